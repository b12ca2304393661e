import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholarsieve.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["", " ", "Hello  World\n\n x", "<|endoftext|>", "a <|startoftext|>b<| c", "don't WE'LL it's 'tis 'S", "1234 ½ ²³ ªº µ ß", "naïve ÀÉ ÿ × ÷", "İstanbul ǅ ΣΑΣ",
       "éa ́b", "x y z \x85 \x1c\x1d q", "東京 とうきょう", "emoji 👩‍👩 ️", "क़ Å ﬁ", "...!?,;: -- __ ##", "tab\tnew\r\nline", "\x00\x01\x7f"]


def test_ids_are_the_librarys():
    rng = random.Random(5)
    alphabet = "aB é'’sßΣİ\n\t 12½.,<|>endoftxt́ 東"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for got, text in zip(packing.Encoder(PATH).encode(texts), texts, strict=True):
        assert got.tolist() == ids_of(text)[:-1], repr(text)


def test_segments_and_forgetting_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 20)
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    texts = [" ".join(ODD), "word " * 50, "x" * 100, " " * 70]
    assert [i.tolist() for i in packing.Encoder(PATH).encode(texts)] == [ids_of(t)[:-1] for t in texts]


def plain_windows(sizes, length, most, least_cut):
    """The same rule over lists: best fit, else a new window, else the fullest goes."""
    opened, done = [], []  # windows as lists of (item, start, tokens)
    used = lambda w: sum(p[2] for p in w)
    for item, size in enumerate(sizes):
        start = 0
        while size:
            fits = [w for w in opened if length - used(w) >= size]
            if fits:
                window = max(fits, key=used)
            elif len(opened) < most:
                window = []
                opened.append(window)
            else:
                window = max(opened, key=used)
                room = length - used(window)
                if room >= least_cut:
                    window.append((item, start, room))
                    size, start = size - room, start + room
                opened.remove(window)
                done.append(window)
                continue
            window.append((item, start, size))
            if used(window) == length:
                opened.remove(window)
                done.append(window)
            break
    return done, opened


@pytest.mark.parametrize("most, least_cut", [(1, 1), (3, 5), (8, 16)])
def test_windows_follow_the_rule(most, least_cut):
    rng = random.Random(most)
    sizes = [rng.choice([1, 2, 3, rng.randrange(1, 100), rng.randrange(50, 100)]) for _ in range(500)]
    windows = packing.Windows(100, most, least_cut)
    done = [w for item, size in enumerate(sizes) for w in windows.place(item, np.zeros(size, np.uint32))]
    want, opened = plain_windows(sizes, 100, most, least_cut)
    shape = lambda ws: [[(d, s, len(i)) for d, s, i in w] for w in ws]
    # Windows of equal room are interchangeable, so fills and the number of windows are what the rule fixes.
    assert sorted(sum(p[2] for p in w) for w in shape(done)) == sorted(sum(p[2] for p in w) for w in want)
    assert sorted(sum(p[2] for p in w) for w in shape(windows.pieces.values())) == sorted(sum(p[2] for p in w) for w in opened)
    assert len(windows.pieces) <= most and all(100 - sum(p[2] for p in w) < least_cut for w in shape(done))


def test_last_tokens_need_no_padding():
    assert packing.cuts(0, 8, True) == [] and packing.cuts(29, 8, True) == [8, 8, 8, 4, 1] and packing.cuts(29, 8, False) == [8, 8, 8]


def check(docs, table, **options):
    pieces = packing.pack(table, PATH, **options)
    got, digest = pieces.collect(), packing.digest(pieces).collect()
    length, least = options.get("length", 4096), options.get("least_cut", 16)
    want = sorted(map(tuple, map(ids_of, (t for _, t, _ in docs))))
    # Pieces of a document: rows with equal ids and texts can't be told apart, so each start occurs as often as the document.
    joined = defaultdict(lambda: defaultdict(list))
    for p in got:
        joined[p.doc_id][p.start].append(tuple(p.ids))
        assert len(p.ids) > 0
    if len({d for d, *_ in docs}) == len(docs):
        assert sorted(tuple(i for start in sorted(starts) for ids in starts[start] for i in ids) for starts in joined.values()) == want
        for starts in joined.values():
            assert all(len(ids) == 1 for ids in starts.values())
            place = 0
            for start in sorted(starts):
                assert start == place
                place += len(starts[start][0])
    assert sum(len(p.ids) for p in got) == sum(map(len, want))
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, len(p.ids)))
    padding = 0
    for placed in sequences.values():
        end = 0
        for offset, size in sorted(placed):
            assert offset == end
            end += size
        assert end <= length
        padding += 0 if end & (end - 1) == 0 else length - end
    assert padding < least * len(sequences)
    sums = sorted((p.doc_id or 0, p.start, len(p.ids), zlib.crc32(np.array(p.ids, "<u4").tobytes()), p.doc_tokens, p.sequence_id, p.offset) for p in got)
    assert sums == sorted((r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in digest)
    return got


def test_every_id_lies_in_one_piece(documents):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "x9"]) for _ in range(rng.choice([0, 1, 5, 40, 300]))), "s") for i in range(200)]
    docs += [(900, None, "s"), (901, "word " * 5000, None)]
    check(docs, documents(docs, 7), length=256, windows=4, fan_in=2)
    check(docs, documents(docs, 7))


def test_repeated_rows_null_ids_and_clashing_names(documents):
    docs = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "z", "s"), (None, None, "s"), (1, "d", "s")]
    table = documents(docs)
    for name in ("ids", "start", "offset", "sequence_id", "origin", "group"):
        table = table.withColumn(name, F.lit(1))
    got = check(docs, table)
    assert sorted(p.doc_tokens for p in got if p.start == 0) == [1, 2, 2, 4, 4]


def test_empty_table(documents):
    assert packing.digest(packing.pack(documents([(1, "a", "s")]).limit(0), PATH)).count() == 0


def test_registered_query_holds_every_document(spark, sf):
    from scholarsieve.llm import queries
    rows = queries.op12_sequence_packing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = defaultdict(list)
    for r in rows:
        held[r.doc_id].append(r)
    assert held.keys() == texts.keys()
    for doc, pieces in held.items():
        ids = ids_of(texts[doc])
        place = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (place, len(ids))
            place += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:place], "<u4").tobytes())
        assert place == len(ids)
