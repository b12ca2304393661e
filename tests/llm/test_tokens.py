import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholarsieve.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**32])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 4000])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    assert (tokens.unpack(*tokens.pack(ids)) == ids).all()


def test_outliers_go_to_exceptions_and_keep_blocks_narrow():
    random = np.random.default_rng(1)
    ids = np.where(random.random(10_000) < 0.03, 4_000_000_000, random.integers(0, 16, 10_000)).astype(np.uint32)
    starts, payload = tokens.pack(ids)
    assert (tokens.unpack(starts, payload) == ids).all() and len(payload) < 10_000


def test_files_match_the_library(documents, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_IDS", 200)
    texts = {5: "Hello  world\n\n x", 3: "", 9: None, 1: "ß é <|endoftext|> 12", 70: "long " * 900, 8: "same", 2: "same"}
    got = {r.doc_id: r for r in tokens.read_digest(tokens.write_files(documents(texts), PATH)).collect()}
    library = Tokenizer.from_file(PATH)
    start = 0
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_repeated_and_null_ids_and_empty_tables(documents):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, "b", "s"), (1, "c d", "s")]
    got = tokens.read_digest(tokens.write_files(documents(rows), PATH)).collect()
    assert sorted(r.start for r in got) == [0, 2, 4, 6] and sum(r.n_tokens for r in got) == 9
    assert [r.start for r in got if r.doc_id is None] == [0]
    assert tokens.read_digest(tokens.write_files(documents(rows).limit(0), PATH)).count() == 0


ODD = ["", " ", "Hello  World\n\n x", "a <|endoftext|> b", "a<|endoftext|>  b", "don't WE'LL it's 'tis 'S 's", "12 ½ ²³ ªº µ ß", "naïve ÀÉ ÿ × ÷", "İ ǅ ΣΑΣ", "éa ́b",
       "x y z \x85 \x1c\x1d q \x0b\x0c", "東京 とう きょう", "emoji 👩‍👩 ️ x", "...!?,; :-- __ ## ' '", "tab\tnew\r\n line \n \n  two", "\x00\x01 \x7f", "  lead", "trail  ", "a  b   c\t d"]


def test_ids_are_those_of_the_plain_call(monkeypatch):
    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    alphabet = "aB é'’sßΣİ\n\t  12½.,<|>endoftxt́ 東\u3000"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder(PATH).encode(texts) == want
    monkeypatch.setattr(tokens, "SEGMENT", 9)
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    assert tokens.Encoder(PATH).encode(texts) == want


def test_many_unseen_parts_are_one_word_of_the_tokenizer():
    texts = [" ".join(f"w{i * 7919 % 10007}x{i}\n\n\tq{i}" for i in range(k, k + 500)) for k in range(0, 3000, 500)]
    encoder, words = tokens.Encoder(PATH), []

    class Recorder:
        def __getattr__(self, name):
            return getattr(library, name)

        def __setattr__(self, name, value):
            setattr(library, name, value)

        def encode_batch_fast(self, lines, **options):
            rule = library.pre_tokenizer
            words.extend(len(rule.pre_tokenize_str(line)) if rule else 1 for line in lines)
            return library.encode_batch_fast(lines, **options)

    library, encoder.whole = encoder.whole, Recorder()
    got, unseen = encoder.encode(texts), len(encoder.known)
    assert unseen > 3000 and sum(words) <= unseen / 50
    assert got == [np.asarray(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_the_byte_between_parts_merges_with_nothing():
    encoder = tokens.Encoder(PATH)
    name = tokens.BYTE_NAMES[ord(encoder.gap)]
    assert [token for token in encoder.whole.get_vocab() if name in token] == [name] and not tokens._PLAIN.fullmatch(encoder.gap)
