import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from scholarsieve.llm import repeats


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) per document."""
    seen, out = set(), {}
    for doc in sorted(texts):
        data = (texts[doc] or "").encode()
        covered = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s:s + length]
            if window in seen:
                covered[s:s + length] = b"\1" * length
            seen.add(window)
        runs = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[doc] = len(data), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(data, covered) if not c)).hexdigest()
    return out


def pieces(seed, letters, n=40):
    rng = random.Random(seed)
    base = "".join(rng.choice(letters) for _ in range(600))
    texts = {}
    for doc in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            at = rng.randrange(560)
            parts.append(base[at:at + rng.randrange(1, 120)] if rng.random() < 0.7 else "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(60))))
        texts[doc * 2] = "".join(parts)
    texts |= {200: texts[4], 202: texts[4], 204: None, 206: "", 208: "ab" * 400, 210: base * 3}
    return texts


def check(documents, texts, **options):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeats(documents(texts), **options).collect()}
    assert got == brute(texts, options.get("length", 100))


def test_removed_bytes_match_brute_force(documents):
    check(documents, pieces(1, "abc"), length=16, gram=8, bucket_bytes=300)
    check(documents, pieces(2, "ab"), length=12, gram=6, bucket_bytes=1 << 20)
    check(documents, pieces(3, "abcdefghij"))


def test_hot_anchors_are_split_without_loss(documents):
    check(documents, pieces(4, "ab"), length=12, gram=6, bucket_bytes=500, hot=2)


def test_a_passage_in_many_documents(documents):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(260))
    check(documents, {i: "".join(rng.choice("abcdefgh ") for _ in range(150)) + passage[:100 + i % 160] + "".join(rng.choice("abcdefgh ") for _ in range(50)) for i in range(120)}, hot=16)


def test_suffixes_are_sorted_by_hash_comparisons():
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(2000)).encode(), np.uint8)
    suffixes = repeats.Suffixes(data, 40)
    at = np.array(sorted(rng.sample(range(1960), 700)))
    group = np.sort(np.array([rng.randrange(5) for _ in at]))
    order = suffixes.sort(at, group)
    key = [(group[i], bytes(data[at[i]:at[i] + 40])) for i in order]
    assert key == sorted(key) and sorted(order) == list(range(700))
    x, y = at[:-1], at[1:]
    want = [next((k for k in range(40) if data[a + k] != data[b + k]), 40) for a, b in zip(x, y)]
    assert suffixes.common(x, y).tolist() == want


def test_equal_hashes_are_verified_by_bytes(monkeypatch):
    monkeypatch.setattr(repeats, "span_hash", lambda prefix, a, b: np.zeros(len(np.atleast_1d(a)), np.uint64))
    data = np.frombuffer(b"a" * 20 + b"b" * 20, np.uint8)
    assert repeats.Suffixes(data, 10).equal_neighbours(np.array([0, 25])).tolist() == [False, False]


def test_null_ids_repeats_and_empty_tables(documents):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(300))
    rows = repeats.repeats(documents([(None, text, "s"), (3, text, "s"), (5, text, None), (5, text, None)])).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in rows) == [("3", 0, 0), ("5", 300, 1), ("5", 300, 1), ("None", 0, 0)]
    assert repeats.repeats(documents({1: "a"}).limit(0)).count() == 0


def test_rows_that_share_an_id_lose_only_what_an_earlier_row_holds(documents):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    text, other, shared = make(300), make(400), make(150)
    rows = [(7, text, "s"), (7, text, "s"), (7, other + shared, "s"), (4, shared, "s"), (9, text[:200], None), (None, text, "s")]
    got = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(x) for x in r.spans]) for r in repeats.repeats(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted([(7, 300, 0, []), (7, 300, 300, [(0, 300)]), (7, 550, 150, [(400, 550)]), (4, 150, 0, []), (9, 200, 200, [(0, 200)]), (None, 300, 0, [])], key=str)


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_bucket_is_sorted_in_bounded_parts():
    rng, n, size = np.random.default_rng(4), 20_000, 51
    column = lambda values, kind: [row.tobytes() for row in values.astype(kind).reshape(-1, 50)]
    table = pa.table({"bucket": np.zeros(n // 50, np.int32), "doc_id": np.arange(n // 50), "starts": column(np.arange(n) % 50 * 200, np.int64), "sizes": column(np.full(n, size), np.int64),
                      "offsets": column(np.full(n, 50), np.int64), "anchors": column(np.arange(n) // 4, np.uint64),
                      "bytes": [row.tobytes() for row in rng.integers(97, 123, (n // 50, 50 * (size + 99)), np.uint8)]})
    assert peak_mb(lambda: repeats._sort_bucket(100)(table)) < 110
