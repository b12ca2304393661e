import random

from pyspark.sql import functions as F

from scholarsieve.llm import decontamination as d


def levenshtein_anywhere(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def edited(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.4 or at == len(out):
            out[at:at] = [rng.choice(letters)]
        elif kind < 0.7:
            del out[at]
        else:
            out[at] = rng.choice(letters)
    return "".join(out)


def test_search_matches_brute_force():
    rng, found = random.Random(3), 0
    for trial in range(250):
        letters = "abcd" if trial % 2 else "ab "
        items = [(i, d.plain("".join(rng.choice(letters) for _ in range(rng.randrange(20, 60)))) or "a") for i in range(4)]
        text = d.plain("".join(rng.choice(letters) for _ in range(30)) + edited(rng, rng.choice(items)[1], rng.randrange(8), letters) + "".join(rng.choice(letters) for _ in range(30)))
        want = {i: n for i, (_, p) in enumerate(items) if (n := levenshtein_anywhere(p, text)) <= d.budget(len(p))}
        assert d.Matcher(items).search(text) == want
        found += len(want)
    assert found > 100


def test_planted_leaks_are_found_and_clean_documents_stay(spark, documents):
    rng = random.Random(1)
    words = ["the", "of", "and", "other", "thing", "rest", "in", "house", "green", "seven"]
    items = {i: " ".join(rng.choice(words) for _ in range(25)) for i in range(30)}
    prose = lambda: " ".join(rng.choice(words) for _ in range(200))
    texts = {i: prose() for i in range(60)}
    for i in range(0, 20):
        texts[i] = prose() + " " + edited(rng, items[i], 6, "xyz") + ", " + prose()
    texts[20] = items[20].upper().replace(" ", "\n - ")
    texts[21], texts[22] = None, ""
    texts[59] = prose() * 40 + items[29]
    docs = documents(texts)
    benchmark = spark.createDataFrame([*items.items(), (98, None), (99, "short"), (100, items[29])], "item_id long, text string")
    want = {(doc, i) for doc, t in texts.items() for i, item in {**items, 100: items[29]}.items()
            if levenshtein_anywhere(d.plain(item), d.plain(t)) <= d.budget(len(d.plain(item)))}
    got = {(r.doc_id, r.item_id) for r in d.matches(docs, benchmark).collect()}
    assert got == want and {(i, i) for i in range(21)} <= got and (59, 100) in got
    kept = d.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts) - {doc for doc, _ in want}


def test_item_blocks_cover_all_items(spark):
    benchmark = spark.createDataFrame([(i, f"item number {i} has some thirty letters in it") for i in range(50)], "item_id long, text string")
    blocks = list(d.item_blocks(benchmark, block_chars=300))
    assert len(blocks) > 5 and sorted(i for b in blocks for i, _ in b) == list(range(50))


def test_nulls_repeats_and_empty_tables(spark, documents):
    item = "a passage that is long enough to count as one"
    docs = documents([(None, item, "s"), (1, item, "s"), (1, "x " + item, "s"), (2, "clean", None)])
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.distance) for r in d.matches(docs, benchmark).collect()) == [("1", 0), ("None", 0)]
    assert [r.doc_id for r in d.clean(docs, benchmark).collect()] == [2]
    assert d.matches(docs, benchmark.limit(0)).count() == 0 and d.clean(docs, benchmark.limit(0)).count() == 4
    assert d.matches(docs.limit(0), benchmark).count() == 0


def test_short_items_match_unchanged_between_word_edges(spark, documents):
    items = spark.createDataFrame([(1, "Paris is it"), (2, "yes"), (3, "!?"), (4, None)], "item_id long, text string")
    docs = documents({1: "They say: PARIS, is it!", 2: "paris is itself", 3: "yesterday", 4: "Yes", 5: "paris was it", 6: "!?"})
    assert sorted((r.doc_id, r.item_id, r.distance) for r in d.matches(docs, items).collect()) == [(1, 1, 0), (4, 2, 0)]


def test_clashing_names_stay(spark, documents):
    items = spark.createDataFrame([(1, "a sentence that is long enough to be an item of its own")], "item_id long, text string")
    docs = documents({1: "Well: a sentence that is long enough to be an item of its own.", 2: "clean"})
    for name in ("_hit", "distance", "item_id", "docs", "hits"):
        docs = docs.withColumn(name, F.lit(name))
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
