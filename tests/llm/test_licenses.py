import random
import re

from scholarsieve.llm import licenses


def shingles(text):
    words = re.findall(r"[A-Za-z0-9]+", (text or "").lower())
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_planted_notices_are_found_whole_or_damaged(documents):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts, want = {}, set()
    for i, (name, notice) in enumerate(licenses.TEMPLATES.items()):
        texts[i] = f"{prose(rng.randrange(200))} {notice.upper()}\n{prose(rng.randrange(200))}"
        words = notice.split()
        if len(words) > 40:
            words[len(words) // 2] = "changed"
            texts[100 + i] = f"{prose(50)} {' '.join(words)} {prose(900)}"
            want.add((100 + i, name))
        want.add((i, name))
    texts |= {300: prose(3000), 301: None, 302: "", 303: "Released under the"}
    got = {(r.doc_id, r.license): r for r in licenses.scan(documents(texts)).collect()}
    assert want <= got.keys()
    for (doc, name), r in got.items():
        template = shingles(licenses.TEMPLATES[name])
        share = len(template & shingles(texts[doc])) / len(template)
        assert r.containment >= 0.8 and r.containment <= share + 1e-9
    # Whatever the text holds to 80% in one place must be found; here every shared shingle lies in one place.
    for doc, text in texts.items():
        for name, notice in licenses.TEMPLATES.items():
            if len(shingles(notice) & shingles(text)) >= 0.8 * len(shingles(notice)):
                assert (doc, name) in got


def test_given_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    lines = {"MIT-line", "Apache-2.0-line", "GPL-3.0-line", "CC-BY-NC-4.0-line"}
    assert {g for g in got if g[1] in lines} == {(r.doc_id, n) for r in docs.collect() for n in lines if licenses.TEMPLATES[n] in r.text}


def test_spans_repeats_and_empty_tables(documents):
    docs = documents([(1, "x y Released under the MIT License. z", "s"), (1, "Released under the MIT License.", "s"), (None, "Released under the MIT License.", None)])
    rows = licenses.scan(docs).collect()
    assert sorted((str(r.doc_id), r.first_word, r.n_words) for r in rows) == [("1", 0, 5), ("1", 2, 5), ("None", 0, 5)]
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_usual_licenses_and_wordings_are_in_the_library(documents):
    fill = " and some more words of the document follow here"
    texts = {
        "BSD-3-Clause-body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                             "* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                             "* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                             "documentation and/or other materials provided with the distribution. * Neither the name of Acme nor the names of its contributors may be used to "
                             "endorse or promote products derived from this software without specific prior written permission. " + licenses._BSD_AS_IS,
        "ISC-body": licenses.TEMPLATES["ISC-body"].replace("and/or", "and"), "Zlib-body": licenses.TEMPLATES["Zlib-body"], "GPL-2.0-notice": licenses.TEMPLATES["GPL-2.0-notice"],
        "LGPL-2.1-notice": licenses.TEMPLATES["LGPL-2.1-notice"], "AGPL-3.0-notice": licenses.TEMPLATES["AGPL-3.0-notice"], "EPL-2.0-notice": licenses.TEMPLATES["EPL-2.0-notice"],
        "MIT-licensed-line": "This project is licensed under the MIT License.", "Apache-2.0-terms-line": "You may use it under the terms of the Apache License 2.0.",
    }
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(documents({i: text + fill for i, text in enumerate(texts.values())})).collect()}
    for i, name in enumerate(texts):
        assert (i, name) in got, name
        if "GPL" in name:  # their notices differ in few words: the highest share names the license
            assert got[i, name] == max(share for (doc, _), share in got.items() if doc == i), name
