"""The pipeline against brute force, stage by stage on what the one before kept."""
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from scholarsieve.llm import common, decontamination, mixing, toxicity  # noqa: E402
from test_minhash import classes  # noqa: E402


def test_stages_match_brute_force(spark, sf):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_ids"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        docs_in, docs = docs, common.stored(stage(spark, docs, sf), f"test-{name}")
        outputs.append((docs_in, docs))
        if name != "token_ids":
            assert docs.columns == docs_in.columns
    texts = [[(r.doc_id, r.text, r.source) for r in frame.collect()] for frame, _ in outputs]

    model = toxicity.learn(outputs[0][0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert Counter(texts[1]) == Counter(r for r in texts[0] if model.score(r[1] or "") < 0.5)

    kept = {doc for doc, (_, first) in classes({d: t for d, t, _ in texts[1]}, 5).items() if doc == first}
    assert Counter(texts[2]) == Counter(r for r in texts[1] if r[0] in kept)

    items = [decontamination.plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, t, _ in texts[2] for item in items
             if item in decontamination.plain(t) or (len(t or "") < 3000 and decontamination.best_distance(item, decontamination.plain(t), decontamination.budget(len(item))) <= decontamination.budget(len(item)))}
    assert Counter(texts[3]) == Counter(r for r in texts[2] if r[0] not in leaks)

    rates = {r.doc_id: r._mix_copies for r in mixing.copies(outputs[3][0]).collect()}
    assert Counter(texts[4]) == Counter({r: rates[r[0]] for r in texts[3] if rates[r[0]]})

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    start, want = 0, []
    for doc, text, _ in sorted(texts[4]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in outputs[4][1].collect()) == want
