"""Operators for large training-data corpora; nothing else in the library imports this subpackage."""
import os
from pathlib import Path

from pyspark import cloudpickle

from scholarsieve.llm import (common, decontamination, divergence, embeddings, filter_audit, html_text, licenses, minhash, packing, repeats,
                              secrets, tokens, toxicity)

# Where the workers' path doesn't name the library's folder, the code of the tasks travels with the job.
_ROOT = Path(__file__).resolve().parents[2]
if not any(path and Path(path).resolve() == _ROOT for path in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
    for _module in (common, decontamination, divergence, embeddings, filter_audit, html_text, licenses, minhash, packing, repeats, secrets, tokens,
                    toxicity):
        cloudpickle.register_pickle_by_value(_module)
