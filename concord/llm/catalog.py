"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from concord.llm import anchor_pii, bin_slack, collision_search, gru_lm, license_scan, pivotal_grams, prefix_hash, randomness_tests, simhash_tree, suffix_match, toxicity_gru, walsh_codes, warc_chunks

_MODULES = (
    license_scan, prefix_hash, suffix_match, warc_chunks, anchor_pii, randomness_tests, toxicity_gru, gru_lm, bin_slack, simhash_tree,
    walsh_codes, pivotal_grams, collision_search,
)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
