"""The queries of the subpackage: one `opN_<name>` for each operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from quarry.llm import decontaminate, html_extract, jaccard_join, language_id, packing, quality, resampling, simhash, substring_dedup, token_counts, topk_search, toxicity, whitening

_MODULES = (substring_dedup, packing, decontaminate, topk_search, language_id, toxicity, quality, token_counts, jaccard_join, html_extract, resampling, whitening, simhash)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {name: text for m in _MODULES for name, text in getattr(m, "SQL", {}).items()}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
