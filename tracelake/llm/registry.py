"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tracelake.llm import chat_rotation, decontaminate, exact_dedup, language_mixture, mixing, near_dedup, pii_tagger, suffix_dedup, toxicity_knn, url_rank

MODULES = (
    language_mixture,
    mixing,
    decontaminate,
    chat_rotation,
    exact_dedup,
    pii_tagger,
    suffix_dedup,
    url_rank,
    near_dedup,
    toxicity_knn,
)


def queries() -> dict:
    out = {name: query for module in MODULES for name, query in module.QUERIES.items()}
    if corpus_pipeline.STAGES:
        out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
    if corpus_pipeline.STAGES and corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
