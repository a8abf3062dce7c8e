"""Queries of the numbered operators and their SQL."""

from __future__ import annotations

from opsloom.llm import (
    content_archive,
    conversation_repair,
    decontamination,
    language_id,
    line_quality,
    ngram_join,
    periodic_runs,
    pipeline,
    quality_rules,
    sharding,
    source_mixing,
    substring_dedup,
    token_store,
    toxicity,
)

MODULES = [content_archive, sharding, token_store, decontamination, quality_rules, line_quality, language_id, source_mixing, ngram_join, substring_dedup, toxicity, conversation_repair, periodic_runs]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": pipeline.run}


def oracle_sql() -> dict:
    own = {k: f for m in MODULES for k, f in m.ORACLE.items()}
    return own | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
