"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from kbforge.llm import decontamination, lexical_search, merkle, near_dedup, quality_rules, substring_dedup


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": substring_dedup.ORACLE_SQL,
        "op6_near_dedup": near_dedup.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op11_decontamination": decontamination.ORACLE_SQL,
        "op12_lexical_search": lexical_search.ORACLE_SQL,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
