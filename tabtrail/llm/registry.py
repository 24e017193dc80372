"""All queries of this folder, the pipeline included, and their DuckDB statements."""

from __future__ import annotations

from tabtrail.llm import queries_learned, queries_lines, queries_manifest, queries_native, queries_pages, queries_rules, queries_runs, queries_text, queries_tokens

MODULES = (queries_text, queries_rules, queries_native, queries_learned, queries_tokens, queries_pages, queries_runs, queries_manifest, queries_lines)


def queries() -> dict:
    import corpus_pipeline
    return {k: q for m in MODULES for k, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict:
    import corpus_pipeline
    found = {k: s for m in MODULES for k, s in m.ORACLES.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
