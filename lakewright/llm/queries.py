"""The queries of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from importlib import import_module

#: Query name: module of this subpackage that has a function of that name.
QUERIES = {
    "op1_main_text": "html_extract",
    "op2_decontaminate": "decontam",
    "op3_line_dedup": "line_dedup",
    "op4_near_dups": "minhash",
    "op5_quality": "quality",
    "op6_url_filter": "url_filter",
    "op7_toxicity": "toxicity",
    "op8_langid": "langid",
    "op9_packing": "packing",
    "op10_secrets": "secrets",
    "op11_tandem_runs": "tandem",
    "op12_clusters": "balltree",
    "op13_ngram_join": "ngram_join",
}


def pipeline(spark, sf_dir: str):
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict:
    found = {name: getattr(import_module(f"lakewright.llm.{module}"), name) for name, module in QUERIES.items()}
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    modules = {name: import_module(f"lakewright.llm.{module}") for name, module in QUERIES.items()}
    return {name: module.ORACLE_SQL for name, module in modules.items() if hasattr(module, "ORACLE_SQL")}
