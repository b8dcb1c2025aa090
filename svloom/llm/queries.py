"""Queries and SQL of this subpackage, for the driver contract."""

from __future__ import annotations

from importlib import import_module

#: query -> module that has a function of this name
QUERIES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_voronoi_knn": "knn",
    "op3_html_text": "html_text",
    "op4_importance_resampling": "quality",
    "op5_bpe": "bpe",
    "op6_packing": "packing",
    "op7_url_filter": "url_filter",
    "op8_setsketch_dedup": "near_dedup",
    "op9_progressive_jpeg": "media",
    "op10_warc": "warc",
}
#: Those whose module has SQL for the result
WITH_SQL = ("op2_voronoi_knn", "op10_warc")


def _query(module: str, name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"svloom.llm.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _query(module, name) for name, module in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: getattr(import_module(f"svloom.llm.{QUERIES[name]}"), "ORACLE") for name in WITH_SQL}
