"""The queries of this subpackage by the module that has them, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.oracles import ORACLES

#: Each query's module, in which a function has the query's name.
MODULES = {
    "op1_minhash": "minhash",
    "op2_warc": "warc",
    "op3_langid": "langid",
    "op4_decontaminate": "decontaminate",
    "op5_bpe": "bpe",
    "op6_simhash": "simhash",
    "op7_licenses": "licenses",
    "op8_secrets": "secrets",
    "op9_toxicity": "toxicity",
    "op10_html": "html",
    "op11_phrases": "phrases",
    "op12_divergence": "divergence",
    "op13_repeats": "repeats",
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query of that name; raises ImportError if a library that its module needs is missing."""
    return getattr(import_module(f"marginalia.llm.{MODULES[name]}"), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(name) for name in MODULES}


__all__ = ["MODULES", "ORACLES", "queries", "query"]
