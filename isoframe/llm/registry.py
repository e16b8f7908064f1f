"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isoframe.llm.op10_rules import ORACLE as OP10_SQL
from isoframe.llm.op10_rules import op10_rules
from isoframe.llm.op11_negatives import ORACLE as OP11_SQL
from isoframe.llm.op11_negatives import op11_negatives
from isoframe.llm.op12_clusters import ORACLE as OP12_SQL
from isoframe.llm.op12_clusters import op12_clusters
from isoframe.llm.op13_substrings import ORACLE as OP13_SQL
from isoframe.llm.op13_substrings import op13_substrings
from isoframe.llm.op1_quality import op1_quality
from isoframe.llm.op2_simhash import op2_simhash
from isoframe.llm.op3_langid import op3_langid
from isoframe.llm.op4_packing import op4_packing
from isoframe.llm.op5_toxicity import op5_toxicity
from isoframe.llm.op6_mixing import op6_mixing
from isoframe.llm.op7_sketches import op7_sketches
from isoframe.llm.op8_tokens import op8_tokens
from isoframe.llm.op9_licenses import op9_licenses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_langid": op3_langid,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_sketches": op7_sketches,
    "op8_tokens": op8_tokens,
    "op9_licenses": op9_licenses,
    "op10_rules": op10_rules,
    "op11_negatives": op11_negatives,
    "op12_clusters": op12_clusters,
    "op13_substrings": op13_substrings,
}

ORACLES: dict[str, str] = {"op10_rules": OP10_SQL, "op11_negatives": OP11_SQL, "op12_clusters": OP12_SQL, "op13_substrings": OP13_SQL}
