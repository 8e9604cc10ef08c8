"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, decontamination and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, lines, packing, quality, simhash
from tidemark.llm.common import dropped_but, owned, saved, table

#: (name, function of (spark, docs, sf_dir)); each stage's rows are written and read again for the next.
STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontaminate", decontaminate.stage),
    ("pack", packing.stage),
]
#: Components of fuzzy links, and token ids, have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables of a stage go once its own rows are written."""
    docs = table(spark, sf_dir, "documents")
    with owned():
        for name, stage in STAGES[:-1]:
            docs = saved(stage(spark, docs, sf_dir), name)
            dropped_but(spark, docs)
        out = STAGES[-1][1](spark, docs, sf_dir)
        dropped_but(spark, out)
    return out
