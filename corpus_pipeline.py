"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, token files.

Each stage takes the documents that the stage before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonority.llm import decontaminate, mixing, quality, simhash, token_store
from sonority.llm.common import finished, forget, table

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing to target weights", mixing.stage),
    ("token files", token_store.stage),
]

#: A fitted classifier can't be stated in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each keeps is written to the shared folder and read again.

    A stage's own tables are deleted once its result is written, and that once the next stage's is. The last stage's stay, for the
    result reads them.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = finished(spark, name.replace(" ", "-"), lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if before is not None:
            forget(before)
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
