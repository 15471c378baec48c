"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

A row is known by its doc_id and its text, so other texts under the same id are judged on their own and repeated rows
alike. Null and empty texts fail the quality rules. Rows without a doc_id are judged by the base rules, lose repeated lines like others,
take part in no near-duplicate group and are mixed and encoded. Extra columns are passed on up to the last stage. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from copse.llm._shared import drop_tables, table, written
from copse.llm.bpe_codec import bpe_stage
from copse.llm.curriculum import mix_stage
from copse.llm.fuzzy_lines import lines_stage
from copse.llm.minmax_dedup import minhash_stage
from copse.llm.risk_rules import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("minhash_near_dedup", minhash_stage),
    ("source_mixing", mix_stage),
    ("byte_bpe", bpe_stage),
]

#: Near-duplicate groups and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is a table in the shared folder, until the next one's is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # nothing reads it any more
            drop_tables(before)
        before = docs
    return docs
