"""A corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes every stage's result as Parquet and gives it to the next, so each stage works on all that the one before kept. A
stage's table is removed once the next one is written; the last one stays, as the result is read from it.

Defined cases: an empty table gives an empty result. Null, empty and blank texts fail the quality rules. Repeated rows
each pass the quality rules and keep their lines (rows that share a doc_id are one place there); of rows that share a
doc_id the near-duplicate stage keeps the first by text. Rows with a null doc_id pass the line and near-duplicate stages as
they are and are packed. Ties go to the smaller doc_id. Other columns pass through all stages but the last, whatever
their names, and are dropped by packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import line_dedup, minmax_dedup, mixing, packing, quality
from tessella.llm.common import scratch, shared_folder, table
from tessella.llm.queries import tokenizer_file
from tessella.sources.scratch import remove

#: Near-duplicates: five words a shingle, a similarity of 0.8.
WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax_dedup.deduplicate(docs, WORDS, PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the mixing stage's topics nor token ids; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):  # what the stage wrote on the way goes once its result is stored
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
