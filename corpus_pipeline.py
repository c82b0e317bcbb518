"""The corpus pipeline: five stages over ``documents``.

1. quality rules: documents that the rules reject go;
2. near-duplicates: one row of each group stays, that of the smallest id (a null
   id comes last, repeated rows count as one);
3. decontamination: documents that hold a benchmark window go;
4. secrets: every secret span is masked in place, all documents stay;
5. mixing: each source's documents are taken to its target; the rows are the
   documents with words taken, with ``epochs`` (whole passes over the source)
   and ``taken`` (words the mix takes, repeats counted).

Null and empty texts fall under the quality rules' least number of words and go
in the first stage; repeated rows and null ids are as stage 2 says; very long
texts are read whole; an empty table gives an empty table from every stage;
further columns pass through.

Each stage's rows are written as Parquet in the shared folder and read again
as the next one's documents, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearline.llm import bbit, mixing, positions, rules, secrets
from nearline.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bbit.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return positions.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("taken > 0").select("__row.*", "epochs", "taken")


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("mix_sources", mix_sources)]

#: The quality stage hashes n-grams with a function that DuckDB lacks; the
#: tests compare run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
