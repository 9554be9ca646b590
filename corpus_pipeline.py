"""The corpus pipeline: quality, near-duplicates, repeated passages, contamination, mixing.

Each stage takes the documents its predecessor kept and returns the columns of documents; the last adds rate and copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm.decontam import uncontaminated
from slotweave.llm.mixing import soft_mixing
from slotweave.llm.plans import AT_MOST, TARGETS, domains
from slotweave.llm.quality import accepted
from slotweave.llm.simhash import one_of_each
from slotweave.llm.substring import passages_cut
from slotweave.session import cut_lineage, prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return accepted(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: three-word shingles, three bits."""
    return one_of_each(docs, shingle=3, radius=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut."""
    return passages_cut(docs, window=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in the benchmark go; others stay as they are."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as bring the domains to their target shares of tokens; bad ones get no more than they have."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = soft_mixing(docs, domains(labels), TARGETS, extra=tuple(docs.columns), at_most=AT_MOST)
    copies = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    own = [c for c in docs.columns if c in mixed.columns and c not in ("n_tokens", "posterior", "rate", "copies", "copy")]
    return copies.select(*own, "rate", "copy")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
