"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads back as the next stage's docs.
All but the last return the columns of ``documents``; null texts stay as they
are unless a rule rejects them.  Columns beyond those of ``documents`` go at
every stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import small, stored, table
from nimbara.llm.decontaminate import decontaminate
from nimbara.llm.line_dedup import line_dedup
from nimbara.llm.ngram_join import similar_classes
from nimbara.llm.packing import VOCABULARY, pack
from nimbara.llm.quality import quality_rules
from nimbara.llm.token_counts import count_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that a broadcast list may name.
SMALL = 500_000


def _without(docs: DataFrame, gone: DataFrame, *of: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id and hash of the columns ``of`` are not in ``gone`` (_d, _k)."""
    gone = small(stored(gone, "gone"), SMALL)
    return docs.join(gone, (F.xxhash64(*of) == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go; rows equal in all that is judged go or stay together."""
    docs, judged = docs.select(*COLUMNS), ("doc_id", "text", "lang", "source")
    keyed = docs.select(*judged, F.xxhash64(*judged).alias("_k"))
    gone = quality_rules(keyed).filter(~F.col("kept")).select(F.col("doc_id").alias("_d"), "_k")
    return _without(docs, gone, *judged)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; every document stays."""
    out = line_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents one row stays: smallest id, then text hash, then other columns.

    Documents without words are no duplicates of each other and stay.
    """
    docs = docs.select(*COLUMNS)
    classes = stored(similar_classes(docs).filter(F.col("class_size") > 1).select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "head", "head_key"), "classes")
    first = (F.col("_k") == F.col("head_key")) & F.col("_d").eqNullSafe(F.col("head"))
    again = stored(classes.filter(first).groupBy("_d", "_k").count().filter("count > 1").select("_d", "_k"), "again")
    gone = classes.filter(~first).select("_d", "_k")
    if not again.limit(1).count():
        return _without(docs, gone, "doc_id", "text")
    # Of rows equal in id and text, the one of least other columns stays.
    same = (F.xxhash64("doc_id", "text") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = docs.join(small(again, SMALL), same).groupBy("doc_id", "_k").agg(F.min(F.struct(*sorted(rest, key="text".__eq__))).alias("r"))
    return _without(docs, gone.unionByName(again), "doc_id", "text").unionByName(one.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in rest]))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    docs = docs.select(*COLUMNS)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = found.filter("contaminated").select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"))
    return _without(docs, gone, "doc_id", "text")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches in length buckets of least padding; texts stay with their slot."""
    return pack(stored(count_tokens(docs.select(*COLUMNS), VOCABULARY, out="length"), "lengths"))


STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_lines),
    ("ngram_join", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("packing", stage_packing),
]

#: Quantile sketches, the forest and the dynamic program have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
