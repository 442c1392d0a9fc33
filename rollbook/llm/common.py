"""What several of the operators need: held-out folds, stratified samples, word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.session import materialise, shared_folder

#: Spark removes the shuffle files of a statement at its end where this is on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What counts as a word: a run of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def stratified(df: DataFrame, label: str, per_class: int, *, key: str) -> DataFrame:
    """About ``per_class`` rows of every label, the same ones on every run.

    Rows are kept whose hashed key lies below the share of their label, so the sample
    needs one count per label and no sort.  The number of labels is that of the model's outputs.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    point = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(point < share)


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *columns: str) -> DataFrame:
    """``key, label`` and ``columns`` of about ``per_class`` documents of each label, 0 and 1.

    The sample is drawn from ``labels`` (``doc_id`` and the label) before the join, so that
    the documents, of which the others are not moved, are met with few ids.  Of rows that share an
    id the one with the smallest columns is taken; labels that contradict each other are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("key"))
    known = known.agg(F.min(label).cast("int").alias("label"), F.max(label).alias("most")).where("label = most").drop("most")
    chosen = materialise(stratified(known, "label", per_class, key="key"), "sample")
    rows = docs.select(F.col("doc_id").alias("key"), *columns).join(chosen, "key")
    least = F.min(F.struct(*columns)).alias("row")
    return rows.groupBy("key", "label").agg(least).select("key", "label", "row.*")


def settle(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back, like ``materialise``, without its shuffle files staying on disk.

    For jobs of several steps whose shuffles are as large as their input.  ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, purpose), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
