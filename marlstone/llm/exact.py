"""Exact dedup, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z.  Pass 1 reads each whole text once and leaves a narrow table: id, row
number, 128-bit content hash, SHA-256.  Rows are counted per hash with partial sums in each task, so that a hash that a third
of all rows have costs one row a task.  Pass 2 compares bytes: of each hash that several rows have, the least and the greatest text
are found (again with partial results); where they differ, different texts share the hash, and such rows are
grouped by their texts instead.  The verdicts go back to the narrow rows by a join that adaptive execution can split.

The hashes that several rows have are sent to the texts up to ``common.BROADCAST_ROWS`` of them; beyond it the join shuffles each text once.

Defined results: a null text counts as empty, and empty texts are equal; of equal texts the row with the largest doc_id stays
(``keep="smallest"``: the smallest), a null doc_id only where all are null; of rows that are equal in text and that doc_id too exactly
one stays, and ``group_size`` counts each; texts of any length are hashed and compared whole; an empty table gives no rows; ``dedup``
returns the columns of docs, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def _verdicts(rows: DataFrame, by: list[str], keep: str) -> DataFrame:
    """rows (doc_id, row, sha and the columns of by) with keep_id, group_size and kept."""
    largest = keep == "largest"  # null is the smallest value of a struct's field
    order = F.struct("doc_id", (-F.col("row")).alias("row")) if largest else F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.max if largest else F.min)(order).alias("first"))
    repeated = groups.where("n > 1").select(*by, "n", F.col("first.doc_id").alias("first_id"), F.abs("first.row").alias("first_row"))
    found = rows.join(repeated, by, "left")
    alone = F.col("n").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def decisions(docs: DataFrame, keep: str = "largest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    texts = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), normalised(docs["text"]).alias("norm"))
    hashed = texts.select("*", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("sha"))
    rows = common.materialize(hashed.drop("norm"), "digests")
    repeated = common.materialize(rows.groupBy("digest").count().where("count > 1").select("digest"), "repeated")
    suspects = hashed.select("digest", "norm").join(common.narrow_side(repeated), "digest", "left_semi")
    extremes = suspects.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    collided = common.materialize(extremes.where("low != high").select("digest"), "collided")
    if collided.isEmpty():
        return _verdicts(rows, ["digest"], keep)
    few = common.narrow_side(collided)
    apart = common.materialize(hashed.join(few, "digest", "left_semi"), "apart")
    return _verdicts(rows.join(few, "digest", "left_anti"), ["digest"], keep).unionByName(_verdicts(apart, ["digest", "norm"], keep))


def dedup(docs: DataFrame, keep: str = "largest", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """docs, all columns, less all rows of equal texts but one."""
    found = common.materialize(decisions(docs, keep, digest).where(~F.col("kept")), "lost")
    own_id, own_sha = common.free_names(docs, "id", "sha")
    own = found["doc_id"].eqNullSafe(found["keep_id"])  # repeats of the very row that stays
    keys = lambda rows: rows.select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha")).distinct()
    tagged = docs.select("*", F.col("doc_id").cast("long").alias(own_id), F.sha2(normalised(docs["text"]), 256).alias(own_sha))

    def joined(rows: DataFrame, how: str) -> DataFrame:
        rows = common.narrow_side(rows)
        return tagged.join(rows, tagged[own_id].eqNullSafe(rows["lost_id"]) & (tagged[own_sha] == rows["lost_sha"]), how)

    kept, repeats = joined(keys(found), "left_anti"), keys(found.where(own))
    if not repeats.isEmpty():
        kept = kept.unionByName(joined(repeats, "left_semi").dropDuplicates([own_id, own_sha]))
    return kept.drop(own_id, own_sha)


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(common.read(spark, sf_dir, "documents"))
