"""Exact duplicates with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty. A mergeable
Misra-Gries summary (Spark's frequent-items sketch) finds digests that may be frequent, an exact count
verifies them, and the few winners are broadcast, so a digest that holds a third of all rows is decided
on the map side. All other digests take one ordinary shuffle, in which no group exceeds the threshold.

Nulls: a null doc_id is a row like any other and ranks below every id. Ties: among rows with equal text
and equal largest doc_id exactly one stays. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradrift.llm.common import Scratch, lower_ascii, own_name, with_rows

#: A digest is heavy with at least 1/HEAVY_SHARE of all rows, so there are HEAVY_SHARE winners at most.
HEAVY_SHARE = 1024
#: Counters of the summary. Its error is below 3.5 / TRACKED of the rows, so no heavy digest is missed among CANDIDATES.
TRACKED, CANDIDATES = 16384, 6000
#: Groups below this size never need the split.
LEAST_HEAVY = 64


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(text), F.lit(""))), 256)).alias("digest"))


def heavy_hitters(rows: DataFrame, n: int) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of the digests with at least n / HEAVY_SHARE rows; HEAVY_SHARE rows at
    most. rows: doc_id, digest, row."""
    least = max(LEAST_HEAVY, -(-n // HEAVY_SHARE))
    if n < least:
        return rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(0).cast("long").alias("group_size")).limit(0)
    short = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    parts = rows.select(short.alias("short"), (F.spark_partition_id() % 64).alias("part"))
    parts = parts.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(short, {TRACKED})").alias("s"))
    # 64 summaries at most; a partition without any would break the combining aggregate
    top = parts.coalesce(1).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s")).select(F.expr(f"inline(approx_top_k_estimate(s, {CANDIDATES}))"))
    top = top.where(F.col("count") >= least).select(F.col("item").alias("short"))
    found = rows.withColumn("short", short).join(F.broadcast(top), "short", "left_semi")
    found = found.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")).where(F.col("group_size") >= least)
    return found.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "dedup")
    # rows get a number when they are written, which tells those apart that share an id and a text
    rows = scratch.save(digests(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "digests")
    heavy = scratch.save(heavy_hitters(rows, rows.count()).coalesce(1), "heavy")  # bounded by HEAVY_SHARE rows
    split = rows.join(F.broadcast(heavy), "digest", "left")
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    known = split.where("group_size is not null").withColumn("kept", F.col("row") == F.col("keep_row"))
    rest = split.where("group_size is null").select("doc_id", "digest", "row")
    group = Window.partitionBy("digest")
    best = F.max(F.struct("doc_id", "row")).over(group)  # a null id ranks below every other
    rest = rest.withColumns({"best": best, "group_size": F.count(F.lit(1)).over(group)})
    rest = rest.withColumns({"keep_id": F.col("best.doc_id"), "kept": F.col("best.row") == F.col("row")})
    return known.select(columns).unionByName(rest.select(columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of equal texts."""
    scratch = Scratch(docs.sparkSession, "dedup-stage")
    mark = F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)
    found = scratch.save(exact_dedup(docs).select("doc_id", F.col("text_sha256").alias("mark"), "kept"), "found")
    seen = found.groupBy("doc_id", "mark").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n"))
    gone, again = seen.where("kept = 0"), seen.where("kept > 0 and n > 1")
    left = with_rows(docs, gone, "left_anti", mark)
    if again.isEmpty():
        return left
    # equal texts of one id
    name = own_name()
    repeated = with_rows(left, again, "left_semi", mark).withColumn(name, mark).dropDuplicates(["doc_id", name])
    return with_rows(left, again, "left_anti", mark).unionByName(repeated.drop(name))
