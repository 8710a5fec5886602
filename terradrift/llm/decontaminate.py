"""Benchmark decontamination by size-partitioned MinHash containment search.

An item leaks into a document that holds at least `threshold` of the item's distinct shingles (five
words; a shorter item is one shingle of all its words). A document's own MinHash says nothing about a
short item inside a long text, so the sketch is taken on the item's side and sized by it: of an item
with n shingles, any n - ceil(threshold * n) + 1 must include one that every leaking document holds, so
the bottom-k MinHash of exactly that k finds all of them. Items are partitioned by size (powers of two);
a partition has its own greatest sketch value and its own least number of shingles that a document must have, and a document
takes part in the partitions that it is large enough for: hashes over all their bounds are dropped before the join, and
what is left meets the sketches of those partitions only.
Candidates are verified by counting all shingles that item and document share.

Nulls: a null or empty text has no shingles and matches nothing; null ids are ids, of documents and items alike. Rows that
repeat an id count as one document (item). drop_contaminated judges texts instead, whatever their ids: a row goes if its own
text holds one item's text. Empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import BROADCAST_ROWS, Scratch, lower_ascii, own_name, with_ids

_SPACE = " \t\n\x0b\f\r"
_LEAST_LONG = -(1 << 63)


def words(text: Column) -> Column:
    bare = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    return F.split(bare, r"[ \t\n\x0B\f\r]+")


def shingles(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, s array<bigint>): hashes of `width` words each, with repeats; null for a shorter text. The explode
    of one array makes no rows; filters that the optimizer infers on s stop there instead of being pushed
    below, where each would split and hash every text again."""
    split = df.select(F.col(key).alias("id"), words(F.col(text)).alias("w"))
    one = lambda i: F.xxhash64(*[F.get("w", i + p) for p in range(width)])
    some = (F.size("w") >= width) & (F.get("w", F.lit(0)) != "")
    return split.select("id", F.explode(F.array(F.when(some, F.transform(F.sequence(F.lit(0), F.size("w") - width), one)))).alias("s"))


def item_sketches(items: DataFrame, threshold: float, width: int = 5) -> DataFrame:
    """item_id, n, width, size_class, s (distinct shingles), sketch (the k least)."""
    w = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where("w[0] <> ''")
    w = w.withColumn("width", F.least(F.size("w"), F.lit(width)))
    one = lambda i: F.xxhash64(*[F.get("w", i + p) for p in range(width)])
    rows = w.select("item_id", "width", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("width")), one)).alias("h"))
    sets = rows.groupBy("item_id").agg(F.max("width").alias("width"), F.sort_array(F.collect_set("h")).alias("s")).withColumn("n", F.size("s"))
    need = F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    sets = sets.withColumns({"need": need, "size_class": F.floor(F.log2("n")).cast("int")})
    return sets.withColumn("sketch", F.slice("s", 1, F.col("n") - F.col("need") + 1))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, item_id, n_item (the item's shingles), n_shared, containment, of every pair at or over threshold."""
    scratch = Scratch(docs.sparkSession, "decon")
    sets = scratch.save(item_sketches(items.select("item_id", "text"), threshold, width), "items")
    bounds = sets.groupBy("width", "size_class").agg(F.max(F.element_at("sketch", -1)).alias("bound"), F.min("need").alias("need")).collect()  # a row a size class
    sketch = _sized(sets.select("item_id", "width", "size_class", "need", F.explode("sketch").alias("h")))
    found = None
    for w in sorted({b["width"] for b in bounds}):
        here = [b for b in bounds if b["width"] == w]
        # the partitions by the size they need; a document's bound is the greatest of those it has
        most = F.greatest(F.lit(_LEAST_LONG), F.lit(_LEAST_LONG), *[F.when(F.col("size") >= b["need"], F.lit(b["bound"])) for b in here])
        rows = shingles(docs, "doc_id", "text", w).select("id", F.size("s").alias("size"), "s").withColumn("most", most)
        rows = rows.select("id", "size", F.explode_outer(F.filter("s", lambda h: h <= F.col("most"))).alias("h"))
        hits = rows.join(sketch.where(F.col("width") == w), "h").where("size >= need").select(F.col("id").alias("doc_id"), "item_id")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id"))]
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, n_item long, n_shared long, containment double")
    pairs = scratch.save(found.groupBy("doc_id", "item_id").agg(F.lit(1).alias("candidate")), "candidates")
    return _verify(scratch, docs, sets, pairs, threshold, sorted({b["width"] for b in bounds}))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verify(scratch: Scratch, docs: DataFrame, sets: DataFrame, pairs: DataFrame, threshold: float, widths: list[int]) -> DataFrame:
    some = pairs.select(F.col("item_id").alias("__item")).distinct()
    wanted = sets.join(some, F.col("item_id").eqNullSafe(F.col("__item")), "left_semi")
    wanted = _sized(scratch.save(wanted.select("item_id", "n", "width", "need", F.explode("s").alias("h")), "wanted"))
    near = with_ids(docs.select("doc_id", "text"), pairs.select("doc_id"), "left_semi")
    shared = None
    for w in widths:
        rows = shingles(near, "doc_id", "text", w).select(F.col("id").alias("doc_id"), F.explode_outer("s").alias("h"))
        hits = rows.join(wanted.where(F.col("width") == w), "h").select("doc_id", "item_id", "n", "need", "h").distinct()
        shared = hits if shared is None else shared.unionByName(hits)
    shared = shared.groupBy("doc_id", "item_id", "n", "need").agg(F.count("*").alias("n_shared")).where("n_shared >= need")
    a, b = shared.alias("a"), pairs.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.item_id").eqNullSafe(F.col("b.item_id"))
    out = a.join(b, same, "left_semi")
    return out.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item. Each text is judged by itself, whatever its row's or item's id."""
    scratch = Scratch(docs.sparkSession, "decon-stage")
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    items = items.select(F.xxhash64("text").alias("item_id"), "text")
    name = own_name()
    bad = scratch.save(contained_items(by_text, items).select(F.col("doc_id").alias(name)).distinct(), "bad")
    return with_ids(docs.withColumn(name, F.xxhash64("text")), bad, "left_anti", name).drop(name)
