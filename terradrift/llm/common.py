"""Shared pieces of the training-data operators: scratch tables in the shared folder, size-checked
filters, connected components over edge tables, and a vectorised word kernel over Arrow strings."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradrift.ship import ship
from terradrift.tables import delete, delete_at_exit, shared_folder

#: Most rows of an id list that may be broadcast; beyond it a shuffled join is planned.
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII rows take Spark's fast lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


class Scratch:
    """Tables of one operator call, written to the shared folder so that no lineage and no executor's
    disk is needed to read them again."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        delete_at_exit(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def hashed_share(share: Column, *columns: str) -> Column:
    """Whether the columns' hash is among the lowest share of all hashes. It leaves about share of the rows, the same
    ones every time, so that a bounded sample is then taken from few rows instead of all."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < share * F.lit(float(1 << 40))


def own_name() -> str:
    """A column name that no table has."""
    return f"__{uuid.uuid4().hex}"


def with_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """left_semi or left_anti of docs by a one-column table of ids, null-safe. The ids are counted
    first: a list within BROADCAST_ROWS is broadcast, a longer one joins by shuffle."""
    name = own_name()
    ids = ids.select(F.col(key).alias(name)).distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key].eqNullSafe(F.col(name)), how)


def with_rows(docs: DataFrame, rows: DataFrame, how: str, mark: Column) -> DataFrame:
    """with_ids for rows: by doc_id and a mark of the text, so rows that share an id, null or not, are told apart.
    rows: doc_id, mark."""
    name, other = own_name(), own_name()
    rows = rows.select(F.col("doc_id").alias(name), F.col("mark").alias(other)).distinct()
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return docs.join(rows, docs["doc_id"].eqNullSafe(F.col(name)) & (mark == F.col(other)), how)


def _least_of_all(batches):
    import pandas as pd

    from terradrift.operators.dbscan import least_in

    parts = [(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)) for pdf in batches]
    if parts:
        node, root = least_in(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pd.DataFrame({"node": node, "root": root})


def connected_components(scratch: Scratch, edges: DataFrame, label: str = "cc", local: int = 0) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the least node of its component. With local, a graph of so
    many edges at most is done in one task, in Python.

    Alternating large-star and small-star steps; each is an aggregate and an equi-join, so a hub's
    links are spread by the skew join and pre-aggregated before the shuffle. Each round is written to
    the shared folder; the count and a checksum of the edges tell when nothing changes any more."""
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    before, step = None, 0
    if local and now.count() <= local:
        return scratch.save(now.coalesce(1).mapInPandas(_least_of_all, "node long, root long"), f"{label}-roots")
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before, step = mark, step + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(low, large["a"] == low["k"])
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = scratch.save(small.where("a <> b").distinct(), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- words of Arrow strings, vectorised -----------------------------------------------------------

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = []

LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: Everything but space and \x09-\x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Letters, digits and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Bytes of text that the kernel takes at a time.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _STEP), np.full(size, _BACK)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, most: int = BLOCK):
    """Ranges of documents with about `most` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j
        i = j


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    return hash_values(_TABLE[data], start, end)


def hash_values(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of random values that stand for symbols."""
    n = len(values)
    up, down = _pow(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """Words of documents i to j: hash (of the lower-cased bytes) and the range of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, inside: np.ndarray = NOT_SPACE):
        lo, hi = int(offsets[i]), int(offsets[j])
        raw = LOWER_BYTES[data[lo:hi]]
        self.bytes = raw
        self.at = offsets[i : j + 1] - lo
        n = hi - lo
        word = inside[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.at] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[edge[:n]] = False
        after[edge[1:]] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.hash = hash_ranges(raw, self.start, self.end)
        self.first = np.searchsorted(self.start, self.at)  # word range of document d: first[d] to first[d + 1]

    def shingles(self, d: int, k: int = 5) -> np.ndarray:
        """Sorted distinct hashes of k words of document d; of the whole sequence if it has fewer."""
        a, b = self.first[d], self.first[d + 1]
        n = b - a
        if n == 0:
            return np.empty(0, np.uint64)
        if n >= k:
            return np.unique(self._windows(k)[a : b - k + 1])
        return mix((self.hash[a:b] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n))

    def _windows(self, k: int) -> np.ndarray:
        if getattr(self, "_k", None) != k:
            h, w = self.hash, max(0, len(self.hash) - k + 1)
            out = np.full(w, k, dtype=np.uint64)
            for p in range(k):
                out += h[p : p + w] * _PLACE[p]
            self._k, self._w = k, mix(out)
        return self._w


def hash_word(word: bytes) -> int:
    """The hash that Words gives one word, as a signed long."""
    data = np.frombuffer(word, np.uint8)
    return int(Words(data, np.array([0, len(data)]), 0, 1, np.ones(256, bool)).hash[:1].view(np.int64)[0])
