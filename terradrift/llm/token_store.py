"""Token-id files with a minimal perfect hash index.

Shards. Documents are range-partitioned and sorted by doc_id; each partition encodes its texts and writes
one shard: a header, the raw ids (uint16 where the vocabulary allows, else uint32; little-endian), then a
footer with the documents' keys and lengths. A shard is written under a name of its attempt and renamed,
so a task that runs twice leaves one file. The manifest (one row a shard) gives each shard its first
global position, a running sum over blocks of shards.

Index. Keys are dealt into buckets by hash; each bucket gets a minimal perfect hash: level after level,
keys that alone claim a bit keep it, the rest go on to the next level, and a key's slot is the rank of its
bit. A slot holds a fingerprint of 32 bits, the shard, the offset, the length, and for an id of several rows their number
and the last shard that has some. A lookup takes one bit
probe a level (under two on average), one rank and one fingerprint check, whatever the number of keys; an
absent key passes the check with probability 2**-32.

Paths with a file: scheme, or none, are read and written by the operating system, others by pyarrow's
file systems. Nulls: a null text is empty and has only the end id; a null doc_id sorts first and is found
under NULL_KEY, which is therefore refused as an id. Rows that repeat a doc_id follow each other, over as many shards
as they need, so that no id makes a shard larger; the index finds the first, and each shard's
part of them is read on its own. Empty table: no shard, empty result. Ids of other types than integers are refused.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terradrift.llm.common import Scratch, blocks, hash_ranges, mix, utf8
from terradrift.ship import ship

MAGIC = b"TDIDS001"
END_ID = 2
#: Key of a null doc_id.
NULL_KEY = -(1 << 63)
#: Text bytes of a shard, about; keys of an index bucket, about.
SHARD_BYTES, BUCKET_KEYS = 32 << 20, 200_000
#: Units whose ids an encoder remembers; beyond it the store starts afresh.
WORD_CACHE = 800_000

_U = np.uint64


# --- files ----------------------------------------------------------------------------------------


def _fs(path: str):
    """pyarrow file system and path for anything that isn't local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def write_file(path: str, attempt: str, parts) -> None:
    """All or nothing: a file of this attempt, then a rename."""
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(f"{local}.{attempt}", "wb") as out:
            for part in parts:
                out.write(part)
        os.replace(f"{local}.{attempt}", local)
        return
    store, at = _fs(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(f"{at}.{attempt}") as out:
        for part in parts:
            out.write(part)
    store.move(f"{at}.{attempt}", at)


def open_file(path: str):
    if (local := _local(path)) is not None:
        return open(local, "rb")
    store, at = _fs(path)
    return store.open_input_file(at)


# --- encoding -------------------------------------------------------------------------------------


_WORD_END = np.zeros(256, bool)
_WORD_END[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_OTHER_SPACE = np.zeros(256, bool)
_OTHER_SPACE[[9, 11, 12, 13, *range(0x1C, 0x20)]] = True


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Places of white space other than the space and the line break, in UTF-8."""
    one, two = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    one[:-1], two[:-2] = data[1:], data[2:]
    odd = _OTHER_SPACE[data]
    odd |= (data == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (data == 0xE1) & (one == 0x9A) | (data == 0xE3) & (one == 0x80) & (two == 0x80)
    return odd | (data == 0xE2) & ((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)) | (one == 0x81) & (two == 0x9F))


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level pre-tokens never cross a single space or line break between two characters that are no white
    space, nor the border between a letter or digit and one mark of punctuation before such a space. So a text is
    cut there into units (a word with its leading space, a mark, a line break). The distinct units of a block
    are found by hash; the library encodes those not yet known, many in a call with line breaks between, and
    the ids of all places are gathered. Texts with other white space, or more than one together, are encoded
    whole. Two units share a 64-bit hash with probability 2**-64."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Added tokens are found anywhere in a text, so texts that hold one are encoded whole.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self._forget()
        line = self.tokenizer.encode("a\nb\n c", add_special_tokens=False).ids
        self.line = line[1] if len(line) == 5 and line[1] == line[3] else None

    def _forget(self) -> None:
        """Known units: sorted hashes, and where in the pool their ids begin and how many there are."""
        self.keys, self.begin, self.width = np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, self.dtype)

    def _plain(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(g.ids, self.dtype).tobytes() for g in got]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        import pyarrow as pa

        return self.encode_utf8(*utf8(pa.array(texts, pa.large_string())))

    def encode_utf8(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Packed ids of each text, with the end id."""
        out: list[bytes] = []
        for i, j in blocks(offsets, 3 << 20):
            out += self._block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        return out

    def _block(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        n, docs = len(data), len(at) - 1
        gap = (data == 32) | (data == 10)
        alone = np.zeros(n + 1, bool)  # edges of documents
        alone[at] = True
        before, after = np.ones(n, bool), np.ones(n, bool)  # whether white space or an end is there
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before[alone[:n]] = True
        after[alone[1:]] = True
        odd = np.concatenate([[0], np.cumsum(gap & (before | after) | odd_spaces(data))])
        simple = (odd[at[1:]] == odd[at[:-1]]) & (self.line is not None)
        raw = data.tobytes() if self.added else b""
        for token in self.added:
            place = raw.find(token)
            while place >= 0:
                simple[int(np.searchsorted(at, place, "right")) - 1] = False
                place = raw.find(token, place + 1)
        mark = np.zeros(n, bool)
        mark[1:] = _MARK[data[1:]] & _WORD_END[data[:-1]]
        cut = alone[:n] | gap | mark & after
        cut[1:] |= data[:-1] == 10
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        doc = np.repeat(np.arange(docs), np.diff(np.searchsorted(start, at)))
        start, end, doc = (v[simple[doc]] for v in (start, end, doc))
        ids, lengths = self._gathered(data, start, end)
        total = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=lengths, minlength=docs).astype(np.int64))]) * self.dtype.itemsize
        packed, places = ids.tobytes(), total.tolist()
        whole = iter(self._plain([data[at[d] : at[d + 1]].tobytes().decode() for d in np.flatnonzero(~simple)]))
        return [(packed[places[d] : places[d + 1]] if simple[d] else next(whole)) + self.end for d in range(docs)]

    def _gathered(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and the number of each unit's ids."""
        if not len(start):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        hashes = np.empty(len(start), _U)
        for lo in range(0, len(start), 1 << 17):  # stays in the cache
            a, b = start[lo : lo + (1 << 17)], end[lo : lo + (1 << 17)]
            hashes[lo : lo + len(a)] = hash_ranges(data[a[0] : b[-1]], a - a[0], b - a[0])
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        edge = np.append(True, ranked[1:] != ranked[:-1])
        unit, first = ranked[edge], order[edge]
        if len(self.keys) + len(unit) > WORD_CACHE:
            self._forget()
        at = np.searchsorted(self.keys, unit)
        here = np.minimum(at, max(0, len(self.keys) - 1))
        new = self.keys[here] != unit if len(self.keys) else np.ones(len(unit), bool)
        if new.any():
            self._learn(unit[new], data, start[first[new]], end[first[new]])
            at = np.searchsorted(self.keys, unit)
        width, begin = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        rank = np.cumsum(edge) - 1
        width[order], begin[order] = self.width[at][rank], self.begin[at][rank]
        shift = begin - (np.cumsum(width) - width)
        return self.pool[np.repeat(shift, width) + np.arange(int(width.sum()))], width

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Units with a leading space and others go to the library apart, 512 in a text."""
        raw, kind = data.tobytes(), data[start]
        done_keys, done_width, done_ids = [], [], []
        line = kind == 10
        if line.any():
            done_keys.append(keys[line])
            done_width.append(np.ones(1, np.int64))
            done_ids.append(np.array([self.line], self.dtype))
        for some in (np.flatnonzero(kind == 32), np.flatnonzero((kind != 32) & ~line)):
            spans = list(zip(start[some].tolist(), end[some].tolist(), strict=True))
            groups = [slice(i, i + 512) for i in range(0, len(some), 512)]
            for i in range(0, len(groups), 64):
                part = groups[i : i + 64]
                texts = [b"\n".join([raw[a:b] for a, b in spans[g]]).decode() for g in part]
                for g, encoded in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                    ids = np.array(encoded.ids, self.dtype)
                    keep = ids != self.line
                    cuts = np.flatnonzero(~keep)
                    n = len(spans[g])
                    if len(cuts) == n - 1:
                        width = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
                    else:  # a unit holds what reads as a line break
                        each = [np.frombuffer(x, self.dtype) for x in self._plain([raw[a:b].decode() for a, b in spans[g]])]
                        ids, width = np.concatenate(each), np.array([len(x) for x in each])
                        keep = np.ones(len(ids), bool)
                    done_keys.append(keys[some[g]])
                    done_width.append(width)
                    done_ids.append(ids[keep])
        new_width = np.concatenate(done_width)
        new_begin = np.cumsum(new_width) - new_width + len(self.pool)
        self.pool = np.concatenate([self.pool, *done_ids])
        merged = np.concatenate([self.keys, *done_keys])
        order = np.argsort(merged, kind="stable")
        self.keys, self.begin, self.width = merged[order], np.concatenate([self.begin, new_begin])[order], np.concatenate([self.width, new_width])[order]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- shards ---------------------------------------------------------------------------------------


def _header(dtype: np.dtype, tokens: int, keys: np.ndarray, lengths: np.ndarray) -> bytes:
    return MAGIC + np.array([dtype.itemsize, tokens, len(keys), 0], "<i8").tobytes()


HEADER_BYTES = len(MAGIC) + 32


def write_shard(path: str, attempt: str, dtype: np.dtype, keys: np.ndarray, payloads: list[bytes]) -> np.ndarray:
    """Writes one shard; returns each document's length in ids."""
    lengths = np.array([len(p) // dtype.itemsize for p in payloads], "<i8")
    write_file(path, attempt, [_header(dtype, int(lengths.sum()), keys, lengths), *payloads, keys.astype("<i8").tobytes(), lengths.tobytes()])
    return lengths


def read_ids(file, offset: int, n: int) -> np.ndarray:
    """n ids from position offset of an open shard."""
    file.seek(0)
    head = file.read(HEADER_BYTES)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard")
    size = int(np.frombuffer(head[len(MAGIC) :], "<i8")[0])
    file.seek(HEADER_BYTES + offset * size)
    return np.frombuffer(file.read(n * size), f"<u{size}")


# --- minimal perfect hash -------------------------------------------------------------------------


def _level_hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 1, _U)))) % _U(size)


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys by levels of claimed bits."""

    GAMMA = 2.0

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bit arrays
        self.rank = [np.concatenate([[0], np.cumsum(b)]) for b in levels]
        self.base = np.concatenate([[0], np.cumsum([int(b.sum()) for b in levels])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(8, int(len(keys) * cls.GAMMA))
            at = _level_hash(keys, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level claims it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = _level_hash(keys[left], level, len(bits)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.base[level] + self.rank[level][at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        n = int(np.frombuffer(data[:8], "<i8")[0])
        sizes, at, levels = np.frombuffer(data[8 : 8 + 8 * n], "<i8"), 8 + 8 * n, []
        for size in sizes.tolist():
            width = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data[at : at + width], np.uint8))[:size].astype(bool))
            at += width
        return cls(levels), at


def _hashed(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(_U) + _U(0x51ED270B))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(_hashed(keys) ^ _U(0xB0C4E7)) % _U(buckets)).astype(np.int32)


_ENTRY = np.dtype([("print", "<u4"), ("shard", "<i4"), ("last", "<i4"), ("offset", "<i8"), ("n", "<i8"), ("rows", "<i8")])
_FIELDS = ("shard", "last", "offset", "n", "rows")


def write_bucket(path: str, attempt: str, keys: np.ndarray, **fields: np.ndarray) -> None:
    """fields: an array for each of _FIELDS."""
    h = _hashed(keys)
    table = PerfectHash.build(h)
    entry = np.zeros(len(keys), _ENTRY)
    slot = table.slots(h)
    for name, value in {"print": (h >> _U(32)).astype(np.uint32), **fields}.items():
        entry[name][slot] = value
    write_file(path, attempt, [table.to_bytes(), entry.tobytes()])


def read_bucket(path: str):
    """Lookup function of a bucket: keys -> entries and whether each was found."""
    with open_file(path) as f:
        data = f.read()
    table, at = PerfectHash.from_bytes(data)
    entry = np.frombuffer(data[at:], _ENTRY)

    def find(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _hashed(keys)
        slot = table.slots(h)
        got = entry[np.maximum(slot, 0)] if len(entry) else np.zeros(len(keys), _ENTRY)
        return got, (slot >= 0) & (got["print"] == (h >> _U(32)).astype(np.uint32))

    return find


# --- store ----------------------------------------------------------------------------------------


class TokenStore:
    """A written store: shards/, index/ and the manifest table (shard, n_docs, n_tokens, start)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, manifest: DataFrame):
        self.spark, self.root, self.buckets, self.manifest = spark, root, buckets, manifest

    def locate(self, keys: DataFrame) -> DataFrame:
        """key -> key, shard, last, offset, n, rows through the index; keys that the store lacks give no row."""
        root, buckets = self.root, self.buckets

        def look(pdf):
            import pandas as pd

            k = pdf["key"].to_numpy(np.int64)
            try:
                find = read_bucket(f"{root}/index/{int(pdf['bucket'].iloc[0]):06d}")
            except FileNotFoundError:  # no key fell there
                return pd.DataFrame({"key": k[:0]} | {f: k[:0] for f in _FIELDS})
            got, ok = find(k)
            return pd.DataFrame({"key": k} | {f: got[f].astype(np.int64) for f in _FIELDS})[ok]

        return _with_bucket(keys, buckets).groupBy("bucket").applyInPandas(look, "key long, " + ", ".join(f"{f} long" for f in _FIELDS))

    def read(self, keys: DataFrame, digest) -> DataFrame:
        """digest(ids uint32 array) -> long, of every document found; columns key, shard, offset, n, digest."""
        root = self.root

        def fetch(pdf):
            import pandas as pd

            pdf = pdf.sort_values(["first", "offset"])
            out, footer = [], None
            with open_file(f"{root}/shards/{int(pdf['shard'].iloc[0]):06d}.ids") as f:
                for key, shard, offset, n, rows, first in pdf[["key", "shard", "offset", "n", "rows", "first"]].itertuples(index=False):
                    if rows == 1:
                        spans = [(offset, n)]
                    else:  # the rows of the id in this shard, which is sorted by it
                        footer = footer or _footer(f)
                        i, j = np.searchsorted(footer[0], key, "left"), np.searchsorted(footer[0], key, "right")
                        spans = zip(footer[1][i:j].tolist(), footer[2][i:j].tolist(), strict=True)
                    for at, size in spans:
                        ids = read_ids(f, at, size)
                        out.append((key, shard, at, len(ids), digest(ids.astype("<u4"))))
            return pd.DataFrame(out, columns=["key", "shard", "offset", "n", "digest"])

        found = self.locate(keys).select("key", F.explode(F.sequence("shard", "last")).alias("shard"), "offset", "n", "rows", F.col("shard").alias("first"))
        return found.groupBy("shard").applyInPandas(fetch, "key long, shard long, offset long, n long, digest long")


def _footer(file) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, offsets and lengths of an open shard's documents."""
    file.seek(len(MAGIC))
    size, tokens, docs, _ = (int(x) for x in np.frombuffer(file.read(32), "<i8"))
    file.seek(HEADER_BYTES + tokens * size)
    keys, lengths = np.frombuffer(file.read(docs * 16), "<i8").reshape(2, docs)
    return keys, np.cumsum(lengths) - lengths, lengths


def _with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    def add(batches):
        import pyarrow as pa

        for b in batches:
            yield b.append_column("bucket", pa.array(bucket_of(b["key"].to_numpy(zero_copy_only=False), buckets)))

    return keys.mapInArrow(add, keys.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", bucket int")


def write_store(docs: DataFrame, tokenizer: str, root: str | None = None) -> TokenStore:
    """Writes docs (doc_id, text) as shards in ascending doc_id order, with their index, under root; without one in
    a folder of the shared folder that goes with the driver."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "tokens")
    root = (root or scratch.root).rstrip("/")
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("document ids must be integers")
    # rows of one id are told apart by where the scan has them, so that their range can be split
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), "text", F.monotonically_increasing_id().alias("row"))
    reserved = F.count_if(docs["doc_id"].cast("long") == NULL_KEY)
    count, size, reserved = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), reserved).first()
    if reserved:
        raise ValueError(f"{NULL_KEY} stands for null and can't be an id")
    parts, buckets = max(1, -(-size // SHARD_BYTES)), max(1, -(-count // BUCKET_KEYS))

    def shard(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        number, attempt = context.partitionId(), f"a{context.taskAttemptId()}"
        coder, keys, payloads = encoder(tokenizer), [], []
        for batch in batches:
            payloads += coder.encode_utf8(*utf8(batch["text"]))
            keys.append(batch["key"].to_numpy(zero_copy_only=False))
        if not keys:
            return
        keys = np.concatenate(keys)
        lengths = write_shard(f"{root}/shards/{number:06d}.ids", attempt, coder.dtype, keys, payloads)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), number)), pa.array(np.cumsum(lengths) - lengths), pa.array(lengths)], ["key", "shard", "offset", "n"])

    ordered = rows.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").select("key", "text")
    entries = scratch.save(ordered.mapInArrow(shard, "key long, shard long, offset long, n long"), "entries")
    manifest = scratch.save(_running(entries.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))), "manifest")
    at = F.min(F.struct("shard", "offset", "n")).alias("at")
    first = entries.groupBy("key").agg(at, F.max("shard").alias("last"), F.count("*").alias("rows"))
    first = first.select("key", "at.shard", "last", "at.offset", "at.n", "rows")

    def index(pdf):
        import pandas as pd
        from pyspark import TaskContext

        bucket = int(pdf["bucket"].iloc[0])
        write_bucket(f"{root}/index/{bucket:06d}", f"a{TaskContext.get().taskAttemptId()}", pdf["key"].to_numpy(np.int64), **{c: pdf[c].to_numpy() for c in _FIELDS})
        return pd.DataFrame({"bucket": [bucket], "keys": [len(pdf)]})

    built = scratch.save(_with_bucket(first, buckets).groupBy("bucket").applyInPandas(index, "bucket int, keys long"), "built")
    if (built.agg(F.sum("keys")).first()[0] or 0) > count:
        raise RuntimeError("the index has more keys than rows")
    return TokenStore(spark, root, buckets, manifest)


def _running(shards: DataFrame, block: int = 4096) -> DataFrame:
    """shards with start, the tokens of all shards before it: summed within blocks of shards and over the blocks."""
    shards = shards.withColumn("block", F.floor(F.col("shard") / block))
    within, before = Window.partitionBy("block").orderBy("shard"), Window.orderBy("block")
    blocks_ = shards.groupBy("block").agg(F.sum("n_tokens").alias("all"))
    blocks_ = blocks_.select("block", (F.sum("all").over(before) - F.col("all")).alias("ahead"))  # a row for block shards
    out = shards.join(blocks_, "block").withColumn("start", F.col("ahead") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
    return out.select("shard", "n_docs", "n_tokens", "start")


def stored_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the store, then looks every key of docs up through the index and reads its ids from the shards:
    doc_id, start, n_tokens, ids_crc32."""
    store = write_store(docs, tokenizer)
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    found = store.read(keys, lambda ids: zlib.crc32(ids.tobytes()))
    out = found.join(store.manifest.select("shard", F.col("start").alias("first")), "shard")
    key = F.when(F.col("key") != NULL_KEY, F.col("key"))
    return out.select(key.alias("doc_id"), (F.col("first") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), F.col("digest").alias("ids_crc32"))
