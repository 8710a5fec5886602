"""SentencePiece encoding as a relational lattice, and decoding.

Texts are cut into units wherever no piece of the table spans the two characters that meet there, which no
segmentation can cross, so units are encoded on their own. Distinct units become rows; their substrings of
bounded length are exploded and equi-joined to the piece table (broadcast: the vocabulary bounds it),
the edges are grouped by unit, and a higher-order aggregate folds them into pieces:

* unigram tables: Viterbi over edges by end position, keeping the best score and its back pointer;
* BPE tables: edges in order of merge rank; an edge whose two parts are symbols by then merges them.
  Viterbi over a BPE table's scores gives other pieces than the table's own algorithm for 7 to 40 % of
  words, so the ids would be wrong; this fold gives the sentencepiece library's ids.

Each task of the scan lists its distinct units with its own number, the unit's pieces come back under that
number as one dictionary file per task in the shared folder, and the second scan encodes with it. So no
text is shuffled, and no dictionary is larger than what one task reads. Rows that come out of a shuffle are
written first, since two runs of it may deal them differently; a unit that a task's dictionary still lacks is folded there.

Units over WINDOW characters (a blob, or text in which all pairs join) go to the lattice as windows that overlap by
half, so no fold is longer than a window, and are put together at a piece that two neighbours both have. That is
exact for BPE: pieces are a text's encoding if and only if each two neighbours are the encoding of their joined
text, and every two neighbours of the result are neighbours in a window. Where two windows share no piece, and for
unigram tables, whose best path is no local matter, the worker folds the whole unit, in n log n steps.

Characters without a piece become their UTF-8 bytes' pieces. Nulls: a null text is empty and has no ids.
Repeated rows are encoded alike. Empty table: empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradrift.llm.common import Scratch, blocks, hash_values, mix, utf8
from terradrift.llm.token_store import open_file, write_file
from terradrift.ship import ship

SPACE = "▁"
#: Between the pieces of a unit; a character of no piece is a unit by itself, so it's in none.
CUT = "\x1f"
#: Bytes of text that a task works on at a time.
CHUNK = 1 << 19
#: Characters of a unit that the lattice takes at once.
WINDOW = 64


@dataclass
class PieceTable:
    pieces: dict[str, tuple[int, float]]  # piece -> id, score
    bytes_: list[int]  # id of each byte's piece; -1 where the table has none
    unknown: int
    kind: str  # bpe or unigram
    bytes_of: list[bytes]  # what each id decodes to

    @classmethod
    def load(cls, path: str, kind: str) -> PieceTable:
        """kind: the algorithm that the model was trained for, bpe or unigram."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, text = {}, [-1] * 256, []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                text.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                text.append(b"")
            else:
                pieces[piece] = (i, sp.get_score(i))
                text.append(piece.replace(SPACE, " ").encode())
        return cls(pieces, byte_ids, sp.unk_id(), kind, text)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, float(s)) for p, (_, s) in self.pieces.items()], "piece string, score double")

    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    def fold(self, unit: str) -> list[str]:
        """The pieces of a unit without the lattice."""
        return _merged(unit, self.pieces) if self.kind == "bpe" else _best(unit, self.pieces, self.longest())

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.pieces:
                out.append(self.pieces[p][0])
            else:
                out += [self.bytes_[b] if self.bytes_[b] >= 0 else self.unknown for b in p.encode("utf-8", "replace")]
        return out


def _merged(unit: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    """Merges by score, of equal ones the first, with linked symbols and a heap."""
    n = len(unit)
    after, before, width = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := pieces.get(unit[i : j + width[j]])):
            heapq.heappush(heap, (-found[1], i, j + width[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not width[i] or j >= n or j + width[j] != stop or i + width[i] != j:
            continue  # one of the two has been merged since
        width[i], width[j] = stop - i, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [unit[i : i + width[i]] for i in range(n) if width[i]]


def _best(unit: str, pieces: dict[str, tuple[int, float]], longest: int, unknown: float = -1e4) -> list[str]:
    """Viterbi as fold_viterbi does it."""
    best, back = [0.0] + [-1e300] * len(unit), [0] * (len(unit) + 1)
    for stop in range(1, len(unit) + 1):
        for start in range(max(0, stop - longest), stop):
            scores = [pieces[unit[start:stop]][1]] if unit[start:stop] in pieces else []
            for score in sorted([*scores, *([unknown] if start == stop - 1 else [])]):
                if best[start] + score >= best[stop]:
                    best[stop], back[stop] = best[start] + score, start
    out, at = [], len(unit)
    while at:
        out.append(unit[back[at] : at])
        at = back[at]
    return out[::-1]


def stitched(n: int, windows: list[list[str]]) -> list[str] | None:
    """The pieces of a unit of n characters from those of its windows; None where two windows have no piece in common."""
    out: list[tuple[int, int, str]] = []
    for k, pieces in enumerate(windows):
        at, here = k * (WINDOW // 2), []
        for piece in pieces:
            here.append((at, at + len(piece), piece))
            at += len(piece)
        if k:
            spans = {(a, b): i for i, (a, b, _) in enumerate(here)}
            keep = len(out) - 1
            while keep >= 0 and out[keep][0] >= k * (WINDOW // 2) and out[keep][:2] not in spans:
                keep -= 1
            if keep < 0 or out[keep][:2] not in spans:
                return None
            out, here = out[: keep + 1], here[spans[out[keep][:2]] + 1 :]
        out += here
    return [p for _, _, p in out]


class Cutter:
    """Cuts texts into units, which it knows by 64-bit hashes of their characters."""

    def __init__(self, table: PieceTable):
        pairs = {p[i : i + 2] for p in table.pieces for i in range(len(p) - 1)}
        chars = sorted({c for p in pairs for c in p})
        if chars and ord(chars[-1]) >= 0x10000:
            raise ValueError("pieces of several characters beyond the basic plane aren't supported")
        self.index = np.zeros(0x10000, np.int32)
        self.index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            self.joined[self.index[ord(a)], self.index[ord(b)]] = True
        self.value = mix(np.arange(0x10000, dtype=np.uint64) + np.uint64(1))

    def hashes(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        plain = self.value[np.minimum(code, 0xFFFF)]
        wide = code > 0xFFFF
        if wide.any():
            plain[wide] = mix(code[wide].astype(np.uint64) + np.uint64(1))
        return hash_values(plain, start, end)

    def cut(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All texts marked and joined, the places of their units (one more than there are units), their hashes,
        and the first unit of each text (one more than there are texts)."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(m) for m in marked], dtype=np.int64)])
        if not len(code):
            return whole, np.zeros(1, np.int64), np.empty(0, np.uint64), np.zeros(len(begin), np.int64)
        at = np.where(code < 0x10000, self.index[np.minimum(code, 0xFFFF)], 0)
        edge = np.ones(len(code) + 1, bool)
        edge[1:-1] = ~self.joined[at[:-1], at[1:]]
        edge[begin] = True
        places = np.flatnonzero(edge)
        return whole, places, self.hashes(code, places[:-1], places[1:]), np.searchsorted(places, begin)

    def windows(self, n: int) -> list[tuple[int, int]]:
        """Ranges of the windows of a long unit of n characters."""
        half = WINDOW // 2
        return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - half), half)]


class Known:
    """Ids of units by hash: sorted hashes, and where in the pool a unit's ids begin and how many there are."""

    def __init__(self, hashes: np.ndarray, ids: list[list[int]], kind: np.dtype):
        order = np.argsort(hashes, kind="stable")
        width = np.array([len(x) for x in ids], np.int64)
        self.pool = np.fromiter((i for x in ids for i in x), kind, int(width.sum()))
        self.hashes, self.width, self.begin = hashes[order], width[order], (np.cumsum(width) - width)[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def join(self, other: Known) -> None:
        h = np.concatenate([self.hashes, other.hashes])
        order = np.argsort(h, kind="stable")
        self.hashes, self.width = h[order], np.concatenate([self.width, other.width])[order]
        self.begin = np.concatenate([self.begin, other.begin + len(self.pool)])[order]
        self.pool = np.concatenate([self.pool, other.pool])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at `at` in order, and the number of each unit's ids."""
        width = self.width[at]
        shift = self.begin[at] - (np.cumsum(width) - width)
        return self.pool[np.repeat(shift, width) + np.arange(int(width.sum()))], width


class Seen:
    """A growing set of hashes: a large sorted array and a small one, which joins it when it has grown."""

    def __init__(self):
        self.parts = [np.empty(0, np.uint64), np.empty(0, np.uint64)]

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the sorted distinct hashes are new."""
        new = np.ones(len(hashes), bool)
        for part in self.parts:
            if len(part):
                new &= part[np.minimum(np.searchsorted(part, hashes), len(part) - 1)] != hashes
        large, small = self.parts[0], np.union1d(self.parts[1], hashes[new])
        self.parts = [np.union1d(large, small), small[:0]] if 4 * len(small) > len(large) else [large, small]
        return new


# --- the lattice ----------------------------------------------------------------------------------


def edges(units: DataFrame, table: PieceTable) -> DataFrame:
    """unit, start, stop, score of each substring that is a piece. units: a column unit."""
    n = F.length("unit")
    least = 2 if table.kind == "bpe" else 1
    one = lambda i: F.transform(F.sequence(F.lit(least), F.least(F.lit(table.longest()), n - i)), lambda k: F.struct(i.alias("start"), (i + k).alias("stop"), F.substr(F.col("unit"), i + 1, k).alias("piece")))
    every = F.flatten(F.transform(F.sequence(F.lit(0), n - F.lit(least)), one))
    rows = units.where(n >= least).select("unit", F.explode(every).alias("e")).select("unit", "e.start", "e.stop", "e.piece")
    return rows.join(F.broadcast(table.rows(units.sparkSession)), "piece").select("unit", "start", "stop", "score")


def _set(array: Column, at: Column, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == at, value).otherwise(x))


def fold_merges(n: Column, found: Column) -> Column:
    """Ends of the symbols by start (0 where none starts), from edges (rank, start, stop) in that order."""
    begin = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i + 1)

    def step(stops, e):
        mid = F.get(stops, e["start"])
        merges = (mid > 0) & (mid < e["stop"]) & (F.get(stops, mid) == e["stop"])
        return F.when(merges, F.transform(stops, lambda x, i: F.when(i == e["start"], e["stop"]).when(i == mid, F.lit(0)).otherwise(x))).otherwise(stops)

    return F.aggregate(found, begin, step)


def fold_viterbi(n: Column, found: Column, unknown: float = -1e4) -> Column:
    """Ends by start as above for the segmentation of greatest total score, from edges (stop, start, score) in
    that order; of equal totals the one with the later start wins. A character without an edge costs unknown."""
    zero = F.struct(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.lit(-1e300))).alias("best"), F.transform(F.sequence(F.lit(0), n), lambda i: F.lit(0)).alias("back"))
    alone = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("stop"), (i - 1).alias("start"), F.lit(unknown).alias("score")))
    every = F.array_sort(F.concat(found, alone))

    def step(acc, e):
        total = F.get(acc["best"], e["start"]) + e["score"]
        better = total >= F.get(acc["best"], e["stop"])
        return F.when(better, F.struct(_set(acc["best"], e["stop"], total).alias("best"), _set(acc["back"], e["stop"], e["start"]).alias("back"))).otherwise(acc)

    back = F.aggregate(every, zero, step)["back"]
    none = F.struct(n.alias("at"), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(0)).alias("stops"))

    def walk(acc, _):
        start = F.get(back, acc["at"])
        return F.when(acc["at"] > 0, F.struct(start.alias("at"), _set(acc["stops"], start, acc["at"]).alias("stops"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), n), none, walk)["stops"]


def segment(units: DataFrame, table: PieceTable) -> DataFrame:
    """unit, cut: its pieces with CUT between. units: distinct units, dealt by unit, so the edges of a unit are
    grouped where they arise."""
    found = edges(units, table)
    n = F.length("unit")
    if table.kind == "bpe":
        grouped = found.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), "start", "stop"))).alias("found"))
        stops = fold_merges(n, F.col("found"))
    else:
        grouped = found.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("stop", "start", "score"))).alias("found"))
        stops = fold_viterbi(n, F.col("found"))
    # the explode of one array keeps the optimizer from folding twice
    folded = grouped.select("unit", F.explode(F.array(stops)).alias("stops"))
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("stops", i) > 0)
    return folded.select("unit", F.array_join(F.transform(starts, lambda i: F.substr(F.col("unit"), i + 1, F.get("stops", i) - i)), CUT).alias("cut"))


# --- documents ------------------------------------------------------------------------------------


def _chunks(batch):
    """Texts of a batch in turn, about CHUNK bytes at a time, with their range of rows."""
    _, offsets = utf8(batch["text"])
    for i, j in blocks(offsets, CHUNK):
        yield i, j, batch["text"].slice(i, j - i).to_pylist()


def encode(docs: DataFrame, table: PieceTable, digests: bool = False) -> DataFrame:
    """doc_id and ids array<int> of every row; with digests, what digest() gives of them, made by the same
    workers."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pieces")
    root = scratch.root
    shared = spark.sparkContext.broadcast(table)  # a row a piece

    def list_units(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, cutter, seen = TaskContext.get().partitionId(), Cutter(shared.value), Seen()
        bpe = shared.value.kind == "bpe"
        for batch in batches:
            for _, _, texts in _chunks(batch):
                whole, places, hashes, _ = cutter.cut(texts)
                order = np.argsort(hashes)
                ranked = hashes[order]
                edge = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
                unit, first = ranked[edge], order[edge]
                several = places[first + 1] - places[first] > 1
                unit, first = unit[several], first[several]
                new = first[seen.add(unit)]
                found = [whole[a:b] for a, b in zip(places[new].tolist(), places[new + 1].tolist(), strict=True)]
                if bpe and (longer := [u for u in found if len(u) > WINDOW]):
                    parts = {u[a:b] for u in longer for a, b in cutter.windows(len(u))}
                    found = [u for u in found if len(u) <= WINDOW] + sorted(parts)
                names = pa.array([u for u in found if len(u) <= WINDOW], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), part, np.int32)), names], ["part", "unit"])

    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = scratch.save(docs.select("doc_id", "text"), "texts")
    texts = docs.select("text")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    # written, so that the texts are cut once; units are dealt once for the lattice, which keeps that partitioning
    # up to its groups, and once for the join
    uses = scratch.save(texts.mapInArrow(list_units, "part int, unit string"), "uses").repartition(tasks, "unit")
    distinct = uses.select("unit").distinct()
    # a unit may come twice from a task, as itself and as a window
    rows = uses.join(segment(distinct, table), "unit", "left").select("part", F.coalesce("cut", F.regexp_replace("unit", "(?<=.)(?=.)", CUT)).alias("cut"))

    def write(key, pdf):
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(pdf["cut"], pa.string())], ["cut"])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        write_file(f"{root}/words/{int(key[0]):06d}", f"a{TaskContext.get().taskAttemptId()}", [memoryview(sink.getvalue())])
        return pd.DataFrame({"part": [int(key[0])], "n": [len(pdf)]})

    scratch.save(rows.groupBy("part").applyInPandas(write, "part int, n long"), "written")

    def read_words(path: str, cutter: Cutter, t: PieceTable, kind: np.dtype, windows: dict[str, str]) -> Known:
        import pyarrow as pa

        known = Known(np.empty(0, np.uint64), [], kind)
        try:
            with open_file(path) as f, pa.ipc.open_stream(f) as stream:
                for batch in stream:
                    for lo in range(0, len(batch), 50_000):
                        cuts = list(set(batch["cut"][lo : lo + 50_000].to_pylist()))
                        names = [c.replace(CUT, "") for c in cuts]
                        if t.kind == "bpe":
                            windows.update((n, c) for n, c in zip(names, cuts, strict=True) if len(n) > WINDOW // 2)
                        ends = np.cumsum([len(n) for n in names])
                        code = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
                        known.join(Known(cutter.hashes(code, np.append(0, ends[:-1]), ends), [t.ids(c.split(CUT)) for c in cuts], kind))
        except FileNotFoundError:  # this task's texts have no unit of two characters
            pass
        return known

    def encode_rows(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        t = shared.value
        cutter, kind = Cutter(t), np.dtype("<u2" if len(t.bytes_of) <= 1 << 16 else "<u4")
        windows: dict[str, str] = {}  # the cuts of units that may be windows
        known = read_words(f"{root}/words/{TaskContext.get().partitionId():06d}", cutter, t, kind, windows)

        def pieces(unit: str) -> list[str]:
            if t.kind == "bpe" and len(unit) > WINDOW:
                cuts = [windows.get(unit[a:b]) for a, b in cutter.windows(len(unit))]
                if None not in cuts and (done := stitched(len(unit), [c.split(CUT) for c in cuts])):
                    return done
            return [unit] if len(unit) == 1 else t.fold(unit)

        for batch in batches:
            for i, j, texts in _chunks(batch):
                whole, places, hashes, first = cutter.cut(texts)
                at, ok = known.find(hashes)
                if not ok.all():  # units of one character and long ones aren't in the files
                    miss, where = np.unique(hashes[~ok], return_index=True)
                    where = np.flatnonzero(~ok)[where]
                    spans = zip(places[where].tolist(), places[where + 1].tolist(), strict=True)
                    known.join(Known(miss, [t.ids(pieces(whole[a:b])) for a, b in spans], kind))
                    at, _ = known.find(hashes)
                ids, width = known.gather(at)
                cuts = np.concatenate([[0], np.cumsum(width)])[first]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), lists], ["doc_id", "ids"])

    kind, rows = docs.schema["doc_id"].dataType.simpleString(), docs.select("doc_id", "text")
    if digests:
        return rows.mapInArrow(lambda batches: _digests(encode_rows(batches), shared.value), f"doc_id {kind}, {_DIGESTS}")
    return rows.mapInArrow(encode_rows, f"doc_id {kind}, ids array<int>")


class Decoder:
    """Texts of ids, whole batches at a time."""

    def __init__(self, table: PieceTable):
        self.width = np.array([len(b) for b in table.bytes_of], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.pool = np.frombuffer(b"".join(table.bytes_of), np.uint8)

    def texts(self, column):
        """UTF-8 bytes of each list of ids, and its ids as little-endian unsigned 32-bit integers. Bytes that are no UTF-8
        become the replacement character, as in the library."""
        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False)
        for i, j in blocks(offsets, 1 << 18):
            ids = values[offsets[i] : offsets[j]]
            width = self.width[ids]
            shift = self.begin[ids] - (np.cumsum(width) - width)
            data = self.pool[np.repeat(shift, width) + np.arange(int(width.sum()))].tobytes()
            packed = ids.astype("<u4").tobytes()
            at = np.concatenate([[0], np.cumsum(width)])[offsets[i : j + 1] - offsets[i]].tolist()
            place = (4 * (offsets[i : j + 1] - offsets[i])).tolist()
            for k in range(j - i):
                text = data[at[k] : at[k + 1]]
                text = text[1:] if text[:1] == b" " else text
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = text.decode("utf-8", "replace").encode()
                yield text, packed[place[k] : place[k + 1]]


def decode(encoded: DataFrame, table: PieceTable) -> DataFrame:
    """doc_id and text of rows with ids; null ids are the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        import pyarrow as pa

        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [t.decode() for t, _ in decoder.texts(batch["ids"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


_DIGESTS = "n_pieces long, ids_crc32 long, decoded_sha256 string"


def _digests(batches, table: PieceTable):
    import hashlib
    import zlib

    import pyarrow as pa

    decoder = Decoder(table)
    for batch in batches:
        rows = [(len(ids) // 4, zlib.crc32(ids), hashlib.sha256(text).hexdigest()) for text, ids in decoder.texts(batch["ids"])]
        n, crc, sha = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])


def digest(encoded: DataFrame, table: PieceTable) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and decoded_sha256 of rows with ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _digests(batches, shared.value), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, {_DIGESTS}")
