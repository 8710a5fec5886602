"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; decision node v has its own context tree over the preceding bytes,
to DEPTH bytes back. A node's Krichevsky-Trofimov estimate and the product of its children mix by the
weighting P_w = (P_e + prod P_w(child)) / 2, so a byte's probability averages over all depths at once;
minus its base-2 logarithm is the code length. The tree is learned from the training documents and then
frozen: every text is scored by the same predictive distribution.

Counts cover all training bytes: (DEPTH + 1)-grams are counted map-side, shuffled and summed. Every context
seen LEAST times is a node; the once-seen ones of a node share one lumped child. The tree grows with the
text and is never in one place: grams are dealt by the last two bytes of their context, and each such
subtree is summed up on its own. The contexts of one byte and none, 257 at most, join the subtrees on the
driver; their estimates go back to the subtrees, which then give each gram of any text, held-out ones too, its
probability. These are sorted files of the shared folder, in which the texts' grams are looked up.

The base score is a unigram model over words. Words with 1/2**17 of the training tokens, 2**17 at most, are
looked up on the map side; the others meet their counts by an ordinary join on 64-bit word hashes.

Nulls: a null text is empty and is one end token; a null id counts as the empty string for the split, so
its row is learned from. Repeated rows are scored and learned as often as they occur. Empty tables give
empty results; without training rows every byte has probability 1/256. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import LOWER_BYTES, Scratch, Words, blocks, utf8
from terradrift.llm.token_store import _local, open_file, write_file

DEPTH = 5
#: Occurrences that make a context a node of its own.
LEAST = 2
HEAD_SHARE = 1 << 17
#: Grams that a task works on at a time (whole subtrees, so more where one is larger), and those of a file.
CHUNK, FILE_GRAMS = 300_000, 200_000
#: Stands before and after each text; no byte of UTF-8.
EDGE = 255
#: The end token among word hashes.
END = 1


def held_out(doc_id, folds: int = 10, fold: int = 0):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _buffer(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts i to j, each after DEPTH edges and before one; which places are predicted; where documents begin."""
    at = offsets[i : j + 1] - offsets[i]
    docs = j - i
    first = at[:-1] + np.arange(docs) * (DEPTH + 1)
    out = np.full(at[-1] + docs * (DEPTH + 1), EDGE, np.uint8)
    target = np.ones(len(out), bool)
    target[(first[:, None] + np.arange(DEPTH)).ravel()] = False
    place = np.arange(at[-1]) + np.repeat(np.arange(docs) * (DEPTH + 1) + DEPTH, np.diff(at))
    out[place] = LOWER_BYTES[data[offsets[i] : offsets[j]]]
    return out, target, first


def _grams(text: np.ndarray) -> np.ndarray:
    """The context before each place from DEPTH on, nearest byte first, and the byte there, packed."""
    key = np.zeros(len(text) - DEPTH, np.int64)
    for p in (*range(DEPTH - 1, -1, -1), DEPTH):
        key = (key << 8) | text[p : len(text) - DEPTH + p]
    return key


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return k[at], np.add.reduceat(n, at) if len(k) else n


def _counted(batches):
    """(kind, key, n) of a partition: kind 0 byte grams, 1 word hashes. Held-out texts add their grams with n 0."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}

    def add(kind: int, keys: np.ndarray, times: int = 1) -> None:
        v = pc.value_counts(pa.array(keys))
        held[kind][0].append(v.field(0).to_numpy(zero_copy_only=False))
        held[kind][1].append(v.field(1).to_numpy(zero_copy_only=False) * times)

    def rows(kind: int):
        k, n = _merged(*held[kind])
        held[kind] = ([], [])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], ["kind", "key", "n"])

    for batch in batches:
        for out in (False, True):
            data, offsets = utf8(batch["text"].filter(pc.equal(batch["held_out"], out)))
            for i, j in blocks(offsets):
                text, target, _ = _buffer(data, offsets, i, j)
                add(0, _grams(text)[target[DEPTH:]], int(not out))
                if not out:
                    add(1, np.append(Words(data, offsets, i, j).hash.view(np.int64), np.full(j - i, END)))
                for kind in (0, 1):
                    if sum(map(len, held[kind][0])) > 2_000_000:
                        k, n = _merged(*held[kind])
                        held[kind] = ([k], [n])
                        if len(k) > 1_000_000:
                            yield rows(kind)
    for kind in (0, 1):
        if held[kind][0]:
            yield rows(kind)


# --- the tree -------------------------------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _lgamma(zero + 0.5) + _lgamma(one + 0.5) - _lgamma(zero + one + 1) - 1.1447298858494002  # log pi


def _mixed(zero, one, below, used_zero, used_one):
    """Share of the own estimate, the lumped child's probability of a one, and log P_w, of inner nodes."""
    lump_zero, lump_one = np.maximum(zero - used_zero, 0), np.maximum(one - used_one, 0)
    own, split = _log_kt(zero, one), below + _log_kt(lump_zero, lump_one)
    both = np.logaddexp(own, split)
    return np.exp(own - both), (lump_one + 0.5) / (lump_zero + lump_one + 1), both - np.log(2)


def _kt(zero, one):
    return (one + 0.5) / (zero + one + 1)


class Subtrees:
    """The contexts of two and more bytes over the sorted grams of whole two-byte endings."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        #: By depth: (context, byte) packed, its count, whether the context is a node, and its place one depth up.
        self.pairs, self.n, self.kept, self.up = {DEPTH: key}, {DEPTH: n.astype(np.float64)}, {}, {}
        for d in range(DEPTH, 1, -1):
            k = self.pairs[d]
            self.pairs[d - 1], self.up[d] = np.unique((k >> 16 << 8) | (k & 255), return_inverse=True)
            self.n[d - 1] = np.bincount(self.up[d], self.n[d], len(self.pairs[d - 1]))
            context, _ = self._runs(k >> 8)
            self.kept[d] = (np.bincount(context, self.n[d]) >= LEAST)[context]

    @staticmethod
    def _runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.append(True, k[1:] != k[:-1])
        return np.cumsum(new) - 1, np.flatnonzero(new)

    def climb(self, level: int) -> dict[int, dict]:
        """By depth, the cells (context, decision node of the level) with their counts and, of inner nodes, _mixed;
        at depth 1 the sums over the nodes of depth 2."""
        cells = {}
        for d in range(1, DEPTH + 1):
            k = self.pairs[d] >> (8 - level)
            cell, first = self._runs(k)
            one = np.bincount(cell, self.n[d] * (self.pairs[d] >> (7 - level) & 1))
            cells[d] = {"key": k[first], "cell": cell, "zero": np.bincount(cell, self.n[d]) - one, "one": one}
            if d > 1:
                cells[d]["kept"], cells[d]["up"] = self.kept[d][first], cells[d - 1]["cell"][self.up[d][first]]
        sums = None
        for d in range(DEPTH, 1, -1):
            c = cells[d]
            if sums is None:
                log_w = _log_kt(c["zero"], c["one"])
            else:
                c["weight"], c["lump"], log_w = _mixed(c["zero"], c["one"], *sums)
            k = c["kept"]
            sums = [np.bincount(c["up"][k], x[k], len(cells[d - 1]["key"])).astype(np.float64) for x in (log_w, c["zero"], c["one"])]  # of nothing, it counts in integers
        cells[1]["sums"] = sums
        return cells

    def score(self, top: tuple) -> np.ndarray:
        """log10 probability of each gram's byte after its context; top: _down()."""
        out = np.zeros(len(self.pairs[DEPTH]))
        for level in range(8):
            cells = self.climb(level)
            k = cells[1]["key"]
            at = (k >> level, (1 << level) - 1 + (k & ((1 << level) - 1)))
            done, left, q = (t[at] for t in top)
            for d in range(2, DEPTH + 1):
                c = cells[d]
                done, left, q = done[c["up"]], left[c["up"]], q[c["up"]]
                weight, lump = (c["weight"], c["lump"]) if d < DEPTH else (1.0, 0.0)
                done = done + left * weight * _kt(c["zero"], c["one"])
                left = left * (1 - weight)
                q = np.where(c["kept"], done + left * lump, q)
            q = np.clip(q, 1e-7, 1 - 1e-7)[cells[DEPTH]["cell"]]
            out += np.log10(np.where(self.pairs[DEPTH] >> (7 - level) & 1, q, 1 - q))
        return out


def _down(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the sums (last, node, zero, one, below, used_zero, used_one) of the one-byte contexts: the mixture so far, what is left
    of it, and the probability of a one where the context goes no deeper, each (256, 255)."""
    at = (rows["last"].to_numpy(np.int64), rows["node"].to_numpy(np.int64))
    table = np.zeros((5, 256, 255))
    for t, name in zip(table, ("zero", "one", "below", "used_zero", "used_one"), strict=True):
        t[at] = rows[name].to_numpy(np.float64)
    zero, one = table[:2]
    weight, lump, log_w = _mixed(*table)
    kept = (zero[:, :1] + one[:, :1]) >= LEAST
    below, used_zero, used_one = ((x * kept).sum(0) for x in (log_w, zero, one))
    root_weight, root_lump, _ = _mixed(zero.sum(0), one.sum(0), below, used_zero, used_one)
    done = root_weight * _kt(zero.sum(0), one.sum(0)) + np.zeros_like(zero)
    left = 1 - root_weight + np.zeros_like(zero)
    short = done + left * root_lump
    done, left = done + left * weight * _kt(zero, one), left * (1 - weight)
    return done, left, np.where(kept, done + left * lump, short)


def _subtrees(batches):
    """Grams of a sorted partition, in runs of whole endings."""
    key, n, size = [], [], 0

    def take():
        out = np.concatenate(key), np.concatenate(n)
        key.clear()
        n.clear()
        return out

    for batch in batches:
        if not len(batch):
            continue
        k, m = batch["key"].to_numpy(zero_copy_only=False), batch["n"].to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1] >> 32 << 32))
        key.append(k[:cut])
        n.append(m[:cut])
        size += cut
        if cut and size >= CHUNK:
            yield take()
            size = 0
        key.append(k[cut:])
        n.append(m[cut:])
        size += len(k) - cut
    if size:
        yield take()


def _summed(batches):
    import pyarrow as pa

    for key, n in _subtrees(batches):
        tree = Subtrees(key, n)
        for level in range(8):
            c = tree.climb(level)[1]
            columns = [c["key"] >> level, (1 << level) - 1 + (c["key"] & ((1 << level) - 1)), c["zero"], c["one"], *c["sums"]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["last", "node", "zero", "one", "below", "used_zero", "used_one"])


class Scores:
    """The files of scored grams; mapped where local, so that workers on a machine share them."""

    def __init__(self, files: list[tuple[int, int, str]]):
        self.files = sorted(files)
        self.first = np.array([f[0] for f in self.files], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _tables(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.open:
            _, n, path = self.files[f]
            if (local := _local(path)) is not None:
                data = np.memmap(local, np.uint8, "r")
            else:
                with open_file(path) as file:
                    data = np.frombuffer(file.read(), np.uint8)
                while len(self.open) >= 16:
                    self.open.pop(next(iter(self.open)))
            self.open[f] = data[: 8 * n].view(np.int64), data[8 * n :].view(np.float32)
        return self.open[f]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Scores of sorted keys, all of which are in the files."""
        out = np.empty(len(keys))
        cut = [0, *np.searchsorted(keys, self.first[1:]).tolist(), len(keys)]
        for f, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if i < j:
                known, score = self._tables(f)
                at = np.searchsorted(known, keys[i:j])
                if at[-1] == len(known) or (known[at] != keys[i:j]).any():
                    raise KeyError("a gram was not counted")
                out[i:j] = score[at]
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> np.ndarray:
        """log10 probability of texts i to j, ends included."""
        import pyarrow as pa

        text, target, first = _buffer(data, offsets, i, j)
        coded = pa.array(_grams(text)[target[DEPTH:]]).dictionary_encode()
        keys = coded.dictionary.to_numpy()
        order = np.argsort(keys)
        score = np.empty(len(keys))
        score[order] = self.of(keys[order])
        value = np.zeros(len(text))
        value[target] = score[coded.indices.to_numpy()]
        return np.add.reduceat(value, first)


def learn(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, list[tuple[int, int, str]]]:
    """Counts table (kind, key, n) of the documents (text, held_out), and the files (first gram, number, path) of the scores
    of all their grams."""
    rows = docs.select("text", "held_out").mapInArrow(_counted, "kind int, key long, n long")
    counts = scratch.save(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    grams = counts.where("kind = 0").select("key", "n")
    parts = max(1, -(-grams.count() // FILE_GRAMS))
    # all grams of an ending are in one partition, and partitions are in order
    grams = grams.repartitionByRange(parts, F.shiftright("key", 32)).sortWithinPartitions("key")
    names = ["zero", "one", "below", "used_zero", "used_one"]
    sums = grams.mapInArrow(_summed, "last long, node long, " + ", ".join(f"{x} double" for x in names))
    top = _down(sums.groupBy("last", "node").agg(*[F.sum(x).alias(x) for x in names]).toPandas())  # 256 * 255 rows at most
    top = scratch.spark.sparkContext.broadcast(top)
    path = scratch.path("scores")

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        done = [(key, Subtrees(key, n).score(top.value).astype(np.float32)) for key, n in _subtrees(batches)]
        if done:
            key, score = (np.concatenate(x) for x in zip(*done, strict=True))
            name = f"{path}/{TaskContext.get().partitionId()}"
            write_file(name, f"a{TaskContext.get().taskAttemptId()}", [key.tobytes(), score.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(key[:1]), pa.array([len(key)]), pa.array([name])], ["first", "n", "path"])

    files = grams.mapInArrow(build, "first long, n long, path string").collect()  # a row a file
    return counts, [tuple(f) for f in files]


def score_documents(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, a row per document."""
    scratch = Scratch(docs.sparkSession, "ctw")
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), folds).alias("held_out"))
    counts, files = learn(scratch, docs)
    words = counts.where("kind = 1")
    n_all, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = words.where(F.col("n") >= max(1, n_all // HEAD_SHARE)).orderBy(F.desc("n"), "key").limit(2 * HEAD_SHARE).select("key", "n").toPandas()
    order = np.argsort(head["key"].to_numpy(np.int64).view(np.uint64))
    keys = head["key"].to_numpy(np.int64).view(np.uint64)[order]
    norm = n_all + 0.1 * (distinct + 1)
    logs = np.log10((head["n"].to_numpy(np.float64)[order] + 0.1) / norm)
    model = docs.sparkSession.sparkContext.broadcast((keys, logs))  # HEAD_SHARE bounds it
    end_log, end_known = (logs[np.searchsorted(keys, END)], 1) if END in keys else (np.log10(0.1 / norm), 0)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        (keys, logs), scores = model.value, Scores(files)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = utf8(batch["text"])
            docs_n = len(offsets) - 1
            n_tokens, known, base, value = (np.zeros(docs_n, t) for t in (np.int64, np.int64, np.float64, np.float64))
            tails, cuts = [], [np.zeros(1, np.int32)]
            for i, j in blocks(offsets):
                value[i:j] = scores.texts(data, offsets, i, j)
                words = Words(data, offsets, i, j)
                doc = np.repeat(np.arange(j - i), np.diff(words.first))
                at = np.searchsorted(keys, words.hash)
                at[at == len(keys)] = 0
                hit = keys[at] == words.hash if len(keys) else np.zeros(len(doc), bool)
                n_tokens[i:j] = np.diff(words.first) + 1
                known[i:j] = np.bincount(doc[hit], minlength=j - i) + end_known
                base[i:j] = np.bincount(doc[hit], weights=logs[at[hit]] if len(keys) else None, minlength=j - i) + end_log
                tails.append(words.hash[~hit].view(np.int64))
                cuts.append(cuts[-1][-1] + np.cumsum(np.bincount(doc[~hit], minlength=j - i)).astype(np.int32))
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate(cuts), pa.int32()), pa.array(np.concatenate(tails) if tails else np.empty(0, np.int64)))
            size = pa.array((offsets[1:] - offsets[:-1]).astype(np.int64))
            columns = [pa.array(uid + np.arange(docs_n)), batch["doc_id"], batch["held_out"], pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(value), size, tail]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "tail"])
            uid += docs_n

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, tail array<long>")
    scored = scratch.save(scored, "scored")
    tail = scored.select("uid", F.explode("tail").alias("key")).join(words.select("key", "n"), "key", "left")
    each = F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.1)) / F.lit(float(norm)))
    tail = tail.groupBy("uid").agg(F.count("n").alias("tail_known"), F.sum(each).alias("tail_base"))
    out = scored.drop("tail").join(tail, "uid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
