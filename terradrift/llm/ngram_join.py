"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents link when 100 * |A and B| >= 80 * |A or B| over their sets of distinct 5-word shingles (64-bit
hashes; two different shingles share one with probability 2**-64). The result is exact up to that.

1. Profile: size and class of every document; equal sets have one class, so exact copies of any number
   are one row of the matrix.
2. Order: shingles by how often they occur in a fixed eighth of the classes, in steps of two, the rarest first. Any order is
   right, this one keeps common passages out of the prefixes; the sample decides nothing else.
3. Blocks: a set of n shingles that links to another shares ceil(0.8 n) with it at least, so l of them
   lie in both prefixes of length n - ceil(0.8 n) + l. The incidence of the prefixes, a class once a task, is dealt into
   blocks of columns; each block multiplies with itself, giving pairs and overlap counts, which are summed over
   the blocks; pairs below their bound l, or whose sizes cannot link, are discarded. A column of more than DENSE classes
   emits, instead of pairs, links of each class to the first of its run by size, runs ending where sizes cannot link.
4. Clusters: connected components of what remains. One within TASK_SHINGLES is one dense or sparse product over whole sets
   in one task, which links exactly. The members of larger ones go through steps 2 and 3 again, each cluster with columns of its
   own and an order counted over its own sets, which takes apart what common passages had chained.
   What is still large, groups of near copies as a rule, is cut into chunks: products within
   chunks first, then between a few members of the components so found, round after round while that joins them,
   then exactly between chunks, where two chunks of one component are left out. No pair table of a group is ever written.

A document's component_id is the smallest doc_id reachable by links. Nulls: a null text is empty; empty
sets link with nothing; null ids take part and never are the smallest unless alone. Rows that repeat an id
are documents of their own and get a row each. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import BROADCAST_ROWS, Scratch, Words, blocks, connected_components, mix, utf8, with_rows

#: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
WIDTH = 5
#: A shingle is frequent from so many occurrences in the sampled classes, one in SAMPLE; raised until MOST_FREQUENT hold.
SAMPLE, FREQUENT, MOST_FREQUENT = 8, 3, 2_000_000
#: Classes of a column that are paired; it bounds the pairs that a column emits at every size.
DENSE = 128
#: Prefix entries, and shingles of whole sets, that a task multiplies.
BLOCK_ENTRIES, TASK_SHINGLES = 600_000, 200_000
#: Links of a graph whose components one task finds; larger graphs take alternating rounds over all tasks.
LOCAL_EDGES = 250_000
#: Rounds in which components of large clusters meet, at most, and the share of them that a round must join.
ROUNDS, WORTH = 8, 0.2

_U = np.uint64


def _class_of(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + _U(len(s))])).view(np.int64)[0]) if len(s) else 0


def need(n):
    """Least intersection of a set of n with any set that links to it."""
    return -(-SIMILAR * n // 100)


def extra(n):
    """l: overlaps that must lie in the prefixes."""
    return np.maximum(1, n // 10)


def _sets(batch):
    data, offsets = utf8(batch["text"])
    for i, j in blocks(offsets):
        words = Words(data, offsets, i, j)
        for d in range(j - i):
            yield i + d, words.shingles(d, WIDTH)


def _profile(batches):
    import pyarrow as pa

    for batch in batches:
        n, c = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for d, s in _sets(batch):
            n[d], c[d] = len(s), _class_of(s)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(n), pa.array(c)], ["doc_id", "mark", "n", "class"])


def _dealt(parts: list[tuple[np.ndarray, ...]], buckets: int, names: list[str]):
    """One row a bucket with the packed arrays of its entries; the first array gives the bucket."""
    import pyarrow as pa

    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    to = (columns[0] % _U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    columns = [c[order] for c in columns]
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    packed = [pa.array([c[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *packed], ["bucket", *names])


def _text_rows(batches):
    """(0, class, set) of each text, a class once."""
    seen: set[int] = set()
    for batch in batches:
        for _, s in _sets(batch):
            if len(s) and (c := _class_of(s)) not in seen:
                seen.add(c)
                yield 0, c, s


def _set_rows(batches):
    """(cluster, class, set) of saved sets."""
    for batch in batches:
        for cluster, c, s in zip(batch["cluster"].to_pylist(), batch["class"].to_pylist(), batch["s"].to_pylist(), strict=True):
            yield cluster, c, np.frombuffer(s, _U)


def _salted(s: np.ndarray, cluster: int) -> np.ndarray:
    """Columns of a cluster's own, in order."""
    return np.sort(mix(s ^ mix(np.array([cluster], np.int64).view(_U)))) if cluster else s


def _collect(rows, entries, buckets: int, names: list[str]):
    """entries(class, set) gives a document's arrays; they leave in rows of a bucket each."""
    parts, held = [], 0
    for cluster, c, s in rows:
        if (got := entries(c, _salted(s, cluster))) is not None:
            parts.append(got)
            held += len(got[0])
        if held >= 1_000_000:
            yield _dealt(parts, buckets, names)
            parts, held = [], 0
    if held:
        yield _dealt(parts, buckets, names)


class Order:
    """Sorted hashes of frequent shingles, and a rank that grows with their count."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        order = np.argsort(h)
        self.h, self.rank = h[order], (1 + np.log2(np.maximum(1, n[order]))).astype(np.uint8)

    def sorted(self, s: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return s
        at = np.searchsorted(self.h, s)
        at[at == len(self.h)] = 0
        rank = np.where(self.h[at] == s, self.rank[at], 0)
        return s[np.argsort(rank, kind="stable")] if rank.any() else s

    def prefix(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        return self.sorted(s)[: n - need(n) + int(extra(n))]


def _frequent(scratch: Scratch, rows: DataFrame, reader, total: int, every: int, name: str) -> Order:
    """The order, from one class in `every`."""
    import pandas as pd

    buckets = max(1, -(-total // (every * 2 * BLOCK_ENTRIES)))

    def sampled(batches):
        yield from _collect(reader(batches), lambda c, s: (s,) if c % every == 0 else None, buckets, ["h"])

    def count(pdf):
        h, n = np.unique(np.frombuffer(b"".join(pdf["h"]), _U), return_counts=True)
        keep = n >= FREQUENT
        return pd.DataFrame({"h": h[keep].view(np.int64), "n": n[keep]})

    found = rows.mapInArrow(sampled, "bucket int, h binary").groupBy("bucket").applyInPandas(count, "h long, n long")
    found, least = scratch.save(found, f"frequent-{name}"), FREQUENT
    while found.where(F.col("n") >= least).count() > MOST_FREQUENT:
        least *= 2
    got = found.where(F.col("n") >= least).select("h", "n").toPandas()
    return Order(got["h"].to_numpy(np.int64).view(_U), got["n"].to_numpy(np.int64))


def _block_pairs(pdf):
    """Product of one block of columns: pairs of classes with their overlap count here and their bound."""
    import pandas as pd

    h, c, n = (np.frombuffer(b"".join(pdf[k]), t) for k, t in (("h", _U), ("c", np.int64), ("n", np.int32)))
    order = np.lexsort((c, n, h))
    h, c, n = h[order], c[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])  # copies have one class
    h, c, n = h[new], c[new], n[new].astype(np.int64)
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(h)))
    a, b, chain = [], [], []
    for k in np.unique(size[size > 1]):
        at = start[size == k]
        if k <= DENSE:
            x, y = np.triu_indices(int(k), 1)
            a.append((at[:, None] + x).ravel())
            b.append((at[:, None] + y).ravel())
        else:
            chain.append((at[:, None] + np.arange(int(k))).ravel())
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    ok = 100 * n[a] >= SIMILAR * n[b]  # by size within a column
    a, b = a[ok], b[ok]
    bound = np.minimum(extra(n[a]), extra(n[b]))
    pair, first, times = np.unique(np.sort(np.stack([c[a], c[b]], 1), axis=1), axis=0, return_index=True, return_counts=True) if len(a) else (np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    out = pd.DataFrame({"a": pair[:, 0], "b": pair[:, 1], "overlap": times.astype(np.int64), "bound": bound[first].astype(np.int64)})
    if chain:
        p = np.sort(np.concatenate(chain))
        begins = np.append(True, (p[1:] != p[:-1] + 1) | (h[p[1:]] != h[p[:-1]]) | (100 * n[p[:-1]] < SIMILAR * n[p[1:]]))
        hub = p[np.maximum.accumulate(np.where(begins, np.arange(len(p)), 0))]
        both = np.unique(np.sort(np.stack([c[hub[~begins]], c[p[~begins]]], 1), axis=1), axis=0)
        out = pd.concat([out, pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "overlap": np.int64(1 << 40), "bound": np.int64(1)})])
    return out


def candidate_edges(scratch: Scratch, rows: DataFrame, total: int, reader=_text_rows, every: int = SAMPLE, name: str = "all") -> DataFrame:
    """(a, b) classes. reader: makes (cluster, class, set) of rows' batches; total: the shingles of all sets."""
    order = rows.sparkSession.sparkContext.broadcast(_frequent(scratch, rows, reader, total, every, name))  # MOST_FREQUENT bounds it
    buckets = max(1, -(-total // (3 * BLOCK_ENTRIES)))

    def dealt(batches):
        def entries(c, s):
            p = order.value.prefix(s)
            return p, np.full(len(p), c), np.full(len(p), len(s), np.int32)

        yield from _collect(reader(batches), entries, buckets, ["h", "c", "n"])

    pairs = rows.mapInArrow(dealt, "bucket int, h binary, c binary, n binary").groupBy("bucket")
    pairs = pairs.applyInPandas(_block_pairs, "a long, b long, overlap long, bound long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.min("bound").alias("bound"))
    return scratch.save(pairs.where("overlap >= bound").select("a", "b"), f"candidates-{name}")


# --- exact links within clusters ------------------------------------------------------------------


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, by column blocks: dense ones multiply, sparse ones are counted."""
    m = len(sets)
    doc = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    start = np.cumsum(df) - df
    for k in np.unique(df[(df > 1) & (df <= 8)]):
        at = start[df == k]
        x, y = np.triu_indices(int(k), 1)
        code = (doc[at[:, None] + x] * m + doc[at[:, None] + y]).ravel()
        pair, times = np.unique(code, return_counts=True)
        out[pair // m, pair % m] += times
    out = out + out.T
    wide = np.flatnonzero(df > 8)
    rank = np.full(len(df), -1)
    rank[wide] = np.arange(len(wide))
    use = rank[col] >= 0
    doc, col = doc[use], rank[col[use]]
    for lo in range(0, len(wide), 2048):
        here = slice(*np.searchsorted(col, [lo, lo + 2048]))
        part = np.zeros((m, min(2048, len(wide) - lo)), np.float32)
        part[doc[here], col[here] - lo] = 1
        out += part @ part.T
    return out


def _link(classes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(least class, class) for every component of two or more."""
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(classes.min()), int(classes.max()))] if 100 * both >= SIMILAR * (n.sum() - both) else []
    both = np.rint(_overlaps(sets)).astype(np.int64)
    linked = 100 * both >= SIMILAR * (n[:, None] + n[None, :] - both)
    left, out = np.ones(len(n), bool), []
    for i in range(len(n)):
        if not left[i]:
            continue
        left[i] = False
        seen, front = [i], linked[i] & left
        while front.any():
            left &= ~front
            new = np.flatnonzero(front)
            seen += new.tolist()
            front = linked[new].any(0) & left
        if len(seen) > 1:
            c = classes[seen]
            out += [(int(c.min()), int(x)) for x in c if x != c.min()]
    return out


def _compare(pdf):
    import pandas as pd

    out = []
    for _, part in pdf.drop_duplicates(["cluster", "class"]).groupby("cluster"):
        if len(part) > 1:
            out += _link(part["class"].to_numpy(np.int64), [np.frombuffer(x, _U) for x in part["s"]])
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _whole_sets(batches):
    import pyarrow as pa

    seen: set[int] = set()  # rows may repeat an id with its text
    for batch in batches:
        rows, sets, classes = [], [], batch["class"].to_pylist()
        for d, s in _sets(batch):
            if classes[d] not in seen and _class_of(s) == classes[d]:
                seen.add(classes[d])
                rows.append(d)
                sets.append(s.tobytes())
        if rows:
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept["class"], kept["cluster"], kept["task"], pa.array(sets, pa.binary())], ["class", "cluster", "task", "s"])


def _sets_of(scratch: Scratch, docs: DataFrame, plan: DataFrame, name: str) -> DataFrame:
    """class, cluster, task and the whole set of the rows of plan: rep, mark, class, cluster, task."""
    plan = scratch.save(plan, f"{name}-plan")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    rows = docs.select("doc_id", "text", _mark().alias("text_mark"))
    rows = rows.join(plan, rows["doc_id"].eqNullSafe(F.col("rep")) & (F.col("text_mark") == F.col("mark"))).select("text", "class", "cluster", "task")
    return rows.mapInArrow(_whole_sets, "class long, cluster long, task string, s binary")


def _tasks(scratch: Scratch, sets: DataFrame, name: str) -> DataFrame:
    """Edges of the components that each task finds. sets: class, cluster, s, task."""
    return scratch.save(sets.groupBy("task").applyInPandas(_compare, "a long, b long"), f"{name}-edges")


def _load(members: DataFrame) -> DataFrame:
    """members (class, cluster, n, ...) with the load of their cluster."""
    load = members.groupBy("cluster").agg(F.sum(F.greatest(F.col("n"), F.lit(256))).alias("load"))
    return members.join(load, "cluster")


def _link_clusters(scratch: Scratch, docs: DataFrame, members: DataFrame) -> DataFrame:
    """members: rep, mark, class, cluster, n. Edges whose components are those of all links."""
    members = scratch.save(_load(members), "members")
    small, large = members.where(F.col("load") <= TASK_SHINGLES), members.where(F.col("load") > TASK_SHINGLES)
    edges = _tasks(scratch, _sets_of(scratch, docs, small.withColumn("task", _bin(small)).select("rep", "mark", "class", "cluster", "task"), "small"), "small")
    if large.isEmpty():
        return edges
    sets = _sets_of(scratch, docs, large.select("rep", "mark", "class", "cluster", F.lit("").alias("task")), "large").drop("task")
    sets = scratch.save(sets, "large-sets")
    # the same join within each cluster, by the cluster's own columns and counts
    total = large.agg(F.sum("n")).first()[0]
    pairs = candidate_edges(scratch, sets.select("cluster", "class", "s"), total, _set_rows, 1, "large")
    roots = connected_components(scratch, pairs, "cc-large", LOCAL_EDGES)
    now = large.select("class", "n").join(roots.select(F.col("node").alias("class"), F.col("root").alias("cluster")), "class")
    now = scratch.save(_load(now), "parted")
    small, large = now.where(F.col("load") <= TASK_SHINGLES), now.where(F.col("load") > TASK_SHINGLES)
    sets = sets.select("class", "s")
    edges = edges.unionByName(_tasks(scratch, sets.join(small.withColumn("task", _bin(small)).select("class", "cluster", "task"), "class"), "parted"))
    return edges if large.isEmpty() else edges.unionByName(_link_large(scratch, sets, large))


def _bin(members: DataFrame):
    whole = members.agg(F.sum(F.greatest(F.col("n"), F.lit(256)))).first()[0] or 0
    return F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-whole * 4 // TASK_SHINGLES)))))


def _link_large(scratch: Scratch, sets: DataFrame, large: DataFrame) -> DataFrame:
    """Edges within clusters of any size. large: class, cluster, n, load."""
    weight = F.greatest(F.col("n"), F.lit(256))
    chunks = F.ceil(F.col("load") / TASK_SHINGLES)
    task = F.concat_ws("/", "cluster", F.pmod(F.xxhash64("class"), chunks))
    edges = _tasks(scratch, sets.join(large.select("class", "cluster", task.alias("task")), "class"), "within")
    comps = None
    for k in range(ROUNDS + 1):
        now = _labelled(scratch, large, edges, f"round-{k}")
        if k == ROUNDS:
            break
        size = scratch.save(now.groupBy("cluster", "comp").agg(F.count("*").alias("size"), F.expr("array_agg(DISTINCT class) FILTER (WHERE pmod(xxhash64(class, 7), 1024) = 0)").alias("few"), F.min("class").alias("least")), f"sizes-{k}")
        many = size.where("size >= 4")
        before, comps = comps, many.count()
        if comps < 2 or (before and comps > (1 - WORTH) * before):
            break
        # eight members of a component speak for it; those of one cluster are dealt to tasks anew each round
        speakers = many.select("cluster", F.explode(F.array_distinct(F.slice(F.array_append(F.coalesce("few", F.array().cast("array<bigint>")), F.col("least")), 1, 8))).alias("class"))
        speakers = large.join(speakers, ["cluster", "class"], "left_semi")
        loads = speakers.groupBy("cluster").agg(F.ceil(F.sum(weight) / TASK_SHINGLES).alias("tasks"))
        speakers = speakers.join(loads, "cluster").select("class", "cluster", F.concat_ws("/", "cluster", F.pmod(F.xxhash64("class", F.lit(k)), F.col("tasks"))).alias("task"))
        edges = edges.unionByName(_tasks(scratch, sets.join(speakers, "class"), f"speakers-{k}"))
    loads = now.groupBy("cluster", "comp").agg(F.sum(weight).alias("comp_load"))
    now = now.join(loads, ["cluster", "comp"])
    pure = F.col("comp_load") >= TASK_SHINGLES / 2
    part = F.when(pure, F.concat_ws(":", F.lit("p"), "comp", F.pmod(F.xxhash64("class"), F.ceil(F.col("comp_load") / TASK_SHINGLES)))).otherwise(F.concat(F.lit("m"), F.pmod(F.xxhash64("comp"), chunks)))
    now = scratch.save(now.withColumn("part", part).withColumn("pure", F.when(pure, F.col("comp"))).select("class", "cluster", "part", "pure"), "parts")
    parts = now.select("cluster", "part", "pure").distinct()
    x, y = parts.select("cluster", F.col("part").alias("p"), F.col("pure").alias("u")), parts.select("cluster", F.col("part").alias("q"), F.col("pure").alias("v"))
    pairs = x.join(y, "cluster").where("p <= q and not coalesce(u = v, false) and (p <> q or u is null)")  # chunks of a cluster, not documents
    name = F.concat_ws("/", "cluster", "p", "q").alias("task")
    both = pairs.select("cluster", F.col("p").alias("part"), name).unionByName(pairs.select("cluster", F.col("q").alias("part"), name)).distinct()
    last = now.join(both, ["cluster", "part"]).select("class", "cluster", "task")
    return edges.unionByName(_tasks(scratch, sets.join(last, "class"), "across"))


def _labelled(scratch: Scratch, members: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    roots = connected_components(scratch, edges, f"cc-{name}", LOCAL_EDGES).select(F.col("node").alias("class"), F.col("root"))
    return members.join(roots, "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root")


def _mark() -> Column:
    return F.xxhash64("text")


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per input row."""
    return _components(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _components(docs: DataFrame) -> DataFrame:
    """ngram_components with the mark of the row's text and the root of its component, null for an empty set."""
    scratch = Scratch(docs.sparkSession, "ngram")
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    profile = scratch.save(docs.withColumn("mark", _mark()).mapInArrow(_profile, f"doc_id {kind}, mark long, n long, class long"), "profile")
    total = profile.agg(F.sum("n")).first()[0] or 0
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("r")
    classes = profile.where("n > 0").groupBy("class").agg(rep, F.max("n").alias("n"))
    classes = scratch.save(classes.select("class", F.col("r.doc_id").alias("rep"), "r.mark", "n"), "classes")
    clusters = connected_components(scratch, candidate_edges(scratch, docs.select("text"), total), "cc-candidates", LOCAL_EDGES)
    members = classes.join(clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")), "class")
    edges = _link_clusters(scratch, docs, members.select("rep", "mark", "class", "cluster", "n"))
    linked = connected_components(scratch, edges, "cc-links", LOCAL_EDGES).select(F.col("node").alias("class"), "root")
    linked = scratch.save(classes.join(linked, "class").select("class", "root", "rep"), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    component = linked.join(least, "root").select("class", "root", "least")
    final = classes.join(component, "class", "left").select("class", F.coalesce("root", "class").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    final = scratch.save(final, "components")
    out = profile.join(final, "class", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "mark", "n", "root", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of linked ones, that with the smallest doc_id; null ids rank last."""
    scratch = Scratch(docs.sparkSession, "ngram-stage")
    found = scratch.save(_components(docs).where("n > 0").select("doc_id", "mark", "root"), "found")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    judged = scratch.save(found.join(first, "root").select("doc_id", "mark", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))).alias("kept")), "judged")
    left = with_rows(docs, judged.where("not kept"), "left_anti", _mark())
    again = judged.where("kept").groupBy("doc_id", "mark").count().where("count > 1")
    if again.isEmpty():
        return left
    # equal texts of one id
    repeated = with_rows(left, again, "left_semi", _mark()).dropDuplicates(["doc_id", "text"])
    return with_rows(left, again, "left_anti", _mark()).unionByName(repeated)
