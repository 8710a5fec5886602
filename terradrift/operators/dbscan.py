"""Velocity-weighted DBSCAN as relational algebra, whole or per group.

Points lie in (east, north, velocity * eps_m / eps_vel); neighbours are within eps_m, bounds included, and a core
point has min_samples of them counting itself. Clusters are numbered in the order of their first core point; a border
point joins the lowest-numbered cluster among its core neighbours.

Fine cells, whose diagonal is eps_m, hold mutual neighbours only. Three things follow, and with them the
work grows with the points and not with the square of a crowded place:

* A cell of min_samples points is dense: all its points are core. Only points of sparse cells, fewer than min_samples
  in a cell, look for neighbours (an equi-join on cells of side eps_m); those in a dense cell are counted by cell.
* Core points of one cell are one node, its first core point, so the graph has a node a cell and a few edges each.
* Two dense cells are linked when one pair of points is within eps_m. Boxes and their outermost points decide most
  pairs; those left are cut in halves along each axis until the boxes decide or the points are few enough to be
  compared. Where they are many, those that other links join are left out first.

Nodes are joined within spatial blocks first, in one task each, which a block's size bounds; the blocks' components
and the links across are a small graph, whose least labels are propagated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradrift.ship import ship
from terradrift.tables import Stage, least_labels, numbered

AXES = ("x", "y", "z")
#: Fine cells along each side of a block.
BLOCK = 48
#: Boxes with fewer pairs of points than this are compared point by point.
FEW_PAIRS = 256
#: Undecided pairs of cells from which it pays to leave out those that other links join.
MANY_OPEN = 200_000


def velocity_axis(v: Column, eps_m: float, eps_vel: float, floor: float = 1e-9) -> Column:
    return v * F.lit(eps_m / max(eps_vel, floor))


def _all(columns: list[Column], op) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = op(out, c)
    return out


def _square(a, b) -> Column:
    """Squared distance of two points, given by what fetches an axis."""
    return _all([(a(k) - b(k)) * (a(k) - b(k)) for k in AXES], lambda u, w: u + w)


def _around(names: list[str], reach: int, half: bool = False) -> Column:
    """Structs of the cells within reach along each axis; with half, one of each two opposite ones and not the cell itself."""
    steps = range(-reach, reach + 1)
    offsets = [(i, j, k) for i in steps for j in steps for k in steps if not half or (i, j, k) > (0, 0, 0)]
    return F.array(*[F.struct(*[(F.col(n) + F.lit(o)).alias(n) for n, o in zip(names, offset, strict=True)]) for offset in offsets])


def _boxes(p: DataFrame, by: list[str]) -> DataFrame:
    """n, the bounds and the outermost points of each group."""
    point = F.struct(*AXES)
    bounds = [f(k).alias(f"{name}{k}") for k in AXES for name, f in (("lo", F.min), ("hi", F.max))]
    return p.groupBy(*by).agg(F.count("*").alias("n"), *bounds, F.array(*[f(point, k) for k in AXES for f in (F.min_by, F.max_by)]).alias("w"))


def _judged(pairs: DataFrame, limit: Column) -> DataFrame:
    """pairs of boxes (columns of _boxes with _a and _b) that may hold neighbours, with linked: whether they surely do."""
    side = lambda name, k, s: F.col(f"{name}{k}_{s}")
    gaps = [F.greatest(F.lit(0.0), side("lo", k, "b") - side("hi", k, "a"), side("lo", k, "a") - side("hi", k, "b")) for k in AXES]
    spans = [F.greatest(side("hi", k, "b") - side("lo", k, "a"), side("hi", k, "a") - side("lo", k, "b")) for k in AXES]
    total = lambda parts: _all([c * c for c in parts], lambda u, w: u + w)
    witness = F.exists("w_a", lambda u: F.exists("w_b", lambda w: _square(lambda k: u[k], lambda k: w[k]) <= limit))
    return pairs.where(total(gaps) <= limit).withColumn("linked", (total(spans) <= limit) | witness)


def _sided(boxes: DataFrame, side: str, keys: dict[str, str]) -> DataFrame:
    return boxes.select(*[F.col(c).alias(keys.get(c, f"{c}_{side}")) for c in boxes.columns])


def _dense_links(stage: Stage, p: DataFrame, fine: list[str], cell_side: float, limit: Column, others: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): first points of dense cells that hold neighbours, as far as others (a, b), links already known, don't
    join them anyway. p: points of dense cells, with chief; nodes: all nodes and their blocks."""
    boxes = stage.keep(_boxes(p, [*fine, "chief"]), "boxes")
    names, group = fine[-3:], fine[:-3]
    a = _sided(boxes.select("*", F.explode(_around(names, 2, half=True)).alias("at")).drop(*names).select("*", "at.*").drop("at"), "a", {c: c for c in fine} | {"chief": "a"})
    b = _sided(boxes, "b", {c: c for c in fine} | {"chief": "b"})
    pairs = stage.keep(_judged(a.join(b, [*group, *names]), limit).select("a", "b", "linked"), "box-pairs")
    links = pairs.where("linked").select("a", "b")
    open_ = pairs.where("not linked").select("a", "b")
    n_open = open_.count()
    if not n_open:
        return links
    if n_open > MANY_OPEN:
        labels = _components(stage.kept("known"), links.unionByName(others), nodes)
        for end in ("a", "b"):
            open_ = open_.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end)
        open_ = open_.where("la <> lb").select("a", "b")
    open_ = open_.select("a", "b", F.array().cast("array<bigint>").alias("ka"), F.array().cast("array<bigint>").alias("kb"))
    open_, depth = stage.keep(open_, "open-0"), 0
    while not open_.isEmpty():
        depth += 1
        # sub-cells of the cells in question, one level down; k names a sub-cell, up the one it lies in
        inside = p.join(open_.select(F.explode(F.array("a", "b")).alias("chief")).distinct(), "chief", "left_semi")
        key = lambda d: F.array(*[F.floor(F.col(k) / F.lit(cell_side / 2**d)) for k in AXES])  # noqa: E731, B023
        up = key(depth - 1) if depth > 1 else F.array().cast("array<bigint>")
        inside = stage.keep(inside.select("chief", *AXES, key(depth).alias("k"), up.alias("up")), f"inside-{depth}")
        sub = stage.keep(_boxes(inside, ["chief", "k", "up"]), f"sub-{depth}")
        found = open_.join(_sided(sub, "a", {"chief": "a", "k": "k_a", "up": "ka"}), ["a", "ka"]).join(_sided(sub, "b", {"chief": "b", "k": "k_b", "up": "kb"}), ["b", "kb"])
        found = stage.keep(_judged(found, limit).select("a", "b", F.col("k_a").alias("ka"), F.col("k_b").alias("kb"), "n_a", "n_b", "linked"), f"found-{depth}")
        few = found.where((~F.col("linked")) & (F.col("n_a") * F.col("n_b") <= FEW_PAIRS))
        left, right = (inside.select(F.col("chief").alias(e), F.col("k").alias(f"k{e}"), *[F.col(k).alias(f"{k}_{e}") for k in AXES]) for e in ("a", "b"))
        near = few.join(left, ["a", "ka"]).join(right, ["b", "kb"]).where(_square(lambda k: F.col(f"{k}_a"), lambda k: F.col(f"{k}_b")) <= limit)
        new = stage.keep(found.where("linked").select("a", "b").unionByName(near.select("a", "b")).distinct(), f"new-{depth}")
        links = links.unionByName(new)
        open_ = found.where((~F.col("linked")) & (F.col("n_a") * F.col("n_b") > FEW_PAIRS)).select("a", "b", "ka", "kb").join(new, ["a", "b"], "left_anti")
        open_ = stage.keep(open_, f"open-{depth}")
    return links


def least_in(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a - b and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not (new == new[new]).all():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _components(stage: Stage, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node that links (a, b) reach. nodes: node, block."""
    n_links = links.count()
    parts = max(int(stage.spark.conf.get("spark.sql.shuffle.partitions")), -(-n_links // 500_000))
    nodes = nodes.select("node", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"))
    for end in ("a", "b"):
        links = links.join(nodes.select(F.col("node").alias(end), F.col("part").alias(f"p{end}")), end)
    links = stage.keep(links, "links")

    def within(pdf):
        import pandas as pd

        node, least = least_in(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
        return pd.DataFrame({"node": node, "least": least})[node != least]

    ship(stage.spark)
    local = stage.keep(links.where("pa = pb").select("a", "b", "pa").groupBy("pa").applyInPandas(within, "node long, least long"), "local")
    across = links.where("pa <> pb").select("a", "b")
    for end in ("a", "b"):
        across = across.join(local.select(F.col("node").alias(end), F.col("least").alias(f"l{end}")), end, "left").withColumn(end, F.coalesce(f"l{end}", end)).drop(f"l{end}")
    across = across.where("a <> b").distinct()
    both = stage.keep(across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "across")
    top = least_labels(stage, both, both.select(F.col("a").alias("node")).distinct())
    out = nodes.select("node").join(local, "node", "left").withColumn("least", F.coalesce("least", "node"))
    return out.join(top.select(F.col("node").alias("least"), "label"), "least", "left").select("node", F.coalesce("label", "least").alias("label"))


def dbscan(points: DataFrame, eps_m: float, eps_vel: float, min_samples: int, group: tuple[str, ...] = (), floor: float = 1e-9) -> DataFrame:
    """idx, group columns and label (-1 for noise) of points with idx (a long, unique, orders them), e, n, v. With group
    columns each group is clustered alone and numbered from 0. Points without a coordinate are noise."""
    stage = Stage(points.sparkSession, "dbscan")
    g, limit = list(group), F.lit(float(eps_m) ** 2)
    side, fine_side = eps_m * (1 + 1e-9), eps_m / 3**0.5 * (1 - 1e-9)
    p = points.select("idx", *g, F.col("e").cast("double").alias("x"), F.col("n").cast("double").alias("y"), velocity_axis(F.col("v").cast("double"), eps_m, eps_vel, floor).alias("z"))
    p = p.withColumns({f"f{k}": F.floor(F.col(k) / fine_side) for k in AXES})
    fine, coarse = [*g, "fx", "fy", "fz"], ["cx", "cy", "cz"]
    cells = p.groupBy(*fine).agg(F.count("*").alias("size"), F.min("idx").alias("chief")).where((F.col("size") >= min_samples) & F.col("fx").isNotNull() & F.col("fy").isNotNull() & F.col("fz").isNotNull())
    p = stage.keep(p.join(cells.drop("size"), fine, "left").withColumns({f"c{k}": F.floor(F.col(k) / side) for k in AXES}), "points")
    # neighbours of the points in sparse cells: each pair of such points once, those in dense cells counted by cell
    a = p.where("chief is null").select(F.col("idx").alias("i"), *g, *[F.col(k).alias(f"a{k}") for k in AXES], F.explode(_around(coarse, 1)).alias("at")).select("*", "at.*").drop("at")
    b = p.select(F.col("idx").alias("j"), *g, *AXES, *coarse, F.col("chief").alias("cj"))
    near = _square(lambda k: F.col(f"a{k}"), lambda k: F.col(k)) <= limit
    pairs = a.join(b, [*g, *coarse]).where((F.col("cj").isNotNull() | (F.col("i") < F.col("j"))) & near)
    near = stage.keep(pairs.groupBy("i", F.coalesce("cj", "j").alias("j"), F.col("cj").isNotNull().alias("dense")).agg(F.count("*").alias("k")), "near")
    seen = near.select("i", "k").unionByName(near.where("not dense").select(F.col("j").alias("i"), "k"))
    sparse = seen.groupBy("i").agg((F.sum("k") + 1).alias("k")).where(F.col("k") >= min_samples).select(F.col("i").alias("idx"))
    if min_samples <= 1:
        sparse = p.where("chief is null and fx is not null and fy is not null and fz is not null").select("idx")
    lone = stage.keep(p.join(sparse, "idx", "left_semi").select("idx", *fine), "lone")
    lone = lone.join(lone.groupBy(*fine).agg(F.min("idx").alias("node")), fine).select("idx", "node", *fine)
    core = lone.unionByName(p.where("chief is not null").select("idx", F.col("chief").alias("node"), *fine))
    core = stage.keep(core, "core")
    block = F.concat_ws("/", *g, *[F.floor(F.col(f"f{k}") / BLOCK) for k in AXES])
    nodes = stage.keep(core.where("idx = node").select("node", *g, block.alias("block")), "nodes")
    of = core.select("idx", "node")
    links = near.join(of.select(F.col("idx").alias("i"), F.col("node").alias("a")), "i").join(of.select(F.col("idx").alias("j"), F.col("node").alias("b")), "j")
    links = stage.keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "sparse-links")
    links = links.unionByName(_dense_links(stage, p.where("chief is not null").select(*fine, *AXES, "chief"), fine, fine_side, limit, links, nodes))
    labels = stage.keep(_components(stage, links, nodes), "labels")
    heads = nodes.join(labels, "node").select(*g, F.col("label").alias("head")).distinct()
    if g:
        heads = heads.withColumn("number", F.dense_rank().over(Window.partitionBy(*g).orderBy("head")).cast("long") - 1)
    else:
        heads = numbered(stage, heads, "head")
    numbers = labels.join(heads.select(F.col("head").alias("label"), "number"), "label").select("node", "number")
    cores = stage.keep(of.join(numbers, "node").select("idx", "number"), "numbers")
    both = near.select("i", "j").unionByName(near.where("not dense").select(F.col("j").alias("i"), F.col("i").alias("j")))
    border = both.join(of.select(F.col("idx").alias("i")), "i", "left_anti").join(cores.withColumnRenamed("idx", "j"), "j")
    border = border.groupBy(F.col("i").alias("idx")).agg(F.min("number").alias("number"))
    return p.select("idx", *g).join(cores.unionByName(border), "idx", "left").select("idx", *g, F.coalesce("number", F.lit(-1)).cast("long").alias("label"))
