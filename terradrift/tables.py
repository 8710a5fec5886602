"""Intermediate tables in the folder that driver and executors share, and jobs over whole tables that need them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder on one machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="terradrift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate tables go when the driver's Python ends; results may be read until then."""

    def go() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            delete(spark, path)

    atexit.register(go)


class Stage:
    """Writes DataFrames as Parquet under spark.checkpoint.dir (a temporary folder where that is unset) and
    reads them back, which cuts lineage and survives the loss of executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        delete_at_exit(spark, self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def kept(self, name: str) -> Stage:
        """A stage in a folder of this one, which goes with it."""
        inner = object.__new__(Stage)
        inner.spark, inner.root = self.spark, f"{self.root}/{name}"
        return inner


def least_labels(stage: Stage, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable over edges (a, b), both directions given. Each round
    takes the least label among neighbours and then the label of that label, so labels jump over paths."""
    labels = stage.keep(nodes.select("node", F.col("node").alias("label")), "labels-0")
    step = 0
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("low"), "label")
        up = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = low.join(up, "low").select("node", F.least("low", "lower").alias("label"), (F.least("low", "lower") != F.col("label")).alias("moved"))
        step += 1
        new = stage.keep(new, f"labels-{step}")
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def numbered(stage: Stage, df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of unique columns: ranges are numbered alone and shifted by the sizes of
    those before, so no task sees all rows."""
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = stage.keep(parts.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("long") - 1), f"numbered-{name}")
    sizes, shifts, total = sorted(parts.groupBy("__part").count().collect()), [], 0  # a row a partition
    for part, n in sizes:
        shifts.append((part, total))
        total += n
    shift = stage.spark.createDataFrame(shifts, "__part int, __shift long")
    return parts.join(F.broadcast(shift), "__part").withColumn(name, F.col(name) + F.col("__shift")).drop("__part", "__shift")


#: Values that percentile_approx tells apart: a value's rank is off by one in so many at most. Groups of so many values
#: are counted in one place.
ACCURACY = 10_000


def quantiles(stage: Stage, df: DataFrame, by: list[str], columns: list[str], fractions: tuple[float, ...], name: str = "quantiles") -> DataFrame:
    """by, and for each column the array of its interpolated quantiles: exact, without all values of a large group in one
    task.

    A sketch brackets each quantile first. Then the values below a bracket are counted, and those in it, one in a thousand or
    so, are counted by value and ranked. Groups of ACCURACY values at most are ranked whole."""
    n, k = len(columns), len(fractions)
    reach = 5 / ACCURACY  # the sketch's error twice, and a rank more
    ends = [F.lit(min(1.0, max(0.0, q + d))) for q in fractions for d in (-reach, reach)]
    rough = df.groupBy(*by).agg(*[F.count(F.col(c)).alias(f"__n{i}") for i, c in enumerate(columns)], *[F.percentile_approx(F.col(c).cast("double"), F.array(*ends), F.lit(ACCURACY)).alias(f"__b{i}") for i, c in enumerate(columns)])
    rough = stage.keep(rough.withColumn("__one", F.lit(1)), f"{name}-rough")
    join = [*by, "__one"]
    rows = df.select(*by, F.lit(1).alias("__one"), *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)]).join(rough if by else F.broadcast(rough), join)
    low = lambda i, j: F.col(f"__b{i}")[2 * j]
    high = lambda i, j: F.col(f"__b{i}")[2 * j + 1]
    large = lambda i: F.col(f"__n{i}") > ACCURACY
    cells = [(i, j) for i in range(n) for j in range(k)]
    counted = [F.count_if(large(i) & (F.col(f"__v{i}") < low(i, j))).alias(f"__l{i}_{j}") for i, j in cells]
    whole = [F.percentile(F.when(~large(i), F.col(f"__v{i}")), F.array(*map(F.lit, fractions))).alias(f"__p{i}") for i in range(n)]
    below = stage.keep(rows.groupBy(*join).agg(*counted, *whole).join(rough, join), f"{name}-below")
    if below.where(" or ".join(f"__n{i} > {ACCURACY}" for i in range(n))).isEmpty():
        return below.select(*by, *[F.col(f"__p{i}").alias(c) for i, c in enumerate(columns)])
    inside = F.array(*[F.when(large(i) & F.col(f"__v{i}").between(low(i, j), high(i, j)), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"__v{i}").alias("v"))) for i, j in cells])
    inside = rows.select(*join, F.explode(F.array_compact(inside)).alias("s")).groupBy(*join, "s.i", "s.j", "s.v").agg(F.count("*").alias("c"))
    sums = F.sum("c").over(Window.partitionBy(*join, "i", "j").orderBy("v"))
    less = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(fractions[j]).alias("q"), F.col(f"__n{i}").alias("n"), F.col(f"__l{i}_{j}").alias("l")) for i, j in cells])
    less = below.select(*join, F.explode(less).alias("e")).select(*join, "e.*")
    ranked = inside.withColumn("upto", sums).join(less, [*join, "i", "j"]).withColumn("upto", F.col("upto") + F.col("l"))
    at = F.col("q") * (F.col("n") - 1)
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    got = ranked.groupBy(*join, "i", "j").agg(first(F.floor(at)).alias("a"), first(F.ceil(at)).alias("b"), F.max(at - F.floor(at)).alias("f"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("f")) * F.col("a") + F.col("f") * F.col("b"))
    found = got.select(*join, F.struct("i", "j", value.alias("v")).alias("e")).groupBy(*join).agg(F.sort_array(F.collect_list("e")).alias("e"))
    of = lambda i: F.transform(F.filter("e", lambda x: x["i"] == i), lambda x: x["v"])
    return below.join(found, join, "left").select(*by, *[F.when(large(i), of(i)).otherwise(F.col(f"__p{i}")).alias(c) for i, c in enumerate(columns)])
