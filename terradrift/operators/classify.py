"""Rule classes, descriptor flags, second classes, and the assembly of labels.

Thresholds compare null-safely: a missing feature makes a comparison false."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradrift import schema
from terradrift.schema import FEATURES
from terradrift.tables import Stage, quantiles

KEY = ("source_file", "pid")


# The limits of the rules and flags.
@dataclass(frozen=True)
class Thresholds:
    v_stable: float = 2.5
    noise: float = 3.0
    quad_r2: float = 0.05
    accel: float = 1.5
    cusum: float = 2.5
    jump_mm: float = 5.0
    seasonal_r2: float = 0.15
    noisy_trend: float = 4.0
    linear_r2: float = 0.65
    curved_r2: float = 0.85
    variable_r2: float = 0.5
    flag_velocity: float = 2.5


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def rule_class(t: Thresholds = Thresholds()) -> Column:
    """The first rule that holds; null for the residual, which the mixture model or `other` takes."""
    v, diff, quad = F.col("v_robust"), F.col("v_diff"), F.col("quad_coeff")
    slow, known = F.abs(v) < t.v_stable, v.isNotNull()
    fit = F.col("velocity_r2")
    curved = (F.abs(v) >= t.v_stable) & (fit < t.curved_r2) & (F.col("quad_r2") > t.quad_r2)
    faster = ((v < 0) & (diff < -t.accel) & (quad < 0)) | ((v > 0) & (diff > t.accel) & (quad > 0))
    slower = ((v < 0) & (diff > t.accel) & (quad > 0)) | ((v > 0) & (diff < -t.accel) & (quad < 0))
    return (
        F.when(yes(known & slow & (F.col("rmse_detrended") <= t.noise)), "stable")
        .when(yes(known & slow & (F.col("rmse_detrended") > t.noise)), "noisy")
        .when(yes(known & slow & (F.col("cusum_score") > t.cusum) & (fit < t.variable_r2)), "variable")
        .when(yes(curved & faster), "accel")
        .when(yes(curved & slower), "decel")
        .when(yes(known & (fit >= t.linear_r2)), "linear")
    )


def flags(t: Thresholds = Thresholds()) -> dict[str, Column]:
    v = F.col("v_robust")
    return {
        "periodic": yes(F.col("seasonal_r2") > t.seasonal_r2),
        "jumpy": yes((F.col("n_jumps") >= 1) & (F.col("jump_max_mm") > t.jump_mm)),
        "variable_flag": yes((F.col("cusum_score") > t.cusum) & v.isNotNull()),
        "noisy_trend": yes((F.abs(v) >= t.flag_velocity) & (F.col("rmse_deseason") > t.noisy_trend)),
    }


def eligible(points: DataFrame, min_coherence: float = 0.5, min_velocity: float = 0.0) -> DataFrame:
    return points.where((F.col("temporal_coherence") >= min_coherence) & (F.abs("mean_velocity") >= min_velocity))


def eligibility(points: DataFrame, min_coherence: float = 0.5, min_velocity: float = 0.0) -> DataFrame:
    """Counts, quartiles and warnings of the thresholds, one row."""
    rows = points.select(F.col("temporal_coherence").cast("double").alias("coh"), F.abs(F.col("mean_velocity")).cast("double").alias("vel"))
    ok = yes((F.col("coh") >= min_coherence) & (F.col("vel") >= min_velocity))
    out = rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_eligible"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("coh", "vel") for f in (F.min, F.max)])
    quarters = (0.25, 0.5, 0.75)
    q = quantiles(Stage(points.sparkSession, "eligibility"), rows, [], ["coh", "vel"], quarters)
    shown = [F.try_element_at(F.first(c), F.lit(k + 1)).alias(f"{c}_p{int(100 * x)}") for c in ("coh", "vel") for k, x in enumerate(quarters)]
    out = out.crossJoin(F.broadcast(q.agg(*shown)))  # single rows
    pct = 100.0 * F.try_divide(F.col("n_eligible"), F.col("n"))
    return out.withColumns({"pct_eligible": pct, "coherence_high": yes(F.lit(min_coherence) > 0.85 * F.col("coh_max")), "few_eligible": yes(pct < 1.0)})


def distances_to(centre: Column, features: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(f) - centre[f]) * (F.col(f) - centre[f]) for f in features])


def centroids(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """source_file, label and mean features of classes with two complete members or more."""
    complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    means = rows.where(complete & F.col(label).isNotNull()).groupBy("source_file", label).agg(F.count("*").alias("members"), *[F.avg(f).alias(f) for f in features])
    return means.where("members >= 2")


def second_class(rows: DataFrame, label: str, features: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """key, class_2: the class of the nearest centroid of another class in the same file, `other` where there is
    none or a feature is missing. Centroids are gathered in one array per file (a row per class), so each
    row is compared within its own task; ties take the class that sorts first."""
    means = centroids(rows, label, features)
    per_file = means.groupBy("source_file").agg(F.collect_list(F.struct(F.col(label).alias("name"), *features)).alias("means"))
    joined = rows.join(per_file, "source_file", "left")
    d = F.transform(F.filter("means", lambda c: c["name"] != F.col(label)), lambda c: F.struct(distances_to(c, features).alias("d"), c["name"].alias("name")))
    best = F.array_min(F.filter(d, lambda x: x["d"].isNotNull()))
    return joined.select(*key, F.coalesce(best["name"], F.lit("other")).alias("class_2"))


def classify(features: DataFrame, points: DataFrame, residual: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Labels of all points: source_file, pid, class_1, class_2, class_prob_1 and four flags. features holds the
    eligible points; residual (source_file, pid, class_1, class_2, class_prob_1) classes of those no rule took."""
    ruled = features.withColumn("rule", rule_class(t)).withColumns(flags(t))
    second = second_class(ruled, "rule", list(FEATURES))
    out = ruled.join(second, list(KEY))
    if residual is None:
        none = F.col("rule").isNull()
        out = out.select(*KEY, F.coalesce("rule", F.lit("other")).alias("class_1"), F.when(none, "other").otherwise(F.col("class_2")).alias("class_2"), F.lit(1.0).cast("float").alias("class_prob_1"), *flags(t))
    else:
        r = residual.select(*KEY, F.col("class_1").alias("g1"), F.col("class_2").alias("g2"), F.col("class_prob_1").alias("gp"))
        out = out.join(r, list(KEY), "left")
        ruled_now = F.col("rule").isNotNull()
        out = out.select(
            *KEY,
            F.coalesce("rule", "g1", F.lit("other")).alias("class_1"),
            F.when(ruled_now, F.col("class_2")).otherwise(F.coalesce("g2", F.lit("other"))).alias("class_2"),
            F.when(ruled_now, 1.0).otherwise(F.coalesce("gp", F.lit(0.0))).cast("float").alias("class_prob_1"),
            *flags(t),
        )
    return with_labels(points.select(*KEY), out)


def with_labels(points: DataFrame, labels: DataFrame) -> DataFrame:
    """points with the label columns in place of any they have; points without a label are unclassified."""
    columns = ["class_1", "class_2", "class_prob_1", "periodic", "jumpy", "variable_flag", "noisy_trend"]
    first = labels.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*columns))).where("__r = 1").drop("__r")
    out = points.drop(*columns).join(first, list(KEY), "left")
    fill = {"class_1": schema.UNCLASSIFIED, "class_2": schema.UNCLASSIFIED, "class_prob_1": 0.0, "periodic": False, "jumpy": False, "variable_flag": False, "noisy_trend": False}
    return out.fillna(fill)


def class_distribution(labels: DataFrame, column: str = "class_1") -> DataFrame:
    n = labels.groupBy(column).agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", (100.0 * F.col("n") / F.col("total")).alias("pct")).orderBy(F.desc("n"), column)


def flag_distribution(labels: DataFrame) -> DataFrame:
    names = ("periodic", "jumpy", "variable_flag", "noisy_trend")
    row = labels.agg(F.count("*").alias("total"), *[F.count_if(n).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in names])).alias("p")
    return row.select("total", pairs).select("p.flag", "p.n", (100.0 * F.try_divide(F.col("p.n"), F.col("total"))).alias("pct"))


def robust_scale(rows: DataFrame, features: list[str]) -> DataFrame:
    """features centred on the median and divided by the interquartile range (1 where that is 0), per file."""
    q = quantiles(Stage(rows.sparkSession, "scale"), rows, ["source_file"], features, (0.25, 0.5, 0.75))
    q = q.select("source_file", *[F.col(f).alias(f"__{f}") for f in features])
    out = rows.join(q, "source_file", "left")
    scaled = {}
    for f in features:
        at = lambda k: F.get(F.col(f"__{f}"), F.lit(k))  # noqa: B023, E731
        spread = at(2) - at(0)
        scaled[f] = (F.col(f) - at(1)) / F.when(spread == 0, 1.0).otherwise(spread)
    return out.withColumns(scaled).drop(*[f"__{f}" for f in features])


def top_two(probabilities: Column, names: tuple[str, ...] = schema.CLASSES) -> Column:
    """struct(class_1, class_2, class_prob_1) of an array with a probability a class; of equal ones the class that is listed
    first, and the sum is taken as one."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    order = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    name = lambda k: F.get(F.array(*map(F.lit, names)), F.get(order, F.lit(k))["i"])
    return F.struct(name(0).alias("class_1"), name(1).alias("class_2"), (-F.get(order, F.lit(0))["p"] / F.when(total == 0, 1.0).otherwise(total)).alias("class_prob_1"))
