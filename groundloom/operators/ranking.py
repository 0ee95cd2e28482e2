"""Rank statistics of scores h against labels y: AUC, Mann-Whitney U, thresholds.

Rows are first counted by distinct score, so that a group's rows, however many, meet only as counts; running
counts go by ranges of the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundloom.functions.metrics import finite

#: Ranges of a score for each unit.
STEPS = 4096
OVERALL = "OVERALL"


def with_overall(df: DataFrame, key: str) -> DataFrame:
    """Each row under its own key (rows without one are left out) and under OVERALL, as column `grp`."""
    return df.withColumn("grp", F.explode(F.array(F.col(key), F.lit(OVERALL)))).where(F.col("grp").isNotNull())


def ladder(df: DataFrame, group: list[str], h: str = "h", y: str = "y", weight: Column | None = None) -> DataFrame:
    """group, h, pos, neg, pos_below, neg_below, prev: counts at each distinct finite score, counts below it, and the score before."""
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    given = df.where(finite(F.col(h))).withColumn("__w", w)
    at = given.groupBy(*group, F.col(h).alias("h")).agg(*(F.sum(F.when(F.col(y) == v, F.col("__w")).otherwise(0)).alias(n) for n, v in (("pos", 1), ("neg", 0))))
    at = at.where("pos + neg > 0").withColumn("__range", F.floor(F.col("h") * STEPS))
    ranges = at.groupBy(*group, "__range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("h").alias("top"))
    order = Window.partitionBy(*group).orderBy("__range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*group, "__range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in "pn"), F.lag("top").over(order).alias("__top"))
    inside = Window.partitionBy(*group, "__range").orderBy("h")
    here = inside.rowsBetween(Window.unboundedPreceding, -1)
    found = at.join(starts, [*group, "__range"])
    below = [(F.col(f"__{c[0]}") + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(f"{c}_below") for c in ("pos", "neg")]
    return found.select(*group, "h", "pos", "neg", *below, F.coalesce(F.lag("h").over(inside), F.col("__top")).alias("prev"))


def auc(df: DataFrame, group: list[str], h: str = "h", y: str = "y", weight: Column | None = None) -> DataFrame:
    """group, n, n_pos, u (of the positives) and auc, null with one class only. Ties count half."""
    at = ladder(df, group, h, y, weight)
    u2 = F.sum(F.col("pos") * (2 * F.col("neg_below") + F.col("neg")))
    sums = at.groupBy(*group).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("n_pos"), u2.alias("u2"))
    both = F.col("n_pos") * (F.col("n") - F.col("n_pos"))
    return sums.select(*group, "n", "n_pos", (F.col("u2") / F.lit(2.0)).alias("u"), F.when(both > 0, F.col("u2") / (F.lit(2.0) * both)).alias("auc"))


def prf(df: DataFrame, group: list[str], theta: Column | float, h: str = "h", y: str = "y", weight: Column | None = None) -> DataFrame:
    """group, n, precision, recall and f1 of `h >= theta`; a share of nothing is 0."""
    t = theta if isinstance(theta, Column) else F.lit(float(theta))
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    said, true = F.col(h) >= t, F.col(y) == 1
    count = lambda c: F.sum(F.when(c, w).otherwise(0))
    sums = df.where(finite(F.col(h))).groupBy(*group).agg(F.sum(w).alias("n"), count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & true).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(*group, "n", share("tp", tp + fp).alias("precision"), share("tp", tp + fn).alias("recall"), F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def best_threshold(df: DataFrame, h: str = "h", y: str = "y") -> DataFrame:
    """theta, f1: the smallest of the thresholds of the largest F1 (0.5 and null with one class only).

    What is said changes only where the threshold crosses a score, so one threshold below each distinct
    score is enough: halfway to the score before, or just below the smallest.
    """
    at = ladder(df, [], h, y)
    total = df.where(finite(F.col(h))).agg(F.coalesce(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)), F.lit(0)).alias("all_pos"), F.coalesce(F.sum(F.when(F.col(y) == 0, 1).otherwise(0)), F.lit(0)).alias("all_neg"))
    tp, fp = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")
    middle = (F.col("prev") + F.col("h")) / F.lit(2.0)
    theta = F.when(F.col("prev").isNull(), F.col("h") - F.lit(1e-9)).when(middle > F.col("prev"), middle).otherwise(F.col("h"))
    tried = at.crossJoin(F.broadcast(total)).select(theta.alias("theta"), (2.0 * tp / (tp + fp + F.col("all_pos"))).alias("f1"), (F.col("all_pos") * F.col("all_neg") > 0).alias("both"))
    best = tried.where("both").agg(F.max(F.struct(F.col("f1"), (-F.col("theta")).alias("t"))).alias("x"))
    return best.select(F.coalesce(-F.col("x.t"), F.lit(0.5)).alias("theta"), F.col("x.f1").alias("f1"))


def mann_whitney(df: DataFrame, h: str = "h", y: str = "y") -> DataFrame:
    """n1, n0, u of the positives, both medians, z of the one-sided test 'greater', corrected for ties and continuity, and the tie sum."""
    at = ladder(df, [], h, y)
    t, n1, n0 = F.col("pos") + F.col("neg"), F.sum("pos"), F.sum("neg")
    sums = at.agg(n1.alias("n1"), n0.alias("n0"), (F.sum(F.col("pos") * (2 * F.col("neg_below") + F.col("neg"))) / F.lit(2.0)).alias("u"), F.sum(t.cast("double") * t * t - t).alias("ties"))
    medians = df.where(finite(F.col(h))).agg(*(F.median(F.when(F.col(y) == v, F.col(h))).alias(f"median_{v}") for v in (1, 0)))
    a, b = F.col("n1"), F.col("n0")
    n = (a + b).cast("double")
    spread = F.sqrt(a * b / F.lit(12.0) * (n + 1.0 - F.try_divide(F.col("ties"), n * (n - 1.0))))
    z = F.try_divide(F.col("u") - a * b / F.lit(2.0) - F.lit(0.5), spread)
    return sums.crossJoin(F.broadcast(medians)).select("n1", "n0", "u", "median_1", "median_0", F.when(a * b > 0, z).alias("z"), "ties")


#: Least product of the group sizes from which the exact distribution is not worked out.
EXACT = 200_000


def u_counts(n1: int, n0: int) -> list[int]:
    """How many of the arrangements of two groups without ties give each U from 0 to n1 * n0.

    The counts are the coefficients of a product of (1 - q^(n0 + i)) / (1 - q^i) over i up to n1: a
    multiplication subtracts what stands n0 + i places below, a division adds up every i-th place.
    """
    few, many = sorted((n1, n0))
    counts = [1] + [0] * (few * many)
    for i in range(1, few + 1):
        for k in range(len(counts) - 1, many + i - 1, -1):
            counts[k] -= counts[k - many - i]
        for k in range(i, len(counts)):
            counts[k] += counts[k - i]
    return counts


def p_value(z: float | None, n1: int = 0, n0: int = 0, u: float | None = None, ties: float = 1.0) -> float | None:
    """Of the one-sided rank-sum test: exact where a group has at most 8 rows and no scores are equal (ties 0), else by the normal distribution."""
    import math

    if z is not None and u is not None and not ties and 0 < min(n1, n0) <= 8 and n1 * n0 < EXACT:
        counts = u_counts(n1, n0)
        return sum(counts[int(u) :]) / sum(counts)
    return None if z is None else 0.5 * math.erfc(z / math.sqrt(2))


def average_precision(df: DataFrame, group: list[str], h: str = "h", y: str = "y", weight: Column | None = None) -> DataFrame:
    """group, n, n_pos and ap: the mean precision over the positives, each at the threshold of its own score; null without a positive."""
    at = ladder(df, group, h, y, weight)
    totals = at.groupBy(*group).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = at.join(totals, group) if group else at.crossJoin(F.broadcast(totals))  # one row
    tp, fp = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")
    sums = joined.groupBy(*group).agg(F.max(F.col("all_pos") + F.col("all_neg")).alias("n"), F.max("all_pos").alias("n_pos"), F.sum(F.col("pos") * (tp / (tp + fp))).alias("s"))
    return sums.select(*group, "n", "n_pos", F.try_divide(F.col("s"), F.when(F.col("n_pos") > 0, F.col("n_pos"))).alias("ap"))


def ablation(df: DataFrame, scores: list[str], y: str = "y") -> DataFrame:
    """score, n, n_pos, auc: each over its own finite rows."""
    each = df.select(F.col(y).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("score"), F.col(c).alias("h")) for c in scores))).alias("x")).select("y", "x.*")
    return auc(each, ["score"]).drop("u")


def bucket_of(x: Column, edges: list[int] | tuple[int, ...]) -> Column:
    """Number of the left-closed bucket, null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((x >= edges[i]) & (x < edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def length_buckets(df: DataFrame, edges: tuple[int, ...], h: str = "h") -> DataFrame:
    """bucket, mean_len over all rows, n and auc over finite ones; empty buckets are left out."""
    found = df.withColumn("bucket", bucket_of(F.col("context_len"), edges)).where(F.col("bucket").isNotNull())
    means = found.groupBy("bucket").agg(F.avg("context_len").alias("mean_len"))
    return means.join(auc(found, ["bucket"], h).select("bucket", "n", "auc"), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def graph_stats(df: DataFrame) -> DataFrame:
    """Means of graph sizes and shares of empty ones by grp."""
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in ("Vc", "Ec", "Va", "Ea")), share(F.col("Ea") == 0).alias("share_no_edges"), share(F.col("unscorable")).alias("share_unscorable"))


def degenerate(df: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    return df.agg(F.count(F.lit(1)).alias("n"), count(F.col("unscorable")).alias("unscorable"), count(F.col("ref_empty")).alias("ref_empty"), count(F.col("Ea") == 0).alias("no_edges"))


def histogram(df: DataFrame, group: list[str], h: str = "h", bins: int = 20) -> DataFrame:
    """group, bin (from 0), n and density over equal bins between each group's least and largest score."""
    good = df.where(finite(F.col(h)))
    span = good.groupBy(*group).agg(F.min(h).alias("lo"), F.max(h).alias("hi"), F.count(F.lit(1)).alias("total"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.when(width > 0, F.least(F.floor((F.col(h) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    found = good.join(F.broadcast(span), group) if not group else good.join(span, group)
    counts = found.withColumn("bin", place).groupBy(*group, "bin", "lo", "hi", "total").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*group, "bin", "n", F.try_divide(F.col("n").cast("double"), F.col("total") * width).alias("density"))
