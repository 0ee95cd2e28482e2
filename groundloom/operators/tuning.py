"""Choice of alpha and theta, threshold sweeps, and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.config import EvalConfig, MatchConfig
from groundloom.functions.metrics import finite, risk
from groundloom.functions.vectors import Embedder
from groundloom.operators import matching, ranking
from groundloom.operators.prefix import spread_number
from groundloom.sources.staging import staged


def hashed(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def folds(df: DataFrame, k: Column | int, seed: str = "fold", id_col: str = "response_id") -> DataFrame:
    """df with `fold`: of each class, rows in the order of a hash of their id take folds in turn."""
    numbered = spread_number(df.withColumn("__key", hashed(seed, id_col)), ["y"], "__key", "__number")
    return numbered.withColumn("fold", (F.col("__number") % k).cast("int")).drop("__key", "__number")


def alpha_scores(rows: DataFrame, config: EvalConfig) -> DataFrame:
    """alpha, cv_auc: the mean AUC over validation folds for each alpha of the grid.

    With fewer rows of a class than folds there are that many folds; with fewer than two, one fold of all.
    """
    good = rows.where(~F.col("unscorable"))
    classes = good.groupBy("y").agg(F.count(F.lit(1)).alias("c")).agg(F.when(F.count(F.lit(1)) == 2, F.min("c")).otherwise(0).alias("least"))
    k = classes.select(F.greatest(F.least(F.lit(config.cv_folds), "least"), F.lit(1)).alias("k"))
    dealt = folds(good.crossJoin(F.broadcast(k)), F.col("k"))
    each = dealt.withColumn("alpha", F.explode(F.array(*map(F.lit, config.alpha_grid))))
    each = each.withColumn("h", risk(F.col("EG"), F.col("RP"), F.col("alpha")))
    return ranking.auc(each, ["alpha", "fold"]).groupBy("alpha").agg(F.avg("auc").alias("cv_auc"))


def best_alpha(scores: DataFrame, grid: tuple[float, ...] = EvalConfig().alpha_grid) -> DataFrame:
    """The smallest alpha of the largest score; nearest to 0.7 if no score is defined; the middle of the grid if nothing was scored."""
    key = F.struct(F.coalesce("cv_auc", F.lit(-1.0)).alias("a"), F.when(F.col("cv_auc").isNull(), -F.abs(F.col("alpha") - 0.7)).otherwise(0.0).alias("b"), (-F.col("alpha")).alias("c"))
    return scores.agg(F.max(key).alias("x")).select(F.coalesce(-F.col("x.c"), F.lit(float(grid[len(grid) // 2]))).alias("alpha"))


def sample(rows: DataFrame, n: int, seed: str = "sample", id_col: str = "response_id") -> DataFrame:
    """n rows without replacement: those of the smallest hashes."""
    return rows.withColumn("__key", hashed(seed, id_col)).orderBy("__key", id_col).limit(n).drop("__key")


def threshold_sweep(answers: DataFrame, contexts: DataFrame, questions: DataFrame, labels: DataFrame, embed: Embedder, match: MatchConfig, config: EvalConfig, alpha: float) -> DataFrame:
    """tau_e, tau_r, n, auc over a grid of thresholds.

    A name's strength is that of its best match (2: without vectors). For a triple, the matches that no other
    one beats in both its ends and its predicate answer all thresholds: of them stands, for each threshold of
    predicates, the strength of the ends, so a triple is one row whatever the grid.
    """
    from groundloom.functions.text import normalize

    entity, relation = config.sweep_entity, config.sweep_relation
    refs, ref_triples = staged(matching.union_entities(contexts, questions), "references"), matching.union_relations(contexts, questions)
    names = answers.select("response_id", "source_id", F.explode("entities").alias("raw")).withColumn("v", normalize(F.col("raw")))
    each = staged(names.where("v != ''").select("source_id", "v").distinct(), "names")
    met = matching.matching_pairs(each, refs, "v", "w", match, embed, min(entity)).groupBy("source_id", "v").agg(F.max("strength").alias("best"))
    # A name of a source with no reference matches at no threshold, as one whose best match is below them all.
    best = staged(names.join(met, ["source_id", "v"], "left").withColumn("best", F.coalesce("best", F.lit(-1.0))), "best")
    share = lambda c, t: F.avg((F.col(c) >= F.lit(t)).cast("double"))
    eg = best.groupBy("response_id").agg(*(share("best", t).alias(f"eg{k}") for k, t in enumerate(entity)))
    edges = answers.select("response_id", "source_id", F.explode("relations").alias("e")).select("response_id", "source_id", "e", *(normalize(F.col(f"e.{c}")).alias(c) for c in "sro"))
    edges = staged(edges, "edges")
    pairs = matching.triple_pairs(edges.where("s != '' AND o != ''"), ref_triples, match, embed, min(entity), min(relation))
    skyline = [F.max(F.when(F.col("rel") >= t, F.col("ends"))).alias(f"held{k}") for k, t in enumerate(relation)]
    gate = {c: best.groupBy("response_id", F.col("v").alias(c)).agg(F.max("best").alias(f"best_{c}")) for c in "so"}
    tried = edges.join(pairs.groupBy("source_id", *"sro").agg(*skyline), ["source_id", *"sro"], "left").join(gate["s"], ["response_id", "s"], "left").join(gate["o"], ["response_id", "o"], "left")
    none = F.lit(-1.0)
    strength = [F.max(F.least(*(F.coalesce(c, none) for c in (f"held{k}", "best_s", "best_o")))).alias(f"held{k}") for k in range(len(relation))]
    per_edge = tried.groupBy("response_id", "e").agg(*strength)
    rp = per_edge.groupBy("response_id").agg(*(share(f"held{j}", t).alias(f"rp{k}_{j}") for k, t in enumerate(entity) for j in range(len(relation))))
    rows = eg.join(rp, "response_id", "left").join(labels.select("response_id", "y"), "response_id")
    risks = [F.struct(F.lit(e).alias("tau_e"), F.lit(r).alias("tau_r"), risk(F.col(f"eg{k}"), F.col(f"rp{k}_{j}"), alpha).alias("h")) for k, e in enumerate(entity) for j, r in enumerate(relation)]
    # Only an answer's risks, a number for each point of the grid, are rows of their own.
    rows = rows.select("y", F.explode(F.array(*risks)).alias("x")).select("y", "x.*")
    return ranking.auc(rows, ["tau_e", "tau_r"]).select("tau_e", "tau_r", "n", "auc")


def poisson_steps(most: int = 32) -> list[list[int]]:
    """For each mean from 0 to `most`, the 32-bit numbers at which a Poisson draw steps up by one."""
    from math import exp

    out: list[list[int]] = [[]]
    for n in range(1, most + 1):
        term, total, steps = exp(-n), 0.0, []
        for k in range(5 * n + 20):
            total += term
            term *= n / (k + 1)
            if int(total * 2**32) >= 2**32 - 1:
                break
            steps.append(int(total * 2**32))
        out.append(steps)
    return out


def normal_steps(count: int = 1024) -> list[float]:
    """Quantiles of the normal distribution in the middle of `count` equal shares, to six digits."""
    from statistics import NormalDist

    return [round(NormalDist().inv_cdf((k + 0.5) / count), 6) for k in range(count)]


def draws(key: Column, n: Column) -> Column:
    """How often n rows are drawn together, from the first 32 bits of a hex hash: Poisson with mean n; above 32 by the normal distribution."""
    steps, normal = poisson_steps(), normal_steps()
    u = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    few = F.size(F.filter(F.element_at(F.lit(steps), (F.least(n, F.lit(len(steps) - 1)) + 1).cast("int")), lambda p: u >= p))
    z = F.element_at(F.lit(normal), (F.shiftright(u, 22) + 1).cast("int"))
    many = F.greatest(F.floor(n + F.sqrt(n.cast("double")) * z + F.lit(0.5)), F.lit(0))
    return F.when(n < len(steps), few).otherwise(many).cast("bigint")


def bootstrap(rows: DataFrame, theta: float, config: EvalConfig, h: str = "h", metrics: dict | None = None) -> DataFrame:
    """metric, lo, hi: percentile intervals over replicates with both classes, of AUC and F1 or of other metrics.

    Rows of one score and class are counted first and drawn together, as often as Poisson draws of each would
    come to: a replicate costs a step for each distinct score, however many the rows. metrics: by name, a
    function of replicates (rep, h, y, w, the draws) that returns rep and v.
    """
    good = rows.where(finite(F.col(h))).select("response_id", "y", F.col(h).alias("h"))
    counted = good.groupBy("h", "y").agg(F.count(F.lit(1)).alias("n"), F.min("response_id").alias("first"))
    drawn = counted.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(config.bootstrap_replicates - 1))))
    # The scores may be few, and all in one task, but their draws are the work.
    drawn = drawn.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep")
    drawn = drawn.withColumn("w", draws(hashed(str(config.seed), "rep", "first"), F.col("n"))).where("w > 0").select("rep", "h", "y", "w")
    drawn = staged(drawn, "draws")
    auc = staged(ranking.auc(drawn, ["rep"], weight=F.col("w")).where("auc IS NOT NULL").select("rep", F.col("auc").alias("v")), "draws-auc")
    if metrics is None:
        metrics = {"f1": lambda d: ranking.prf(d, ["rep"], theta, weight=F.col("w")).select("rep", F.col("f1").alias("v"))}
        each = auc.select(F.lit("auc").alias("metric"), "v")
    else:
        each = auc.limit(0).select(F.lit("").alias("metric"), "v")
    for name, of in metrics.items():
        each = each.unionByName(of(drawn).join(auc.select("rep"), "rep", "left_semi").select(F.lit(name).alias("metric"), "v"))
    band = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), band.alias("band")).select("metric", "n", F.col("band")[0].alias("lo"), F.col("band")[1].alias("hi"))
