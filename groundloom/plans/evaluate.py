"""Tuning, evaluation, audits and the report, over staged rows. Only small result tables come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.config import EvalConfig, MatchConfig
from groundloom.functions.metrics import cfi, risk
from groundloom.operators import ranking, tuning


def tune(train: DataFrame, config: EvalConfig, sweep: DataFrame | None = None) -> dict:
    """alpha (given, or by cross-validation), theta of the largest F1, and the trace, with that of a threshold sweep if given.

    Without a train row that can be scored alpha is the middle of the grid, and theta 0.5.
    """
    trace = [] if config.alpha is not None else [r.asDict() for r in tuning.alpha_scores(train, config).orderBy("alpha").collect()]
    scores = train.sparkSession.createDataFrame([(r["alpha"], r["cv_auc"]) for r in trace], "alpha double, cv_auc double")
    alpha = config.alpha if config.alpha is not None else tuning.best_alpha(scores, config.alpha_grid).first().alpha
    best = ranking.best_threshold(train.withColumn("h", risk(F.col("EG"), F.col("RP"), alpha)).where(~F.col("unscorable"))).first()
    found = {"alpha": alpha, "theta": best.theta, "train_f1": best.f1, "alpha_cv": trace}
    return found if sweep is None else found | {"tau_sweep": [r.asDict() for r in sweep.orderBy("tau_e", "tau_r").collect()]}


def tables(rows: DataFrame, alpha: float, theta: float, config: EvalConfig) -> dict[str, DataFrame]:
    """The evaluation of test rows: answers that can't be scored are left out of `main` and imputed in `imputed`."""
    rows = rows.withColumn("h", risk(F.col("EG"), F.col("RP"), alpha))
    main = rows.where(~F.col("unscorable"))
    imputed = rows.withColumn("h", F.when(F.col("unscorable"), F.lit(config.empty_response_impute_h)).otherwise(F.col("h")))
    return {
        "auc_by_task": ranking.auc(ranking.with_overall(main, "task"), ["grp"]),
        "auc_by_model": ranking.auc(ranking.with_overall(main, "gen_model"), ["grp"]),
        "prf_by_task": ranking.prf(ranking.with_overall(main, "task"), ["grp"], theta),
        "ablation": ranking.ablation(main, ["H_eg", "H_rp", "h"]),
        "length_buckets": ranking.length_buckets(main, config.context_length_edges),
        "graph_stats": ranking.graph_stats(ranking.with_overall(rows, "task")),
        "mann_whitney": ranking.mann_whitney(main),
        "intervals": tuning.bootstrap(main, theta, config),
        "auc_imputed": ranking.auc(imputed, []),
        "prf_imputed": ranking.prf(imputed, [], theta),
        "degenerate": ranking.degenerate(rows),
        "histogram": ranking.histogram(main, ["task", "y"]),
    }


def summary(found: dict[str, DataFrame], rows: DataFrame, tuned: dict, match: MatchConfig, theta: float, n_failed: int = 0) -> DataFrame:
    """One row: the settings, the overall figures of both policies, intervals, and counts of odd answers. rows: of the test, with h."""
    overall = ranking.auc(rows.where(~F.col("unscorable")), []).select(F.col("auc").alias("overall_AUC_exclude_unscorable"))
    at_theta = ranking.prf(rows.where(~F.col("unscorable")), [], theta).select(F.col("precision").alias("overall_P"), F.col("recall").alias("overall_R"), F.col("f1").alias("overall_F1"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    bands = found["intervals"].agg(*(of(m, c).alias(f"overall_{m.upper()}_{c}") for m in ("auc", "f1") for c in ("lo", "hi")))
    settings = {"alpha": tuned["alpha"], "theta": theta, "tau_e": match.entity_sim_threshold, "tau_r": match.relation_sim_threshold}
    out = overall.select(*(F.lit(float(v)).alias(k) for k, v in settings.items()), "*")
    odd = found["degenerate"].select(*(F.col(c).alias(f"degenerate_{c}") for c in found["degenerate"].columns), F.lit(n_failed).alias("degenerate_failed_extractions"))
    imputed = found["auc_imputed"].select(F.col("auc").alias("overall_AUC_impute")).crossJoin(F.broadcast(found["prf_imputed"].select(F.col("f1").alias("overall_F1_impute"))))
    for one in (at_theta, bands, imputed, odd):  # a row each
        out = out.crossJoin(F.broadcast(one))
    return out


#: Columns of a summary that a short print shows.
SHORT = ("alpha", "theta", "tau_e", "tau_r", "overall_AUC_exclude_unscorable", "overall_F1", "overall_AUC_impute")


def audits(scored: DataFrame, instances: DataFrame, alpha: float, theta: float, impute: float, timings: dict[str, float] | None = None) -> DataFrame:
    """split and the audit record of each scored answer as JSON, nulls kept; rounding is half-up to 4 places."""
    names = [c for c in ("response_id", "task", "gen_model", "split", "y", "gt_span_types", "context", "query", "response") if c in instances.columns]
    joined = scored.join(instances.select(*names), "response_id")
    joined = joined.withColumns({"H": risk(F.col("EG"), F.col("RP"), alpha, impute), "CFI": cfi(F.col("EG"), F.col("RP"), alpha)})
    sizes = F.struct(*(F.col(c) for c in ("Vc", "Ec", "Vq", "Eq", "Va", "Ea")))
    rounded = {c: F.round(c, 4).alias(c) for c in ("EG", "RP", "CFI", "H")}
    lists = ("matched_entities", "ungrounded_entities", "supported_relations", "unsupported_relations")
    types = F.col("gt_span_types") if "gt_span_types" in names else F.array().cast("array<string>")
    spent = F.create_map(*(F.lit(x) for kv in (timings or {}).items() for x in kv)) if timings else F.create_map().cast("map<string,double>")
    record = F.struct(
        "response_id", "source_id", "task", "gen_model", "split", F.lit(alpha).alias("alpha"), F.lit(theta).alias("theta"),
        rounded["EG"], rounded["RP"], "RP_defined", rounded["CFI"], rounded["H"], (F.col("H") >= theta).alias("flagged"),
        "unscorable", "ref_empty", sizes.alias("graph_sizes"), *lists, F.col("y").alias("gt_label"), types.alias("gt_span_types"),
        spent.alias("timings_s"), "query", "response",
    )
    return joined.select("split", "response_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def failures(instances: DataFrame, answers: DataFrame, contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """stage, response_id, source_id and error of the graphs that are missing: of sources, and of answers, with those that their source leaves without one.

    The three graph tables have a column `error`, null where extraction went well.
    """
    bad = F.col("error").isNotNull()
    refs = contexts.where(bad).select("source_id", "error").unionByName(questions.where(bad).select("source_id", "error")).groupBy("source_id").agg(F.min("error").alias("error"))
    lost = instances.select("response_id", "source_id").join(refs.select("source_id"), "source_id", "left_semi")
    none = F.lit(None).cast("string").alias("response_id")
    skipped = lost.select(F.lit("response(skipped: ref failed)").alias("stage"), "response_id", "source_id", F.lit("reference extraction failed").alias("error"))
    own = answers.where(bad).join(lost.select("response_id"), "response_id", "left_anti").select(F.lit("response").alias("stage"), "response_id", "source_id", "error")
    return refs.select(F.lit("reference").alias("stage"), none, "source_id", "error").unionByName(skipped).unionByName(own)


def _table(columns: list[str], rows: list) -> str:
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}", *(f"| {' | '.join(map(show, r))} |" for r in rows)])


#: Headings of a report's tables.
HEADINGS = {
    "auc_by_task": "AUC by task", "auc_by_model": "AUC by generator", "prf_by_task": "Precision, recall and F1 by task at theta", "ablation": "AUC of each share alone and of both",
    "length_buckets": "AUC by length of the context", "graph_stats": "Sizes of graphs", "mann_whitney": "Rank-sum test, flagged above others", "intervals": "Bootstrap intervals",
    "auc_imputed": "AUC with imputed risks", "prf_imputed": "Precision, recall and F1 with imputed risks", "degenerate": "Answers that can't be scored", "histogram": "Histogram of the risk",
}


def report(found: dict[str, DataFrame], tuned: dict | None = None, usage: dict | None = None, summary: dict | None = None, settings: dict | None = None) -> str:
    """Markdown of small tables: settings, summary, evaluation, tuning trace and usage; undefined is blank."""
    parts = []
    for title, one in (("Settings", settings), ("Summary", summary)):
        if one:
            parts.append((title, _table(["name", "value"], list(one.items()))))
    for name, df in found.items():
        columns, rows = df.columns, [tuple(r) for r in df.collect()]
        if name == "mann_whitney":
            of = dict(zip(columns, rows[0], strict=True))
            p = ranking.p_value(of["z"], of["n1"], of["n0"], of["u"], of["ties"])
            columns, rows = [*columns, "p_value"], [(*rows[0], p)]
        parts.append((f"{HEADINGS.get(name, name)} ({name})", _table(columns, rows)))
    for name in ("alpha_cv", "tau_sweep"):
        if rows := (tuned or {}).get(name):
            parts.append((f"Tuning on train rows (tuning: {name})", _table(list(rows[0]), [tuple(r.values()) for r in rows])))
    if usage:
        parts.append(("Calls, cost and cache (usage)", _table(list(usage), [tuple(usage.values())])))
    return "\n\n".join(f"## {k}. {title}\n\n{text}" for k, (title, text) in enumerate(parts, 1)) + "\n"
