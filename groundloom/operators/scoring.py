"""Entity grounding, relation preservation and audit lists of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.config import MatchConfig
from groundloom.functions.metrics import cfi, complement, risk
from groundloom.functions.text import contains_words, normalize, word_runs
from groundloom.functions.vectors import Embedder
from groundloom.operators import matching
from groundloom.sources.staging import staged

ID = ["response_id", "source_id"]


def _sizes(graph: DataFrame, key: str, mark: str) -> DataFrame:
    named = F.exists("entities", lambda e: normalize(e) != "")
    return graph.select(key, F.size("entities").alias(f"V{mark}"), F.size("relations").alias(f"E{mark}"), named.alias(f"named_{mark}"))


def score(answers: DataFrame, contexts: DataFrame, questions: DataFrame, config: MatchConfig, embed: Embedder | None = None) -> DataFrame:
    """A row per answer: sizes, EG, RP, flags and the four audit lists.

    answers has response_id, source_id, entities and relations, which are distinct; contexts and questions
    have source_id, entities and relations. EG and RP are shares of the raw names and triples; answers whose
    source has no graph are left out.
    """
    refs = matching.union_entities(contexts, questions)
    raw = answers.select(*ID, F.explode("entities").alias("raw")).withColumn("v", normalize(F.col("raw")))
    edges = answers.select(*ID, F.explode("relations").alias("e")).select(*ID, "e", *(normalize(F.col(f"e.{c}")).alias(c) for c in "sro"))
    ends = edges.select("source_id", F.explode(F.array(normalize(F.col("s")), normalize(F.col("o")))).alias("v"))
    matched = staged(matching.match_entities(raw.select("source_id", "v").union(ends), refs, config, embed), "matched")
    aligned = matching.align_relations(edges.select("source_id", *"sro"), matching.union_relations(contexts, questions), matched, config, embed)

    hits = raw.join(matched, ["source_id", "v"], "left")
    seen = F.col("method").isNotNull()
    per_name = hits.groupBy(*ID).agg(
        F.sum(seen.cast("bigint")).alias("grounded"),
        _listed(F.when(seen, F.struct("raw", "v", "ref", "method")), ("v", "ref", "method")).alias("matched_entities"),
        F.transform(F.sort_array(F.collect_list(F.when(~seen, F.struct("raw", "v")))), lambda x: x["v"]).alias("ungrounded_entities"),
    )
    held = edges.join(aligned.select("source_id", *"sro", F.lit(True).alias("held")), ["source_id", *"sro"], "left")
    yes = F.coalesce("held", F.lit(False))
    per_edge = held.groupBy(*ID).agg(
        F.sum(yes.cast("bigint")).alias("supported"),
        _listed(F.when(yes, F.struct("e", *"sro")), "sro").alias("supported_relations"),
        _listed(F.when(~yes, F.struct("e", *"sro")), "sro").alias("unsupported_relations"),
    )
    out = answers.select(*ID, F.size("entities").alias("Va"), F.size("relations").alias("Ea"))
    out = out.join(_sizes(contexts, "source_id", "c"), "source_id").join(_sizes(questions, "source_id", "q"), "source_id", "left")
    out = out.join(per_name, ID, "left").join(per_edge, ID, "left")
    return out.select(
        *ID,
        *(F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("Vc", "Ec", "Vq", "Eq", "Va", "Ea")),
        F.try_divide(F.col("grounded").cast("double"), F.when(F.col("Va") > 0, F.col("Va"))).alias("EG"),
        F.try_divide(F.col("supported").cast("double"), F.when(F.col("Ea") > 0, F.col("Ea"))).alias("RP"),
        (F.col("Ea") > 0).alias("RP_defined"),
        *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in _LISTS.items()),
        (F.col("Va") == 0).alias("unscorable"),
        (~(F.coalesce("named_c", F.lit(False)) | F.coalesce("named_q", F.lit(False)))).alias("ref_empty"),
    )


_TRIPLES = "array<struct<s:string,r:string,o:string>>"
_LISTS = {"matched_entities": "array<struct<v:string,ref:string,method:string>>", "ungrounded_entities": "array<string>", "supported_relations": _TRIPLES, "unsupported_relations": _TRIPLES}


def _listed(item: Column, names) -> Column:
    """The items in the order of their raw form, which comes first, without it."""
    return F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in names)))


def eval_rows(scored: DataFrame, instances: DataFrame, alpha: float) -> DataFrame:
    """The flat row of an answer for evaluation: risks by both shares and by each alone."""
    given = instances.select("response_id", "task", "gen_model", "split", "y", F.length("context").alias("context_len"))
    rows = scored.join(given, "response_id")
    return rows.select(
        *ID, "task", "gen_model", "split", "y", "context_len", "Vc", "Ec", "Vq", "Eq", "Va", "Ea", "EG", "RP", "unscorable", "ref_empty",
        cfi(F.col("EG"), F.col("RP"), alpha).alias("CFI"),
        risk(F.col("EG"), F.col("RP"), alpha).alias("H"),
        complement(F.col("EG")).alias("H_eg"),
        complement(F.col("RP")).alias("H_rp"),
    )


def supported_in_text(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The `support` mode, as this library reads it: triples (source_id, s, r, o) whose two ends stand in the
    normalized text of the source (source_id, text) as whole words.

    Each end of a source is looked for once, and only in a text that has its first word among its own.
    """
    given = texts.select("source_id", normalize(F.col("text")).alias("body"))
    words = given.select("source_id", F.explode(F.array_distinct(word_runs(F.col("body")))).alias("word"))
    ends = edges.select("source_id", F.explode(F.array("s", "o")).alias("end")).distinct().withColumn("word", F.element_at(word_runs(F.col("end")), 1))
    likely = ends.join(words, ["source_id", "word"], "left_semi").unionByName(ends.where("word IS NULL")).drop("word")
    found = staged(likely.join(given, "source_id").where(contains_words(F.col("body"), F.col("end"))).select("source_id", "end"), "ends-in-texts")
    for c in "so":
        edges = edges.join(found.withColumnRenamed("end", c), ["source_id", c], "left_semi")
    return edges.select("source_id", *"sro").distinct()


def critical_risk(scored: DataFrame, beta: float = 0.5, k: int = 3) -> DataFrame:
    """The `support-critical` mode, as this library reads it: beta * (1 - EG) + (1 - beta) * the mean risk of the
    k riskiest claims, a claim being a triple and its risk 1 if it is unsupported. Without claims 1 - EG alone."""
    risks = F.concat(F.transform("unsupported_relations", lambda _: F.lit(1.0)), F.transform("supported_relations", lambda _: F.lit(0.0)))
    top = F.slice(risks, 1, k)  # unsupported first
    mean = F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), F.when(F.size(top) > 0, F.size(top)))
    eg = F.lit(1.0) - F.col("EG")
    return scored.select(*ID, mean.alias("H_top"), F.when(mean.isNull(), eg).otherwise(F.lit(beta) * eg + F.lit(1.0 - beta) * mean).alias("H_critical"))
