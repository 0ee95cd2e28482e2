"""The registered queries of the grounding engine, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.config import Config, ExtractConfig, MatchConfig
from groundloom.functions import text
from groundloom.functions.metrics import complement
from groundloom.functions.vectors import letter_counts, measured
from groundloom.operators import extract, matching, near, ranking, scoring, tuning
from groundloom.plans import evaluate
from groundloom.plans.instances import graphs, instances, read, rows, scored, written_corpus
from groundloom.sources import jsonl
from groundloom.sources.staging import new_path, staged

CONFIG = Config()
ALPHA, THETA = 0.7, 0.5
Query = Callable[[SparkSession, str], DataFrame]


def _joined(c: str, sep: str = "|"):
    return F.array_join(c, sep)


def _triples(c: str):
    return F.array_join(F.transform(c, lambda e: F.concat_ws(">", e["s"], e["r"], e["o"])), "|")


def _doc_graphs(spark: SparkSession, d: str) -> DataFrame:
    return extract.offline_graph(read(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


def fake_entities(spark: SparkSession, d: str) -> DataFrame:
    return _doc_graphs(spark, d).select("doc_id", F.size("entities").alias("n"), _joined("entities").alias("entities"))


def fake_edges(spark: SparkSession, d: str) -> DataFrame:
    return _doc_graphs(spark, d).select("doc_id", F.posexplode("relations").alias("pos", "e")).select("doc_id", "pos", "e.s", "e.r", "e.o")


def graph_codec(spark: SparkSession, d: str) -> DataFrame:
    """Graphs written as JSON and read back."""
    coded = _doc_graphs(spark, d).select("doc_id", extract.graph_json(F.col("entities"), F.col("relations")).alias("json"))
    back = coded.select("doc_id", extract.graph_from_json(F.col("json")).alias("g"))
    return back.select("doc_id", _joined("g.entities").alias("entities"), _triples("g.relations").alias("relations"))


def build_instances(spark: SparkSession, d: str) -> DataFrame:
    return instances(spark, d).withColumn("context_len", F.length("context"))


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return instances(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def ref_union(spark: SparkSession, d: str) -> DataFrame:
    _, contexts, questions = graphs(instances(spark, d))
    return matching.union_entities(contexts, questions)


def ref_triples(spark: SparkSession, d: str) -> DataFrame:
    _, contexts, questions = graphs(instances(spark, d))
    return matching.union_relations(contexts, questions)


def normalize_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.select("doc_id", "pos", text.normalize(F.col("line")).alias("norm"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return extract.with_key(read(spark, d, "documents"), "text", CONFIG.extract).select("doc_id", "cache_key")


def cache_miss(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the cache, which holds those of the labelled documents, has no graph of."""
    docs = extract.with_key(read(spark, d, "documents"), "text", CONFIG.extract)
    cache = docs.join(read(spark, d, "labels"), "doc_id", "left_semi")
    return extract.misses(docs.select("cache_key", "text"), cache).select("cache_key", F.length("text").alias("n_chars"))


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    answers, contexts, questions = graphs(instances(spark, d))
    return answers.select("response_id", "source_id", F.explode("entities").alias("raw")).withColumn("v", text.normalize(F.col("raw"))), matching.union_entities(contexts, questions)


def eg_exact(spark: SparkSession, d: str) -> DataFrame:
    names, refs = _names(spark, d)
    exact = MatchConfig(allow_substring_match=False)
    found = names.join(matching.match_entities(names.select("source_id", "v"), refs, exact), ["source_id", "v"], "left")
    return found.groupBy("response_id").agg(F.count(F.lit(1)).alias("n"), F.count("ref").alias("matched"), (F.count("ref") / F.count(F.lit(1))).alias("eg"))


def match_cascade(spark: SparkSession, d: str) -> DataFrame:
    names, refs = _names(spark, d)
    return matching.match_entities(names.select("source_id", "v"), refs, CONFIG.match, letter_counts)


def substring_matches(spark: SparkSession, d: str) -> DataFrame:
    names, refs = _names(spark, d)
    return matching.substring_pairs(names.select("source_id", "v").distinct(), refs, CONFIG.match)


def _aligned(spark: SparkSession, d: str, config: MatchConfig) -> DataFrame:
    answers, contexts, questions = graphs(instances(spark, d))
    edges = answers.select("source_id", F.explode("relations").alias("e")).select("source_id", *(text.normalize(F.col(f"e.{c}")).alias(c) for c in "sro"))
    ends = edges.select("source_id", F.explode(F.array(text.normalize(F.col("s")), text.normalize(F.col("o")))).alias("v"))
    matched = staged(matching.match_entities(ends, matching.union_entities(contexts, questions), config, letter_counts), "matched")
    return matching.align_relations(edges, matching.union_relations(contexts, questions), matched, config, letter_counts)


def rp_align(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, CONFIG.match)


def rp_inverse(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, MatchConfig(inverse_edge_match=True))


def score_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d)


def audit_lists(spark: SparkSession, d: str) -> DataFrame:
    found = scored(instances(spark, d), CONFIG)
    matched = F.array_join(F.transform("matched_entities", lambda m: F.concat_ws(">", m["v"], m["ref"], m["method"])), "|")
    return found.select("response_id", matched.alias("matched"), _joined("ungrounded_entities").alias("ungrounded"), _triples("supported_relations").alias("supported"), _triples("unsupported_relations").alias("unsupported"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).withColumn("h", F.col("H"))


def auc_by_task(spark: SparkSession, d: str) -> DataFrame:
    return ranking.auc(ranking.with_overall(_scores(spark, d), "task"), ["grp"])


def auc_by_model(spark: SparkSession, d: str) -> DataFrame:
    return ranking.auc(ranking.with_overall(_scores(spark, d), "gen_model"), ["grp"])


def prf_by_task(spark: SparkSession, d: str) -> DataFrame:
    return ranking.prf(ranking.with_overall(_scores(spark, d), "task"), ["grp"], THETA)


def ablation_auc(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ablation(rows(spark, d), ["H_eg", "H_rp", "H"])


def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return ranking.length_buckets(_scores(spark, d), CONFIG.evaluate.context_length_edges)


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return ranking.graph_stats(ranking.with_overall(rows(spark, d), "task"))


def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    found = ranking.mann_whitney(_scores(spark, d))
    return found.drop("ties").withColumn("z", F.round("z", 6))


def impute_policy(spark: SparkSession, d: str) -> DataFrame:
    """AUC without the answers that can't be scored, and with their risk imputed."""
    found = _scores(spark, d)
    kept = found.where(~F.col("unscorable")).withColumn("policy", F.lit("exclude"))
    filled = found.withColumn("h", F.when(F.col("unscorable"), F.lit(0.5)).otherwise(F.col("h"))).withColumn("policy", F.lit("impute"))
    return ranking.auc(kept.unionByName(filled), ["policy"])


def degenerate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.degenerate(rows(spark, d))


def theta_f1(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_threshold(_scores(spark, d).where("split = 'train'"))


def alpha_cv(spark: SparkSession, d: str) -> DataFrame:
    found = tuning.alpha_scores(rows(spark, d).where("split = 'train'"), CONFIG.evaluate)
    best = tuning.best_alpha(found).withColumnRenamed("alpha", "best_alpha")
    return found.crossJoin(F.broadcast(best)).select("alpha", F.round("cv_auc", 9).alias("cv_auc"), "best_alpha")


def tau_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Over all train answers; tuning.sample is there for a sweep over fewer."""
    given = instances(spark, d).where("split = 'train'")
    return tuning.threshold_sweep(*graphs(given), given, letter_counts, CONFIG.match, CONFIG.evaluate, ALPHA)


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    found = tuning.bootstrap(_scores(spark, d).where("split = 'test'"), THETA, CONFIG.evaluate)
    return found.select("metric", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def embedding_nn(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vector of its label to every twentieth one."""
    given = read(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", "label", measured(F.col("embedding").cast("array<double>")).alias("vec"))
    asked = given.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label", F.col("vec").alias("vec_query"))
    refs = given.select(F.col("vec_id").alias("ref"), "label", F.col("vec").alias("vec_ref"))
    found = near.nearest(asked, refs, ["label"], "query", "ref", digits=9, other=True)
    return found.select("query", "label", "ref", F.round("cos", 6).alias("cos"))


def flag_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of answers from spans, with and without those that are true by implication."""
    from groundloom.sources.construct import response_label

    spans = F.filter(
        F.array(
            F.struct(F.when(F.col("toxic") == 1, "toxic").alias("label_type"), F.col("quality").cast("string").alias("implicit_true")),
            F.struct(F.when(F.col("quality") == 0, "low quality").alias("label_type"), F.lit("no").alias("implicit_true")),
        ),
        lambda s: s["label_type"].isNotNull(),
    )
    found = read(spark, d, "labels").select("doc_id", spans.alias("labels"))
    every, strict = (response_label(F.col("labels"), x) for x in (False, True))
    return found.select("doc_id", every["y"].alias("y_all"), strict["y"].alias("y_strict"), _joined(strict["types"], ",").alias("types"))


def json_facts(spark: SparkSession, d: str) -> DataFrame:
    from groundloom.sources.construct import flat_facts

    given = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    return given.select("event_id", F.explode(flat_facts(F.lit("The event"), "props", F.col("props"))).alias("fact"))


def dedupe_sources(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each key, from JSON lines: the events in order, a user being the key."""
    folder, as_text = new_path(spark, "events"), lambda c: F.col(c).cast("string")
    events = read(spark, d, "events").orderBy("event_id")
    jsonl.write_jsonl(events.select(as_text("user_id").alias("source_id"), F.col("event_type").alias("task_type"), as_text("event_id").alias("source"), as_text("value").alias("source_info")), f"{folder}/source_info.jsonl")
    last = jsonl.load_sources(spark, folder)
    return last.select(F.col("source_id").cast("bigint").alias("user_id"), F.col("source").cast("bigint").alias("event_id"), F.col("task_type").alias("event_type"), F.col("source_info").cast("double").alias("value"))


def first_instances(spark: SparkSession, d: str) -> DataFrame:
    """The first instance of each source."""
    return jsonl.first_of(read(spark, d, "documents"), "source", "doc_id", ["doc_id", "lang"])


def corpus_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances read from JSON lines, several answers to a source."""
    found = jsonl.load_instances(spark, written_corpus(spark, d))
    return found.select("response_id", "source_id", "task", "gen_model", "split", "context", "query", "response", "y", _joined("gt_span_types", ",").alias("types"), "quality", "prompt")


def corpus_train(spark: SparkSession, d: str) -> DataFrame:
    """Those of the train split, without labels that are true by implication."""
    found = jsonl.load_instances(spark, written_corpus(spark, d), exclude_implicit_true=True, splits=("train",))
    return found.select("response_id", "source_id", "split", "y", _joined("gt_span_types", ",").alias("types"))


def corpus_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores where a source has several answers."""
    found = scored(staged(jsonl.load_instances(spark, written_corpus(spark, d)), "instances"), CONFIG)
    return found.select("response_id", "source_id", "Vc", "Ec", "Vq", "Eq", "Va", "Ea", "EG", "RP", "unscorable", "ref_empty")


def match_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Names of all answers of a language against the references of its contexts: few, large sources."""
    answers, contexts, _ = graphs(instances(spark, d).withColumn("source_id", F.col("response_id")))
    task = instances(spark, d).select("response_id", F.col("task").alias("lang"))
    by_lang = [g.join(task, g[c] == task["response_id"]).select(F.col("lang").alias("source_id"), "entities") for g, c in ((answers.drop("source_id").withColumnRenamed("response_id", "id"), "id"), (contexts, "source_id"))]
    return matching.match_entities(matching.union_entities(by_lang[0]).withColumnRenamed("w", "v"), matching.union_entities(by_lang[1]), CONFIG.match)


def _three_words(graph: DataFrame) -> DataFrame:
    """Relations from each single word over the next to the one after."""
    words = F.filter("entities", lambda w: ~F.contains(w, F.lit(" ")))
    n = F.size("words")
    part = lambda k: F.slice("words", F.lit(k), F.greatest(n - 2, F.lit(0)))
    triples = F.transform(F.arrays_zip(part(1).alias("s"), part(2).alias("r"), part(3).alias("o")), lambda t: F.struct(t["s"].alias("s"), t["r"].alias("r"), t["o"].alias("o")))
    return graph.withColumn("words", words).withColumn("relations", triples).drop("words")


def predicate_align(spark: SparkSession, d: str) -> DataFrame:
    """Relations of many predicates, which agree if equal or by their vectors."""
    answers, contexts, questions = map(_three_words, graphs(instances(spark, d)))
    edges = answers.select("source_id", F.explode("relations").alias("e")).select("source_id", *(text.normalize(F.col(f"e.{c}")).alias(c) for c in "sro"))
    ends = edges.select("source_id", F.explode(F.array(text.normalize(F.col("s")), text.normalize(F.col("o")))).alias("v"))
    matched = staged(matching.match_entities(ends, matching.union_entities(contexts, questions), CONFIG.match, letter_counts), "matched")
    return matching.align_relations(edges, matching.union_relations(contexts, questions), matched, MatchConfig(inverse_edge_match=True), letter_counts)


def _word_backend():
    """A backend of the extraction interface: the first distinct words, each linked to the next, and a pair that is no triple."""
    import re

    def generate(given: str, cluster: bool, chunk_size: int | None) -> tuple[list, list]:
        words = list(dict.fromkeys(w for w in re.findall("[a-z][a-z0-9]+", given.lower()) if len(w) >= 4))[:12]
        if len(words) < 3:
            raise ValueError("too short")
        return [*words, *([f"chunk {chunk_size}"] if chunk_size else [])], [*((a, "next", b) for a, b in zip(words, words[1:], strict=False)), tuple(words[:2])]

    return generate


def backend_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Graphs by a backend that fails on short texts: one call, then the error stays in the row."""
    found = extract.backend_graph(read(spark, d, "documents"), "doc_id", "text", _word_backend, ExtractConfig(max_retries=1))
    return found.select("doc_id", _joined("entities").alias("entities"), _triples("relations").alias("relations"), "error")


def tuned_alpha_theta(spark: SparkSession, d: str) -> DataFrame:
    """What tuning on the train rows chooses."""
    found = evaluate.tune(rows(spark, d).where("split = 'train'"), CONFIG.evaluate)
    return spark.createDataFrame([(found["alpha"], found["theta"], found["train_f1"])], "alpha double, theta double, train_f1 double").select("alpha", *(F.round(c, 9).alias(c) for c in ("theta", "train_f1")))


def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    """The one-row summary of the test rows."""
    test = _scores(spark, d).where("split = 'test'")
    found = evaluate.summary(evaluate.tables(test, ALPHA, THETA, CONFIG.evaluate), test, {"alpha": ALPHA}, CONFIG.match, THETA)
    return found.select(*(F.round(c, 6).alias(c) if c.startswith("overall") else F.col(c) for c in found.columns))


def audit_records(spark: SparkSession, d: str) -> DataFrame:
    """Audit records, read back from their JSON."""
    given = instances(spark, d)
    kept = evaluate.audits(scored(given, CONFIG), given, ALPHA, THETA, CONFIG.evaluate.empty_response_impute_h)
    shape = "source_id string, task string, alpha double, EG double, RP double, RP_defined boolean, flagged boolean, unscorable boolean, graph_sizes struct<Vc:int,Va:int,Ea:int>, ungrounded_entities array<string>, gt_label int, query string, response string"
    record = kept.select("response_id", "split", F.from_json("record", shape).alias("x"), F.contains("record", F.lit('"query":null')).alias("null_kept"))
    sizes = [F.col(f"x.graph_sizes.{c}").alias(c) for c in ("Vc", "Va", "Ea")]
    return record.select("response_id", "split", "x.source_id", "x.task", "x.alpha", "x.EG", "x.RP", "x.RP_defined", "x.flagged", "x.unscorable", *sizes, _joined("x.ungrounded_entities").alias("ungrounded"), "x.gt_label", "x.query", "x.response", "null_kept")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls of a backend, of which views were answered by the cache."""
    return read(spark, d, "events").select("event_id", (F.col("event_type") == "view").alias("cached"), F.round(F.col("value") * 100).cast("bigint").alias("cost_cents"))


def usage_cumsum(spark: SparkSession, d: str) -> DataFrame:
    return extract.usage_log(_calls(spark, d), "event_id").select("event_id", "cum_calls", "cum_cost_cents")


def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return extract.usage_summary(_calls(spark, d))


def sample_n(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator: 300 rows without replacement."""
    return tuning.sample(read(spark, d, "documents").select("doc_id", "source"), 300, id_col="doc_id")


def prefix_limit(spark: SparkSession, d: str) -> DataFrame:
    """The limit operator: the first rows in order."""
    return jsonl.limited(read(spark, d, "documents").select("doc_id", "source"), 100, "doc_id")


def h_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ranking.histogram(_scores(spark, d), ["task", "y"])


def topk_claims(spark: SparkSession, d: str) -> DataFrame:
    return scoring.critical_risk(scored(instances(spark, d), CONFIG)).drop("source_id")


def text_support(spark: SparkSession, d: str) -> DataFrame:
    given = instances(spark, d)
    answers, _, _ = graphs(given)
    edges = answers.select("source_id", F.explode("relations").alias("e")).select("source_id", *(text.normalize(F.col(f"e.{c}")).alias(c) for c in "sro")).distinct()
    return scoring.supported_in_text(edges, given.select("source_id", F.col("context").alias("text")).dropDuplicates(["source_id"]))


def single_shares(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("response_id", complement(F.col("EG")).alias("h_eg"), complement(F.col("RP")).alias("h_rp"))


def skipped_responses(spark: SparkSession, d: str) -> DataFrame:
    """Failure rows of a run over the turns of conversations, whose sources are the labelled documents of their number.

    A source without one has no graph, so its answers are skipped; an answer without words has none of its own.
    """
    conv = F.col("conv_id").cast("string")
    turns = read(spark, d, "conversations").select(F.concat(conv, F.lit("-"), "turn").alias("response_id"), conv.alias("source_id"), "text")
    labelled = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("source_id"), F.lit(True).alias("has"))
    contexts = turns.select("source_id").distinct().join(labelled, "source_id", "left").select("source_id", F.when(F.col("has").isNull(), "no document").alias("error"))
    answers = extract.offline_graph(turns, "text").select("response_id", "source_id", F.when(F.size("entities") < 3, "few words").alias("error"))
    return evaluate.failures(turns, answers, contexts, contexts.select("source_id", F.lit(None).cast("string").alias("error")))


def graph_store(spark: SparkSession, d: str) -> DataFrame:
    """A cache of graphs that several writers filled at the same time: the first commit of a text's key counts, after compaction too.

    The writer of the labelled documents commits before that of all documents, which wrote first; all are
    written once more, the commits are made one, and the labelled ones come again, to no effect.
    """
    found = extract.offline_graph(extract.with_key(read(spark, d, "documents"), "text", CONFIG.extract), "text").select("doc_id", "cache_key", "entities", "relations")
    own = found.join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("entities", F.array_prepend("entities", F.lit("labelled"))).drop("doc_id")
    found = staged(found.drop("doc_id"), "graphs")
    store = extract.graph_store(spark, new_path(spark, "cache"), "documents")
    late, early = store.write(found), store.write(own)
    store.commit(early)
    store.commit(late)
    store.append(found.withColumn("entities", F.array(F.lit("again"))))
    store.compact()
    store.append(own.withColumn("entities", F.array(F.lit("again"))))
    return store.found(found.select("cache_key").distinct()).select("cache_key", F.size("relations").alias("n_relations"), _joined("entities").alias("entities"))


def chunked_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Graphs of all texts, of chunks that end with sentences where a text is longer than the bound."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    made = lambda df: extract.offline_graph(df, "text").drop("text")
    found = extract.chunked_graphs(docs, "doc_id", "text", "documents", new_path(spark, "cache"), made, CONFIG.extract).graphs
    parts = docs.select("doc_id", F.size(extract.chunks(text.strip(F.col("text")), CONFIG.extract.context_chunk_chars)).alias("n_chunks"))
    return found.join(parts, "doc_id").select("doc_id", "n_chunks", _joined("entities").alias("entities"), _triples("relations").alias("relations"))


def _counting_backend():
    """A backend that says what its calls took: a token for each word given and two for each entity, a quarter of a cent a call."""
    import re

    def generate(given: str, cluster: bool, chunk_size: int | None) -> tuple[list, list, dict]:
        words = re.findall("[a-z][a-z0-9]+", given.lower())
        if len(words) < 3:
            raise ValueError("too short")
        first = list(dict.fromkeys(words))[:12]
        return first, [], {"prompt_tokens": len(words), "completion_tokens": 2 * len(first), "cost": 0.25}

    return generate


def usage_of_calls(spark: SparkSession, d: str) -> DataFrame:
    """What extracting all documents takes: calls, tokens, cost, failures, and texts that an equal one had brought into the cache."""
    docs, config = read(spark, d, "documents"), ExtractConfig(max_retries=1, concurrency=16, calls_per_task=4)
    made = lambda df: extract.backend_graph(df, "cache_key", "text", _counting_backend, config)
    log = staged(extract.call_log([extract.cached_graphs(docs, "doc_id", "text", "documents", new_path(spark, "cache"), made, config).calls]), "log")
    last = log.agg(F.max("cum_calls").alias("last_cum_calls"), F.max("cum_cost_usd").alias("last_cum_cost_usd"))
    return extract.call_summary(log).crossJoin(F.broadcast(last))  # one row each


def prefix_in_file(spark: SparkSession, d: str) -> DataFrame:
    """The first records of JSON lines in the order of the file, which is that of a hash here."""
    folder = new_path(spark, "lines")
    jsonl.write_jsonl(read(spark, d, "documents").select("doc_id", "source").orderBy(F.md5(F.col("doc_id").cast("string"))), folder)
    return jsonl.first_in_files(jsonl.with_place(jsonl.read_jsonl(spark, folder, "doc_id bigint, source string")), 100)


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return ranking.average_precision(ranking.with_overall(_scores(spark, d), "task"), ["grp"])


QUERIES: tuple[Query, ...] = (
    fake_entities, fake_edges, graph_codec, build_instances, split_counts, ref_union, ref_triples, normalize_lines, cache_keys, cache_miss,
    eg_exact, match_cascade, substring_matches, rp_align, rp_inverse, score_rows, audit_lists, auc_by_task, auc_by_model, prf_by_task,
    ablation_auc, length_buckets, graph_stats, mann_whitney, impute_policy, degenerate, theta_f1, alpha_cv, tau_sweep, bootstrap_ci,
    embedding_nn, flag_labels, json_facts, dedupe_sources, first_instances, usage_cumsum, usage_summary, sample_n, prefix_limit,
    h_histogram, topk_claims, text_support, single_shares, skipped_responses, corpus_instances, corpus_train, corpus_scores,
    match_by_language, predicate_align, backend_graphs, tuned_alpha_theta, evaluation_summary, audit_records,
    graph_store, chunked_graphs, usage_of_calls, prefix_in_file, average_precision,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}
