"""Graphs from texts: the offline extractor, pluggable backends, and the cache of graphs."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.config import ExtractConfig
from groundloom.functions.text import cache_key, strip
from groundloom.operators.prefix import running_sums
from groundloom.sources.keyed_store import KeyedStore
from groundloom.sources.staging import file_groups, new_path, staged

MAX_ENTITIES, MIN_LETTERS, LINK = 12, 4, "co_occurs_with"
#: Characters of a text that are looked through first.
BEGINNING = 512
#: What a row of a backend says of its call.
USAGE = {"seconds": "double", "calls": "bigint", "prompt_tokens": "bigint", "completion_tokens": "bigint", "cost_usd": "double"}
#: Bytes of written texts that a task which calls a backend reads, about, and rows of a file of them.
TASK_BYTES, FILE_ROWS = 128 << 20, 5_000
GRAPH = "entities array<string>, relations array<struct<s:string,r:string,o:string>>"


def tokens(text: Column) -> Column:
    """The first distinct words of a text, in order.

    Mostly they stand in its beginning; the rest is read only where they don't.
    """

    def firsts(low: Column) -> Column:
        found = F.regexp_extract_all(low, F.lit("[a-z][a-z0-9]+"), F.lit(0))
        return F.slice(F.array_distinct(F.filter(found, lambda t: F.length(t) >= MIN_LETTERS)), 1, MAX_ENTITIES)

    whole = F.coalesce(text, F.lit(""))
    # The word at the cut may go on, so it is left out.
    begun = F.regexp_replace(F.lower(F.substring(whole, 1, BEGINNING)), "[a-z0-9]+$", "")
    tried = F.transform(F.array(firsts(begun)), lambda x: F.when(F.size(x) == MAX_ENTITIES, x).otherwise(firsts(F.lower(whole))))
    return F.element_at(tried, 1)


def links(entities: Column) -> Column:
    """Each entity linked to the next."""
    n = F.size(entities)
    pairs = F.zip_with(F.slice(entities, F.lit(1), n - 1), F.slice(entities, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("s"), F.lit(LINK).alias("r"), b.alias("o")))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<s:string,r:string,o:string>>"))


def offline_graph(df: DataFrame, text_col: str, phrases: bool = False) -> DataFrame:
    """df with entities and relations of a text; phrases adds the pairs of linked words as entities."""
    found = df.withColumn("entities", tokens(F.col(text_col))).withColumn("relations", links(F.col("entities")))
    if not phrases:
        return found
    return found.withColumn("entities", F.array_distinct(F.concat("entities", F.transform("relations", lambda e: F.concat_ws(" ", e["s"], e["o"])))))


class Pace:
    """At most one call each `interval` seconds, by the threads of a task."""

    def __init__(self, interval: float) -> None:
        self._interval, self._next, self._lock = interval, 0.0, threading.Lock()

    def wait(self) -> None:
        if self._interval:
            with self._lock:
                at = max(self._next, time.monotonic())
                self._next = at + self._interval
            time.sleep(max(0.0, at - time.monotonic()))


def waits(config: ExtractConfig) -> list[float]:
    """Seconds before each repeated call: the multiplier, doubled from call to call."""
    return [config.backoff_multiplier * 2.0**k for k in range(config.max_retries - 1)]


def backend_graph(df: DataFrame, key: str, text_col: str, load: Callable[[], Callable], config: ExtractConfig) -> DataFrame:
    """key, entities, relations and error of each text by a backend `generate(text, cluster, chunk_size)`, and what the call took.

    generate returns entities and relations, and may return a mapping with prompt_tokens, completion_tokens and
    cost besides. A failing call is tried again after growing waits, and its error kept in the row; an empty
    text makes no call. Relations that are no triples are dropped.

    `concurrency` calls are under way in the cluster, `calls_per_task` of them in each task, which keeps the
    order of its rows; each task takes its share of `calls_per_second`. A task that is run again makes its calls
    again, but leaves its rows, and so its usage, once. More texts than so many tasks should read are called for in
    rounds, one after the other, so that a task's share is bounded and the number of calls under way stays.
    """
    tasks = max(1, -(-config.concurrency // config.calls_per_task))
    interval = tasks / config.calls_per_second if config.calls_per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate, pace = load(), Pace(interval)

        def call(text: str | None) -> dict:
            row = {"entities": [], "relations": [], "error": None, "seconds": 0.0, "calls": 0, "prompt_tokens": 0, "completion_tokens": 0, "cost_usd": 0.0}
            if not (text or "").strip():
                return row
            size, began = config.context_chunk_chars if len(text) > config.context_chunk_chars else None, time.monotonic()
            for wait in [*waits(config), None]:
                pace.wait()
                row["calls"] += 1
                try:
                    entities, relations, *usage = generate(text, config.cluster, size)
                except Exception as e:
                    row["error"] = repr(e)
                    if wait is not None:
                        time.sleep(wait)
                    continue
                triples = sorted({tuple(map(str, t)) for t in relations if len(t) == 3})
                row |= {"entities": sorted({str(e) for e in entities}), "relations": [dict(zip("sro", t, strict=True)) for t in triples], "error": None}
                if usage and usage[0]:
                    row |= {"prompt_tokens": int(usage[0].get("prompt_tokens", 0)), "completion_tokens": int(usage[0].get("completion_tokens", 0)), "cost_usd": float(usage[0].get("cost", 0.0))}
                break
            row["seconds"] = time.monotonic() - began
            return row

        def in_order(pool: ThreadPoolExecutor) -> Iterator[dict]:
            held: deque = deque()
            for batch in batches:
                for k, text in zip(batch[key], batch["text"], strict=True):
                    held.append((k, pool.submit(call, text)))
                    if len(held) >= 4 * config.calls_per_task:  # more wait in line, so that one slow call doesn't hold the others up
                        k, done = held.popleft()
                        yield {key: k, **done.result()}
            for k, done in held:
                yield {key: k, **done.result()}

        with ThreadPoolExecutor(config.calls_per_task) as pool:
            rows = in_order(pool)
            while some := list(islice(rows, 500)):
                yield pd.DataFrame(some, columns=[key, "entities", "relations", "error", *USAGE])

    kind = df.schema[key].dataType.simpleString()
    given = staged(df.select(key, F.col(text_col).alias("text")), "texts", FILE_ROWS)
    made = lambda texts: texts.repartition(tasks).mapInPandas(run, f"`{key}` {kind}, {GRAPH}, error string, {', '.join(f'{c} {t}' for c, t in USAGE.items())}")
    rounds = file_groups(given, tasks * TASK_BYTES)
    if len(rounds) < 2:
        return made(given)
    spark, place = df.sparkSession, new_path(df.sparkSession, "calls")
    for files in rounds:
        made(spark.read.schema(given.schema).parquet(*files)).write.mode("append").parquet(place)
    return spark.read.schema(made(given).schema).parquet(place)


def extraction_params(config: ExtractConfig) -> dict:
    return {"model": config.model, "temperature": config.temperature, "cluster": config.cluster, "chunk_chars": config.context_chunk_chars, "v": 1}


def with_key(df: DataFrame, text_col: str, config: ExtractConfig) -> DataFrame:
    return df.withColumn("cache_key", cache_key(strip(F.col(text_col)), extraction_params(config)))


#: Columns of a log of calls.
CALLS = f"kind string, cache_key string, seq bigint, cached boolean, failed boolean, {', '.join(f'{c} {t}' for c, t in USAGE.items())}, cum_calls bigint, cum_prompt_tokens bigint, cum_completion_tokens bigint, cum_cost_usd double"


class Extracted(NamedTuple):
    graphs: DataFrame
    """key, entities, relations and error of each text."""
    calls: DataFrame
    """kind, cache_key, cached and usage of each text that isn't blank, in the order of `seq`."""


def graph_store(spark: SparkSession, cache: str, kind: str) -> KeyedStore:
    return KeyedStore(spark, f"{cache.rstrip('/')}/{kind}", "cache_key", GRAPH)


def cached_graphs(texts: DataFrame, key: str, text_col: str, kind: str, cache: str, extract: Callable[[DataFrame], DataFrame], config: ExtractConfig) -> Extracted:
    """The graph of each text, from the cache, or extracted and added to it, with what that took.

    The cache is a store of graphs by the key of their text, apart for each kind of text. `extract` gets
    cache_key and text of what it lacks, each once, and returns cache_key, entities, relations and maybe error
    and usage; graphs with an error aren't kept, so a later run tries them again.
    """
    spark = texts.sparkSession
    store = graph_store(spark, cache, kind)
    keyed = staged(with_key(texts.select(key, F.col(text_col).alias("text")), "text", config), f"{kind}-texts")
    keys = keyed.select("cache_key", "text")
    made = extract(store.misses(keys).select("cache_key", "text"))
    lacking = {"error": "string", **USAGE}
    made = made.withColumns({c: F.lit(None).cast(t) for c, t in lacking.items() if c not in made.columns})
    made = staged(made.select("cache_key", "entities", "relations", *lacking), f"{kind}-made")
    good = made.where("error IS NULL").select("cache_key", "entities", "relations")
    if not good.isEmpty():
        store.append(good)
    # All graphs are read from the store, so runs that extracted one text at the same time go on with one graph of it.
    held = staged(store.found(keys.select("cache_key").distinct()), f"{kind}-held")
    bad = made.where("error IS NOT NULL").join(held.select("cache_key"), "cache_key", "left_anti").drop(*USAGE)
    found = held.withColumn("error", F.lit(None).cast("string")).unionByName(bad)
    graphs = staged(keyed.select(key, "cache_key").join(found, "cache_key").drop("cache_key"), f"{kind}-graphs")
    calls = staged(_calls_of(keyed, made, kind), f"{kind}-calls")
    return Extracted(graphs, calls)


def _calls_of(keyed: DataFrame, made: DataFrame, kind: str) -> DataFrame:
    """A row for each text: the first of a key that was extracted made the call, all others found it in the cache."""
    rows = keyed.where(strip(F.coalesce("text", F.lit(""))) != "").select("cache_key", F.monotonically_increasing_id().alias("seq"))
    first = rows.groupBy("cache_key").agg(F.min("seq").alias("seq"))
    own = first.join(made.select("cache_key", F.lit(True).alias("own"), F.col("error").isNotNull().alias("failed"), *USAGE), "cache_key")
    found = rows.join(own, ["cache_key", "seq"], "left")
    no = F.lit(False)
    return found.select(F.lit(kind).alias("kind"), "cache_key", "seq", F.coalesce(~F.col("own"), ~no).alias("cached"), F.coalesce("failed", no).alias("failed"), *(F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in USAGE.items()))


def call_log(kinds: list[DataFrame]) -> DataFrame:
    """The calls of some kinds of text, one kind after the other, with running totals; calls that failed and texts found in the cache add none."""
    each = [df.withColumn("seq", F.col("seq") + F.lit(k << 58)) for k, df in enumerate(kinds)]
    all_calls = each[0]
    for df in each[1:]:
        all_calls = all_calls.unionByName(df)
    totals = {"prompt_tokens": "cum_prompt_tokens", "completion_tokens": "cum_completion_tokens", "cost_usd": "cum_cost_usd"}
    paid = all_calls.withColumn("__paid", (~F.col("cached") & ~F.col("failed")).cast("bigint"))
    return running_sums(paid, "seq", {"__paid": "cum_calls", **totals}).drop("__paid")


def call_summary(calls: DataFrame) -> DataFrame:
    """One row: calls that gave a graph, their cost and tokens, all attempts, failures, and texts found in the cache."""
    count = lambda c: F.count_if(c)
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero))
    return calls.agg(
        count(~F.col("cached") & ~F.col("failed")).alias("api_calls"), total("cost_usd", 0.0).alias("estimated_cost_usd"), total("prompt_tokens", 0).alias("prompt_tokens"),
        total("completion_tokens", 0).alias("completion_tokens"), total("calls", 0).alias("attempts"), count("failed").alias("failed"), count("cached").alias("cache_hits"),
    )


SENTENCE = r"[^.!?]*[.!?]+\s*|[^.!?]+"


def chunks(text: Column, size: int) -> Column:
    """The text cut at ends of sentences into parts of at most `size` characters; a longer sentence is cut where it must be.

    Sentences are laid into a part as long as it holds them. Null and empty texts have no part.
    """
    sentences = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))
    pieces = F.flatten(F.transform(F.filter(sentences, lambda s: s != ""), lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda k: F.substr(s, k * size + 1, F.lit(size)))))

    def laid(done: Column, piece: Column) -> Column:
        fits = F.length(done["part"]) + F.length(piece) <= size
        return F.when(fits, F.struct(done["parts"].alias("parts"), F.concat(done["part"], piece).alias("part"))).otherwise(
            F.struct(F.array_append(done["parts"], done["part"]).alias("parts"), piece.alias("part"))
        )

    none = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("part"))
    return F.aggregate(pieces, none, laid, lambda done: F.filter(F.array_append(done["parts"], done["part"]), lambda p: p != ""))


def chunked_graphs(texts: DataFrame, key: str, text_col: str, kind: str, cache: str, extract: Callable[[DataFrame], DataFrame], config: ExtractConfig) -> Extracted:
    """As cached_graphs, with a graph for each chunk of a text: its entities and relations are those of its chunks.

    Chunks are cached one by one, so a run that broke off asks only for those it lacks. A text with a chunk that
    failed has that error and no graph. Keys are distinct.
    """
    given = staged(texts.select(F.col(key).alias("of"), F.posexplode_outer(chunks(strip(F.col(text_col)), config.context_chunk_chars)).alias("chunk", "text")), f"{kind}-chunks")
    parts = given.select(F.struct("of", "chunk").alias("part"), "text")
    graphs, calls = cached_graphs(parts, "part", "text", kind, cache, extract, config)
    names = graphs.select("part.of", F.explode_outer("entities").alias("e")).groupBy("of").agg(F.sort_array(F.collect_set("e")).alias("entities"))
    links_ = graphs.select("part.of", F.explode_outer("relations").alias("r")).groupBy("of").agg(F.sort_array(F.collect_set("r")).alias("relations"))
    errors = graphs.groupBy("part.of").agg(F.min("error").alias("error"))
    whole = names.join(links_, "of").join(errors, "of")
    failed = F.col("error").isNotNull()
    empty = lambda c: F.when(failed, F.array().cast(whole.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return Extracted(staged(whole.select(F.col("of").alias(key), empty("entities"), empty("relations"), "error"), f"{kind}-graphs"), calls)


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys and texts that the cache has no graph of."""
    return wanted.dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")


def graph_json(entities: Column, relations: Column) -> Column:
    return F.to_json(F.struct(F.sort_array(entities).alias("entities"), F.transform(F.sort_array(relations), lambda e: F.array(e["s"], e["r"], e["o"])).alias("relations")))


def graph_from_json(x: Column) -> Column:
    """struct(entities, relations); relations that aren't triples are dropped."""
    raw = F.from_json(x, "entities array<string>, relations array<array<string>>")
    triples = F.transform(F.filter(raw["relations"], lambda t: F.size(t) == 3), lambda t: F.struct(t[0].alias("s"), t[1].alias("r"), t[2].alias("o")))
    return F.struct(raw["entities"].alias("entities"), triples.alias("relations"))


def usage_log(calls: DataFrame, order: str) -> DataFrame:
    """calls (order, cached, cost_cents) with the running number of calls that weren't cached and their cost."""
    paid = calls.withColumns({"__calls": F.when(F.col("cached"), 0).otherwise(1).cast("bigint"), "__cost": F.when(F.col("cached"), 0).otherwise(F.col("cost_cents")).cast("bigint")})
    return running_sums(paid, order, {"__calls": "cum_calls", "__cost": "cum_cost_cents"}).drop("__calls", "__cost")


def usage_summary(calls: DataFrame) -> DataFrame:
    """The number of calls (cached, cost_cents) that weren't cached and their cost, as one row."""
    paid = calls.where(~F.col("cached"))
    return paid.agg(F.count(F.lit(1)).alias("api_calls"), F.coalesce(F.sum(F.col("cost_cents").cast("bigint")), F.lit(0)).alias("cost_cents"))
