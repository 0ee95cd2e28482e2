"""Matching of an answer's graph with the graph of its source.

Names are compared within a source only: exactly, then as whole words of one another, then by vectors. Each
stage sees what the one before left over, and each distinct name of a source is matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.config import MatchConfig
from groundloom.functions.text import WORD, contains_words, normalize, word_runs
from groundloom.functions.vectors import Embedder, measured, measured_cosine
from groundloom.operators.near import near_pairs, nearest
from groundloom.sources.staging import staged, staged_pair

#: Rows of a block where all rows of a group are compared.
BLOCK = 1024


def union_entities(*graphs: DataFrame) -> DataFrame:
    """Distinct normalized entities (source_id, w) of graphs with source_id and entities."""
    # A filter is pushed below a column, which is then made twice, but not below an outer generator.
    each = [g.select("source_id", F.explode_outer(F.transform("entities", normalize)).alias("w")) for g in graphs]
    return _union(each).where(F.col("w") != "").distinct()


def union_relations(*graphs: DataFrame) -> DataFrame:
    """Distinct normalized triples (source_id, s2, r2, o2); all three parts must be left."""
    named = lambda e: F.struct(*(normalize(e[c]).alias(f"{c}2") for c in "sro"))
    each = [g.select("source_id", F.explode_outer(F.transform("relations", named)).alias("e")).select("source_id", "e.*") for g in graphs]
    return _union(each).where((F.col("s2") != "") & (F.col("r2") != "") & (F.col("o2") != "")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _guarded(shorter: Column, config: MatchConfig) -> Column:
    return (F.length(shorter) >= config.min_substring_chars) & ~shorter.isin(*config.stopwords)


def part_of(v: Column, w: Column, config: MatchConfig) -> Column:
    """Whether the shorter of two names, if long enough and no stopword, stands in the other as whole words."""
    first = F.length(v) <= F.length(w)
    shorter, longer = F.when(first, v).otherwise(w), F.when(first, w).otherwise(v)
    return _guarded(shorter, config) & contains_words(longer, shorter)


def with_vectors(df: DataFrame, names: list[str], embed: Embedder | None) -> DataFrame:
    """df with vec_<name>, the vector of each name and its squared length: made once a row, before rows are paired."""
    if not embed:
        return df
    return df.withColumns({f"vec_{c}": measured(embed(F.col(c))) for c in names})


def substring_pairs(names: DataFrame, refs: DataFrame, config: MatchConfig) -> DataFrame:
    """(source_id, v, w) of names in one another.

    Where one stands in the other as whole words, the first word of the shorter is a word of the longer: an
    equality by which the join finds its candidates. Names without any word are compared within the source.
    """

    v, w = names.select("source_id", "v"), refs.select("source_id", "w")
    firsts = [x.where(F.rlike(c, F.lit(WORD))).select("source_id", c, F.regexp_extract(c, WORD, 0).alias("word")) for x, c in ((v, "v"), (w, "w"))]
    all_words = [x.select("source_id", c, F.explode_outer(F.array_distinct(word_runs(F.col(c)))).alias("word")).where("word IS NOT NULL") for x, c in ((v, "v"), (w, "w"))]
    by_word = firsts[0].join(all_words[1], ["source_id", "word"]).unionByName(all_words[0].join(firsts[1], ["source_id", "word"]))
    pairs, bare = by_word.drop("word"), [x.where(~F.rlike(c, F.lit(WORD))) for x, c in ((v, "v"), (w, "w"))]
    # Mostly there are none; then the other side is not dealt into blocks.
    for few, sides in ((bare[0], (bare[0], w)), (bare[1], (v, bare[1]))):
        if not few.isEmpty():
            pairs = pairs.unionByName(in_blocks(*sides, ["source_id"], ["v"], ["w"]))
    return pairs.where((F.col("v") != F.col("w")) & part_of(F.col("v"), F.col("w"), config)).distinct()


def match_entities(names: DataFrame, refs: DataFrame, config: MatchConfig, embed: Embedder | None = None) -> DataFrame:
    """(source_id, v, ref, method) of the names (source_id, v) that match a reference (source_id, w).

    Of several matches of one method the smallest reference stands; of vectors the nearest.
    """
    names = names.where(F.col("v") != "").distinct()
    if config.allow_substring_match or embed:
        # Each way of matching reads both sides, their words and the sizes of their groups.
        names, refs = staged_pair(names.select("source_id", "v"), refs.select("source_id", "w"), "names")
    exact = names.join(refs.withColumn("v", F.col("w")), ["source_id", "v"]).select("source_id", "v", F.col("w").alias("ref"), F.lit("exact").alias("method"))
    found, rest = exact, names.join(refs.withColumnRenamed("w", "v"), ["source_id", "v"], "left_anti")
    if config.allow_substring_match:
        part = staged(substring_pairs(rest, refs, config).groupBy("source_id", "v").agg(F.min("w").alias("ref")), "parts")
        found = found.unionByName(part.withColumn("method", F.lit("substring")))
        rest = rest.join(part, ["source_id", "v"], "left_anti")
    if embed:
        rest = staged(rest, "unmatched")
        near = nearest(with_vectors(rest, ["v"], embed), with_vectors(refs, ["w"], embed), ["source_id"], "v", "w", config.entity_sim_threshold)
        found = found.unionByName(near.select("source_id", "v", F.col("w").alias("ref"), F.lit("embedding").alias("method")))
    return found


def in_blocks(left: DataFrame, right: DataFrame, group: list[str], l_key: list[str], r_key: list[str], block: int = BLOCK) -> DataFrame:
    """The pairs of rows of one group, both sides dealt by a hash of their keys into blocks of about `block` rows.

    Each pair of blocks is a join key of its own, so a large group is spread over many tasks, and none of them
    holds more than two blocks.
    """
    count = lambda df, n: df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).alias(n))
    sizes = count(left, "__nl").join(count(right, "__nr"), group)

    def dealt(df: DataFrame, key: list[str], own: str, other: str) -> DataFrame:
        placed = df.join(sizes, group).withColumn(f"__{own}", F.pmod(F.xxhash64(*key), F.col(f"__n{own}")))
        return placed.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"__n{other}") - 1))).drop("__nl", "__nr")

    return dealt(left, l_key, "l", "r").join(dealt(right, r_key, "r", "l"), [*group, "__l", "__r"]).drop("__l", "__r")


def matching_pairs(left: DataFrame, right: DataFrame, l_name: str, r_name: str, config: MatchConfig, embed: Embedder | None, least: float | None = None) -> DataFrame:
    """source_id, l_name, r_name, strength of all pairs of names (source_id and the name, distinct) that match.

    The strength is the cosine where only vectors match, at `least` or more (the threshold of entities by
    default), and 2 where the names are equal or parts of one another.
    """
    sides = left.select("source_id", F.col(l_name).alias("v")), right.select("source_id", F.col(r_name).alias("w"))
    plain = sides[0].join(sides[1].withColumn("v", F.col("w")), ["source_id", "v"])
    if config.allow_substring_match:
        plain = plain.unionByName(substring_pairs(*sides, config))
    out = plain.withColumn("strength", F.lit(2.0))
    if embed:
        vectors = with_vectors(sides[0], ["v"], embed), with_vectors(sides[1], ["w"], embed)
        near = near_pairs(*vectors, ["source_id"], ["v"], ["w"], "vec_v", "vec_w", config.entity_sim_threshold if least is None else least)
        out = out.unionByName(near.select("source_id", "v", "w", F.col("cos").alias("strength"))).groupBy("source_id", "v", "w").agg(F.max("strength").alias("strength"))
    return out.withColumnsRenamed({"v": l_name, "w": r_name})


#: Pairs of predicates that agree up to which they are handed to every task.
FEW = 50_000


def agreeing(met: DataFrame, least: float, embed: Embedder | None) -> DataFrame:
    """The pairs of triples (with columns r and r2) whose predicates agree, with `rel`: 2 if they are equal, else their cosine.

    Only predicates of triples that met are compared, each pair once, so that no row is made for the other pairs of
    a corpus's predicates.
    """
    same, other = met.where(F.col("r") == F.col("r2")).withColumn("rel", F.lit(2.0)), met.where(F.col("r") != F.col("r2"))
    if not embed or other.isEmpty():
        return same
    pairs = staged(other.select("r", "r2").distinct(), "predicate-pairs")
    vectors = staged(with_vectors(pairs.select(F.explode(F.array("r", "r2")).alias("r")).distinct(), ["r"], embed), "predicates")
    told = pairs.join(vectors, "r").join(vectors.select(F.col("r").alias("r2"), F.col("vec_r").alias("vec_r2")), "r2")
    cosines = staged(told.select("r", "r2", measured_cosine(F.col("vec_r"), F.col("vec_r2")).alias("rel")), "agreed")
    agreed = cosines.where((F.col("rel") >= least) & ~F.isnan("rel"))
    return same.unionByName(other.join(F.broadcast(agreed) if agreed.count() <= FEW else agreed, ["r", "r2"]))


def triple_pairs(triples: DataFrame, ref_triples: DataFrame, config: MatchConfig, embed: Embedder | None, ends_least: float | None = None, rel_least: float | None = None, inverse: bool = False) -> DataFrame:
    """Pairs of triples (source_id, s, r, o, s2, r2, o2) whose ends match and whose predicates agree, with `ends`, the weaker end's
    strength, `rel`, and `inverse`: whether the reference's ends are the other way round. Those are looked for only if asked.

    Ends are matched name by name first, so triples meet by equal names only, and a predicate that all triples
    share costs nothing.
    """
    triples, ref_triples = staged_pair(triples.select("source_id", *"sro").distinct(), ref_triples.select("source_id", "s2", "r2", "o2"), "triples")
    ends = lambda df, names: df.select("source_id", F.explode(F.array(*names)).alias("end")).distinct()
    sides = staged_pair(ends(triples, "so").withColumnRenamed("end", "v"), ends(ref_triples, ["s2", "o2"]).withColumnRenamed("end", "w"), "ends")
    matched = staged(matching_pairs(*sides, "v", "w", config, embed, ends_least), "matched-ends")
    side = lambda v, w, name: matched.select("source_id", F.col("v").alias(v), F.col("w").alias(w), F.col("strength").alias(name))

    def paired(a: str, b: str) -> DataFrame:
        first = triples.join(side("s", a, "first"), ["source_id", "s"]).join(ref_triples, ["source_id", a])
        both = first.join(side("o", b, "second"), ["source_id", "o", b])
        return both.select("source_id", *"sro", "s2", "r2", "o2", F.least("first", "second").alias("ends"), F.lit(a == "o2").alias("inverse"))

    met = paired("s2", "o2")
    if inverse:
        met = met.unionByName(paired("o2", "s2"))
    return agreeing(staged(met, "meetings"), config.relation_sim_threshold if rel_least is None else rel_least, embed)


def align_relations(triples: DataFrame, ref_triples: DataFrame, matched: DataFrame, config: MatchConfig, embed: Embedder | None = None) -> DataFrame:
    """(source_id, s, r, o, s2, r2, o2, method) of the normalized triples that a reference triple supports.

    Both ends must match some reference entity (by their name normalized again), the predicates agree, and
    the ends match the triple's own, in its direction or, if allowed, the other.
    """
    ends = matched.select("source_id", F.col("v"))
    open_triples = triples.where((F.col("s") != "") & (F.col("o") != "")).distinct()
    open_triples = open_triples.withColumns({"s_again": normalize(F.col("s")), "o_again": normalize(F.col("o"))})
    for c in ("s_again", "o_again"):
        open_triples = open_triples.join(ends.withColumnRenamed("v", c), ["source_id", c], "left_semi")
    found = triple_pairs(open_triples, ref_triples, config, embed, inverse=config.inverse_edge_match or not config.direction_sensitive_edges)
    found = found.withColumn("method", F.when(F.col("inverse"), "inverse").otherwise("forward"))
    # Of one reference triple both ways round, the forward one stands: it sorts first.
    first = F.min(F.struct("s2", "r2", "o2", "method")).alias("x")
    return found.groupBy("source_id", "s", "r", "o").agg(first).select("source_id", "s", "r", "o", "x.*")
