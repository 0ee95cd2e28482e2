import pytest
from pyspark.sql import functions as F

from groundloom.config import MatchConfig
from groundloom.functions.metrics import cfi
from groundloom.functions.text import normalize
from groundloom.functions.vectors import letter_counts
from groundloom.operators import matching, scoring

GRAPH = "source_id string, entities array<string>, relations array<struct<s:string,r:string,o:string>>"
CONFIG = MatchConfig(stopwords=("it", "the", "a", "is", "of"))


def graph(spark, entities, relations=()):
    return spark.createDataFrame([("1", list(entities), [tuple(r) for r in relations])], GRAPH)


def matched(spark, refs, name, config=CONFIG, embed=None):
    names = spark.createDataFrame([("1", name)], "source_id string, raw string").select("source_id", normalize(F.col("raw")).alias("v"))
    rows = matching.match_entities(names, matching.union_entities(graph(spark, refs)), config, embed).collect()
    return (rows[0].ref, rows[0].method) if rows else None


@pytest.mark.parametrize(
    "given, expected",
    [("  The Cat.  ", "cat"), ("'Paris'", "paris"), ("Westfield Properties, LLC", "westfield properties, llc"), ("A dog", "dog"), ("king of the hill", "king of the hill"), ("new    york\tcity", "new york city"), (None, "")],
)
def test_normalize(spark, given, expected):
    assert spark.createDataFrame([(given,)], "x string").select(normalize(F.col("x"))).first()[0] == expected


def test_entities_match_exactly_then_as_words(spark):
    assert matched(spark, ["Paris", "France"], "paris") == ("paris", "exact")
    assert matched(spark, ["Paris", "France"], "berlin") is None
    assert matched(spark, ["Westfield Properties"], "Westfield Properties LLC") == ("westfield properties", "substring")
    assert matched(spark, ["it is the law"], "it") is None
    assert matched(spark, ["ab cdef"], "ab", MatchConfig(min_substring_chars=3, stopwords=("x",))) is None
    assert matched(spark, ["ab cdef"], "ab", MatchConfig(stopwords=("x",))) == ("ab cdef", "substring")
    assert matched(spark, ["category"], "cat") is None
    assert matched(spark, ["über alles"], "ber") is None


def test_entities_match_by_vectors(spark):
    same = lambda x: F.when(x.isin("nyc", "new york city"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    assert matched(spark, ["nyc"], "new york city", embed=same) == ("nyc", "embedding")
    assert matched(spark, ["dog"], "nyc", embed=same) is None


@pytest.mark.parametrize("inverse, expected", [(False, []), (True, ["inverse"])])
def test_swapped_triples_need_the_inverse_option(spark, inverse, expected):
    refs = graph(spark, ["France", "Paris"], [("France", "has capital", "Paris")])
    config = MatchConfig(inverse_edge_match=inverse)
    found = matching.match_entities(spark.createDataFrame([("1", "paris"), ("1", "france")], "source_id string, v string"), matching.union_entities(refs), config)
    align = lambda s, o: [r.method for r in matching.align_relations(spark.createDataFrame([("1", s, "has capital", o)], "source_id string, s string, r string, o string"), matching.union_relations(refs), found, config).collect()]
    assert align("france", "paris") == ["forward"]
    assert align("paris", "france") == expected


def scores(spark, answer, relations, refs, ref_relations=()):
    given = graph(spark, answer, relations).withColumn("response_id", F.lit("r"))
    return scoring.score(given, graph(spark, refs, ref_relations), graph(spark, []), MatchConfig()).first()


def test_scores(spark):
    row = scores(spark, ["paris", "france", "berlin"], [("france", "has capital", "paris")], ["france", "paris", "europe"], [("france", "has capital", "paris")])
    assert (row.EG, row.RP, row.ungrounded_entities) == (2 / 3, 1.0, ["berlin"])
    row = scores(spark, ["berlin", "france"], [("berlin", "is in", "france")], ["france"])
    assert row.RP == 0 and [tuple(t) for t in row.unsupported_relations] == [("berlin", "is in", "france")]
    row = scores(spark, ["paris"], [], ["paris"])
    assert (row.EG, row.RP, row.RP_defined) == (1.0, None, False)
    row = scores(spark, [], [], ["paris"])
    assert row.unscorable and row.EG is None
    row = scores(spark, ["paris"], [], [])
    assert row.ref_empty and row.EG == 0


def test_cfi(spark):
    one = spark.range(1).select(cfi(F.lit(0.5), F.lit(1.0), 0.7).alias("a"), cfi(F.lit(0.8), F.lit(None).cast("double"), 0.7).alias("b")).first()
    assert one.a == pytest.approx(0.65) and one.b == 0.8


def test_only_predicates_of_triples_that_met_are_compared(spark, monkeypatch):
    met, plain = {}, matching.staged
    monkeypatch.setattr(matching, "staged", lambda df, name: met.setdefault(name, plain(df, name)))
    triples = spark.createDataFrame([("1", "paris", "capital of", "france"), *(("2", f"x{k}", f"seen in {k}", f"y{k}") for k in range(30))], "source_id string, s string, r string, o string")
    refs = spark.createDataFrame([("1", "paris", "capitals of", "france"), ("1", "paris", "zz", "france"), *(("2", f"v{k}q", f"seen at {k}", f"w{k}q") for k in range(30))], "source_id string, s2 string, r2 string, o2 string")
    ends = triples.select("source_id", F.explode(F.array("s", "o")).alias("v"))
    found = matching.align_relations(triples, refs, ends, MatchConfig(), letter_counts).collect()
    assert [(r.source_id, r.r2, r.method) for r in found] == [("1", "capitals of", "forward")]
    assert sorted((r.r, r.r2) for r in met["predicate-pairs"].collect()) == [("capital of", "capitals of"), ("capital of", "zz")]


def test_a_name_is_normalized_once(spark):
    names = matching.union_entities(graph(spark, ["Paris", "..", "The  Cat"], [("a", "b", "..")]))
    triples = matching.union_relations(graph(spark, ["Paris"], [("a", "b", ".."), ("Paris", "is", "It")]))
    assert sorted(r.w for r in names.collect()) == ["cat", "paris"] and [(r.s2, r.r2, r.o2) for r in triples.collect()] == [("paris", "is", "it")]
    for df in (names, triples):
        filters = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
        assert filters and not any("regexp_replace" in line for line in filters)
