"""The store of graphs by key: writers at the same time, readers, compaction, cleaning, and what is read of it."""

import glob
import re

import pytest

from groundloom.config import ExtractConfig
from groundloom.operators import extract
from groundloom.sources.keyed_store import KeyedStore


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), "k", "v string")


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v string")


def held(store, prefixes=None):
    return sorted((r.k, r.v) for r in store.read(prefixes).collect())


def test_two_writers_at_once_leave_one_row_a_key(spark, store):
    assert held(store) == [] and store.misses(frame(spark, [("aa1", "x")])).count() == 1
    first = store.write(frame(spark, [("aa1", "first"), ("bb1", "first")]))
    second = store.write(frame(spark, [("aa1", "second"), ("cc1", "second"), (None, "no key")]))
    assert held(store) == []  # nothing is seen before its commit
    assert store.commit(second) == 1 and store.commit(first) == 2
    assert held(store) == [("aa1", "second"), ("bb1", "first"), ("cc1", "second")]
    # A commit whose number is taken meanwhile takes the next one.
    taken = store.commits
    late = KeyedStore(spark, store.root, "k", "v string")
    late.commits = lambda: taken()[:1]
    assert late.commit(late.write(frame(spark, [("aa1", "third"), ("dd1", "third")]))) == 3
    assert held(store) == [("aa1", "second"), ("bb1", "first"), ("cc1", "second"), ("dd1", "third")]


def test_compaction_beside_another_writer(spark, store):
    for k in range(3):
        store.append(frame(spark, [("aa", f"v{k}"), (f"b{k}", f"v{k}")]))
    before = held(store)
    found, live = store.commits(), store.live()
    batch = store.write(store.read())
    store.append(frame(spark, [("aa", "late"), ("cc", "late")]))  # while the compaction writes
    store.commit(batch, max(k for k, *_ in found))
    assert len(live) == 3 and len(store.live()) == 2 and held(store) == before + [("cc", "late")]
    assert store.compact() is not None and len(store.live()) == 1 and store.compact() is None
    lost = store.write(frame(spark, [("zz", "never committed")]))
    assert store.clean() == 0 and store.clean(older_than_s=0) == 6
    assert glob.glob(f"{store.root}/data/batch=*") == [f"{store.root}/data/batch={store.live()[0][1]}"] and lost not in str(store.commits())
    assert held(store) == before + [("cc", "late")] and len(store.commits()) == 1
    store.append(frame(spark, [("dd", "next")]))
    assert held(store)[-1] == ("dd", "next")


def test_only_the_folders_of_needed_prefixes_are_read(spark, store):
    store.append(frame(spark, [(f"{k}{'0' * 6}", "v") for k in ("0a", "0b", "3f", "99", "c0", "ff")]))
    wanted = frame(spark, [("0a000000", "w"), ("0a111111", "w"), ("ff111111", "w")])
    missing = store.misses(wanted)
    assert sorted(r.k for r in missing.collect()) == ["0a111111", "ff111111"]
    plan = missing._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*prefix[^\]]*IN \(0,f\)", plan) and "ReadSchema: struct<k:string>" in plan
    assert held(store, store.prefixes_of(wanted)) == [("0a000000", "v"), ("0b000000", "v"), ("ff000000", "v")]


def test_a_damaged_file_counts_as_lacking(spark, store):
    store.append(frame(spark, [("aa1", "v"), ("bb1", "v")]))
    (path,) = glob.glob(f"{store.root}/data/*/prefix=a/*.parquet")
    with open(path, "wb") as f:
        f.write(b"no parquet")
    assert [r.k for r in store.misses(frame(spark, [("aa1", "w"), ("bb1", "w")])).collect()] == ["aa1"]


def test_texts_that_two_runs_extract_at_once_have_one_graph(spark, tmp_path):
    texts = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "one two three"), (4, " ")], "id int, text string")

    def extractor(name):
        def run(df):
            if name == "outer":  # another run extracts and commits the same texts meanwhile
                extract.cached_graphs(texts, "id", "text", "t", str(tmp_path), extractor("inner"), ExtractConfig())
            return df.selectExpr("cache_key", f"array('{name}') AS entities", "CAST(array() AS array<struct<s:string,r:string,o:string>>) AS relations")

        return run

    own = extract.cached_graphs(texts, "id", "text", "t", str(tmp_path), extractor("outer"), ExtractConfig())
    assert own.graphs.count() == 4
    again = extract.cached_graphs(texts, "id", "text", "t", str(tmp_path), extractor("never"), ExtractConfig())
    assert sorted((r.id, r.entities) for r in again.graphs.collect()) == [(k, ["inner"]) for k in (1, 2, 3, 4)]
    assert (own.calls.where("NOT cached").count(), own.calls.where("cached").count(), again.calls.where("cached").count()) == (2, 1, 3)
