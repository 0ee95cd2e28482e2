"""Near copies by Jaccard similarity against brute force, and the pipeline's stage that keeps one of each group."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from groundloom.llm import simhash


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def made():
    """Copies of 12 texts with one to eight words replaced, a larger group of near copies, and texts of few words."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(12)]
    texts += [" ".join(edited(rng, t.split(), n)) for t in texts for n in (1, 2, 3, 4, 8)]
    texts += [" ".join(edited(rng, texts[0].split(), 1)) for _ in range(40)]
    return [*texts, "", None, "two words", "Two  words", texts[3]]


def groups(texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (texts[i] or "") == (texts[j] or "") or a and b and len(a & b) >= 0.8 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_one_of_each_group_of_near_copies_stays(spark):
    texts = made()
    label = groups(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    # The fingerprints alone, at three bits, leave near copies.
    assert simhash.near_duplicates(docs).agg(F.count_distinct("component_id")).first()[0] > len(set(label))
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), "").count() == 0


def test_blocks_of_a_large_group_lose_no_link(spark):
    texts = made()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    whole = {r.node: r.component for r in simhash.similar_texts(docs).collect()}
    assert {r.node: r.component for r in simhash.similar_texts(docs, most=4, volume=300).collect()} == whole
