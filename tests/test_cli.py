"""The command line end to end: risks at the tuned alpha, failures, the cache, limits and odd train splits."""

import csv
import glob
import json

import pytest

from groundloom.config import load_config
from groundloom.plans import cli
from groundloom.sources import jsonl


def corpus(path, splits=("train", "test")):
    sources = [{"source_id": str(k), "task_type": "Summary", "source_info": f"paris castle river number{k} garden"} for k in range(8)]
    texts = ("paris castle river", "paris dragon volcano castle")
    answers = [{"id": f"{k}{y}", "source_id": str(k), "model": "m", "split": splits[k // 4], "response": texts[y], "labels": [{"label_type": "T"}] * y} for k in range(8) for y in (0, 1)]
    for name, rows in (("source_info", sources), ("response", answers)):
        (path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))


def run(path, *more, config="evaluate: {bootstrap_replicates: 20, alpha: 0.0}\n"):
    (path / "c.yaml").write_text(config)
    cli.main(["--data-dir", str(path), "--output-dir", str(path / "out"), "--config", str(path / "c.yaml"), *more])


def rows(path):
    return [r for f in glob.glob(f"{path}/part-*.csv") for r in csv.DictReader(open(f))]


def test_risks_are_those_of_the_tuned_alpha(spark, tmp_path):
    corpus(tmp_path)
    run(tmp_path)
    # paris>dragon, dragon>volcano and volcano>castle: none holds; with alpha 0 the risk is 1 - RP alone.
    found = {r["response_id"]: r for r in rows(tmp_path / "out/metrics")}
    assert float(found["11"]["H"]) == 1.0 and float(found["11"]["CFI"]) == 0.0 and 0 < float(found["11"]["EG"]) < 1
    assert float(found["10"]["H"]) == 0.0
    (summary,) = rows(tmp_path / "out/summary")
    assert (float(summary["alpha"]), float(summary["overall_AUC_exclude_unscorable"]), float(summary["overall_F1"]), summary["degenerate_n"], summary["degenerate_failed_extractions"]) == (0.0, 1.0, 1.0, "8", "0")
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out/report")).collect())
    # Twelve different texts of answers, contexts and questions; the offline extractor costs nothing.
    usage = text.split("(usage)")[1].split("\n")
    assert dict(zip(usage[2].split(" | "), usage[4].split(" | "), strict=True))["| api_calls"] == "| 10" and "## 2. Summary" in text
    assert "p_value" in text and "tuning: tau_sweep" in text and "| OVERALL | 8 | 4 | 16.0000 | 1.0000 |" in text
    (audit,) = [a for a in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/audits")).collect()) if a["response_id"] == "11"]
    assert (audit["H"], audit["CFI"], audit["RP_defined"], audit["gt_label"], audit["gt_span_types"]) == (1.0, 0.0, True, 1, ["T"])


def test_a_train_split_without_rows(spark, tmp_path):
    corpus(tmp_path, ("test", "test"))
    run(tmp_path, "--no-audit", config="evaluate: {bootstrap_replicates: 5}\n")
    tuned = json.loads(spark.read.text(str(tmp_path / "out/tuning")).first()[0])
    assert (tuned["alpha"], tuned["theta"]) == (0.5, 0.5)
    assert len(rows(tmp_path / "out/metrics")) == 16


def loader(path):
    """A backend as the command line would load it, with the path of its log."""

    def load():
        def generate(text, cluster, chunk):
            with open(path, "a") as f:
                f.write(text + "\n")
            if "number3" in text or text.startswith("paris dragon"):
                raise ValueError("no graph")
            words = text.split()
            return words, [(a, "next", b) for a, b in zip(words, words[1:], strict=False)]

        return generate

    return load


def test_failures_and_the_cache(spark, tmp_path, monkeypatch):
    corpus(tmp_path)
    log = str(tmp_path / "calls")
    monkeypatch.setattr(cli, "_named", lambda name: loader(log))
    config = "extract: {max_retries: 1}\nevaluate: {bootstrap_replicates: 5, alpha: 0.5}\n"
    run(tmp_path, "--extractor", "a:b", "--stage", "score", config=config)
    failed = {(r.stage, r.response_id, r.source_id) for r in spark.read.json(str(tmp_path / "out/failed")).collect()}
    assert ("reference", None, "3") in failed and ("response(skipped: ref failed)", "30", "3") in failed
    assert ("response", "11", "1") in failed and len(failed) == 1 + 2 + 7
    assert {r.response_id for r in spark.read.parquet(str(tmp_path / "out/scored")).collect()} == {f"{k}0" for k in range(8) if k != 3}
    first = open(log).read().split("\n")
    assert first.count("paris castle river") == 1  # equal texts are extracted once
    run(tmp_path, "--extractor", "a:b", "--stage", "extract", config=config)
    again = open(log).read().split("\n")[len(first) - 1 :]
    assert sorted(set(filter(None, again))) == ["paris castle river number3 garden", "paris dragon volcano castle"]


def test_limit_takes_the_first_of_the_file(spark, tmp_path):
    corpus(tmp_path)
    lines = (tmp_path / "response.jsonl").read_text().split("\n")
    (tmp_path / "response.jsonl").write_text("\n".join(lines[::-1]))
    run(tmp_path, "--limit", "5", "--fake-extractor", "--stage", "score")
    assert {r.response_id for r in spark.read.parquet(str(tmp_path / "out/scored")).collect()} == {"71", "70", "61", "60", "51"}


def test_the_first_lines_over_many_parts_of_a_file(spark, tmp_path, monkeypatch):
    ids = [str(k * 7919 % 1000) for k in range(1000)]  # "10" stands before "9"
    (tmp_path / "response.jsonl").write_text("\n\n".join(json.dumps({"id": i, "source_id": "s" if k % 3 else "no source", "response": "x" * (k % 50)}) for k, i in enumerate(ids)))
    (tmp_path / "source_info.jsonl").write_text(json.dumps({"source_id": "s", "task_type": "QA"}))
    want = [i for k, i in enumerate(ids) if k % 3]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        for n in (1, 100, 666, 667, None):
            found = [r.response_id for r in jsonl.load_instances(spark, str(tmp_path), limit=n).select("response_id").collect()]
            assert sorted(found) == sorted(want[:n])
        assert spark.read.text(str(tmp_path / "response.jsonl")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_settings_under_other_names(spark, tmp_path):
    corpus(tmp_path)
    config = """
llm: {model: some/model, api_base: null, api_key_env: SOME_KEY, temperature: 0.5, max_retries: 3, retry_backoff_base_s: 3, concurrency: 2}
extraction: {cluster: true, context_chunk_chars: 20}
matching: {embedding_model: m, entity_sim_threshold: 0.8, stopwords: [a, b]}
metrics: {alpha: null, empty_response_graph_policy: exclude, empty_response_impute_h: 0.4}
eval: {seed: 7, n_bootstrap: 5, alpha_cv_folds: 2, tau_e_sweep: [0.9], tau_r_sweep: [0.7], sweep_limit: 9, context_length_buckets: [0, 10], make_plots: false}
""" + f"data: {{dir: {tmp_path}, exclude_implicit_true: true, splits: [train]}}\ncache_dir: {tmp_path}/kept\noutput_dir: {tmp_path}/there\n"
    (tmp_path / "c.yaml").write_text(config)
    found = load_config(str(tmp_path / "c.yaml"))
    assert (found.extract.backoff_multiplier, found.extract.context_chunk_chars, found.match.stopwords, found.evaluate.sweep_entity, found.evaluate.bootstrap_replicates) == (3, 20, ("a", "b"), (0.9,), 5)
    cli.main(["--config", str(tmp_path / "c.yaml")])
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "there/report")).collect())
    assert "| model | some/model |" in text and "## 1. Settings" in text and "histogram" not in text and (tmp_path / "kept/answers/commits").exists()
    assert {r.split for r in spark.read.parquet(str(tmp_path / "there/scored")).join(spark.read.json(str(tmp_path / "response.jsonl")).selectExpr("id response_id", "split"), "response_id").collect()} == {"train"}
    for bad in ("more: {}", "llm: {more: 1}", "- list"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises((AttributeError, ValueError)):
            load_config(str(tmp_path / "bad.yaml"))
