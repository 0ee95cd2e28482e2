import json

from groundloom.config import MatchConfig
from groundloom.plans import cli
from groundloom.streaming.score_stream import score_stream


def test_a_corpus_runs_to_a_report(spark, tmp_path):
    sources = [{"source_id": str(k), "task_type": "Summary", "source_info": f"Paris castle river number{k} garden"} for k in range(8)]
    answers = [{"id": f"{k}{y}", "source_id": str(k), "model": "m", "split": "train" if k < 4 else "test", "response": "paris castle river" if not y else "dragon volcano unicorn", "labels": [{"label_type": "T"}] * y} for k in range(8) for y in (0, 1)]
    for name, rows in (("source_info", sources), ("response", answers)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "c.yaml").write_text("evaluate: {bootstrap_replicates: 20}\n")
    cli.main(["--data-dir", str(tmp_path), "--output-dir", str(tmp_path / "out"), "--config", str(tmp_path / "c.yaml")])
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out/report")).collect())
    assert "| OVERALL | 8 | 4 | 16.0000 | 1.0000 |" in text
    assert spark.read.text(str(tmp_path / "out/audits")).count() == 16


def test_answers_are_scored_as_they_arrive(spark, tmp_path):
    graph = "source_id string, entities array<string>, relations array<struct<s:string,r:string,o:string>>"
    contexts = spark.createDataFrame([("1", ["paris"], [])], graph)
    spark.createDataFrame([("a", "1", "Paris dragon")], "response_id string, source_id string, response string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("response_id string, source_id string, response string").json(str(tmp_path / "in"))
    score_stream(stream, contexts, spark.createDataFrame([], graph), str(tmp_path / "out"), str(tmp_path / "check"), MatchConfig()).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.Va == 3 and row.EG == 2 / 3
