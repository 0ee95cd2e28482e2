"""The running AUC of a stream in which a batch is delivered twice."""

import json

import pytest

from groundloom.operators import ranking
from groundloom.streaming import running_auc

SCHEMA = "response_id string, y int, h double, at timestamp"


def test_answers_delivered_again_count_once(spark, tmp_path):
    # Scores in the middle of a range each: equal only where they are equal.
    rows = [{"response_id": f"r{k}", "y": int(k % 3 == 0), "h": ((k * 577 % 1009) + 0.5) / 4096, "at": f"2024-01-01 00:{k // 5:02}:00"} for k in range(200)]
    rows += [{"response_id": "undefined", "y": 1, "h": None, "at": "2024-01-01 00:10:00"}, {"response_id": "outside", "y": 0, "h": 1.0, "at": "2024-01-01 00:10:00"}]
    batches = [rows[:80], rows[:80], rows[80:], rows[40:120]]
    (tmp_path / "in").mkdir()
    for k, batch in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, batch)))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        running_auc.run(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()  # a new query each time: state comes from the checkpoint
    numbers = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    last = running_auc.auc_of_counts(spark.read.parquet(f"{tmp_path}/out/batch={numbers[-1]}")).first()
    want = ranking.auc(spark.createDataFrame([(r["response_id"], r["y"], r["h"]) for r in rows], "response_id string, y int, h double"), []).first()
    assert (last.n, last.n_pos) == (want.n, want.n_pos) == (201, 67) and last.auc == pytest.approx(want.auc, abs=1e-12)
    first = running_auc.auc_of_counts(spark.read.parquet(f"{tmp_path}/out/batch={numbers[0]}")).first()
    assert first.n == 80
