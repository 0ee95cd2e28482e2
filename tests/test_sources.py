import json

import pytest
from pyspark.sql import functions as F

from groundloom.config import load_config
from groundloom.sources.construct import business_text
from groundloom.sources.jsonl import load_instances


def test_business_text():
    info = {"name": "Subway", "city": None, "attributes": {"wifi": False, "parking": {"garage": True}}, "review_info": [{"review_text": " Good. "}, {"stars": 1}]}
    assert business_text(json.dumps(info)) == "The business is named Subway.\nSubway has city = null (unknown).\nSubway has attributes.wifi = false.\nSubway has attributes.parking.garage = true.\n\nCustomer reviews:\nGood."


def write(folder, sources, answers):
    for name, rows in (("source_info", sources), ("response", answers)):
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")


def test_instances(spark, tmp_path):
    qa = {"source_id": 1, "task_type": "QA", "source_info": {"passages": " P ", "question": "Q"}}
    sources = [{**qa, "source_info": {"passages": "old"}}, qa, {"source_id": "2", "task_type": "Summary", "source_info": " S "}, {"source_id": "3", "task_type": "Data2txt", "source_info": {"name": "N", "x": 1}}]
    span = {"start": 0, "end": 1, "label_type": "T", "implicit_true": True}
    answers = [{"id": "a", "source_id": "1", "labels": [span], "split": "train"}, {"id": "b", "source_id": "2"}, {"id": "c", "source_id": "9"}, {"id": "d", "source_id": "3", "labels": [{**span, "implicit_true": None, "due_to_null": True}]}]
    write(tmp_path, sources, answers)
    rows = {r.response_id: r for r in load_instances(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b", "d"}
    assert (rows["a"].context, rows["a"].query, rows["a"].y, rows["a"].gt_span_types) == ("P", "Q", 1, ["T"])
    assert (rows["b"].context, rows["b"].query, rows["b"].y, rows["b"].gen_model) == ("S", None, 0, "unknown")
    assert rows["d"].context == "The business is named N.\nN has x = 1."
    strict = {r.response_id: r.y for r in load_instances(spark, str(tmp_path), True, ("train", "")).collect()}
    assert strict == {"a": 0, "b": 0, "d": 1}


def test_unknown_tasks_raise(spark, tmp_path):
    write(tmp_path, [{"source_id": "1", "task_type": "?", "source_info": "x"}], [{"id": "a", "source_id": "1"}])
    with pytest.raises(Exception, match="wrong kind"):
        load_instances(spark, str(tmp_path)).collect()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("match: {min_substring_chars: 3}\n")
    assert load_config(str(tmp_path / "c.yaml")).match.min_substring_chars == 3
    (tmp_path / "c.yaml").write_text("[1]")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "c.yaml"))


def test_the_first_words_of_long_texts(spark):
    """Those of the whole text, wherever the beginning that is looked through first ends."""
    import re

    from groundloom.operators import extract

    words = [f"word{chr(97 + k)}" for k in range(14)]
    texts = [" " * n + " ".join(words) for n in range(380, 520, 7)] + ["ab " * 300 + " ".join(words), "same " * 400 + "other", " ".join(words[:11]) + " " * 440 + "x" * 90, "É" * 505 + "wordabcdefgh " + " ".join(words), ""]
    firsts = lambda t: list(dict.fromkeys(w for w in re.findall("[a-z][a-z0-9]+", t.lower()) if len(w) >= 4))[:12]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", extract.tokens(F.col("t")).alias("e")).collect()
    assert all(r.e == firsts(r.t) for r in rows)
