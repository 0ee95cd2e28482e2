"""Contexts, questions and labels from source and response records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from groundloom.functions.text import is_true, shown_value, strip

TASKS = ("QA", "Data2txt", "Summary")


def response_label(labels: Column, exclude_implicit_true: bool) -> Column:
    """struct(y, types) of an answer's spans; those true by implication count unless excluded."""
    counted = F.filter(labels, lambda s: ~is_true(s["implicit_true"])) if exclude_implicit_true else labels
    types = F.transform(counted, lambda s: F.coalesce(s["label_type"], F.lit("Unknown")))
    return F.struct(F.when(F.size(counted) > 0, 1).otherwise(0).alias("y"), types.alias("types"))


def flat_facts(subject: Column, path: str, values: Column) -> Column:
    """A fact for each entry of a map of scalars, in the order of the map."""
    return F.transform(F.map_entries(values), lambda e: F.concat(subject, F.lit(f" has {path}."), e["key"], F.lit(" = "), shown_value(e["value"]), F.lit(".")))


def _facts(subject: str, path: str, value: object) -> Iterator[str]:
    entries = None
    if isinstance(value, dict):
        entries = [(f"{path}.{k}", v) for k, v in value.items()]
    elif isinstance(value, list):
        entries = [(f"{path}[{i}]", v) for i, v in enumerate(value)]
    if entries is not None:
        for p, v in entries:
            yield from _facts(subject, p, v)
        return
    shown = {None: "null (unknown)", True: "true", False: "false"}.get(value) if value is None or isinstance(value, bool) else str(value)
    yield f"{subject} has {path} = {shown}."


def business_text(record: str, with_reviews: bool = True) -> str:
    """A nested record as sentences: a fact for each scalar, named by its path; reviews follow verbatim."""
    info = json.loads(record)
    if not isinstance(info, dict):
        raise ValueError("a Data2txt record is an object")
    subject = str(info.get("name") or "").strip() or "The business"
    facts: list[str] = []
    for key, value in info.items():
        if key == "name":
            facts.append(f"The business is named {subject}.")
        elif key != "review_info":
            facts += _facts(subject, key, value)
    given = info.get("review_info")
    reviews = [str(r["review_text"]).strip() for r in given if isinstance(r, dict) and r.get("review_text") is not None] if isinstance(given, list) else []
    tail = "\n\nCustomer reviews:\n" + "\n".join(reviews) if with_reviews and reviews else ""
    return "\n".join(facts) + tail


@F.pandas_udf(StringType())
def business_texts(records: pd.Series) -> pd.Series:
    # The order and the lexemes of nested JSON are kept by Python's reader only.
    return records.map(lambda r: None if r is None else business_text(r))


def context_and_query(task: Column, info: Column) -> tuple[Column, Column]:
    """Context and question of a source record by its task; a question may be null, an unknown task raises."""
    is_object = info.startswith("{")
    wrong = F.raise_error(F.concat(F.lit("source_info of the wrong kind for task "), F.coalesce(task, F.lit("null")))).cast("string")
    field = lambda name: strip(F.coalesce(F.get_json_object(info, f"$.{name}"), F.lit("")))
    context = (
        F.when(task == "QA", F.when(is_object, field("passages")).otherwise(wrong))
        .when(task == "Data2txt", F.when(is_object, business_texts(F.when((task == "Data2txt") & is_object, info))).otherwise(wrong))
        .when(task == "Summary", strip(info))
        .otherwise(wrong)
    )
    question = F.when(task == "QA", F.nullif(field("question"), F.lit("")))
    return context, question
