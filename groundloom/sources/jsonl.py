"""JSON-lines corpora, and the files that runs write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundloom.sources.construct import context_and_query, response_label

SOURCES = "source_id string, task_type string, source string, source_info string, prompt string"
RESPONSES = (
    "id string, source_id string, model string, temperature double, split string, quality string, response string, "
    "labels array<struct<start:int,end:int,text:string,label_type:string,meta:string,due_to_null:string,implicit_true:string>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file in a schema; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each source_id: the last in the file."""
    given = read_jsonl(spark, f"{folder}/source_info.jsonl", SOURCES)
    columns = given.columns
    placed = given.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    last = F.max_by(F.struct(*columns), F.struct("__file", "__block", "__line"))
    return placed.groupBy("source_id").agg(last.alias("x")).select("x.*")


#: Where a row stands in the files it was read from: file, first byte of the part of it that a task reads, and number in the task.
PLACE = "__place"


def with_place(df: DataFrame) -> DataFrame:
    """df, as read from files, with the place of each row. Rows of a part have ascending numbers."""
    return df.withColumn(PLACE, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line")))


def first_in_files(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows by their place, without it; all if n is None or 0.

    The rows of each part are counted and the counts added up: parts before the one where n is reached are
    taken whole, and only that one is put in order.
    """
    if not n:
        return df.drop(PLACE)
    part = [F.col(f"{PLACE}.{c}").alias(c) for c in ("file", "part")]
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("rows"))
    # One row a part of a file.
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("before", before).where((F.col("before") < n) & (F.col("before") + F.col("rows") >= n)).first()
    if cut is None:
        return df.drop(PLACE)
    here, at = F.struct(F.col(f"{PLACE}.file"), F.col(f"{PLACE}.part")), F.struct(F.lit(cut.file), F.lit(cut.part).cast("bigint"))
    rest = df.where(here == at).orderBy(f"{PLACE}.line").limit(n - cut.before)
    return df.where(here < at).unionByName(rest).drop(PLACE)


def load_instances(spark: SparkSession, folder: str, exclude_implicit_true: bool = False, splits: tuple[str, ...] | None = None, limit: int | None = None) -> DataFrame:
    """Answers with their source's context and question, and labels; answers without a source are dropped.

    limit: the first so many of them in the order of the file of answers.
    """
    sources = load_sources(spark, folder)
    context, query = context_and_query(F.col("task_type"), F.col("source_info"))
    built = sources.select("source_id", F.col("task_type").alias("task"), context.alias("context"), query.alias("query"), F.coalesce("prompt", F.lit("")).alias("prompt"))
    answers = with_place(read_jsonl(spark, f"{folder}/response.jsonl", RESPONSES)).withColumn("split", F.coalesce("split", F.lit("")))
    if splits is not None:
        answers = answers.where(F.col("split").isin(*splits))
    spans = F.coalesce("labels", F.array().cast(answers.schema["labels"].dataType))
    answers = answers.withColumn("label", response_label(spans, exclude_implicit_true))
    return first_in_files(answers.join(built, "source_id"), limit).select(
        F.col("id").alias("response_id"), "source_id", "task", F.coalesce("model", F.lit("unknown")).alias("gen_model"), "split", "context", "query",
        F.coalesce("response", F.lit("")).alias("response"), F.col("label.y").alias("y"), F.col("label.types").alias("gt_span_types"),
        F.coalesce("quality", F.lit("")).alias("quality"), "prompt",
    )


def first_of(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key and columns of the first row in order of each key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("x")).select(key, "x.*")


def limited(df: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first n rows in order; all if n is None or 0."""
    return df.orderBy(order).limit(n) if n else df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays and structs as JSON, so that every column is a scalar."""
    flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


FAILURES = "stage string, response_id string, source_id string, error string"


def write_failures(df: DataFrame, path: str) -> None:
    """A record for each graph that is missing: stage, response_id, source_id, error."""
    write_jsonl(df, path)
