from pyspark.sql import functions as F

from groundloom import queries
from groundloom.config import EvalConfig


def test_the_sweep_takes_every_train_answer(spark, tmp_path):
    n = 4 * EvalConfig().sweep_answers
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Alice Smith met Bob Jones. Alice Smith met Carol "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    train = queries.instances(spark, str(tmp_path)).where("split = 'train'").count()
    rows = queries.tau_sweep(spark, str(tmp_path)).collect()
    assert train > EvalConfig().sweep_answers and {r.n for r in rows} == {train}
