from pyspark.sql import functions as F

from pagemill.llm.narrow import narrowed


def test_no_key_is_lost_and_few_others_stay(spark):
    df = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(1).alias("__x")).union(spark.range(1).select(F.lit(None).cast("string"), F.lit(1)))
    keys = df.where("id like '%7'").select(F.col("id").alias("key"))
    got = narrowed(df, "id", keys, "key")
    assert got.join(keys, got.id == keys.key, "left_semi").count() == 5000
    assert got.count() < 5000 + 0.05 * 45_000 and got.columns == df.columns
    assert narrowed(df, "id", keys.where("false"), "key").count() == 0
    assert narrowed(df, "id", keys.union(spark.range(1).select(F.lit(None).cast("string"))), "key").where("id is null").count() == 0
