"""Resamples by hashes: the same weights as in SQL, without a row per row and resample."""

from pyspark.sql import functions as F

from spanwise.operators import uncertainty as un


def exploded(df, by, value, key, resamples):
    u = (F.pmod(F.xxhash64(F.col(key), F.col("b")), F.lit(1_000_003)) + F.lit(0.5)) / F.lit(1_000_003.0)
    w, total, term = F.lit(0), 0.0, 2.718281828459045**-1
    for i in range(1, 12):
        total += term
        w = w + F.when(u > total, 1).otherwise(0)
        term /= i
    d = df.where(F.col(value).isNotNull()).select(*by, key, F.col(value).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("w", w)
    m = d.groupBy(*by, "b").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w").cast("double")).alias("m"))
    return m.groupBy(*by).agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def test_same_intervals_without_exploding_rows(spark):
    data = [(f"r{i % 3}" if i % 7 else None, f"soru {i % 40}" if i % 11 else None, (i * 37 % 101) / 101 if i % 13 else None) for i in range(300)] + [("one", "tek", 0.5)]
    df = spark.createDataFrame(data, "run string, question string, value double")
    for by in (["run"], ["run", "half"]):
        d = df.withColumn("half", F.col("value") > 0.5)
        got = un.bootstrap_sql(d, by, "value", "question", 700)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "explode" not in plan
        assert sorted(map(str, got.collect())) == sorted(map(str, exploded(d, by, "value", "question", 700).collect()))
    assert un.bootstrap_sql(df.limit(0), ["run"], "value", "question", 10).count() == 0
