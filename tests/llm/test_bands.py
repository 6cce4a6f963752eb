"""Bands of perplexity move smoothly with a language's number of documents."""

from pyspark.sql import functions as F

from terraloom.llm import perplexity


def test_no_switch_by_count(spark):
    def high(n):
        rows = [("+en", 2.0 + k / 500, 2.0 + k / 500) for k in range(400)] + [("+fr", 3.0 + k % 10 / 100, 3.0 + k % 10 / 100) for k in range(n)]
        df = spark.createDataFrame(rows, "lang string, fifth double, third double").withColumn("base_failed", F.lit(False))
        return {(r.measure, r.lang): r.median + 4 * r.above for r in perplexity.bands(df).collect()}

    at = {n: high(n) for n in (1, 48, 49, 50, 51)}
    for measure in perplexity.MEASURES:
        own = [at[n][measure, "+fr"] for n in (48, 49, 50, 51)]
        assert max(own) - min(own) < 0.1
        assert abs(at[1][measure, "+fr"] - at[1][measure, "+en"]) < 0.2
