"""Poisson replication against SQL and its rates."""

import math

from barwright.llm import mixing


def test_matches_sql(docs, duck):
    cols = ["doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key"]
    got = sorted(tuple(r[c] for c in cols) for r in mixing.mixed(docs).collect())
    assert got == sorted(duck.execute(f"SELECT {', '.join(cols)} FROM ({mixing.oracle()})").fetchall())


def test_inversion(spark):
    from pyspark.sql import functions as F

    def slow(u, m):
        k, p = 0, math.exp(-m)
        c = p
        while c <= u:
            k += 1
            p *= m / k
            c += p
        return k

    cases = [(u / 97, m) for u in range(97) for m in (0.0, 0.2, 1.0, 3.7, 8.0)]
    df = spark.createDataFrame(cases, "u double, m double").withColumn("k", mixing.poisson(F.col("u"), F.col("m")))
    assert all(r["k"] == slow(r["u"], r["m"]) for r in df.collect())


def test_high_rates_are_poisson(spark):
    """Mean and variance are the rate, also where it is far above one part's."""
    from pyspark.sql import functions as F

    for rate in (0.0, 7.9, 8.1, 60.0, 900.0):
        df = spark.range(4000).select(mixing.copies(F.concat(F.lit("s:"), F.col("id").cast("string")), F.lit(rate)).alias("k"))
        mean, var = df.agg(F.avg("k"), F.var_samp("k")).first()
        assert abs(mean - rate) <= 4 * math.sqrt(rate / 4000) and abs(var - rate) <= 5 * rate * math.sqrt(2 / 4000) + 5 * math.sqrt(rate / 4000)


def test_high_rates_match_sql(spark, duck):
    rows = [(i, "x" * (4000 if i < 3 else 2), "en", "big" if i < 3 else "small", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pdf = df.toPandas()  # noqa: F841  DuckDB finds it by name
    duck.register("few", pdf)
    want = sorted(r[0] for r in duck.execute(f"SELECT mix_key FROM ({mixing.oracle('few', temperature=0.0)})").fetchall())
    got = sorted(r["mix_key"] for r in mixing.mixed(df, temperature=0.0).collect())
    assert got == want and len(got) > 500


def test_shares_follow_target_weights(spark):
    rows = [(i, "x" * 10, "en", "a" if i % 10 else "b") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["source"]: r["count"] for r in mixing.mixed(df, {"a": 0.5, "b": 0.5}).groupBy("source").count().collect()}
    assert abs(got["a"] / (got["a"] + got["b"]) - 0.5) < 0.02 and abs(sum(got.values()) / 20_000 - 1) < 0.05


def test_odd_rows_and_rerun(odd):
    key = lambda df: sorted(r["mix_key"] for r in df.select("mix_key").collect())
    a = mixing.mixed(odd, seed="s")
    assert set(odd.columns) < set(a.columns)
    assert key(a) == key(mixing.mixed(odd.repartition(3), seed="s"))
    assert mixing.mixed(odd, {"nowhere": 1.0}, shuffle=False).count() >= 0 and mixing.mixed(odd, {}).count() >= 0
    assert mixing.mixed(odd.limit(0)).count() == 0
