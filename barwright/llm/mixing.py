"""Mixing sources to target weights by Poisson replication.

A source whose share of the text is to become its target weight has a target repetition rate: the weight times the
corpus' characters over the source's. Each document draws its number of copies from a Poisson distribution with that
mean, by inverting the distribution at a uniform number hashed from its id and the seed, so that a rerun, or another
partitioning, draws the same. A rate above ``STEP`` is cut into equal parts of at most that, each with a draw of its own:
the sum of Poisson numbers is Poisson, whatever the rate. Copies are exploded and shuffled globally by a hash of id, copy and seed.

A null source is a source of its own. A null or empty text has no characters and keeps its source's rate. Rows that
repeat an id draw the same number. A source that has no target weight, and a corpus without characters, keeps rate 1.
Extra columns pass through; ``copy`` and ``mix_key`` of the input are replaced, and ``mixing_source``, ``mixing_rate`` and
``mixing_copies`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import shuffle_partitions, small, staged

#: Terms of the distribution that are summed for a part's mean of at most STEP (what is left out is below 2^-52).
TERMS, STEP = 40, 8.0


def uniform(text: Column) -> Column:
    """52 bits of the MD5 sum as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(u: Column, rate: Column) -> Column:
    """The least k whose distribution function passes u, for a mean of at most STEP."""
    p, total, k = F.exp(-rate), F.exp(-rate), F.lit(0)
    state = F.struct(p.alias("p"), total.alias("c"), k.alias("k"))
    step = lambda s, i: F.struct((s["p"] * rate / i).alias("p"), (s["c"] + s["p"] * rate / i).alias("c"), (s["k"] + (s["c"] <= u).cast("int")).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), state, step, lambda s: s["k"])


def copies(name: Column, rate: Column) -> Column:
    """A Poisson number with mean rate, drawn by a hash of name: one draw for each part of the rate."""
    parts = F.greatest(F.ceil(rate / STEP), F.lit(1)).cast("int")
    one = lambda j: poisson(uniform(F.concat(name, F.when(j > 0, F.concat(F.lit("#"), j.cast("string"))).otherwise(F.lit("")))), rate / parts)
    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda s, j: s + one(j))


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """source, rate. Without weights a source's target is its share of characters to the power temperature, scaled to 1."""
    chars = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        want = F.when(F.col("chars") > 0, F.pow("chars", F.lit(temperature)))
    else:
        total = float(sum(weights.values())) or 1.0
        want = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / total)])[F.col("source")] if weights else F.lit(None).cast("double")
    sums = chars.select("*", want.alias("want"))
    # one row of totals, joined to a row a source
    totals = sums.agg(F.sum("want").alias("w"), F.sum("chars").alias("all"))
    found = sums.join(F.broadcast(totals))
    return found.select("source", F.coalesce(F.when(F.col("chars") > 0, F.col("want") / F.col("w") * F.col("all") / F.col("chars")), F.lit(1.0)).alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, seed: str = "mix-1", shuffle: bool = True) -> DataFrame:
    """docs, each row as often as it is drawn, with copy (from 0) and mix_key; globally shuffled by mix_key.

    weights: target share of characters by source (scaled to 1). temperature: used where weights is None.
    """
    docs = docs.drop("copy", "mix_key", "mixing_source", "mixing_rate", "mixing_copies")
    # a row for each source, counted: broadcast below the bound, so that texts needn't be shuffled by their source
    table = staged(rates(docs, weights, temperature).select(F.col("source").alias("mixing_source"), F.col("rate").alias("mixing_rate")), "rates")
    joined = docs.join(small(table), F.col("source").eqNullSafe(F.col("mixing_source")), "left").drop("mixing_source")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = joined.withColumn("mixing_copies", copies(F.concat(F.lit(f"{seed}:"), key), F.col("mixing_rate")))
    out = drawn.where("mixing_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("mixing_copies") - 1)))
    out = out.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy").cast("string")))).drop("mixing_copies", "mixing_rate")
    if shuffle:
        n = shuffle_partitions(docs.sparkSession)
        out = out.repartition(n, "mix_key").sortWithinPartitions("mix_key")
    return out


def oracle(docs: str = "documents", temperature: float = 0.7, seed: str = "mix-1") -> str:
    """DuckDB's SQL for mixed() without weights, over the table docs."""
    return f"""
WITH RECURSIVE chars AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM {docs} GROUP BY source),
want AS (SELECT source, chars, CASE WHEN chars > 0 THEN pow(chars, {temperature}) END AS want FROM chars),
rates AS (SELECT source, coalesce(CASE WHEN chars > 0 THEN want / (SELECT sum(want) FROM want) * (SELECT sum(chars) FROM want) / chars END, 1.0) AS rate FROM want),
split AS (SELECT source, CAST(greatest(ceil(rate / {STEP}), 1) AS INTEGER) AS parts, rate / greatest(ceil(rate / {STEP}), 1) AS mean FROM rates),
poisson AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM split
  UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM poisson WHERE k < {TERMS}),
cdf AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS cs FROM poisson GROUP BY source),
uniforms AS (
  SELECT d.*, t.cs, list_transform(range(t.parts), lambda j: CAST(CAST('0x' || md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || CASE WHEN j > 0 THEN '#' || j ELSE '' END)[1:13] AS UBIGINT) AS DOUBLE) / {float(2**52)}) AS us
  FROM {docs} d JOIN cdf t ON d.source IS NOT DISTINCT FROM t.source),
drawn AS (SELECT * EXCLUDE (cs, us), CAST(list_sum(list_transform(us, lambda u: len(list_filter(cs[1:{TERMS}], lambda x: x <= u)))) AS INTEGER) AS copies FROM uniforms)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS mix_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM drawn WHERE copies > 0)
"""
