"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docqa.llm.common import column, fresh
from docqa.workspace import settle

STEP = 32.0
MOST_SOURCES = 100_000  # rates that are broadcast at most


def poisson_count(rate: Column, key: Column, seed: int) -> Column:
    """Inverted Poisson draw of mean ``rate``; rates above STEP are sums of draws, so exp never underflows."""
    draws = F.ceil(rate / STEP).cast("int")
    mean = rate / F.greatest(draws, F.lit(1))
    last = (mean + 12 * F.sqrt(mean) + 25).cast("int")

    def draw(j: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), j), 11) / F.lit(float(1 << 53))
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))

        def step(a: Column, k: Column) -> Column:
            p = a["p"] * mean / k
            n = a["n"] + (u >= a["cdf"]).cast("int")
            return F.struct(p.alias("p"), (a["cdf"] + p).alias("cdf"), n.alias("n"))

        return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["n"])

    return F.when(draws > 0, F.aggregate(F.transform(F.sequence(F.lit(1), draws), draw), F.lit(0), lambda a, x: a + x)).otherwise(0)


def mix(docs: DataFrame, alpha: float = 0.5, seed: int = 7) -> DataFrame:
    """Sources at shares proportional to share ** alpha; each document is repeated by its count.

    The rates of up to ``MOST_SOURCES`` sources are broadcast, so texts stay where they are until the global shuffle; more are
    joined by key. A null source is a source; rows of one ``doc_id`` and text get the same count, null, empty and long texts
    too; an empty table gives none. All other columns stay; columns ``copy_no`` and ``shuffle_key`` of the input are replaced.
    """
    source, rate_of, n, copy, order = fresh(docs, "rate_source", "rate", "repeats", "copy_made", "order_made")
    sizes = settle(docs.groupBy("source").agg(F.count("*").alias(n)), "sources")
    total = sizes.agg(F.sum(n), F.sum(F.pow(n, F.lit(alpha))), F.count("*")).first()
    rate = F.pow(n, F.lit(alpha)) / F.lit(total[1] or 1.0) * F.lit(float(total[0] or 0)) / F.col(n)
    rates = sizes.select(F.col("source").alias(source), rate.alias(rate_of))
    rates = F.broadcast(rates) if total[2] <= MOST_SOURCES else rates
    joined = docs.join(rates, docs["source"].eqNullSafe(rates[source]))
    key = F.xxhash64("doc_id", "text")
    copies = joined.withColumn(n, poisson_count(F.col(rate_of), key, seed)).filter(F.col(n) > 0)
    rows = copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    shuffled = rows.withColumn(order, F.xxhash64(key, copy, F.lit(seed + 1))).repartition(order).sortWithinPartitions(order)
    kept = [column(c) for c in docs.columns if c.lower() not in ("copy_no", "shuffle_key")]
    return shuffled.select(*kept, F.col(copy).alias("copy_no"), F.col(order).alias("shuffle_key"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_mixing": op7_mixing}
