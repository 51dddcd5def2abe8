"""Mixing sources to target weights by Poisson replication.

A source's documents are repeated at the mean rate that brings the source to its target share. How often one document comes
is a Poisson count of that mean, drawn by inverting the distribution at a uniform number that is a hash of seed and key: the
same seed and rows give the same mixture, on any cluster and after any lost executor. The copies are then dealt out and
sorted by a second hash, which shuffles them globally.

Scale: one scan sums the sources' bytes, one more explodes; only the copies are shuffled, once. The table of sources is
written to the shared folder first, so that its size is known and Spark broadcasts it only below
spark.sql.autoBroadcastJoinThreshold. No group of a source is ever formed, so a hot source is no hot task.

Cases: a null source is a source of its own. Sources that `weights` doesn't name have weight 0 and go. A null key is hashed
as the empty string; rows of equal keys are repeated equally often. An empty table gives an empty one. Columns of docs named
as the two added ones give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialised, partitions, unused

EXPONENT = 0.5
SEED = 17
#: Above this mean exp(-mean) nears the smallest double; such counts are sums of several.
_PART = 500.0


def uniform(*parts) -> Column:
    """A number in [0, 1), the same for the same parts everywhere: 52 bits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict | None = None, exponent: float = EXPONENT, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, bytes, weight, rate): the target share of each source and the mean number of times that its documents come.

    Without weights, shares go as a source's bytes to the power `exponent`. epochs: bytes of the mixture by bytes of docs.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("bytes"))
    if weights is None:
        raw = F.pow(F.col("bytes").cast("double"), F.lit(float(exponent)))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
    sums = sums.withColumn("_raw", raw)
    total = sums.agg(F.sum("_raw").alias("_all_raw"), F.sum("bytes").cast("double").alias("_all_bytes"))
    weight = F.when(F.col("_all_raw") > 0, F.col("_raw") / F.col("_all_raw")).otherwise(F.lit(0.0))
    out = sums.join(F.broadcast(total), F.lit(True))  # total is one row
    return out.withColumn("weight", weight).select("source", "bytes", "weight", (F.lit(float(epochs)) * F.col("weight") * F.col("_all_bytes") / F.col("bytes")).alias("rate"))


def with_distribution(found: DataFrame) -> DataFrame:
    """rates() with parts, and the distribution function of a Poisson count of mean rate / parts at 0, 1, ... until it is 1."""
    found = found.withColumn("parts", F.greatest(F.ceil(F.col("rate") / F.lit(_PART)), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    most = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("f"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(s["f"], F.array(F.element_at(s["f"], -1) + p)).alias("f"))

    return found.withColumn("distribution", F.aggregate(F.sequence(F.lit(1), most), start, step)["f"])


def replicate(docs: DataFrame, weights: dict | None = None, exponent: float = EXPONENT, epochs: float = 1.0, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text", copy: str = "copy", order: str = "shuffle_key") -> DataFrame:
    """docs' rows, each as often as drawn, with `copy` (from 1) and `shuffle_key`, by which the result is in order within its partitions."""
    spark = docs.sparkSession
    found = materialised(with_distribution(rates(docs, weights, exponent, epochs, source, text)), "rates")
    of, parts, distribution, name, times = unused(docs, "_source", "_parts", "_distribution", "_id", "_times")
    found = found.select(F.col("source").alias(of), F.col("parts").alias(parts), F.col("distribution").alias(distribution))
    identity = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.join(found, docs[source].eqNullSafe(found[of])).withColumn(name, identity)
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)),
        F.lit(0),
        lambda n, i: n + F.size(F.filter(F.col(distribution), lambda f: f <= uniform(F.lit(str(seed)), F.col(name), i.cast("string")))),
    )
    rows = rows.withColumn(times, draw).where(F.col(times) > 0)
    copies = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col(name), F.col(copy).cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    copies = copies.withColumn(order, hashed).select(*(column(c) for c in docs.columns if c not in (copy, order)), copy, order)
    return copies.repartition(partitions(spark), order).sortWithinPartitions(order)
