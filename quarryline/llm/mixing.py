"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every source has a target share of the output. With ``epochs`` times the input's characters to give
out, a source's mean repetition rate is share * total / its own characters. Each document draws how
often it comes from a Poisson distribution of that mean, inverted at a uniform number that is a hash of
seed and doc_id: the draw depends on nothing else, so a lost executor's work gives the same rows. The
document is exploded by its count, and the copies are dealt over all partitions and sorted by a hash.

Sums a source are pre-aggregated in each task; what is joined back is a row a source. With at most
MOST_SOURCES sources, which are counted, these rows are broadcast; beyond that they are joined by source, and
Spark splits skewed partitions.

Edge cases: a null source is a source of its own; a null doc_id draws as the empty text; rows with
equal doc_id draw alike, each for itself; a null or empty text counts one character; sources without a
target weight get none of the output when weights are given; an empty table gives no rows; other
columns pass through, those named like an added one give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import boxed, cut, table, unboxed

#: Poisson draws of a larger mean are sums of draws of equal smaller ones, for exp(-mean) must not vanish.
LARGEST_MEAN = 200.0
#: Up to so many sources their rates are broadcast (some 100 bytes each).
MOST_SOURCES = 10_000
#: Hexadecimal digits of an md5 that make a uniform number below 1.
DIGITS = 13


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, joined by a colon."""
    digest = F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def poisson_at(u: Column, mean: Column) -> Column:
    """The smallest k at which the Poisson distribution function of ``mean`` reaches ``u``."""
    most = (mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("f"), F.lit(0).alias("k"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.when(a["f"] >= u, a).otherwise(F.struct(p.alias("p"), (a["f"] + p).alias("f"), k.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["k"]


def poisson_count(mean: Column, seed: str, key: Column) -> Column:
    """A hash-seeded Poisson draw; means above LARGEST_MEAN are split in equal parts."""
    parts = F.greatest(F.lit(1), F.ceil(mean / LARGEST_MEAN).cast("int"))
    one = poisson_at(uniform(seed, key), mean)
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, k: n + poisson_at(uniform(seed, key, k), mean / parts))
    return F.when(mean <= 0, F.lit(0)).when(parts == 1, one).otherwise(many)


def rates(documents: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, share, rate. Without ``weights`` a source's share follows its characters to ``power``."""
    size = F.greatest(F.lit(1), F.length(F.coalesce("text", F.lit("")))).cast("double")
    sizes = documents.groupBy("source").agg(F.sum(size).alias("chars"))
    if weights is None:
        weight = F.pow("chars", F.lit(float(power)))
    else:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    weighed = sizes.select("source", "chars", weight.alias("weight"))
    weighed = cut(weighed)  # a row a source
    totals = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars")).first()
    share = F.col("weight") / F.lit(totals["all_weight"] or 1.0)
    return weighed.select("source", share.alias("share"), (share * F.lit(totals["all_chars"] or 0.0) * F.lit(float(epochs)) / F.col("chars")).alias("rate"))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """The documents replicated to the target mix and shuffled; adds ``copy`` (from 1) and ``shuffle_key``."""
    means = rates(documents, weights, power, epochs).select("source", "rate")
    if means.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        means = F.broadcast(means)
    keys = boxed(documents, doc=F.col("doc_id"), origin=F.col("source"))
    met = keys.join(means, F.col("origin").eqNullSafe(F.col("source")))
    drawn = met.withColumn("n", poisson_count(F.col("rate"), seed, F.col("doc"))).where("n > 0")
    copies = drawn.select("row", "doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    shuffled = copies.withColumn("shuffle_key", uniform(seed, F.lit("order"), F.col("doc"), F.col("copy"))).drop("doc")
    shuffled = shuffled.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return unboxed(shuffled, documents, copy=F.col("copy"), shuffle_key=F.col("shuffle_key"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_U = "CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0"
MIX_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(greatest(1, length(coalesce(text, '')))::DOUBLE) AS chars FROM documents GROUP BY source),
totals AS (SELECT sum(pow(chars, 0.5)) AS all_weight, sum(chars) AS all_chars FROM sizes),
rates AS (SELECT source, pow(chars, 0.5) / all_weight * all_chars / chars AS rate FROM sizes, totals),
drawn AS (
  SELECT d.*, r.rate, {_U.format(key="'mix-1:' || coalesce(d.doc_id::VARCHAR, '')")} AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
steps(doc_id, text, lang, source, n_chars, rate, u, k, p, f) AS (
  SELECT doc_id, text, lang, source, n_chars, rate, u, 0, exp(-rate), exp(-rate) FROM drawn
  UNION ALL
  SELECT doc_id, text, lang, source, n_chars, rate, u, k + 1, p * rate / (k + 1), f + p * rate / (k + 1)
  FROM steps WHERE f < u AND k < CAST(floor(rate + 12 * sqrt(rate) + 24) AS INT))
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INTEGER) AS copy,
  {_U.format(key="'mix-1:order:' || coalesce(doc_id::VARCHAR, '') || ':' || k::VARCHAR")} AS shuffle_key
FROM steps WHERE k > 0
"""
