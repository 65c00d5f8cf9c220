"""Mixing sources to target weights by Poisson replication.

A source's rate is its share of the target over its share of the corpus, times `size` over the number
of documents: the mean number of copies of each of its documents. The count of a document is the
smallest k with u <= P(X <= k) for X ~ Poisson(rate), where u is drawn from a hash of seed and id. Copies
are then ordered globally by a hash of seed, id and copy number. No state is kept between documents,
so a lost task yields the same copies again.

Defined results: a null source is a source of its own; documents of a source without target weight
go, as do weights of sources without documents; null ids count as the empty string; repeated
documents get the same count each; a column of the documents named like an added one is replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import free_name

SEED = 20_240
#: Terms of a Poisson distribution beyond its mean: this many standard deviations, and this many more.
TAIL_DEVIATIONS, TAIL_TERMS = 12, 30
#: Sources that one broadcast holds; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered_weights(docs: DataFrame, source_column: str = "source", power: float = 0.5) -> DataFrame:
    """Rows source, weight: each source's number of documents to a power, which lifts small sources."""
    counts = docs.groupBy(F.col(source_column).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def source_rates(docs: DataFrame, weights: DataFrame, size: float | None, source_column: str = "source") -> DataFrame:
    """Rows source, rate, cdf: P(X <= k) for k = 0, 1, ..., up to where it is 1 to double precision."""
    counts = docs.groupBy(F.col(source_column).alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    found = counts.join(
        weights.where("weight > 0").select(F.col("source").alias("wanted"), F.col("weight").cast("double")),
        F.col("source").eqNullSafe(F.col("wanted")),
    )
    all_weight, all_n = found.agg(F.sum("weight"), F.sum("n")).first()
    target = float(all_n or 0) if size is None else float(size)
    rate = F.col("weight") / F.lit(all_weight) * F.lit(target) / F.col("n")
    rates = found.select("source", rate.alias("rate"))
    terms = F.ceil(F.col("rate") + TAIL_DEVIATIONS * F.sqrt("rate")).cast("int") + TAIL_TERMS

    def add(state: Column, k: Column) -> Column:
        log_term = state["log_term"] + F.ln("rate") - F.ln(k)
        total = state["total"] + F.exp(log_term)
        cdf = F.concat(state["cdf"], F.array(total))
        return F.struct(log_term.alias("log_term"), total.alias("total"), cdf.alias("cdf"))

    zero = F.exp(-F.col("rate"))
    start = F.struct((-F.col("rate")).alias("log_term"), zero.alias("total"), F.array(zero).alias("cdf"))
    return rates.select("source", "rate", F.aggregate(F.sequence(F.lit(1), terms), start, add)["cdf"].alias("cdf"))


def mix(
    docs: DataFrame,
    weights: DataFrame,
    size: float | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """The copies of `docs`, all columns and `copy` (from 0) and `mix_key`, in ascending order of `mix_key`.

    `weights` has source and weight. `size` is the expected number of rows, by default that of the sources
    in both tables.
    """
    rates = source_rates(docs, weights, size, source_column)
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    # Names that no column of the documents has, also not `copy` and `mix_key`, which replace columns of that name.
    source, cdf, draw, n = (free_name(docs.columns, f"_mix_{part}") for part in ("source", "cdf", "draw", "n"))
    rates = rates.select(F.col("source").alias(source), F.col("cdf").alias(cdf))
    joined = docs.join(F.broadcast(rates) if small else rates, F.col(source_column).eqNullSafe(F.col(source)))
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    drawn = joined.withColumn(draw, uniform(F.lit(str(seed)), name))
    counted = drawn.withColumn(n, F.size(F.filter(cdf, lambda c: c < F.col(draw))).cast("bigint"))
    copies = counted.where(F.col(n) > 0)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), name, F.col("copy").cast("string")))
    return copies.withColumn("mix_key", key).drop(source, cdf, draw, n).orderBy("mix_key")
