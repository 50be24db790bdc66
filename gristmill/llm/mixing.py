"""Mixing sources to target weights by Poisson replication.

A source with n documents and target share p of a mixture of `total` documents
has the mean repetition rate p * total / n. Each document takes a uniform number
from a hash of the seed and its id, and is repeated as often as the inverse of
the Poisson distribution with that mean says: no counters or state are shared,
and a rerun, or a retried task, draws the same counts. Copies are then sorted by
another hash, which shuffles the whole mixture.

A mean above `LARGEST_MEAN` is the sum of equal means up to it, each with a number
of its own from the hash: sums of Poisson numbers are Poisson distributed, and no
table of the distribution is longer than about 1,500.

Defined results: a null source is a source of its own; rows that repeat a doc_id
draw alike, a null doc_id draws as ''. Sources without a weight get none. Extra
columns stay, but for any of the name of a new column, in any case; an empty table
gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import others, private, public
from .storage import written

LARGEST_MEAN = 1024
#: Numbers in distribution tables that are broadcast (8 MB); beyond it they are joined over salted keys.
BROADCAST_NUMBERS = 1 << 20
SALTS = 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_tables(rates: DataFrame) -> DataFrame:
    """source, rate, draws and the table P(count <= k), k = 0, 1, ..., of one draw's mean, as far as doubles tell it from 1."""
    rows = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    last = F.when(F.col("mean") > 0, F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20)).otherwise(0).cast("int")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    sofar = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    factorial = F.sum(F.when(F.col("k") > 1, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(sofar)
    rows = rows.withColumn("p", F.when(F.col("mean") > 0, F.exp(-F.col("mean") + F.col("k") * F.log("mean") - factorial)).otherwise(1.0))
    rows = rows.withColumn("sum", F.sum("p").over(sofar))
    return rows.groupBy("source", "rate", "draws").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sum"))), lambda x: x["sum"]).alias("table"))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None, source: str = "source") -> DataFrame:
    """source, rate: by the given weights, or by document counts raised to `temperature`."""
    counts = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        given = F.create_map(*(F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))))
        weight = F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(0.0))
    counts = written(counts.withColumn("weight", weight), "source-counts")
    sums = counts.agg(F.sum("n"), F.sum("weight")).first()
    size, weighed = (total or sums[0] or 0), (sums[1] or 1.0)
    return counts.select("source", "n", (F.col("weight") / F.lit(float(weighed)) * F.lit(float(size)) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs, each repeated, in shuffled order; adds rate, copy (from 0) and shuffle_key."""
    tables = written(poisson_tables(source_rates(docs, weights, temperature, total, source)), "poisson-tables")
    tables = tables.withColumnRenamed("source", "name")
    few = (tables.agg(F.sum(F.size("table"))).first()[0] or 0) <= BROADCAST_NUMBERS
    columns = others(docs, "rate", "copy", "shuffle_key")
    # the text tells rows that repeat a doc_id apart, so that they don't stay side by side
    own = F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))) if text in docs.columns else F.lit("")
    rows = private(docs, columns, id=F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), source=F.col(f"`{source}`"), own=own)
    on = F.col("source").eqNullSafe(F.col("name"))
    if few:
        rows = rows.join(F.broadcast(tables), on)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        tables = tables.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(tables, on & (F.col("salt") == F.col("other")))
    below = lambda u: F.size(F.filter("table", lambda c: c < u))
    rest = F.aggregate(F.sequence(F.lit(2), F.col("draws")), F.lit(0), lambda n, i: n + below(uniform(seed, F.col("id"), i)))
    times = below(uniform(seed, F.col("id"))) + F.when(F.col("draws") > 1, rest).otherwise(0)
    copies = rows.withColumn("n", times).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}s"), "id", F.col("copy").cast("string"), "own"))
    return copies.select(*public(columns), "rate", "copy", key.alias("shuffle_key")).orderBy("shuffle_key")
