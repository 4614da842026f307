"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, table

SEED = 20
#: Up to so many sources, the table of rates (one short row a source) goes to every task; beyond, it is joined by shuffle.
RATES_BROADCAST = 10_000
#: Copies of a document are made in runs of so many.
RUN = 4096


def hash_uniform(text: Column) -> Column:
    """A number in [0, 1) with 52 bits, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


@lru_cache(maxsize=32)
def _poisson_cdf(rate: float) -> tuple[int, np.ndarray]:
    """The first k, and P(X <= k) from there up to where the rest is below 2^-52.

    Twelve deviations around the rate hold all that a number of 52 bits can tell apart, so a large rate takes
    the root of its size in memory, and for as long as a task draws from it.
    """
    if rate <= 0:
        return 0, np.ones(1)
    spread = 12 * math.sqrt(rate) + 40
    low = max(0, int(rate - spread))
    return low, np.cumsum([math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(low, int(rate + spread))])


@F.pandas_udf(T.LongType())
def _draws(rates: pd.Series, u: pd.Series) -> pd.Series:
    """For each rate and uniform number, how many k have P(X <= k) at most that number."""
    out = np.zeros(len(rates), np.int64)
    rate, of = np.unique(rates.to_numpy(), return_inverse=True)
    for i, r in enumerate(rate):
        low, cdf = _poisson_cdf(float(r))
        own = of == i
        out[own] = low + np.searchsorted(cdf, u.to_numpy()[own], side="right")
    return pd.Series(out)


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """source, n_docs, chars, weight, rate: rate is the mean number of copies of each of the source's documents.

    The mixed corpus has epochs times as many characters as docs, dealt to sources by weights; without weights
    all sources weigh the same, and a source that weights doesn't name weighs nothing. Documents of null source
    are a source of their own; one with no characters at all keeps rate epochs.
    """
    stats = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    stats = stats.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0)))
    total = stats.agg(F.sum("weight").alias("weights"), F.sum("chars").alias("all_chars")).withColumn("one", F.lit(1))  # one row
    share = F.col("weight") / F.col("weights") * F.col("all_chars") * F.lit(float(epochs)) / F.col("chars")
    rate = F.when(F.col("chars") == 0, F.lit(float(epochs))).when(F.col("weights") > 0, share).otherwise(F.lit(0.0))
    return stats.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("source", "n_docs", "chars", "weight", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """Every document as often as its hash-seeded Poisson draw says, in globally shuffled order.

    The draw inverts the Poisson distribution of the source's rate at a uniform number hashed from doc_id and
    seed, so it is the same on every run and after every retry. Adds n_copies, copy (0, 1, ...), rate and
    mix_key, by which the rows are dealt out and sorted: partitions in turn are a uniform shuffle of all copies.
    Columns of docs with these names are replaced. Null doc_ids share one draw, as do rows that repeat a doc_id;
    null texts have no characters; an empty table stays empty.
    """
    spark = docs.sparkSession
    own = ("n_copies", "copy", "rate", "mix_key")
    rates = source_rates(docs, weights, epochs).select("source", "rate")
    known = rates.limit(RATES_BROADCAST + 1).collect()
    if len(known) <= RATES_BROADCAST:
        small = F.broadcast(spark.createDataFrame([tuple(r) for r in known], "of string, rate double"))
    else:
        small = rates.select(F.col("source").alias("of"), "rate")
    names = [c for c in docs.columns if c not in own]
    doc = [f"_d{i}" for i in range(len(names))]  # whatever names the columns have, they don't clash
    rows = docs.select(*[F.col(f"`{c}`").alias(d) for c, d in zip(names, doc)])
    rows = rows.join(small, F.col(doc[names.index("source")]).eqNullSafe(F.col("of")))
    ident = F.coalesce(F.col(doc[names.index("doc_id")]).cast("string"), F.lit("null"))
    u = hash_uniform(F.concat_ws(":", F.lit(str(seed)), ident))
    # the draw is part of the row before it multiplies: copies come in runs, so no array grows with a rate
    rows = rows.select(*doc, "rate", _draws("rate", u).alias("n_copies"))
    rows = rows.select(*doc, "rate", "n_copies", F.explode(F.when(F.col("n_copies") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n_copies") - 1, F.lit(RUN).cast("bigint")))).alias("first"))
    rows = rows.select(*doc, "rate", "n_copies", F.explode(F.sequence("first", F.least(F.col("first") + RUN, F.col("n_copies")) - 1)).alias("copy"))
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(str(seed)), ident, F.col("copy").cast("string"))))
    out = rows.select(*[F.col(d).alias(c) for c, d in zip(names, doc)], "n_copies", "copy", "rate", "mix_key")
    return out.repartition(partitions(spark), "mix_key").sortWithinPartitions("mix_key")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.col("n_copies").cast("long").alias("n_copies"), F.col("copy").cast("long").alias("copy"), "mix_key")


#: Shared with the pipeline's SQL: the copies of each document of a relation named docs.
MIX_SQL = f"""
stats as (select source, sum(coalesce(length(text), 0)) as chars from docs group by source),
rates as (select source, case when chars = 0 then 1.0::double else (1.0::double / (select count(*) from stats where chars > 0)) * (select sum(chars) from stats)::double / chars::double end as rate from stats),
steps as (select source, k, sum(exp(-rate + k * ln(rate) - (case when k = 0 then 0 else lgamma(k + 1) end))) over (partition by source order by k) as cdf
  from (select source, rate, unnest(range(0, cast(floor(rate + 12 * sqrt(rate) + 40) as bigint))) as k from rates)),
drawn as (select d.*, ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13))::bigint / 4503599627370496.0::double as u from docs d),
counts as (select source, list(cdf order by k) as cdf from steps group by source),
copies as (select d.*, len(list_filter(c.cdf, lambda x: x <= d.u)) as n_copies from drawn d join counts c on d.source is not distinct from c.source),
mixed as (select * exclude (u), unnest(range(0, n_copies)) as copy from copies)
"""

ORACLE_SQL = f"""
with docs as (select * from documents), {MIX_SQL}
select doc_id, text, lang, source, n_chars, n_copies, copy, md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || cast(copy as varchar)) as mix_key
from mixed
"""
