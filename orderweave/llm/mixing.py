"""Mixing of sources to target weights by Poisson replication, in DataFrame functions only.

A source of ``size`` characters that shall make up the share ``w`` of ``total * epochs``
characters is repeated ``rate = w * total * epochs / size`` times on average. Each document
draws its own number of copies: a uniform number from a hash of seed and doc_id goes through
the inverted Poisson distribution with that mean. So the result does not depend on order,
partitions or restarts, and no count of other documents is needed. The copies get a random
key of their own, by which they are dealt to partitions and sorted: one shuffle, after which
the row order is random over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderweave.session import stored

#: A larger mean is drawn as a sum of equal Poisson parts of at most this mean, with TERMS terms
#: of the distribution each; what lies beyond them has a probability below 1e-20.
PART, TERMS = 16, 80
#: Exponent of the default weights: shares in proportion to size ** ALPHA.
ALPHA = 0.7


def uniform(text: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """source, size, rate, parts, cdf: one row per source; null is a source like others.

    A document counts as its characters plus one, so that no source has size 0. weights: share
    of each source, in any unit; sources that are not named get none.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) + 1).cast("double").alias("size"))
    if weights is None:
        share = F.pow("size", F.lit(alpha))
    else:
        share = F.lit(0.0)
        for source, weight in weights.items():
            share = F.when(F.col("source") == source, F.lit(float(weight))).otherwise(share)
    sizes = stored(sizes.withColumn("share", share), "mixing-sizes")
    whole = sizes.agg(F.sum("size").alias("total"), F.sum("share").alias("shares"))
    rated = sizes.withColumns({
        "total": whole.select("total").scalar(), "shares": whole.select("shares").scalar()})
    rated = rated.withColumn("rate", F.coalesce(F.expr(f"share / nullif(shares, 0) * total * {float(epochs)!r}D / size"), F.lit(0.0)))
    rated = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    cdf = (f"aggregate(sequence(1, {TERMS}), named_struct('p', exp(-rate / parts), 'c', exp(-rate / parts), 'all', array(exp(-rate / parts))), "
           "(a, k) -> named_struct('p', a.p * (rate / parts) / k, 'c', a.c + a.p * (rate / parts) / k, "
           "'all', concat(a.all, array(a.c + a.p * (rate / parts) / k))), a -> a.all)")
    return rated.select("source", "size", "rate", "parts", F.expr(cdf).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0,
        seed: int = 17) -> DataFrame:
    """The columns of docs, copy (from 1) and shuffle_key: each document as often as drawn.

    docs: doc_id, text, source and any other columns, which go along; columns named copy and
    shuffle_key are replaced. Rows of a source without weight do not appear. Null text counts
    one character. A row without doc_id draws by a hash of its text. Rows that repeat a doc_id
    draw the same number each. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    found = stored(rates(docs, weights, alpha, epochs), "mixing-rates")
    rate = found.select(F.col("source").alias("r_source"), F.col("parts").alias("r_parts"), F.col("cdf").alias("r_cdf"))
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                       F.col("source").cast("string").alias("m_source"), F.concat(F.lit(f"{seed}:"), who).alias("m_who"))
    rows = rows.join(rate, F.col("m_source").eqNullSafe(F.col("r_source")))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("r_parts")), F.lit(0),
        lambda sum_, j: sum_ + F.size(F.filter("r_cdf", lambda c: c <= uniform(F.concat("m_who", F.lit(":"), j.cast("string"))))))
    rows = rows.withColumn("m_n", draw).where("m_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m_n"))))
    key = F.conv(F.substring(F.md5(F.concat("m_who", F.lit("#"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    out = rows.withColumn("shuffle_key", key).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "copy", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = r"""
with recursive s as (select source, sum(coalesce(length(text), 0) + 1)::double as size from documents group by 1),
r as (select source, size, pow(size, 0.7) / (select sum(pow(size, 0.7)) from s) * (select sum(size) from s) * 1.0::double / size as rate from s),
p as (select source, greatest(ceil(rate / 16), 1)::int as parts, rate / greatest(ceil(rate / 16), 1)::int as l from r),
t as (select source, parts, l, 0 as k, exp(-l) as p, exp(-l) as c from p
      union all select source, parts, l, k + 1, p * l / (k + 1), c + p * l / (k + 1) from t where k < 80),
u as (select doc_id, d.source, j, ('0x' || md5('17:' || doc_id || ':' || j)[1:13])::bigint / 4503599627370496.0::double as u
      from documents d join p on d.source is not distinct from p.source, lateral (select unnest(range(1, parts + 1)) as j)),
n as (select doc_id, count(*)::int as n from u join t on u.source is not distinct from t.source and t.c <= u.u group by 1)
select d.*, copy::int as copy, ('0x' || md5('17:' || doc_id || '#' || copy)[1:15])::bigint as shuffle_key
from documents d join n using (doc_id), lateral (select unnest(range(1, n + 1)) as copy)
"""
