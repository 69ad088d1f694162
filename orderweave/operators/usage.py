"""Usage totals, latest entries, limits and trailing sums."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.operators.joins import all_of, with_constant
from orderweave.session import stored

PERIODS = tuple(fv.PERIOD_SECONDS)


def _since(as_of: datetime, period: str) -> Column:
    return F.lit(as_of - timedelta(seconds=fv.PERIOD_SECONDS[period])).cast("timestamp")


def _selected(usages: DataFrame, as_of: datetime, period: str | None, path: str | None
              ) -> DataFrame:
    wanted = usages if period is None else usages.where(
        F.col("timestamp") >= _since(as_of, period))
    return wanted if path is None else wanted.where(F.col("path") == path)


def usage_totals(usages: DataFrame, as_of: datetime, period: str | None = None,
                 path: str | None = None) -> DataFrame:
    """One row: tokens and cost of the trailing period, zero when nothing is found."""
    return _selected(usages, as_of, period, path).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def usage_by_path(usages: DataFrame, as_of: datetime, period: str) -> DataFrame:
    return _selected(usages, as_of, period, None).groupBy("path").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def usage_latest(usages: DataFrame, as_of: datetime, period: str | None = None,
                 path: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; a limited list is a top-k and never sorts the whole table."""
    found = _selected(usages, as_of, period, path).orderBy(F.desc("timestamp"), F.desc("id"))
    return found if limit is None else found.limit(limit)


def limit_check(usages: DataFrame, limits: DataFrame, as_of: datetime) -> DataFrame:
    """May a path go on? One verdict per path known from usages or limits.

    A path passes while its own and the overall usage stay below every set limit of
    all three periods. Usage is summed once for all periods; the overall sums come
    from the sums per path.
    """
    def within(period: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(
            F.col("timestamp") >= _since(as_of, period), F.col(column))), F.lit(0))

    recent = usages.where(F.col("timestamp") >= _since(as_of, "monthly"))
    sums = recent.groupBy("path").agg(*[
        within(p, c).alias(f"{p}_{c}") for p in PERIODS for c in ("tokens", "cost")])
    overall = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                         for c in sums.columns if c != "path"])

    def long(df: DataFrame, scope: Column) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"{p}_tokens").alias("tokens"),
                                  F.col(f"{p}_cost").cast("double").alias("cost"))
                         for p in PERIODS])
        return df.select(scope.alias("path"), F.inline(rows))

    passes = all_of([
        F.coalesce(F.coalesce(F.col("cost"), F.lit(0.0)) < F.col("max_cost"), F.lit(True)),
        F.coalesce(F.coalesce(F.col("tokens"), F.lit(0)) < F.col("max_tokens"), F.lit(True))])
    own = (
        limits.where(F.col("path").isNotNull())
        .join(long(sums, F.col("path")), ["period", "path"], "left")
        .groupBy("path").agg(F.bool_and(passes).alias("own")))
    overall_use = long(overall, F.lit(None).cast("string")).drop("path")
    # At most one overall limit per period: three rows, then one.
    overall_ok = (
        limits.where(F.col("path").isNull()).drop("path").join(overall_use, "period", "left")
        .agg(F.coalesce(F.bool_and(passes), F.lit(True)).alias("overall")))
    paths = (usages.select("path").distinct()
             .unionByName(limits.select("path")).where(F.col("path").isNotNull()).distinct())
    verdict = with_constant(paths.join(own, "path", "left"), overall_ok)
    return verdict.select("path", (F.coalesce("own", F.lit(True)) & F.col("overall"))
                          .alias("available"))


def set_limits(limits: DataFrame, new: DataFrame) -> DataFrame:
    """Set or replace limits by (period, path); a NULL path is the overall limit."""
    from orderweave.operators.tables import merge_rows
    return merge_rows(limits, new, ["period", "path"], "replace")[0]


def delete_limits(limits: DataFrame, gone: DataFrame) -> DataFrame:
    return limits.join(gone, (limits["period"] == gone["period"])
                       & limits["path"].eqNullSafe(gone["path"]), "left_anti")


_SCOPE = ["overall", "path"]


def _equal(left: str, right: str, columns: list[str]) -> Column:
    """Equal columns of two aliased tables; NULLs equal each other."""
    return all_of(F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns)


_MICROS = 1_000_000
#: Costs count in units of 1e-9; running totals may wrap around, their differences do not.
_UNITS = 1_000_000_000


def _instants(usages: DataFrame) -> DataFrame:
    """overall, path, at, tokens, units: sums per distinct instant, per path and over all."""
    per_path = usages.groupBy("path", F.unix_micros("timestamp").alias("at")).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"),
        (F.coalesce(F.sum(F.col("cost").cast("decimal(28,9)")), F.lit(0)) * _UNITS).cast("bigint").alias("units"))
    overall = per_path.groupBy("at").agg(F.sum("tokens").alias("tokens"), F.sum("units").alias("units"))
    columns = ["at", "tokens", "units"]
    return per_path.select(F.lit(False).alias("overall"), "path", *columns).unionByName(
        overall.select(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("path"), *columns))


def _chunk_ends(instants: DataFrame, chunk_rows: int) -> list[int]:
    """Instants that end chunks of time; one number per chunk, with about equally many instants each."""
    overall = instants.where("overall")
    chunks = max(1, -(-overall.count() // chunk_rows))
    if chunks == 1:
        return []
    return sorted(set(overall.agg(F.percentile_approx("at", [i / chunks for i in range(1, chunks)], 10_000)).first()[0]))


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row the instants of a list column, and tokens and units from each instant on."""
    lists = batch.column(batch.schema.get_field_index(name))
    ends, items = lists.offsets.to_numpy(), lists.values
    at, tokens, units = (items.field(c).to_numpy(zero_copy_only=False) for c in ("at", "tokens", "units"))
    for first, last in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield at[first:last], *(np.append(np.cumsum(v[first:last][::-1])[::-1], 0) for v in (tokens, units))


def _wrapped(value) -> np.int64:
    return np.int64((int(value) + (1 << 63)) % (1 << 64) - (1 << 63))


def _trailing_of_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a scope: the trailing sums at its instants.

    A sum up to an instant is what came before the chunk plus what stands in it up to there. The sum
    before a period's start is what came through the last chunk in which starts can lie, less what
    these chunks hold from the start on.
    """
    names = [*_SCOPE, "at", *[f"{p}_{c}" for p in PERIODS for c in ("tokens", "units")]]
    for batch in batches:
        known = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if not n.startswith("items")}
        own = _lists(batch, "items")
        past = [_lists(batch, f"items_{p}") for p in PERIODS]
        for row, ((at, *own_sums), *starts) in enumerate(zip(own, *past, strict=True)):
            columns = [pa.array([known["overall"][row]] * len(at), pa.bool_()), pa.array([known["path"][row]] * len(at), pa.string()), pa.array(at)]
            for period, (then, *past_sums) in zip(PERIODS, starts, strict=True):
                start = np.searchsorted(then, at - fv.PERIOD_SECONDS[period] * _MICROS, side="left")
                for c, inside, earlier in zip(("tokens", "units"), own_sums, past_sums, strict=True):
                    up_to = _wrapped(known[f"before_{c}"][row]) + inside[0] - inside[1:]
                    columns.append(pa.array(up_to - (_wrapped(known[f"{c}_{period}"][row]) - earlier[start])))
            yield pa.RecordBatch.from_arrays(columns, names=names)


def usage_trailing(usages: DataFrame, chunk_rows: int = 20_000) -> DataFrame:
    """Tokens and cost of the trailing minute, day and 30 days at every entry.

    Per path and over all paths, without one task per path or minute: sums per distinct instant
    are gathered into chunks of time with about ``chunk_rows`` instants over all paths. A chunk of a
    scope is one row, which starts with the sums of all chunks before. A trailing sum is the difference of
    two running totals; the one at a period's start is found in the few chunks that the starts of
    a chunk's instants fall into. So instants are shuffled, once, and not marks for each start.
    Costs are summed as whole billionths, so differences are exact, for periods of up to nine
    billion. Entries without a path are a
    scope of their own; entries of one instant have equal sums.
    """
    instants = stored(_instants(usages), "usage-instants")
    ends = np.array(_chunk_ends(instants, chunk_rows), np.int64)

    @F.pandas_udf("int")
    def chunk_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, at.to_numpy(), side="left").astype(np.int32))

    packed = instants.withColumn("chunk", chunk_of("at")).groupBy(*_SCOPE, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("at", "tokens", "units"))).alias("items"))
    big = "decimal(38,0)"
    total = lambda c: F.aggregate("items", F.lit(0).cast(big), lambda s, x: (s + x[c]).cast(big))
    packed = stored(packed.withColumns({"tokens": total("tokens"), "units": total("units")}), "usage-chunks")
    # For each chunk and period the chunks in which the starts of its instants lie.
    reach = packed.select(*_SCOPE, "chunk", F.get("items.at", F.lit(0)).alias("low"), F.element_at("items.at", -1).alias("high"),
                          F.posexplode(F.array(*[F.lit(s * _MICROS) for s in fv.PERIOD_SECONDS.values()])).alias("period", "span"))
    reach = stored(reach.select(*_SCOPE, "chunk", "period", chunk_of(F.col("low") - F.col("span")).alias("first"),
                                chunk_of(F.col("high") - F.col("span")).alias("last")), "usage-reach")
    # Totals through a chunk: rows of chunks and questions in one order, a few per chunk and scope.
    none = F.lit(None).cast("int")
    zero = F.lit(0).cast(big)
    steps = packed.select(*_SCOPE, "chunk", F.lit(0).alias("turn"), none.alias("of"), none.alias("period"), "tokens", "units").unionByName(
        packed.select(*_SCOPE, (F.col("chunk") - 1).alias("chunk"), F.lit(1).alias("turn"), F.col("chunk").alias("of"),
                      none.alias("period"), zero.alias("tokens"), zero.alias("units"))).unionByName(
        reach.select(*_SCOPE, F.col("last").alias("chunk"), F.lit(1).alias("turn"), F.col("chunk").alias("of"), "period",
                     zero.alias("tokens"), zero.alias("units")))
    so_far = Window.partitionBy(*_SCOPE).orderBy("chunk", "turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    through = steps.withColumns({c: F.sum(c).over(so_far).cast(big) for c in ("tokens", "units")}).where("turn = 1")
    parts = reach.withColumn("source", F.explode(F.sequence("first", "last")))
    q, h = parts.alias("q"), packed.select(*_SCOPE, F.col("chunk").alias("source"), "items").alias("h")
    sources = q.join(h, _equal("q", "h", [*_SCOPE, "source"])).select("q.*", "h.items").groupBy(*_SCOPE, "chunk", "period").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source", "items"))), lambda x: x["items"])).alias("items"))
    asked = through.where("period IS NOT NULL").select(*_SCOPE, F.col("of").alias("chunk"), "period", "tokens", "units")
    s, t = sources.alias("s"), asked.alias("t")
    nothing = F.array().cast("array<struct<at: bigint, tokens: bigint, units: bigint>>")
    answered = t.join(s, _equal("t", "s", [*_SCOPE, "chunk", "period"]), "left").select("t.*", F.coalesce("s.items", nothing).alias("items"))
    of_period = lambda i, c: F.first(F.when(F.col("period") == i, F.col(c)), True)
    by_chunk = answered.groupBy(*_SCOPE, "chunk").agg(*[
        of_period(i, c).alias(f"{c}_{period}") for i, period in enumerate(PERIODS) for c in ("tokens", "units", "items")])
    before = through.where("period IS NULL").select(*_SCOPE, F.col("of").alias("chunk"), F.col("tokens").alias("before_tokens"),
                                                    F.col("units").alias("before_units"))
    p, b, c = packed.select(*_SCOPE, "chunk", "items").alias("p"), before.alias("b"), by_chunk.alias("c")
    cells = p.join(b, _equal("p", "b", [*_SCOPE, "chunk"])).join(c, _equal("p", "c", [*_SCOPE, "chunk"])).select(
        "p.overall", "p.path", "p.items", "b.before_tokens", "b.before_units",
        *[f"c.{c}_{period}" for period in PERIODS for c in ("tokens", "units", "items")])
    names = [f"{p}_{c}" for p in PERIODS for c in ("tokens", "units")]
    sums = cells.mapInArrow(_trailing_of_chunk, "overall boolean, path string, at long, " + ", ".join(f"{n} long" for n in names))
    sums = stored(sums, "usage-trailing")
    shown = lambda prefix: [(F.col(f"{p}_tokens") if c == "tokens" else (F.col(f"{p}_units").cast("decimal(28,0)") / _UNITS).cast("double"))
                            .alias(f"{prefix}_{p}_{c}") for p in PERIODS for c in ("tokens", "cost")]
    entries = usages.select("id", F.col("path").alias("own_path"), F.unix_micros("timestamp").alias("own_at"))
    of_path = sums.where("not overall").select(F.col("path").alias("p_path"), F.col("at").alias("p_at"), *shown("path"))
    of_all = sums.where("overall").select(F.col("at").alias("own_at"), *shown("all"))
    found = entries.join(of_path, (F.col("own_at") == F.col("p_at")) & F.col("own_path").eqNullSafe(F.col("p_path"))).join(of_all, "own_at")
    return found.select("id", *[f"{prefix}_{p}_{c}" for prefix in ("path", "all") for p in PERIODS for c in ("tokens", "cost")])
