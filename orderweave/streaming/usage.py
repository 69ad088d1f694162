"""Usage sums over event time windows and alerts when a limit is crossed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orderweave import fixed_values as fv

#: What a query with ``usage_alerts`` has to run with: its state needs this store.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_DAY = 86_400
#: Costs are added up in millionths, so that sums do not depend on their order.
_UNITS = 1_000_000
_PERIODS = tuple(fv.PERIOD_SECONDS)
_ALERTS = ("path string, overall boolean, period string, seconds bigint, tokens bigint, "
           "cost double, over boolean")


def _timed(stream: DataFrame, ticks: DataFrame | None, delay: str) -> DataFrame:
    """Usages with a watermark, which ticks move too.

    The filter that takes ticks out again refers to the event time, as the optimizer would
    move it before the watermark otherwise.
    """
    marked = stream.withColumn("is_usage", F.lit(True))
    if ticks is not None:
        marked = marked.unionByName(ticks.select("timestamp", F.lit(False).alias("is_usage")),
                                    allowMissingColumns=True)
    return marked.withWatermark("timestamp", delay).where(
        F.when(F.col("is_usage"), F.col("timestamp")).isNotNull()).drop("is_usage")


def usage_windows(stream: DataFrame, width: str = "1 minute", delay: str = "10 minutes",
                  ticks: DataFrame | None = None) -> DataFrame:
    """Tokens and cost per path and window; append mode, late entries up to ``delay``.

    ticks: a stream of ``timestamp``; they count as no usage but move the watermark, so that
    windows close although no usage follows.
    """
    return (
        _timed(stream, ticks, delay)
        .groupBy(F.window("timestamp", width).alias("w"), "path")
        .agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "path", "tokens", "cost"))


class LimitWatch(StatefulProcessor):
    """Trailing sums of one scope at every instant where they can change.

    A sum changes at the end of a minute with usages, and when such a minute leaves the period.
    All minutes up to the watermark are known, so each call judges the instants from the
    last one to the watermark, in order. While a period is over its limit a timer stands at the
    instant when its oldest minute leaves, so it comes back without any new usage. The state
    holds one entry per minute of the longest period, filed by day, however many usages
    there are.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState(
            "days", "day bigint", "ends array<bigint>, tokens array<bigint>, costs array<bigint>")
        self.over = handle.getMapState("over", "period string", "flag boolean")
        self.known = handle.getValueState("known", "until bigint, limits array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues
                        ) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        limits = [float(arrived[f"{p}_{c}"].iloc[0]) for p in _PERIODS for c in ("max_tokens", "max_cost")]
        until = max(timerValues.getCurrentWatermarkInMs() // 1000, int(arrived["seconds"].max()))
        yield self._judged(key, arrived, limits, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.known.exists():
            yield self._judged(key, None, None, timerValues.getCurrentWatermarkInMs() // 1000)

    def _judged(self, key, arrived: pd.DataFrame | None, limits: list[float] | None, until: int) -> pd.DataFrame:
        """The crossings after the last judged instant, up to ``until``."""
        since, old_limits = self.known.get() if self.known.exists() else (-(1 << 62), None)
        limits = limits or old_limits
        minutes = self._with_arrived(arrived)
        ends = minutes["seconds"].to_numpy()
        tokens, costs = (np.concatenate([[0], np.cumsum(minutes[c].to_numpy())]) for c in ("tokens", "units"))
        was = {k[0]: v[0] for k, v in self.over.iterator()}
        out = []
        for i, (period, seconds) in enumerate(fv.PERIOD_SECONDS.items()):
            at = np.unique(np.concatenate([ends, ends + seconds]))
            at = at[(at > since) & (at <= until)]
            first, last = (np.searchsorted(ends, t, side="right") for t in (at - seconds, at))
            used_tokens, used_units = tokens[last] - tokens[first], costs[last] - costs[first]
            # A missing limit is NaN, which no sum reaches.
            over = (used_tokens >= limits[2 * i]) | (used_units / _UNITS >= limits[2 * i + 1])
            before = np.concatenate([[was.get(period, False)], over[:-1]]) if len(at) else over
            for j in np.flatnonzero(over != before):
                out.append((key[1], bool(key[0]), period, int(at[j]), int(used_tokens[j]),
                            float(used_units[j]) / _UNITS, bool(over[j])))
            if len(at):
                was[period] = bool(over[-1])
                self.over.updateValue((period,), (was[period],))
            inside = ends[ends > until - seconds]
            if was.get(period, False) and len(inside):
                self.handle.registerTimer(int(inside[0] + seconds) * 1000)
        self.known.update((max(until, since), limits))
        self._forget(until)
        return pd.DataFrame(out, columns=["path", "overall", "period", "seconds", "tokens", "cost", "over"])

    def _with_arrived(self, arrived: pd.DataFrame | None) -> pd.DataFrame:
        """All known minutes in order; days that changed are stored."""
        parts = [pd.DataFrame({"seconds": v[0], "tokens": v[1], "units": v[2]}) for _, v in self.days.iterator()]
        if arrived is not None:
            parts.append(arrived[["seconds", "tokens", "units"]])
        minutes = pd.concat(parts).astype("int64").groupby("seconds", as_index=False).sum() if parts else pd.DataFrame(
            {c: np.zeros(0, np.int64) for c in ("seconds", "tokens", "units")})
        if arrived is not None:
            changed = set(arrived["seconds"] // _DAY)
            for day, part in minutes.groupby(minutes["seconds"] // _DAY):
                if day in changed:
                    self.days.updateValue((int(day),), tuple(part[c].tolist() for c in ("seconds", "tokens", "units")))
        return minutes

    def _forget(self, until: int) -> None:
        oldest = (until - fv.PERIOD_SECONDS["monthly"]) // _DAY
        for day in [k[0] for k, _ in self.days.iterator()]:
            if day < oldest:
                self.days.removeKey((day,))

    def close(self) -> None:
        pass


def usage_alerts(stream: DataFrame, limits: DataFrame, delay: str = "10 minutes",
                 ticks: DataFrame | None = None) -> DataFrame:
    """``path, overall, period, at, tokens, cost, over``: every crossing of a limit, either way.

    One scope per path with a limit, and ``overall`` (path NULL) over all paths. Sums count whole
    minutes; ``at`` is the end of the minute that takes a sum to its limit, or the instant when
    a minute leaves the period and the sum falls below it. Usages are first summed per
    scope and minute, partly before the shuffle, so the keyed state sees one row per scope
    and minute even for a very hot path. ticks: as for ``usage_windows``. Run it with the
    settings ``ROCKSDB``.
    """
    scoped = _timed(stream, ticks, delay).select(
        "timestamp", "tokens", F.col("cost").cast("decimal(28,6)").alias("cost"),
        F.inline(F.array(F.struct(F.lit(False).alias("overall"), F.col("path")),
                         F.struct(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("path")))))
    sums = scoped.groupBy(F.window("timestamp", "1 minute").alias("w"), "overall", "path").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    # Periods are at most one row each per scope.
    wide = limits.groupBy(F.col("path").isNull().alias("limit_overall"), F.col("path").alias("limit_path")).agg(*[
        F.max(F.when(F.col("period") == p, F.col(c)).cast("double")).alias(f"{p}_{c}")
        for p in _PERIODS for c in ("max_tokens", "max_cost")])
    rows = sums.select(
        F.window_time("w").alias("minute"), "overall", "path", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
        (F.coalesce("cost", F.lit(0)) * _UNITS).cast("bigint").alias("units"), F.unix_seconds("w.end").alias("seconds")).join(
        wide, (F.col("overall") == F.col("limit_overall")) & F.col("path").eqNullSafe(F.col("limit_path")))
    found = rows.drop("limit_overall", "limit_path").groupBy("overall", "path").transformWithStateInPandas(
        LimitWatch(), _ALERTS, "append", "EventTime")
    return found.select("path", "overall", "period", F.timestamp_seconds("seconds").alias("at"), "tokens", "cost", "over")
