"""Streaming forms of the bar operators. A series is (exchange, symbol).

Folds keep a series' total order if its micro-batches come in order, or whatever they come in if `late` is given: then rows wait in
the state until the watermark has passed them (an event-time timer wakes a series that gets no rows), so what comes out is the batch
result for all rows that are not later than `late`, and later ones are left out. What waits is bounded by the rows of that time.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.windows import SERIES

KEYS = "exchange string, symbol string"


def time_bars(ticks: DataFrame, every: str, late: str) -> DataFrame:
    """Time bars in append mode; rows later than `late` are left out."""
    at = F.struct("ts", "seq")
    bars = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = bars.groupBy(*SERIES, F.window("ts", every).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"),
    )
    return bars.select(*SERIES, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n")


def _in_order(rows: DataFrame, fold, schema: str, late: str | None) -> DataFrame:
    """An ordered fold over the series of a stream: `fold(key, kept, rows)` gives what it remembers (None at first) and output rows, of
    (ts, seq, ...) tuples in order."""
    import pickle

    names = [part.split()[0] for part in schema.split(", ")]
    columns = [c for c in rows.columns if c not in SERIES]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, kept = pickle.loads(state.get[0]) if state.exists else ([], None)
        at = state.getCurrentWatermarkMs() if late is not None else 0
        mark = pd.Timestamp(at, unit="ms") if at else pd.Timestamp.min
        for pdf in [] if state.hasTimedOut else batches:
            waiting += [r for r in pdf[columns].itertuples(index=False, name=None) if r[0] > mark]
        ripe = waiting
        if late is not None:
            ripe, waiting = [r for r in waiting if r[0] <= mark], [r for r in waiting if r[0] > mark]
        kept, out = fold(key, kept, sorted(ripe, key=lambda r: r[:2]))
        state.update((pickle.dumps((waiting if late is not None else [], kept)),))
        if late is not None and waiting:
            state.setTimeoutTimestamp(max(int(min(r[0] for r in waiting).value // 1_000_000), at + 1))
        yield pd.DataFrame(out, columns=names)

    if late is not None:
        rows = rows.withWatermark("ts", late)
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(*SERIES).applyInPandasWithState(run, schema, "kept binary", "append", timeout)


def unit_bars(ticks: DataFrame, measure: str, unit: float, late: str | None = None) -> DataFrame:
    """Volume or imbalance bars, summed per ts as in batch but without sums of 0 (without `late` a ts that two micro-batches share gives a row in each).

    What a series remembers is its exact running sum, in units of 1e-10: it has no largest value.
    """
    whole = int(Decimal(str(unit)).scaleb(10))

    def fold(key, kept, rows):
        total, seen = kept or (0, False)
        made: dict = {}
        for ts, _, m in rows:
            before, total = total // whole, total + (0 if m is None else int(m.scaleb(10)))
            if seen:
                made[ts] = made.get(ts, 0) + total // whole - before
            seen = True
        return (total, seen), [(*key, ts, n) for ts, n in made.items() if n]

    rows = ticks.select(*SERIES, F.col("ts").cast("timestamp").alias("ts"), "seq", F.expr(measure).cast("decimal(38,10)").alias("m"))
    return _in_order(rows, fold, f"{KEYS}, ts timestamp, volume_size long", late)


def upsert_sink(stream: DataFrame, path: str, keys: list[str], partition: str, late: str):
    """A stream into a partitioned table: rows of the same keys within `late` are taken once, and a later row of keys replaces the
    stored one. Returns the writer, to be started with a checkpoint."""
    from tickloom.operators.store import write_upsert

    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return once.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else write_upsert(batch, path, keys, partition))


def publish(stream: DataFrame, subscriptions: DataFrame, sink):
    """Rows of subscribed symbols as JSON, handed to `sink(batch, epoch)`."""
    keys = [c for c in SERIES if c in subscriptions.columns and c in stream.columns]
    rows = stream.join(subscriptions.select(*keys).distinct(), keys)
    return rows.select(*keys, F.to_json(F.struct(*rows.columns)).alias("json")).writeStream.foreachBatch(sink)


def sequence_bars(ticks: DataFrame, measure: str, unit: float, late: str | None = None) -> DataFrame:
    """Run bars, one row each (not summed by ts); what a series remembers is its two one-sided sums, exact in units of 1e-10."""
    goal = int(Decimal(str(unit)).scaleb(10))

    def fold(key, kept, rows):
        (up, down), out = kept or (0, 0), []
        for ts, _, m in rows:
            m = 0 if m is None else int(m.scaleb(10))
            up, down = up + max(m, 0), down + max(-m, 0)
            if up >= goal or down >= goal:
                out.append((*key, ts, 1 if up >= goal else -1))
                up = down = 0
        return (up, down), out

    rows = ticks.select(*SERIES, F.col("ts").cast("timestamp").alias("ts"), "seq", F.expr(measure).cast("decimal(38,10)").alias("m"))
    return _in_order(rows, fold, f"{KEYS}, ts timestamp, sequence int", late)


def delta_sampling(ticks: DataFrame, value: str, delta: float, late: str | None = None) -> DataFrame:
    """Rows where the value has drifted `delta` or more from the last row kept, which is what a series remembers."""

    def fold(key, last, rows):
        out = []
        for ts, seq, v in rows:
            if last is None or abs(v - last) >= delta:
                last = v
                out.append((*key, ts, seq, v))
        return last, out

    rows = ticks.where(F.col(value).isNotNull()).select(*SERIES, F.col("ts").cast("timestamp").alias("ts"), "seq", F.col(value).cast("double").alias("v"))
    return _in_order(rows, fold, f"{KEYS}, ts timestamp, seq long, {value} double", late)


def best_prices(l2: DataFrame, late: str | None = None) -> DataFrame:
    """Best bid and ask after each level update; the state is the day and its price levels by side, which start anew each day."""

    def fold(key, kept, rows):
        day, bids, asks = kept or (None, (), ())
        book, out = {1: set(bids), -1: set(asks)}, []
        for ts, seq, price, size, count in rows:
            if ts.date() != day:
                day, book = ts.date(), {1: set(), -1: set()}
            side = 1 if size > 0 else -1
            if count:
                book[side].add(price)
                book[-side] = {p for p in book[-side] if (p - price) * side > 0}
            else:
                book[side].discard(price)
            out.append((*key, ts, seq, float(max(book[1], default="nan")), float(min(book[-1], default="nan"))))
        return (day, tuple(book[1]), tuple(book[-1])), out

    rows = l2.select(*SERIES, F.col("ts").cast("timestamp").alias("ts"), "seq", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), F.col("count").cast("int").alias("count"))
    return _in_order(rows, fold, f"{KEYS}, ts timestamp, seq long, best_bid double, best_ask double", late)


def scored(ticks: DataFrame, every: str, late: str, edges: dict[str, list[float]], model, out: str = "prediction") -> DataFrame:
    """Time bars, their columns as bin codes, and a fitted pyspark.ml model's prediction for each; stateless after the bars."""
    from tickloom.operators.binning import coded

    bars = time_bars(ticks, every, late)
    return model.transform(coded(bars, edges)).select(*SERIES, "ts", *edges, out)
