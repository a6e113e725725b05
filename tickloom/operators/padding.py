"""Gapless volume bars: values of ticks that a single large deal skipped.

A gap and the bar that ends it form an island, named by that bar's number; a gap's neighbours are the bar before and the bar after.
All steps are running frames or aggregates over islands, in the order of `pad`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import bfill, carried, ffill

ORDER = ("volume_tick",)
#: Tick numbers that are made, and carried over, together.
CHUNK = 4096


def spine(bars: DataFrame) -> DataFrame:
    """Every tick number from the first to the last of a symbol; bars where there are some, nulls in gaps."""
    ends = bars.groupBy("exchange", "symbol").agg(F.min("volume_tick").alias("a"), F.max("volume_tick").alias("z"))
    chunks = ends.select("exchange", "symbol", "z", F.explode(F.sequence("a", "z", F.lit(CHUNK).cast("long"))).alias("a"))
    every = chunks.select("exchange", "symbol", F.explode(F.sequence("a", F.least(F.col("z"), F.col("a") + CHUNK - 1))).alias("volume_tick"))
    full = every.join(bars.withColumn("__bar", F.col("volume_tick")), ["exchange", "symbol", "volume_tick"], "left")
    full = carried(full, {"island": ("next", F.col("__bar"))}, chunk=F.floor(F.col("volume_tick") / CHUNK), order=ORDER)
    return full.withColumn("gap", F.col("__bar").isNull()).drop("__bar")


def next_open(df: DataFrame) -> DataFrame:
    """Prices of empty ticks are the next open; their time is the next time."""
    later = bfill("open", order=ORDER)
    return df.withColumns({c: F.coalesce(c, later) for c in ("open", "high", "low", "close")} | {"ts": bfill("ts", order=ORDER)})


def open_then_close(df: DataFrame) -> DataFrame:
    """Prices back-filled from the open into all four, then forward-filled from the close."""
    names = ("open", "high", "low", "close")
    back = df.withColumns({c: F.coalesce(c, bfill("open", order=ORDER)) for c in names})
    return back.withColumns({c: F.coalesce(c, ffill("close", order=ORDER)) for c in names})


def spread_totals(df: DataFrame, totals: list[str], counts: list[str]) -> DataFrame:
    """The ending bar's totals in equal whole parts over its island; counts are 1 at least where they are not 0."""
    inside = Window.partitionBy("exchange", "symbol", "island")
    ticks = F.count(F.lit(1)).over(inside)
    whole = lambda c: F.max(c).over(inside)  # noqa: E731  one bar of an island has a value
    parts = {c: F.floor(whole(c) / ticks).cast("long") for c in totals}
    parts |= {c: F.when(whole(c) > 0, F.floor(F.greatest(whole(c) / ticks, F.lit(1.0)))).otherwise(0).cast("long") for c in counts}
    return df.withColumns(parts)


def hold_sizes(df: DataFrame, price: str, sizes: list[str], equal_only: bool) -> DataFrame:
    """Sizes carried into gaps from the bar before; with `equal_only` just where both neighbours have the same price."""
    bar_price = F.when(~F.col("gap"), F.col(price))
    same = ffill(bar_price, order=ORDER) == bfill(bar_price, order=ORDER)
    carry = {c: F.coalesce(c, F.when(same, ffill(c, order=ORDER)) if equal_only else ffill(c, order=ORDER)) for c in sizes}
    return df.withColumns(carry)


def sync_sides(df: DataFrame, bid: str, ask: str) -> DataFrame:
    """A removed size that is null on one side and known on the other is 0."""
    return df.withColumns({bid: F.when(F.col(bid).isNull() & F.col(ask).isNotNull(), 0).otherwise(F.col(bid)), ask: F.when(F.col(ask).isNull() & F.col(bid).isNotNull(), 0).otherwise(F.col(ask))})


def fill_spread(df: DataFrame) -> DataFrame:
    return df.withColumns({"spread_high": F.coalesce("spread_high", F.col("ask_high") - F.col("bid_low")), "spread_low": F.coalesce("spread_low", F.col("ask_low") - F.col("bid_high"))})


def from_trades(df: DataFrame) -> DataFrame:
    """Ticks with one-sided trades and no quote take that side's quote prices and removed size from the deal; its size, where the frame has one, is 0."""
    none = F.col("bid_close").isNull() & F.col("ask_close").isNull()
    sold = none & (F.col("volume_sell") > 0) & (F.col("volume_buy") == 0)
    bought = none & (F.col("volume_buy") > 0) & (F.col("volume_sell") == 0)
    cols = {}
    for side, test, volume in (("bid", sold, "volume_sell"), ("ask", bought, "volume_buy")):
        cols |= {f"{side}_{c}": F.when(test, F.col(c)).otherwise(F.col(f"{side}_{c}")) for c in ("open", "high", "low", "close")}
        cols[f"{side}_size_removed"] = F.when(test, F.col(volume)).otherwise(F.col(f"{side}_size_removed"))
        if f"{side}_size" in df.columns:
            cols[f"{side}_size"] = F.when(test, 0).otherwise(F.col(f"{side}_size"))
    return df.withColumns(cols)


ADDED = ("bid_size_added", "bid_size_added_count", "ask_size_added", "ask_size_added_count")


def added_defaults(df: DataFrame) -> DataFrame:
    """Added sizes and counts that are null are 0."""
    return df.fillna({c: 0 for c in ADDED if c in df.columns})


def removed_by_trades(df: DataFrame) -> DataFrame:
    """Where there are trades and no quote, a buy's volume and count are removed from the ask, a sale's from the bid; quote sizes
    are carried forward in ticks that have trades."""
    deal, none = F.col("n").isNotNull(), F.col("bid_close").isNull() & F.col("ask_close").isNull()
    cols = {}
    for side, flow in (("ask", "buy"), ("bid", "sell")):
        cols[f"{side}_size_removed"] = F.when(deal & none, F.col(f"volume_{flow}")).otherwise(F.col(f"{side}_size_removed"))
        cols[f"{side}_size_removed_count"] = F.when(deal & none, F.col(f"count_{flow}")).otherwise(F.col(f"{side}_size_removed_count"))
        cols[f"{side}_size"] = F.coalesce(f"{side}_size", F.when(deal, ffill(F.when(deal, F.col(f"{side}_size")), order=ORDER)))
    return df.withColumns(cols)


def totals(df: DataFrame) -> DataFrame:
    """Null totals are buy + sell; the mean is volume by count."""
    n, v = F.coalesce("n", F.col("count_buy") + F.col("count_sell")), F.coalesce("volume", F.col("volume_buy") + F.col("volume_sell"))
    return df.withColumns({"n": n, "volume": v, "volume_mean": v / F.nullif(n, F.lit(0))})


def pad(bars: DataFrame) -> DataFrame:
    """Deal bars without gaps."""
    rows = next_open(spine(bars))
    rows = spread_totals(rows, ["volume_buy", "volume_sell"], ["count_buy", "count_sell"])
    return totals(rows.withColumns({"n": F.lit(None).cast("long"), "volume": F.lit(None).cast("long")}))
