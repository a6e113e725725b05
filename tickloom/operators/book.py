"""Order book levels, their imbalance, and quote bars by volume tick."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.bars import best_prices, delta_sampling, size_delta
from tickloom.operators.windows import SERIES, carried, near

SIDES = {"bid": 1, "ask": -1}


def clean_updates(l2: DataFrame, distance: float) -> DataFrame:
    """Level updates with the best prices after them (carried forward, then backward) and their level, `distance` apart.

    Updates without price or size, or strictly between the best prices, are dropped; an update that empties a level has size 0;
    an ask under the best ask and a bid over the best bid change sides.
    """
    best = best_prices(l2.where("price IS NOT NULL AND size IS NOT NULL")).select(*SERIES, "ts", "seq", "best_bid", "best_ask")
    known = {f"__{c}_{k}": (k, F.col(c)) for c in ("best_bid", "best_ask") for k in ("last", "next")}
    best = carried(best, known).select(*SERIES, "ts", "seq", *[F.coalesce(f"__{c}_last", f"__{c}_next").alias(c) for c in ("best_bid", "best_ask")])
    rows = l2.join(best, [*SERIES, "ts", "seq"]).withColumn("price", F.col("price").cast("double"))
    rows = rows.where(~F.coalesce((F.col("best_bid") < F.col("price")) & (F.col("price") < F.col("best_ask")), F.lit(False)))
    side = F.when(F.col("size") > 0, 1).otherwise(-1)
    wrong = F.coalesce(F.when(side > 0, F.col("price") > F.col("best_bid")).otherwise(F.col("price") < F.col("best_ask")), F.lit(False))
    rows = rows.withColumns({"side": F.when(wrong, -side).otherwise(side), "size": F.when(F.col("count") == 0, 0).otherwise(F.col("size"))})
    near_side = F.when(F.col("side") > 0, F.col("best_bid") - F.col("price")).otherwise(F.col("price") - F.col("best_ask"))
    level = F.abs(F.bround(near_side / distance) + 1).cast("int")
    return rows.select(*SERIES, "ts", "seq", "side", "price", "size", "count", "best_bid", "best_ask", level.alias("level"))


def book_levels(updates: DataFrame, levels: int) -> DataFrame:
    """Size and count of each side's first levels at every ts (the last update of a ts), carried forward.

    `updates`: series, ts, seq, side, level, size, count. Rows begin where every level that ever occurs has begun; levels that
    never occur are 0. Columns `bid_1` ... `ask_n` are structs (size, count).
    """
    names = {f"{s}_{k}": (v, k) for s, v in SIDES.items() for k in range(1, levels + 1)}
    mine = lambda v, k: (F.col("side") == v) & (F.col("level") == k)
    value = F.struct(F.col("size").cast("double").alias("size"), F.col("count").cast("double").alias("count"))
    per = updates.where(F.col("level") <= levels).groupBy(*SERIES, "ts").agg(*[F.max_by(value, F.when(mine(*at), F.col("seq"))).alias(n) for n, at in names.items()])
    begun = per.groupBy(*SERIES).agg(*[F.min(F.when(F.col(n).isNotNull(), F.col("ts"))).alias(n) for n in names])
    begun = begun.select(*SERIES, F.greatest(*names).alias("__from"))
    rows = carried(per, {n: ("last", F.col(n)) for n in names}, order=("ts",))
    none = F.struct(F.lit(0.0).alias("size"), F.lit(0.0).alias("count"))
    rows = rows.join(begun, list(SERIES)).where(F.col("ts") >= F.col("__from"))
    return rows.select(*SERIES, "ts", *[F.coalesce(n, none).alias(n) for n in names])


def book_imbalance(levels_of: DataFrame, levels: int) -> DataFrame:
    """Ratio and difference of sizes and counts of both sides, levels weighted by (1 - 2 / (levels + 1)) ^ (level - 1).

    A side without size (count) has the least positive one of its series, so no ratio divides by 0. Ratios under 1 are
    inverted; both are negative where the ask is larger than the bid. size_net is bid less ask, count_net ask less bid.
    """
    keep = 1 - 2 / (levels + 1)
    total = lambda side, what: reduce(add, [F.abs(F.col(f"{side}_{k}.{what}")) * keep ** (k - 1) for k in range(1, levels + 1)])
    sums = {f"{s}_{w}": total(s, w) for s in SIDES for w in ("size", "count")}
    rows = levels_of.select(*SERIES, "ts", *[v.alias(k) for k, v in sums.items()])
    positive = lambda w: F.least(*[F.min(F.when(F.col(f"{s}_{w}") > 0, F.col(f"{s}_{w}"))) for s in SIDES])
    rows = rows.join(rows.groupBy(*SERIES).agg(positive("size").alias("__size"), positive("count").alias("__count")), list(SERIES))
    rows = rows.withColumns({f"{s}_{w}": F.when(F.col(f"{s}_{w}") == 0, F.col(f"__{w}")).otherwise(F.col(f"{s}_{w}")) for s in SIDES for w in ("size", "count")})

    def ratio(what: str) -> Column:
        r = F.col(f"ask_{what}") / F.col(f"bid_{what}")
        return F.when(r < 1, 1 / r).otherwise(r)

    sign = F.when(F.col("ask_size") > F.col("bid_size"), -1).otherwise(1)
    return rows.select(
        *SERIES, "ts", ratio("size").alias("steps"), (ratio("size") * sign).alias("size_ratio"), (ratio("count") * sign).alias("count_ratio"),
        (F.col("bid_size") - F.col("ask_size")).alias("size_net"), (F.col("ask_count") - F.col("bid_count")).alias("count_net"),
    )


def published_imbalance(imbalance: DataFrame, delta: float) -> DataFrame:
    """The four series in long form at the times where the size ratio has drifted `delta` or more from the last time kept."""
    kept = delta_sampling(imbalance.withColumn("seq", F.lit(0).cast("long")), "steps", delta).select(*SERIES, "ts")
    rows = imbalance.join(kept, [*SERIES, "ts"], "left_semi")
    return rows.unpivot([*SERIES, "ts"], ["size_ratio", "count_ratio", "size_net", "count_net"], "information", "value")


def quote_tick_bars(quotes: DataFrame) -> DataFrame:
    """Per volume tick of the quotes: OHLC of both prices and sizes, sizes added and removed at unchanged prices, and the spread."""
    flagged = near(quotes, lambda d, key: d.withColumns({f"__{s}": size_delta(s, f"{s}_size", key) for s in SIDES}), 1)
    at, spread, out = F.struct("ts", "seq"), F.col("ask") - F.col("bid"), [F.max("ts").alias("ts")]
    for s in SIDES:
        for c, name in ((s, s), (f"{s}_size", f"{s}_size")):
            out += [F.min_by(c, at).alias(f"{name}_open"), F.max(c).alias(f"{name}_high"), F.min(c).alias(f"{name}_low"), F.max_by(c, at).alias(f"{name}_close")]
        d = F.col(f"__{s}")
        out += [
            F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0)).alias(f"{s}_size_removed"), F.count_if(d < 0).alias(f"{s}_size_removed_count"),
            F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0)).alias(f"{s}_size_added"), F.count_if(d > 0).alias(f"{s}_size_added_count"),
        ]
    return flagged.groupBy(*SERIES, "volume_tick").agg(*out, F.max(spread).alias("spread_high"), F.min(spread).alias("spread_low"))


def with_changes(bars: DataFrame, value: str, gap: int) -> DataFrame:
    """Rows next to a change of `value`, and every `gap`-th row between two of them that are `gap` rows or more apart.

    The last row next to a change only ends the row of gaps and is left out.
    """

    def marked(d: DataFrame, key) -> DataFrame:
        from tickloom.operators.windows import ordered

        w = ordered(key)
        moved = lambda a, b: F.coalesce(a != b, F.lit(False))
        return d.withColumn("__k", moved(F.col(value), F.lag(value).over(w)) | moved(F.lead(value).over(w), F.col(value)))

    rows = carried(near(bars, marked, 1, 1), {"ix": ("sum", F.lit(1))}).withColumn("ix", F.col("ix") - 1)
    here = F.when(F.col("__k"), F.col("ix"))
    last = rows.groupBy(*SERIES).agg(F.max(here).alias("__last"))
    rows = carried(rows, {"__a": ("last", here), "__z": ("next", here)}).join(last, list(SERIES))
    between = (F.col("__z") - F.col("__a") >= gap) & ((F.col("ix") - F.col("__a")) % gap == 0) & (F.col("ix") < F.col("__z"))
    return rows.where((F.col("__k") & (F.col("ix") < F.col("__last"))) | (~F.col("__k") & between)).drop("__k", "__a", "__z", "__last")


def ratio_changes(pairs: DataFrame, by: list[str], steps: list[int], mean: int) -> DataFrame:
    """The ratio x / y of a pair's closes: its change over each number of rows, and its mean of `mean` rows; rows that have all changes."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("ts")
    rows = pairs.withColumn("__r", F.col("x") / F.col("y")).withColumn("__i", F.row_number().over(w))
    made = {f"ratio_d_{n}": F.col("__r") - F.lag("__r", n).over(w) for n in steps}
    rows = rows.withColumns(made | {"ratio_mean": F.avg("__r").over(w.rowsBetween(-(mean - 1), 0))})
    return rows.where(F.col("__i") > max(steps)).select(*by, "ts", *made, "ratio_mean")


def quote_and_fill_features(quotes: DataFrame, ticks: DataFrame, every: str, digits: int = 5) -> DataFrame:
    """Features of quotes and of ticks on the intervals that both have, scaled to 0..1 and coded as whole numbers; nulls are 0."""
    at = F.struct("ts", "seq")
    spread = F.col("ask") - F.col("bid")
    q = quotes.groupBy(*SERIES, F.window("ts", every).alias("w")).agg(
        F.max_by(spread, at).alias("spread"), F.max(spread).alias("spread_max"), F.max_by((F.col("bid") + F.col("ask")) / 2, at).alias("mid"))
    t = ticks.groupBy(*SERIES, F.window("ts", every).alias("w")).agg(
        F.sum(F.when(F.col("side") > 0, F.col("size")).otherwise(0)).alias("bought"), F.sum(F.when(F.col("side") > 0, 0).otherwise(F.col("size"))).alias("sold"), F.count(F.lit(1)).alias("n"))
    names = ["spread", "spread_max", "mid", "bought", "sold", "n"]
    both = q.join(t, [*SERIES, "w"]).select(*SERIES, F.col("w.start").alias("ts"), *[F.col(c).cast("double").alias(c) for c in names])
    ends = both.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("z")).alias(f"__{c}") for c in names])  # one row
    scaled = {c: (F.col(c) - F.col(f"__{c}.a")) / F.nullif(F.col(f"__{c}.z") - F.col(f"__{c}.a"), F.lit(0.0)) for c in names}
    coded = {c: F.coalesce((x * 10**digits).cast("long"), F.lit(0)) for c, x in scaled.items()}
    return both.join(F.broadcast(ends), F.lit(True)).withColumns(coded).select(*SERIES, "ts", *names)
