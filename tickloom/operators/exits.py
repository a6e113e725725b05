"""Entries, the curve rows they hold, exits and fills.

An entry has `id`, its series, `ts`, `end`, a price `p0` and a `direction` of 1 or -1. All exits of all entries come from one
expansion (entry x curve rows of its window) and one aggregation by `id`; work grows with the rows held, not with series squared.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.chains import Turns, chain
from tickloom.operators.windows import START


def select_entries(rows: DataFrame, strategies: dict[str, tuple[int, dict[str, list[Column]]]], minutes: int) -> DataFrame:
    """Rows that at least one strategy enters at, listed per strategy.

    A strategy is (direction, {"all": [...], "any": [...], "none": [...]}): intersection, union and difference of predicates,
    read in one pass. A null predicate is false.
    """
    chosen = []
    for name, (direction, rule) in strategies.items():
        true = lambda p: F.coalesce(p, F.lit(False))
        test = reduce(and_, [true(p) for p in rule.get("all", [])], F.lit(True))
        if rule.get("any"):
            test = test & reduce(or_, [true(p) for p in rule["any"]])
        for p in rule.get("none", []):
            test = test & ~true(p)
        chosen.append(F.when(test, F.struct(F.lit(name).alias("strategy"), F.lit(direction).alias("direction"))))
    listed = rows.withColumn("__s", F.explode(F.array_compact(F.array(*chosen))))
    return listed.select(*rows.columns, "__s.strategy", "__s.direction", (F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("end"))


def merged_entries(entries: DataFrame, by: list[str]) -> DataFrame:
    """One row per (series, ts, seq) with the sorted strategies that enter there."""
    return entries.groupBy(*by).agg(F.array_sort(F.collect_set("strategy")).alias("strategies"))


def held_rows(entries: DataFrame, curve: DataFrame, by: list[str], bucket_s: int = 3600) -> DataFrame:
    """Entry x curve rows in (ts, end]: an equi-join on (series, time bucket), not a range join.

    The entry's own time becomes `entry_ts`; `ts` and the other columns are the curve's.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_s)
    e = entries.withColumnRenamed("ts", "entry_ts")
    e = e.withColumn("__b", F.explode(F.sequence(bucket("entry_ts"), bucket("end"))))
    rows = e.join(curve.withColumn("__b", bucket("ts")), [*by, "__b"])
    return rows.where((F.col("ts") > F.col("entry_ts")) & (F.col("ts") <= F.col("end"))).drop("__b")


def deal_curves(held: DataFrame, price: str = "price") -> DataFrame:
    """Profit, relative profit, best profit so far, distance to it and minutes held, for each row a deal holds."""
    w = Window.partitionBy("id").orderBy("ts", "seq").rowsBetween(START, 0)
    rows = held.withColumn("profit", (F.col(price) - F.col("p0")) * F.col("direction"))
    return rows.withColumns({
        "profit_rel": F.col("profit") / F.col("p0"),
        "best": F.greatest(F.max("profit").over(w), F.lit(0.0)),
        "giveback": F.greatest(F.max("profit").over(w), F.lit(0.0)) - F.col("profit"),
        "elapsed": (F.unix_micros("ts") - F.unix_micros("entry_ts")) / 60e6,
    })


def first_exits(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per deal the first (ts, seq) of each rule, and the earliest of all with its reason; one aggregation.

    Ties go to the rule listed first. A deal that no rule ends leaves at its last row, for the reason `timeout`.
    """
    at = F.struct("ts", "seq")
    hits = rows.groupBy("id").agg(*[F.min(F.when(rule, at)).alias(f"__{name}") for name, rule in rules.items()], F.max(at).alias("__timeout"))
    ranked = [F.when(F.col(f"__{n}").isNotNull(), F.struct(F.col(f"__{n}").alias("at"), F.lit(i).alias("i"), F.lit(n).alias("reason"))) for i, n in enumerate([*rules, "timeout"])]
    out = hits.withColumn("__e", F.array_min(F.array_compact(F.array(*ranked))))
    return out.select("id", *[F.col(f"__{n}.ts").alias(f"{n}_ts") for n in rules], F.col("__e.at.ts").alias("exit_ts"), F.col("__e.at.seq").alias("exit_seq"), F.col("__e.reason").alias("reason"))


def vetoed(rows: DataFrame, veto: Column) -> DataFrame:
    """Candidate rows without those a veto holds; a null veto does not hold."""
    return rows.where(~F.coalesce(veto, F.lit(False)))


def never_negative_again(curves: DataFrame) -> Column:
    """True from the row after which a deal's profit stays at 0 or above to the end of its window."""
    back = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(START, 0)
    return F.min("profit").over(back) >= 0


def market_fill(bars: DataFrame, direction: Column) -> Column:
    """Worst of quote and deal in the bar: highest ask or deal for a buy, lowest bid or deal for a sale."""
    return F.when(direction > 0, F.greatest("ask_high", "high")).otherwise(F.least("bid_low", "low"))


def limit_fills(orders: DataFrame, bars: DataFrame, by: list[str], tick: float, late: bool = True) -> DataFrame:
    """Fill of limit orders (id, ts, end, direction, limit) on later bars, and whether they are cancelled before.

    A buy fills at the first bar whose lowest ask or deal is under the limit (at it, unless `late`), at min(highest ask, limit); a
    sale likewise. Without such a bar it fills at the last one at its limit. It is cancelled at the first bar before the fill
    where the near side (bid high of a buy, ask low of a sale) is two ticks or more away from the limit.
    """
    buy, limit = F.col("direction") > 0, F.col("limit")
    low, high = F.least("ask_low", "low"), F.greatest("bid_high", "high")
    touch = F.when(buy, low < limit if late else low <= limit).otherwise(high > limit if late else high >= limit)
    price = F.when(buy, F.least("ask_high", "limit")).otherwise(F.greatest("bid_low", "limit"))
    away = F.when(buy, F.col("bid_high") >= limit + 2 * tick).otherwise(F.col("ask_low") <= limit - 2 * tick)
    rows = held_rows(orders, bars, by)
    found = rows.groupBy("id").agg(
        F.min(F.when(touch, F.struct("ts", price.alias("p")))).alias("__f"),
        F.max(F.struct("ts", limit.alias("p"))).alias("__l"),
        F.min(F.when(away, F.col("ts"))).alias("__c"),
    )
    fill = F.coalesce("__f", "__l")
    cancelled = F.when(F.col("__c") < fill["ts"], F.col("__c"))
    return found.select("id", fill["ts"].alias("fill_ts"), fill["p"].alias("fill_price"), F.col("__f").isNotNull().alias("touched"), cancelled.alias("cancel_ts"))


def sweep(rows: DataFrame, params: list[float], exit_rule) -> DataFrame:
    """Total profit of every parameter: each deal leaves at the first row of its rule, else at its last row.

    All parameters are evaluated in one aggregation over the same rows; nothing is multiplied by their number.
    """
    at = F.struct("ts", "seq", "profit")
    exits = [F.coalesce(F.min(F.when(exit_rule(p), at)), F.max(at))["profit"] for p in params]
    per_deal = rows.groupBy("id").agg(F.array(*[F.struct(F.lit(p).alias("param"), x.alias("profit")) for p, x in zip(params, exits)]).alias("__x"))
    return per_deal.select(F.inline("__x")).groupBy("param").agg(F.sum("profit").alias("total"), F.count("profit").alias("trades"))


def portfolio_side(orders: DataFrame, strategy: str, order: str, direction: str, stopped: Column) -> DataFrame:
    """Side held after each order: its direction, or flat after a stop; `may_enter` where the side before is flat or opposite."""
    w = Window.partitionBy(strategy).orderBy(order)
    side = F.when(stopped, F.lit(0)).otherwise(F.col(direction))
    out = orders.withColumn("side", side).withColumn("__b", F.coalesce(F.lag(side).over(w), F.lit(0)))
    return out.withColumn("may_enter", F.col("__b") != F.col(direction)).drop("__b")


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("ts", "seq")
    return rows.withColumn("ix", F.row_number().over(w) - 1).withColumn("__k", F.floor(F.col("ix") / n).cast("long"))


def twin_peaks(curves: DataFrame, n: int, giveback_rel: float, price: str = "price") -> DataFrame:
    """Per deal the first exit at a second peak worse than the one before it.

    Peaks are those of the mean price of whole buckets of n rows, in the deal's direction: above the bucket before, not under the one
    after. The exit is the first row after the bucket that confirms the peak, if the deal has given back over `giveback_rel`
    of its entry price there. Trades without one have nulls.
    """
    rows = _bucketed(curves, n)
    means = rows.groupBy("id", "__k").agg(F.avg(F.col(price) * F.col("direction")).alias("m"), F.count(F.lit(1)).alias("c")).where(F.col("c") == n)
    w = Window.partitionBy("id").orderBy("__k")
    peak = (F.col("m") > F.lag("m").over(w)) & (F.col("m") >= F.lead("m").over(w))
    peaks = means.withColumn("__p", peak).where("__p").withColumn("__before", F.lag("m").over(w))
    lower = peaks.where(F.col("m") < F.col("__before")).select("id", ((F.col("__k") + 2) * n).alias("ix"))
    at = rows.where(F.col("giveback") > giveback_rel * F.col("p0")).join(lower, ["id", "ix"])
    first = at.groupBy("id").agg(F.min(F.struct("ts", "seq")).alias("__e")).select("id", F.col("__e.ts").alias("exit_ts"), F.col("__e.seq").alias("exit_seq"))
    return curves.select("id").distinct().join(first, "id", "left")


def dip_and_return(rows: DataFrame, value: Column, level: Column, wait: int) -> DataFrame:
    """Per deal: the first row whose value is under the level, the first row `wait` rows later or after that where it is above it again,
    and the row of the least value from the dip up to there (the earliest on ties). Trades that do not return have no least row."""
    r = _bucketed(rows, 1).withColumns({"__v": value, "__l": level}).select("id", "ts", "ix", "__v", "__l")
    dip = r.groupBy("id").agg(F.min(F.when(F.col("__v") < F.col("__l"), F.col("ix"))).alias("dip_ix"))
    r = r.join(dip, "id")
    back = r.groupBy("id").agg(F.min(F.when((F.col("ix") >= F.col("dip_ix") + wait) & (F.col("__v") > F.col("__l")), F.col("ix"))).alias("back_ix"))
    r = r.join(back, "id")
    inside = (F.col("ix") >= F.col("dip_ix")) & (F.col("ix") < F.col("back_ix"))
    return r.groupBy("id").agg(F.first("dip_ix").alias("dip_ix"), F.first("back_ix").alias("back_ix"), F.min_by("ix", F.when(inside, F.struct("__v", "ix"))).alias("least_ix"), F.min_by("ts", F.when(inside, F.struct("__v", "ix"))).alias("least_ts"))


def _lowest_since_greater(x):
    """For each value the lowest one back to it from after the last greater value before it; a stack of falling values, one pass."""
    import numpy as np

    out, stack = np.empty(len(x)), []
    for i, v in enumerate(x.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        out[i] = low
        stack.append((v, low))
    return out


def peaks(rows: DataFrame, value: str, height: float, distance: int, prominence: float) -> DataFrame:
    """Local maxima of each deal: strict against both sides, at least `height`, the higher of two closer than `distance` rows (the later
    on ties), with a prominence of `prominence` or more. Prominence is the height over the higher of the two lowest values between the
    peak and the next greater value on each side, or the end. One group is what one deal holds."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import StructType

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"])
        x = pdf["v"].to_numpy()
        at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:]) & (x[1:-1] >= height)) + 1
        alive = np.ones(len(at), bool)
        for i in np.lexsort((at, x[at]))[::-1]:  # the highest first; it ends those near it on both sides
            if alive[i]:
                alive[np.searchsorted(at, at[i] - distance, "right") : i] = False
                alive[i + 1 : np.searchsorted(at, at[i] + distance, "left")] = False
        at = at[alive]
        out = x[at] - np.maximum(_lowest_since_greater(x)[at], _lowest_since_greater(x[::-1])[::-1][at])
        return pdf.iloc[at][["id", "ts", "seq", "v"]].assign(prominence=out)[out >= prominence]

    x = rows.where(F.col(value).isNotNull()).select("id", "ts", "seq", F.col(value).cast("double").alias("v"))
    return x.groupBy("id").applyInPandas(find, StructType(list(x.schema.fields)).add("prominence", "double")).withColumnRenamed("v", value)


def orders_of_executions(executions: DataFrame, by: str, order: list[str], passive: str) -> DataFrame:
    """Executions as orders: passive buys enter, other sales exit; funding is left out.

    Passive sales and other buys are left out too, unless a passive one follows a passive one: a reversal, which takes the quantity
    of the execution before it and exits. A passive buy after a passive execution takes that one's quantity as well.
    """
    w = Window.partitionBy(by).orderBy(*order)
    is_passive = F.coalesce(F.col("exec_inst") == passive, F.lit(False))
    rows = executions.withColumns({"__p": is_passive, "__pp": F.coalesce(F.lag(is_passive).over(w), F.lit(False)), "__q": F.lag("quantity").over(w)})
    again, buy = F.col("__p") & F.col("__pp"), F.col("side") == "Buy"
    odd = F.col("__p") != buy
    rows = rows.where(~F.coalesce(F.col("text") == "Funding", F.lit(False))).where(~odd | again)
    entry = F.col("__p") & ~odd
    rows = rows.withColumn("quantity", F.when(again, F.col("__q")).otherwise(F.col("quantity")))
    return rows.withColumns({
        "direction": F.when(buy, 1).otherwise(-1), "timing": F.when(entry, "entry").otherwise("exit"),
        "fee": F.col("commission") * F.col("quantity") * F.col("price"), "quantity": F.when(buy, F.col("quantity")).otherwise(-F.col("quantity")),
    }).drop("__p", "__pp", "__q")


def not_overlapping(rows: DataFrame, by: list[str], mark: Column | None = None, block_rows: int = 0) -> DataFrame:
    """The deals of a strategy (ts, id, end) that are taken one after another: each starts after the end of the last one taken;
    rows before `mark` are left out. A deal without an end ends where it starts."""

    class Made(Turns):
        def __init__(self, pdf):
            micros = lambda c: pdf[c].to_numpy(dtype="datetime64[us]").astype("int64")
            super().__init__(micros("ts"), micros("__end"))

    rows = rows if mark is None else rows.where(F.col("ts") >= mark)
    taken = chain(rows.withColumn("__end", F.coalesce("end", "ts")), Made, "__free long", tuple(by), ("ts", "id"), block_rows)
    return taken.select(rows.columns)
