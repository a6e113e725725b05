"""Deal analytics over order ledgers and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import SERIES, START, carried, fold_ordered


def round_trips(ledger: DataFrame, strategy: str, order: str, price: str, direction: str, fee: float) -> DataFrame:
    """Profit of every second order against the one before it, net of fees on both prices."""
    w = Window.partitionBy(strategy).orderBy(order)
    rows = ledger.withColumn("__n", F.row_number().over(w) - 1).withColumn("__p", F.lag(price).over(w)).withColumn("__d", F.lag(direction).over(w))
    trips = rows.where("__n % 2 = 1")
    profit = (F.col(price) - F.col("__p")) * F.col("__d") - fee * (F.col(price) + F.col("__p"))
    return trips.select(strategy, order, profit.alias("profit"))


def trip_summary(ledger: DataFrame, strategy: str, order: str, price: str, direction: str, day: str, fee: float) -> DataFrame:
    """Per strategy: round trips, their profit, fees, durations in days, the best and the worst."""
    w = Window.partitionBy(strategy).orderBy(order)
    rows = ledger.withColumn("days", F.datediff(day, F.lag(day).over(w))).withColumn("fee", fee * (F.col(price) + F.lag(price).over(w)))
    trips = rows.select(strategy, order, "days", "fee").join(round_trips(ledger, strategy, order, price, direction, fee), [strategy, order])
    return trips.groupBy(strategy).agg(
        F.count(F.lit(1)).alias("trips"), F.sum("profit").alias("profit"), F.sum("fee").alias("fees"), F.avg("days").alias("mean_days"),
        F.max("days").alias("most_days"), F.max("profit").alias("best"), F.min("profit").alias("worst"),
    )


def wins(trips: DataFrame, strategy: str, order: str) -> DataFrame:
    """Per strategy: round trips that earn and that do not, their ratio, and both in order as letters w and l (as long as its trips)."""
    letter = F.when(F.col("profit") > 0, "w").otherwise("l")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), letter.alias("x")))), lambda e: e["x"]), "")
    won = F.count_if(F.col("profit") > 0)
    return trips.groupBy(strategy).agg(won.alias("wins"), F.count_if(F.col("profit") <= 0).alias("losses"), (won / F.count(F.lit(1))).alias("win_ratio"), listed.alias("outcomes"))


def equity(trips: DataFrame, strategy: str, order: str) -> DataFrame:
    """Running profit, its peak (seeded with the first deal) and the drawdown."""
    w = Window.partitionBy(strategy).orderBy(order).rowsBetween(START, 0)
    cum = trips.withColumn("total", F.sum("profit").over(w))
    return cum.withColumn("peak", F.max("total").over(w)).withColumn("drawdown", F.col("peak") - F.col("total"))


def holdings(ledger: DataFrame, strategy: str, order: str, price: str, qty: str, fee: float) -> DataFrame:
    """Cash, holding and portfolio value after each order."""
    w = Window.partitionBy(strategy).orderBy(order).rowsBetween(START, 0)
    cash = F.sum(-F.col(price) * F.col(qty) - fee * F.col(price) * F.abs(F.col(qty))).over(w)
    held = F.sum(qty).over(w)
    return ledger.select(strategy, order, cash.alias("cash"), held.alias("holding"), (cash + held * F.col(price)).alias("value"))


def opportunity(rows: DataFrame, close: str, n: int, series=SERIES) -> DataFrame:
    """Distance of the close to the highest and lowest close of the n rows before."""
    w = Window.partitionBy(*series).orderBy("ts", "seq").rowsBetween(-n, -1)
    return rows.withColumn("to_high", F.max(close).over(w) - F.col(close)).withColumn("to_low", F.col(close) - F.min(close).over(w))


def best_threshold(rows: DataFrame, signal: str, pnl: str, by: list[str], step: float = 1.0) -> DataFrame:
    """Signal value at the highest cumulative P&L when deals are taken from the strongest signal down.

    The running sum is carried over chunks of `step` of the signal, so no series is one task.
    """
    ranked = rows.withColumn("__s", -F.col(signal))
    cum = carried(ranked, {"__total": ("sum", F.col(pnl))}, chunk=F.floor(F.col("__s") / step), series=tuple(by), order=("__s", "seq"))
    return cum.groupBy(*by).agg(F.max_by(signal, F.struct("__total", -F.col("seq"))).alias("threshold"), F.max("__total").alias("total"))


def position_sizes(ledger: DataFrame, strategy: str, order: str, direction: str, timing: str) -> DataFrame:
    """Quantity -1, 0 or 1 of each order: entries open when flat, exits close what is held.

    What is held follows from the order before: an entry leaves a position, an exit leaves none. So the first entry after an
    exit opens, the first exit after an entry closes what was opened last; windows find both.
    """
    w = Window.partitionBy(strategy).orderBy(order)
    before = F.coalesce(F.lag(timing).over(w), F.lit("exit"))
    rows = ledger.select(strategy, order, F.col(direction).cast("int").alias("__d"), F.col(timing).alias("__t"), before.alias("__b"))
    rows = rows.withColumn("__o", F.when((F.col("__t") == "entry") & (F.col("__b") == "exit"), F.col("__d")))
    closes = (F.col("__t") == "exit") & (F.col("__b") == "entry")
    quantity = F.coalesce("__o", F.when(closes, -F.last("__o", True).over(w.rowsBetween(START, 0))), F.lit(0))
    return rows.select(strategy, order, quantity.cast("int").alias("quantity"))


def convex_sizes(ledger: DataFrame, strategy: str, order: str, direction: str, timing: str, price: str, most: float = 1.0) -> DataFrame:
    """Quantities that risk more after a winner: an order to a side that is fully held is 0, an exit closes what is held, an entry
    turns to `most` after a winner or before any, else to most / (2 * winners so far).

    An order's profit is that of the price before it against its own, in its direction. An ordered fold over a strategy's orders;
    its state is four numbers.
    """

    def step(state, row):
        held, wins, won, last = state or (0.0, 0, False, None)
        key, n, side, when, p = row
        if held * side >= 1:
            return (held, wins, won, p), (key, n, 0.0)
        cap = most if won or not wins else most / (wins * 2)
        q = -held if when == "exit" else float(side) if last is None else side * cap - held
        if last is not None:
            won = (last - p) * side > 0
            wins += won
        return (held + q, wins, won, p), (key, n, q)

    kinds = dict(ledger.dtypes)
    rows = ledger.select(strategy, order, F.col(direction).cast("int"), timing, F.col(price).cast("double"))
    return fold_ordered(rows, [strategy], step, f"{strategy} {kinds[strategy]}, {order} {kinds[order]}, quantity double", (order,))
