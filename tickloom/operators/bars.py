"""Resampling ticks into bars."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.chains import Drift, Runs, block_states, chain
from tickloom.operators.windows import ORDER, SERIES, carried, filled, near, ordered, spine

#: Sums that are floored: sizes have up to eight decimals, notionals ten.
EXACT = "decimal(38,10)"


def whole(total: Column, unit: float) -> Column:
    """How many whole units a decimal holds, floored, without a rounding division."""
    u = F.lit(Decimal(str(unit)))
    return ((total - F.pmod(total, u)) / u).cast("long")


def unit_bars(ticks: DataFrame, measure: Column, unit: float, name: str = "volume_size", series=SERIES) -> DataFrame:
    """Bars of a fixed amount: whole units that the running sum of `measure` passes at each row, summed per ts.

    The sum is exact (decimal) and floored, so signed flows may give negative bars. The first row of a series never emits.
    """
    value = F.coalesce(measure.cast(EXACT), F.lit(0).cast(EXACT))
    total = carried(ticks, {"__m": ("sum", value), "__i": ("sum", F.lit(1))}, series=series).withColumn("__x", value)
    step = total.where("__i > 1").withColumn("__n", whole(F.col("__m"), unit) - whole(F.col("__m") - F.col("__x"), unit))
    return step.where("__n <> 0").groupBy(*series, "ts").agg(F.sum("__n").cast("long").alias(name))


def time_bars(ticks: DataFrame, every: str, price: str = "price", size: str = "size") -> DataFrame:
    """OHLC, volume and count per interval, left-closed and left-labelled; the same in batch and streaming."""
    at = F.struct("ts", "seq")
    return (
        ticks.groupBy(*SERIES, F.window("ts", every).alias("w"))
        .agg(
            F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, at).alias("close"), F.sum(size).alias("volume"), F.count(F.lit(1)).alias("n"),
        )
        .select(*SERIES, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n")
    )


def quote_bars(quotes: DataFrame, every: str, size_agg=F.max) -> DataFrame:
    """OHLC of bid and ask per interval; the size aggregate is a parameter."""
    at, out = F.struct("ts", "seq"), []
    for s in ("bid", "ask"):
        out += [
            F.min_by(s, at).alias(f"{s}_open"), F.max(s).alias(f"{s}_high"), F.min(s).alias(f"{s}_low"),
            F.max_by(s, at).alias(f"{s}_close"), size_agg(f"{s}_size").alias(f"{s}_size"),
        ]
    bars = quotes.groupBy(*SERIES, F.window("ts", every).alias("w")).agg(*out)
    return bars.withColumn("ts", F.col("w.start")).drop("w")


def last_filled(ticks: DataFrame, every: str, value: str) -> DataFrame:
    """Last value per interval on a gapless spine of intervals, carried forward through empty ones."""
    bars = time_bars(ticks, every, price=value).select(*SERIES, "ts", F.col("close").alias(value))
    ends = bars.groupBy(*SERIES).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = spine(ends, every).join(bars, [*SERIES, "ts"], "left")
    return carried(rows, {value: ("last", F.col(value))}, order=("ts",))


def price_bars(ticks: DataFrame, unit: float) -> DataFrame:
    """Prices rounded half-even to a unit, rows where that price changed, the last of each ts."""
    rounded = ticks.withColumn("p", F.bround(F.col("price").cast("double") / unit) * unit)
    moved = near(rounded, lambda rows, key: rows.withColumn("q", F.lag("p").over(ordered(key))), 1).where("p <> q")
    return moved.groupBy(*SERIES, "ts").agg(F.max_by("p", "seq").alias("price"))


def with_volume_tick(ticks: DataFrame, amount: float) -> DataFrame:
    """`notional` and the number of whole amounts of it reached at each row."""
    value = (F.col("price") * F.col("size")).cast(EXACT)
    total = carried(ticks.withColumn("notional", value), {"__m": ("sum", F.col("notional"))})
    return total.withColumn("volume_tick", whole(F.col("__m"), amount)).drop("__m")


def dollar_bars(ticks: DataFrame, amount: float) -> DataFrame:
    """One bar per whole `amount` of notional: OHLC, counts, sizes by side, notional."""
    at, buy = F.struct("ts", "seq"), F.col("side") > 0
    return with_volume_tick(ticks, amount).groupBy(*SERIES, "volume_tick").agg(
        F.max("ts").alias("ts"), F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("volume"), F.sum(F.when(buy, F.col("size")).otherwise(0)).alias("volume_buy"),
        F.sum(F.when(~buy, F.col("size")).otherwise(0)).alias("volume_sell"), F.count_if(buy).alias("count_buy"),
        F.count_if(~buy).alias("count_sell"), F.sum("notional").alias("notional"),
    )


def counters(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of the non-zero, negative and positive values of a group."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count_if(v != 0).alias("count_non_zero"), F.count_if(v < 0).alias("count_lt_zero"),
        F.count_if(v > 0).alias("count_gt_zero"), F.sum(F.when(v > 0, v).otherwise(0)).alias("sum_gt_zero"),
        F.sum(F.when(v < 0, v).otherwise(0)).alias("sum_lt_zero"),
    )


def size_delta(price: str, size: str, series=SERIES) -> Column:
    """Change of the size at an unchanged best price, else 0."""
    w = ordered(series)
    return F.when(F.col(price) == F.lag(price).over(w), F.col(size) - F.lag(size).over(w)).otherwise(0)


def imbalance_per_move(ticks: DataFrame, measure: Column) -> DataFrame:
    """Flow between price changes: rows up to and with the one before a new price form a run; the last, open run is left out."""
    last = lambda rows, key: rows.withColumn("last", F.coalesce(F.lead("price").over(ordered(key)) != F.col("price"), F.lit(False)))
    flagged = near(ticks.withColumn("m", measure), last, 0, 1)
    runs = carried(flagged, {"run": ("next", F.when(F.col("last"), F.struct(*ORDER)))})
    closed = runs.where("run IS NOT NULL").groupBy(*SERIES, "run").agg(F.max("ts").alias("ts"), F.sum("m").alias("m"))
    return closed.groupBy(*SERIES, "ts").agg(F.avg("m").cast("int").alias("imbalance"))


KEYS = "exchange string, symbol string"


def sequence_bars(ticks: DataFrame, measure: Column, unit: float, rows: int = 0) -> DataFrame:
    """Run bars: two one-sided sums; the side that reaches the unit first emits +1 or -1 and both restart at that row.

    Sums are exact (ten decimals), so where they restart does not depend on how rows are cut into blocks.
    """
    goal = int(Decimal(str(unit)).scaleb(10))

    class Made(Runs):
        def __init__(self, pdf):
            super().__init__([int(f"{m:.10f}".replace(".", "")) for m in pdf["m"]], goal)

    exact = F.coalesce(measure.cast(EXACT), F.lit(0).cast(EXACT))
    made = chain(ticks.select(*SERIES, *ORDER, exact.alias("m")), Made, "sequence int", rows=rows)
    return made.groupBy(*SERIES, "ts").agg(F.sum("sequence").alias("sequence")).where("sequence <> 0")


def delta_sampling(ticks: DataFrame, value: str, delta: float, rows: int = 0) -> DataFrame:
    """Rows where the value has drifted `delta` or more from the last row kept (the first row is kept)."""

    class Made(Drift):
        def __init__(self, pdf):
            super().__init__(pdf["v"].to_numpy(dtype=float), delta)

    known = ticks.where(F.col(value).isNotNull()).select(*SERIES, *ORDER, F.col(value).cast("double").alias("v"))
    return chain(known, Made, "__kept double", rows=rows).select(*SERIES, *ORDER, F.col("v").alias(value))


class Book:
    """Levels of both sides, price -> size. An update with a count sets its level (size > 0: bid) and drops crossed levels of the other
    side; without, it removes it."""

    def __init__(self, bids: dict | None = None, asks: dict | None = None):
        self.bids, self.asks = dict(bids or {}), dict(asks or {})

    def update(self, price: float, size: float, count: int) -> None:
        own, other, sign = (self.bids, self.asks, 1) if size > 0 else (self.asks, self.bids, -1)
        if count:
            own[price] = abs(size)
            for p in [p for p in other if (p - price) * sign <= 0]:
                del other[p]
        else:
            own.pop(price, None)

    @staticmethod
    def summary(updates: list[tuple[float, float, int]]):
        """What updates do to any book: levels of it last unless they are named or crossed; what they leave of their own is added."""
        book, named, crossed = Book(), (set(), set()), [float("inf"), float("-inf")]
        for price, size, count in updates:
            bid = size > 0
            named[0 if bid else 1].add(price)
            if count and bid:
                crossed[1] = max(crossed[1], price)
            elif count:
                crossed[0] = min(crossed[0], price)
            book.update(price, size, count)
        return named, crossed, (book.bids, book.asks)

    @staticmethod
    def after(summary, state):
        (bids, asks), (low, high), (own_bids, own_asks) = summary
        old_bids, old_asks = state or ({}, {})
        return (
            {p: s for p, s in old_bids.items() if p not in bids and p < low} | own_bids,
            {p: s for p, s in old_asks.items() if p not in asks and p > high} | own_asks,
        )


def _updates(l2: DataFrame) -> DataFrame:
    cols = [F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), F.col("count").cast("int").alias("count")]
    return l2.select(*SERIES, F.to_date("ts").alias("d"), *ORDER, *cols)


#: Rows and levels of a batch of books: a block's books are made and passed on batch by batch.
BATCH_ROWS, BATCH_LEVELS = 1 << 13, 1 << 18


def _changes(rows) -> list[tuple[float, float, int]]:
    """Price, size and count (0 where unknown) of the rows of an Arrow table."""
    floats = (rows[c].to_numpy().tolist() for c in ("price", "size"))
    return list(zip(*floats, rows["count"].fill_null(0).to_pylist()))


class Levels:
    """All levels of both sides, as Arrow lists."""

    made = "bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"

    def __init__(self):
        self.sides = [([0], [], []) for _ in range(2)]

    def add(self, book: Book) -> None:
        for (ends, prices, sizes), side in zip(self.sides, (book.bids, book.asks)):
            own = sorted(side)
            prices += own
            sizes += map(side.__getitem__, own)
            ends.append(len(prices))

    def held(self) -> int:
        return sum(len(prices) for _, prices, _ in self.sides)

    def columns(self, types: list) -> list:
        flat = lambda x: pa.array(x, pa.float64())
        made = lambda e, p, s, t: pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.StructArray.from_arrays([flat(p), flat(s)], fields=list(t.value_type)), type=t)
        return [made(*side, t) for side, t in zip(self.sides, types)]


class Best:
    """The best price of each side."""

    made = "best_bid double, best_ask double"

    def __init__(self):
        self.bids, self.asks = [], []

    def add(self, book: Book) -> None:
        self.bids.append(max(book.bids, default=None))
        self.asks.append(min(book.asks, default=None))

    def held(self) -> int:
        return 0

    def columns(self, types: list) -> list:
        return [pa.array(x, t) for x, t in zip((self.bids, self.asks), types)]


def book_batches(rows, book: Book, make, schema):
    """Record batches of what `make` (`Levels`, `Best`) gives of the book after each of `rows`, an ordered Arrow table of updates."""
    keys = [*SERIES, *ORDER]
    for start in range(0, rows.num_rows, BATCH_ROWS):
        part = rows.slice(start, BATCH_ROWS)
        made, begin = make(), 0
        for i, update in enumerate(_changes(part), 1):
            book.update(*update)
            made.add(book)
            if i == part.num_rows or made.held() >= BATCH_LEVELS:
                own = part.select(keys).slice(begin, i - begin).combine_chunks()
                columns = [pa.concat_arrays(own[c].chunks).cast(schema.field(c).type) for c in keys]
                yield pa.RecordBatch.from_arrays([*columns, *made.columns(schema.types[len(keys) :])], schema=schema)
                made, begin = make(), i


def _books(l2: DataFrame, make, rows: int) -> DataFrame:
    """What `make` gives of the book after each update. A day starts with an empty book; its hours are folded in blocks, so one day of
    one series is many tasks. The book that comes into a block is one row more of it; blocks give their rows in batches."""
    import pickle

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    changes = lambda pdf: list(zip(pdf["price"].tolist(), pdf["size"].tolist(), pdf["count"].fillna(0).tolist()))
    placed, states, keys = block_states(_updates(l2), lambda pdf: Book.summary(changes(pdf)), Book.after, (*SERIES, "d"), rows=rows)
    schema = StructType.fromDDL(f"{KEYS}, ts timestamp, seq long, {make.made}")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        state = pickle.loads(pc.drop_null(table["__state"])[0].as_py())
        table = table.filter(pc.is_null(table["__state"])).drop_columns("__state").sort_by([(c, "ascending") for c in ORDER])
        yield from book_batches(table, Book(*(state or ())), make, target)

    return placed.unionByName(states, allowMissingColumns=True).groupBy(*keys).applyInArrow(run, schema)


def clean_book(l2: DataFrame, rows: int = 0) -> DataFrame:
    """The levels of both sides after each level update of a day."""
    return _books(l2, Levels, rows)


def best_prices(l2: DataFrame, rows: int = 0) -> DataFrame:
    """Best bid and ask after each level update of a day; crossed opposite levels are dropped."""
    return _books(l2, Best, rows)
