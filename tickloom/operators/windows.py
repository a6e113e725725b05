"""Ordered windows over series: cumulative sums, rolling frames, fills.

A series is (exchange, symbol) unless told otherwise; its order is (ts, seq), which is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("exchange", "symbol")
ORDER = ("ts", "seq")
START, END = Window.unboundedPreceding, Window.unboundedFollowing


def ordered(series=SERIES, order=ORDER):
    return Window.partitionBy(*series).orderBy(*order)


def trailing(n: int, series=SERIES, order=ORDER):
    return ordered(series, order).rowsBetween(-(n - 1), 0)


def leading(n: int, series=SERIES, order=ORDER):
    return ordered(series, order).rowsBetween(0, n - 1)


def running(series=SERIES, order=ORDER):
    return ordered(series, order).rowsBetween(START, 0)


def full(value: Column, agg: Column, n: int, w) -> Column:
    """`agg` over the frame, null until the frame holds n values."""
    return F.when(F.count(value).over(w) == n, agg.over(w))


#: Rows of a series that a block of `blocked` holds, about.
BLOCK_ROWS = 1 << 16


def _small_join(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with the columns of `small`, which has a row or a few for each of the keys; null keys are keys too."""
    named = small.withColumnsRenamed({k: f"__j_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__j_{k}")) for k in keys]
    return df.join(named, on).drop(*[f"__j_{k}" for k in keys])


def carried(df: DataFrame, specs: dict[str, tuple[str, Column]], chunk: Column | None = None, series=SERIES, order=ORDER) -> DataFrame:
    """Running values from the start of a series to each row, parallel inside one series.

    `specs`: name -> (kind, column); kinds are sum, max, min, last (the last non-null value), next (the first non-null
    value from the row on) and total (the sum over the whole series). A series is cut into chunks of time (days unless told otherwise). Each chunk is aggregated to one
    row; a window over those few rows gives what each chunk carries in; rows then look at their own chunk only.
    """
    chunk = F.to_date("ts") if chunk is None else chunk
    at = F.struct(*order)
    agg = {
        "sum": F.sum, "total": F.sum, "max": F.max, "min": F.min,
        "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), at)), "next": lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), at)),
    }
    past = {"sum": F.sum, "total": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, True), "next": lambda v: F.last(v, True)}
    both = {
        "sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least,
        "last": lambda own, before: F.coalesce(own, before), "next": lambda own, after: F.coalesce(own, after),
    }
    # Join and window keys are the same columns and never null, so rows are shuffled once, by (series, chunk).
    named = {f"__k{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(series)}
    nulls = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in series])
    whole, keys = [*named, "__kn"], [*named, "__kn", "__kc"]
    values = {f"__v{i}": column for i, (_, column) in enumerate(specs.values())}
    keyed = df.withColumns(values).withColumns(named | {"__kn": nulls, "__c": chunk}).withColumn("__kc", F.coalesce(F.col("__c").cast("string"), F.lit("")))
    small = keyed.groupBy(*keys, "__c").agg(*[agg[kind](f"__v{i}").alias(f"__a{i}") for i, (kind, _) in enumerate(specs.values())])
    back = [F.desc(c) for c in order]
    carry, inside = {}, {}
    for i, (kind, _) in enumerate(specs.values()):
        ahead = kind == "next"
        if kind == "total":
            carry[f"__in{i}"] = F.sum(f"__a{i}").over(Window.partitionBy(*whole))
            inside[list(specs)[i]] = F.col(f"__in{i}")
            continue
        over = Window.partitionBy(*whole).orderBy(F.desc("__c") if ahead else "__c").rowsBetween(START, -1)
        carry[f"__in{i}"] = past[kind](f"__a{i}").over(over)
        own = Window.partitionBy(*keys).orderBy(*(back if ahead else order)).rowsBetween(START, 0)
        inside[list(specs)[i]] = both[kind](past[kind](f"__v{i}").over(own), F.col(f"__in{i}"))
    names = [f"__in{i}" for i in range(len(specs))]
    carries = small.withColumns(carry).select(*keys, *names)
    out = keyed.join(carries, keys).withColumns(inside)
    return out.drop("__c", *keys, *names, *values)


def cumsum_chunked(df: DataFrame, value: Column, name: str, chunk: Column | None = None, series=SERIES, order=ORDER) -> DataFrame:
    """Running sum, parallel inside one series."""
    return carried(df, {name: ("sum", value)}, chunk, series, order)


def block_plan(df: DataFrame, before: int = 0, after: int = 0, series=SERIES, rows: int = 0) -> DataFrame:
    """(series, __c, __block, __own): which blocks the rows of an hour go to, with halos of `before` and `after` rows.

    Blocks are runs of whole hours of about BLOCK_ROWS rows, or of the halo if that is longer, so a halo meets the two
    blocks next to it at most. One row an hour is counted and ordered here, never the rows themselves.
    """
    size = max(rows or BLOCK_ROWS, before, after)
    w = Window.partitionBy(*series).orderBy("__c")
    hours = df.withColumn("__c", hour_of("ts")).groupBy(*series, "__c").agg(F.count(F.lit(1)).alias("__n"))
    hours = hours.withColumn("__first", F.coalesce(F.sum("__n").over(w.rowsBetween(START, -1)), F.lit(0)))
    hours = hours.withColumn("__block", F.floor(F.col("__first") / size))
    if not before and not after:
        return hours.select(*series, "__c", "__block", F.lit(True).alias("__own"))
    # The two blocks before and after, from the first hours of blocks: no join of the hours with their blocks.
    begins = F.coalesce(F.lag("__block").over(w) != F.col("__block"), F.lit(True))
    hours = hours.withColumns({"__new": begins, "__prev": F.lag("__block").over(w)})
    at_start = lambda c: F.last(F.when(F.col("__new"), c), True)
    upto, behind = w.rowsBetween(START, 0), Window.partitionBy(*series).orderBy(F.desc("__c")).rowsBetween(START, -1)
    if before:
        hours = hours.withColumn("__up1", at_start(F.struct("__block", F.col("__first").alias("__from"))).over(behind))
        hours = hours.withColumn("__up2", at_start(F.col("__up1")).over(behind))
    if after:
        down = F.when(F.col("__prev").isNotNull(), F.struct(F.col("__prev").alias("__block"), F.col("__first").alias("__to")))
        hours = hours.withColumn("__down1", at_start(down).over(upto))
        hours = hours.withColumn("__down0", F.lag("__down1").over(w)).withColumn("__down2", at_start(F.col("__down0")).over(upto))
    goes = [F.struct("__block", F.lit(True).alias("__own"))]
    for k in (1, 2):
        if before:
            up = F.col(f"__up{k}")
            goes.append(F.when(F.col("__first") + F.col("__n") > up["__from"] - before, F.struct(up["__block"].alias("__block"), F.lit(False).alias("__own"))))
        if after:
            down = F.col(f"__down{k}")
            goes.append(F.when(F.col("__first") < down["__to"] + after, F.struct(down["__block"].alias("__block"), F.lit(False).alias("__own"))))
    return hours.select(*series, "__c", F.inline(F.array_compact(F.array(*goes))))


def hour_of(ts: str | Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 3600)


def near(df: DataFrame, fn, before: int = 0, after: int = 0, series=SERIES, rows: int = 0) -> DataFrame:
    """`fn(rows, key)` over blocks of a series instead of whole series; rows see `before` rows before and `after` rows after them.

    `fn` adds columns by windows partitioned by `key`. Frames are to stay within the halo; results are then those over
    the whole series, and a long series is spread over many tasks.
    """
    placed = _small_join(df.withColumn("__c", hour_of("ts")), block_plan(df, before, after, series, rows), [*series, "__c"])
    return fn(placed.drop("__c"), (*series, "__block")).where("__own").drop("__block", "__own")


def near_frames(df: DataFrame, fn, made: str, inputs: list[str], before: int = 0, after: int = 0, series=SERIES, order=ORDER, rows: int = 0) -> DataFrame:
    """As `near`, for what no window expresses: `fn(arrays, own)` gets the inputs of a block and its halos as float arrays in order (not
    a number for null) and gives an array for each of the columns `made` (names and types), whose own rows are kept."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import StructType

    keys, columns, added = [*series, "__block"], df.columns, StructType.fromDDL(made)
    placed = _small_join(df.withColumn("__c", hour_of("ts")), block_plan(df, before, after, series, rows), [*series, "__c"]).drop("__c")
    names = [f.name for f in added.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        own = pdf["__own"].to_numpy(dtype=bool)
        made_ = fn([pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in inputs], own)
        return pdf.loc[own, columns].assign(**{n: v[own] for n, v in zip(names, made_)})

    return placed.groupBy(*keys).applyInPandas(run, StructType(df.schema.fields + added.fields))


def frames(x, n: int) -> dict:
    """count, sum, mean, dev (sum of squared deviations), max and min of the last n values of each row (as many as there are), without what
    is not a number. Frames of 1, 2, 4 ... values are put together by the binary digits of n: log2(n) steps, whatever n is."""
    import numpy as np

    there = ~np.isnan(x)
    part = [there.astype(float), np.where(there, x, 0.0), np.zeros(len(x)), np.where(there, x, -np.inf), np.where(there, x, np.inf)]
    none = (0.0, 0.0, 0.0, -np.inf, np.inf)

    def back(p, k):
        return [np.concatenate([np.full(min(k, len(x)), e), v[: max(len(x) - k, 0)]]) for v, e in zip(p, none)]

    def both(a, b):  # counts, means, deviations, extremes of two frames next to each other
        n_ = a[0] + b[0]
        share = np.divide(b[0], n_, out=np.zeros(len(x)), where=n_ > 0)
        step = b[1] - a[1]
        return [n_, np.where(a[0] > 0, a[1] + step * share, b[1]), a[2] + b[2] + step * step * a[0] * share, np.maximum(a[3], b[3]), np.minimum(a[4], b[4])]

    made, taken, k = [np.full(len(x), e) for e in none], 0, 1
    while k <= n:
        if n & k:
            made, taken = both(back(part, taken), made), taken + k
        part, k = both(back(part, k), part), 2 * k
    count, mean, dev, most, least = made
    return {"count": count, "sum": count * mean, "mean": mean, "dev": dev, "max": most, "min": least}


def with_zscore(df: DataFrame, value: str, n: int, name: str = "z", series=SERIES, rows: int = 0) -> DataFrame:
    """Population z-score over n rows; 0 until there are n, null where they are equal."""
    import numpy as np

    def score(columns, own):
        x = columns[0]
        f = frames(x, n)
        spread = np.sqrt(f["dev"] / n)
        flat = f["max"] == f["min"]
        with np.errstate(divide="ignore", invalid="ignore"):
            return [np.where(f["count"] < n, 0.0, np.where(flat, np.nan, (x - f["mean"]) / spread))]

    return near_frames(df, score, f"{name} double", [value], n - 1, series=series, rows=rows)


def with_rolling(df: DataFrame, made: dict[str, tuple[str, str, int]], full_only: bool = False, series=SERIES, rows: int = 0) -> DataFrame:
    """Rolling aggregates of any length: name -> (count, sum, mean, max or min; column; rows); with `full_only` null until all rows have a value."""
    import numpy as np

    inputs = list(dict.fromkeys(c for _, c, _ in made.values()))

    def roll(columns, own):
        of = dict(zip(inputs, columns))
        known = {key: frames(of[key[0]], key[1]) for key in dict.fromkeys((c, n) for _, c, n in made.values())}
        out = []
        for agg, c, n in made.values():
            f = known[c, n]
            least = n if full_only else 0 if agg == "count" else 1
            out.append(np.where(f["count"] >= least, f[agg], np.nan))
        return out

    most = max(n for _, _, n in made.values())
    return near_frames(df, roll, ", ".join(f"{name} double" for name in made), inputs, most - 1, series=series, rows=rows)


def spine(ends: DataFrame, every: str) -> DataFrame:
    """Rows of `ends` (a and b, and what names them) once for each interval from a to b: by days first, so no array holds a series."""
    step, names = F.expr(f"INTERVAL {every}"), [c for c in ends.columns if c not in ("a", "b")]
    each = F.unix_micros(F.col("a") + step) - F.unix_micros("a")
    chunk = F.greatest(F.floor(F.lit(86_400_000_000) / each), F.lit(1)).cast("long")
    rows = ends.withColumns({"__each": each, "__n": F.floor((F.unix_micros("b") - F.unix_micros("a")) / each).cast("long"), "__chunk": chunk})
    rows = rows.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"), F.col("__chunk"))))
    rows = rows.withColumn("__i", F.explode(F.sequence("__from", F.least(F.col("__n"), F.col("__from") + F.col("__chunk") - 1))))
    return rows.select(*names, F.timestamp_micros(F.unix_micros("a") + F.col("__i") * F.col("__each")).alias("ts"))


def ffill(value: str | Column, series=SERIES, order=ORDER) -> Column:
    return F.last(value, ignorenulls=True).over(running(series, order))


def backward(series=SERIES, order=ORDER):
    """From the current row to the last one, as a running frame of the reversed order: one pass, not one per row."""
    return Window.partitionBy(*series).orderBy(*[F.desc(c) for c in order]).rowsBetween(START, 0)


def bfill(value: str | Column, series=SERIES, order=ORDER) -> Column:
    return F.last(value, ignorenulls=True).over(backward(series, order))


def upsample(df: DataFrame, value: str, windows: list[int], aggs=("sum", "avg", "max", "min")) -> DataFrame:
    """Rolling aggregates over the last n non-null rows, null until there are n, for every n (powers of two).

    Frames double: that of 2k rows is that of k rows and the one k rows before, so a row costs log2(n) steps, not n.
    """
    if any(n & (n - 1) for n in windows):
        raise ValueError("windows must be powers of two")
    most = max(windows)

    def doubled(rows: DataFrame, key) -> DataFrame:
        w, k = ordered(key), 1
        rows = rows.withColumns({"__sum": F.col(value).cast("double"), "__max": F.col(value), "__min": F.col(value)})
        while True:
            if k in windows:
                made = {"sum": F.col("__sum"), "avg": F.col("__sum") / k, "max": F.col("__max"), "min": F.col("__min")}
                rows = rows.withColumns({f"{value}_{a}_{k}": made[a] for a in aggs})
            if k == most:
                return rows.drop("__sum", "__max", "__min")
            past = {c: F.lag(c, k).over(w) for c in ("__sum", "__max", "__min")}
            full_now = past["__sum"].isNotNull()
            rows = rows.withColumns({
                "__sum": F.col("__sum") + past["__sum"], "__max": F.when(full_now, F.greatest("__max", past["__max"])),
                "__min": F.when(full_now, F.least("__min", past["__min"])),
            })
            k *= 2

    return near(df.where(F.col(value).isNotNull()), doubled, most - 1)


def chunks_of(df: DataFrame, chunk: Column | None = None, series=SERIES) -> int:
    """The most chunks that a series has."""
    own = df.select(*series, (F.to_date("ts") if chunk is None else chunk).alias("__c")).distinct().groupBy(*series).count()
    return own.agg(F.max("count")).first()[0] or 1


def linear_scan(df: DataFrame, a: float | Column, b: Column, name: str, chunk: Column | None = None, series=SERIES, order=ORDER, most: int = 0) -> DataFrame:
    """y_t = a_t * y_(t-1) + b_t with y before the first row 0; parallel inside one series.

    Each chunk is folded from zero, by doubling steps over arrays; what it carries on is (product of a, its end), an
    associative pair. Pairs of the few chunk rows are combined by doubling too, which gives each chunk's carry-in c, and a
    row gets c times the product of a up to it on top. `most` is the most chunks a series has (counted if not given).
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import DoubleType, LongType, StructType

    chunk = F.to_date("ts") if chunk is None else chunk
    keys = [*series, "__c"]
    most = most or chunks_of(df, chunk, series)
    keyed = df.withColumns({"__a": a if isinstance(a, Column) else F.lit(float(a)), "__b": b.cast("double"), "__c": chunk})
    schema = StructType(list(keyed.schema.fields)).add("__y", DoubleType()).add("__q", DoubleType()).add("__k", LongType())

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        y, q, k = pdf["__b"].to_numpy(copy=True), pdf["__a"].to_numpy(copy=True), 1
        while k < len(y):
            y[k:] += q[k:] * y[:-k]
            q[k:] *= q[:-k].copy()
            k *= 2
        return pdf.assign(__y=y, __q=q, __k=np.arange(1, len(pdf) + 1))

    folded = keyed.groupBy(*keys).applyInPandas(fold, schema)
    small = folded.groupBy(*keys).agg(F.max_by("__y", "__k").alias("__e"), F.max_by("__q", "__k").alias("__p"))
    w, k = ordered(series, ("__c",)), 1
    while k < most:
        e, p = F.lag("__e", k).over(w), F.lag("__p", k).over(w)
        small = small.withColumns({"__e": F.col("__e") + F.col("__p") * F.coalesce(e, F.lit(0.0)), "__p": F.col("__p") * F.coalesce(p, F.lit(1.0))})
        k *= 2
    carry = small.select(*keys, F.coalesce(F.lag("__e").over(w), F.lit(0.0)).alias("__in"))
    out = _small_join(folded, carry, keys).withColumn(name, F.col("__y") + F.col("__q") * F.col("__in"))
    return out.drop("__a", "__b", "__c", "__y", "__q", "__k", "__in")


def fold_ordered(df: DataFrame, keys: list[str], step, schema: str, order=ORDER) -> DataFrame:
    """An ordered fold over each group: `step(state, row)` returns (state, row or None); state is None at a group's start.

    Rows are sorted by Spark's spilling shuffle and come in Arrow batches, so only the state is held, never a group. For
    recurrences that have no associative form; a group is one task.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    names, n = df.columns, len(keys)
    at = [names.index(k) for k in keys]

    def run(batches):
        key, state = object(), None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(row[i] for i in at)
                if own != key:
                    key, state = own, None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            columns = list(zip(*out)) if out else [[] for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    assert n
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def islands(df: DataFrame, flag: Column, series=SERIES, order=ORDER) -> DataFrame:
    """Runs of rows where `flag` holds: first and last ts, rows. A null flag does not hold; a run is named by how many rows do not hold before it."""
    marked = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    runs = carried(marked, {"__g": ("sum", F.when(F.col("__f"), 0).otherwise(1))}, series=series, order=order).where("__f")
    return runs.groupBy(*series, "__g").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n")).drop("__g")


def filled(df: DataFrame, forward: dict[str, str], backward_: dict[str, str] | None = None) -> DataFrame:
    """Columns filled forward and backward (name -> source column), chunk by chunk."""
    specs = {k: ("last", F.col(v)) for k, v in forward.items()} | {k: ("next", F.col(v)) for k, v in (backward_ or {}).items()}
    return carried(df, specs)


def interpolate(df: DataFrame, value: str, longest_s: int) -> DataFrame:
    """Linear in time inside gaps whose ends are `longest_s` seconds apart at most; null in longer gaps."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.unix_micros("ts").alias("t"), F.col(value).alias("x")))
    rows = carried(df, {"__a": ("last", known), "__z": ("next", known)})
    t0, t1, x0, x1 = F.col("__a.t"), F.col("__z.t"), F.col("__a.x"), F.col("__z.x")
    line = x0 + (x1 - x0) * (F.unix_micros("ts") - t0) / F.nullif(t1 - t0, F.lit(0))
    return rows.withColumn(value, F.coalesce(F.col(value), F.when(t1 - t0 <= longest_s * 1_000_000, line))).drop("__a", "__z")


def started(df: DataFrame, columns: list[str], series=SERIES) -> DataFrame:
    """Rows from where every column has begun to where the first one ends."""
    spans = df.groupBy(*series).agg(
        F.greatest(*[F.min(F.when(F.col(c).isNotNull(), F.col("ts"))) for c in columns]).alias("__a")
        if len(columns) > 1 else F.min(F.when(F.col(columns[0]).isNotNull(), F.col("ts"))).alias("__a"),
        F.least(*[F.max(F.when(F.col(c).isNotNull(), F.col("ts"))) for c in columns]).alias("__z")
        if len(columns) > 1 else F.max(F.when(F.col(columns[0]).isNotNull(), F.col("ts"))).alias("__z"),
    )
    return df.join(spans, list(series)).where("ts BETWEEN __a AND __z").drop("__a", "__z")


def filled_bars(bars: DataFrame, every: str) -> DataFrame:
    """Bars on a gapless spine: a missing one has the last close in all four prices and volume 0."""
    ends = bars.groupBy(*SERIES).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    x = carried(spine(ends, every).join(bars, [*SERIES, "ts"], "left"), {"close": ("last", F.col("close"))}, order=("ts",))
    return x.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")} | {"volume": F.coalesce("volume", F.lit(0))})


def with_touches_ahead(df: DataFrame, value: str, n: int, move: float, name: str, series=SERIES, rows: int = 0) -> DataFrame:
    """1 where one of the next n rows is `move` or more above this one, else 0; rows after the last count for nothing."""
    import numpy as np

    from tickloom.operators.searches import Tops

    def touches(columns, own):
        x, at = columns[0], np.arange(len(columns[0]))
        found = Tops(x).first(at + 1, np.where(np.isnan(x), np.inf, x + move))
        return [((found <= at + n) & (found < len(x))).astype(float)]

    return near_frames(df, touches, f"{name} double", [value], 0, n, series, rows=rows).withColumn(name, F.col(name).cast("int"))


def extended(entry: Column, n: int, series=SERIES) -> Column:
    """True at an entry and at the n - 1 rows after it."""
    return F.max(F.coalesce(entry, F.lit(False))).over(trailing(n, series))
