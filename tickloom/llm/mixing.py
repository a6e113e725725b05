"""Mixing sources to target weights along a time-varying curriculum (native DataFrame code only).

Sources, ordered by code point with null last, weigh 5, 2, 1 in turn and share RATE of all words; no target
exceeds REPEAT times its source (the excess is shared again by weight until none is above).

A source's weight over training time t in [0, 1] is linear, w(t) = target * (1 + slope * (2 t - 1)); slopes go
from -TILT to +TILT through the ordered sources, so early sources lead and late ones close the run. Its
integral W(t) = target * ((1 - slope) t + slope t^2) is the source's cumulative demand. A word at cumulative
place x of what is taken from a source trains at the t with W(t) = x. A document is placed by its first word, once
for each pass that takes words of it: `positions` holds one place a pass, in order, and all passes but the last take
the whole document. `position` is the place of the first pass (1 where nothing is taken, with no `positions`); the
rows of `mix` are range-sorted by it, and `passes` gives one row a document and pass, range-sorted by its own place.

Inside a source, documents come in the order of a hash. Each pass takes whole documents until the target is
reached; the document on the boundary gives what is left. So the words taken equal the target, rounded.
The prefix sums run in two levels (chunks of a source, then documents of a chunk), so a source that holds a
third of all rows is spread over many tasks.

Defined results: null text has size 0 and takes nothing; null source is a source; repeated rows are separate
documents; other columns of the input are ignored, or carried along on demand; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import WORD, materialise

WEIGHTS = (5, 2, 1)
RATE = 1.5
REPEAT = 2
TILT = 0.8
#: Documents a chunk holds on average.
CHUNK_ROWS = 4096
#: Sources are planned on the driver up to this many; the plan of more would not be small.
MAX_SOURCES = 100_000


def plan(sizes: dict, weights=WEIGHTS, rate: float = RATE, repeat: int = REPEAT) -> dict:
    """source -> (target, slope), from source -> words."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, rate * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and left * weight[s] / total > repeat * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = float(repeat * sizes[s])
            left -= target[s]
            open_.discard(s)
    n = len(order)
    slope = {s: TILT * (2 * i / (n - 1) - 1) if n > 1 else 0.0 for i, s in enumerate(order)}
    return {s: (float(target[s]), slope[s]) for s in order}


OWN = ("size", "source_size", "target", "taken", "position", "positions")


def mix(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, position, positions; range-sorted by position.

    With `whole` the documents' other columns come with them; those named like one of the above (but doc_id and source) get
    `document_` before their name. Rows alike in all columns are brought back to their texts as one.
    """
    spark = docs.sparkSession
    row = F.xxhash64(*[f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]) if whole else F.lit(0).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = materialise(
        docs.select(
            "doc_id",
            "source",
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.col("doc_id"), F.lit("mix"), F.col("source"), F.col("text")).alias("h"),
            row.alias("__mix_row"),
        ),
        "mix-sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix over a coarser column")
    planned = plan({r["source"]: r["source_size"] for r in found})
    chunks = max(1, sum(r["rows"] for r in found) // CHUNK_ROWS)
    # One text literal holds the plan of all sources (MAX_SOURCES rows at most), so the query does not grow with them.
    listed = json.dumps([{"s": r["source"], "source_size": r["source_size"], "target": planned[r["source"]][0], "slope": planned[r["source"]][1]} for r in found])
    kind = "array<struct<s:string,source_size:bigint,target:double,slope:double>>"
    targets = spark.range(1).select(F.inline(F.from_json(F.lit(listed), kind)))

    # Level one: words of each chunk (a range of the hash order), then the words before it.
    rank = F.shiftrightunsigned("h", 33).cast("double") / float(1 << 31)
    # Rows alike in doc_id, source and text are one row with a count until they are placed: no chunk holds them all.
    sized = sized.withColumn("chunk", F.floor(rank * chunks).cast("int"))
    alike = sized.groupBy("source", "chunk", "h", "doc_id", "size", "__mix_row").agg(F.count(F.lit(1)).alias("n"))
    by_chunk = sized.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = by_chunk.select(
        F.col("source").alias("s"),
        F.col("chunk").alias("c"),
        (F.sum("words").over(Window.partitionBy("source").orderBy("chunk")) - F.col("words")).alias("before"),
    )
    # Level two: words before each document inside its chunk.
    inside = Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "size", "__mix_row").rowsBetween(Window.unboundedPreceding, -1)
    some = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1), F.lit(CHUNK_ROWS)))
    each = F.explode(F.sequence("from", F.least(F.col("n"), F.col("from") + CHUNK_ROWS) - 1))
    placed = (
        alike.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
        .join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
        .drop("s", "c")
        .join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("from", some)
        .withColumn("copy", each)
        .withColumn("at", F.col("before") + F.col("inner") + F.col("copy") * F.col("size"))
    )
    goal = F.round("target").cast("long")
    starts = [p * F.col("source_size") + F.col("at") for p in range(REPEAT)]
    taken = [F.greatest(F.lit(0), F.least(F.col("size"), goal - x)) for x in starts]
    straight = 1 - F.col("slope")

    def place(start):
        share = F.least(F.lit(1.0), start / F.greatest(goal.cast("double"), F.lit(1.0)))
        root = (-straight + F.sqrt(straight * straight + 4 * F.col("slope") * share)) / (2 * F.col("slope"))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("slope") == 0, share).otherwise(root) + 0.0))

    positions = F.array_compact(F.array(*[F.when(n > 0, place(x)) for n, x in zip(taken, starts)]))
    mixed = placed.select(
        "doc_id", "size", "source", "source_size", "target", sum(taken[1:], taken[0]).cast("long").alias("taken"),
        place(starts[0]).alias("position"), positions.alias("positions"), "__mix_row",
    )
    if not whole:
        return mixed.drop("__mix_row").orderBy("position", "doc_id")
    rows = docs.withColumn("__mix_key", row).withColumnsRenamed({c: f"document_{c}" for c in docs.columns if c in OWN})
    if not alike.where("n > 1").isEmpty():
        rows = rows.dropDuplicates(["__mix_key", "doc_id"])
    same = (F.col("__mix_row") == F.col("__mix_key")) & F.col("doc_id").eqNullSafe(F.col("__mix_id"))
    both = rows.join(mixed.drop("source").withColumnRenamed("doc_id", "__mix_id"), same)
    return both.select(*[c for c in rows.columns if c != "__mix_key"], *OWN).orderBy("position", "doc_id")


def passes(mixed: DataFrame) -> DataFrame:
    """doc_id, source, pass, position, words of every pass over a document of `mix`; range-sorted by position."""
    each = mixed.select("doc_id", "source", "size", "taken", F.posexplode("positions").alias("pass", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    return each.select("doc_id", "source", "pass", "position", words.alias("words")).orderBy("position", "doc_id", "pass")
