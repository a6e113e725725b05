"""Scalar functions over prices, symbols and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def measurable(unit: str, symbol: str = "sym", price: str = "price", size: str = "size", side: str = "side", home: str | None = None) -> Column:
    """What a bar sums: `tick` the side, the symbol's own unit the signed size, `usd` the signed notional, `xbt` the signed home notional
    (notional by price where the source has none)."""
    signed = F.col(side) * F.col(size)
    if unit == "tick":
        return F.col(side)
    if unit == "usd":
        return signed * F.col(price)
    if unit == "xbt":
        return F.col(side) * (F.col(home) if home else F.col(size).cast("double") / F.col(price).cast("double"))
    if unit == symbol:
        return signed
    raise ValueError(f"no measure {unit}")


def numbers(texts: str) -> Column:
    """The numbers among a list of texts, in order; what is no number is left out."""
    return F.filter(F.transform(F.col(texts), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def aliased(symbol: str, names: dict[str, str]) -> Column:
    """A symbol by its alias; others stay."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.col(symbol)), F.col(symbol))


def inflated(price: str, symbol: str, prefix: str, factor: float = 1e6) -> Column:
    """Prices of low-value assets times a factor."""
    return F.when(F.col(symbol).startswith(prefix), F.col(price) * factor).otherwise(F.col(price))


def fee(price: str, quantity: str, rates: dict[str, float], kind: Column) -> Column:
    """Rate of the order kind on the notional; a null quantity counts as 1."""
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    return F.col(price) * F.abs(F.coalesce(F.col(quantity), F.lit(1))) * F.try_element_at(table, kind)


def above_one(rate: str) -> Column:
    """Rates below 1 inverted; 0 has no inverse and gives null."""
    return F.when(F.col(rate) < 1, 1 / F.nullif(F.col(rate), F.lit(0.0))).otherwise(F.col(rate))


def interactions(columns: list[str]) -> dict[str, Column]:
    """Bias, the columns, and all products of two."""
    out = {"one": F.lit(1.0)} | {c: F.col(c) for c in columns}
    return out | {f"{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]}


def synthetic_quotes(price: str, spread: float) -> dict[str, Column]:
    return {"bid": F.col(price) - spread / 2, "ask": F.col(price) + spread / 2}


def precision_and_scale(x: str, digits: int = 14) -> tuple[Column, Column]:
    """Decimal digits of a number, all and after the point, of its text with `digits` significant digits and no zeros at the end."""
    text = F.format_string(f"%.{digits - 1}e", F.abs(F.col(x).cast("double")))
    kept = F.length(F.rtrim(F.regexp_replace(F.substring_index(text, "e", 1), r"\.", ""), F.lit("0")))
    place = F.substring_index(text, "e", -1).cast("int")  # power of ten of the first digit
    scale = F.greatest(kept - 1 - place, F.lit(0))
    return F.greatest(place + 1, F.lit(1)) + scale, scale


def lineage(name: str) -> tuple[Column, Column, Column]:
    """Tags, window and aggregator of a curve name of `key-value` items joined by `|`; settings of the curve are no tags."""
    settings = ["aggWindow", "aggAggregator", "levels", "unit_size", "alpha"]  # fixed values
    item = lambda s: F.struct(F.substring_index(s, "-", 1).alias("key"), F.regexp_replace(F.regexp_extract(s, "-(.*)$", 1), "_(book|bars)$", " $1").alias("value"))
    items = F.filter(F.split(name, r"\|"), lambda s: ~F.substring_index(s, "-", 1).isin(settings))
    window = F.regexp_extract(name, r"aggWindow-(\d+)", 1).try_cast("int")
    return F.map_from_entries(F.transform(items, item)), window, F.nullif(F.regexp_extract(name, r"aggAggregator-(\w+)", 1), F.lit(""))


def at_seconds(day: Column, seconds: Column) -> Column:
    """A day and seconds of it as a timestamp, to the millisecond, halves to even."""
    return F.timestamp_millis(F.unix_millis(day.cast("timestamp")) + F.bround(seconds * 1000).cast("long"))


def to_features(df, features: list[str]):
    """The columns of a model in its order; a missing one is null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in features])


def relative(x: Column, base: Column) -> Column:
    """Change relative to the base; null where that is 0."""
    return x / F.nullif(base, F.lit(0.0)) - 1
