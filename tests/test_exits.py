"""Hand cases of exits, padding and model evaluation."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.operators import evaluation, exits, padding

T0 = datetime(2024, 1, 1)
CURVE = "id long, ts timestamp, seq long, profit double, giveback double"


def at(m):
    return T0 + timedelta(minutes=m)


def test_ties_go_to_the_first_rule_and_no_hit_is_a_timeout(spark):
    rows = spark.createDataFrame([(1, at(1), 1, 5.0, 5.0), (1, at(2), 2, 9.0, 9.0), (2, at(1), 1, 0.0, 0.0), (2, at(3), 2, 1.0, 0.0)], CURVE)
    out = exits.first_exits(rows, {"target": F.col("profit") >= 9, "trail": F.col("giveback") >= 9})
    got = {r.id: (r.reason, r.exit_seq) for r in out.collect()}
    assert got == {1: ("target", 2), 2: ("timeout", 2)}


def test_no_rows_give_no_exits(spark):
    assert exits.first_exits(spark.createDataFrame([], CURVE), {"a": F.col("profit") > 0}).isEmpty()


def test_null_predicates_do_not_enter_and_null_vetoes_do_not_hold(spark):
    rows = spark.createDataFrame([(at(0), 1, None), (at(1), 2, 3.0)], "ts timestamp, seq long, x double")
    found = exits.select_entries(rows, {"s": (1, {"all": [F.col("x") > 0]})}, 5).collect()
    assert [(r.seq, r.end) for r in found] == [(2, at(6))]
    assert exits.vetoed(rows, F.col("x") > 0).count() == 1


def test_limit_order_on_the_limit_waits_when_late(spark):
    orders = spark.createDataFrame([(1, "X", "a", at(0), at(60), 1, 10.0)], "id long, exchange string, symbol string, ts timestamp, end timestamp, direction int, limit double")
    bars = spark.createDataFrame(
        [("X", "a", at(1), 10.0, 12.0, 10.0, 12.0, 9.9), ("X", "a", at(2), 9.5, 9.8, 9.6, 9.8, 9.4)],
        "exchange string, symbol string, ts timestamp, low double, high double, ask_low double, ask_high double, bid_high double",
    ).withColumn("bid_low", F.col("bid_high"))
    late = exits.limit_fills(orders, bars, ["exchange", "symbol"], 0.5).first()
    soon = exits.limit_fills(orders, bars, ["exchange", "symbol"], 0.5, late=False).first()
    assert (late.fill_ts, late.fill_price) == (at(2), 9.8)
    assert (soon.fill_ts, soon.fill_price) == (at(1), 10.0)


def test_gap_takes_next_open_and_equal_parts(spark):
    bars = spark.createDataFrame(
        [("X", "a", 1, at(1), 5.0, 5.0, 5.0, 5.0, 4, 0, 4, 0), ("X", "a", 4, at(2), 7.0, 7.0, 7.0, 7.0, 9, 3, 2, 1)],
        "exchange string, symbol string, volume_tick long, ts timestamp, open double, high double, low double, close double, volume_buy long, volume_sell long, count_buy long, count_sell long",
    )
    got = [(r.volume_tick, r.open, r.volume_buy, r.volume_sell, r.n) for r in padding.pad(bars).orderBy("volume_tick").collect()]
    assert got == [(1, 5.0, 4, 0, 4), (2, 7.0, 3, 1, 2), (3, 7.0, 3, 1, 2), (4, 7.0, 3, 1, 2)]


def test_quote_padding(spark):
    prices = [f"{s}_{c}" for s in ("bid", "ask") for c in ("open", "high", "low", "close")]
    schema = ", ".join([f"{c} double" for c in ("open", "high", "low", "close", *prices, "bid_size_removed", "ask_size_removed", "volume_buy", "volume_sell", "spread_high", "spread_low")])
    row = [1.0, 2.0, 0.5, 1.5] + [None] * 8 + [None, None, 0.0, 3.0, None, None]
    out = padding.fill_spread(padding.sync_sides(padding.from_trades(spark.createDataFrame([row], schema)), "bid_size_removed", "ask_size_removed")).first()
    assert (out.bid_high, out.bid_size_removed, out.ask_size_removed, out.ask_close, out.spread_high) == (2.0, 3.0, 0.0, None, None)


def test_equal_labels_weigh_zero_and_horizon(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "s string, y double")
    assert [r.weight for r in evaluation.attribution_weights(rows, "y", ["s"]).collect()] == [0.0, 0.0]
    assert evaluation.horizon(0.5, 0.25) == 2


def test_every_row_is_predicted_once(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = spark.range(30).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("label"))
    out = evaluation.out_of_fold(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows), LinearRegression(), F.col("id") % 3, 3)
    assert out.count() == out.select("id").distinct().count() == 30
    assert out.where("abs(prediction - label) > 1e-3").isEmpty()
