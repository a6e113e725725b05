"""Tag-addressed series as one long table: (ts, value, tags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series_id(tags: str = "tags") -> Column:
    """md5 of the sorted tags."""
    return F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags)))))


def column_name(tags: str, order: list[str]) -> Column:
    """Values of the ordered tags, then of the others by key."""
    rest = F.transform(F.filter(F.array_sort(F.map_entries(tags)), lambda e: ~e["key"].isin(order)), lambda e: e["value"])
    return F.concat_ws("-", *[F.col(tags)[k] for k in order], rest)


def matching(series: DataFrame, want: dict[str, str]) -> DataFrame:
    """Rows whose tags contain all of `want`."""
    test = F.lit(True)
    for k, v in want.items():
        test = test & (F.col("tags")[k] == v)
    return series.where(test)


def window_aggregate(series: DataFrame, every: str, agg) -> DataFrame:
    """One value per series and interval; empty intervals give no row."""
    out = series.withColumn("id", series_id()).groupBy("id", F.window("ts", every).alias("w")).agg(agg("value").alias("value"))
    return out.select("id", F.col("w.start").alias("ts"), "value")


def _alike(df: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """`left_semi` or `left_anti` join on equal keys, where null equals null."""
    other = keys.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)]
    return df.join(other, on, how)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows win over existing rows of the same keys; null keys are keys too. Columns that one side lacks are null there."""
    return _alike(old, new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def _file_system(spark, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def has_table(spark, path: str) -> bool:
    """Whether a folder is there, by the file system of its path."""
    system, where = _file_system(spark, path)
    return system.exists(where)


def _stored(spark, path: str, partition: str, kind=None) -> DataFrame | None:
    """A partitioned table with its partition column as it is named on disk (text unless `kind` says otherwise); None if it has no files.

    Left to itself, Spark would read the folders `01` and `1` as one number.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    if not has_table(spark, path) or not spark.read.schema("__none int").parquet(path).inputFiles():
        return None
    found = spark.read.parquet(path).schema
    fields = [StructField(partition, kind or StringType()) if f.name == partition else f for f in found.fields]
    return spark.read.schema(StructType(fields)).parquet(path)


def write_upsert(new: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Upsert into a partitioned parquet table; only the partitions that `new` touches are read and rewritten.

    A null partition is a partition, and null keys are keys. Columns that `new` lacks are kept and null in its rows.
    """
    merged, stored = new, _stored(new.sparkSession, path, partition, new.schema[partition].dataType)
    if stored is not None:
        merged = upsert(_alike(stored, new, [partition], "left_semi"), new, keys)
    _rewrite(merged, path, partition)


def _rewrite(rows: DataFrame, path: str, partition: str) -> None:
    """Put rows made from a table in place of its partitions that they belong to: staged beside it, so that reads come first."""
    import uuid

    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    spark = rows.sparkSession
    spark.read.schema(rows.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    system, where = _file_system(spark, staged)
    system.delete(where, True)


def write_without(spark, path: str, partition: str, predicate: Column, start, stop) -> None:
    """Delete the rows that match in [start, stop) from a partitioned table; a partition that loses all its rows is removed.

    Only partitions that lose rows are rewritten. A partition is told by its folder, as files name it, so null partitions and
    names with escaped characters are partitions like others. The folders of emptied ones are listed in a file before anything
    is rewritten and go one by one after it. The predicate sees the partition column as Spark reads it by itself.
    """
    import uuid

    stored = _stored(spark, path, partition)
    if stored is None:
        return
    kind = spark.read.parquet(path).schema[partition].dataType
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    table = stored.withColumns({"__folder": folder, "__name": F.col(partition), partition: F.col(partition).cast(kind)})
    hit = F.coalesce(predicate, F.lit(False)) & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(stop).cast("timestamp"))
    marked = table.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    counts = marked.groupBy("__folder").agg(F.count(F.lit(1)).alias("__n"), F.count_if("__hit").alias("__gone")).where(F.col("__gone") > 0)
    listed = f"{path.rstrip('/')}.emptied-{uuid.uuid4().hex}"
    counts.write.parquet(listed)
    counts = spark.read.schema("__folder string, __n long, __gone long").parquet(listed)
    left = marked.join(counts.where("__gone < __n"), "__folder", "left_semi").where(~F.col("__hit"))
    rest = [c for c in stored.columns if c != partition]
    _rewrite(left.select(*rest, F.col("__name").alias(partition)), path, partition)
    for row in counts.where("__gone = __n").select("__folder").toLocalIterator():  # a file-system call each, none is held
        # file_path is a URI: its escapes come on top of those of the folder's own name
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(row[0]))
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    system, where = _file_system(spark, listed)
    system.delete(where, True)


def dropped(series: DataFrame, want: dict[str, str] | None = None, key: str | None = None) -> DataFrame:
    """All series but those whose tags are exactly `want`, or whose id is `key`."""
    if want is not None:
        pairs = [F.lit(x) for k in sorted(want) for x in (k, want[k])]
        key_of = F.md5(F.to_json(F.create_map(*pairs)))
        return series.where(series_id() != key_of)
    return series.where(series_id() != key)


def registered(registry: DataFrame | None, series: DataFrame) -> DataFrame:
    """(id, tags) of the registry and of all series, each id once."""
    new = series.select(series_id().alias("id"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags")))).alias("tags"))
    return (new if registry is None else registry.unionByName(new)).dropDuplicates(["id"])


def deregistered(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """The registry without the ids of `ids`."""
    return registry.join(ids.select("id").distinct(), "id", "left_anti")


def wide(series: DataFrame, want: dict[str, str], more: bool = False, name: str | None = None, most: int = 10_000) -> DataFrame:
    """Matching series as columns by ts, named `tag-value|tag-value` (or `name` for a single one).

    An error if more than one series matches and `more` is not set, or if there are more than `most`.
    """
    label = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("-", e["key"], e["value"])), "|")
    found = matching(series, want).withColumn("__n", label)
    names = sorted(r[0] for r in found.select("__n").distinct().limit(most + 1).collect())
    if len(names) > 1 and not more:
        raise ValueError("more than one series; give more tags")
    if len(names) > most:
        raise ValueError(f"more than {most} series do not make one wide table")
    out = found.groupBy("ts").pivot("__n", names or [""]).agg(F.first("value"))
    return out.withColumnRenamed(names[0], name) if name and len(names) == 1 else out


def keep_if_better(stored: DataFrame, new: DataFrame, keys: list[str], profit: str) -> DataFrame:
    """Stored rows, and new ones whose profit exceeds that stored under their keys (or that have none); the stored one stays on ties."""
    rows = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(profit), -F.col("__new"), *[F.hash(c) for c in rest])).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def watermark(loaded: DataFrame, source: DataFrame, by: list[str], lag_hours: int) -> DataFrame:
    """What to load: per key the last loaded and last available ts, where they are `lag_hours` or more apart."""
    have = loaded.groupBy(*by).agg(F.max("ts").alias("loaded"))
    there = source.groupBy(*by).agg(F.max("ts").alias("available"))
    gap = F.unix_timestamp("available") - F.unix_timestamp("loaded")
    return there.join(have, by, "left").where(F.col("loaded").isNull() | (gap >= lag_hours * 3600))


def points(df: DataFrame, ids: list[str], fields: list[str], tags: dict[str, Column]) -> DataFrame:
    """A wide frame as points (ts, value, tags): one for each field that is not null, the field's name among the tags."""
    long = df.unpivot(ids, fields, "__f", "value").where(F.col("value").isNotNull())
    pairs = [x for k, v in tags.items() for x in (F.lit(k), v)]
    return long.select("ts", "value", F.create_map(*pairs, F.lit("field"), F.col("__f")).alias("tags"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; must be empty before bars are stored."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def without(df: DataFrame, predicate: Column, start, stop) -> DataFrame:
    """Rows but those that match the predicate in [start, stop); a null predicate does not match."""
    hit = F.coalesce(predicate, F.lit(False)) & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(stop).cast("timestamp"))
    return df.where(~hit)


def retagged(series: DataFrame, measurement: str, remove: list[str]) -> DataFrame:
    """A measurement with fewer tags; points that then share a time and tags become one, the greatest."""
    mine = F.col("tags")["measurement"] == measurement
    fewer = series.where(mine).withColumn("tags", F.map_filter("tags", lambda k, v: ~k.isin(remove)))
    one = fewer.withColumn("__id", series_id()).groupBy("__id", "ts").agg(F.max("value").alias("value"), F.first("tags").alias("tags"))
    return series.where(~F.coalesce(mine, F.lit(False))).select("ts", "value", "tags").unionByName(one.select("ts", "value", "tags"))


def prediction_points(df: DataFrame, model: str, fields: list[str]) -> DataFrame:
    """Predictions as points, one series per model and field."""
    return points(df, ["ts", model], fields, {"measurement": F.lit("prediction"), "model": F.col(model)})


def label_points(df: DataFrame, label: str, asset: str) -> DataFrame:
    """Labels above 0 as points."""
    return points(df.where(F.col(label) > 0), ["ts", asset], [label], {"measurement": F.lit("label"), "asset": F.col(asset)})


def write_experiment(predictions: DataFrame, path: str) -> None:
    """Predictions by experiment and stage; a stage that is written again replaces what was there."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ex", "stage").parquet(path)


def between(df: DataFrame, start, stop) -> DataFrame:
    return df.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp")))


def snapshots(df: DataFrame, by: str, member: str) -> DataFrame:
    """Sorted members of each date."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(member)).alias("members"))


def memberships(df: DataFrame, by: str, member: str) -> DataFrame:
    """Dated rows of members as spells: from the first to the last of the dates, of all there are, that follow each other."""
    from pyspark.sql import Window

    dates = df.select(by).distinct().withColumn("__d", F.row_number().over(Window.orderBy(by)))  # one row a date
    rows = df.select(by, member).distinct().join(F.broadcast(dates), by)
    rows = rows.withColumn("__g", F.col("__d") - F.row_number().over(Window.partitionBy(member).orderBy(by)))
    return rows.groupBy(member, "__g").agg(F.min(by).alias("since"), F.max(by).alias("until")).drop("__g")


def factor_rows(df: DataFrame, by: list[str], date: str, factor: str, last_date: str) -> DataFrame:
    """Factors of series that are not flat, each closed by a row of factor 1 at a late date."""
    w = df.groupBy(*by).agg(F.min(factor).alias("__a"), F.max(factor).alias("__z")).where("__a <> __z").select(*by)
    rows = df.select(*by, date, factor).join(w, by, "left_semi")
    return rows.unionByName(w.select(*by, F.lit(last_date).cast("date").alias(date), F.lit(1.0).alias(factor)))


def first_per_key(pages: list[DataFrame], key: str) -> DataFrame:
    """All rows of the pages, the first of each key by page, then by the whole row."""
    out = None
    for i, page in enumerate(pages):
        rows = page.withColumn("__p", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "__p")]
    best = out.groupBy(key).agg(F.min(F.struct("__p", *rest)).alias("__b"))
    return best.select(key, *[F.col(f"__b.{c}").alias(c) for c in rest])


def aliased_copy(df: DataFrame, symbol: str, alias: str) -> DataFrame:
    """The rows, and a symbol's rows under its alias for the days on which the alias has none on that exchange."""
    have = df.where(F.col("symbol") == alias).select("exchange", F.to_date("ts").alias("__d")).distinct()
    copy = df.where(F.col("symbol") == symbol).withColumns({"__d": F.to_date("ts"), "symbol": F.lit(alias)}).join(have, ["exchange", "__d"], "left_anti")
    return df.unionByName(copy.drop("__d"))


def normaliser(df: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest and largest value of each column, one row each, in one pass."""
    long = df.agg(F.array(*[F.struct(F.lit(c).alias("col"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]).alias("__x"))
    return long.select(F.inline("__x"))


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """A stored normaliser brought up to date with new extremes."""
    return old.unionByName(new).groupBy("col").agg(F.min("min").alias("min"), F.max("max").alias("max"))
