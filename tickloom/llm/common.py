"""Helpers shared by the corpus operators: table access, shared storage, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local one is made only on a local master whose session names none, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tickloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that `materialise` wrote and nothing has deleted yet.
_WRITTEN: list[str] = []


def owned(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that `clear` deletes."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}")
    return _WRITTEN[-1]


#: Spark deletes a query's shuffle files when the query ends, not when the JVM next finds its frames unused.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str, compression: str = "snappy", drop_shuffles: bool = False) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage is cut, lost executors cost no recomputation.

    `drop_shuffles`: the shuffle files of this write are deleted as soon as it is done.
    """
    spark, path = df.sparkSession, owned(df.sparkSession, f"{tag}-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLES_END, None)
    if drop_shuffles:
        spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(name)


def drop_written(*frames: DataFrame) -> None:
    """Delete the files of frames made by `materialise` once nothing reads them any more."""
    for df in frames:
        own = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        _delete(df.sparkSession, [p for p in _WRITTEN if p.rpartition("/")[2] in own])


def clear(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Delete all that `materialise` wrote since it had written `since` folders, but for the frame `keep`.

    A result that is still to be computed may read such files: clear once it is written.
    """
    own = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    _delete(spark, [p for p in _WRITTEN[since:] if p.rpartition("/")[2] not in own])


def written() -> int:
    """How many folders are written and not deleted."""
    return len(_WRITTEN)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def append(docs: DataFrame, fn, fields: list[tuple[str, str]], size: int = 0) -> DataFrame:
    """All columns of `docs` and those `fn` makes of the column `text`, one value a row, by Arrow batches.

    `fn(texts)` gets a list of up to `size` texts (SLICE unless told otherwise; None for null) and returns one list per field.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in fields))
    schema = StructType(docs.schema.fields + added.fields)
    types = [f.type for f in to_arrow_schema(added)]
    at, step = docs.columns.index("text"), size or SLICE

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                made = fn(part.column(at).to_pylist())
                arrays = [pa.array(x, t) for x, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(part.columns + arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


#: Texts that a Python function holds at once.
SLICE = 256


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
