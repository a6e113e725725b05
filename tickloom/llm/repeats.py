"""Removal of every byte covered by a LENGTH-byte string that starts anywhere else in the corpus, exactly.

Full suffix sorting is not used: a suffix tuple with its common-prefix value takes 16 bytes or more per byte of
text and several recursion levels write it again, over the disk limit of four times the compressed input (see
the README). What is kept of the method is its core, induction from a sorted sample of suffixes:

1. Sample. In every LENGTH-byte string the smallest hashed GRAM-gram is the anchor. It depends on the string
   alone, so equal strings have equal anchors at equal offsets. Runs of starts with one anchor form a segment,
   one per 67 bytes or so: (anchor hash, offsets, hash of all bytes that its strings cover).
2. External sort. Spark's spilling shuffles bring equal anchors together. An anchor that occurs once rules out
   all strings of its segment. Where all segments of an anchor agree, all their strings repeat.
3. Induction. Where they differ, one representative of each distinct segment is refined: its offsets are cut
   into aligned blocks (BLOCKS: 16 offsets, then 1). Strings of a block share a core of bytes; a core that no
   other segment has rules the block out, equal cores with equal full blocks settle it, and the rest goes on to
   single offsets, which always settles it. Matches flow back to all equal segments.

No pair of documents or segments is ever formed; hot anchors are split by aggregation before the shuffle and
by skewed-join handling. Strings are told apart by two independent 64-bit hashes (of the gram, and of the
covered bytes), not byte by byte: the result is exact but for a collision of both at once.

Defined results: null and empty texts have no bytes and one digest of nothing; repeated rows are copies of each other (searched once, whatever their number);
very long texts are read whole, in pieces of PIECE bytes that overlap; other columns are ignored, whatever their names (but for
`__repeats_*`); an empty table gives no rows. Bytes are judged on the input, overlaps count.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import drop_written, materialise, release

LENGTH = 200
GRAM = 40
BLOCKS = (16, 1)
#: Bytes hashed at once; longer texts are cut into pieces that overlap by LENGTH - 1.
PIECE = 1 << 18

_RANDOM = np.random.default_rng(20240607)
_CODES = [_RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            x = np.full(max(n, 2 * PIECE), base, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _POWERS[which] = tuple(made)
    return _POWERS[which]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any byte range of a buffer, by prefix sums."""

    def __init__(self, buf: np.ndarray, which: int):
        self.up, down = _powers(which, len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_CODES[which][buf] * down[: len(buf)], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[first]) * self.up[first]
        return _mix(raw + (end - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def _anchors(gram: np.ndarray, starts: int, w: int) -> np.ndarray:
    """Position of the smallest (then first) of gram[i : i + w] for each start i, by block minima from both sides."""
    low = np.uint64(255)
    n = (-(-len(gram) // w) + 1) * w
    keyed = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    keyed[: len(gram)] = (gram & ~low) | (np.arange(len(gram), dtype=np.uint64) % np.uint64(w))
    rows = keyed.reshape(-1, w)
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:starts]
    right = np.minimum.accumulate(rows, axis=1).ravel()[w - 1 : w - 1 + starts]
    base = (np.arange(starts) // w) * w
    first = (left >> np.uint64(8)) <= (right >> np.uint64(8))
    return base + np.where(first, left & low, (right & low) + np.uint64(w)).astype(np.int64)


def segments(parts: list[bytes]) -> dict[str, np.ndarray] | None:
    """Segments of texts: owner, anchor hash, segment hash, first start, offset of the anchor, starts."""
    lens = np.array([len(p) for p in parts])
    buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
    if len(buf) < LENGTH:
        return None
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), lens)
    one, two = Hashes(buf, 0), Hashes(buf, 1)
    places = np.arange(len(buf) - GRAM + 1)
    gram = one.of(places, places + GRAM)
    starts = len(buf) - LENGTH + 1
    anchor = _anchors(gram, starts, LENGTH - GRAM + 1)
    inside = np.nonzero(owner[:starts] == owner[LENGTH - 1 :])[0]
    if not len(inside):
        return None
    at = anchor[inside]
    cut = np.nonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1))))[0]
    first, a = inside[cut], at[cut]
    n = np.diff(np.append(cut, len(inside)))
    whole = two.of(first, first + n - 1 + LENGTH) ^ _mix(((a - first) * 256 + n).astype(np.uint64))
    return {
        "owner": owner[first],
        "ah": gram[a].view(np.int64),
        "ch": whole.view(np.int64),
        "s": (first - np.concatenate(([0], np.cumsum(lens)))[owner[first]]).astype(np.int32),
        "a": (a - first).astype(np.int16),
        "n": n.astype(np.int16),
    }


def _bytes(column) -> list:
    """The UTF-8 bytes of a string column, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def _groups(keys: list, texts: list):
    """(key, first byte, bytes) of texts and pieces of long texts, about PIECE bytes a time."""
    group, size = [], 0
    for k, t in zip(keys, texts):
        b = t or b""
        for at in range(0, max(1, len(b) - LENGTH + 1), PIECE):
            piece = b[at : at + PIECE + LENGTH - 1]
            group.append((k, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _scan(batches):
    """Batches (k, text) -> rows of segments."""
    import pyarrow as pa

    names = ["k", "ah", "ch", "p"]
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            for group in _groups(part.column(0).to_pylist(), _bytes(part.column(1))):
                found = segments([b for _, _, b in group])
                if found:
                    keys = np.array([k for k, _, _ in group], dtype=np.int64)[found["owner"]]
                    s = found["s"] + np.array([at for _, at, _ in group], dtype=np.int64)[found["owner"]]
                    place = (s << 16) | (found["a"].astype(np.int64) << 8) | found["n"]
                    cols = [keys, found["ah"], found["ch"], place]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _refine(block: int):
    """Batches (k, text, list of segment parts) -> blocks of aligned offsets with their core and full hashes."""
    import pyarrow as pa

    names = ["ah", "ch", "k", "s", "a", "j", "lo", "hi", "core", "full"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = _bytes(part.column(1))
                lens = np.array([len(t) for t in texts])
                at = np.concatenate(([0], np.cumsum(lens)))
                lists = part.column(2)
                rows = lists.flatten()
                owner = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
                ah, ch, s, a, lo, hi = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                lo, hi = lo.astype(np.int64), hi.astype(np.int64)
                first, last = lo // block, hi // block
                count = last - first + 1
                i = np.repeat(np.arange(len(owner)), count)
                j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                low, high = np.maximum(lo[i], j * block), np.minimum(hi[i], j * block + block - 1)
                anchor = s[i].astype(np.int64) + a[i] + at[owner[i]]
                buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
                hashes = Hashes(buf, 1)
                core = hashes.of(anchor - j * block, anchor - (j * block + block - 1) + LENGTH)
                full = hashes.of(anchor - high, anchor - low + LENGTH) ^ _mix((low * 256 + high).astype(np.uint64))
                keys = part.column(0).to_numpy(zero_copy_only=False)[owner[i]]
                cols = [ah[i], ch[i], keys, s[i], a[i], j.astype(np.int16), low.astype(np.int16), high.astype(np.int16), core.view(np.int64), full.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return run


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """`docs` with a 64-bit row key: doc_id where it names rows, else a hash of doc_id and text; and whether it names rows."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named"), F.countDistinct("doc_id").alias("ids")).first()
    if ids["n"] == ids["named"] == ids["ids"] and dict(docs.dtypes)["doc_id"] in ("bigint", "int"):
        return docs.withColumn("__repeats_row", F.col("doc_id").cast("long")), True
    return docs.withColumn("__repeats_row", F.xxhash64("doc_id", "text")), False


#: A segment's place packed into one long: first start, offset of the anchor from it, number of starts.
PLACE = ("p >> 16", "CAST((p >> 8) & 255 AS INT)", "CAST(p & 255 AS INT)")


def _range(first, end):
    """A byte range packed into one long: its first byte and its length (1,023 at most)."""
    return first * 1024 + (end - first)


def spans(keyed: DataFrame) -> DataFrame:
    """(k, spans): packed byte ranges that repeated strings cover in every text; texts without any are left out."""
    spark = keyed.sparkSession
    first, offset, n = (F.expr(x) for x in PLACE)
    text = keyed.select(F.col("__repeats_row").alias("k"), "text").where(F.col("text").isNotNull())
    segs = materialise(text.mapInArrow(_scan, "k long, ah long, ch long, p long"), "repeat-segments")
    # What a join reads is written first: both sides are then dealt for the join, and Spark can split hot keys.
    same = segs.groupBy("ah").agg(F.count(F.lit(1)).alias("c"), F.min("ch").alias("x"), F.max("ch").alias("y")).where("c > 1")
    same = materialise(same.select("ah", (F.col("x") != F.col("y")).alias("mixed")), "repeat-anchors")
    release(spark)
    found = materialise(segs.join(same, "ah"), "repeat-found")
    drop_written(segs, same)
    release(spark)

    # One representative of each distinct segment of the anchors whose segments differ.
    mixed = found.where("mixed")
    rep = F.min(F.struct("k", "p"))
    classes = materialise(mixed.groupBy("ah", "ch").agg(F.count(F.lit(1)).alias("c"), rep.alias("r")).select("ah", "ch", "c", "r.*"), "repeat-classes")
    offsets = [(offset - n + 1).alias("lo"), offset.alias("hi")]
    todo = classes.select("k", "ah", "ch", first.alias("s"), offset.alias("a"), *offsets)
    settled = classes.where("c > 1").select("ah", "ch", *offsets)
    for block in BLOCKS:
        part = F.struct("ah", "ch", "s", "a", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
        wanted = todo.groupBy(F.col("k").alias("tk")).agg(F.collect_list(part).alias("parts"))  # as long as the text at most
        level = text.join(wanted, F.col("k") == F.col("tk")).select("k", "text", "parts")
        level = materialise(
            level.mapInArrow(_refine(block), "ah long, ch long, k long, s long, a int, j smallint, lo smallint, hi smallint, core long, full long"),
            f"repeat-level{block}",
        )
        release(spark)
        cores = level.groupBy("ah", "j", "core").agg(F.count(F.lit(1)).alias("c"), F.min("full").alias("x"), F.max("full").alias("y"))
        cores = materialise(cores.where("c > 1").select("ah", "j", "core", (F.col("x") != F.col("y")).alias("open")), f"repeat-cores{block}")
        release(spark)
        judged = materialise(level.join(cores, ["ah", "j", "core"]).drop("core", "full", "j"), f"repeat-judged{block}")
        drop_written(level, cores)
        release(spark)
        settled = settled.unionByName(judged.where("not open").select("ah", "ch", "lo", "hi"))
        todo = judged.where("open").select("k", "ah", "ch", "s", "a", "lo", "hi")

    # Back to every segment: offset o of a segment is the string that starts at s + a - o.
    both = F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
    ranges = materialise(settled.groupBy("ah", "ch").agg(F.collect_set(both).alias("ranges")), "repeat-ranges")  # 161 at most
    release(spark)
    starts = mixed.join(ranges, ["ah", "ch"]).select("k", (first + offset).alias("anchor"), F.inline("ranges"))
    covered = starts.select("k", _range(F.col("anchor") - F.col("hi"), F.col("anchor") - F.col("lo") + LENGTH).alias("v"))
    plain = found.where("not mixed").select("k", _range(first, first + n - 1 + LENGTH).alias("v"))
    return covered.unionByName(plain).groupBy("k").agg(F.collect_list("v").alias("spans"))


def runs_of(packed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first byte, end) of the maximal runs that packed ranges of several texts cover, in order."""
    keys = np.sort((owner.astype(np.int64) << 48) | packed)
    owner, v = keys >> 48, keys & ((1 << 48) - 1)
    first = (owner << 40) | (v >> 10)
    reach = np.maximum.accumulate(first + (v & 1023))
    new = np.concatenate(([True], first[1:] > reach[:-1]))
    last = np.concatenate((np.nonzero(new)[0][1:] - 1, [len(keys) - 1]))
    low = (1 << 40) - 1
    return owner[new], first[new] & low, reach[last] & low


def _cut(texts: list, spans, again) -> list[tuple[bytes, int, int, int]]:
    """(kept bytes, bytes, removed bytes, removed runs) of each text; spans: an Arrow list column of packed ranges; again: whether the row is there again."""
    out = [(b"", len(t), len(t), 1) if whole and len(t or b"") >= LENGTH else (t or b"", len(t or b""), 0, 0) for t, whole in zip(texts, again.to_pylist())]
    values = spans.flatten().to_numpy(zero_copy_only=False)
    if not len(values):
        return out
    counts = spans.fill_null([]).value_lengths().to_numpy(zero_copy_only=False)
    owner, first, end = runs_of(values, np.repeat(np.arange(len(texts)), counts))
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in np.unique(owner).tolist():
        b, kept, at = texts[i], [], 0
        x, y = first[cuts[i] : cuts[i + 1]], end[cuts[i] : cuts[i + 1]]
        for from_, to in zip(x.tolist(), y.tolist()):
            kept.append(b[at:from_])
            at = to
        kept.append(b[at:])
        out[i] = (b"".join(kept), len(b), int((y - x).sum()), len(x))
    return out


def _joined(docs: DataFrame) -> DataFrame:
    """`docs` with the spans of each row, and `__repeats_all` where the row is there again.

    Rows alike in doc_id and text are one row to the search, and each of them is a repeat of the others as a whole.
    """
    keyed, named = _keyed(docs)
    texts = keyed.select("__repeats_row", "text")
    if named:
        found = spans(texts).withColumn("all", F.lit(False))
    else:
        again = texts.groupBy("__repeats_row").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("__repeats_row").alias("k"))
        again = materialise(again, "repeat-rows")
        same = F.col("__repeats_row") == F.col("k")
        one = texts.join(again, same, "left_anti").unionByName(texts.join(again, same, "left_semi").dropDuplicates(["__repeats_row"]))
        found = spans(one).join(again, "k", "left_anti").withColumn("all", F.lit(False))
        found = found.unionByName(again.select("k", F.lit(None).cast("array<bigint>").alias("spans"), F.lit(True).alias("all")))
    found = materialise(found, "repeat-spans")
    release(docs.sparkSession)
    found = found.select(F.col("k").alias("__repeats_of"), F.col("spans").alias("__repeats_spans"), F.col("all").alias("__repeats_all"))
    return keyed.join(found, F.col("__repeats_row") == F.col("__repeats_of"), "left")


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = _cut(_bytes(part.column(1)), part.column(2), part.column(3))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)),
                        pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    joined = _joined(docs.select("doc_id", "text")).select("doc_id", "text", "__repeats_spans", "__repeats_all")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated bytes taken out of `text` (a character cut apart goes whole)."""
    import pyarrow as pa

    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = _bytes(part.column(at))
                rows = _cut(texts, part.column(len(names)), part.column(len(names) + 1))
                kept = [None if t is None else r[0] if not r[3] else r[0].decode("utf-8", "ignore").encode() for t, r in zip(texts, rows)]
                columns = part.columns[: len(names)]
                columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _joined(docs).select(*names, "__repeats_spans", "__repeats_all").mapInArrow(run, docs.schema)
