"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint bit is set if it is set in over half of the XXH64 values of a text's 3-word shingles. Fingerprints
link at RADIUS or fewer differing bits; components of links are near-duplicate groups.

Search over the distinct fingerprints:
1. Pair statistics of all 64 bits (counted over all fingerprints) put correlated bits into the same of PARTS
   partitions: correlated bits select little together, so they should not weaken several partitions.
2. Pigeonhole: if the thresholds sum to RADIUS - PARTS + 1, two linked fingerprints agree in some partition up
   to its threshold; -1 leaves a partition out. Collisions of every partition, counted over all fingerprints,
   and bit agreement rates estimate the candidates at thresholds 0 and 1; a dynamic programme takes the
   cheapest allocation.
3. Fingerprints are grouped by the agreeing bits. Groups of up to BUCKET members compare all their pairs
   inside one row. In larger ones each member is listed under itself and every fingerprint one bit
   away outside the agreeing bits; two members are linked exactly if they share such an entry, and an entry has 65
   members at most. So no group, however large, forms all its pairs and no link is lost.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; repeated
rows give repeated rows; component_id is null only where no document of the component has a doc_id; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import append, drop_written, materialise
from tickloom.llm.components import components

RADIUS = 2
PARTS = 3
BUCKET = 64
SEED = 42
BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, row=()) -> DataFrame:
    """doc_id, fp (signed) and the columns `row` of every document."""
    made = append(docs.select("doc_id", "text", *row), lambda texts: [[fingerprint(t) for t in texts]], [("fp", "long")])
    return made.drop("text")


def _bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have both bits i and j set, for all i, j."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((64, 64), dtype=np.int64)
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for i in range(0, len(values), 4096):
                bits = np.unpackbits(values[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total += (bits.T.astype(np.float64) @ bits.astype(np.float64)).astype(np.int64)
        i, j = np.triu_indices(64)
        keep = total[i, j] > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array(total[i, j][keep], pa.int64())],
            names=["i", "j", "n"],
        )

    out = np.zeros((64, 64), dtype=np.float64)
    sums = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # 2,080 rows at most
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["n"]
    return out


def partition_bits(both: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """Partitions of 64 // parts bits or one more; each grows from a free bit by the most correlated free one."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    corr[sd < 1e-5] = corr[:, sd < 1e-5] = 1.0  # constant bits select nothing: keep them together
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        order = sorted(free)
        group = [max(order, key=lambda b: (corr[b, order].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> list[int]:
    """Thresholds summing to `total` with the least cost; costs[i][t] for each allowed threshold t of partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, more in cost.items():
                if used + t not in step or c + more < step[used + t][0]:
                    step[used + t] = (c + more, [*chosen, t])
        best = step
    return best[total][1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan(fps: DataFrame) -> list[tuple[int, int]]:
    """(partition and deleted bit as one number, mask of agreeing bits) of every probe."""
    n = fps.count()
    both = _bit_counts(fps)
    groups = partition_bits(both, n)
    masks = [sum(1 << b for b in g) for g in groups]
    hits = []
    for m in masks:
        same = fps.groupBy(F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("c"))
        hits.append(same.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0.0)
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    costs = []
    for g, h in zip(groups, hits):
        near = h * (1 + sum((1 - agree[b]) / agree[b] for b in g))
        costs.append({-1: 0.0, 0: h + n, 1: near + n * len(g)})
    chosen = allocate(costs, RADIUS - PARTS + 1)
    probes = []
    for k, (g, m, t) in enumerate(zip(groups, masks, chosen)):
        if t == 0:
            probes.append((k * 100, m))
        if t == 1:
            probes += [(k * 100 + 1 + b, m & ~(1 << b)) for b in g]
    return probes


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of `fps` exactly as all links do."""
    probes = plan(fps)
    entry = F.array(
        *[
            F.struct(F.lit(k).alias("probe"), F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for k, m in probes
        ]
    )
    keys = fps.select("fp", F.inline(entry))
    sizes = keys.groupBy("probe", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(keys.join(sizes, ["probe", "key"]), "simhash-keys")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= RADIUS
    small = shared.where(F.col("n") <= bucket).groupBy("probe", "key").agg(F.collect_list("fp").alias("m"))
    found = F.flatten(
        F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    direct = small.select(F.inline(found))
    flips = F.transform(
        F.filter(F.array(*[F.lit(_signed(1 << b)) for b in range(64)]), lambda f: f.bitwiseAND(F.col("mask")) == 0),
        lambda f: F.col("fp").bitwiseXOR(f),
    )
    around = shared.where(F.col("n") > bucket).select("fp", "probe", "key", F.explode(F.concat(F.array("fp"), flips)).alias("at"))
    hubs = around.groupBy("probe", "key", "at").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
    star = hubs.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return direct.union(star).distinct()


def grouped(docs: DataFrame, row=()) -> DataFrame:
    """doc_id, fp, component_id, the columns `row`, and `label`, which names the component, of every document."""
    fps = materialise(fingerprints(docs, row), "simhash-fp")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    parts = components(links(classes.select("fp")))
    labelled = classes.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = materialise(labelled.join(smallest, "label").select("fp", "label", "component_id"), "simhash-named")
    drop_written(classes, parts)
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: that of the smallest doc_id (rows without one come last), the least row hash on ties.

    Rows are told apart by doc_id and a hash of all their columns, so of repeated rows one stays too.
    """
    key = F.xxhash64(*[f.name for f in docs.schema.fields if f.dataType.typeName() != "map"])
    found = grouped(docs.withColumn("__simhash_row", key), ["__simhash_row"])
    alike = found.groupBy("label", "doc_id", "__simhash_row").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__simhash_row")
    best = alike.groupBy("label").agg(F.min(F.struct(first.alias("at"), "n")).alias("b"))
    best = materialise(best.select(F.col("b.at.doc_id").alias("__simhash_id"), F.col("b.at.__simhash_row").alias("__simhash_key"), F.col("b.n").alias("__simhash_n")), "simhash-kept")
    same = (F.col("__simhash_row") == F.col("__simhash_key")) & F.col("doc_id").eqNullSafe(F.col("__simhash_id"))
    kept = docs.withColumn("__simhash_row", key).join(best, same)
    once = kept.where("__simhash_n = 1").select(docs.columns)
    if best.where("__simhash_n > 1").isEmpty():
        return once
    many = kept.where("__simhash_n > 1").dropDuplicates(["__simhash_row", "__simhash_id"])
    return once.unionByName(many.select(docs.columns))
