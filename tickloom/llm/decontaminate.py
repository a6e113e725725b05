"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all WINDOW-word windows of the benchmark items; an item of fewer words is one pattern of its own
length. Patterns of one length form a search table: the block is the last two words at a position (one for
one-word patterns), the shift table gives how far a window end may safely move on when it sees a block, and
blocks that end a pattern lead to a bucket of patterns, chosen again by their first two words and confirmed by
direct comparison of all words.

Patterns are made on Spark and split by hash into blocks whose tables take about TABLE_BYTES of a Python process
(PATTERN_BYTES and what its text and items take for each pattern). Each block is one broadcast and one pass over the
documents; its hits are written and its broadcast is destroyed before the next, so memory is bounded whatever the
benchmark's size.

Defined results: null text has no words and is clean; an item without words matches nothing; a null item_id makes a
document contaminated but is no item; windows shared by items count for each; repeated rows give repeated rows; very long
texts are searched whole; all columns of the documents stay, whatever their names but for `__leaks_*` (those that the operator adds get `prefix`); an empty benchmark
leaves every document clean; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import append, drop_written, materialise

WINDOW = 10
TABLE_BYTES = 64 << 20
#: What a pattern takes in the tables beside its text (3 bytes a character) and 60 bytes an item.
PATTERN_BYTES = 600
#: The same words for Spark, of texts whose A-Z are lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes of words: ASCII digits and letters (lower-cased) and all bytes of other characters; the rest is space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SearchTable:
    """Shift and bucket tables for patterns of one length; patterns and blocks are words joined by spaces."""

    def __init__(self, patterns: dict[bytes, tuple], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list] = defaultdict(list)
        for p, items in patterns.items():
            w = p.split()
            for end in range(self.block, length + 1):
                key, move = b" ".join(w[end - self.block : end]), length - end
                if move < self.shift.get(key, self.far):
                    self.shift[key] = move
            self.buckets[b" ".join(w[-self.block :])].append((b" ".join(w[: self.block]), p, items))

    def search(self, words: list[bytes]) -> list[tuple[int, tuple]]:
        """(start, items) of every occurrence."""
        found, end, n, m, b = [], self.length, len(words), self.length, self.block
        shift, far = self.shift.get, self.far
        while end <= n:
            last = words[end - 2] + b" " + words[end - 1] if b == 2 else words[end - 1]
            move = shift(last, far)
            if move:
                end += move
                continue
            start = end - m
            first = b" ".join(words[start : start + b])
            for begin, p, items in self.buckets[last]:
                if begin == first and b" ".join(words[start:end]) == p:
                    found.append((start, items))
            end += 1
        return found


def search_tables(patterns: list[tuple[str, int, list[str]]]) -> list[SearchTable]:
    """Tables of (pattern, words of it, items)."""
    by_length: dict[int, dict] = defaultdict(dict)
    same: dict[tuple, tuple] = {}
    for text, m, items in patterns:
        own = tuple(items)
        by_length[m][text.encode()] = same.setdefault(own, own)
    return [SearchTable(ps, m) for m, ps in sorted(by_length.items())]


def scan(words: list[bytes], tables: list[SearchTable]) -> tuple[list[int], list[str]]:
    """Hit word runs as start, end, start, end ... and the item ids as strings, sorted."""
    spans, items = [], set()
    for t in tables:
        for start, ids in t.search(words):
            spans.append((start, start + t.length))
            items.update(ids)
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat, sorted(items)


def _low(text):
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def patterns(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """pattern, m (words of it), items (distinct item_ids as strings) of all items' windows."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(_low(F.col("text")), F.lit(WORDS), F.lit(0)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("m", F.least(F.lit(window), F.size("w")))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))
    return w.select("item", "m", F.explode(each).alias("pattern")).groupBy("pattern", "m").agg(F.collect_set("item").alias("items"))


_FOUND = "struct<n:long,spans:array<int>,items:array<string>>"


def _search(docs: DataFrame, shared, name: str) -> DataFrame:
    """`docs` with what the tables of the broadcast `shared` find in `text`, as one column."""

    def run(texts):
        words = [words_of(t) for t in texts]
        both = [scan(w, shared.value) for w in words]
        return [[{"n": len(w), "spans": s, "items": i} for w, (s, i) in zip(words, both)]]

    return append(docs, run, [(name, _FOUND)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, prefix: str = "", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """All columns of `docs` with n_words, n_hit, n_items, items_sha256, contaminated (names get `prefix`)."""
    sc, base, at, row = docs.sparkSession.sparkContext, docs.columns, f"__leaks_{prefix}state", f"__leaks_{prefix}row"
    known = materialise(patterns(benchmark), "bench-patterns")
    cost = F.lit(PATTERN_BYTES) + 3 * F.octet_length("pattern") + 60 * F.size("items")
    blocks = max(1, -(-(known.agg(F.sum(cost)).first()[0] or 0) // table_bytes))

    def tables(k: int):
        part = known.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k) if blocks > 1 else known
        return sc.broadcast(search_tables([(r["pattern"], r["m"], r["items"]) for r in part.collect()]))

    if blocks == 1:
        found = _search(docs, tables(0), at)
        drop_written(known)
    else:
        keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "bench-rows")
        hits = []
        for k in range(blocks):
            shared = tables(k)
            hit = _search(keyed.select(row, "text"), shared, at).where(F.size(f"{at}.spans") > 0).select(row, f"{at}.spans", f"{at}.items")
            hits.append(materialise(hit, "bench-hits"))
            shared.destroy()
        drop_written(known)
        every = hits[0]
        for hit in hits[1:]:
            every = every.unionByName(hit)
        every = every.groupBy(row).agg(  # lists as long as one text's hits
            F.flatten(F.collect_list("spans")).alias(f"{at}_s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias(f"{at}_i")
        )
        n = F.regexp_count(_low(F.col("text")), F.lit(WORDS)).cast("long")
        state = F.struct(n.alias("n"), F.coalesce(f"{at}_s", F.array().cast("array<int>")).alias("spans"), F.coalesce(f"{at}_i", F.array().cast("array<string>")).alias("items"))
        found = keyed.join(every, row, "left").select(*base, state.alias(at))
    hit = F.size(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(f"{at}.spans") - 2, F.lit(2)),
        lambda i: F.sequence(F.get(F.col(f"{at}.spans"), i), F.get(F.col(f"{at}.spans"), i + 1) - 1),
    ))))
    n_hit = F.when(F.size(f"{at}.spans") > 0, hit).otherwise(0).cast("long")
    return found.select(
        *base,
        F.col(f"{at}.n").alias(f"{prefix}n_words"),
        n_hit.alias(f"{prefix}n_hit"),
        F.size(f"{at}.items").cast("long").alias(f"{prefix}n_items"),
        F.sha2(F.array_join(F.array_sort(f"{at}.items"), ","), 256).alias(f"{prefix}items_sha256"),
        (F.size(f"{at}.spans") > 0).alias(f"{prefix}contaminated"),
    )


def oracle() -> str:
    """The op's result in DuckDB SQL."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH b AS (SELECT item_id, regexp_extract_all({low.format('text')}, '{word}') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (
        SELECT item_id, w, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
s AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (
        SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT rid, i, s.m, item_id FROM s JOIN p ON s.win = p.win AND s.m = p.m),
pos AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS q FROM h) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)"""
