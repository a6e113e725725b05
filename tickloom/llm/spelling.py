"""Spelling variants: near words by FM-index search schemes for one error.

Words are the letter runs of all texts (see `vocabulary`) with their occurrences. Two words are near if one inserted, deleted or
replaced code point makes one the other. A word's form is its most frequent near word if that is RATIO times as frequent;
its root is where forms lead.

Search: of a word cut into two halves, one error leaves one half as it is. So there are two searches, one for each half: the half
is matched exactly from the word's outer end inwards, and the other half is matched on in the same direction with one error. The
index is a pair of FM indexes over the delimited vocabulary, one of the words and one of the reversed words, one for each direction;
as a search starts at a word's end and never turns, the two intervals need not be kept in step. A step takes the suffix-rank
interval [lo, hi) of what is matched to that of what is matched and a symbol c, by two binary searches among the
(symbol, row) pairs of the transform. All words of a block search at the same time, as arrays of states. Edits that give
the same word (a letter deleted from or added to a run of equal ones) are tried once.

Blocks: a near word shares the exact half, so it shares the word's first or last KEY code points. Each search has blocks of words by a
hash of these; a key with more than BLOCK_CHARS is cut into parts by a hash of the word, and each part searches the indexes of all
parts, block by block. A near word found by the second search that the first one finds too (it has the first half as well) is left
out there, so counts are added up and no pair is shuffled.

Defined results: null and empty texts have no words; a null doc_id counts as the empty text where it enters the hash; repeated rows count
as often as they are there; the most frequent near words tie by code-point order; very long texts and runs are taken whole;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import drop_written, materialise

LEAST, OFTEN, RATIO, SLIPS = 7, 2, 10, 31
KEY = 3
#: Code points of the words of a block, about.
BLOCK_CHARS = 1 << 18
MOST_TASKS = 100_000
#: Words that search at the same time.
TOGETHER = 4096
#: Words that a task counts before it passes them on.
HELD = 500_000

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST},}}")


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: letter runs, A-Z lower-cased, of LEAST code points or more that occur OFTEN or more in all.

    A run of a document loses a code point if SLIPS divides h, the CRC-32 of `<doc_id>:<run>`: that at h modulo its length.
    """
    import pyarrow as pa

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, times in Counter(_RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % SLIPS == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST:
                            continue
                    held[word] = held.get(word, 0) + times
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    parts = docs.select(named.alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


class Index:
    """FM index of delimited words: suffix-rank intervals of what ends where a word ends, longer by a symbol a step.

    Words are given as arrays of symbols (1 and above) in the order in which a search takes them.
    """

    def __init__(self, words: list[np.ndarray]):
        m, lengths = len(words), np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1 if m else 0
        text = np.zeros(n, dtype=np.int64)
        text[np.delete(np.arange(n), ends)] = np.concatenate([w[::-1] for w in words]) if m else 0
        rank = text + m
        rank[ends] = np.arange(m)  # delimiters differ, so suffixes do
        k = 1
        while n:
            after = np.zeros(n, dtype=np.int64)
            after[: n - k] = rank[k:] + 1
            both = rank * (n + m + int(text.max()) + 2) + after
            rows = np.argsort(both, kind="stable")
            sorted_ = both[rows]
            rank[rows] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            if rank[rows[-1]] == n - 1:
                break
            k *= 2
        rows = np.argsort(rank) if n else np.zeros(0, dtype=np.int64)
        self.n, self.m, self.symbols = n, m, int(text.max()) if n else 0
        self.before = text[rows - 1] if n else text  # the symbol before each suffix, 0 where a word begins
        self.pairs = np.sort(self.before * (n + 1) + np.arange(n))
        self.begins = np.flatnonzero(self.before == 0)
        self.word = np.searchsorted(ends, rows[self.begins])

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = c * (self.n + 1)
        return np.searchsorted(self.pairs, base + lo), np.searchsorted(self.pairs, base + hi)

    def choices(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) of all symbols that stand before an interval's suffixes; in wide intervals of all that there are."""
        size = hi - lo
        small, wide = np.flatnonzero(size <= self.symbols), np.flatnonzero(size > self.symbols)
        own = np.repeat(small, size[small])
        at = np.arange(len(own)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + lo[own]
        pairs = np.unique(own * (self.symbols + 1) + self.before[at])
        of, c = pairs // (self.symbols + 1), pairs % (self.symbols + 1)
        of = np.concatenate([of[c > 0], np.repeat(wide, self.symbols)])
        return of, np.concatenate([c[c > 0], np.tile(np.arange(1, self.symbols + 1), len(wide))])

    def near(self, words: list[np.ndarray], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all indexed words that differ by one error after the first `exact` symbols of a query."""
        text, length = np.concatenate([*words, np.zeros(1, np.int64)]), np.array([len(w) for w in words], dtype=np.int64)
        start = np.cumsum(length) - length
        q, lo, hi = np.arange(len(words)), np.zeros(len(words), np.int64), np.full(len(words), self.m)
        for i in range(int(exact.max(initial=0))):
            go = exact[q] > i
            lo[go], hi[go] = self.step(text[start[q[go]] + i], lo[go], hi[go])
            live = lo < hi
            q, lo, hi = q[live], lo[live], hi[live]
        i = exact[q]
        none = np.zeros(0, dtype=np.int64)
        wrong, found = (none, none, none, none), []
        while len(q) or len(wrong[0]):
            now, more = text[start[q] + i], i < length[q]
            past = np.where(i == exact[q], -1, text[start[q] + i - 1])
            of, c = self.choices(lo, hi)
            a, b = self.step(c, lo[of], hi[of])
            live = a < b
            of, c, a, b = of[live], c[live], a[live], b[live]
            put, swap, drop = c != past[of], more[of] & (c != now[of]), more & (now != past)
            made = [  # one symbol more, another one, one less
                (q[of[put]], i[of[put]], a[put], b[put]), (q[of[swap]], i[of[swap]] + 1, a[swap], b[swap]), (q[drop], i[drop] + 1, lo[drop], hi[drop]),
            ]
            wq, wi, wlo, whi = wrong
            wlo, whi = self.step(text[start[wq] + wi], wlo, whi)
            wrong = [np.concatenate(x) for x in zip((wq, wi + 1, wlo, whi), *made)]
            wrong = [x[wrong[2] < wrong[3]] for x in wrong]
            done = wrong[1] == length[wrong[0]]
            first, last = np.searchsorted(self.begins, wrong[2][done]), np.searchsorted(self.begins, wrong[3][done])
            found.append((wrong[0][done][first < last], self.word[first[first < last]]))
            wrong = [x[~done] for x in wrong]
            lo, hi = self.step(now, lo, hi)
            live = more & (lo < hi)
            q, i, lo, hi = q[live], i[live] + 1, lo[live], hi[live]
        pairs = np.unique(np.concatenate([a * (self.m + 1) + b for a, b in found] or [none]))
        return pairs // (self.m + 1), pairs % (self.m + 1)


def block_search(words: list[str], counts: np.ndarray, queries: list[str], backwards: bool) -> list[tuple[str, int, int, str]]:
    """(query, near words, occurrences and name of the first of them by occurrences and code points) of one search.

    Forwards, the first half of a query is exact; backwards, the second is, and near words that begin with the first one are left out.
    """
    code = {c: k + 1 for k, c in enumerate(sorted(set("".join(words))))}
    rest = len(code) + 1  # a symbol that no indexed word has

    def symbols(w: str) -> np.ndarray:
        out = np.array([code.get(c, rest) for c in w], dtype=np.int64)
        return out[::-1] if backwards else out

    index = Index([symbols(w) for w in words])
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    out = []
    for at in range(0, len(queries), TOGETHER):
        part = queries[at : at + TOGETHER]
        half = [len(w) // 2 for w in part]
        exact = np.array([len(w) - h if backwards else h for w, h in zip(part, half)], dtype=np.int64)
        q, x = index.near([symbols(w) for w in part], exact)
        if backwards:
            keep = np.array([not words[b].startswith(part[a][: half[a]]) for a, b in zip(q.tolist(), x.tolist())], dtype=bool)
            q, x = q[keep], x[keep]
        n, best = np.bincount(q, minlength=len(part)), np.full(len(part), len(words))
        np.minimum.at(best, q, place[x])
        for k in np.flatnonzero(n):
            first = order[best[k]]
            out.append((part[k], int(n[k]), int(counts[first]), words[first]))
    return out


def near_words(words: DataFrame, block_chars: int = 0) -> DataFrame:
    """word, n_near, and `best` (struct of the negative count and the name of the first near word) of words that have near words."""
    import pandas as pd

    size = block_chars or BLOCK_CHARS
    side = F.explode(F.array(*[F.struct(F.lit(k).alias("back"), key.alias("key")) for k, key in ((False, F.left("word", F.lit(KEY))), (True, F.right("word", F.lit(KEY))))]))
    rows = words.select("word", "n", side.alias("__s")).select("word", "n", "__s.*")
    keys = rows.groupBy("back", "key").agg(F.sum(F.char_length("word")).alias("chars"))
    total = keys.agg(F.sum("chars")).first()[0] or 0
    keys = keys.withColumn("parts", F.ceil(F.col("chars") / size).cast("int")).drop("chars")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    blocks = max(1, -(-total // size))
    slot = F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("string"))
    cell = lambda index, query, is_index, is_query: F.struct(index.alias("i"), query.alias("j"), is_index.alias("index"), is_query.alias("query"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_index = F.transform(every, lambda j: cell(F.col("own"), j, F.lit(True), j == F.col("own")))
    as_query = F.transform(F.filter(every, lambda i: i != F.col("own")), lambda i: cell(i, F.col("own"), F.lit(False), F.lit(True)))
    placed = rows.join(keys, ["back", "key"]).withColumns({"own": own, "slot": slot})
    placed = placed.select("back", "slot", "word", "n", F.inline(F.concat(as_index, as_query)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        of = pdf[pdf["index"]]
        found = block_search(of["word"].tolist(), of["n"].to_numpy(), pdf["word"][pdf["query"]].tolist(), bool(pdf["back"].iloc[0])) if len(of) else []
        return pd.DataFrame(found, columns=["word", "n_near", "best_n", "best_word"])

    cells = ["back", "slot", "i", "j"]  # a block a task: its work is far more than its bytes say
    found = placed.repartition(min(2 * blocks, MOST_TASKS), *cells).groupBy(*cells).applyInPandas(search, "word string, n_near long, best_n long, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root, from word and form: forms are followed to the last, twice as far each round. Forms must not lead back."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        made = now.join(after, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved"))
        past, now = now, materialise(made, "spelling-roots")
        drop_written(past)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, block_chars: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = materialise(vocabulary(docs), "spelling-words")
    near = near_words(words, block_chars)
    often = -F.col("best.less") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
    )
    rows = materialise(rows, "spelling-forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """The variants in DuckDB SQL: CRC-32 by its table, near words by their deletions."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all({low}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT doc, run, count(*) AS n, hex(encode(concat(doc, ':', run))) AS x FROM d WHERE length(run) >= {LEAST} GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i:
             CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM r, crc),
s AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OFTEN}),
x AS (SELECT word, n, i, word[:i] || word[i + 2:] AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
   UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word
   UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * v.n THEN other END AS form,
        CASE WHEN most >= {RATIO} * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
far AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN far USING (word)"""
