"""How the sources of a language differ in their words, by chunk factorization.

1. Every document's white-space chunks (A-Z lower-cased, ASCII signs and digits at their ends cut off) are counted, and the counts of a
   task's documents are added up before anything is shuffled: a chunk of a (lang, source) group becomes one row with its
   occurrences, its documents, and the first and the last of them. Rows are shuffled by chunk, once.
2. In its chunk's partition every globally distinct chunk is cut into terms once, at its first row, and its other rows take the
   terms over. Sums over them give the occurrences of every term in every group, one row a term with a list of its sources.
3. A term is kept in a language if MIN_DOCS of its documents have it. A document can have a term in several chunks, so documents
   of chunks are not added up: one chunk with MIN_DOCS documents is enough; where all chunks of a term have fewer, their first and
   last document are all they have. One that lies between the term's first and last is a third; if the sources' own first and
   last show none, the distinct ones of all chunks are counted.
4. With exact integers p = 1 + floor(SCALE * (count + 1) / (N + V)), two sources differ in a term by floor((p - q)^2 / q). Pairs
   are summed in blocks of terms: a block holds the p of all its terms in all sources (sources without the term have the p of
   count 0) and gives one partial sum a pair. No row is made for a pair and a term.
5. Leading terms are ranked in parts (by a hash of the term) first, so no task sorts all terms of a group.

Defined results: null text, lang and source are ''; every row is a document, so repeated rows are documents of their own;
texts without terms still make their group known; equal values are ranked by item in UTF-8 order; a language without kept
terms has value 0 for all its pairs and no terms; very long texts and chunks are counted whole; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import drop_written, materialise

#: Documents of a language that a kept term is in. The first and last document of a chunk are all it has only below 3.
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What is cut off at the ends of chunks: no term has it.
ENDS = "".join(chr(b) for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
#: Chunks of groups that a task counts before it passes them on, bytes of text that it cuts at once, and rows of a record batch.
HELD, BYTES, ROWS = 2_000_000, 1 << 24, 1 << 17
#: Numbers (terms times sources) that a block of pair sums holds, and the sources of one side of it.
CELLS, SIDE = 1 << 20, 512
#: Parts in which the terms of a group are ranked first.
PARTS = 64


def slices(batch):
    """Whole rows of a batch with about BYTES of text, one row at least."""
    lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // BYTES
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for i, j in zip(begins, [*begins[1:], len(part)]):
        yield batch.slice(i, j - i)


def counted(batch, known: dict) -> tuple:
    """Chunks of the groups of some documents: chunk, number of the group in `known`, occurrences, documents, first and last document."""
    text = batch.column("text")
    text = text.view(pa.large_string() if pa.types.is_large_binary(text.type) else pa.string())  # bytes, none of which is decoded
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    words = lists.flatten().dictionary_encode()
    chunks = pc.ascii_trim(words.dictionary, characters=ENDS).dictionary_encode()
    code = chunks.indices.to_numpy()[words.indices.to_numpy()].astype(np.int64)
    # Documents are numbered group by group, so one sort puts a chunk's documents of a group together, the first one first.
    pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
    group = np.array([known.setdefault(x, len(known)) for x in pairs], dtype=np.int64)
    order = np.argsort(group, kind="stable")
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.arange(len(order))
    key = code * len(order) + np.repeat(at, pc.list_value_length(lists).to_numpy())
    empty = pc.index(chunks.dictionary, "").as_py()
    key = np.sort(key[code != empty] if empty >= 0 else key)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    times, (code, doc) = np.diff(np.append(first, len(key))), np.divmod(key[first], len(order))
    group, row = group[order][doc], batch.column("row").to_numpy()[order][doc]
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (group[1:] != group[:-1]))) if len(key) else first
    last = np.append(new[1:], len(code)) - 1
    n = np.add.reduceat(times, new) if len(new) else times
    return chunks.dictionary.take(pa.array(code[new])), group[new], n, last + 1 - new, row[new], row[last[: len(new)]]


def added(parts: list[tuple]) -> tuple:
    """Such counts of further documents added up."""
    if len(parts) == 1:
        return parts[0]
    chunks = pa.chunked_array([x[0] for x in parts]).combine_chunks().dictionary_encode()
    group, n, docs, lo, hi = (np.concatenate([x[k] for x in parts]) for k in range(1, 6))
    key = chunks.indices.to_numpy().astype(np.int64) * (group.max(initial=0) + 1) + group
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    total = lambda f, x: f.reduceat(x[order], new) if len(new) else x
    code, own = np.divmod(key[new], group.max(initial=0) + 1)
    return chunks.dictionary.take(pa.array(code)), own, total(np.add, n), total(np.add, docs), total(np.minimum, lo), total(np.maximum, hi)


def packed(made: tuple, known: dict):
    """Counts as record batches."""
    chunk, group, *numbers = made
    names = [pa.array([x[k] for x in known], pa.string()) for k in (0, 1)]
    for i in range(0, len(group), ROWS):
        own = pa.array(group[i : i + ROWS])
        columns = [*[x.take(own) for x in names], chunk[i : i + ROWS].cast(pa.binary()), *[pa.array(x[i : i + ROWS]) for x in numbers]]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "chunk", "n", "docs", "lo", "hi"])


def chunk_counts(docs: DataFrame) -> DataFrame:
    """lang, source, chunk, n (occurrences), docs (documents), lo and hi (first and last of them); partial sums, one a task or more."""
    none = F.lit("")
    rows = docs.select(
        F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"),
        F.coalesce("text", none).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"),
    )

    def full(held: list[tuple], share: int) -> bool:
        return sum(len(x[0]) for x in held) > HELD // share or sum(x[0].nbytes for x in held) > 8 * BYTES // share

    def run(batches):
        known, held = {}, []
        for batch in batches:
            for part in slices(batch):
                held.append(counted(part, known))
                if not full(held, 1):
                    continue
                held = [added(held)]
                if full(held, 2):
                    yield from packed(held[0], known)
                    known, held = {}, []
        if held:
            yield from packed(added(held), known)

    made = rows.mapInArrow(run, "lang string, source string, chunk binary, n long, docs long, lo long, hi long")
    return made.withColumn("chunk", F.col("chunk").cast("string"))


def _sums() -> list:
    return [F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]


def term_rows(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs, lo, hi: a row for each term of each chunk of a group."""
    # Rows of a task are sums already, so they are shuffled as they are, once: adding up a chunk's rows of a group (one a task at most)
    # and handing its terms over both find them in the chunk's partition.
    chunks = chunk_counts(docs).repartition("chunk").groupBy("chunk", "lang", "source").agg(*_sums())
    w = Window.partitionBy("chunk").orderBy("lang", "source")  # one row a group
    chunks = chunks.withColumn("__at", F.row_number().over(w))
    chunks = chunks.withColumn("__terms", F.when(F.col("__at") == 1, F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))))
    chunks = chunks.withColumn("__terms", F.first("__terms", True).over(w))
    return chunks.select("lang", "source", F.explode("__terms").alias("term"), "n", "docs", "lo", "hi")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, term, n (occurrences in the language) and items (source and n of the sources that have it) of the kept terms."""
    rows = materialise(term_rows(docs), "divergence-rows", drop_shuffles=True)

    groups = rows.groupBy("lang", "source", "term").agg(*_sums(), F.max("docs").alias("most"))
    item = F.struct("source", "n", "lo", "hi")
    terms = groups.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list(item).alias("items")
    )  # a list has one item a source
    inside = lambda doc: (doc > F.col("lo")) & (doc < F.col("hi"))
    third = F.exists("items", lambda x: inside(x["lo"]) | inside(x["hi"]))
    sure = (F.col("most") >= MIN_DOCS) | third
    terms = terms.where(sure | ((F.col("docs") >= MIN_DOCS) & (F.col("lo") < F.col("hi"))))
    terms = terms.select("lang", "term", "n", F.transform("items", lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"))).alias("items"), sure.alias("sure"))
    terms = materialise(terms, "divergence-terms", drop_shuffles=True)
    open_ = terms.where("NOT sure").select("lang", "term")
    few = rows.join(open_, ["lang", "term"], "left_semi").select("lang", "term", F.explode(F.array("lo", "hi")).alias("doc")).distinct()
    some = few.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= MIN_DOCS)
    more = terms.where("NOT sure").join(some, ["lang", "term"], "left_semi")
    kept = materialise(terms.where("sure").unionByName(more).drop("sure"), "divergence-kept", drop_shuffles=True)
    drop_written(rows, terms)
    return kept


def _p(count, total, terms):
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for any counts: in decimals where 64 bits do not hold the product."""
    wide = lambda c: c.cast("decimal(38,0)")
    far = F.call_function("div", wide(F.lit(SCALE)) * (count + 1).cast("decimal(20,0)"), wide(total + terms))
    near = F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), total + terms)
    return F.lit(1) + F.when(count < (1 << 63) // SCALE - 1, near).otherwise(far)


def _f(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: summed differences of every two sources that share a language with kept terms.

    `cells`: lang, term (a number), at, p of what groups have; `groups`: lang, at (the source's number in it), source, p0 (p of count
    0), sources, terms (of the language). A block's task gets its terms' rows, and one row for each source.
    """
    import pandas as pd

    size = groups.select("lang", "sources", "terms").distinct()
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / CELLS)).cast("int")
    sides = F.ceil(F.col("sources") / SIDE).cast("int")
    size = size.select("lang", blocks.alias("blocks"), sides.alias("sides"))
    side = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side")
    block_of = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    cells = cells.join(size, "lang").select("lang", block_of.alias("block"), "term", "at", "p", side)
    known = groups.join(size, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(-1).cast("long").alias("term"), "at", F.col("p0").alias("p"), side)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        plain, own = rows[rows["term"] < 0].sort_values("at"), rows[rows["term"] >= 0]
        p0, lang, part = plain["p"].to_numpy(), plain["lang"].iloc[0], int(plain["side"].iloc[0])
        known, term = np.unique(own["term"].to_numpy(), return_inverse=True)
        p = np.repeat(p0[:, None], len(known), axis=1)
        p[own["at"].to_numpy(), term] = own["p"].to_numpy()
        out = []
        for i in range(part * SIDE, min((part + 1) * SIDE, len(p0))):
            d = p[i][None, :] - p
            out.append(pd.DataFrame({"lang": lang, "a": i, "b": np.arange(len(p0)), "value": (d * d // p).sum(axis=1)}))
        return pd.concat(out)

    made = cells.unionByName(known).groupBy("lang", "block", "side").applyInPandas(summed, "lang string, a int, b int, value long")
    made = made.where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda at, c: groups.select("lang", F.col("at").alias(at), F.col("source").alias(c))
    return made.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (`pair`) and the leading terms (`term`) of every group."""
    kept = term_counts(docs)
    cells = kept.withColumn("number", F.monotonically_increasing_id()).select("lang", "number", "term", F.col("n").alias("n_lang"), F.explode("items").alias("x"))
    cells = cells.select("lang", "number", "term", "n_lang", "x.source", "x.n")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none, w = F.lit(""), Window.partitionBy("lang")
    groups = docs.select(F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source")).distinct()
    groups = groups.join(size, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("terms", "total", "total_lang")})
    groups = groups.withColumns({"at": F.row_number().over(w.orderBy("source")) - 1, "sources": F.count(F.lit(1)).over(w)})  # one row a group
    groups = materialise(groups, "divergence-groups", drop_shuffles=True)

    with_p = cells.join(groups.select("lang", "source", "at", "total", "terms", "total_lang"), ["lang", "source"])
    with_p = with_p.withColumns({"p": _p(F.col("n"), F.col("total"), F.col("terms")), "q": _p(F.col("n_lang"), F.col("total_lang"), F.col("terms"))})
    with_terms = groups.where("terms > 0").select("lang", "source", "at", "sources", "terms", _p(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("p0"))
    sums = pair_sums(with_p.select("lang", F.col("number").alias("term"), "at", "p"), with_terms)
    without = groups.where("terms = 0").select("lang", "source")
    zero = without.join(without.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    by_value = [F.desc("value"), F.asc("item")]
    pairs = sums.unionByName(zero).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)))

    lead = with_p.where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    lead = lead.withColumn("__part", F.pmod(F.xxhash64("item"), F.lit(PARTS)))
    lead = lead.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "__part").orderBy(*by_value))).where(F.col("rank") <= top)
    lead = lead.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).where(F.col("rank") <= top)
    made = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return made(pairs, "pair").unionByName(made(lead, "term"))


def oracle() -> str:
    """The audit in DuckDB SQL, with the terms of every document cut directly."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all({low}, '{TERM}') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCS}),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
cl AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
total AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
total_lang AS (SELECT lang, sum(n) AS n FROM cl GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(total.n, 0) + v) AS p
      FROM g JOIN kept k USING (lang) JOIN size USING (lang)
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
q AS (SELECT cl.lang, term, 1 + {SCALE}::HUGEINT * (cl.n + 1) // (total_lang.n + v) AS q
      FROM cl JOIN total_lang USING (lang) JOIN size USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
lead AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term)
      WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM lead)
QUALIFY part = 'pair' OR rank <= {TOP}"""
