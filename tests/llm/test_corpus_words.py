"""Spelling variants, token files and source divergence against brute force, and on nulls, empties, repeats and clashing names."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import divergence, spelling, tokens
from tickloom.llm.common import table

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, word string, term string, row int, n string, h int, value string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 0, "x", 1, "y") for r in rows], KIND)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    stems = ["thousand", "Ördnung", "señorita", "abcabcabc", "aaaaaaaa", "réponse"]

    def text():
        out = []
        for _ in range(300):
            w = rng.choice(stems)
            i = rng.randrange(len(w))
            out.append(w if rng.random() < 0.7 else w[:i] + rng.choice("abéx") * rng.randint(0, 2) + w[i + 1 :])
        return " ".join(out)

    rows = [(i, text(), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(12)]
    rows += [(1, rows[1][1], "en", "a"), (None, None, None, None), (None, text(), "en", "c"), (20, "", "en", "d"), (21, " \n", "fr", "a"),
             (22, "one-Two,three; ONE", "fr", "b"), (23, "x" * 30_000 + " thousand", "en", "a"), (24, "12 34", "xx", None)]
    return documents(spark, rows)


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    form, out = {}, []
    near = {w: [x for x in n if one_error(w, x)] for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [0, 400])
def test_variants_equal_brute_force(spark, odd, block):
    docs = odd.unionByName(documents(spark, [(r["doc_id"], r["text"], "en", "a") for r in table(spark, SF, "documents").where("doc_id < 40").collect()]))
    got = sorted((tuple(r) for r in spelling.variants(docs, block_chars=block).collect()), key=str)
    assert got == brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(r[1] for r in got)


def test_near_words_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(30):
        letters = "abé"[: rng.randint(1, 3)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(rng.randint(1, 120))})
        n = np.array([rng.randint(2, 50) for _ in words])
        found = defaultdict(list)
        for back in (False, True):
            for w, k, often, name in spelling.block_search(words, n, words, back):
                found[w].append((k, (-often, name)))
        for w in words:
            near = [(-int(n[i]), x) for i, x in enumerate(words) if one_error(w, x)]
            assert sum(k for k, _ in found[w]) == len(near)
            assert min((b for _, b in found[w]), default=None) == min(near, default=None)


def test_variants_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(map(str, con.sql(spelling.oracle()).fetchall()))
    assert sorted(str(tuple(r)) for r in spelling.variants(table(spark, SF, "documents")).collect()) == want


@pytest.fixture(scope="module")
def vocabulary():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    return tokens.read_vocabulary(path)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 300, 3000])
@pytest.mark.parametrize("top", [0, 1, 1000, 2**40, 2**63])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n, dtype=np.uint64))
    data = tokens.EliasFano.of(values).to_bytes()
    kept, end = tokens.EliasFano.read(memoryview(b"ab" + data), 2)
    assert end == len(data) + 2
    assert (kept.select(np.arange(n)) == values).all()
    index = rng.integers(0, max(n, 1), 50 if n else 0)
    assert (kept.select(index) == values[index]).all()
    with pytest.raises(IndexError):
        kept.select([n])


def test_elias_fano_is_near_minimal():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert 8 * len(tokens.EliasFano.of(values).to_bytes()) / len(values) < np.log2(values[-1] / len(values)) + 3


def test_chunks_encode_as_whole_texts(vocabulary):
    from tokenizers import Tokenizer

    plain, words, rng = Tokenizer.from_str(vocabulary), tokens.encoder(vocabulary, 2), random.Random(2)
    parts = list("abcXYZ's 'll'd<|>\t\n\x0b\x0c\x1c\x85\xa0 é́̀Σς0129½!?.,;:…日本‍🙂İK") + ["<|endoftext|>", " <|startoftext|> ", "don't", "WORD.", "a,", ".'s", "Ελλάδα", "Größe", "ﬁ", "ǅ", "ª", "ʰ", "สวัสดี"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(text.encode(), True), "<u2").tolist() == want
        assert np.frombuffer(words.ids(text.encode(), False), "<u2").tolist() == want


def test_other_tokenizers_encode_whole_texts(spark, odd):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    other = tokens.read_vocabulary(path)
    with pytest.raises(ValueError):
        tokens.token_ids(odd, other, by_word=True)
    docs = odd.where("doc_id < 4").dropDuplicates(["doc_id"])
    got = sorted(tuple(r) for r in tokens.through_files(docs, other, end_id=50_256).collect())
    assert got == brute_tokens(other, [(r["doc_id"], r["text"]) for r in docs.collect()], 50_256)


def test_the_cache_forgets_and_stays_right(vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 20)
    words = tokens._Words(tokens.encoder(vocabulary, 2).tokenizer, 2)
    texts = [f"word{i} the and, again{i % 7}." for i in range(60)]
    for t in texts + texts:
        want = words.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(t.encode(), True), "<u2").tolist() == want
    assert len(words) + len(words.old) < 60


def brute_tokens(vocabulary, rows, end=1):
    from tokenizers import Tokenizer

    plain, start, out = Tokenizer.from_str(vocabulary), 0, []
    made = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, end]) for d, t in rows]
    for d, ids in sorted(made, key=lambda x: (x[0] is None, x[0] or 0)):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("size", [tokens.FILE_BYTES, 3000])
def test_token_files_equal_brute_force(spark, odd, vocabulary, size):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = sorted(tuple(r) for r in tokens.through_files(docs, vocabulary, by_word=True, file_bytes=size).collect())
    assert got == brute_tokens(vocabulary, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_token_files_of_repeated_and_missing_ids(spark, odd, vocabulary):
    rows = tokens.through_files(odd.withColumn("doc_id", F.col("doc_id") - 7), vocabulary, file_bytes=2000).collect()
    want = brute_tokens(vocabulary, [(None if r["doc_id"] is None else r["doc_id"] - 7, r["text"]) for r in odd.collect()])
    assert sorted(str((r[0], r[2], r[3])) for r in rows) == sorted(str((w[0], w[2], w[3])) for w in want)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0))


def test_a_file_gives_documents_by_id():
    ids = [np.array(x, "<u4").tobytes() for x in ([5, 6, 1], [1], [70_000, 1], [2, 1])]
    file = tokens.TokenFile(tokens.pack(3, 4, [-9, 2, 2, None], ids, 4) + b"\n")
    assert (file.part, file.piece, file.n_docs, file.n_null, file.n_ids) == (3, 4, 4, 1, 8)
    assert [file.ids(i).tolist() for i in range(4)] == [[5, 6, 1], [1], [70_000, 1], [2, 1]]
    assert [file.find(d) for d in (-9, 2, 3, -10)] == [0, 1, None, None]
    with pytest.raises(ValueError):
        tokens.TokenFile(b"x" * 100)


def test_doc_ids_of_files_are_integers(spark, vocabulary):
    with pytest.raises(ValueError):
        tokens.token_ids(spark.createDataFrame([("a", "b")], "doc_id string, text string"), vocabulary)


def brute_audit(rows, least=3, scale=10**9, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [("".join(c.lower() if c < "\x80" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[0])) for r in rows]
    terms = [list(t) for t in terms]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(r[2], t) for r, t in zip(rows, terms) if r[1] == lang]
        have = Counter(x for _, t in mine for x in set(t))
        kept = {t for t, k in have.items() if k >= least}
        count = defaultdict(Counter)
        for source, t in mine:
            for name in ((0, ""), (1, source)):
                count[name].update(x for x in t if x in kept)
        p = {g: {t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for g, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for g in [g for g in p if g[0]]:
            pair = [(h[1], sum(f(p[g][t], p[h][t]) for t in kept)) for h in p if h[0] and h != g]
            lead = [(t, f(p[g][t], p[(0, "")][t])) for t in kept if count[g][t] and p[g][t] > p[(0, "")][t]]
            for part, found in (("pair", pair), ("term", lead)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, g[1], part, item, value, k + 1) for k, (item, value) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, odd, monkeypatch, small):
    if small:
        for name, value in (("HELD", 5), ("CELLS", 8), ("SIDE", 2)):
            monkeypatch.setattr(divergence, name, value)
    got = sorted(tuple(r) for r in divergence.audit(odd, 5 if small else 200).collect())
    assert got == brute_audit([(r["text"], r["lang"], r["source"]) for r in odd.collect()], top=5 if small else 200)


def test_divergence_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(tuple(r) for r in divergence.audit(table(spark, SF, "documents")).collect()) == sorted(con.sql(divergence.oracle()).fetchall())


def test_documents_of_a_term_are_told_apart(spark):
    """Two documents have a term in three chunks: it is not in three documents."""
    rows = [(1, "foo foo, foo.", "en", "a"), (2, "foo! bar", "en", "a"), (3, "bar; bar-bar", "en", "b"), (3, "BAR", "en", "b")]
    got = {r["item"] for r in divergence.audit(documents(spark, rows)).where("part = 'term'").collect()}
    assert {r["term"] for r in divergence.term_counts(documents(spark, rows)).collect()} == {"bar"} >= got


@pytest.mark.parametrize("held, size", [(1, 1), (40, 100), (1 << 20, 1 << 24)])
def test_chunks_are_counted_as_bytes(spark, monkeypatch, held, size):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BYTES", size)
    rng = random.Random(3)
    parts = ["A", "b", "\u00c9", "\u00a0", "\x1c", "\x00", "\x0b", " ", " \n", ".", "7", "x-", "\U0001f600"]
    rows = [(i, "".join(rng.choices(parts, k=rng.choice([0, 3, 40]))), rng.choice("de"), rng.choice([None, "s"])) for i in range(120)]
    want = {}
    for _, text, lang, source in rows:
        own = Counter(x.strip(divergence.ENDS.encode()) for x in text.encode().lower().split())
        for chunk, n in own.items():
            if chunk:
                k = (lang, source or "", chunk.decode())
                want[k] = (want.get(k, (0, 0))[0] + n, want.get(k, (0, 0))[1] + 1)
    got = divergence.chunk_counts(documents(spark, rows)).groupBy("lang", "source", "chunk").agg({"n": "sum", "docs": "sum", "lo": "min", "hi": "max"}).collect()
    assert {(r["lang"], r["source"], r["chunk"]): (r["sum(n)"], r["sum(docs)"]) for r in got} == want
    assert all((r["min(lo)"] == r["max(hi)"]) == (r["sum(docs)"] == 1) for r in got)


def test_divergence_shuffles_chunks_once_and_drops_the_files(spark, odd):
    plan = divergence.term_rows(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p for d in manager.localDirsString() for p in Path(d).rglob("shuffle_*.data")}
    before = files()
    divergence.term_counts(odd)
    for _ in range(50):  # executors are told, not waited for
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_empty_tables(spark, odd, vocabulary):
    none = odd.where("false")
    assert spelling.variants(none).count() == 0
    assert tokens.through_files(none, vocabulary).count() == 0
    assert divergence.audit(none).count() == 0
