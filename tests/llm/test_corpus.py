"""The corpus operators against brute force, and on nulls, empties, repeats, clashing names and empty tables."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, decontaminate, html, langid, licenses, mixing, quality, queries, repeats, simhash, toxicity
from tickloom.llm.common import table
from tickloom.llm.components import components

SF = "/root/testdata/sf0.001"
PROSE = "the quick brown fox jumps over the lazy dog and runs on through the deep green wood until night falls "


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "the", "of"]) + str(rng.randint(0, 99)) for _ in range(400))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", None), (3, None, None, None), (4, "", "en", "b"),
        (5, "   \n\t ", "fr", "b"), (6, "one", "en", "b"), (7, base[:900] + " changed " + base[900:], "de", "a"),
        (8, "12 34 !!", None, "c"), (9, PROSE * 400, "en", "c"), (10, "Released under the MIT License.", "en", "a"),
        (None, base[300:1200], "en", "a"), (None, "no id here", None, "z"),
    ]
    rows = [(*r, len(r[1] or ""), "clash", 0, 0.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, k int, score double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 0, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE), (2, "no id here"), (3, ""), (4, None), (5, "one")], "item_id long, text string")


def brute_repeats(texts, n=repeats.LENGTH):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        covered = set()
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                covered.update(range(i, i + n))
        kept = bytes(b for i, b in enumerate(t) if i not in covered)
        out.append((len(t), len(covered), sum(i - 1 not in covered for i in covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(spark, odd):
    for docs in (odd, table(spark, SF, "documents").where("doc_id < 80")):
        got = sorted(tuple(r)[1:] for r in repeats.repeated_strings(docs).collect())
        assert got == brute_repeats([(r["text"] or "").encode() for r in docs.collect()])


def test_repeats_in_periodic_text(spark):
    docs = spark.createDataFrame([(1, "a" * 900), (2, "ab" * 250), (3, "a" * 199), (4, "a" * 200)], "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in repeats.repeated_strings(docs).collect())
    assert got == brute_repeats([r["text"].encode() for r in docs.collect()])


def test_simhash_equals_brute_force(spark, odd):
    for docs in (odd, table(spark, SF, "documents")):
        rows = simhash.near_duplicates(docs).collect()
        assert len(rows) == docs.count()
        fps = sorted({int(r["fingerprint"], 16) for r in rows})
        group = {f: f for f in fps}

        def root(f):
            while group[f] != f:
                f = group[f]
            return f

        for i, x in enumerate(fps):
            for y in fps[i + 1 :]:
                if (x ^ y).bit_count() <= 2:
                    a, b = sorted((root(x), root(y)))
                    group[b] = a
        first = {}
        for r in rows:
            f = root(int(r["fingerprint"], 16))
            if r["doc_id"] is not None:
                first[f] = min(first.get(f, r["doc_id"]), r["doc_id"])
        assert all(r["component_id"] == first.get(root(int(r["fingerprint"], 16))) for r in rows)


def test_simhash_fingerprint_by_hand():
    import xxhash

    text = "A b c d e"
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c d e")]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 2)
    assert simhash.fingerprint(text) % (1 << 64) == want and simhash.fingerprint(None) == 0


def test_large_groups_link_like_small_ones(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    fps = {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = [{tuple(r) for r in components(simhash.links(df, bucket=b)).collect()} for b in (2, 10_000)]
    assert found[0] == found[1]


def test_decontamination_equals_sql(spark, odd, benchmark):
    con = duckdb.connect()
    for docs, bench in ((odd, benchmark), (table(spark, SF, "documents"), table(spark, SF, "benchmark"))):
        con.register("documents", docs.select("doc_id", "text").toArrow())
        con.register("benchmark", bench.toArrow())
        want = sorted(map(str, con.sql(decontaminate.oracle()).fetchall()))
        cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        got = decontaminate.decontaminate(docs.select("doc_id", "text"), bench).select(cols).collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_quality_equals_sql(spark, odd, labels):
    con = duckdb.connect()
    con.register("documents", odd.select("doc_id", "text", "lang").toArrow())
    con.register("labels", labels.toArrow())
    want = sorted(map(str, con.sql(quality.oracle()).fetchall()))
    assert sorted(str(tuple(r)) for r in quality.quality_rules(odd, labels).collect()) == want


def test_quality_cutoffs_hold_their_bound(spark):
    scores = spark.range(4000).selectExpr(
        "id AS doc_id", "'x' AS stratum", "CAST(id AS STRING) AS digest", "false AS base_failed", "IF(id < 2000, 500, id % 20) AS symbols", "0L AS dup_lines", "0L AS repeats", "0L AS shout"
    )
    marks = spark.range(4000).selectExpr("id AS doc_id", "IF(id < 2000, 0, 1) AS quality")
    cut = quality.cutoffs(scores, marks).first()
    assert cut["cut_symbols"] == 500  # the most lenient that rejects every bad text: none stricter leads by more
    assert cut["cut_shout"] is None
    assert quality.cutoffs(scores.limit(50), marks).where("cut_symbols IS NOT NULL").isEmpty()
    copies = scores.withColumn("digest", F.when(F.col("doc_id") >= 2000, F.lit("one text")).otherwise(F.col("digest")))
    assert quality.cutoffs(copies, marks).where("cut_symbols IS NOT NULL").isEmpty()


def test_licenses(spark, odd):
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(odd).collect() if r["licenses"]}
    assert got == {10: "mit-short"}
    long = licenses.TEMPLATES["mit-grant"]
    worn = " ".join(w for i, w in enumerate(long.split()) if i % 60 != 30)
    docs = spark.createDataFrame([(1, PROSE * 5 + worn + PROSE * 3), (2, PROSE * 9), (3, long[: len(long) // 2])], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["best_containment"]) for r in licenses.license_scan(docs).collect()}
    assert got[1][0] == "mit-grant" and 0.8 <= got[1][1] < 1 and got[2][0] == got[3][0] == ""


def brute_phrases(codes, known):
    """Phrases of the longest-match parse of `codes` by occurrence in `known` (bytes of one byte a code)."""
    n, i = 0, 0
    while i < len(codes):
        j = i + 1
        while j < len(codes) and codes[i : j + 1].tobytes() in known:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("block", [4, 32, 512])
def test_language_parse_equals_brute_force(monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(langid, "BLOCK", block)
    learned = {"en": PROSE * 3, "xx": "zu der die und ein lich keit ung ach sch " * 8}
    model = langid.learn(learned)
    table_, automata = model[1], model[2]
    for text in (PROSE[5:60], "die keit qq the fox", "a", PROSE * 2 + "und " * 90 + PROSE[::-1] + "z" * 700):
        codes = langid.encode(text, table_)
        n = -(-len(codes) // block)
        padded = np.zeros(n * block, dtype=table_.dtype)
        padded[: len(codes)] = codes
        blocks = np.ascontiguousarray(padded.reshape(n, block).T)
        for lang, automaton in zip(sorted(learned), automata):
            want = brute_phrases(codes, langid.encode(learned[lang], table_).tobytes())
            assert langid.phrases(blocks, automaton, np.arange(n) > 0).sum() == want


def many_scripts(seed):
    """Texts of invented words: two languages over each of five alphabets, with own word lists."""
    rng = random.Random(seed)
    out = {}
    for script, (first, n, size) in {"latin": (97, 26, 6), "cyrillic": (0x430, 32, 6), "greek": (0x3B1, 17, 6), "han": (0x4E00, 3000, 2), "hangul": (0xAC00, 900, 3)}.items():
        for k in (1, 2):
            own = random.Random(f"{script}{k}")
            listed = ["".join(chr(first + own.randrange(n)) for _ in range(size)) for _ in range(300)]
            out[f"{script}{k}"] = " ".join(rng.choice(listed) for _ in range(2000))
    return out


def test_language_of_many_scripts():
    model = langid.learn(many_scripts(1))
    assert [a[4] is None for a in model[2]] == [not lang.startswith("han") for lang in model[0]]
    texts = many_scripts(2)
    got, score = langid.predict([*texts.values(), "\u0e01\u0e02", "12 !"], model)
    assert got[:-2] == list(texts) and min(score[:-2]) > 0.3 and got[-1] == "und"


def test_sparse_moves_equal_full_tables(monkeypatch):
    texts = many_scripts(3)
    wanted = [t[i : i + 400] for t in many_scripts(4).values() for i in (0, 801)] + ["\u0e01\u0e02 abc", "", None]
    found = []
    for wide in (0, 10_000):
        monkeypatch.setattr(langid, "WIDE", wide)
        small = {lang: t[:3000] for lang, t in texts.items()}
        model = langid.learn(small)
        assert all((a[4] is None) == bool(wide) for a in model[2])
        found.append(langid.predict(wanted, model))
    assert found[0] == found[1]


def test_language_id(spark, odd):
    got = langid.identify(table(spark, SF, "documents").select("doc_id", "text", "lang")).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    rows = langid.identify(odd, prefix="own_").collect()
    assert len(rows) == odd.count()
    assert {r["own_lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 8)} == {"und"}


def test_language_learning_on_skew(spark):
    rows = [("1", "xx", "again and again " + str(i)) for i in range(3000)] + [(str(i), "yy", f"{chr(0x430 + i % 32)}{chr(0x430 + i // 32)} " * 1000) for i in range(2, 120)]
    rows += [(str(i), "zz", "lange " * 2000) for i in range(200, 204)]
    docs = spark.createDataFrame(rows, "doc_id string, lang string, text string")
    texts = langid.labelled_text(docs.repartition(7))
    assert texts == langid.labelled_text(docs.repartition(3))
    assert re.fullmatch(r"again and again \d+", texts["xx"]) and texts["zz"] == "lange " * 2000
    assert 30_000 < len(texts["yy"]) <= langid.TEXT_CHARS + langid.ROWS and set(map(len, texts["yy"].split())) == {2}


def test_pipeline_keeps_documents_where_no_language_is_known(spark, odd):
    import corpus_pipeline

    kept = corpus_pipeline.language_id(spark, odd.withColumn("lang", F.lit(None).cast("string")), SF)
    assert sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 2, 6, 7, 9, 10] and kept.columns == odd.columns


def test_toxicity(spark, odd, labels):
    sf = "/root/testdata/sf0.1"  # the smaller ones have 6 toxic held-out documents or fewer
    marks = table(spark, sf, "labels")
    got = toxicity.score(table(spark, sf, "documents"), marks).join(marks, "doc_id").where("held_out").collect()
    good = [r["score"] for r in got if r["toxic"] == 0]
    bad = [r["score"] for r in got if r["toxic"] == 1]
    assert sum(x > y for x in bad for y in good) > 0.95 * len(good) * len(bad)
    assert sum(x >= 0.5 for x in bad) > 0.85 * len(bad) and sum(x >= 0.5 for x in good) < 0.02 * len(good)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in toxicity.score(odd, labels).collect()} == {0.0}


def test_html(spark):
    page = """<html><head><title>t</title></head><body><header>Site name</header><nav><a href=x>Menu one</a></nav><script>if (a<b) {"</p>"}</script>
    <article><header><h1>Big &amp; title</h1></header><p class='x>y'>First   <b>para</b>graph.<br>Next&nbsp;line<p>Second <i>one</i><aside>By the way</aside><!-- no <p>this</p> -->
    <form><label>Mail</label></form></p></article><section class="comments"><p>What a great article this is!</p></section><div class="cookie-notice">We use cookies</div><footer>&copy; us</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p></p>"), (5, "u", "plain text only"), (6, "u", "<div><p>Words enough to be the text of the page.</p></div><script>x")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Big & title\nFirst paragraph.\nNext line\nSecond one"
    assert [got[i]["text"] for i in (2, 3, 4)] == ["", "", ""]
    assert got[5]["text"] == "plain text only" and got[6]["text"] == "Words enough to be the text of the page."
    assert got[1]["n_chars"] == len(got[1]["text"])


def test_html_blocks_inside_the_article():
    advert = "<div class='ad'>" + "<p>buy <a href=x>this</a> now</p>" * 200 + "</div>"
    comments = "<section class='comments'>" + "<p>I do not agree with any of it</p>" * 60 + "</section>"
    page = f"<nav>Menu {PROSE}</nav><article><h1>A short title</h1>{advert}<p>First part.</p>{comments}<p>Last part.</p>{'<img src=x>' * 300}<p>End.</p></article><footer>{PROSE * 3}</footer>"
    for weights in ({}, {"word": 0.1, "<p>": -2.0, "<a>": -2.0}):
        assert html.main_text(page, weights) == "A short title\nFirst part.\nLast part.\nEnd."


def test_chat_round_trip(spark):
    rng = random.Random(1)
    parts = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "\\", "|", "été", " ", "%0A", "🙂", "<\\|"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for c in range(30) for t in range(4)]
    rows += [(99, 0, "assistant", None), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for k, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want


def test_mixing(spark, odd):
    for docs in (table(spark, SF, "documents"), odd):
        rows = mixing.mix(docs).collect()
        assert sorted(r["size"] for r in rows) == sorted(len(words(r["text"])) for r in docs.select("text").collect())
        for s in {r["source"] for r in rows}:
            own = [r for r in rows if r["source"] == s]
            assert sum(r["taken"] for r in own) == round(own[0]["target"]) or abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
            assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert all(0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1 for r in rows)
        assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    targets = mixing.plan({"a": 100, "b": 1000, None: 10})
    assert targets["a"][0] == 200 and abs(sum(t for t, _ in targets.values()) - 1665) < 1e-6


def test_mixing_places_every_pass(spark, odd):
    for docs in (table(spark, SF, "documents"), odd):
        mixed = mixing.mix(docs)
        rows, each = mixed.collect(), mixing.passes(mixed).collect()
        slopes = {s: slope for s, (_, slope) in mixing.plan({r["source"]: r["source_size"] for r in rows}).items()}
        assert any(len(r["positions"]) == 2 for r in rows)
        for r in rows:
            assert len(r["positions"]) == (-(-r["taken"] // r["size"]) if r["size"] else 0)
            assert not r["positions"] or r["positions"][0] == r["position"]
        assert sum(e["words"] for e in each) == sum(r["taken"] for r in rows)
        assert [e["position"] for e in each] == sorted(e["position"] for e in each)
        # At each place, the words of a source's earlier passes are its integrated weight.
        for s, slope in slopes.items():
            before, goal = 0, sum(e["words"] for e in each if e["source"] == s)
            for e in (e for e in each if e["source"] == s):
                t = e["position"]
                assert abs(goal * ((1 - slope) * t + slope * t * t) - before) < 1e-6 * goal + 1e-6
                before += e["words"]


def test_empty_tables(spark, odd, labels, benchmark):
    none = odd.limit(0)
    for df in (
        quality.quality_rules(none, labels), licenses.license_scan(none), simhash.near_duplicates(none), repeats.repeated_strings(none),
        decontaminate.decontaminate(none, benchmark, prefix="x_"), langid.identify(none, prefix="x_"), toxicity.score(none, labels), mixing.mix(none),
        html.extract(spark.createDataFrame([], "page_id long, url string, html string")),
        chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    ):
        assert df.count() == 0
    clean = decontaminate.decontaminate(odd, benchmark.limit(0), prefix="x_")
    assert clean.where("x_contaminated").isEmpty() and clean.count() == odd.count()


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns, name
            docs = out
    n = out.count()
    assert 0 < n <= table(spark, SF, "documents").count()
    ids = [r[0] for r in out.select("doc_id").collect()]
    assert len(set(ids)) == n
    odd_kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.language_id(spark, odd, SF), SF)
    assert odd_kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in odd_kept.where("doc_id IN (1, 2)").collect()) == [1]
    assert set(queries.queries()) >= {"pipeline", "op9_repeated_strings"}
