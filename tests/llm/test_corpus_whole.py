"""Whole results of the corpus operators against plain versions: hot groups, long texts, blocks, templates, pages, pipeline."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, common, decontaminate, html, langid, licenses, mixing, quality, repeats, simhash, toxicity
from tickloom.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some(rng, n, words=500):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# ---- near-duplicates: one row of each group -----------------------------------------------------------------


def test_keep_one_tells_rows_apart(spark):
    rng = random.Random(2)
    a, b, c = some(rng, 60), some(rng, 60), some(rng, 60)
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (None, a, "s"), (None, c, "s"), (None, c, "t"), (5, b, "s"), (2, b, "s"), (7, None, "s"), (8, "", "s")]
    kept = simhash.keep_one(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, a), (2, b), (0, c), (7, "")])
    assert simhash.keep_one(documents(spark, rows * 3)).count() == 4


def test_fingerprint_of_a_text_of_many_blocks():
    import xxhash

    words = [f"w{i % 977}x{i % 31}" for i in range(simhash.BLOCK + 500)]
    ones = [0] * 64
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    want = sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)
    assert simhash.fingerprint(" ".join(words)) % (1 << 64) == want


# ---- license scan ------------------------------------------------------------------------------------------


def brute_licenses(text, templates, shingle=licenses.SHINGLE):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    own = lambda w: [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
    found = {}
    for name, t in templates.items():
        wanted = set(own(re.findall(r"[^\W_]+", t.lower())))
        if not wanted:
            continue
        n, stride, best = len(wanted), max(1, len(wanted) // licenses.STRIDE_PART), 0.0
        for s in {*range(0, max(1, len(words) - shingle + 2 - n), stride), max(0, len(words) - shingle + 1 - n)}:
            piece = words[max(0, s - stride) : max(0, s - stride) + n + 2 * stride + shingle - 1]
            best = max(best, len(wanted & set(own(piece))) / n)
        if best >= licenses.CONTAINMENT:
            found[name] = best
    return ",".join(sorted(found)), max(found.values(), default=None)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(4)
    worn = " ".join(w for i, w in enumerate(licenses.TEMPLATES["mit-grant"].split()) if i % 60 != 30)
    half = licenses.TEMPLATES["gpl-notice"][:120]
    rows = [(i, " ".join((some(rng, rng.randrange(80)), rng.choice([*licenses.TEMPLATES.values(), worn, half]), some(rng, rng.randrange(80)))), "s") for i in range(60)]
    rows += [(100, worn * 3 + some(rng, 3000) + half, "s"), (101, None, "s"), (102, "Released under the MIT", "s"), (103, "", "s"), (None, worn, "s")]
    for docs in (documents(spark, rows), table(spark, SF, "documents")):
        got = sorted((str(r["doc_id"]), r["licenses"], r["best_containment"]) for r in licenses.license_scan(docs).collect())
        want = sorted((str(r["doc_id"]), *brute_licenses(r["text"], licenses.TEMPLATES)) for r in docs.collect())
        assert got == want


def test_licenses_of_many_templates(spark):
    rng = random.Random(6)
    named = {f"t{i:03}": some(rng, rng.randrange(6, 60), 5000) for i in range(400)}
    listed = spark.createDataFrame([*named.items(), ("short", "only four words here"), (None, "no name"), ("none", None), ("t000", named["t000"] + " zz")], "name string, text string")
    rows = [(i, some(rng, 30, 5000) + " " + t + " " + some(rng, 30, 5000), "s") for i, t in enumerate(named.values())]
    began = time.time()
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(documents(spark, rows), listed).collect()}
    assert all(name in got[i].split(",") for i, name in enumerate(named)) and time.time() - began < 120


# ---- decontamination in blocks ------------------------------------------------------------------------------


def test_decontamination_in_blocks_is_the_same(spark):
    docs = table(spark, SF, "documents").withColumn("state", F.lit("clash"))
    bench = table(spark, SF, "benchmark").union(spark.createDataFrame([(None, "the of and"), (900_000, "un"), (900_001, "UN")], "item_id long, text string"))
    cols = ["doc_id", "x_n_words", "x_n_hit", "x_n_items", "x_items_sha256", "x_contaminated", "state"]
    found = [sorted(str(tuple(r)) for r in decontaminate.decontaminate(docs, bench, "x_", size).select(cols).collect()) for size in (1 << 30, 60_000)]
    assert found[0] == found[1] and any("True" in r for r in found[0])


def test_patterns_have_the_words_of_texts(spark):
    texts = ["Été 1 a-b_c d e İX ß\x00q" * 3, "ABC def", "", None, "🙂 z" * 20]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    want = defaultdict(set)
    for i, t in enumerate(texts):
        w = decontaminate.words_of(t)
        m = min(decontaminate.WINDOW, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            want[b" ".join(w[k : k + m]).decode(), m].add(str(i))
    assert {(r["pattern"], r["m"]): set(r["items"]) for r in decontaminate.patterns(bench).collect()} == want


# ---- repeated strings ---------------------------------------------------------------------------------------


def test_repeats_across_the_pieces_of_a_long_text(spark, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    noise = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    long = noise(1900) + passage + noise(3000) + passage[:400] + noise(200)
    docs = documents(spark, [(1, long, "s"), (2, noise(300) + passage[100:350], "s"), (3, None, "s"), (4, "", "s")]).withColumn("k", F.lit(1))

    def brute(texts, n=repeats.LENGTH):
        seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        out = []
        for t in texts:
            hit = {j for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1 for j in range(i, i + n)}
            out.append((len(t), len(hit), hashlib.sha256(bytes(b for i, b in enumerate(t) if i not in hit)).hexdigest()))
        return sorted(out)

    want = brute([(r["text"] or "").encode() for r in docs.collect()])
    for piece in (1 << 20, 512, 300):
        groups = list(repeats._groups([0], [long.encode()]))
        assert groups
        monkeypatch.setattr(repeats, "PIECE", piece)
        rows = list(repeats._groups([7], [long.encode()]))
        joined = {(at + i): b[i : i + repeats.LENGTH] for g in rows for _, at, b in g for i in range(len(b) - repeats.LENGTH + 1)}
        assert joined == {i: long.encode()[i : i + repeats.LENGTH] for i in range(len(long) - repeats.LENGTH + 1)}
    assert sorted((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeats.repeated_strings(docs).collect()) == want


# ---- mixing -------------------------------------------------------------------------------------------------


def test_mixing_equals_brute_force_on_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 16)
    rng = random.Random(9)
    rows = [(i, some(rng, rng.randrange(30)), "abc"[i % 3]) for i in range(300)] + [(None, "same text here", None)] * 70 + [(400, None, "a"), (401, "", "d")] + [(None, some(rng, 9), "a") for _ in range(50)]
    docs = documents(spark, rows).withColumn("size", F.lit("clash")).withColumn("n", F.lit(0))
    got = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    keyed = docs.select("doc_id", "source", "text", F.xxhash64(F.col("doc_id"), F.lit("mix"), F.col("source"), F.col("text")).alias("h")).collect()
    plan = mixing.plan({s: sum(len((r["text"] or "").split()) for r in keyed if r["source"] == s) for s in {r["source"] for r in keyed}})
    want = []
    for s, (target, slope) in plan.items():
        own = sorted((r for r in keyed if r["source"] == s), key=lambda r: (r["h"] % (1 << 64) >> 33, r["h"]))
        total, goal, at = sum(len((r["text"] or "").split()) for r in own), round(target), 0
        for r in own:
            n = len((r["text"] or "").split())
            takes = [max(0, min(n, goal - p * total - at)) for p in range(mixing.REPEAT)]
            want.append((str(r["doc_id"]), n, total, round(target, 6), sum(takes), sum(t > 0 for t in takes)))
            at += n
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"], len(r["positions"])) for r in got) == sorted(want)


def test_mixing_of_many_sources(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'a b c' AS text", "concat('s ', id) AS source")
    began = time.time()
    rows = mixing.mix(docs).collect()
    assert len(rows) == 20_000 and time.time() - began < 60
    assert abs(sum(r["taken"] for r in rows) - 90_000) <= 20_000


# ---- toxicity -----------------------------------------------------------------------------------------------


def test_toxicity_features_by_hand():
    assert toxicity.tokens("You are 4n !d10t, f*ck it's") == ["you", "are", "an", "!d10t"[1:].replace("1", "i").replace("0", "o"), "fck", "its"]
    lexicon, heads = {"bad": 2.0}, ({"bad": 2.0}, {}, {})
    plain = toxicity.features("ÉLAN odd", lexicon, heads)
    hit = toxicity.features("ÉLAN bad", lexicon, heads)
    at = toxicity.FEATURES.index
    assert plain[at("capitals")] == hit[at("capitals")] == 0.5
    assert hit[at("hit_share")] == 0.5 and plain[at("hit_share")] == 0
    near = toxicity.features("you " + "x " * 3 + "bad " + "x " * 9 + "badly bad!", lexicon, heads)
    assert near[at("near_share")] == 0.5 and near[at("head_share")] == pytest.approx(1 / 16) and near[at("exclaims")] == pytest.approx(1 / 16)
    for text in (None, "", " \n", "é" * 50_000):
        assert len(toxicity.features(text, lexicon, heads)) == len(toxicity.FEATURES)
    for text in ("Ünïcode ÀÉÎ Ж ж Ω", "ABC", "ǅ \U00010400"):
        assert toxicity.capitals(text) == sum(c.isupper() for c in text)


def test_toxicity_of_repeated_ids_and_one_sided_folds(spark):
    rows = [(1, "fine words " + str(i), "s") for i in range(400)] + [(i, ("vile awful trash " if i % 2 else "calm fine day ") + str(i), "s") for i in range(2, 200)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 200) if toxicity.held_out], "doc_id long, toxic int")
    picked = toxicity._labelled(documents(spark, rows), marks)
    assert picked.count() == picked.select("doc_id").distinct().count()
    one_sided = marks.join(picked.where("fold = 3 AND toxic = 1"), "doc_id", "left_anti")
    got = toxicity.score(documents(spark, rows), one_sided).where("doc_id > 1").collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in got) > 0.95 * len(got)


# ---- pages --------------------------------------------------------------------------------------------------


def words(n, w="word"):
    return " ".join(f"{w}{i}" for i in range(n))


def learned():
    import pandas

    seen: dict = {}
    for page in pandas.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]:
        for (kind, inside), n in html.counts(page).items():
            seen.setdefault(kind, [0, 0])[inside] += n
    return html.log_odds(seen)


WEIGHTS = learned()


def test_pages_without_a_leak_or_a_loss():
    body = f"<p>{words(40)}</p>"
    pages = {
        f"<article><p>{words(10)}</p><aside>{words(50, 'x')}</aside><p>{words(30)}</p></article>": 40,
        f"<div><p>{words(10)}</p><aside>{words(50, 'x')}</aside><p>{words(30)}</p></div>": 40,
        f"<div class=post>{body}</div><div class='comment-body'>{words(50, 'x')}</div><p class='comment-text'>{words(50, 'x')}</p>": 40,
        f"<article>{body}<div class='comment-body'>{words(50, 'x')}</div></article>": 40,
        f"<div class='sidebar-content'>{words(50, 'x')}</div>{body}<div class=cookie-container>{words(20, 'x')}</div>": 40,
        f"<article><h1 class='header'>One</h1><p class='legal'>{words(4)}</p><div class='more'>{words(5)}</div></article>": 10,
        f"<article>teaser</article><div><p>{words(200)}</p><p>{words(100)}</p></div>": 300,
        f"<div class='wrapper has-sidebar'>{body}</div><form>{words(9, 'x')}</form>": 40,
        f"<div class='site-header'>{words(30, 'x')}</div><ul class='page-nav'><li>{words(9, 'x')}</ul>{body}<div class='site-footer'>{words(30, 'x')}</div>": 40,
        f"<div class='content'><div class='post-share'>{words(9, 'x')}</div>{body}<div id='post-comments'><p>{words(60, 'x')}</p></div></div>": 40,
        f"<form id=page><nav>{words(5, 'x')}</nav><h1>One</h1>{body}</form>": 41,
        f"<article><h1>One two</h1><div class='ad'>{words(9, 'x')}</div><p>{words(300)}</p></article>": 302,
    }
    for page, n in pages.items():
        text = html.main_text(page, WEIGHTS)
        assert len(text.split()) == n and "x0" not in text.split(), page[:80]


def test_names_say_what_their_last_word_says():
    body, more = f"<p>{words(40)}</p>", f"<p>{words(50, 'x')}</p>"
    for name in ("user-responses", "readerOpinions", "article__comments--list", "post-share", "cookie-notice", "notice", "related-posts", "ad-unit"):
        assert html.main_text(f"<article>{body}<div class='{name}'>{more}</div>{body}</article>", WEIGHTS).split() == words(40).split() * 2, name
    assert len(html.main_text(f"<article>{body}<section class=discussion>{more}</section></article>", WEIGHTS).split()) == 40
    for page in (
        f"<article>{body}<p class='ad-hoc'>{words(9)}</p></article>", f"<article>{body}<div class='navigation-systems'><p>{words(9)}</p></div></article>",
        f"<article>{body}<p class='sharing-economy'>{words(9)}</p></article>", f"<article>{body}<p class=notice>{words(9)}</p></article>",
    ):
        assert len(html.main_text(page, WEIGHTS).split()) == 49, page[-80:]
    for line in ("&copy; 2024 Some House", "Copyright 2024 Some House. All rights reserved.", "(c) 2024 us"):
        for page in (f"<article>{body}<p>{line}</p></article>", f"<div>{body}<div>{line}</div></div>"):
            assert len(html.main_text(page, WEIGHTS).split()) == 40, line


def bare(page, rng):
    """A page without what names and elements say."""
    page = re.sub(r'class="[^"]*"', lambda m: 'class="' + "".join(rng.choice("bcdfgkz") for _ in range(6)) + '"', page)
    for name in ("article", "nav", "footer"):
        page = page.replace(f"<{name}", "<div").replace(f"</{name}", "</div")
    return page


def test_weights_and_scan_find_the_text_of_pages_without_names(monkeypatch):
    import pandas

    pages, rng = list(pandas.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]), random.Random(1)

    def measured(weights):
        good = n_got = n_want = 0
        for page in pages:
            want, got = (Counter(t.split()) for t in (html.main_text(page, WEIGHTS), html.main_text(bare(page, rng), weights)))
            good, n_got, n_want = good + (got & want).total(), n_got + got.total(), n_want + want.total()
        return good / n_got, good / n_want

    precision, recall = measured(WEIGHTS)
    assert precision > 0.99 and recall > 0.99
    assert measured({})[0] < precision - 0.01
    monkeypatch.setattr(html, "best_region", lambda scores: (0, len(scores)))
    assert measured(WEIGHTS)[0] < precision - 0.01


def test_the_region_is_the_best_one():
    rng = random.Random(11)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(14))]
        first, end = html.best_region(scores)
        every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[first:end]) == max([0.0, *every])
    assert html.best_region([1.0, -1.0, 1.0]) == (0, 1) and html.best_region([-1.0]) == (0, 0)


def test_marked_and_unmarked_pages_give_the_same_text():
    import pandas

    pages = list(pandas.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"])
    same = good = n_got = n_want = 0
    for page in pages:
        want = html.main_text(page, WEIGHTS)
        got = html.main_text(page.replace("<article", "<div").replace("</article", "</div"), WEIGHTS)
        same += got == want
        good += sum((Counter(got.split()) & Counter(want.split())).values())
        n_got, n_want = n_got + len(got.split()), n_want + len(want.split())
    assert good > 0.99 * n_got and good > 0.99 * n_want and same > 0.9 * len(pages)


def test_broken_pages_take_linear_time():
    k = 40_000
    for page in ("<a " * 350_000, '<a "' * 250_000, "<b>" * k + "<hr>" * k, "<div>" * k + "</section>" * k, "<script>" * k, "<!--" * k, '<p class="' * k + ">", "<i><b>" * k + "</i>" * k, "<" * 1_000_000, "x" * 1_000_000):
        began = time.time()
        html.main_text(page, WEIGHTS)
        assert time.time() - began < 5, page[:12]
    assert html.main_text("<p>a < b and b <c> d <e", WEIGHTS) == "a < b and b d <e"


def test_pages_table(spark):
    rows = [(1, "u", f"<article><p>{words(30)}</p></article>")] * 3 + [(None, None, None), (2, "u", "<p>" + "long text " * 60_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in html.extract(pages).collect())
    assert got == [(0, 0), *[(1, len(words(30)))] * 3, (2, 599_999)]


# ---- quality, chat ------------------------------------------------------------------------------------------


def test_quality_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = table(spark, SF, "documents").unionByName(documents(spark, [(90_001, "a " * 300, "s")]).withColumn("lang", F.lit("(null)")).select("doc_id", "text", "lang", "source", "n_chars"))
    marks = table(spark, SF, "labels")
    want = sorted(map(str, quality.quality_rules(docs, marks).collect()))
    monkeypatch.setattr(quality, "MAX_STRATA", 0)
    assert sorted(map(str, quality.quality_rules(docs, marks).collect())) == want
    strata = {r["stratum"] for r in quality.scored(quality.features(docs)).select("stratum").distinct().collect()}
    assert "=(null)" in strata and all(s == "" or s.startswith("=") for s in strata)


def test_chat_of_a_long_text_and_clashing_columns(spark):
    text = "word <|im_start|> " * 20_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0)).withColumn("tokens", F.lit(0))
    got = chat.digests(chat.format_conversations(df)).first()
    assert got["loss_chars"] == len(text) and got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_vocabulary_beyond_its_bound(tmp_path, monkeypatch):
    path = tmp_path / "v"
    path.write_bytes(b"x" * 100)
    monkeypatch.setattr(chat, "MAX_VOCAB", 99)
    with pytest.raises(ValueError):
        chat.read_vocabulary(str(path))


# ---- shared storage, pipeline -------------------------------------------------------------------------------


def test_written_frames_can_be_cleared(spark):
    before = common.written()
    one, two = (common.materialise(spark.range(n), "clear") for n in (3, 4))
    common.drop_written(one)
    assert common.written() == before + 1 and two.count() == 4
    three = common.materialise(spark.range(5), "clear")
    common.clear(spark, three, before)
    assert common.written() == before + 1 and three.count() == 5
    common.clear(spark, since=before)
    assert common.written() == before


def odd_documents(spark):
    rng = random.Random(12)
    base, passage = some(rng, 150), some(rng, 80, 9000)
    rows = [(i, some(rng, 60) + " " + passage, "ab"[i % 2]) for i in range(4)]
    rows += [(10, base, "a"), (11, base, None), (12, base, "a"), (12, base, "a"), (None, base, "b"), (None, some(rng, 40), None), (13, None, "a"), (14, "", "a"), (15, "1 2 3", "a"), (16, some(rng, 3000), "b")]
    return documents(spark, rows).withColumn("score", F.lit("clash")).withColumn("size", F.lit(1.5)).withColumn("fp", F.lit("z"))


def test_pipeline_equals_plain_version(spark):
    """The five stages against plain Python, on nulls, copies, repeated rows and clashing columns."""
    import corpus_pipeline as cp

    docs = odd_documents(spark)
    rows = [r.asDict() for r in docs.collect()]
    bench = [decontaminate.words_of(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    fps = {r["text"]: simhash.fingerprint(r["text"]) % (1 << 64) for r in rows}
    groups = []
    for text in fps:
        near = [g for g in groups if any((fps[text] ^ fps[t]).bit_count() <= 2 for t in g)]
        groups = [g for g in groups if g not in near] + [{text}.union(*near)]
    first = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    rows = [min((r for r in rows if r["text"] in g), key=first) for g in groups]
    seen = Counter(b[i : i + 200] for b in (r["text"].encode() for r in rows) for i in range(len(b) - 199))
    for r in rows:
        b = r["text"].encode()
        cut = {j for i in range(len(b) - 199) if seen[b[i : i + 200]] > 1 for j in range(i, i + 200)}
        r["text"] = bytes(x for i, x in enumerate(b) if i not in cut).decode("utf-8", "ignore")
    wins = {tuple(w[i : i + min(10, len(w))]) for w in bench if w for i in range(len(w) - min(10, len(w)) + 1)}
    dirty = lambda w: any(tuple(w[i : i + m]) in wins for m in {len(x) for x in wins} for i in range(len(w) - m + 1))
    rows = [r for r in rows if not dirty(decontaminate.words_of(r["text"]))]
    want = sorted((str(r["doc_id"]), len(r["text"].split())) for r in rows)

    now = docs
    for name, stage in cp.STAGES:
        now = stage(spark, now, SF)
        assert cp.STAGES[-1][1] is stage or now.columns == docs.columns, name
        if name == "language ID":
            held = now.collect()
            assert {r["lang"] for r in held} <= {r["lang"] for r in docs.collect()} and len(held) == len([r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")])
    assert sorted((str(r["doc_id"]), r["size"]) for r in now.collect()) == want
    assert sorted((str(r["doc_id"]), r["text"], r["source"]) for r in now.collect()) == sorted((str(r["doc_id"]), r["text"], r["source"]) for r in rows)
    assert set(now.columns) == {f"document_{c}" if c in ("size",) else c for c in docs.columns} | {"size", "source_size", "target", "taken", "position", "positions"}
    assert sum(r["taken"] for r in now.collect()) == pytest.approx(1.5 * sum(n for _, n in want), abs=3)


def test_stages_of_empty_tables(spark):
    import corpus_pipeline as cp

    none = odd_documents(spark).limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0, name
    assert langid.identify(none, prefix="x_").count() == 0


def test_mixing_carries_whole_documents(spark):
    rows = [(i % 3, "one two three", "a") for i in range(9)] + [(None, "four", None), (5, None, "b"), (5, "six", "b")]
    docs = documents(spark, rows).withColumn("taken", F.lit("clash")).withColumn("n", F.col("doc_id") * 2)
    got, plain = mixing.mix(docs, whole=True), mixing.mix(docs)
    digest = lambda df: sorted(str((r["doc_id"], r["source"], r["size"])) for r in df.collect())
    assert digest(got) == digest(plain) and sum(r["taken"] for r in got.collect()) == sum(r["taken"] for r in plain.collect())
    assert sorted(str((r["doc_id"], r["text"], r["source"], r["document_taken"], r["n"])) for r in got.collect()) == sorted(str((a, b, c, "clash", None if a is None else 2 * a)) for a, b, c in rows)


def test_many_copies_of_a_row(spark):
    """Rows alike in doc_id and text: all of a long one goes, a short one stays, and work grows with their number."""
    rng = random.Random(4)
    long, other = some(rng, 900), some(rng, 300)
    rows = [(7, long, "a")] * 3000 + [(8, "short", "a")] * 50 + [(9, other + long[300:900], "a"), (10, other[:300] + some(rng, 90), "b"), (None, None, "a"), (None, None, "a")]
    got = [tuple(r) for r in repeats.repeated_strings(documents(spark, rows)).collect()]
    want = Counter((d, len((t or "").encode())) for d, t, _ in rows)
    assert Counter(g[:2] for g in got) == want
    assert {g[2:4] for g in got if g[0] == 7} == {(len(long), 1)} and {g[2:4] for g in got if g[0] in (8, None)} == {(0, 0)}
    assert {g[:4] for g in got if g[0] == 9} == {(9, len(other) + 600, 900, 2)}
    assert {g[2] for g in got if g[0] == 10} == {300}
    kept = repeats.without_repeats(documents(spark, rows)).collect()
    assert {r["text"] for r in kept if r["doc_id"] == 7} == {""} and sum(r["text"] is None for r in kept) == 2


def test_decontamination_with_a_column_named_state(spark):
    docs = documents(spark, [(1, "nothing here", "a")]).withColumn("state", F.lit(1)).withColumn("state_row", F.lit(2)).withColumn("items", F.lit(3))
    bench = spark.createDataFrame([(1, "nothing here"), (2, "else")], "item_id long, text string")
    for size in (1 << 20, 1):
        got = decontaminate.decontaminate(docs, bench, table_bytes=size).collect()
        assert len(got) == 1 and got[0]["contaminated"] and got[0]["state"] == 1


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(str(i), "xx", f"{chr(0x430 + i)} " * (150_000 + i)) for i in range(2, 8)] + [(str(i), "yy", "words " * 200) for i in range(10, 30)]
    texts = langid.labelled_text(spark.createDataFrame(rows, "doc_id string, lang string, text string"))
    from tickloom.llm.common import held_out

    free = {r[0] for r in spark.createDataFrame(rows, "doc_id string, lang string, text string").where(~held_out(F.col("doc_id"))).collect()}
    shortest = min(int(i) for i, lang, _ in rows if lang == "xx" and i in free)
    assert len(texts["xx"]) == 2 * (150_000 + shortest) and texts["yy"]
