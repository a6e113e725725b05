"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled rows that are not held out are dealt by crc32(doc_id) mod 5: remainders 1 and 2 give the lexicon,
3 the trees, 4 the calibration, so no step is fitted on what another has already seen. Each may use
FIT_ROWS documents (by hash of doc_id; the least text of a repeated doc_id) at most. Where remainder 3 lacks one
kind of label, all three steps use all these rows.

Lexicon: words and word beginnings (3, 5 and 7 letters) seen in MIN_DOCS documents or more, by smoothed log odds
of toxic against other documents; the LEXICON strongest above LEAST_ODDS. Words are compared after undoing
digit and symbol substitutions. Features: densities of lexicon hits (whole words, beginnings, summed odds),
nearness of second-person words to hits, capitals, punctuation and obfuscation rates.

score is the calibrated value, with a thousandth part of the trees' probability to keep the order inside
a calibration step.

Defined results: null and empty texts get the score of all-zero features; with fewer than LEAST_LABELS
labelled documents of either kind every score is 0; a doc_id with both labels is toxic; very long texts are scored whole; equal texts get equal scores; a score of
exactly 0.5 is predicted toxic; repeated rows give repeated rows; labels, lang and source are never read for scores, other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import append, drop_written, held_out, materialise

FIT_ROWS = 20_000
LEXICON = 3_000
LEAST_LABELS = 5
MIN_DOCS = 3
LEAST_ODDS = 1.5
NEAR = 6
HEADS = (3, 5, 7)
TREES, DEPTH = 20, 3

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
# Characters that stand in for letters.
STAND_IN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_TOKEN = re.compile(r"[^\W_]+(?:[@$!*'][^\W_]+)*|[@$][^\W_]+")
_PLAIN = str.maketrans(STAND_IN)
_MIXED = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-*]){3,}[^\W\d_]\b")

FEATURES = (
    "hit_share", "hits_log", "head_share", "head_log", "odds_mean", "odds_max", "near_share",
    "second_share", "capitals", "exclaims", "punctuation", "obfuscated", "spaced", "words_log",
)


def tokens(text: str) -> list[str]:
    """Lower-cased words with stand-ins undone where a word mixes them with letters."""
    out = []
    for w in _TOKEN.findall(text.lower()):
        if not w.isalpha():
            if any(c.isalpha() for c in w):
                w = w.translate(_PLAIN).replace("*", "").replace("'", "")
        out.append(w)
    return out


def terms(text: str | None) -> list[str]:
    """Distinct lexicon terms of a text: words, and beginnings marked by their length."""
    words = set(tokens(text or ""))
    return sorted(words | {f"{n}:{w[:n]}" for w in words for n in HEADS if len(w) > n})


_ASCII_CAPITALS, _BEYOND_ASCII = re.compile("[A-Z]"), re.compile("[^\\x00-\\x7f]")


def capitals(text: str) -> int:
    """Capital letters of a text, of any alphabet."""
    ascii_ = len(_ASCII_CAPITALS.findall(text))
    return ascii_ if text.isascii() else ascii_ + sum(map(str.isupper, _BEYOND_ASCII.findall(text)))


def features(text: str | None, lexicon: dict[str, float], heads: tuple[dict[str, float], ...]) -> list[float]:
    text = text or ""
    words = tokens(text)
    n = max(1, len(words))
    chars = max(1, len(text))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    odds = [lexicon[words[i]] for i in hits]
    begun = 0
    for size, table in zip(HEADS, heads):
        if table:
            found = [table[w[:size]] for w in words if len(w) > size and w[:size] in table]
            begun += len(found)
            odds += found
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near, j = 0, 0
    for i in hits:
        while j < len(you) and you[j] < i - NEAR:
            j += 1
        near += j < len(you) and you[j] <= i + NEAR
    return [
        len(hits) / n, math.log1p(len(hits)), begun / n, math.log1p(begun), sum(odds) / n, max(odds, default=0.0),
        near / max(1, len(hits)), len(you) / n, capitals(text) / chars, text.count("!") / n,
        sum(text.count(c) for c in ".,;:?-") / n, len(_MIXED.findall(text)) / n, len(_SPACED.findall(text)) / n,
        math.log1p(len(words)),
    ]


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, fold of at most FIT_ROWS labelled documents of each use; never a held-out row."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("fold", _fold(F.col("doc_id"))).where("fold > 0")
    # A merge join: neither side is shipped whole, however few labels there seem to be.
    known = marks.hint("merge").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    use = {1: 0, 2: 0, 3: 1, 4: 2}
    picked = None
    for k in range(3):
        part = known.where(F.col("fold").isin([f for f, u in use.items() if u == k]))
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
        picked = part if picked is None else picked.unionByName(part)
    picked = materialise(picked, "toxic-labels")  # 3 * FIT_ROWS small rows at most
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = materialise(found.groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text")), "toxic-rows")
    drop_written(picked)
    return rows


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Term -> smoothed log odds, the LEXICON strongest; counted on Spark over distinct terms of each text."""
    named = append(rows.select("toxic", "text"), lambda texts: [[terms(t) for t in texts]], [("terms", "array<string>")])
    total = rows.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    odds = F.log(((F.col("t") + 0.3) / (total["t"] + 0.6)) / ((F.col("c") + 0.3) / (total["c"] + 0.6)))
    strong = (
        named.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
        .where(F.col("t") >= MIN_DOCS)
        .select("term", odds.alias("odds"))
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("odds"), "term")
        .limit(LEXICON)
    )
    return {r["term"]: float(r["odds"]) for r in strong.collect()}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    rows = _labelled(own, labels)
    found = rows.groupBy("fold", "toxic").count().collect()
    kinds = {(r["fold"], r["toxic"]) for r in found}
    base = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"))
    if any(sum(r["count"] for r in found if r["toxic"] == toxic) < LEAST_LABELS for toxic in (0, 1)):
        return base.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    dealt = {(3, 0), (3, 1)} <= kinds
    use = (lambda *folds: F.col("fold").isin(*folds)) if dealt else (lambda *folds: F.lit(True))
    lexicon = learn_lexicon(rows.where(use(1, 2)))
    whole = {t: o for t, o in lexicon.items() if ":" not in t}
    heads = tuple({t[2:]: o for t, o in lexicon.items() if t.startswith(f"{n}:")} for n in HEADS)
    shared = spark.sparkContext.broadcast((whole, heads))

    def vectors(df: DataFrame) -> DataFrame:
        made = append(df, lambda texts: [[features(t, *shared.value) for t in texts]], [("f", "array<double>")]).drop("text")
        made = made.select("*", *[F.col("f")[i].alias(x) for i, x in enumerate(FEATURES)]).drop("f")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(made).drop(*FEATURES)

    fit = materialise(vectors(rows), "toxic-vectors").withColumn("y", F.col("toxic").cast("double")).coalesce(8)
    trees = GBTClassifier(featuresCol="v", labelCol="y", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=3, stepSize=0.2, seed=7)
    model = trees.fit(fit.where(use(3)))
    p = vector_to_array("probability")[1]
    ranked = model.transform(fit.where(use(4))).select("y", p.alias("p"))
    if ranked.isEmpty():
        ranked = model.transform(fit.where(use(3))).select("y", p.alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="c").fit(ranked)
    made = model.transform(vectors(own)).select("doc_id", p.alias("p"))
    made = steps.transform(made)
    final = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("c") + 0.001 * F.col("p")))
    return made.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        final.alias("score"),
        (final >= 0.5).cast("int").alias("predicted"),
    )
