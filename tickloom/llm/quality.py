"""Quality rules with risk-controlled cutoffs (native DataFrame code only).

Base rules are counts over the whole text. On top of them each rule score (an integer per mille) gets a
cutoff per stratum (the document's `lang`, null being a stratum of its own). Labelled good documents are the
holdout: cutoffs are tried from the most lenient to the strictest; a cutoff is admissible while the exact
binomial test rejects "the false rejection rate is above ALPHA / number of rules" at level
DELTA / (strata * rules) (fixed-sequence testing inside a rule, Bonferroni across rules and strata), up to the
first failure. All admissible cutoffs hold together, so one may be picked freely: the one with the largest
lead of the rejection rate of labelled bad documents over that of good ones, if there is a lead; the more
lenient on ties. A stratum with too few labels gets no cutoff: nothing is rejected there without evidence.
With probability 1 - DELTA, at most ALPHA of the good documents of every
stratum that pass the base rules are rejected. A draw of the holdout is a distinct text: copies of one text and
rows of a repeated doc_id (whose label is the lowest given) are not independent and count once.

Defined results: null or empty text has no words (base_failed, not kept); null lang is its own stratum;
repeated rows give repeated rows; very long texts are counted whole; a score equal to a cutoff is rejected; other
columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, drop_written, let, materialise

ALPHA = 0.08
DELTA = 0.10
CUTOFFS = (900, 700, 500, 400, 300, 200, 150, 100, 70, 50, 30, 20, 10)
RULES = ("symbols", "dup_lines", "repeats", "shout")
WINDOW = 8
#: The strata table is broadcast up to this many rows; beyond it a shuffled join is used.
MAX_STRATA = 10_000


def _repeat_words(words, n):
    """Words inside WINDOW-word windows that occur twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def union_length(s):
            last = F.size(s) - 1
            same = F.transform(
                F.sequence(F.lit(0), last),
                lambda j: F.when(
                    ((j > 0) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"]))
                    | ((j < last) & (F.get(s, j + 1)["h"] == F.get(s, j)["h"])),
                    F.get(s, j)["i"],
                ),
            )
            starts = F.sort_array(F.filter(same, lambda i: i.isNotNull()))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
                lambda acc, i: F.struct(
                    (i + WINDOW).alias("end"), (acc["total"] + i + WINDOW - F.greatest(i, acc["end"])).alias("total")
                ),
                lambda acc: acc["total"].cast("long"),
            )

        return let(ordered, union_length)

    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(n > WINDOW, repeated).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the base counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        "lang",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z!]")).cast("long").alias("n_shout"),
        F.md5(F.encode(text, "utf-8")).alias("digest"),
    )
    return split.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.size("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_shout",
        "digest",
    )


def scored(feats: DataFrame) -> DataFrame:
    mille = lambda x, y: F.expr(f"(1000 * {x}) div greatest({y}, 1)")
    return feats.select(
        *[c for c in feats.columns if c not in ("n_lines", "n_shout", "lang")],
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("stratum"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        mille("n_symbols", "word_chars").alias("symbols"),
        mille("n_dup_lines", "n_lines").alias("dup_lines"),
        mille("n_repeat_words", "n_words").alias("repeats"),
        mille("n_shout", "word_chars").alias("shout"),
    )


def _binomial_cdf(k, n, p: float):
    """P(Binomial(n, p) <= k); 1 where k is above the mean, as no test passes there."""
    from math import log

    step = lambda acc, j: F.struct(
        (acc["lt"] + F.log((n - j) / (j + 1)) + log(p / (1 - p))).alias("lt"), (acc["s"] + F.exp(acc["lt"])).alias("s")
    )
    start = F.struct((n * log(1 - p)).alias("lt"), F.lit(0.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda acc: acc["s"])
    return F.when((n == 0) | (k > n * p), F.lit(1.0)).otherwise(total)


def cutoffs(scores: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: the cutoff of each rule, null where none is admissible and useful. `labels`: doc_id, quality.

    Rows of `scores` with one digest are one draw, labelled with the lowest label any of them has.
    """
    rate = alpha / len(RULES)
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = scores.where(~F.col("base_failed")).join(marks, "doc_id")
    labelled = labelled.groupBy("stratum", "digest").agg(F.min("quality").alias("quality"), *[F.max(r).alias(r) for r in RULES])
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    counts = labelled.groupBy("stratum").agg(
        F.count_if(good).alias("n"),
        F.count_if(bad).alias("n_bad"),
        *[F.count_if(good & (F.col(r) >= c)).alias(f"{r}_{c}") for r in RULES for c in CUTOFFS],
        *[F.count_if(bad & (F.col(r) >= c)).alias(f"{r}_{c}_bad") for r in RULES for c in CUTOFFS],
    )
    counts = materialise(counts, "quality-counts")
    level = delta / max(1, counts.where("n > 0").count() * len(RULES))

    def best(rule: str):
        """Cutoffs up to the first failure, as (lead, leniency, cutoff); the largest with a lead."""
        options = F.array().cast("array<struct<lead:bigint,step:int,cut:int>>")
        for step, c in reversed(list(enumerate(CUTOFFS))):
            k, k_bad = F.col(f"{rule}_{c}"), F.col(f"{rule}_{c}_bad")
            lead = k_bad * F.col("n") - k * F.col("n_bad")
            here = F.struct(lead.alias("lead"), F.lit(-step).alias("step"), F.lit(c).alias("cut"))
            ok = _binomial_cdf(k, F.col("n"), rate) <= level
            options = F.when(ok, F.concat(F.array(here), options)).otherwise(
                F.array().cast("array<struct<lead:bigint,step:int,cut:int>>")
            )
        return F.array_max(F.filter(options, lambda o: o["lead"] > 0))["cut"].alias(f"cut_{rule}")

    return counts.select("stratum", *[best(r) for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, `base_failed` and `kept` of every document; `failed_rule` names the first rule that rejects it."""
    scores = materialise(scored(features(docs)), "quality-scores")
    cuts = materialise(cutoffs(scores, labels), "quality-cutoffs")
    if cuts.count() <= MAX_STRATA:
        cuts = F.broadcast(cuts)
    hit = F.coalesce(*[F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES])
    return scores.join(cuts, "stratum", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & hit.isNull()).alias("kept"),
        F.when(F.col("base_failed"), F.lit("base")).otherwise(hit).alias("failed_rule"),
    )


def oracle() -> str:
    """The same result in DuckDB SQL."""
    rate = ALPHA / len(RULES)
    grid = ", ".join(f"({c}, {i})" for i, c in enumerate(CUTOFFS))
    scores = " UNION ALL ".join(f"SELECT stratum, quality, '{r}' AS rule, {r} AS score FROM good" for r in RULES)
    most = ", ".join(f"max({r}) AS {r}" for r in RULES)
    first = "coalesce(" + ", ".join(f"CASE WHEN s.{r} >= c_{r}.cut THEN '{r}' END" for r in RULES) + ")"
    joins = " ".join(f"LEFT JOIN cuts c_{r} ON c_{r}.stratum = s.stratum AND c_{r}.rule = '{r}'" for r in RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win
      FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM w) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
f AS (
  SELECT d.doc_id, coalesce('=' || lang, '') AS stratum, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(regexp_extract_all(text, '[A-Z!]')) AS n_shout, md5(text) AS digest
  FROM d LEFT JOIN rep USING (rid)),
s AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         (1000 * n_symbols) // greatest(word_chars, 1) AS symbols,
         (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_lines,
         (1000 * n_repeat_words) // greatest(n_words, 1) AS repeats,
         (1000 * n_shout) // greatest(word_chars, 1) AS shout
  FROM f),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
good AS (SELECT stratum, digest, min(quality) AS quality, {most} FROM s JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY stratum, digest),
strata AS (SELECT count(DISTINCT stratum) AS m FROM good WHERE quality = 1),
counts AS (
  SELECT stratum, rule, cut, step, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS n_bad,
         count(*) FILTER (quality = 1 AND score >= cut) AS k, count(*) FILTER (quality = 0 AND score >= cut) AS k_bad
  FROM ({scores}) x, (VALUES {grid}) g(cut, step) GROUP BY ALL),
tests AS (
  SELECT *, CASE WHEN n = 0 OR k > n * {rate} THEN 1.0 ELSE
    list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
      + j * ln({rate}) + (n - j) * ln(1 - {rate})))) END * m * {len(RULES)} <= {DELTA} AS ok
  FROM counts, strata),
cuts AS (
  SELECT stratum, rule, arg_max(cut, struct_pack(a := k_bad * n - k * n_bad, b := -step)) AS cut FROM (
    SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step) AS all_ok FROM tests)
  WHERE all_ok AND k_bad * n > k * n_bad GROUP BY stratum, rule)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {first} IS NULL) AS kept,
       CASE WHEN base_failed THEN 'base' ELSE {first} END AS failed_rule
FROM s {joins}"""
