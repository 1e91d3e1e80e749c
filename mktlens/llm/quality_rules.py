"""Quality rules: fixed counts, and the length-normalised log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words are hashed into ``buckets``. Two multinomials
over the buckets are counted: the trusted target (all documents whose label says good
quality) and the raw corpus (all documents). A document's score is the mean over its
features of ``ln(target / raw)``. Every document with a score of ``threshold`` or
more passes; nothing is drawn at random. Unless it is given, the threshold comes
from the scores of all labelled documents that pass the base rules
(``derived_threshold``): the lowest one that lets at most 1 in 100 of the bad
labels through, unless more than 1 in 1000 of the good ones would go.

All work is DataFrame functions: words, hashes and windows are array expressions,
and the ratios are one constant array. Repeated three-word windows are found by
64-bit hashes, sorted only in texts that have any.

Cases: a null text has no words, symbols or lines, and fails the base rule, as does
an empty one; without labels or documents all ratios are 0; without a good or a bad
label on a document that passes the base rules the threshold is ``THRESHOLD``;
repeated rows are kept and count as rows, but for the threshold, where an id counts
once (a good one's lowest score, a bad one's highest); repeated labels count once,
as good if any says so; further columns of the documents are
ignored by ``judge`` and kept by ``passing``; an empty table gives an empty table;
long texts are judged whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, kept, words_of

BUCKETS = 8192
#: Up to so many labelled ids (16 bytes each) are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
SMOOTHING = 1.0
THRESHOLD = -0.1
#: Shares of the labelled documents that the derived threshold may get wrong, in 1/1000.
BAD_KEPT, GOOD_DROPPED = 10, 1
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with value worked out once, however often body reads it and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(h: Column) -> Column:
    """Hashes of all three-word windows."""
    return _let(h, lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(0))),
                                         lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2))))


def _covered(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more."""
    def spread(s: Column) -> Column:  # s: (hash, place) in order
        twice = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(e["h"])))
        places = F.sort_array(F.transform(twice, lambda e: e["p"]))
        return _let(places, lambda d: F.aggregate(
            F.transform(d, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(d, i + 1) - p, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))

    in_order = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(_let(in_order, spread))


def _features(h: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    pairs = _let(h, lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
                                          lambda x, i: F.xxhash64(x, F.get(a, i + 1))))
    return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def _hashed(docs: DataFrame, *more: Column) -> DataFrame:
    words = docs.select(*more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    words = words.withColumn("__words", words_of(F.col("__text")))
    return words.withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))


def _labelled(labels: DataFrame) -> DataFrame:
    """(__labelled, __good) of every id with a label, once; an id with both labels is good."""
    ids = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    return ids.filter("good = 1 or bad = 1").select("__labelled", (F.col("good") == 1).alias("__good"))


def _by_size(ids: DataFrame) -> DataFrame:
    """The ids with a hint to broadcast them, if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """ln(target / raw) of each bucket: one pass over all documents, summed up to a row a bucket."""
    trusted = _by_size(_labelled(labels).filter("__good").select(F.col("__labelled").alias("__trusted")))
    rows = _hashed(docs, F.col("doc_id").alias("__doc_id")).select("__doc_id", _features(F.col("__hash"), buckets).alias("__f"))
    rows = rows.join(trusted, F.col("__doc_id") == F.col("__trusted"), "left")
    counted = (rows.select(F.col("__trusted").isNotNull().cast("long").alias("good"), F.explode_outer("__f").alias("bucket"))
               .filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect())
    raw, good = [smoothing] * buckets, [smoothing] * buckets
    for r in counted:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    if sum(good) <= smoothing * buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(good))
    return [math.log(g) - math.log(r) + shift for g, r in zip(good, raw, strict=True)]


def _scored(docs: DataFrame, ratios: list[float], *more: Column) -> DataFrame:
    """The counts, the score and whether a document is kept, with the columns ``more``."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text, words, h = F.col("__text"), F.col("__words"), F.col("__hash")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    rows = _hashed(docs, *more).withColumn("__windows", _windows(h)).withColumn("__lines", lines)
    features = _features(h, len(ratios))
    total = F.aggregate(features, F.lit(0.0), lambda a, b: a + F.get(table, b))
    n_words = F.size(words).cast("long")
    rows = rows.select(
        "*", n_words.alias("n_words"),
        F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("__windows")).cast("long").alias("n_repeat_words"),
        (total / F.greatest(F.size(h) * 2 - 1, F.lit(1))).alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return rows.withColumn("base_failed", failed)


def _middle(border: float, above: float) -> float:
    middle = (border + above) / 2
    return middle if border < middle else above


def threshold_between(good: list[float], bad: list[float]) -> float:
    """The lowest threshold that keeps at most BAD_KEPT of the bad scores, but drops at most GOOD_DROPPED of the good ones.

    It lies midway between the scores on either side of it.
    """
    if not good or not bad:
        return THRESHOLD
    good, bad = sorted(good), sorted(bad)
    border = bad[-1 - len(bad) * BAD_KEPT // 1000]  # the highest bad score that must go
    first = good[len(good) * GOOD_DROPPED // 1000]  # the lowest good score that must stay
    if border >= first:
        border, above = max((x for x in good + bad if x < first), default=first), first
    else:
        above = min(x for x in good + bad if x > border)
    return _middle(border, above)


def _at_rank(scores: DataFrame, rank: int, steps: int = 4096) -> float:
    """The exact score at a place (from 0) in ascending order: counts of equal steps of value, then of the steps inside
    the one that holds the place, until it holds one value. A row a step comes to the driver, whatever the number of scores."""
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    while lo < hi:
        inside = scores.filter(F.col("score").between(lo, hi))
        step = F.least(F.floor((F.col("score") - lo) / (hi - lo) * steps), F.lit(steps - 1))
        for r in sorted(inside.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()):
            if rank < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            rank -= r["n"]
    return lo


def derived_threshold(scores: DataFrame, labels: DataFrame) -> float:
    """``threshold_between`` of the scores (doc_id, score, base_failed) of all labelled documents, without holding them."""
    rows = (scores.filter("not base_failed").join(_by_size(_labelled(labels)), F.col("doc_id") == F.col("__labelled"))
            .groupBy("__labelled", "__good").agg(F.when(F.col("__good"), F.min("score")).otherwise(F.max("score")).alias("score")))
    rows = kept(rows.select("__good", "score"), "labelled-scores")
    good, bad = rows.filter("__good"), rows.filter("not __good")
    n_good, n_bad = good.count(), bad.count()
    if not n_good or not n_bad:
        return THRESHOLD
    border = _at_rank(bad, n_bad - 1 - n_bad * BAD_KEPT // 1000)  # the highest bad score that must go
    first = _at_rank(good, n_good * GOOD_DROPPED // 1000)  # the lowest good score that must stay
    if border >= first:
        below = rows.filter(F.col("score") < first).agg(F.max("score")).first()[0]
        return _middle(first if below is None else below, first)
    return _middle(border, rows.filter(F.col("score") > border).agg(F.min("score")).first()[0])


OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """doc_id with the counts, base_failed, kept and the score of every document, which are worked out once and stored."""
    rows = kept(_scored(docs, log_ratios(docs, labels, buckets), F.col("doc_id"))
                .select("doc_id", *[c for c in OUT if c != "kept"]), "quality-scores")
    threshold = derived_threshold(rows, labels) if threshold is None else threshold
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select("doc_id", *OUT)


def passing(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that are kept."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = kept(_scored(docs, log_ratios(docs, labels, buckets), whole).select("__row", "base_failed", "score"), "quality-scores")
    if threshold is None:
        threshold = derived_threshold(rows.select("__row.doc_id", "score", "base_failed"), labels)
    return (rows.filter(~F.col("base_failed") & (F.col("score") >= threshold))
            .select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))
