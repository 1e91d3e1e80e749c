"""Language identification as inference of a mixture of languages.

Each language is a multinomial over hashed byte trigrams of lower-cased letters
(everything else is one separator), learned from labelled texts. A document is a
mixture: expectation-maximisation finds the share of each language that makes its
trigrams most likely. The set of languages is chosen by penalised likelihood: of
the sets of the 1, 2, ... ``max_set`` languages with the largest shares, each
fitted anew, the one with the greatest log-likelihood less ``penalty`` x log(n) for
each language. The prediction is the largest share of that set.

The models are learned from up to about ``rows_per_language`` texts of each language
(by a hash of doc_id; a stated bound for the training sample). Every document is
judged by its whole text, in parts of ``part_bytes`` bytes summed up per iteration.

Cases: a null text, or one without a letter, is ``und`` with score 0, as is every
text if nothing could be learned; equal shares go to the language that sorts
first; repeated rows are kept; further columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

BUCKETS = 1 << 15
ROWS_PER_LANGUAGE = 5000
SMOOTHING = 0.1
PENALTY = 12.0
ROUNDS = 8
BATCH = 256
UNKNOWN = "und"
GUESS = "doc_id long, lang_pred string, score double, langs string"

#: a-z and bytes from 0x80 on stay, the rest is one separator.
_LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def trigram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of lower-cased texts, and where each text's begin (the total last)."""
    low = pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")).cast(pa.large_binary())
    low = low.combine_chunks() if isinstance(low, pa.ChunkedArray) else low
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset:low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if low.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    x = _LETTERS[data]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    use = (x[1:-1] != 32) | (x[:-2] != 32) & (x[2:] != 32)
    for end in offsets[1:-1]:
        use[max(0, end - 2):end] = False  # these reach into the next text
    at = np.concatenate([[0], np.cumsum(use)])
    starts = at[np.minimum(offsets, len(use))]
    mixed = code[use] * np.uint32(2654435761)
    return (mixed >> np.uint32(17)).astype(np.int64), starts


def held_out(doc_id: Column) -> Column:
    """Documents whose CRC-32 of the id's text leaves 2 by 4: never learned from (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed trigram probabilities (languages x buckets)."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not rows:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    wanted = F.create_map(*[F.lit(x) for lang, n in sorted(rows.items()) for x in (lang, min(1.0, rows_per_language / n))])
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = labelled.filter(share < wanted[F.col("lang")]).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            buckets, starts = trigram_buckets(batch.column("text"))
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                got = np.bincount(buckets[starts[k]:starts[k + 1]], minlength=BUCKETS)
                total[lang] = total[lang] + got if lang in total else got
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    counts = (sample.mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())  # at most languages x buckets
    langs = sorted(rows)
    model = np.full((len(langs), BUCKETS), SMOOTHING)
    place = {x: k for k, x in enumerate(langs)}
    row = np.array([place[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    model[row, counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    return langs, (model / model.sum(axis=1, keepdims=True)).astype(np.float32)


def _fit(p: np.ndarray, times: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of p) after some rounds of EM over buckets that come ``times`` often, and their log-likelihood."""
    for _ in range(rounds):
        share = share * (p @ (times / (share @ p)))
        share = share / share.sum()
    return share, float(np.log(share @ p) @ times)


def infer(buckets: np.ndarray, model: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Languages (numbers, largest share first) and shares of one document with at least one trigram.

    The set grows, by share, as long as the penalised likelihood rises.
    """
    used, times = np.unique(buckets, return_counts=True)
    p, times = model[:, used], times.astype(np.float64)
    share, _ = _fit(p, times, np.full(len(model), 1 / len(model)), rounds)
    order = np.argsort(-share, kind="stable")
    best = None
    for size in range(1, len(model) + 1):
        chosen = order[:size]
        start = share[chosen] + 1e-6
        fitted, loglik = _fit(p[chosen], times, start / start.sum(), rounds // 2 if size > 1 else 0)
        value = loglik - penalty * size * np.log(len(buckets) + 1)
        if best is not None and value <= best[0]:
            break
        best = (value, chosen, fitted)
    by_share = np.argsort(-best[2], kind="stable")
    return best[1][by_share], best[2][by_share]


def _guesses(texts: pa.ChunkedArray | pa.Array, langs: list[str], model: np.ndarray) -> list[tuple[str, float, str]]:
    """(language, share, chosen set) of each text."""
    letter = re.compile(r"[^\W\d_]").search
    buckets, starts = trigram_buckets(texts)
    out = []
    for k, text in enumerate(texts.to_pylist()):
        own = buckets[starts[k]:starts[k + 1]]
        if not langs or not text or not letter(text):
            out.append((UNKNOWN, 0.0, ""))
        elif not len(own):
            out.append((langs[0], 1 / len(langs), langs[0]))  # too short for a trigram: all equally likely
        else:
            chosen, shares = infer(own, model)
            out.append((langs[chosen[0]], float(min(1.0, max(0.0, shares[0]))), ",".join(langs[c] for c in chosen)))
    return out


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the language's share), langs (the chosen set, largest share first) from doc_id and text alone."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets

    def guess(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out = _guesses(part.column("text"), langs, sent.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x[0] for x in out], pa.string()),
                     pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.string())],
                    ["doc_id", "lang_pred", "score", "langs"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(guess, GUESS))


def identified(docs: DataFrame, min_share: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is known and has at least that share of the text."""
    prepare(docs.sparkSession)
    langs, model = learn(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out = _guesses(part.column(text_at), langs, sent.value)
                yield part.filter(pa.array([lang != UNKNOWN and share >= min_share for lang, share, _ in out]))

    return docs.mapInArrow(keep, docs.schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out, judge all: doc_id, held_out, lang_pred, score, langs."""
    prepare(docs.sparkSession)
    langs, model = learn(docs)
    return identify(docs, langs, model).withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score", "langs")
