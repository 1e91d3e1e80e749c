"""Periodic runs of words: every stretch that goes on repeating its first words, found by multi-scale minimizers.

A run is a stretch of consecutive words whose smallest period is q (words q apart
are the same), of at least ``max(least_words, least_times * q)`` words, which no
neighbouring word extends with that period. ``periodic_runs`` returns all runs of every text
and the text with each run collapsed to its first period.

Method, for each text:

* Periods up to ``DIRECT`` are too short for windows: the words are compared with
  those q places on, and long enough stretches of equal places are runs.
* A scale w = 16, 32, 64, ... serves the periods from w / 2 + 1 to w. Every place has
  a hash of its next w words (built from two of the scale before). Places whose hash
  is the smallest of some window of w / 2 places are the scale's minimizers. Inside a run of
  four periods a window and the one a period later see the same hashes, so their
  minimizers lie exactly q apart, and as a window of q words or more occurs once a
  period, they follow one another among the minimizers of that hash. So each pair of
  neighbours of one hash, between w / 2 and w apart, seeds an extension.
* A seed is compared word by word to both sides, in steps that double; a stretch
  that is long enough is a run unless a part of its period is a period as well (that
  run has seeds of its own). Seeds inside a run already found are skipped.

All compares are of word numbers, so nothing that isn't a run gets through; a collision
of 64-bit hashes could at most hide a seed. A text's scales end at a quarter of
its words; the work is a few passes over the words for each scale.

Cases: a null or empty text has no words and no runs, and collapses to an empty
text; texts are taken whole, each in one task; repeated rows and doc_ids, also null
ones, are kept, each with its own runs; further columns are ignored, whatever
their names; runs may overlap and are ordered by start, then period; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import offsets_of, prepare, text_or_empty, words_of

LEAST_WORDS, LEAST_TIMES = 6, 4
DIRECT = 8
#: Bytes of text worked on together, one longer text at a time.
PART_BYTES = 4_000_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _stretch(x: np.ndarray, p: int, d: int) -> tuple[int, int]:
    """The largest [a, b) around p with x[i] == x[i + d] for every i in it, empty if they differ at p."""
    last = len(x) - d
    b, step = p, 64
    while b < last:
        differ = np.flatnonzero(x[b:min(b + step, last)] != x[b + d:min(b + step, last) + d])
        if len(differ):
            b += int(differ[0])
            break
        b, step = min(b + step, last), step * 2
    a, step = p, 64
    while a > 0 and b > p:
        low = max(a - step, 0)
        differ = np.flatnonzero(x[low:a] != x[low + d:a + d])
        if len(differ):
            a = low + int(differ[-1]) + 1
            break
        a, step = low, step * 2
    return a, b


def _prime_factors(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return out + [n] * (n > 1)


def _direct(x: np.ndarray, q: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, q) of the stretches of period q, by one compare with the words q places on."""
    same = np.zeros(len(x) - q + 2, dtype=np.int8)
    same[1:-1] = x[:-q] == x[q:]
    turns = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = turns[0::2], turns[1::2]
    long = ends - starts + q >= least
    return [(int(a), int(b - a + q), q) for a, b in zip(starts[long], ends[long], strict=True)]


def _neighbours(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of minimizers whose next one of the same hash lies more than w / 2 and at most w places on, and how far."""
    window = w // 2
    low, span = h, 1
    while span < window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    pad = np.zeros(window - 1, dtype=h.dtype)
    high, span = np.concatenate([pad, low, pad]), 1
    while span < window:
        high = np.maximum(high[:-span], high[span:])
        span *= 2
    at = np.flatnonzero(high == h)  # the smallest of a window that holds it
    order = np.argsort(h[at], kind="stable")
    at, value = at[order], h[at[order]]
    far = at[1:] - at[:-1]
    pair = (value[1:] == value[:-1]) & (far > window) & (far <= w)
    return at[:-1][pair], far[pair]


def _seeds(x: np.ndarray, lens: np.ndarray, least_times: int):
    """(places, distances) of the seeds of each scale. x: all texts' words, each text closed by a number of its own."""
    with np.errstate(over="ignore"):
        h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        place, of_text, w = np.arange(len(x)), lens + 1, 1
        while len(h) > w:
            h = h[:len(h) - w] * np.uint64(0xD6E8FEB86659FD93) + h[w:]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x2545F4914F6CDD1D)
            h ^= h >> np.uint64(30)
            w *= 2
            if w <= DIRECT:
                continue
            # texts too short for this scale's periods go
            fits = of_text > least_times * (w // 2 + 1)
            rows = np.repeat(fits, of_text)
            h, place, of_text = h[rows[:len(h)]], place[rows], of_text[fits]
            if len(h) < w:
                return
            at, far = _neighbours(h, w)
            yield place[at], far


def runs_of(x: np.ndarray, lens: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period; starts count in x (see ``_seeds``)."""
    found: list[tuple[int, int, int]] = []
    for q in range(1, min(DIRECT, len(x) - 1) + 1):
        found += _direct(x, q, max(least_words, least_times * q))
    shortest: dict[tuple[int, int], int] = {}
    for start, length, q in found:  # in ascending order of q: a stretch's smallest period comes first
        shortest.setdefault((start, length), q)
    for places, distances in _seeds(x, lens, least_times):
        order = np.lexsort((places, distances))
        places, distances = places[order], distances[order]
        k = 0
        while k < len(places):
            p, d = int(places[k]), int(distances[k])
            a, b = _stretch(x, p, d)
            length = b - a + d
            if b > a and length >= max(least_words, least_times * d):
                parts = (d // r for r in _prime_factors(d))
                if not any(np.array_equal(x[a:a + length - c], x[a + c:a + length]) for c in parts):
                    shortest[a, length] = d
            k += 1
            if b > p:  # go on behind this stretch
                same_d = int(np.searchsorted(distances, d, side="right"))
                k = max(k, k + int(np.searchsorted(places[k:same_d], b)))
    return sorted((start, length, q) for (start, length), q in shortest.items())


def _collapse(texts: pa.Array, least_words: int, least_times: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Numbers of words, runs and collapsed texts of an Arrow array of texts."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # outer white space leaves empty ends
    offsets = parts.offsets.to_numpy().astype(np.int64)
    before = offsets_of(real)
    starts = before[offsets - offsets[0]]
    words = words.filter(pa.array(real))
    lens = np.diff(starts)
    coded = words.dictionary_encode()
    x = np.empty(len(words) + len(lens), dtype=np.int64)
    own = np.ones(len(x), dtype=bool)
    closers = starts[1:] + np.arange(len(lens))
    own[closers] = False
    x[own] = coded.indices.to_numpy()
    x[closers] = -1 - np.arange(len(lens))
    runs = runs_of(x, lens, least_words, least_times)
    kept = np.ones(len(words), dtype=bool)
    first = starts[:-1] + np.arange(len(lens))
    start, length, period = np.array(runs, dtype=np.int64).reshape(-1, 3).T
    text = np.searchsorted(first, start, side="right") - 1
    for a, n, q, k in zip(start.tolist(), length.tolist(), period.tolist(), text.tolist(), strict=True):
        kept[a - k + q:a - k + n] = False  # a text's words lie k places further left without the closers
    ends = offsets_of(kept)
    left = pa.ListArray.from_arrays(pa.array(ends[starts], pa.int32()), words.filter(pa.array(kept)))
    of_text = np.searchsorted(text, np.arange(len(lens) + 1))
    rows = pa.StructArray.from_arrays([pa.array(start - first[text] if len(text) else start), pa.array(length), pa.array(period)],
                                      fields=list(RUN))
    return lens, pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), rows), pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed: every row of ``docs`` (doc_id, text)."""
    if least_times < 4:
        raise ValueError("the scales find runs of four periods or more")
    prepare(docs.sparkSession)

    def find(batches):
        for batch in batches:
            size = offsets_of(pc.binary_length(batch.column("text")).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + PART_BYTES, side="right")) - 1)
                part = batch.slice(at, to - at)
                n_words, runs, collapsed = _collapse(part.column("text"), least_words, least_times)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), runs, collapsed],
                                                 ["doc_id", "n_words", "runs", "collapsed"])
                at = to

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    return rows.mapInArrow(find, FOUND)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, exactly; of equals the first. Null without runs."""
    return F.reduce(F.slice(runs, 2, F.size(runs)), F.get(runs, F.lit(0)),
                    lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, by a hash of the id, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", text_or_empty().cast("string").alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = words_of(F.col("text"))
    n = F.size(words)
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    again = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, 1, a.cast("int")), again), 1, n), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, digests of all runs and of the collapsed text."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
                       "n_words")
