"""Near-duplicate join of documents by the Jaccard similarity of word shingles, exact.

1. A document's set: 64-bit hashes of its distinct shingles. Documents of equal sets
   form one class (a 128-bit digest of the set); the rest works on classes, so
   copies cost nothing but their row.
2. Token orders. A token is a shingle's hash, cut to its upper 40 bits where only
   candidates are at stake. Similar sets are of similar size, so small sets (up to
   ``SMALL`` tokens over the threshold) and large ones (from ``SMALL`` on) have tokens of
   their own; a set between counts as both. Of small sets all tokens are visible, of
   large ones those below a fixed share of the hash range. The frequency of visible
   tokens over all documents is counted exactly (each block of documents sends each
   of its distinct visible tokens once, to a bucket, and gets those back that other
   sets have too). Three global orders put rare
   tokens first: by (frequency, token), and twice by the frequency's power of two and
   a hash of the token; tokens that aren't visible follow, by value.
3. Two sets of similarity t share a token of their prefixes, the first
   ``n - ceil(t n) + 1`` tokens, in each order. A token of one set alone makes no
   candidate, so most documents end here. Candidates share a token of the first
   order's prefixes and of the second's and the third's; these pairs are verified by
   the whole sets. A set of n tokens has at most ``s`` in common with any other, s being
   n less its tokens of frequency 1: that bounds the similarity of a pair by (n, s).
   Where pairs are made, so do ``PARITY`` bits of each set, the parity of its tokens by
   hash: every bit that differs stands for a token that only one of the two has.
4. A token's documents are not all paired. First those go that by the bound, for each
   (n, s) that occurs under the token, have no possible partner outside their
   component. The rest is held against a pivot, the set with the fewest tokens of its
   own (the middle of a group of near copies), and components are joined by the links
   found. After ``PIVOT_ROUNDS`` rounds all pairs of different components that are left
   are verified, each made once, under its first common token. No link between
   different components is lost by this.

Tables between the steps lie in the shared folder; nothing but counts comes to the
driver.

Cases: a document without words or text, or null, has an empty set and is its own
component; one with fewer words than a shingle has its whole sequence as one;
rows that share a doc_id are rows of their own; a null doc_id takes part but never
names a component that has another; repeated rows are links of similarity 1;
further columns are ignored; an empty table gives an empty table; whole texts count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, kept, offsets_of, prepare, text_or_empty
from .components import stars

SHINGLE, PERCENT = 5, 80
BLOCK_TOKENS = 2_000_000
BATCH = 1000
#: A token: 39 bits of the hash, and above them one for tokens of small sets.
KEY_BITS, HASH_BITS = 40, 39
SMALL = 200
#: Visible share of the token range, as a multiple of the share of a prefix.
VISIBLE = 1.75
#: Parity bits of a set, in words of 64.
PARITY = 512
#: Rounds against pivots before the pairs that are left are all verified.
PIVOT_ROUNDS = 1

BLOCKS = "block long, doc_ids array<bigint>, sizes array<int>, sigs array<binary>, small_lens array<int>, large_lens array<int>, keys binary"
BUCKETS = "block long, bucket int, keys binary, counts binary"
ANSWERS = "block long, bucket int, keys binary, df binary"
PREFIXES = "sig binary, n int, s int, p1 array<bigint>, p2 array<bigint>, p3 array<bigint>"

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of all texts, and where each text's begin."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    big = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(big.buffers()[1], dtype=np.int64)[big.offset:big.offset + len(big) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = np.frombuffer(big.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.flatnonzero(begins[at])  # among the bytes of words
    lens = np.diff(np.append(first, len(at)))
    power = _powers(int(lens.max()))
    place = np.arange(len(at)) - np.repeat(first, lens)
    words = np.add.reduceat(_BYTE[data[at]] * power[place], first)
    words = _mixed(words + lens.astype(np.uint64))
    return words, np.searchsorted(at[first], offsets)


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    words, starts = word_hashes(texts)
    weights = _PLACE[np.arange(shingle) % len(_PLACE)] * _powers(shingle)
    whole = np.zeros(max(len(words) - shingle + 1, 0), dtype=np.uint64)
    for k in range(shingle):
        whole += words[k:k + len(whole)] * weights[k]
    whole = _mixed(whole)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(whole[a:b - shingle + 1]))
        elif b > a:
            out.append(_mixed((words[a:b] * weights[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def prefix_length(n: np.ndarray | int, percent: int):
    """Tokens of a set of n of which one at least is shared with any set of that similarity."""
    return n - -(-percent * n // 100) + 1


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    five = np.frombuffer(data, dtype=np.uint8).reshape(-1, KEY_BITS // 8)
    return np.pad(five, [(0, 0), (0, 8 - KEY_BITS // 8)]).view("<u8").reshape(-1)


def _visible_keys(percent: int) -> int:
    return int(min(1.0, VISIBLE * (1 - percent / 100)) * (1 << HASH_BITS))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else b""


def _tokens_of(hashes: np.ndarray, percent: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's tokens as a small set and as a large one, ascending; empty where it is not of that kind."""
    n = len(hashes)
    short = hashes >> np.uint64(64 - HASH_BITS)
    none = short[:0]
    small = short | np.uint64(1 << HASH_BITS) if n * percent <= SMALL * 100 else none
    large = short[:max(int(np.searchsorted(short, limit)), prefix_length(n, percent))] if n >= SMALL else none
    return small, large


def set_blocks(docs: DataFrame, shingle: int, percent: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each block of documents with their sizes, digests and tokens (the latter once for each set of the block)."""
    limit = _visible_keys(percent)
    names = [f.strip().split(" ")[0] for f in BLOCKS.split(",")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.binary()]

    def build(batches):
        block = TaskContext.get().partitionId() << 32
        none = np.zeros(0, np.uint64)
        doc_ids, sizes, sigs, small, large, seen, held = [], [], [], [], [], set(), 0

        def row():
            flat = np.concatenate([x for pair in zip(small, large, strict=True) for x in pair])
            values = [block, doc_ids, sizes, sigs, list(map(len, small)), list(map(len, large)), _pack(flat)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                for doc_id, hashes in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), shingle), strict=True):
                    sig, new = _digest(hashes), (none, none)
                    if sig and sig not in seen:
                        seen.add(sig)
                        new = _tokens_of(hashes, percent, limit)
                    doc_ids.append(doc_id)
                    sizes.append(len(hashes))
                    sigs.append(sig)
                    small.append(new[0])
                    large.append(new[1])
                    held += len(hashes)
                if held >= block_tokens:
                    yield row()
                    block += 1
                    doc_ids, sizes, sigs, small, large, seen, held = [], [], [], [], [], set(), 0
        if doc_ids:
            yield row()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
            .mapInArrow(build, BLOCKS))


def _hidden(keys: np.ndarray, limit: int) -> np.ndarray:
    return (keys >= np.uint64(limit)) & (keys < np.uint64(1 << HASH_BITS))


def block_buckets(blocks: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """For each block and bucket its distinct visible tokens, and in how many of its sets they are."""
    limit = _visible_keys(percent)

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = _unpack(row["keys"])
                keys, times = np.unique(keys[~_hidden(keys, limit)], return_counts=True)
                bucket = (_mixed(keys) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                mine = [order[cuts[b]:cuts[b + 1]] for b in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(full), pa.int64()), pa.array(full, pa.int32()),
                     pa.array([_pack(keys[m]) for m in mine], pa.binary()),
                     pa.array([times[m].astype("<u4").tobytes() for m in mine], pa.binary())],
                    ["block", "bucket", "keys", "counts"])

    return blocks.select("block", "keys").mapInArrow(deal, BUCKETS)


def shared_tokens(buckets: DataFrame) -> DataFrame:
    """For each block and bucket the tokens that are in two sets or more over all blocks, and in how many."""
    def count(table: pa.Table) -> pa.Table:
        keys = [_unpack(x.as_py()) for x in table.column("keys")]
        times = np.concatenate([np.frombuffer(x.as_py(), dtype="<u4") for x in table.column("counts")])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(place, weights=times).astype(np.int64)[place]
        ends = offsets_of(np.array([len(k) for k in keys], dtype=np.int64))
        out_keys, out_df = [], []
        for own, a, b in zip(keys, ends[:-1], ends[1:], strict=True):
            shared = df[a:b] > 1
            out_keys.append(_pack(own[shared]))
            out_df.append(np.minimum(df[a:b][shared], (1 << 32) - 1).astype("<u4").tobytes())
        return pa.table([table.column("block"), table.column("bucket"), pa.array(out_keys, pa.binary()),
                         pa.array(out_df, pa.binary())], names=["block", "bucket", "keys", "df"])

    return buckets.groupBy("bucket").applyInArrow(count, ANSWERS)


def _prefix_tokens(keys: np.ndarray, df: np.ndarray, hidden: np.ndarray, length: int) -> list[list[int]]:
    """The distinct tokens of the prefix in each order that more than this set may have."""
    level = np.where(hidden, 0, df)
    power = np.where(hidden, 0, np.frexp(df)[1])
    out = []
    for first, second in ((keys, level), (_mixed(keys + np.uint64(1)), power), (_mixed(keys + np.uint64(2)), power)):
        order = np.lexsort((np.where(hidden, keys, first), second, hidden))[:length]
        out.append(np.unique(keys[order[(df[order] > 1) | hidden[order]]]).tolist())
    return out


def prefixes(texts: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """(sig, n, s, p1, p2, p3): sizes, most tokens in common with any other, and the tokens of each set's prefixes in the three orders that another set may have too."""
    limit = _visible_keys(percent)
    found = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", F.col("keys").alias("k"), "df"))).alias("found"))

    def cut(batches):
        for batch in batches:
            for row_at in range(batch.num_rows):
                row = batch.slice(row_at, 1).to_pylist()[0]
                got = row["found"] or []
                tokens = np.concatenate([_unpack(x["k"]) for x in got]) if got else np.zeros(0, np.uint64)
                times = np.concatenate([np.frombuffer(x["df"], "<u4") for x in got]) if got else np.zeros(0, np.uint32)
                by_token = np.argsort(tokens)
                tokens, times = tokens[by_token], times[by_token]
                flat = _unpack(row["keys"])
                df = np.ones(len(flat), dtype=np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
                    hit = tokens[at] == flat
                    df[hit] = times[at[hit]]
                hidden = _hidden(flat, limit)
                end, out = 0, []
                for sig, n, *lens in zip(row["sigs"], row["sizes"], row["small_lens"], row["large_lens"], strict=True):
                    found_in, alone = [[], [], []], n
                    for length in filter(None, lens):
                        own = slice(end, end + length)
                        end += length
                        alone = min(alone, int(((df[own] == 1) & ~hidden[own]).sum()))
                        for have, new in zip(found_in, _prefix_tokens(flat[own], df[own], hidden[own], prefix_length(n, percent)), strict=True):
                            have += new
                    # a set of both kinds may share with large sets what no small one has
                    out.append((sig, n, n - alone, *found_in))
                out = [x for x in out if x[3] and x[4] and x[5]]
                if out:
                    kinds = [pa.binary(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                     ["sig", "n", "s", "p1", "p2", "p3"])

    return texts.join(found, "block", "left").mapInArrow(cut, PREFIXES)


def parity_words(sets: list[np.ndarray]) -> np.ndarray:
    """Each set's parity bits as a row of 64-bit words: bit k is set if an odd number of its tokens fall to k."""
    lens = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = np.repeat(np.arange(len(sets)), lens) * PARITY + (flat % np.uint64(PARITY)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * PARITY) & 1).astype(np.uint8).reshape(len(sets), PARITY)
    return np.packbits(odd, axis=1).view("<i8")


def candidate_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(sig, tokens binary, bits): the whole sets of the wanted classes (sig, rep), read from one document of each."""
    def build(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                sets = shingle_sets(batch.slice(at, BATCH).column("text"), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()),
                                                  pa.array([x.tobytes() for x in sets], pa.binary()),
                                                  pa.array(list(parity_words(sets)), pa.list_(pa.int64()))], ["sig", "tokens", "bits"])

    reps = wanted.select(F.col("rep")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    sets = rows.join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text").mapInArrow(build, "sig binary, tokens binary, bits array<bigint>")
    return sets.join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a token of the second and third prefixes and whose sets have the similarity asked for.

    Pairs (a, b, w: tokens of both) are dealt into blocks by a bucket of each side, so that the pairs of one group of texts
    share blocks, and a block is split until its pairs hold about ``BLOCK_TOKENS`` tokens. A set goes to each block
    that needs it once, however many of the block's pairs it is in. In a block the filters of the
    three orders are intersected on the prefixes before sets are compared.
    """
    pairs = kept(pairs, "pairs")
    weight = pairs.agg(F.sum("w")).first()[0] or 0
    side = max(1, round((weight / BLOCK_TOKENS) ** 0.5))

    def bucket(c: str):
        return F.pmod(F.xxhash64(c), F.lit(side))

    grid = pairs.withColumn("i", bucket("a")).withColumn("j", bucket("b"))
    parts = grid.groupBy("i", "j").agg(F.ceil(F.sum("w") / BLOCK_TOKENS).alias("parts"))  # at most side * side rows
    dealt = grid.join(parts, ["i", "j"]).select(
        "a", "b", F.struct("i", "j", F.pmod(F.xxhash64("a", "b"), F.col("parts")).alias("k")).alias("block"))
    needed = dealt.select(F.col("block").alias("to"), F.explode(F.array("a", "b")).alias("sig")).distinct()
    found = needed.join(sets.select("sig", "tokens", "p2", "p3"), "sig")

    def check(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        place = {x: k for k, x in enumerate(sets.column("sig").to_pylist())}
        tokens, p2, p3 = (sets.column(c).combine_chunks() for c in ("tokens", "p2", "p3"))
        tokens = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in tokens]
        p2, p3 = ([set(x) for x in c.to_pylist()] for c in (p2, p3))
        keep = []
        for row, (a, b) in enumerate(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)):
            k, m = place[a], place[b]
            if p2[k].isdisjoint(p2[m]) or p3[k].isdisjoint(p3[m]):
                continue
            x, y = tokens[k], tokens[m]
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = int((x[at] == y).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(row)
        return pairs.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return dealt.groupBy("block").cogroup(found.groupBy("to")).applyInArrow(check, "a binary, b binary")


def _possible(n, s, m, t, percent: int):
    """Whether sets of n and m tokens, with at most s and t in common with others, can be similar enough."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(s, t) * (100 + percent) >= (n + m) * percent)


def _near(percent: int):
    """Whether the tokens that the parity bits of a row and of ``x`` show to be in one of them alone leave enough in common."""
    apart = F.lit(0)
    for k in range(PARITY // 64):
        apart = apart + F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("x.bits", F.lit(k))))
    both = F.col("n").cast("long") + F.col("x.n")
    return (both - apart) * (100 + percent) >= both * (2 * percent)


def _open(postings: DataFrame, percent: int) -> DataFrame:
    """The postings (token, sig, n, s, c) that may have a partner in another component c."""
    # of each size the most that any set has in common with others: no partner is missed, some postings more stay
    kinds = postings.groupBy("token", "n").agg(F.max("s").alias("s"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    kinds = kinds.groupBy("token").agg(F.collect_list(F.struct("n", "s", "c0", "c1")).alias("kinds"))  # sizes, not sets
    partner = F.exists("kinds", lambda k: _possible(F.col("n"), F.col("s"), k["n"], k["s"], percent)
                       & ((k["c0"] != F.col("c")) | (k["c1"] != F.col("c"))))
    return postings.join(kinds, "token").filter(partner).select("token", "sig", "n", "s", "c")


def _pairs(left: DataFrame, right: DataFrame, percent: int, *conditions) -> DataFrame:
    """Pairs (a, b, w: tokens of both) under a token, of different components, that the sizes allow. ``right``: token t and struct x."""
    fits = ((F.col("token") == F.col("t")) & (F.col("c") != F.col("x.c"))
            & _possible(F.col("n"), F.col("s"), F.col("x.n"), F.col("x.s"), percent))
    for more in conditions:
        fits &= more
    return left.join(right, fits).select(F.least("sig", "x.sig").alias("a"), F.greatest("sig", "x.sig").alias("b"),
                                         (F.col("n") + F.col("x.n")).cast("long").alias("w")).distinct()


def class_links(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): each linked class but the smallest of its component, with that smallest one.

    ``postings`` (token, sig, n, s): the first order's prefixes. ``sets`` (sig, tokens, bits, p1, p2, p3).
    """
    links, now, bits = None, postings.withColumn("c", F.col("sig")), sets.select("sig", "bits")
    for _ in range(PIVOT_ROUNDS):
        now = kept(_open(now, percent), "open")
        pivots = now.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "sig", "n", "s", "c")).alias("x"))
        held = pivots.select(F.col("token").alias("t"), "x.*").join(bits, "sig").select("t", F.struct("sig", "n", "s", "c", "bits").alias("x"))
        pairs = _pairs(now.join(bits, "sig"), held, percent, _near(percent))
        found = verified(pairs, sets, percent)
        links = stars(found if links is None else found.unionByName(links))
        now = (now.join(pivots.select("token", F.col("x.sig").alias("pivot")), "token").filter(F.col("sig") != F.col("pivot"))
               .select("token", "sig", "n", "s").join(links.withColumnRenamed("a", "sig"), "sig", "left")
               .select("token", "sig", "n", "s", F.coalesce("b", "sig").alias("c")))
    now = kept(_open(now, percent), "open")
    # a pair of different components has one side at least outside the token's largest component
    largest = (now.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("token")
               .agg(F.max_by("c", F.struct("k", "c")).alias("largest")))
    full = now.join(sets.select("sig", "p1", "bits"), "sig")
    others = (full.join(largest, "token").filter(F.col("c") != F.col("largest"))
              .select(F.col("token").alias("t"), F.struct("sig", "n", "s", "c", "p1", "bits").alias("x")))
    first = F.array_min(F.array_intersect("p1", "x.p1")) == F.col("token")
    return stars(verified(_pairs(full, others, percent, _near(percent), first), sets, percent).unionByName(links))


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class_sig, root_sig (the component) of every document."""
    spark = docs.sparkSession
    prepare(spark)
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = kept(set_blocks(docs, shingle, percent, block_tokens), "sets")
    texts = blocks.select("block", "sizes", "sigs", "small_lens", "large_lens", "keys")
    answers = shared_tokens(block_buckets(blocks, percent, n_buckets))
    found = kept(prefixes(texts, answers, percent).dropDuplicates(["sig"]), "prefixes")

    members = (blocks.select(F.explode(F.arrays_zip("doc_ids", "sizes", "sigs")).alias("m"))
               .select(F.col("m.doc_ids").alias("doc_id"), F.col("m.sizes").cast("long").alias("n_shingles"), F.col("m.sigs").alias("sig")))
    reps = members.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"))

    postings = found.select("sig", "n", "s", F.explode("p1").alias("token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token")
    postings = kept(postings.join(shared, "token").select("token", "sig", "n", "s"), "postings")
    wanted = kept(postings.select("sig").distinct().join(reps, "sig"), "wanted")
    sets = candidate_sets(docs, wanted, shingle).join(found.select("sig", "p1", "p2", "p3"), "sig")
    links = class_links(postings, kept(sets, "whole-sets"), percent)

    # the smallest doc_id of each component: of the class for most, of all linked classes for the others
    roots = reps.join(links.select(F.col("a").alias("sig"), F.col("b").alias("root")), "sig", "left").select(
        "sig", "rep", F.coalesce("root", "sig").alias("root"))  # a class without links is its own root
    lowest = (roots.join(links.select(F.col("b").alias("root")).distinct(), "root", "left_semi")
              .groupBy("root").agg(F.min("rep").alias("low")))
    named = roots.join(lowest, "root", "left").select("sig", "root", F.coalesce("low", "rep").alias("component"))
    return members.join(named, "sig", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("sig").alias("class_sig"), F.col("root").alias("root_sig"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, of one document for each component: the smallest doc_id (nulls last), set digest and text.

    Components are told apart by their root, so repeated and null ids neither keep nor cost a row too many.
    Documents without words all stay, but for repeated rows.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("class_sig").alias("sig"))
    first = (components(docs, shingle, percent).filter("n_shingles > 0").groupBy("root_sig").agg(F.min(order).alias("w"))
             .select(F.col("w.doc_id").alias("first_id"), F.col("w.sig").alias("sig")))

    def digest(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sigs = [_digest(x) for x in shingle_sets(part.column("text"), shingle)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(sigs, pa.binary())], ["row", "id", "sig"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       text_or_empty().cast("string").alias("text"))
    blank = F.btrim("text", F.lit(SPACE_CHARS)) == ""
    out = T.StructType([*(rows.schema[c] for c in ("row", "id")), T.StructField("sig", T.BinaryType())])
    found = rows.filter(~blank).mapInArrow(digest, out)
    # rows go through one shuffle, which serves the join and the grouping, and their text goes once, in the row
    keys = ["no_id", "some_id", "sig"]

    def keyed(df, c: str):
        return df.withColumn("no_id", F.col(c).isNull()).withColumn("some_id", F.coalesce(c, F.lit(0).cast("long")))

    with_words = keyed(found, "id").join(keyed(first, "first_id").select(*keys), keys, "left_semi")
    text = F.coalesce(F.col("row").getField("text").cast("string"), F.lit(""))
    each = with_words.groupBy(*keys).agg(F.min_by("row", text).alias("row")).select("row")
    without = rows.filter(blank).groupBy("id", "text").agg(F.min_by("row", "text").alias("row")).select("row")
    return each.unionByName(without).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
