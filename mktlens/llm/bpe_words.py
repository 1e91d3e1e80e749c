"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. ``word_positions``: every text is split by the pattern of the vocabulary. In a
   block of documents (about ``block_pieces`` pieces) each distinct piece, a word,
   gets a number, and a text becomes its pieces' numbers in order of position. A task holds
   one block and nothing of those before it.
2. The blocks' distinct words are shuffled by a hash of the word, so that all
   copies of a word over the whole corpus meet in one task, where it is encoded once
   (``encoded_words``). A block sends each word once, however often it occurs, so no
   word is hot.
3. The ids go back to their blocks, are joined to the positions by block number, and
   each text's ids are put together by position (``encode``).
4. ``decode`` looks the bytes of every id up in the token-byte table and joins them up.

The first table is written to the shared folder, since block numbers must stay the
same for both of its uses when executors are lost. It is bucketed by block, so only words and
ids are shuffled and the positions wait for their ids where they are.

Cases: a null text counts as empty; an empty text has no ids and decodes to no
bytes; repeated rows and doc_ids, also null ones, are kept, each with its own ids;
further columns are ignored; an empty table gives an empty table; a text longer
than ``block_pieces`` makes a block of its own.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import gather, offsets_of, prepare, scratch, text_or_empty

POSITIONS = ("block long, doc_ids array<bigint>, lens array<int>, word_order binary, positions binary,"
             " bucket int, words binary")
WORD_IDS = "block long, bucket int, lens binary, ids binary"
ENCODED = "doc_id long, n_tokens long, ids binary"
#: Pieces of a block, reckoned at so many bytes each.
BLOCK_PIECES, PIECE_BYTES = 1_000_000, 5
BATCH = 1000


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(a.tobytes())


def _unzip(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def _zip_planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte place by byte place: the high places are mostly zero and press well."""
    return _zip(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unzip_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unzip(b, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _pieces(texts: pa.Array, find) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces of all texts, the pieces of all texts by number, and where each text's begin (the total last)."""
    found: list[pa.Array] = []

    def split(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = [find(c) for c in chunks.to_pylist()]
        coded = pa.array([p for pieces in own for p in pieces], pa.large_string()).dictionary_encode()
        found.append(coded.dictionary)
        return coded.indices.to_numpy(), np.fromiter(map(len, own), np.int64, len(own))

    # one call of split for all the texts' distinct chunks; the table goes with the block
    flat, starts = ChunkTable(split, np.uint32).values(texts)
    return found[0] if found else pa.array([], pa.large_string()), flat, starts


def pack_words(words: list[bytes]) -> bytes:
    """Sorted words: how much of the word before each goes on with, the rest's length, the rests."""
    shared = [0] * len(words)
    for k in range(1, len(words)):
        a, b = words[k - 1], words[k]
        n = min(len(a), len(b), 255)
        if a[:n] != b[:n]:
            n = next(i for i in range(n) if a[i] != b[i])
        shared[k] = n
    lens = np.array([len(w) - n for w, n in zip(words, shared, strict=True)], dtype="<u4")
    return zstandard.ZstdCompressor(level=3).compress(
        b"".join([len(words).to_bytes(4, "little"), bytes(shared), lens.view(np.uint8).reshape(-1, 4).T.tobytes(),
                  *[w[n:] for w, n in zip(words, shared, strict=True)]]))


def unpack_words(packed: bytes) -> list[bytes]:
    body = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(body[:4], "little")
    shared = body[4:4 + n]
    lens = np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n, 4 + n).reshape(4, -1).T).view("<u4").reshape(-1)
    at, word, out = 4 + 5 * n, b"", []
    for keep, more in zip(shared, lens.tolist(), strict=True):
        word = word[:keep] + body[at:at + more]
        at += more
        out.append(word)
    return out


def word_positions(docs: DataFrame, pattern: str, n_buckets: int, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """For each block a row of positions and, for each bucket with words, a row of distinct words."""
    block_bytes = PIECE_BYTES * block_pieces
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    names = ["block", "doc_ids", "lens", "word_order", "positions", "bucket", "words"]

    def rows(block, batches, find):
        table = pa.Table.from_batches(batches).combine_chunks()
        words, flat, starts = _pieces(table.column("text").chunk(0), find)
        times = np.bincount(flat, minlength=len(words))
        local = np.empty(len(words), dtype=np.int64)
        local[np.argsort(-times, kind="stable")] = np.arange(len(words))  # frequent words have small numbers
        found = words.cast(pa.large_binary()).to_pylist()
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in found), np.int64, len(found))
        by_bucket: list[list[int]] = [[] for _ in range(n_buckets)]
        for k, b in enumerate(bucket.tolist()):
            by_bucket[b].append(k)
        for own in by_bucket:
            own.sort(key=found.__getitem__)
        order = local[np.array([k for own in by_bucket for k in own], dtype=np.int64)]
        out = [(block, table.column("doc_id").to_pylist(), np.diff(starts), _zip_planes(order), _zip_planes(local[flat]), None, None)]
        out += [(block, None, None, None, None, b, pack_words([found[k] for k in own])) for b, own in enumerate(by_bucket) if own]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def split(batches):
        import regex

        find = regex.compile(pattern).findall
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= block_bytes or at < batch.num_rows:
                    yield rows(block, held, find)
                    block, held, size = block + 1, [], 0
        if held:
            yield rows(block, held, find)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
            .mapInArrow(split, POSITIONS))


def load_ranks(vocab: str) -> dict[bytes, int]:
    with open(vocab, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def encoded_words(words: DataFrame, vocab: str, pattern: str, n_buckets: int) -> DataFrame:
    """The ids of each block's words of a bucket; within a bucket each distinct word is encoded once."""
    def encode(batches):
        import tiktoken

        library = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(vocab), special_tokens={})
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for word in unpack_words(row["words"]):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = library.encode_ordinary(word.decode())
                    out.append(ids)
                lens = np.fromiter(map(len, out), dtype=np.uint32, count=len(out))
                flat = np.fromiter((i for ids in out for i in ids), dtype=np.uint32, count=int(lens.sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([row["bucket"]], pa.int32()),
                     pa.array([_zip_planes(lens)], pa.binary()), pa.array([_zip_planes(flat)], pa.binary())],
                    ["block", "bucket", "lens", "ids"])

    return words.repartition(n_buckets, "bucket").mapInArrow(encode, WORD_IDS)


def encode(docs: DataFrame, vocab: str, pattern: str, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """doc_id, n_tokens, ids (uint32, little-endian) of every document."""
    spark = docs.sparkSession
    prepare(spark)
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "positions")
    name = "llm_positions_" + path.rpartition("-")[2]
    (word_positions(docs, pattern, n_buckets, block_pieces).write.option("path", path).option("compression", "zstd")
     .bucketBy(n_buckets, "block").saveAsTable(name))
    table = spark.table(name)
    texts = table.select("block", "doc_ids", "lens", "word_order", "positions").filter("positions is not null")
    ids = (encoded_words(table.select("block", "bucket", "words").filter("words is not null"), vocab, pattern, n_buckets)
           .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", F.col("lens").alias("n"), "ids"))).alias("found")))

    def assemble(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = row["found"] or []
                lens_in = [_unzip_planes(x["n"]) for x in found]
                ids_in = [_unzip_planes(x["ids"]) for x in found]
                lens_by_bucket = np.concatenate(lens_in).astype(np.int64) if found else np.zeros(0, np.int64)
                flat = np.concatenate(ids_in) if found else np.zeros(0, np.uint32)
                order = _unzip_planes(row["word_order"])
                starts, lens = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
                starts[order], lens[order] = offsets_of(lens_by_bucket)[:-1], lens_by_bucket
                positions = _unzip_planes(row["positions"])
                tokens = gather(flat, starts[positions], lens[positions]).astype("<u4")
                ends = offsets_of(lens[positions])[offsets_of(np.array(row["lens"], dtype=np.int64))]
                for k in range(0, len(row["doc_ids"]), BATCH):
                    cuts = ends[k:k + BATCH + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][k:k + BATCH], pa.int64()), pa.array(np.diff(cuts), pa.int64()),
                         pa.array([tokens[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                        ["doc_id", "n_tokens", "ids"])

    return texts.join(ids, "block", "left").mapInArrow(assemble, ENCODED)


def decode(encoded: DataFrame, vocab: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the bytes that the ids stand for, looked up in the token-byte table."""
    prepare(encoded.sparkSession)

    def to_bytes(batches):
        ranks = load_ranks(vocab)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        lens = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        starts, flat = offsets_of(lens)[:-1], np.frombuffer(b"".join(tokens), dtype=np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out = []
                for x in part.column("ids"):
                    ids = np.frombuffer(x.as_buffer(), dtype="<u4")
                    out.append(gather(flat, starts[ids], lens[ids]).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(to_bytes, ENCODED + ", decoded binary")


def round_trip(docs: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 digests of the ids and of the decoded bytes."""
    return decode(encode(docs, vocab, pattern), vocab).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
