"""Token-id files: frequency-ranked ids in a byte-aligned variable-length coding with separate control bytes.

Format. A folder with two Parquet tables. ``ranks`` (id, rank, n): every id of the
files, ranked by how often it occurs over all documents (ties: smaller id first).
``blocks``: rows of up to ``block_ids`` ids of whole documents in ascending
(shard, block) order, which is ascending order of doc_id (nulls first; rows that
share a doc_id by a hash of their text):

    shard, block  int     place of the block
    first         long    ids of the shard before this block
    doc_ids       array<long>, lens array<int>: documents and their numbers of ids
    control       binary  two bits an id, four ids a byte, low bits first: bytes of the rank less one
    data          binary  the ranks, one to four bytes each, little-endian

The coder packs by numpy masks; the decoder looks four lengths up for each control
byte. A shard is a range of doc_id, dealt by Spark, so a block is a few MB and no
task holds more than its range.

Cases: a null text counts as empty; an empty text has only the end id; repeated
rows are kept, each with its own ids; further columns of the input are ignored;
an empty table gives empty tables; texts of any length are encoded whole (a
document longer than ``block_ids`` makes a block of its own).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkTable, can_follow, one_by_one
from .common import gather, kept, offsets_of, prepare, text_or_empty

RANKS = "id int, rank int, n long"
RAW = "shard int, block int, first long, doc_ids array<bigint>, lens array<int>, ids binary, found array<int>, times array<bigint>"
BLOCKS = "shard int, block int, first long, doc_ids array<bigint>, lens array<int>, control binary, data binary"
DECODED = "shard int, doc_id long, at long, n_tokens long, ids binary"
BLOCK_IDS = 1 << 20
#: Documents looked up at once; chunks sent to the library in one call.
BATCH, CALL_CHUNKS = 1000, 2000

#: Bytes of the four ids of each control byte.
_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int64)

_tables: dict[str, ChunkTable] = {}


def _joined(chunks: pa.Array) -> str:
    """The chunks as one text."""
    offsets = np.frombuffer(chunks.buffers()[1], dtype=np.int64)[chunks.offset:chunks.offset + len(chunks) + 1]
    return str(chunks.buffers()[2][int(offsets[0]):int(offsets[-1])], "utf-8") if offsets[-1] > offsets[0] else ""


class _Library:
    """Ids of chunks by the tokenizers library, many chunks in one call.

    Chunks that can follow one another are sent as one text. Every token of a
    byte-level vocabulary stands for a known number of bytes, so sums of bytes tell
    where each chunk's ids end. Other chunks, those that hold an added token, and
    all if the sums don't meet the chunks' ends, are sent one by one.
    """

    def __init__(self, vocab: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(ids.values(), default=0) + 1, dtype=np.int64)
        for token, i in ids.items():
            self.n_bytes[i] = len(token)  # a character of the vocabulary's alphabet is a byte

    def _alone(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(chunks.to_pylist(), add_special_tokens=False)
        return one_by_one((e.ids for e in found), np.uint32)

    def _together(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([_joined(chunks)], add_special_tokens=False)
        ids = np.array(found[0].ids, dtype=np.uint32)
        bytes_to = np.cumsum(self.n_bytes[ids])
        wanted = np.cumsum(pc.binary_length(chunks).to_numpy(), dtype=np.int64)
        last = np.searchsorted(bytes_to, wanted)
        if not len(ids) or bytes_to[-1] != wanted[-1] or (bytes_to[last] != wanted).any():
            return self._alone(chunks)
        return ids, np.diff(last, prepend=-1)

    def encode(self, chunks: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids, one chunk after another, and their numbers of ids."""
        chunks = pa.array(chunks, pa.large_string())
        fits = can_follow(chunks).copy()
        for t in self.added:
            fits &= ~pc.match_substring(chunks, t).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)])
        n, parts = int(fits.sum()), []
        for run, call in ((order[:n], self._together), (order[n:], self._alone)):
            for at in range(0, len(run), CALL_CHUNKS):
                parts.append(call(chunks.take(pa.array(run[at:at + CALL_CHUNKS]))))
        lens = np.concatenate([x for _, x in parts])
        back = np.argsort(order)
        return gather(np.concatenate([x for x, _ in parts]), offsets_of(lens)[:-1][back], lens[back]), lens[back]


def library_table(vocab: str) -> ChunkTable:
    """This worker's table of chunks encoded by the tokenizers library."""
    if vocab not in _tables:
        _tables[vocab] = ChunkTable(_Library(vocab).encode, np.uint32)
    return _tables[vocab]


def _encoded(batches, vocab: str, end_id: int):
    """(columns of the batch part, ids with the end id) for parts of up to BATCH documents."""
    table = library_table(vocab)
    end = np.array([end_id], dtype=np.uint32)
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            flat, starts = table.values(part.column("text"))
            yield part, [np.concatenate([flat[a:b], end]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    four = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    four[:len(ranks)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks that ``pack`` coded: lengths by table lookup, then one gather for each byte place."""
    lens = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    starts = offsets_of(lens)[:-1]
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(count, dtype=np.uint32)
    for place in range(4):
        has = lens > place
        if not has.any():
            break
        out[has] |= raw[starts[has] + place].astype(np.uint32) << np.uint32(8 * place)
    return out


def id_blocks(docs: DataFrame, vocab: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of raw ids (little-endian, uint16 if all of a block fit, else uint32) in ascending doc_id order, with how often each is in the block; each whole text is encoded once."""
    def encode(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs_in, ids_in, held = [], [], 0

        def flush():
            flat = np.concatenate(ids_in)
            times = np.bincount(flat)
            found = np.flatnonzero(times)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([docs_in], pa.list_(pa.int64())),
                 pa.array([list(map(len, ids_in))], pa.list_(pa.int32())),
                 pa.array([flat.astype("<u2" if found[-1] < 1 << 16 else "<u4").tobytes()], pa.binary()),
                 pa.array([found], pa.list_(pa.int32())), pa.array([times[found]], pa.list_(pa.int64()))],
                ["shard", "block", "first", "doc_ids", "lens", "ids", "found", "times"])

        for part, ids in _encoded(batches, vocab, end_id):
            for doc_id, got in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                if held and held + len(got) > block_ids:
                    yield flush()
                    block, first = block + 1, first + held
                    docs_in, ids_in, held = [], [], 0
                docs_in.append(doc_id)
                ids_in.append(got)
                held += len(got)
        if docs_in:
            yield flush()

    text = text_or_empty()
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
            .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
            .select("doc_id", "text").mapInArrow(encode, RAW))


def _raw_ids(data: pa.Buffer, count: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if data.size == 2 * count else "<u4")


def id_counts(blocks: DataFrame) -> DataFrame:
    """How often each id occurs over all blocks: the blocks' counts, summed in each task and then over all; ids are not read."""
    def count(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            at = batch.column("found").flatten().to_numpy()
            if len(at) and at.max() >= len(total):
                total = np.concatenate([total, np.zeros(int(at.max()) + 1 - len(total), dtype=np.int64)])
            np.add.at(total, at, batch.column("times").flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    return blocks.select("found", "times").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, vocab: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, append ``end_id``, write the two tables of the format under ``path``."""
    spark = docs.sparkSession
    prepare(spark)
    raw = kept(id_blocks(docs, vocab, end_id, block_ids), "ids")
    by_rank = Window.orderBy(F.desc("n"), "id")  # one row an id of the vocabulary
    (id_counts(raw).withColumn("rank", F.row_number().over(by_rank) - 1)
     .select("id", "rank", "n").write.parquet(f"{path}/ranks"))
    sent = spark.sparkContext.broadcast(_rank_arrays(spark, path)[1])  # four bytes an id of the vocabulary

    def code(batches):
        for batch in batches:
            coded = [pack(sent.value[_raw_ids(ids.as_buffer(), pc.sum(lens.values).as_py())])
                     for ids, lens in zip(batch.column("ids"), batch.column("lens"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("shard", "block", "first", "doc_ids", "lens")),
                 pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                ["shard", "block", "first", "doc_ids", "lens", "control", "data"])

    raw.drop("found", "times").mapInArrow(code, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _rank_arrays(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """id by rank and rank by id; as many entries as the vocabulary has ids."""
    rows = spark.read.schema(RANKS).parquet(f"{path}/ranks").select("id", "rank").toArrow()
    ids, ranks = (rows.column(c).to_numpy().astype(np.uint32) for c in ("id", "rank"))
    id_of = np.zeros(len(ids), dtype=np.uint32)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.uint32)
    id_of[ranks], rank_of[ids] = ids, ranks
    return id_of, rank_of


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a written folder: shard, doc_id, ``at`` (ids of the shard before it), n_tokens, ids (uint32, little-endian)."""
    prepare(spark)
    sent = spark.sparkContext.broadcast(_rank_arrays(spark, path)[0])

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["lens"], dtype=np.int64)
                ids = sent.value[unpack(row["control"], row["data"], int(lens.sum()))].astype("<u4")
                at = offsets_of(lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(lens), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(row["first"] + at[:-1], pa.int64()), pa.array(lens, pa.int64()),
                     pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["shard", "doc_id", "at", "n_tokens", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, DECODED)


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_start): the ids of all shards before; reads one number a block."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    size = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return (blocks.groupBy("shard").agg(F.sum(size).alias("n"))
            .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start")))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    return (read_tokens(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
            .join(token_starts(spark, path), "shard")
            .select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
