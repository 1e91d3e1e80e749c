"""Exact top-k by inner product over a bit-sliced index.

Index. Each component x of a vector becomes the integer ``floor(scale * x)``. Rows
are dealt into blocks; in a block each component is stored as bit slices of its
offset from the block's smallest value: slice b is a bitmap over the rows with
bit b of the offset (``build_index``).

Search. A query multiplies slices by its own integer components: component q adds
slice b with weight 2**(b + j) for each set bit j of \\|q\\|; a negative q adds the
complement instead. All slices of a weight are summed by bitmap adders (three
slices to a sum and a carry), from the lowest weight up, which leaves the score
of every row as slices. Rows are then chosen from the most significant slice
down: rows with the bit go ahead of those without until k are certain. The rows
left equal at the border are told apart exactly by vec_id.

Every tile (block, group of queries) is one row of a join on tile numbers, so a
task holds one block (``block_rows`` x components) and ``group_rows`` queries; the
k best of each tile go on to one window per query.

Wide vectors (a component of 2**23 or more after scaling, or 2**16 components or
more) are kept as whole numbers in blocks of their own. A tile with a wide block or
a wide query takes plain dot products instead, in 64 bits or, where these could
overflow, in integers without a bound.

Cases: a vector that is null, empty, or holds a null or non-finite component takes
no part, nor does a null vec_id; rows that share a vec_id, with the same vector or
another, each count as candidates, and as queries share the ranks of their query_id; shorter vectors count as padded with zeros; rows with
a query's own vec_id are no candidates; ties go to the smaller vec_id; a score among
the k best that doesn't fit 64 bits is an error, as is a component that leaves the
range of doubles by scaling; fewer candidates than k give fewer rows; an empty table gives none;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, prepare

SCALE, BLOCK_ROWS, GROUP_ROWS = 256, 16384, 256
LARGEST, LONGEST = 1 << 23, 1 << 16
INDEX = "block long, size int, ids binary, low binary, dims binary, bits binary, slices binary, wide int"
HITS = "query_id long, vec_id long, score long, over boolean"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<int>, wide array<double>): the rows that take part; whole numbers, in wide if they don't suit v."""
    x = F.col(vector_col).cast("array<double>")
    usable = (x.isNotNull() & (F.size(x) > 0) & F.col(id_col).isNotNull()
              & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))  # NaN is greater
    rows = (vectors.filter(F.coalesce(usable, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")))
    scaled = F.transform("x", lambda c: F.lit(float(scale)) * c)
    narrow = (F.size("x") < LONGEST) & F.forall("x", lambda c: F.abs(c) * scale < LARGEST)
    # from 2**52 on every double is whole
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c))
    return rows.select("vec_id", F.when(narrow, F.transform(scaled, lambda c: F.floor(c)).cast("array<int>")).alias("v"),
                       F.when(~narrow, whole).alias("wide"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows x components, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    lens = np.diff(offsets)
    width = int(lens.max()) if len(lens) else 0
    out = np.zeros((len(lens), width), dtype=np.float64 if flat.dtype.kind == "f" else np.int64)
    out[np.arange(width) < lens[:, None]] = flat[offsets[0]:offsets[-1]]
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (last axis: rows) as 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.pad(packed, [*[(0, 0)] * (packed.ndim - 1), (0, pad)]).view(np.uint64)


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block of bit slices, or of wide vectors (``wide`` components each, else 0)."""
    names = [f.strip().split(" ")[0] for f in INDEX.split(",")]

    def slice_block(ids: np.ndarray, v: np.ndarray, block: int) -> pa.RecordBatch:
        low = v.min(axis=0)
        offset = v - low
        width = [int(x).bit_length() for x in offset.max(axis=0)]
        dims = np.repeat(np.arange(v.shape[1]), width).astype(np.int32)
        bits = np.array([b for w in width for b in range(w)], dtype=np.int32)
        slices = _words(((offset[:, dims] >> bits) & 1).T.astype(bool)) if len(dims) else np.zeros((0, 1), np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([len(ids)], pa.int32()),
             *(pa.array([x.tobytes()], pa.binary()) for x in (ids, low, dims, bits, slices)), pa.array([0], pa.int32())], names)

    def wide_block(ids: np.ndarray, v: np.ndarray, block: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([len(ids)], pa.int32()),
             *(pa.array([x], pa.binary()) for x in (ids.tobytes(), b"", b"", b"", v.tobytes())), pa.array([v.shape[1]], pa.int32())],
            names)

    def build(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        kinds = {"v": (slice_block, block_rows), "wide": (wide_block, max(1, block_rows // 4))}
        held = {name: [] for name in kinds}
        for batch in batches:
            for name, (make, most) in kinds.items():
                held[name].append(batch.filter(pc.is_valid(batch.column(name))))
                while sum(b.num_rows for b in held[name]) >= most:
                    table = pa.Table.from_batches(held[name])
                    head, tail = table.slice(0, most), table.slice(most)
                    yield make(head.column("vec_id").to_numpy(), _matrix(head.column(name)), block)
                    block, held[name] = block + 1, tail.to_batches()
        for name, (make, _) in kinds.items():
            if sum(b.num_rows for b in held[name]):
                table = pa.Table.from_batches(held[name])
                yield make(table.column("vec_id").to_numpy(), _matrix(table.column(name)), block)
                block += 1

    return rows.mapInArrow(build, INDEX)


def _add_up(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum bit slices given by weight: one slice for each bit of the sum, lowest first."""
    out, weight = [], 0
    while columns:
        slices = columns.pop(weight, [])
        stack = np.concatenate(slices) if slices else None
        carries = []
        while stack is not None and len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                stack = np.concatenate([ab ^ c, stack[3 * third:]])
            else:
                a, b = stack[:1], stack[1:2]
                carries.append(a & b)
                stack = a ^ b
        if stack is not None:
            out.append(stack[0])
        else:
            out.append(None)
        if carries:
            columns.setdefault(weight + 1, []).extend(carries)
        weight += 1
    return out


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def search_block(block: dict, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and scores of the k best rows of a block for one query of integers."""
    ids, slices, dims, bits = block["ids"], block["slices"], block["dims"], block["bits"]
    q = np.zeros(max(len(query), len(block["low"])), dtype=np.int64)
    q[:len(query)] = query
    low = np.zeros(len(q), dtype=np.int64)
    low[:len(block["low"])] = block["low"]
    base = int(q @ low)
    size = np.abs(q[dims])
    columns: dict[int, list[np.ndarray]] = {}
    for j in range(int(size.max()).bit_length() if len(size) else 0):
        has = (size >> j) & 1 == 1
        for weight in np.unique(bits[has]) if has.any() else ():
            pick = np.flatnonzero(has & (bits == weight))
            # the complement of a slice is in the second half of the stack
            columns.setdefault(int(weight) + j, []).append(slices[pick + np.where(q[dims[pick]] < 0, len(dims), 0)])
    # a negative q: q * x = |q| * (2**width - 1 - x) - |q| * (2**width - 1)
    base -= int((size * (1 << bits.astype(np.int64)))[q[dims] < 0].sum())
    score = _add_up(columns)
    open_rows = block["valid"].copy()
    for at in block["place"].get(own, ()):
        open_rows[at >> 6] &= ~np.uint64(1 << (at & 63))
    sure = np.zeros_like(open_rows)
    n_sure = 0
    if _count(open_rows) > k:
        for bit in reversed(score):
            if bit is None:
                continue
            ahead = open_rows & bit
            n = n_sure + _count(ahead)
            if n > k:
                open_rows = ahead
            else:
                sure |= ahead
                open_rows &= ~bit
                n_sure = n
                if n == k:
                    open_rows[:] = 0
                    break
        border = _rows_of(open_rows)
        border = border[np.argsort(ids[border], kind="stable")][:k - n_sure]
        rows = np.concatenate([_rows_of(sure), border])
    else:
        rows = _rows_of(open_rows)
    scores = np.full(len(rows), base, dtype=np.int64)
    word, shift = rows >> 6, (rows & 63).astype(np.uint64)
    for weight, bit in enumerate(score):
        if bit is not None:
            scores += ((bit[word] >> shift) & np.uint64(1)).astype(np.int64) << weight
    return ids[rows], scores


def load_block(row: dict) -> dict:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    if row["wide"]:
        return {"ids": ids, "values": np.frombuffer(row["slices"], dtype=np.float64).reshape(len(ids), -1)}
    dims = np.frombuffer(row["dims"], dtype=np.int32)
    slices = np.frombuffer(row["slices"], dtype=np.uint64).reshape(len(dims), -1) if len(dims) else np.zeros((0, 1), np.uint64)
    place: dict[int, list[int]] = {}
    for k, x in enumerate(ids.tolist()):
        place.setdefault(x, []).append(k)
    return {"ids": ids, "low": np.frombuffer(row["low"], dtype=np.int64), "dims": dims,
            "bits": np.frombuffer(row["bits"], dtype=np.int32), "slices": np.concatenate([slices, ~slices]),
            "valid": _words(np.ones(len(ids), dtype=bool)), "place": place}


def _values(block: dict) -> np.ndarray:
    """Rows x components of a block, from its slices unless it is wide."""
    if "values" not in block:
        values = np.tile(block["low"], (len(block["ids"]), 1))
        for dim, bit, bitmap in zip(block["dims"], block["bits"], block["slices"]):
            values[_rows_of(bitmap), dim] += 1 << int(bit)
        block["values"] = values
    return block["values"]


def search_plain(block: dict, query: list[int], k: int, own: int) -> tuple[np.ndarray, list[int]]:
    """As ``search_block``, by plain dot products; the scores are Python integers of any size."""
    values, ids = _values(block), block["ids"]
    n = min(len(query), values.shape[1])
    values, query = values[:, :n], query[:n]
    if n * max(map(abs, query)) * int(np.abs(values).max()) < 1 << 63:
        scores = (values.astype(np.int64) @ np.array(query, dtype=np.int64)).tolist()
    else:
        used = [(d, q) for d, q in enumerate(query) if q]
        scores = [sum(int(row[d]) * q for d, q in used) for row in values]
    rows = sorted(np.flatnonzero(ids != own).tolist(), key=lambda r: (-scores[r], ids[r]))[:k]
    return ids[rows], [scores[r] for r in rows]


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row that ``is_query`` (over vec_id) selects."""
    prepare(vectors.sparkSession)
    rows = kept(quantised(vectors, id_col, vector_col, scale), "vectors")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_blocks, n_groups = -(-total["n"] // block_rows) or 1, -(-total["q"] // group_rows) or 1
    index = kept(build_index(rows.repartition(n_blocks), block_rows), "slices")
    queries = rows.filter(is_query).withColumn("g", F.pmod(F.xxhash64("vec_id", "v", "wide"), F.lit(n_groups)))
    groups = queries.groupBy("g").agg(F.collect_list(F.struct("vec_id", "v", "wide")).alias("queries"))  # about group_rows each
    tiles = index.select("block").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)).cast("array<bigint>")))

    def search(batches):
        for batch in batches:
            for tile in batch.to_pylist():
                block, out = load_block(tile), []
                for q in tile["queries"]:
                    own, over = q["vec_id"], False
                    if q["v"] is not None and not tile["wide"]:
                        ids, scores = search_block(block, np.array(q["v"], dtype=np.int64), k, own)
                    else:
                        query = [int(c) for c in (q["v"] if q["v"] is not None else q["wide"])]
                        ids, exact = search_plain(block, query, k, own)
                        scores = np.array([min(max(x, -1 << 63), (1 << 63) - 1) for x in exact], dtype=np.int64)
                        over = np.array([x != y for x, y in zip(exact, scores.tolist())], dtype=bool)
                    out.append((np.full(len(ids), own), ids, scores, np.broadcast_to(over, len(ids))))
                kinds = [pa.int64()] * 3 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[c] for x in out]), kind) for c, kind in enumerate(kinds)],
                    ["query_id", "vec_id", "score", "over"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (tiles.join(groups, "g").join(index, "block").repartition(n_blocks * n_groups).mapInArrow(search, HITS)
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
                    F.when(F.col("over"), F.raise_error(F.lit("a score among the k best doesn't fit 64 bits")).cast("long"))
                    .otherwise(F.col("score")).alias("score")))
