"""Hard negatives for labelled vectors by Fagin's threshold algorithm, exact.

Each component x of a vector becomes the whole number ``floor(scale * x)``; a row's
score is its inner product with the anchor. An anchor's positives are its best
rows of the same label; each positive of score s opens a window of scores from
``low`` to ``high`` hundredths of s, and the window's best rows of other labels are
the hard negatives.

Index (``build_index``): rows are dealt by label into blocks of up to ``block_rows``,
so one label of any size spreads over blocks. For each dimension a block holds its rows
in order of that component.

Search of one block for one anchor (``threshold_search``). Each list is read from the end that
the sign of the anchor's component prefers, all lists to the same depth. Rows that
come up for the first time are scored by random access to their components. No
row that hasn't come up scores more than the threshold, the sum of the anchor's
components times the components at that depth. A window is done once the
threshold falls strictly below its kth score (ties go by vec_id, so an equal score
could still matter) or below its lower end; the anchor is done when all of its
windows are. Depth grows by steps that double; at the end of the lists every row
has come up.

Positives search the blocks that hold the anchor's label, as one window without ends;
negatives search all blocks. Each tile (block, group of up to about ``group_rows``
anchors) is one row, and the best of each tile go on to one window of Spark for each
anchor and positive. Scores are whole numbers in doubles where they stay below
2**53, Python's integers else.

Cases: rows with a null label, a null vector, or a null or non-finite component
take no part; an empty vector takes part, shorter ones count as padded with zeros;
a null vec_id sorts after all others; rows that repeat a vec_id are rows of their own:
each is an anchor if the id is, and only an anchor's own row is left out;
fewer rows than asked for give fewer; a label alone has no positives, so its anchors
give no rows; positives below zero open empty windows; a score that doesn't fit 64 bits
is an error, as is a component that leaves the range of doubles by scaling; an
empty table gives none; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, offsets_of, prepare

SCALE, BLOCK_ROWS, GROUP_ROWS, FIRST_DEPTH = 256, 16384, 512, 16
INDEX = "block long, size int, width int, row_ids binary, ids array<bigint>, labels array<string>, vectors binary, lists binary"
POSITIVES = "anchor_row long, row long, id long, score long, over boolean"
NEGATIVES = "anchor_row long, positive long, id long, score long, over boolean"


def labelled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             scale: int = SCALE) -> DataFrame:
    """(row, id, label string, v array<double>): the rows that take part, as whole numbers, each with a number of its own."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is greater
    scaled = F.transform(x, lambda c: F.lit(float(scale)) * c)
    # from 2**52 on every double is whole
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows x components, padded with zeros."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    lens = np.diff(offsets)
    out = np.zeros((len(lens), int(lens.max(initial=0))))
    out[np.arange(out.shape[1]) < lens[:, None]] = flat[offsets[0]:offsets[-1]]
    return out


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block: its rows and, for each dimension, their places in ascending order of the component."""
    def block_of(table: pa.Table, block: int) -> pa.RecordBatch:
        values = _matrix(table.column("v").combine_chunks())
        lists = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([len(values)], pa.int32()), pa.array([values.shape[1]], pa.int32()),
             pa.array([table.column("row").to_numpy().tobytes()], pa.binary()),
             pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
             pa.array([table.column("label").to_pylist()], pa.list_(pa.string())),
             pa.array([values.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(lists).tobytes()], pa.binary())],
            [f.strip().split(" ")[0] for f in INDEX.split(",")])

    def build(batches):
        block, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block_rows:
                table = pa.Table.from_batches(held)
                yield block_of(table.slice(0, block_rows), block)
                block, held = block + 1, table.slice(block_rows).to_batches()
        if sum(b.num_rows for b in held):
            yield block_of(pa.Table.from_batches(held), block)

    return rows.mapInArrow(build, INDEX)


class Block:
    """A block of the index in a worker."""

    def __init__(self, row: dict):
        n, width = row["size"], row["width"]
        self.rows = np.frombuffer(row["row_ids"], dtype=np.int64)
        known = [i is not None for i in row["ids"]]
        ids = np.array([i if k else 0 for i, k in zip(row["ids"], known, strict=True)], dtype=np.int64)
        self.place = np.empty(n, dtype=np.int64)  # place in the order of ids, nulls last
        self.place[np.lexsort((self.rows, ids, ~np.array(known, dtype=bool)))] = np.arange(n)
        self.ids = row["ids"]
        names, self.labels = np.unique(np.array(row["labels"], dtype=object).astype(str), return_inverse=True)
        self.number = {name: k for k, name in enumerate(names.tolist())}
        self.values = np.frombuffer(row["vectors"], dtype=np.float64).reshape(n, width)
        self.lists = np.frombuffer(row["lists"], dtype=np.int32).reshape(width, n)
        self.largest = float(np.abs(self.values).max(initial=0))

    def query(self, vector: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """The anchor's components and the block's, in doubles or, where sums could leave 2**53, whole numbers without a bound."""
        q = np.zeros(self.values.shape[1])
        n = min(len(q), len(vector))
        q[:n] = vector[:n]
        if max(len(q), 1) * max(self.largest, 1.0) * float(np.abs(q).max(initial=1.0)) < 1 << 53:
            return q, self.values
        whole = np.frompyfunc(int, 1, 1)
        if not hasattr(self, "whole"):
            self.whole = whole(self.values)
        return whole(q), self.whole


def threshold_search(block: Block, vector: list[float], allowed: np.ndarray, k: int,
                     windows: list[tuple[int | None, int | None]]) -> list[list[tuple[int, int]]]:
    """For each window (lowest, highest score; None: no end) the k best allowed rows of the block: (place in the block, score).

    ``allowed``: which of the block's rows take part. Best is highest score first, then smallest id.
    """
    q, values = block.query(vector)
    n, used = len(block.rows), np.flatnonzero(q != 0)
    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=values.dtype)) for _ in windows]
    is_open = [True] * len(windows)
    new_to = allowed.copy()
    depth, step = 0, FIRST_DEPTH
    while any(is_open) and depth < n:
        to = min(n, depth + step) if len(used) else n
        if len(used):
            near = [block.lists[d, n - to:n - depth] if q[d] > 0 else block.lists[d, depth:to] for d in used]
            seen = np.concatenate(near)
            seen = seen[new_to[seen]]
            fresh = np.zeros(n, dtype=bool)
            fresh[seen] = True
            fresh = np.flatnonzero(fresh)
            edge = [block.lists[d, n - to] if q[d] > 0 else block.lists[d, to - 1] for d in used]
            threshold = sum(q[d] * values[r, d] for d, r in zip(used, edge, strict=True))
        else:  # every score is zero
            fresh, threshold = np.flatnonzero(new_to), None
        new_to[fresh] = False
        scores = values[fresh][:, used] @ q[used] if len(used) else np.zeros(len(fresh))
        done = to == n or not new_to.any()
        for w, (lowest, highest) in enumerate(windows):
            if not is_open[w]:
                continue
            fits = np.ones(len(fresh), dtype=bool)
            if lowest is not None:
                fits &= scores >= lowest
            if highest is not None:
                fits &= scores <= highest
            rows, got = np.concatenate([best[w][0], fresh[fits]]), np.concatenate([best[w][1], scores[fits]])
            order = np.lexsort((block.place[rows], -got))[:k] if got.dtype != object else np.array(
                sorted(range(len(rows)), key=lambda r: (-got[r], block.place[rows[r]]))[:k], dtype=np.int64)
            best[w] = rows[order], got[order]
            beyond = lowest is not None and not done and threshold < lowest
            is_open[w] = not (done or beyond or (len(order) == k and threshold < got[order[-1]]))
        depth, step = to, step * 2
    return [[(int(r), int(s)) for r, s in zip(*b, strict=True)] for b in best]


def _grouped(dealt: DataFrame, *keys: str) -> DataFrame:
    return dealt.groupBy(*keys).agg(F.collect_list(F.struct("row", "label", "v", "windows")).alias("anchors"))  # about group_rows each


def _clipped(x: int) -> tuple[int, bool]:
    y = min(max(x, -1 << 63), (1 << 63) - 1)
    return y, x != y


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "over" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)


def _checked(score: Column) -> Column:
    return F.when(F.col("over"), F.raise_error(F.lit("a score among the best doesn't fit 64 bits")).cast("long")).otherwise(score)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
         block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` selects the anchors, over a column ``id``.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = kept(labelled(vectors, id_col, vector_col, label_col, scale), "labelled")
    total = rows.count()
    n_blocks = -(-total // block_rows) or 1
    index = kept(build_index(rows.repartitionByRange(n_blocks, "label", F.xxhash64("row"))
                             .sortWithinPartitions("label", F.xxhash64("row")), block_rows), "lists")
    anchors = rows.filter(F.coalesce(is_anchor, F.lit(False)))

    def positives_of(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tile = batch.slice(k, 1).to_pylist()[0]
                block, out = Block(tile), []
                for a in tile["anchors"]:
                    allowed = (block.labels == block.number[a["label"]]) & (block.rows != a["row"])
                    for r, s in threshold_search(block, a["v"], allowed, positives, [(None, None)])[0]:
                        out.append((a["row"], int(block.rows[r]), block.ids[r], *_clipped(s)))
                yield _batch(out, POSITIVES)

    def negatives_of(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tile = batch.slice(k, 1).to_pylist()[0]
                block, out = Block(tile), []
                for a in tile["anchors"]:
                    windows = [(-(-low * w["score"] // 100), high * w["score"] // 100) for w in a["windows"]]
                    allowed = block.labels != block.number.get(a["label"], -1)
                    found = threshold_search(block, a["v"], allowed, negatives, windows)
                    for w, hits in zip(a["windows"], found, strict=True):
                        out += [(a["row"], w["nth"], block.ids[r], *_clipped(s)) for r, s in hits]
                yield _batch(out, NEGATIVES)

    labels = index.select("block", F.explode(F.array_distinct("labels")).alias("label"))
    own = anchors.join(labels, "label").withColumn("windows", F.lit(None).cast("array<struct<nth: long, id: long, score: long>>"))
    asked = own.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    n_tiles = asked.agg(F.sum(F.ceil(F.col("n") / group_rows))).first()[0] or 1
    dealt = own.join(asked, "block").withColumn("g", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / group_rows)))
    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    first = kept(_grouped(dealt, "block", "g").join(index, "block").repartition(int(n_tiles))
                 .mapInArrow(positives_of, POSITIVES).withColumn("nth", F.row_number().over(best).cast("long"))
                 .filter(F.col("nth") <= positives).withColumn("score", _checked(F.col("score"))).drop("over"), "positives")

    windows = first.groupBy("anchor_row").agg(F.collect_list(F.struct("nth", "id", "score")).alias("windows"))
    n_groups = -(-windows.count() // group_rows) or 1
    asking = anchors.join(windows.withColumnRenamed("anchor_row", "row"), "row")
    groups = _grouped(asking.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(n_groups))), "g")
    tiles = index.select("block").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)).cast("array<bigint>")))
    ranked = Window.partitionBy("anchor_row", "positive").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    hits = (tiles.join(groups, "g").join(index, "block").repartition(n_blocks * n_groups).mapInArrow(negatives_of, NEGATIVES)
            .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives))
    named = first.select("anchor_row", F.col("nth").alias("positive"), F.col("id").alias("positive_id"),
                         F.col("score").alias("positive_score"))
    return (hits.join(named, ["anchor_row", "positive"])
            .join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", _checked(F.col("score")).alias("negative_score")))
