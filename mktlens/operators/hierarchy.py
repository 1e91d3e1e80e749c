"""Category forest operators (H0-H6).

The forest is a small dimension (one row per category). Its transitive
closure takes log2(depth) rounds of pointer doubling over stored tables (or
a recursive CTE). Everything returned here is a DataFrame that joins
to facts on ``category_id``; AQE broadcasts it at runtime when its measured
size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and falls back
to a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_dimension


def category_closure(categories: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(ancestor, descendant, depth) for every strict ancestor, depth >= 1, at any depth.

    Pointer doubling: with all pairs up to distance d, joining those of distance d with all of them gives
    those up to 2d, so a forest of depth D takes log2(D) rounds. Each round is stored reliably
    (``materialize_dimension``), its size and loops are counted before the next. A cycle raises, as does
    a forest deeper than ``max_depth`` if that is given.
    """
    has_parent = F.col("parent_category_id").isNotNull() & (F.col("parent_category_id") != 0)
    new = categories.filter(has_parent).select(F.col("parent_category_id").cast("long").alias("ancestor"),
                                               F.col("category_id").cast("long").alias("descendant"), F.lit(1).alias("depth"))
    pairs, reach = None, 1
    while True:
        new = materialize_dimension(new)
        size = new.agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"),
                       F.count_if(F.col("ancestor") == F.col("descendant")).alias("loops")).first()
        if size["loops"]:
            raise ValueError("the category forest has a cycle")
        if max_depth is not None and (size["depth"] or 0) > max_depth:
            raise ValueError(f"category forest deeper than {max_depth} levels")
        if pairs is not None and not size["n"]:
            return pairs
        if pairs is not None:
            reach *= 2
        pairs = new if pairs is None else pairs.unionByName(new)
        far = new.filter(F.col("depth") == reach).select(F.col("ancestor").alias("via"), F.col("descendant").alias("low"))
        up = pairs.select(F.col("descendant").alias("via"), F.col("ancestor").alias("high"), F.col("depth").alias("steps"))
        new = far.join(up, "via").select(F.col("high").alias("ancestor"), F.col("low").alias("descendant"),
                                         (F.col("steps") + reach).alias("depth"))


def category_closure_recursive(categories: DataFrame) -> DataFrame:
    """Closure by recursive CTE (any depth)."""
    spark = categories.sparkSession
    return spark.sql(
        """
        WITH RECURSIVE walk(ancestor, descendant, depth) AS (
            SELECT parent_category_id, category_id, 1
            FROM {cat} WHERE parent_category_id <> 0
            UNION ALL
            SELECT c.parent_category_id, w.descendant, w.depth + 1
            FROM walk w JOIN {cat} c ON c.category_id = w.ancestor
            WHERE c.parent_category_id <> 0
        )
        SELECT CAST(ancestor AS BIGINT) AS ancestor, CAST(descendant AS BIGINT) AS descendant,
               CAST(depth AS INT) AS depth
        FROM walk
        """,
        cat=categories.select("category_id", "parent_category_id"),
    )


def descendants(closure: DataFrame, category_id: int | DataFrame, level: int = 0) -> DataFrame:
    """Strict descendants of ``category_id``; ``level`` 0 = any depth, else exactly that depth.

    A one-column DataFrame of ids is answered as a whole: (ancestor, category_id, depth).
    """
    if isinstance(category_id, DataFrame):
        asked = category_id.select(F.col(category_id.columns[0]).cast("long").alias("ancestor")).distinct()
        out = closure.filter(F.col("depth") == level) if level else closure
        return out.join(asked, "ancestor").select("ancestor", F.col("descendant").alias("category_id"), "depth")
    out = closure.filter(F.col("ancestor") == category_id)
    if level:
        out = out.filter(F.col("depth") == level)
    return out.select(F.col("descendant").alias("category_id"))


def roots(categories: DataFrame) -> DataFrame:
    return categories.filter(F.col("parent_category_id") == 0)


def scope_table(categories: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(scope_id, category_id): strict descendants of every category, or the category itself for a leaf.

    This is the "descendants, else itself" filter of every category query, for
    all categories at once, so a query over many scopes is one join.
    """
    closure = closure if closure is not None else category_closure(categories)
    strict = closure.select(F.col("ancestor").alias("scope_id"), F.col("descendant").alias("category_id"))
    # a node has strict descendants iff it is some node's parent
    parents = categories.select(F.col("parent_category_id").alias("category_id"))
    leaves = (categories.select("category_id").join(parents, "category_id", "left_anti")
              .select(F.col("category_id").alias("scope_id"), "category_id"))
    return strict.unionByName(leaves)


def scope_of(categories: DataFrame, category_id: int, closure: DataFrame | None = None) -> DataFrame:
    """Scope table of one id, same shape as ``scope_table``: its strict descendants, else ``[id]``
    (also for an id missing from the forest)."""
    spark = categories.sparkSession
    closure = closure if closure is not None else category_closure(categories)
    strict = descendants(closure, category_id)
    # the id itself only when it has no strict descendants: a scalar subquery
    self_row = (spark.range(1).select(F.lit(category_id).cast("long").alias("category_id"))
                .filter(strict.agg(F.count(F.lit(1))).scalar() == 0))
    return strict.unionByName(self_row).select(F.lit(category_id).cast("long").alias("scope_id"), "category_id")


def in_scope(facts: DataFrame, scope: DataFrame, keep_scope: bool = True) -> DataFrame:
    """Restrict facts to a scope table; with ``keep_scope`` a fact appears once per scope containing it."""
    if "scope_id" in scope.columns and keep_scope:
        return facts.join(scope, "category_id")
    return facts.join(scope.select("category_id").distinct(), "category_id", "left_semi")


def category_info(categories: DataFrame) -> DataFrame:
    """Title, parent and direct children of every category (H3)."""
    children = (categories.filter(F.col("parent_category_id") != 0)
                .groupBy(F.col("parent_category_id").alias("category_id"))
                .agg(F.array_sort(F.collect_list("category_id")).alias("children_ids")))
    return (categories.join(children, "category_id", "left")
            .select("category_id", F.col("title").alias("name"),
                    F.col("parent_category_id").alias("parent_id"),
                    F.coalesce("children_ids", F.array().cast("array<bigint>")).alias("children_ids")))


def with_title(df: DataFrame, categories: DataFrame, id_col: str, out: str, missing: str | None = None) -> DataFrame:
    """Dictionary lookup of a category title (left join; optional default)."""
    dim = categories.select(F.col("category_id").alias(id_col), F.col("title").alias(out))
    res = df.join(dim, id_col, "left")
    if missing is not None:
        res = res.withColumn(out, F.coalesce(F.col(out), F.lit(missing)))
    return res
