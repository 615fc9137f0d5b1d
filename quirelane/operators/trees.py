"""Trees as tables of (document, node, parent, position): depth, order, inherited attributes and hashes of subtrees.

Every node holds a pointer to an ancestor, and what it has gathered on the way there. A round replaces each pointer by the
ancestor's own, so the way covered doubles: a tree of depth d takes about log2(d) joins, where a walk from level to level
takes d. Inherited attributes and orders are gathered alike, as both are put together in parts. Nodes of a cycle never
arrive; they are told by a round in which nobody does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelane.session import cut

#: Children of a node that are hashed together.
BLOCK = 1024
OK, CYCLE, ORPHAN = "ok", "cycle", "orphan"


def climb(nodes: DataFrame, *, key: str = "doc_id", inherit: Sequence[str] = (), order: bool = True) -> DataFrame:
    """``nodes`` with root, depth, state and, if ``order``, path: the positions from the root down; order by it is pre-order.

    Columns of ``inherit`` are filled from the nearest ancestor that has a value. state: ``ok``, or ``cycle`` for nodes
    that are on a cycle or below one, and ``orphan`` for nodes below a parent that isn't there; such a node keeps its own
    attributes and those of the ancestors that it has. (key, node) has to be unique; a null parent makes a root. Hot
    ancestors are joined under a key that adaptive execution may split, as both sides are stored tables.
    """
    own = ["position"] if order else []
    cur = nodes.select(
        key, "node", F.col("parent").alias("up"), F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(False).alias("lost"), *inherit, *([F.array("position").alias("path")] if own else [])
    )
    cur = cut(cur.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0)).withColumn("root", F.coalesce("up", "node")))
    waiting = cur.where(F.col("up").isNotNull()).count()
    while waiting:
        done, way = cur.where(F.col("up").isNull()), cur.where(F.col("up").isNotNull())
        above = cur.select(F.col(key).alias("a_key"), F.col("node").alias("a_node"), *(F.col(c).alias(f"a_{c}") for c in ("up", "root", "depth", "lost", *inherit, *(["path"] if own else []))))
        met = way.join(above, (F.col(key) == F.col("a_key")) & (F.col("up") == F.col("a_node")), "left")
        there = F.col("a_node").isNotNull()
        moved = met.select(
            key, "node", F.col("a_up").alias("up"), F.coalesce("a_root", "root").alias("root"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"),
            (~there | F.coalesce("a_lost", F.lit(False))).alias("lost"), *(F.coalesce(c, f"a_{c}").alias(c) for c in inherit),
            *([F.concat(F.coalesce("a_path", F.array().cast(dict(cur.dtypes)["path"])), F.col("path")).alias("path")] if own else []),
        )
        nxt = cut(done.unionByName(moved))
        left = nxt.where(F.col("up").isNotNull()).count()
        if left == waiting:  # a node as deep as the way covered plus one would have arrived
            break
        cur, waiting = nxt, left
    state = F.when(F.col("up").isNotNull(), CYCLE).when(F.col("lost"), ORPHAN).otherwise(OK)
    lone = state != OK
    found = cur.select(key, "node", *inherit, F.when(~lone, F.col("root")).alias("root"), F.when(~lone, F.col("depth")).alias("depth"), state.alias("state"), *([F.when(~lone, F.col("path")).alias("path")] if own else []))
    return nodes.drop(*inherit).join(found, [key, "node"])


def numbered(climbed: DataFrame, leaves: Column, *, key: str = "doc_id", name: str = "number") -> DataFrame:
    """The leaves of each document, numbered from 0 in pre-order; what isn't below a root is left out."""
    found = climbed.where(leaves & (F.col("state") == OK))
    return found.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy("path", "node")) - 1).cast("int"))


def nest(items: DataFrame, *, key: str = "doc_id", place: str = "place", level: str = "level", levels: int = 6) -> DataFrame:
    """``items`` with parent (the place of the nearest earlier item of a smaller level) and position among all items.

    One ordered pass per document finds the last place of each of ``levels`` levels; deeper levels count as the deepest.
    """
    before = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    deep = F.least(F.col(level), F.lit(levels))
    last = [F.last(F.when(deep == k, F.col(place)), ignorenulls=True).over(before) for k in range(1, levels)]
    known = items.withColumns({f"__last{k}": c for k, c in enumerate(last, 1)})
    parent = F.greatest(*(F.when(deep > k, F.col(f"__last{k}")) for k in range(1, levels)), F.lit(None).cast(dict(items.dtypes)[place]))
    return known.select(*items.columns, parent.alias("parent"), F.col(place).alias("position"))


def _joined(rows: DataFrame, keys: list[str], order: str, digest: str) -> DataFrame:
    """One digest per ``keys`` over the digests of its rows in order: of blocks first, so that no long list is ever gathered."""
    block = F.floor(F.col("__n") / BLOCK)
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    text = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", name))), lambda r: r[name]), "")
    blocks = ranked.groupBy(*keys, block.alias("__b")).agg(F.sha2(text(digest), 256).alias("__h"), F.min("__n").alias("__n"))
    return blocks.groupBy(*keys).agg(F.sha2(text("__h"), 256).alias(digest))


def subtree_hashes(climbed: DataFrame, payload: Column, *, key: str = "doc_id") -> DataFrame:
    """(key, node, hash) of every node below a root: SHA-256 of its payload and its children's digest, from the deepest level up.

    A child's place counts, its name doesn't: a subtree that moves changes the hashes of all that hold it, and of no other.
    A level is one aggregation. A node without children hashes its payload alone.
    """
    rows = cut(climbed.where(F.col("state") == OK).select(key, "node", "parent", "position", "depth", F.sha2(payload, 256).alias("own")))
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows.select(key, "node", F.col("own").alias("hash"))
    found, below = [], None
    for d in range(deepest, -1, -1):
        level = rows.where(F.col("depth") == d)
        if below is None:
            hashed = level.withColumn("hash", F.sha2(F.col("own"), 256))
        else:
            kids = _joined(below.select(key, F.col("parent").alias("node"), "position", F.col("hash").alias("kids")), [key, "node"], "position", "kids")
            hashed = level.join(kids, [key, "node"], "left").withColumn("hash", F.sha2(F.concat("own", F.coalesce("kids", F.lit(""))), 256)).drop("kids")
        below = cut(hashed)
        found.append(below)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.select(key, "node", "hash")
