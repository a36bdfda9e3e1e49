"""Parent chains by pointer doubling.

Each round joins every unfinished row to its ancestor's row and doubles the
distance covered, so a chain of a million links needs twenty rounds, and rows
whose chain is complete leave the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.session import cut_lineage


def resolve_roots(nodes: DataFrame, node: str, parent: str, max_rounds: int = 40, path: bool = True) -> DataFrame:
    """(node, root, depth, path) for each node; without ``path`` none is written.

    A root has no parent, or one outside the given nodes. A cycle never
    reaches a root and raises after ``max_rounds``. Paths grow with the depth:
    for "below X" take ``subtree_intervals``.
    """
    known = nodes.select(F.col(node).alias("_pid")).distinct()
    state = (
        nodes.select(F.col(node).alias("node"), F.col(parent).alias("_pid"))
        .join(known.withColumn("_known", F.lit(True)), "_pid", "left")
        .select(
            "node",
            F.when(F.col("_known"), F.col("_pid")).alias("up"),
            F.col("node").alias("top"),
            F.lit(0).alias("depth"),
            (F.col("node").cast("string") if path else F.lit(None).cast("string")).alias("path"),
        )
    )
    state = cut_lineage(state)
    done = state.where("up IS NULL")
    todo = state.where("up IS NOT NULL")
    # `up` is the next unseen ancestor; `top` the highest one already passed.
    table = state
    for _ in range(max_rounds):
        if todo.isEmpty():
            return done.select("node", F.col("top").alias("root"), "depth", *(["path"] if path else []))
        above = table.select(
            F.col("node").alias("up"), F.col("up").alias("_up2"), F.col("top").alias("_top2"),
            F.col("depth").alias("_d2"), F.col("path").alias("_path2"),
        )
        moved = cut_lineage(
            todo.join(above, "up").select(
                "node",
                F.col("_up2").alias("up"),
                F.col("_top2").alias("top"),
                (F.col("depth") + 1 + F.col("_d2")).alias("depth"),
                (F.concat_ws("/", "_path2", "path") if path else F.col("path")).alias("path"),
            )
        )
        done = done.unionByName(moved.where("up IS NULL"))
        todo = moved.where("up IS NOT NULL")
        table = done.unionByName(todo)
    raise ValueError("parent links form a cycle or exceed the allowed depth")


def _siblings(edges: DataFrame) -> DataFrame:
    """(node, next): the next child of the same parent by id. ``edges`` has node and up.

    Children are put in order over all tasks, so a parent of very many children
    is spread; what follows in the next range is one row per range.
    """
    placed = edges.repartitionByRange("up", "node").withColumn("_range", F.spark_partition_id())
    placed = cut_lineage(placed)
    within = W.partitionBy("_range", "up").orderBy("node")
    listed = placed.withColumn("next", F.lead("node").over(within))
    starts = placed.groupBy("_range").agg(F.min(F.struct("up", "node")).alias("first"))
    following = starts.select("_range", F.lead("first").over(W.orderBy("_range")).alias("_following"))
    joined = listed.join(F.broadcast(following), "_range")
    goes_on = F.col("next").isNull() & (F.col("_following.up") == F.col("up"))
    return joined.select("node", F.when(goes_on, F.col("_following.node")).otherwise(F.col("next")).alias("next"))


def subtree_intervals(nodes: DataFrame, node: str, parent: str, max_rounds: int = 40) -> DataFrame:
    """(node, root, depth, low, high): X's subtree is the nodes of its root with low between X's low and high.

    Every node is entered and left once on a tour around its tree, children by
    id. The tour is a list; pointer doubling adds up what follows each of its
    steps, so a chain of a million links takes about twenty rounds, and no path
    is written. A root has no parent, or one outside the nodes; ids are unique;
    a cycle raises after ``max_rounds``.
    """
    plain = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up")).where("node IS NOT NULL")
    known = plain.select(F.col("node").alias("up"), F.lit(True).alias("_known"))
    edges = cut_lineage(plain.join(known, "up", "left").select("node", F.when(F.col("_known"), F.col("up")).alias("up")))
    children = edges.where("up IS NOT NULL")
    first = children.groupBy(F.col("up").alias("node")).agg(F.min("node").alias("child"))
    ways = edges.join(first, "node", "left").join(_siblings(children), "node", "left")

    def step(leaves: bool, to, to_leaves, weight: int, turn: int):
        return F.struct(F.lit(leaves).alias("leaves"), to.alias("to"), to_leaves.alias("to_leaves"),
                        F.lit(weight).cast("long").alias("entered"), F.lit(turn).cast("long").alias("turn"))

    enter = step(False, F.coalesce("child", "node"), F.col("child").isNull(), 1, 1)
    leave = step(True, F.coalesce("next", "up"), F.col("next").isNull(), 0, -1)
    tour = cut_lineage(ways.select("node", F.inline(F.array(enter, leave))).withColumn("end", F.when(F.col("to").isNull(), F.col("node"))))
    done, todo = tour.where("to IS NULL"), tour.where("to IS NOT NULL")
    for _ in range(max_rounds):
        if todo.isEmpty():
            break
        ahead = done.unionByName(todo).select(
            F.col("node").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("_to"), F.col("to_leaves").alias("_leaves"),
            F.col("entered").alias("_entered"), F.col("turn").alias("_turn"), F.col("end").alias("_end"))
        moved = cut_lineage(todo.join(ahead, ["to", "to_leaves"]).select(
            "node", "leaves", F.col("_to").alias("to"), F.col("_leaves").alias("to_leaves"),
            (F.col("entered") + F.col("_entered")).alias("entered"), (F.col("turn") + F.col("_turn")).alias("turn"), F.col("_end").alias("end")))
        done, todo = done.unionByName(moved.where("to IS NULL")), moved.where("to IS NOT NULL")
    else:
        raise ValueError("parent links form a cycle or exceed the allowed depth")
    both = done.groupBy("node").agg(
        F.first("end").alias("root"), F.max(F.when(~F.col("leaves"), -F.col("turn"))).alias("depth"),
        F.max(F.when(~F.col("leaves"), F.col("entered"))).alias("_from"), F.max(F.when(F.col("leaves"), F.col("entered"))).alias("_after"))
    sizes = both.where("node = root").select("root", F.col("_from").alias("_all"))
    return both.join(sizes, "root").select(
        "node", "root", F.col("depth").cast("int").alias("depth"), (F.col("_all") - F.col("_from")).alias("low"),
        (F.col("_all") - F.col("_after") - 1).alias("high"))
