"""The commit graph: edges (child, parent)."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorelog.storage import drop_stored, stored

#: Up to this many edges the graph is walked on the driver (some tens of MB); larger ones by rounds of joins.
DRIVER_EDGES = 2_000_000


def _small(edges: DataFrame) -> list | None:
    rows = edges.select("child", "parent").limit(DRIVER_EDGES + 1).collect()
    return rows if len(rows) <= DRIVER_EDGES else None


def ancestors(edges: DataFrame, head) -> DataFrame:
    """(node): head and all that it reaches."""
    spark, kind = edges.sparkSession, edges.schema["child"].dataType
    rows = _small(edges)
    if rows is not None:
        up = defaultdict(list)
        for r in rows:
            up[r["child"]].append(r["parent"])
        seen, todo = {head}, [head]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return spark.createDataFrame([(x,) for x in sorted(seen)], f"node {kind.simpleString()}")
    found = frontier = spark.createDataFrame([(head,)], f"node {kind.simpleString()}")
    while not frontier.isEmpty():
        step = edges.join(frontier, F.col("child") == F.col("node"), "left_semi").select(F.col("parent").alias("node")).distinct()
        frontier = step.join(found, "node", "left_anti").checkpoint()
        found = found.unionByName(frontier).checkpoint()
    return found


def levels(edges: DataFrame) -> DataFrame:
    """(node, level, position): parents first; level is the longest way down to a root; of commits that could come next,
    the smaller node does."""
    rows = _small(edges)
    if rows is None:
        return _levels_by_joins(edges)
    order = topological([(r["child"], r["parent"]) for r in rows])
    kind = edges.schema["child"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(n, lv, i) for i, (n, lv) in enumerate(order)], f"node {kind}, level int, position int")


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, top): top is the greatest of the node and all that it reaches.  Each round places the nodes whose
    parents are all placed."""
    pending = stored(edges.select("child", "parent", F.lit(None).cast("int").alias("up"), F.lit(None).cast(edges.schema["parent"].dataType).alias("most")), "dag-edges")
    front = nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("level"), F.col("node").alias("top"))
    placed = []
    while True:
        front = stored(front, "dag-front")
        placed.append(front)
        if pending.isEmpty():
            break
        if front.isEmpty():
            raise ValueError("the graph has a cycle")
        filled = pending.join(front.withColumnRenamed("node", "parent"), "parent", "left")
        filled = stored(filled.select("child", "parent", F.coalesce("up", "level").alias("up"), F.coalesce("most", "top").alias("most")), "dag-edges")
        ready = filled.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.count("up").alias("k"), F.max("up").alias("up"), F.max("most").alias("most")).filter("n = k")
        front = stored(ready.select(F.col("child").alias("node"), (F.col("up") + 1).cast("int").alias("level"), F.greatest("child", "most").alias("top")), "dag-front")
        drop_stored(pending)
        pending = stored(filled.join(front.select(F.col("node").alias("child")), "child", "left_anti"), "dag-edges")
        drop_stored(filled)
    return stored(reduce(DataFrame.unionByName, placed), "dag-placed")


def _levels_by_joins(edges: DataFrame) -> DataFrame:
    """levels() without gathering the graph.

    A node comes after all with a smaller top, as one of their ancestors is always free and smaller.  Of the nodes with
    one top, the top itself is first and the others follow by the same rule among themselves, so the falling row of tops
    that ends with the node is its place in the order.
    """
    edges = stored(edges.select("child", "parent").distinct(), "dag-all")
    nodes = stored(edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct(), "dag-nodes")
    found = _peeled(nodes, edges)
    levels_of = found.select("node", "level")
    state = found.select("node", F.array("top").alias("key"), "top")
    done = []
    while True:
        done.append(stored(state.filter("node = top").select("node", "key"), "dag-done"))
        state = stored(state.filter("node <> top"), "dag-state")
        if state.isEmpty():
            break
        child = state.select(F.col("node").alias("child"), F.col("key").alias("child_key"))
        parent = state.select(F.col("node").alias("parent"), F.col("key").alias("parent_key"))
        inner = stored(edges.join(child, "child").join(parent, "parent").filter("child_key = parent_key").select("child", "parent"), "dag-inner")
        tops = _peeled(state.select("node"), inner).select("node", "top")
        state = state.select("node", "key").join(tops, "node").select("node", F.concat("key", F.array("top")).alias("key"), "top")
    keyed = reduce(DataFrame.unionByName, done).join(levels_of, "node")
    dealt = stored(keyed.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "dag-keyed")
    sizes = sorted(tuple(r) for r in dealt.groupBy("part").count().collect())  # one row a partition
    before = [(part, sum(n for p, n in sizes if p < part)) for part, _ in sizes]
    starts = edges.sparkSession.createDataFrame(before, "part int, before long")
    number = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return dealt.join(F.broadcast(starts), "part").select("node", "level", (F.col("before") + number - 1).cast("int").alias("position"))


def topological(edges: list[tuple], rank=None) -> list[tuple]:
    """[(node, level)] with parents first; ``rank`` orders nodes that are free at the same time."""
    import heapq

    rank = rank or (lambda x: x)
    parents, children = defaultdict(set), defaultdict(set)
    nodes = set()
    for c, p in edges:
        nodes |= {c, p}
        parents[c].add(p)
        children[p].add(c)
    waiting = {n: len(parents[n]) for n in nodes}
    free = [(rank(n), n) for n in nodes if not waiting[n]]
    heapq.heapify(free)
    level: dict = {}
    out = []
    while free:
        _, n = heapq.heappop(free)
        level[n] = max((level[p] + 1 for p in parents[n]), default=0)
        out.append((n, level[n]))
        for c in children[n]:
            waiting[c] -= 1
            if not waiting[c]:
                heapq.heappush(free, (rank(c), c))
    if len(out) < len(nodes):
        raise ValueError("the graph has a cycle")
    return out


def merge_diff_parents(commits: DataFrame) -> DataFrame:
    """(hash, diff_no, parent_no): which parent each diff of a merge belongs to.

    A merge shows one diff for each parent whose tree differs from its own, in the parents' order.
    commits: (hash, tree, parents).
    """
    edges = commits.select("hash", "tree", F.posexplode("parents").alias("parent_no", "parent"))
    trees = commits.select(F.col("hash").alias("parent"), F.col("tree").alias("parent_tree"))
    w = Window.partitionBy("hash").orderBy("parent_no")
    shown = edges.join(trees, "parent", "left").filter(F.col("parent_tree").isNull() | (F.col("parent_tree") != F.col("tree")))
    return shown.select("hash", (F.row_number().over(w) - 1).alias("diff_no"), "parent_no")


def merge_changes(commits: DataFrame, diffs: DataFrame) -> DataFrame:
    """(hash, path, new_blob, parents): for each file that differs from the first parent, its version in every parent.

    diffs: (hash, parent_no, path, previous_path, old_blob, new_blob).  A parent whose diff doesn't name the file holds
    the merge's own version.
    """
    first = diffs.filter("parent_no = 0").select("hash", "path", "new_blob")
    places = commits.filter(F.size("parents") > 1).select("hash", F.posexplode("parents").alias("parent_no", "parent")).drop("parent")
    d = diffs.select("hash", "parent_no", "path", F.coalesce("previous_path", "path").alias("p"), F.col("old_blob").alias("v"), F.lit(True).alias("named"))
    each = first.join(places, "hash").join(d, ["hash", "parent_no", "path"], "left")
    version = F.struct("parent_no", F.coalesce("p", "path").alias("path"), F.when(F.col("named"), F.col("v")).otherwise(F.col("new_blob")).alias("blob"))
    rows = each.groupBy("hash", "path", "new_blob").agg(F.array_sort(F.collect_list(version)).alias("x"))
    return rows.select("hash", "path", "new_blob", F.transform("x", lambda v: F.struct(v["path"].alias("path"), v["blob"].alias("blob"))).alias("parents"))
