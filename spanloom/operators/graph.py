"""Traversal of the lineage graph, and chains of sessions."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalar import stored_class
from spanloom.operators.hierarchy import hierarchy
from spanloom.operators.running import running_sum
from spanloom.params import DEFAULT, Params

EDGE_KEY = ["from_anchor", "to_anchor", "confidence", "location_delta", "cardinality", "agent_link", "note"]


def visible(edges: DataFrame, min_confidence: float = DEFAULT.min_confidence, forensics: bool = False, p: Params = DEFAULT) -> DataFrame:
    """Edges a traversal may use: those of agents, and others that are lineage and confident enough; all of them in forensics."""
    if forensics:
        return edges
    enough = (stored_class(F.col("confidence"), F.col("agent_link"), p) == "lineage") & (F.col("confidence") >= F.lit(min_confidence).cast("float"))
    return edges.where(F.col("agent_link") | enough)


def neighbours(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, inbound, edge columns) of all edges that end or begin at the anchors."""
    into = anchors.select("anchor").distinct().join(edges, F.col("anchor") == F.col("to_anchor")).withColumn("inbound", F.lit(True))
    out = anchors.select("anchor").distinct().join(edges, F.col("anchor") == F.col("from_anchor")).withColumn("inbound", F.lit(False))
    return into.unionByName(out)


def bounded_bfs(edges: DataFrame, seeds: list[str], p: Params = DEFAULT, forensics: bool = False) -> list[dict]:
    """The edges of a breadth-first traversal in the order taken, within depth, fan-out and total of ``p``.

    At each node its edges are ordered by confidence, the inbound ones first, then by their ends and note; those already taken
    are skipped. A level reads the edges of its nodes in one job; only as many edges of a node as can ever be taken come
    to the driver, so what it holds is bounded by the budgets.
    """
    usable = visible(edges, p.min_confidence, forensics, p)
    taken: list[dict] = []
    seen: set[tuple] = set()
    visited: set[str] = set()
    level = list(dict.fromkeys(seeds))
    for _ in range(p.max_depth):
        level = [a for a in level if a not in visited]
        if not level or len(taken) >= p.max_edges:
            break
        ends = usable.where(F.col("to_anchor").isin(level)).select(F.col("to_anchor").alias("node"), F.lit(0).alias("side"), *EDGE_KEY)
        begins = usable.where(F.col("from_anchor").isin(level)).select(F.col("from_anchor").alias("node"), F.lit(1).alias("side"), *EDGE_KEY)
        order = W.partitionBy("node").orderBy(F.desc("confidence"), "side", "from_anchor", "to_anchor", "note", *EDGE_KEY[3:6])
        top = ends.unionByName(begins).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * (p.max_fanout + p.max_edges))
        by_node: dict[str, list] = {}
        for r in top.orderBy("node", "rank").collect():
            by_node.setdefault(r["node"], []).append(r)
        queue, following = deque(level), []
        while queue and len(taken) < p.max_edges:
            node = queue.popleft()
            if node in visited:
                continue
            visited.add(node)
            fanout = 0
            for r in by_node.get(node, []):
                key = tuple(r[c] for c in EDGE_KEY)
                if key in seen:
                    continue
                if fanout == p.max_fanout or len(taken) == p.max_edges:
                    break
                seen.add(key)
                fanout += 1
                taken.append(dict(zip(EDGE_KEY, key, strict=True)))
                following.append(r["from_anchor"] if r["side"] == 0 else r["to_anchor"])
        level = list(dict.fromkeys(following))
    return taken


def reach(edges: DataFrame, seeds: DataFrame, depth: int = DEFAULT.max_depth) -> DataFrame:
    """(seed, anchor, depth): least number of edges from each seed (column anchor), in either direction, without budgets.

    A level is one join and one anti join; meant for stated sets of seeds.
    """
    from spanloom.runtime import materialize

    both = edges.select(F.col("from_anchor").alias("a"), F.col("to_anchor").alias("b")).union(edges.select("to_anchor", "from_anchor")).where("a <> b").distinct()
    known, _ = materialize(seeds.select(F.col("anchor").alias("seed"), F.col("anchor"), F.lit(0).alias("depth")).distinct(), "reach")
    last = known
    for d in range(1, depth + 1):
        step = last.join(both, last["anchor"] == both["a"]).select("seed", F.col("b").alias("anchor")).distinct()
        new, _ = materialize(step.join(known.select("seed", "anchor"), ["seed", "anchor"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        if new.isEmpty():
            break
        known, last = known.unionByName(new), new
    return known


def touched(seeds: list[str], edges: list[dict]) -> list[str]:
    """Query anchors, then the ends of the edges taken, in order and once each."""
    return list(dict.fromkeys([*seeds, *[e[c] for e in edges for c in ("from_anchor", "to_anchor")]]))


def chains(sessions: DataFrame, links: DataFrame) -> DataFrame:
    """Sessions (session_id) with parent, n_children, root, depth and chain_length.

    ``links`` are (parent, child, position); only those between given sessions count, the last link of a child gives its
    parent. Sessions on a loop, or below one, are roots of their own.
    """
    ids = sessions.select("session_id")
    inside = links.join(ids.withColumnRenamed("session_id", "parent"), "parent", "left_semi").join(ids.withColumnRenamed("session_id", "child"), "child", "left_semi")
    if links.isEmpty() or inside.isEmpty():
        alone = [F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("n_children"), F.col("session_id").alias("root"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("chain_length")]
        return sessions.select("*", *alone)
    parent = inside.groupBy("child").agg(F.max_by("parent", "position").alias("parent"))
    tree = hierarchy(parent.select("child", "parent"), ids.withColumnRenamed("session_id", "node"))
    loop = F.col("depth") < 0
    placed = tree.select(F.col("node").alias("session_id"), F.when(loop, F.col("node")).otherwise(F.col("root")).alias("root"), F.when(loop, 0).otherwise(F.col("depth")).alias("depth"))
    size = placed.groupBy("root").agg(F.count("*").alias("chain_length"))
    kids = inside.groupBy("parent").agg(F.count_distinct("child").alias("n_children")).withColumnRenamed("parent", "session_id")
    out = sessions.join(placed, "session_id").join(size, "root").join(parent.withColumnRenamed("child", "session_id"), "session_id", "left").join(kids, "session_id", "left")
    return out.fillna(0, ["n_children"])


def chain_metadata(sessions: DataFrame) -> DataFrame:
    """Adds to sessions (root, session_id, depth, position) their ``place`` in the chain of their root, by depth and position, and
    the chain's ``first_position``. A chain of very many sessions is cut by depth, so it is no single task."""
    placed = running_sum(sessions, ["root"], ["depth", "position", "session_id"], F.col("depth"), F.lit(1), "place")
    return placed.join(sessions.groupBy("root").agg(F.min("position").alias("first_position")), "root")
