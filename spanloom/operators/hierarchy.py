"""Parent-child links to full hierarchies by pointer doubling.

Each node holds a pointer to an ancestor and the distance to it. A round joins the pointers to themselves, which
doubles the distance, so a tree of depth d is resolved after log2(d) rounds. The number of nodes below a node is
summed along the same exact doubling steps (after round k a node has counted everything less than 2^k below
it), so no ancestor-descendant pairs are needed for it. Depths of a tree are contiguous: when a round resolves no
further node, what is left lies on a loop or below one.

Only nodes that have children take part in the rounds: leaves are most nodes of a tree and take root and depth from their parent
in one join at the end. A round moves only the nodes that are deeper than its step; their targets are looked up among all,
in one join, and the sums are pre-aggregated on the ancestor key. Each round is one table in the shared folder, which cuts
lineage; what is left to do is counted while it is written.

Defined results
* Links with a null or blank end are no links; repeated links count once; a node linked to itself is a loop.
* Nodes on a loop or below one have root '', depth -1, n_descendants -1 and path null.
* If a node has two different parents the smallest parent is kept.
* Empty links give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanloom.runtime import drop_path, materialize

EDGES, LINKS = "edges", "dispatch_links"
SEPARATOR = " > "


#: White space of Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def canonical(c: Column) -> Column:
    """Trimmed (any white space) and in lower case; blank becomes null."""
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def edge_links(edges: DataFrame) -> DataFrame:
    """(child, parent) of edges."""
    return edges.select(canonical(F.col("to_anchor")).alias("child"), canonical(F.col("from_anchor")).alias("parent")).where("child is not null and parent is not null")


def dispatch_parents(links: DataFrame) -> DataFrame:
    """(child, parent) tapes: the tape that sent a uuid is the parent of those that received it."""
    side = lambda d: links.where(F.lower(F.trim("direction")) == d).select(canonical(F.col("uuid")).alias("uuid"), "tape_id").where("uuid is not null and tape_id is not null").distinct()
    sent, received = side("sent").withColumnRenamed("tape_id", "parent"), side("received").withColumnRenamed("tape_id", "child")
    # all senders of a uuid but the least lose against it anyway, so a uuid of many senders and receivers makes no pairs
    return received.join(sent.groupBy("uuid").agg(F.min("parent").alias("parent")), "uuid").select("child", "parent")


def hierarchy(links: DataFrame, nodes: DataFrame | None = None, paths: bool = False, key: tuple[str, ...] = ()) -> DataFrame:
    """node, root, depth, n_descendants (and path) of every node of (child, parent) links.

    ``nodes`` (one column ``node``) adds nodes without links. ``key`` names columns that keep separate forests apart
    (all inputs must have them). ``paths`` adds the text of all nodes from the root down; its size is the sum of
    all depths, so it is left out by default.
    """
    k = list(key)
    no = F.lit(None).cast("string")
    end = lambda node, parent, inner: F.struct(node.alias("node"), parent.alias("parent"), F.lit(inner).alias("inner"))
    # both ends of a link from one reading of it
    every = links.select(*k, F.inline(F.array(end(F.col("child"), F.col("parent"), False), end(F.col("parent"), no, True))))
    if nodes is not None:
        every = every.unionByName(nodes.select(*k, "node", no.alias("parent"), F.lit(False).alias("inner")))
    every, _ = materialize(every.groupBy(*k, "node").agg(F.min("parent").alias("parent"), F.max("inner").alias("inner")), "nodes")
    leaves = every.where("not inner and parent is not null")
    few = leaves.groupBy(*k, F.col("parent").alias("node")).agg(F.count("*").alias("leaves"))
    alone = every.where("not inner and parent is null")
    start = every.where("inner").join(few, [*k, "node"], "left").select(
        *k, "node", F.coalesce("parent", "node").alias("anc"), F.when(F.col("parent").isNull(), 0).cast("long").alias("depth"), F.coalesce("leaves", F.lit(0)).alias("leaves"), (F.coalesce("leaves", F.lit(0)) + 1).alias("below"),
        (F.col("node") if paths else no).alias("path"),
    )
    table, left = _counted(start)
    # nodes less deep than the step, with their root, and the others with their ancestor at exactly the step
    found, far = table.where("depth is not null"), table.where("depth is null")
    sums, step = [far.select(*k, "anc", "below")], 1
    while left:
        gain = far.groupBy(*k, F.col("anc").alias("node")).agg(F.sum("below").alias("gain"))
        target = found.unionByName(far).select(*k, F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        jumped = far.drop("depth").join(target, [*k, "anc"]).join(gain, [*k, "node"], "left").select(
            *k, "node", F.col("anc2").alias("anc"), (F.col("depth2") + step).alias("depth"), "leaves", (F.col("below") + F.coalesce("gain", F.lit(0))).alias("below"),
            (F.concat_ws(SEPARATOR, "path2", "path") if paths else F.col("path")).alias("path"),
        )
        table, now = _counted(jumped)
        far = table.where("depth is null")
        if now == left:
            break
        found, step, left = found.unionByName(table.where("depth is not null")), step * 2, now
        sums.append(far.select(*k, "anc", "below"))
    counted = sums[0]
    for x in sums[1:]:
        counted = counted.unionByName(x)
    counted = counted.groupBy(*k, F.col("anc").alias("node")).agg(F.sum("below").alias("n"))
    known = found.join(counted, [*k, "node"], "left").select(*k, "node", F.col("anc").alias("root"), "depth", (F.coalesce("n", F.lit(0)) + F.col("leaves")).alias("n_descendants"), "path")
    lost = lambda df: df.select(*k, "node", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit(-1).alias("n_descendants"), no.alias("path"))
    inner = known.unionByName(lost(far)) if left else known
    up = inner.select(*k, F.col("node").alias("parent"), "root", F.col("depth").alias("above"), F.col("path").alias("path2"))
    below = leaves.join(up, [*k, "parent"]).select(
        *k, "node", "root", F.when(F.col("above") < 0, -1).otherwise(F.col("above") + 1).alias("depth"), F.when(F.col("above") < 0, -1).otherwise(0).alias("n_descendants"),
        (F.when(F.col("path2").isNotNull(), F.concat_ws(SEPARATOR, "path2", "node")) if paths else no).alias("path"),
    )
    single = alone.select(*k, "node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(0).alias("n_descendants"), (F.col("node") if paths else no).alias("path"))
    out = inner.unionByName(below).unionByName(single).withColumns({c: F.col(c).cast("int") for c in ("depth", "n_descendants")})
    return out if paths else out.drop("path")


def _counted(pointers: DataFrame) -> tuple[DataFrame, int]:
    """The written table and how many of its nodes have no depth yet."""
    seen = Observation()
    table, _ = materialize(pointers.observe(seen, F.count_if(F.col("depth").isNull()).alias("far")), "pointers")
    return table, seen.get["far"]


def closure(links: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(ancestor, node, distance) of all pairs above one another, by ``key``; loops and what is below them left out.

    The pairs at distance d up to 2^k join the exact jumps of 2^k, so each pair is made once. The result has as many
    rows as the sum of all depths.
    """
    k = list(key)
    base = hierarchy(links, key=key)
    single = links.groupBy(*k, "child").agg(F.min("parent").alias("parent"))
    trees = single.join(base.where("depth > 0").select(*k, F.col("node").alias("child")), [*k, "child"], "left_semi")
    pairs, path = materialize(trees.select(*k, F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).cast("int").alias("distance")), "closure")
    exact, exact_path = pairs, None
    step = 1
    while exact.limit(1).count():
        far = pairs.withColumnRenamed("ancestor", "mid").join(exact.select(*k, F.col("node").alias("mid"), "ancestor", F.col("distance").alias("more")), [*k, "mid"])
        far = far.select(*k, "ancestor", "node", (F.col("distance") + F.col("more")).alias("distance"))
        grown, newer = materialize(pairs.unionByName(far), "closure")
        jumps, jumps_path = materialize(grown.where(F.col("distance") == 2 * step), "jumps")
        for old in (path, exact_path):
            if old:
                drop_path(pairs.sparkSession, old)
        pairs, path, exact, exact_path, step = grown, newer, jumps, jumps_path, 2 * step
    return pairs


def both_links(edges: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) of both tables, kept apart by ``src``."""
    both = edge_links(edges).withColumn("src", F.lit(EDGES)).unionByName(dispatch_parents(links).withColumn("src", F.lit(LINKS)))
    return both, links.where("tape_id is not null").select(F.lit(LINKS).alias("src"), F.col("tape_id").alias("node"))


def found(edges: DataFrame, links: DataFrame) -> DataFrame:
    both, nodes = both_links(edges, links)
    return hierarchy(both, nodes, key=("src",)).select("src", "node", "root", "depth", "n_descendants")


def full_paths(edges: DataFrame, links: DataFrame) -> DataFrame:
    both, nodes = both_links(edges, links)
    return hierarchy(both, nodes, paths=True, key=("src",)).select("src", "node", "root", "depth", "path")


def descendants(edges: DataFrame, links: DataFrame) -> DataFrame:
    return closure(both_links(edges, links)[0], key=("src",)).select("src", "ancestor", "node", "distance")
