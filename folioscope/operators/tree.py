"""The page tree: parents, depths, subtrees and the map of a space.

Where every page has one parent, which is what a page tree is, paths are doubled: rounds grow with the logarithm of the
depth and rows with the pages.  Where child lists give a page several parents, pairs of the closure are counted instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise


def tree_edges(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("id").alias("parent"), F.explode("child_list").alias("child"))


def parent_map(edges: DataFrame) -> DataFrame:
    """One parent per child, the largest where there are several."""
    return edges.groupBy("child").agg(F.max("parent").alias("parent"))


def single_parents(edges: DataFrame) -> DataFrame | None:
    """``node, up`` of the edges but for loops, written to the shared folder; None if a child has several parents."""
    rows = edges.where("parent <> child").select(F.col("child").alias("node"), F.col("parent").alias("up")).distinct()
    rows = materialise(rows, "parents")
    return None if rows.groupBy("node").count().where("count > 1").head(1) else rows


def lifted(parents: DataFrame) -> tuple[list[DataFrame], int]:
    """Tables ``node, up, steps, top``, of which number k has each node's ancestor ``2 ** k`` steps up, null above a root, how many
    of the steps up to there exist, and the farthest ancestor of these; and how many nodes of the last one never get to a root.

    A table is the one before joined with itself, so their number is the logarithm of the depth and their rows are the
    nodes'.  When a round ends no path, what is left runs into cycles: some node is at each depth below the greatest.
    """
    roots = parents.select(F.col("up").alias("node")).distinct().join(parents, "node", "left_anti")
    first = parents.select("node", "up", F.lit(1).cast("long").alias("steps"), F.col("up").alias("top"))
    now = materialise(first.unionByName(roots.select("node", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("steps"), F.col("node").alias("top"))), "lifted")
    tables, left = [now], now.where("up is not null").count()
    while left:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"), F.col("top").alias("farthest"))
        now = materialise(now.join(above, "up", "left").select("node", F.col("far").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("farthest", "top").alias("top")), "lifted")
        tables.append(now)
        new = now.where("up is not null").count()
        if new == left:
            break
        left = new
    return tables, left


def cycles(parents: DataFrame, last: DataFrame, left: int) -> DataFrame:
    """``node, cycle`` of the nodes that lie on cycles, from the last table of ``lifted`` and the number of its unfinished
    nodes; a cycle is named by its smallest node.

    Far enough up every path is on its cycle, and nodes of a cycle that go equally far up reach all of it; from there the
    smallest of twice as many nodes is known each round.
    """
    now, far = last.where("up is not null").select("node", "up"), 1
    while far < left:  # wherever they start, ``left`` steps more lead into the cycle
        far *= 2
        now = materialise(now.join(now.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")), "cycles")
    on = materialise(now.select(F.col("up").alias("node")).distinct(), "cycles")
    jump, far = parents.join(on, "node", "left_semi").withColumn("least", F.col("node")), 1
    while far < left:
        far *= 2
        above = jump.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("least").alias("other"))
        jump = materialise(jump.join(above, "up").select("node", F.col("far").alias("up"), F.least("least", "other").alias("least")), "cycles")
    return jump.select("node", F.col("least").alias("cycle"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, depth`` from the root, the nearest one where children have several parents; a node that no root among ``nodes`` reaches
    has depth 0.  A page that lists itself is not its own child."""
    nodes = nodes.select("id").distinct()
    parents = single_parents(edges)
    if parents is None:
        return _levels(nodes, edges)
    last = lifted(parents)[0][-1].where("up is null").join(nodes.select(F.col("id").alias("top")), "top", "left_semi").select(F.col("node").alias("id"), F.col("steps").cast("int").alias("depth"))
    return nodes.join(last, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    edges = edges.where("parent <> child")
    level = nodes.join(edges.select(F.col("child").alias("id")), "id", "left_anti").withColumn("depth", F.lit(0))
    seen = level = materialise(level, "depths")
    depth = 0
    while level.head(1):
        depth += 1
        below = level.join(edges, F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct()
        level = materialise(below.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "depths")
        seen = seen.unionByName(level)
    return nodes.join(seen, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def closure(edges: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` (the shortest), for every pair on a downward path; cycles end it.

    Paths double in length each round, so the number of rounds is the logarithm of the depth.
    """
    known = materialise(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("distance")).distinct(), "closure")
    size = known.count()
    while True:
        ahead = known.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("far"), F.col("distance").alias("more"))
        longer = known.join(ahead, "descendant").select("ancestor", F.col("far").alias("descendant"), (F.col("distance") + F.col("more")).alias("distance"))
        known = materialise(known.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance")), "closure")
        new = known.agg(F.count("*"), F.sum("distance")).head()
        if tuple(new) == size:
            return known.where("ancestor <> descendant")
        size = tuple(new)


def descendants(pages: DataFrame, edges: DataFrame, page_id: str, most: int | None = None) -> DataFrame:
    """``descendant, title, distance`` of one page: each round looks twice as far up from all pages, so there is no job per level."""
    parents = single_parents(edges)
    if parents is None:
        found = closure(edges).where((F.col("ancestor") == page_id) & (F.lit(True) if most is None else F.col("distance") <= most)).select("descendant", "distance")
    else:
        hit = lambda c: F.when(F.col(c) == page_id, 1).cast("int")
        now, far, left = parents.withColumn("distance", hit("up")), 1, parents.count()
        size = left
        while left and far < size and (most is None or far < most):
            above = now.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("distance").alias("more"))
            now = materialise(now.join(above, "up", "left").select("node", F.col("far").alias("up"), F.coalesce("distance", F.col("more") + far).alias("distance")), "below")
            left = now.where("up is not null and distance is null").count()
            far *= 2
        found = now.where((F.col("distance") <= most) if most is not None else F.col("distance").isNotNull()).select(F.col("node").alias("descendant"), "distance").where(F.col("descendant") != page_id)
    return found.join(pages.select(F.col("id").alias("descendant"), "title"), "descendant", "left").select("descendant", "title", "distance").orderBy("distance", F.coalesce("title", F.lit("")), "descendant")


def _subtree_counts(own: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, page_type, n, words, worded`` summed over each node's descendants, a row per type; ``own`` has the nodes' own.

    What lies fewer than ``2 ** k`` steps below a node, plus the same of each node that many steps below it, is what lies
    fewer than ``2 ** (k + 1)`` steps below.  Nodes of a cycle are descendants of one another with all that hangs on them,
    so the cycle's edges are cut and its nodes share one total.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "words", "worded")]
    parents = single_parents(edges)
    if parents is None:
        below = closure(edges).join(own.withColumnRenamed("id", "descendant"), "descendant")
        return below.groupBy(F.col("ancestor").alias("id"), "page_type").agg(*sums)
    tables, left = lifted(parents)
    ring = None
    if left:
        ring = materialise(cycles(parents, tables[-1], left), "cycles")
        tables, _ = lifted(parents.join(ring, "node", "left_anti"))
    total = own
    for table in tables:
        moved = total.join(table.where("up is not null").select(F.col("node").alias("id"), "up"), "id").drop("id").withColumnRenamed("up", "id")
        total = materialise(total.unionByName(moved).groupBy("id", "page_type").agg(*sums), "subtrees")
    if ring is not None:
        ring = ring.withColumnRenamed("node", "id")
        shared = total.join(ring, "id").groupBy("cycle", "page_type").agg(*sums)
        total = total.join(ring, "id", "left_anti").unionByName(shared.join(ring, "cycle").drop("cycle"))
    less = own.select("id", "page_type", *((-F.col(c)).alias(c) for c in ("n", "words", "worded")))
    return total.unionByName(less).groupBy("id", "page_type").agg(*sums).where("n > 0")


def subtree_metrics(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Per page with any: descendants, their mean words to the nearest ten, and their most common type."""
    own = pages.select("id", "page_type", F.lit(1).cast("long").alias("n"), F.coalesce(F.col("word_count").cast("long"), F.lit(0).cast("long")).alias("words"), F.col("word_count").isNotNull().cast("long").alias("worded"))
    rows = _subtree_counts(own, edges)
    first = F.min(F.when(F.col("page_type").isNotNull(), F.struct((-F.col("n")).alias("n"), "page_type")))
    mean = F.coalesce(F.bround(F.try_divide(F.sum("words"), F.sum("worded")), -1), F.lit(0.0))
    return rows.groupBy("id").agg(F.sum("n").alias("n_descendants"), mean.alias("avg_words"), first["page_type"].alias("common_type"))


def cartography(pages: DataFrame, edges: DataFrame, links: DataFrame, limit: int = 25) -> DataFrame:
    """The pages that matter in the tree or the link graph, by ``children + 0.1 descendants + in + out``."""
    children = edges.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    into = links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"))
    out = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    joined = pages.select("id", "title", "page_type")
    for x in (children, subtree_metrics(pages, edges), into, out, depths(pages, edges)):
        joined = joined.join(x, "id", "left")
    joined = joined.fillna(0, ["n_children", "n_descendants", "avg_words", "n_in", "n_out", "depth"])
    score = F.col("n_children") + 0.1 * F.col("n_descendants") + F.col("n_in") + F.col("n_out")
    kept = joined.where("(n_children > 2 and n_descendants > 0) or n_in + n_out > 10").withColumns({"score": score, "subtree_words": F.col("avg_words") * F.col("n_descendants")})
    return kept.orderBy(F.desc("score"), "id").limit(limit)


def scores(nodes: DataFrame, group: str = "space_id") -> DataFrame:
    """Structural and importance scores of the rows of a map, and which of them are gems."""
    w = W.partitionBy(group)
    part = lambda c: F.col(c) / F.greatest(F.max(c).over(w), F.lit(1))
    q = part("quality")
    structural = 0.5 * part("subtree_words") + 0.3 * part("subtree_quality") + 0.2 * q
    importance = (0.55 * part("n_in") + 0.25 * part("n_out") + 0.2 * q) * F.greatest(F.lit(0.6), 1 - 0.08 * F.col("depth"))
    out = nodes.withColumns({"structural": structural, "importance": importance})
    n = F.count("*").over(w)
    at = F.when(n < 3, None).otherwise(F.floor(n * 0.6).cast("int") + 1)
    ranks = {f"{c}_rank": F.row_number().over(W.partitionBy(group).orderBy(c)) for c in ("structural", "importance")}
    out = out.withColumns({"at": at, **ranks})
    limit = lambda c: F.coalesce(F.max(F.when(F.col(f"{c}_rank") == F.col("at"), F.col(c))).over(w), F.lit(0.0))
    gem = (F.col("depth") >= 4) & (F.col("structural") >= limit("structural")) & (F.col("importance") >= limit("importance"))
    return out.withColumn("gem", gem).drop("at", *ranks)


def depth_name(depth) -> F.Column:
    return F.when(depth == 0, "root").when(depth == 1, "top level").when(depth <= 3, "mid level").otherwise("deep")


def gems(nodes: DataFrame) -> DataFrame:
    """The gems among scored nodes, the best first."""
    return nodes.where("gem").orderBy(F.desc(F.col("importance") + F.col("structural")), "id")


def visible_branches(nodes: DataFrame, least: int = 150) -> DataFrame:
    """Without branches of few words (on average over the subtree) but for roots, which always show."""
    return nodes.where((F.col("depth") == 0) | (F.col("avg_words") >= least))
