"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .joins import lookup

#: Rows of a table of hooks that Spark may broadcast. Four salts repeat a row, and a stored table of small numbers is far larger in memory
#: than its files, by which Spark judges it.
BROADCAST_HOOKS = 20_000


def _bounded(hook: DataFrame) -> DataFrame:
    """A stored table of hooks that is broadcast only when it has few rows; larger ones never pass the driver."""
    return hook if hook.count() <= BROADCAST_HOOKS else hook.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root) for every node that has an edge; the root is the smallest member.

    Every round hooks each root to its smallest neighbour, follows the hooks by
    doubling until they end, and contracts the edges; finished parts drop out.
    A chain of n nodes costs log n steps. Each round's small tables go to
    reliable storage. A root may carry a large share of all edges, hence the
    salted lookups.
    """
    live = checkpointed(edges.where("a <> b").selectExpr("least(a, b) AS lo", "greatest(a, b) AS hi").distinct())
    roots = live.selectExpr("explode(array(lo, hi)) AS node").distinct().selectExpr("node", "node AS root")
    while not live.isEmpty():
        hook = live.groupBy("hi").agg(F.min("lo").alias("up"))
        hook = checkpointed(hook)
        while True:
            above = _bounded(hook.selectExpr("hi AS h2", "up AS u2"))
            further = checkpointed(lookup(hook, above, "up", "h2", ["hi"], salts=4).selectExpr(
                "hi", "coalesce(u2, up) AS up", "u2 IS NOT NULL AS moved"))
            hook = further.select("hi", "up")
            if further.where("moved").isEmpty():
                break
        hook = _bounded(hook)
        roots = lookup(roots, hook, "root", "hi", ["node"]).selectExpr("node", "coalesce(up, root) AS root")
        roots = checkpointed(roots)
        first = lookup(live, hook.selectExpr("hi AS k", "up AS up1"), "lo", "k", ["lo", "hi"]).selectExpr(
            "coalesce(up1, lo) AS a", "hi AS b")
        both = lookup(first, hook.selectExpr("hi AS k", "up AS up1"), "b", "k", ["a", "b"]).selectExpr(
            "a", "coalesce(up1, b) AS b")
        live = checkpointed(both.where("a <> b").selectExpr("least(a, b) AS lo", "greatest(a, b) AS hi").distinct())
    return roots
