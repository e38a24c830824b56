"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmark.llm.common import materialise, release


def _star(links: DataFrame, both_ways: bool, name: str) -> DataFrame:
    """Hang each node's neighbours on the smallest of them; written as ``name``.

    The smallest neighbour is a partial aggregate, so a node with very many
    links costs no task more; the join back is one that Spark can split.
    """
    near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else links
    least = materialise(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    hung = near.join(least, "u")
    if both_ways:
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    found = materialise(hung.where("u <> v").distinct(), name)
    release(least)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) but the roots themselves.

    ``root`` is the smallest node of the component. Every round is written to
    the shared folder, so no round depends on the one before it, which is then
    deleted. The result reads what the last round has written and can be
    released.
    """
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(ordered, "links")
    while True:
        large = _star(now, True, "large")
        after = _star(large, False, "small")
        release(now, large)
        # Done when every node hangs on one root and no root hangs on another.
        roots = after.select("v").distinct()
        stars = after.groupBy("u").count().where("count > 1").limit(1).count() == 0 and after.join(roots.withColumnRenamed("v", "u"), "u", "left_semi").limit(1).count() == 0
        now = after
        if stars:
            found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            found.__dict__["scratch"] = now.__dict__.pop("scratch")
            return found
