"""Connected components of a link table, by contraction, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(u, v) bigint links -> (node, root) for every node that has a link.

    Each round sends every node to the neighbour (or itself) that comes first in that round's pseudo-random order
    and contracts, so chains shrink by a constant share a round. A node's neighbours are only ever reduced to one by
    a combinable minimum; no group is gathered.
    """
    edges = cut(links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        salt = len(steps)
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        key = lambda c: F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("k"), F.col(c).alias("n"))
        step = both.groupBy("u").agg(F.min(key("v")).alias("m")).select(F.col("u").alias("node"), F.least(key("u"), "m")["n"].alias("up"))
        step = cut(step, "step")
        steps.append(step)
        a = step.select(F.col("node").alias("u"), F.col("up").alias("pu"))
        b = step.select(F.col("node").alias("v"), F.col("up").alias("pv"))
        edges = cut(
            edges.join(a, "u").join(b, "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(),
            "links",
        )
    if not steps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    out = steps[0].select("node", F.col("up").alias("root"))
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("up").alias("_up"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    return out
