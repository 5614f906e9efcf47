"""Connected components of an edge table: hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(v, comp)``, the least vertex reachable, for every vertex of an edge.

    Only joins on vertices and minima (combined before the shuffle), so a hub is no large group in a task.
    Each round is written to the scratch folder; rounds grow with the logarithm of the longest path.
    """
    both = scratch.write(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp")), f"{name}-0")
    done, k = False, 0
    while not done:
        k += 1
        met = both.join(labels.select(F.col("v").alias("a"), F.col("comp").alias("c")), "a").groupBy(F.col("b").alias("v")).agg(F.min("c").alias("c"))
        hooked = labels.join(met, "v", "left").select("v", F.col("comp").alias("old"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        up = labels.select(F.col("v").alias("comp"), F.col("comp").alias("up"))
        new = scratch.write(hooked.join(up, "comp", "left").select("v", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), f"{name}-{k}")
        done = new.where("comp <> old").isEmpty()
        labels = new.select("v", "comp")
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    return labels


def joined_components(comps: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``comps(v, comp)`` after further ``links(a, b)``: only the components that these join are worked on."""
    if comps is None:
        return connected_components(links, scratch, name)
    a = comps.select(F.col("v").alias("a"), F.col("comp").alias("ca"))
    b = comps.select(F.col("v").alias("b"), F.col("comp").alias("cb"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    moved = connected_components(between, scratch, f"{name}-moved")
    known = comps.join(moved.select(F.col("v").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("v", F.coalesce("new", "comp").alias("comp"))
    return scratch.write(known.unionAll(moved.join(comps.select("v"), "v", "left_anti").select("v", "comp")), name)
