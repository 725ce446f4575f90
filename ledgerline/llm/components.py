"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v). Minima are pre-aggregated per task; the join back can be split where a hub is hot."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    out = materialize(out.where("u <> v").distinct(), "cc-edges")
    discard(low)
    return out


def _settled(cur: DataFrame) -> bool:
    """Every node points once to a smaller one that points nowhere: the components are these stars."""
    edges, nodes = cur.agg(F.count("*"), F.countDistinct("u")).first()
    return edges == nodes and not cur.select("v").join(cur.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the edges (u, v) of one ordered type; label is the smallest node reachable.

    Edges may repeat, point either way or be loops (a node known only by a loop is left out); null ends are ignored;
    no edges give no rows. Raises if `max_rounds` do not suffice; nothing is cut off silently.
    """
    cur = materialize(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "cc-edges")
    if not cur.limit(1).count():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for _ in range(max_rounds):
        wide = _star(cur, True)
        last, cur = cur, _star(wide, False)
        discard(last, wide)
        if _settled(cur):
            return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    raise RuntimeError("components did not settle")
