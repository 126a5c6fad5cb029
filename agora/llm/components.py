"""Connected components of a large undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from agora.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b). Every node's smallest neighbour (or
    itself) is found by a pre-aggregated minimum; the node's larger (large
    star) or not larger (small star) neighbours are then linked to it.

    The minima are written first, so that both join sides are plain scans
    and a node with very many neighbours is split by the skew join."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "star").select(
        "a", F.least("a", "m").alias("m")
    )
    joined = both.join(least, "a")
    if large:
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), the root being
    the smallest node that it reaches. Alternates large-star and small-star
    steps (logarithmically many rounds in practice) until every edge ends in
    a root; each step is written to the shared folder. Only counts come to
    the driver. An empty edge table gives an empty result."""
    links = materialize(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct(), "edges")
    while True:
        # A star forest: every node has one edge, and its end has none.
        ends = links.select(F.col("b").alias("a")).distinct()
        loose = links.groupBy("a").count().where("count > 1").limit(1).count()
        if not loose and not links.join(ends, "a", "left_semi").limit(1).count():
            break
        links = materialize(_star(links, large=True), "edges")
        links = materialize(_star(links, large=False), "edges")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
