"""Connected components of an undirected graph whose edges are a table (distributed union-find)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginwise.session import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); the component is its smallest id.

    Alternating star contraction: large-star links every greater neighbour of a node to the least
    node around it, small-star does so for the lesser ones. Both keep the components, and the number
    of rounds grows with the logarithm of the longest path. Each round is a written table, so a lost
    executor costs one round at most, and nothing but two numbers per round reaches the driver.

    Loops, repeated edges and both directions of an edge are fine; edges with a NULL end are ignored.
    """
    a, b = F.col("a"), F.col("b")
    current = stored(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "components"
    )
    seen = _mark(current)
    while seen[0]:
        both = current.unionByName(current.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        current = stored(small.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "components")
        before, seen = seen, _mark(current)
        if before == seen:
            break
    roots = current.select(b.alias("id"), b.alias("component")).distinct()
    return current.select(a.alias("id"), b.alias("component")).unionByName(roots)
