"""Connected components of an edge table by repeated contraction.

Every round lets each vertex choose its smallest neighbour (or itself), follows those choices to
their roots by pointer doubling and keeps only the edges between different roots.  All state lives
in tables of the shared folder; the driver only learns whether a table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _roots(parents: DataFrame) -> DataFrame:
    """(v, root) from (v, root) where root <= v, following the chain to its end."""
    while True:
        up = parents.select(F.col("v").alias("_root"), F.col("root").alias("_next"))
        jumped = parents.join(up, F.col("root") == F.col("_root"), "left").select(
            "v",
            F.coalesce("_next", "root").alias("root"),
            (F.coalesce("_next", "root") != F.col("root")).alias("moved"),
        )
        jumped = saved(jumped, "roots")
        parents = jumped.select("v", "root")
        if jumped.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: longs); root is the smallest vertex reached.

    Self loops, repeated edges and either direction are allowed; an empty edge table gives an
    empty result.  Null ends are ignored.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = saved(e.filter("a < b").distinct(), "edges")
    found = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("_m"))
        parents = saved(parents.select("v", F.least("v", "_m").alias("root")), "parents")
        roots = _roots(parents)
        if found is None:
            found = roots
        else:
            r = roots.select(F.col("v").alias("_v"), F.col("root").alias("_r"))
            found = saved(
                found.join(r, F.col("root") == F.col("_v"), "left").select(
                    "v", F.coalesce("_r", "root").alias("root")
                ),
                "found",
            )
        ra = roots.select(F.col("v").alias("a"), F.col("root").alias("_ra"))
        rb = roots.select(F.col("v").alias("b"), F.col("root").alias("_rb"))
        e = e.join(ra, "a").join(rb, "b").filter("_ra <> _rb")
        e = saved(e.select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).distinct(), "edges")
    if found is None:
        return edges.sparkSession.createDataFrame([], "v long, root long")
    return found
