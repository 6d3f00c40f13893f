"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisflow.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """doc and comp, the smallest document reachable, for every document in `links` (a, b).

    Every round is a table in the shared folder. A document with very many links costs no more than
    its share: minima are combined before they move, and the join on a linked document is between two
    plain shuffles, which Spark splits where a key is hot.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        theirs = labels.select(F.col("doc").alias("b"), F.col("comp").alias("near"))
        nearest = both.join(theirs, "b").groupBy(F.col("a").alias("doc")).agg(F.min("near").alias("near"))
        moved = written(labels.join(nearest, "doc").select("doc", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "labels")
        hop = moved.select(F.col("doc").alias("comp"), F.col("comp").alias("far"))
        after = written(moved.join(hop, "comp", "left").select("doc", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        if after.filter("old <> comp").isEmpty():
            return after.select("doc", "comp")
        labels = after.select("doc", "comp")
