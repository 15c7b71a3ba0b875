"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored


def components(edges: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(``within``, id, label) for every id in ``edges`` (``within``, a, b: long): ``label`` is the smallest id reachable.

    Ids of different ``within`` (say, tenants) have nothing to do with each other. Each round takes the smallest label among a
    node's neighbours, then the label of that label, and writes the labels to the shared folder (those of the round before
    go); the rounds grow with the logarithm of a component's diameter. Messages are map-side combined, so a hub with very many
    links sends one row per task.
    """
    w = list(within)
    links = stored(edges.select(*w, "a", "b").union(edges.select(*w, F.col("b"), F.col("a"))).filter("a <> b").distinct())
    kept = stored(links.groupBy(*w, F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        labels = kept.select(*w, "id", "label")
        heard = links.join(labels.withColumnRenamed("id", "b"), [*w, "b"]).groupBy(*w, F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, [*w, "id"], "left").select(*w, "id", F.least("label", "heard").alias("label"), F.col("label").alias("before"))
        up = labels.select(*w, F.col("id").alias("label"), F.col("label").alias("above"))
        following = stored(lower.join(up, [*w, "label"], "left").select(*w, "id", F.least("label", "above").alias("label"), "before"))
        moved = following.filter("label <> before").limit(1).count()
        discard(kept)
        kept = following
        if not moved:
            discard(links)
            return kept.select(*w, "id", "label")
