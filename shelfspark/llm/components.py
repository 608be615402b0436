"""Connected components of an edge table, by rounds of one shuffle each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.shared import discard, stored
from shelfspark.shipping import map_arrow

#: Edges of one id that a task takes; an id with more is dealt to several.
HOT_EDGES = 1_000_000
#: Edges for which another task is used, and the least tasks: few tasks shorten paths in fewer rounds.
PLACE_EDGES, LEAST_PLACES = 100_000, 6


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every id to the smallest id that these edges connect it with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        np.minimum.at(label, x, before[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _round(edges: DataFrame, hot: DataFrame | None, parts: int) -> DataFrame:
    """(a, b, changed): the edges of every partition pulled to the smallest ids, all edges of an id being in one place.

    An edge goes to the places of both its ends. A hot id has several: the edges that come into it are spread over them,
    and its own edge goes to each. A place passes on the edges of the ids that it owns, and what others do not know yet.
    """
    ends = edges.select(F.col("a").alias("key"), F.lit(True).alias("own"), "a", "b").unionAll(edges.select(F.col("b").alias("key"), F.lit(False).alias("own"), "a", "b"))
    if hot is None:
        dealt = ends.repartition("key")
    else:
        spread = ends.join(F.broadcast(hot), "key", "left")
        places = F.when(F.col("places").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).otherwise(F.array(F.pmod(F.xxhash64("a"), "places")))
        dealt = spread.select("key", F.explode(places).alias("place"), "own", "a", "b").repartition("key", "place")

    def run(batches):
        held = [[np.asarray(c) for c in batch.columns] for batch in batches if batch.num_rows]
        if not held:
            return
        a, b, own = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
        given = np.unique(np.stack([a, b], 1), axis=0)
        x, y = forest(given[:, 0], given[:, 1])
        # forest's ids are sorted and single, as are the rows of given: an edge is given if a row equals it
        place = np.searchsorted(given[:, 0], x, "left")
        known = (given[np.minimum(place, len(given) - 1)] == np.stack([x, y], 1)).all(1)
        one = np.searchsorted(given[:, 0], x, "right") - place == 1
        changed = not (known & one).all()
        keep = np.isin(x, a[own]) | ~known
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep]), pa.array(np.full(int(keep.sum()), changed))], names=["a", "b", "changed"])

    rows = dealt.select("a", "b", "own")
    return map_arrow(rows.coalesce(parts) if hot is None else rows, run, "a long, b long, changed boolean")


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every id of edges(a, b): the smallest id that links reach.

    A round pulls the edges of each partition to the smallest ids they connect; paths shorten by half at least. It ends
    when no partition changed anything. Edges are written after every round; nothing is collected. No edges give an empty table.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    last = edges
    while True:
        hot, n = None, edges.count()
        if n > HOT_EDGES:
            hot = edges.groupBy(F.col("b").alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_EDGES).select("key", F.ceil(F.col("n") * 2 / HOT_EDGES).alias("places"))
        moved = stored(_round(edges, hot, max(LEAST_PLACES, -(-n // PLACE_EDGES))), f"{name}-edges")
        discard(last)
        edges, last = moved.select("a", "b"), moved
        if not moved.where("changed").limit(1).count():
            break
    # now every id that is not the smallest has one edge
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
