"""Hierarchical clustering of a short list of vectors, such as those of the categories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaris.functions.vectors import DISTANCES
from lexaris.session import BROADCAST_ROWS

#: Vectors that are clustered at most; their distances, the square of it, are held on the driver.
MOST = 4096


def linked(items: DataFrame, label: str, link: str = "avg", letter: str = "u", digits: int = 9) -> DataFrame:
    """(step, a, b, d, size): the pairs of clusters joined, in order, by average, greatest or least distance.

    A cluster has the number of its vector in the order of ``label``, a joined one n, n + 1, ...
    Ties go to the smaller numbers. The list is checked to have at most MOST vectors;
    their distances are computed on the executors.
    """
    n = items.limit(min(MOST, BROADCAST_ROWS) + 1).count()
    if n > MOST:
        raise ValueError(f"more than {MOST} vectors; cluster the categories, or centres of k-means")
    one, two = items.select(F.col(label).alias("i"), "x"), items.select(F.col(label).alias("j"), F.col("x").alias("y"))
    pairs = one.crossJoin(F.broadcast(two)).where("i < j").select("i", "j", F.round(DISTANCES[letter](F.col("x"), F.col("y")), digits).alias("d"))
    names = sorted(r[label] for r in items.select(label).collect())
    number = {name: i for i, name in enumerate(names)}
    dist = np.full((n, n), np.inf)
    for r in pairs.collect():
        a, b = number[r["i"]], number[r["j"]]
        dist[a, b] = dist[b, a] = r["d"]
    ids, sizes, steps = list(range(n)), [1] * n, []
    for step in range(n - 1):
        a, b = min(((i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))), key=lambda p: (dist[p], ids[p[0]], ids[p[1]]))
        d = float(dist[a, b])
        near = {
            "avg": lambda: (sizes[a] * dist[a] + sizes[b] * dist[b]) / (sizes[a] + sizes[b]),  # noqa: B023
            "max": lambda: np.maximum(dist[a], dist[b]),  # noqa: B023
            "min": lambda: np.minimum(dist[a], dist[b]),  # noqa: B023
        }[link]()
        steps.append((step, ids[a], ids[b], d, sizes[a] + sizes[b]))
        keep = [i for i in range(len(ids)) if i not in (a, b)]
        fresh = np.full((len(keep) + 1, len(keep) + 1), np.inf)
        fresh[:-1, :-1] = dist[np.ix_(keep, keep)]
        fresh[-1, :-1] = fresh[:-1, -1] = near[keep]
        ids, sizes, dist = [ids[i] for i in keep] + [n + step], [sizes[i] for i in keep] + [sizes[a] + sizes[b]], fresh
    return items.sparkSession.createDataFrame(steps, "step int, a int, b int, d double, size int")


def cut_tree(steps: DataFrame, items: DataFrame, label: str, k: int) -> DataFrame:
    """(label, cluster): the ``k`` clusters before the last joins, numbered by their first vectors."""
    names = [r[label] for r in items.select(label).orderBy(label).collect()]
    n = len(names)
    of = {i: [i] for i in range(n)}
    for r in steps.orderBy("step").collect()[: max(0, n - k)]:
        of[n + r["step"]] = of.pop(r["a"]) + of.pop(r["b"])
    groups = sorted(sorted(g) for g in of.values())
    rows = [(names[i], c) for c, g in enumerate(groups) for i in g]
    kind = items.schema[label].dataType.simpleString()
    return items.sparkSession.createDataFrame(rows, f"{label} {kind}, cluster int")
