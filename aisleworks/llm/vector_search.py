"""Approximate nearest neighbours by collision counting on single-projection sorted arrays.

Method: every block of vectors is projected on random lines, one sorted array per line. A query's window on each line
starts around its own projection and widens by virtual rehashing: from one radius to the next only the newly covered
stretches of the arrays are counted. A vector whose windows cover it on enough lines is verified by its distance. A query
is done in a block when enough verified vectors lie well inside the radius, or all are verified. Blocks' nearest are then
merged; every block of vectors meets every block of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisleworks.llm.common import written
from aisleworks.llm.vectors import checked_vectors, matrix

LINES = 64
#: Half the window's width in radii, growth of the radius, share of lines that must collide, and how far inside the
#: radius the wanted neighbours must lie to end a search.
HALF_WIDTH, GROWTH, COLLISIONS, INSIDE = 1.36, 1.25, 0.775, 1.15
BLOCKS, LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 24, 2048, 65_536, 4096
FOUND = "query_id long, vec_id long, score double"


class SortedLines:
    """Projections of a block on each line, sorted, with the rows they belong to.

    The lines' arrays lie one behind the other, each shifted into a stretch of its own, so one binary search finds the
    window ends of a query on all lines.
    """

    def __init__(self, vectors: np.ndarray, lines: np.ndarray):
        self.vectors = vectors
        projected = (vectors @ lines).T
        self.least, self.most = projected.min() - 1, projected.max() + 1
        self.shift = np.arange(lines.shape[1]) * (self.most - self.least + 2) - self.least
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32).ravel()
        self.sorted = (np.sort(projected, axis=1) + self.shift[:, None]).ravel()

    def _ends(self, at: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(self.sorted, np.clip(at, self.least, self.most) + self.shift, side=side)

    def nearest(
        self, query: np.ndarray, at: np.ndarray, wanted: int, first_radius: float, others: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of what was verified for a query with projections ``at``; only ``others`` count as found."""
        rows = len(self.vectors)
        needed = math.ceil(COLLISIONS * len(at))
        counts = np.zeros(rows, dtype=np.int64)
        distance = np.full(rows, np.inf)
        verified = np.zeros(rows, dtype=bool)
        low = high = self._ends(at, "left")
        radius = first_radius
        while True:
            new_low = self._ends(at - HALF_WIDTH * radius, "left")
            new_high = self._ends(at + HALF_WIDTH * radius, "right")
            starts = np.concatenate([new_low, high])
            sizes = np.concatenate([low - new_low, new_high - high])
            before = np.cumsum(sizes) - sizes
            covered = np.arange(sizes.sum()) + np.repeat(starts - before, sizes)
            counts += np.bincount(self.order[covered], minlength=rows)
            low, high = new_low, new_high
            fresh = np.flatnonzero((counts >= needed) & ~verified)
            if len(fresh):
                difference = self.vectors[fresh] - query
                distance[fresh] = np.sqrt((difference * difference).sum(axis=1))
                verified[fresh] = True
            if verified.all() or (others & (distance <= radius / INSIDE)).sum() >= wanted:
                found = np.flatnonzero(verified)
                return found, distance[found]
            radius *= GROWTH


def search_block(data: pa.Table, queries: pa.Table, wanted: int) -> pa.Table:
    """The nearest found of each query of a block among the vectors of a block."""
    found: list[tuple[int, int, float]] = []
    if data.num_rows and queries.num_rows:
        dims = data["dims"][0].as_py()
        vectors, points = matrix(data["data"], dims), matrix(queries["data"], dims)
        ids, query_ids = data["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        lines = np.random.default_rng(dims).standard_normal((dims, LINES))
        index = SortedLines(vectors, lines)
        scale = float(np.sqrt(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
        for query, own, at in zip(points, query_ids, points @ lines, strict=True):
            others = ids != own
            rows, distances = index.nearest(query, at, wanted, scale / 8, others)
            rows, distances = rows[others[rows]], distances[others[rows]]
            best = np.lexsort((ids[rows], distances))[:wanted]
            found += [(int(own), int(ids[r]), float(d)) for r, d in zip(rows[best], distances[best], strict=True)]
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])


def nearest_vectors(
    table: DataFrame, is_query: Column, wanted: int = 10, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Per query its ``wanted`` nearest found: ``query_id, rank, vec_id, score`` (Euclidean distance in doubles).

    ``is_query`` is a condition on ``vec_id``. Vectors that are null, empty, all zero or hold a null or non-finite
    component, and rows with a null id, take no part; vectors are only compared with those of their own length. A query
    never finds rows of its own id; repeated rows count once. Ties go to the smaller ``vec_id``; a query without
    candidates gives no row, as does an empty table. Other columns are not read.
    """
    checked = checked_vectors(table, id_column, vector_column).where("data IS NOT NULL AND vec_id IS NOT NULL")
    valid = written(checked.distinct(), "vectors")
    queries = valid.where(is_query)
    rows = valid.count()
    block = min(MOST_BLOCK, max(LEAST_BLOCK, -(-rows // BLOCKS)))
    blocks = max(1, -(-rows // block))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    salt = F.xxhash64(F.lit(3), "vec_id")
    dealt = valid.withColumn("block", F.pmod(salt, F.lit(blocks))).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    asked = queries.withColumn("query_block", F.pmod(salt, F.lit(query_blocks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    )
    keys = ("dims", "block", "query_block")
    pairs = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys))
    found = pairs.applyInArrow(lambda data, points: search_block(data, points, wanted), FOUND)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= wanted)
    return ranked.select("query_id", "rank", "vec_id", "score")
