"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Method: centroids are fitted by spherical k-means on a bounded sample. A vector's home is the cell with the largest cosine;
it is also given to every cell whose cosine is within ``MARGIN`` of that. In a cell, vectors at home are compared with
all vectors given to it by matrix products of bounded blocks. Equal vectors are one class from the start, and a block
returns sums of links and one edge per linked vector, so copies never meet pair by pair outside a matrix.

A pair is missed only if each vector's own cell is more than ``MARGIN`` worse for the other than that one's home; at a cosine
of 0.95 and 64 dimensions that is beyond two standard deviations in both directions, and rarer the closer the vectors are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import written
from aisleworks.llm.graph import components
from aisleworks.llm.vectors import checked_vectors, matrix

#: Classes that centroids are fitted on at most, centroids at most, and fitting rounds.
SAMPLE, MOST_CELLS, ROUNDS = 16_384, 4096, 8
#: How much worse than at home a cosine with a centroid may be for a vector to be given to that cell too.
MARGIN = 0.12
BLOCK = 2048

CELLS = "rep long, copies long, dims int, data binary, home int, cells array<int>"
RESULT = "kind int, a long, b long"


def spherical_centroids(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors: assignment by largest cosine, means scaled to unit length."""
    pick = np.random.default_rng(5).permutation(len(vectors))[:cells]
    centroids = vectors[pick].copy()
    for _ in range(ROUNDS):
        home = np.concatenate([(vectors[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(vectors), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centroids)
    return centroids


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps squares in range
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fitted_cells(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by number of dimensions, about one for the square root of the classes."""
    sample = classes.orderBy(F.xxhash64(F.lit(1), "rep"), "rep").limit(SAMPLE).select("dims", "data").collect()
    counts = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    out = {}
    for dims in {r["dims"] for r in sample}:
        vectors = unit(np.frombuffer(b"".join(r["data"] for r in sample if r["dims"] == dims)).reshape(-1, dims))
        cells = min(MOST_CELLS, max(1, math.isqrt(counts.get(dims, 1))), max(1, len(vectors) // 4))
        out[dims] = spherical_centroids(vectors, cells)
    return out


def assigned(classes: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """Unit vectors with their home and all their cells. Lengths that no sampled vector has share one cell each."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for size in np.unique(dims):
                part = batch.filter(pa.array(dims == size))
                for start in range(0, part.num_rows, 4096):
                    piece = part.slice(start, 4096)
                    vectors = unit(matrix(piece.column(3), int(size)))
                    centers = shared.value.get(int(size), np.zeros((1, int(size))))
                    cosine = vectors @ centers.T
                    home = cosine.argmax(axis=1)
                    near = cosine >= cosine.max(axis=1, keepdims=True) - MARGIN
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(piece.column(i) for i in range(3)),
                            pa.array([v.tobytes() for v in vectors], pa.binary()),
                            pa.array(home.astype(np.int32)),
                            pa.array([np.flatnonzero(n).astype(np.int32) for n in near], pa.list_(pa.int32())),
                        ],
                        names=["rep", "copies", "dims", "data", "home", "cells"],
                    )

    return classes.select("rep", "copies", "dims", "data").mapInArrow(run, CELLS)


def local_labels(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each position reaches over the pairs of positions."""
    labels = ids.copy()
    while True:
        before = labels.copy()
        np.minimum.at(labels, left, before[right])
        np.minimum.at(labels, right, before[left])
        if (labels == before).all():
            return labels


def compared(block: pa.Table, least: float) -> pa.Table:
    """Kind 0: a vector and the copies linked to it in this block pair; kind 1: an edge to its smallest reached id."""
    dims = block["dims"][0].as_py()
    vectors, ids, copies = matrix(block["data"], dims), block["rep"].to_numpy(), block["copies"].to_numpy()
    home = block["home"].to_numpy()
    in_rows = np.flatnonzero(block["as_row"].to_numpy(zero_copy_only=False))
    in_columns = np.flatnonzero(block["as_column"].to_numpy(zero_copy_only=False))
    hit_rows, hit_columns = [], []
    for start in range(0, len(in_rows), 512):
        rows = in_rows[start : start + 512]
        at, to = np.nonzero(vectors[rows] @ vectors[in_columns].T >= least)
        hit_rows.append(rows[at])
        hit_columns.append(in_columns[to])
    left = np.concatenate(hit_rows) if hit_rows else np.zeros(0, dtype=np.int64)
    right = np.concatenate(hit_columns) if hit_columns else np.zeros(0, dtype=np.int64)
    # a pair that meets at both homes counts at the smaller id's
    same = home[left] == home[right]
    keep = np.where(same, ids[left] < ids[right], True)
    left, right, same = left[keep], right[keep], same[keep]
    doubtful = np.flatnonzero(~same & (ids[left] > ids[right]))
    if len(doubtful):
        cells = block["cells"].to_pylist()
        also = np.array([home[right[i]] in cells[left[i]] for i in doubtful])
        drop = np.ones(len(left), dtype=bool)
        drop[doubtful[also]] = False
        left, right = left[drop], right[drop]
    linked = np.bincount(left, weights=copies[right], minlength=len(ids)) + np.bincount(
        right, weights=copies[left], minlength=len(ids)
    )
    labels = local_labels(left, right, ids)
    counted, moved = np.flatnonzero(linked), np.flatnonzero(labels != ids)
    kind = np.repeat(np.array([0, 1], dtype=np.int32), [len(counted), len(moved)])
    a = np.concatenate([ids[counted], ids[moved]])
    b = np.concatenate([linked[counted].astype(np.int64), labels[moved]])
    return pa.table([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def near_vectors(
    table: DataFrame, least: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept`` for links of a cosine of at least ``least`` in doubles.

    Vectors that are null, empty, all zero or hold a null or non-finite component link with nothing, and so do vectors
    of different lengths. Equal vectors are linked, rows of one id are counted each. A row with a null id has no links and a
    null component and is not kept. An empty table gives no row. Other columns are not read.
    """
    checked = checked_vectors(table, id_column, vector_column)
    rows = written(checked.withColumn("key", F.md5("data")), "vectors")
    valid = rows.where("data IS NOT NULL AND vec_id IS NOT NULL")
    classes = written(
        valid.groupBy("key").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dims").alias("dims"), F.first("data").alias("data")
        ),
        "classes",
    )
    placed = written(assigned(classes, fitted_cells(classes)), "cells")

    members = placed.withColumn("cell", F.explode("cells"))
    sizes = members.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("members"))
    sizes = sizes.select(F.col("dims").alias("d"), F.col("cell").alias("c"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, (F.col("dims") == F.col("d")) & (F.col("cell") == F.col("c"))).drop("d", "c")
    members = members.withColumn("own", F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("blocks")).cast("int"))
    # a vector is a column of its block with every row block and, at home, a row of its block with every column block
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_column = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    as_row = F.transform(every, lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    places = F.when(F.col("home") == F.col("cell"), F.array_union(as_column, as_row)).otherwise(as_column)
    dealt = members.withColumn("place", F.explode(places)).select(
        "rep", "copies", "dims", "data", "home", "cells", "cell", F.col("place.i").alias("i"), F.col("place.j").alias("j"),
        ((F.col("home") == F.col("cell")) & (F.col("place.i") == F.col("own"))).alias("as_row"),
        (F.col("place.j") == F.col("own")).alias("as_column"),
    )
    found = dealt.groupBy("dims", "cell", "i", "j").applyInArrow(lambda block: compared(block, least), RESULT)
    found = written(found, "links")
    joined = components(found.where("kind = 1").select("a", "b"))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("counted")).agg(F.sum("b").alias("links"))

    # ids with several vectors tie their classes together
    keyed = classes.select(F.col("key").alias("k"), "rep", "copies")
    several = valid.groupBy("vec_id").agg(F.count_distinct("key").alias("n")).where("n > 1").select("vec_id")
    tied = valid.select("vec_id", "key").join(several, "vec_id").join(keyed, F.col("key") == F.col("k"))
    if not tied.isEmpty():
        joined = components(found.where("kind = 1").select("a", "b").union(tied.select("vec_id", "rep")))
    usable = F.col("vec_id").isNotNull()
    placed_rows = rows.select("vec_id", F.when(usable, F.col("key")).alias("key")).join(keyed, F.col("key") == F.col("k"), "left")
    roots = joined.select("node", F.col("component").alias("root"))
    out = placed_rows.join(counts, F.col("rep") == F.col("counted"), "left").join(
        roots, F.coalesce("rep", "vec_id") == F.col("node"), "left"
    )
    links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.when(usable, F.coalesce("root", "rep", "vec_id"))
    return out.select(
        "vec_id",
        links.cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
