"""Random forest of regression trees, grown level by level over blocks of binned rows.

The rows are binned once and written as blocks of a byte a row and input. A level is one job: a task walks its blocks' rows
down each tree, sums count and target by node and bin, and sends one such table a tree; the tables of the tasks are added up by
ranges of nodes, and the best split of each node reaches the driver. What a task holds depends on its blocks and on one tree's
level, and nothing is kept of a row between levels but its block: a row's place in a bootstrap sample follows from the seed,
its block and the tree. The result is a model of Spark's own class.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleworks.session import materialized, shared_folder, ship_package

# --- fixed values -----------------------------------------------------------
#: Points that a summary of an input's values keeps; inputs with fewer values are known exactly.
SUMMARY_POINTS = 1024
#: Rows of a block, at least and at most, and rows that a task holds at once.
LEAST_ROWS, MOST_ROWS, TASK_ROWS = 4096, 65_536, 1 << 22
#: Bins of inputs that are counted as one, at least and at most, and cells of such a table that stay near the processor.
LEAST_BINS, MOST_BINS, NEAR_CELLS = 64, 4096, 1 << 15
#: Nodes of a range whose tables are added up together.
NODE_RANGE = 64
#: Rows that are scored at once, and combinations of inputs' bins among them for which trees are cut down, and their least rows.
SCORED_ROWS, MOST_COMBINATIONS, COMBINATION_ROWS = 1 << 16, 32, 1000
#: Impurity that Spark states where none was measured.
UNMEASURED = -1.0
BLOCK = "block bigint, n int, bins binary, target binary"
PARTIAL = "part bigint, tree int, first int, n binary, total binary, node binary"
SPLIT = "tree int, node int, n bigint, total double, squares double, feature int, bin int, gain double, left_n bigint, left_total double"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    """What a forest is grown by."""

    trees: int
    depth: int
    least: int
    least_gain: float
    rate: float
    seed: int
    max_bins: int


def shape_of(regressor: RandomForestRegressor) -> Shape | None:
    """The estimator's parameters, or nothing if it asks for something that is left to Spark."""
    strategy = regressor.getFeatureSubsetStrategy()
    plain = regressor.getBootstrap() and regressor.getMinWeightFractionPerNode() == 0.0 and not regressor.isDefined("weightCol")
    if strategy != "all" or not plain or regressor.getMaxBins() > 256:
        return None
    return Shape(
        regressor.getNumTrees(), regressor.getMaxDepth(), regressor.getMinInstancesPerNode(), regressor.getMinInfoGain(),
        regressor.getSubsamplingRate(), regressor.getSeed() & (2**64 - 1), regressor.getMaxBins(),
    )


def fit(rows: DataFrame, inputs: list[str], target: str, regressor: RandomForestRegressor) -> RandomForestRegressionModel:
    """A model of the estimator from rows without missing values, which are read three times."""
    shape = shape_of(regressor)
    spark = rows.sparkSession
    ship_package(spark)
    values = rows.select(*[F.col(c).cast("double").alias(c) for c in inputs], F.col(target).cast("double").alias("_target"))
    count, low = values.agg(F.count(F.lit(1)), F.min("_target")).first()
    thresholds = split_points(values, inputs, min(shape.max_bins, max(count, 2)))
    tasks = spark.sparkContext.defaultParallelism
    tasks *= -(-count // (TASK_ROWS * tasks))
    block_rows = min(MOST_ROWS, max(LEAST_ROWS, -(-count // (4 * tasks))))
    blocks = binned(values, inputs, thresholds, low, block_rows).repartition(2 * tasks)
    with materialized(blocks, "forest-blocks") as kept:
        nodes = grown(kept.coalesce(tasks), [len(t) + 1 for t in thresholds], shape)
    return _as_model(spark, nodes, thresholds, low, regressor, len(inputs))


# --- bins -------------------------------------------------------------------


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """Columns of ``size`` rows, the last ones of fewer."""
    held, n = [], 0
    for batch in batches:
        held.append(_columns(batch))
        n += batch.num_rows
        while n >= size:
            whole = np.concatenate(held, axis=1)
            yield whole[:, :size]
            held, n = [whole[:, size:]], n - size
    if n:
        yield np.concatenate(held, axis=1)


def _summary(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their counts; beyond the kept points, a value stands for those below it down to the next."""
    found, place = np.unique(values, return_inverse=True)
    counts = np.bincount(place, weights=counts, minlength=len(found))
    if len(found) > SUMMARY_POINTS:
        upto = np.cumsum(counts)
        kept = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], SUMMARY_POINTS + 1)[1:]).clip(max=len(found) - 1))
        kept = np.unique(np.append(kept, [0, len(found) - 1]))
        found, counts = found[kept], np.diff(upto[kept], prepend=0)
    return found, counts


def split_points(values: DataFrame, inputs: list[str], max_bins: int) -> list[np.ndarray]:
    """Thresholds between the bins of each input, from all rows, by the rule that Spark's trees have for them."""
    width = len(inputs)

    def summarise(batches):
        found = [(np.empty(0), np.empty(0))] * width
        for columns in _gathered(batches, 1 << 18):
            for i, (v, n) in enumerate(found):
                found[i] = _summary(np.concatenate([v, columns[i]]), np.concatenate([n, np.ones(columns.shape[1])]))
        rows = [(i, v.tobytes(), n.tobytes()) for i, (v, n) in enumerate(found) if len(v)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            names=["input", "found", "times"],
        )

    parts: list[list] = [[] for _ in inputs]
    for r in values.select(*inputs).mapInArrow(summarise, "input int, found binary, times binary").collect():
        parts[r["input"]].append((np.frombuffer(r["found"]), np.frombuffer(r["times"])))
    out = []
    for found in parts:
        v, n = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0), np.empty(0))
        v, place = np.unique(v, return_inverse=True)
        out.append(_thresholds(v, np.bincount(place, weights=n, minlength=len(v)), max_bins - 1))
    return out


def _thresholds(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Midpoints between all values, or between those where the rows below come closest to equal shares."""
    between = (values[1:] + values[:-1]) / 2
    if len(between) <= most:
        return between
    stride, upto = counts.sum() / (most + 1), np.cumsum(counts)
    goal, out = stride, []
    for i in range(1, len(values)):
        if abs(upto[i - 1] - goal) < abs(upto[i] - goal):
            out.append(between[i - 1])
            goal += stride
    return np.array(out[:most])


def binned(values: DataFrame, inputs: list[str], thresholds: list[np.ndarray], low: float, block_rows: int) -> DataFrame:
    """Blocks of rows: one byte a row and input, input after input, and the targets above the lowest."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, columns in enumerate(_gathered(batches, block_rows)):
            bins = np.stack([np.searchsorted(t, columns[i]).astype(np.uint8) for i, t in enumerate(thresholds)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + number], pa.int64()),
                    pa.array([columns.shape[1]], pa.int32()),
                    pa.array([bins.tobytes()], pa.binary()),
                    pa.array([(columns[-1] - low).tobytes()], pa.binary()),
                ],
                names=["block", "n", "bins", "target"],
            )

    return values.select(*inputs, "_target").mapInArrow(run, BLOCK)


# --- growing ----------------------------------------------------------------


def _joined(sizes: list[int], most: int) -> list[list[int]]:
    """Inputs that are counted together, so that a row is counted once for several inputs of few bins."""
    groups: list[tuple[int, list[int]]] = []
    for i in sorted((i for i, size in enumerate(sizes) if size > 1), key=lambda i: -sizes[i]):
        for k, (cells, members) in enumerate(groups):
            if cells * sizes[i] <= most:
                groups[k] = (cells * sizes[i], [*members, i])
                break
        else:
            groups.append((sizes[i], [i]))
    return [members for _, members in groups]


def _draw_bounds(rate: float) -> np.ndarray:
    """A row is in a bootstrap sample as often as its 16 random bits reach one of these."""
    chance, upto = np.exp(-rate), []
    total = chance
    for k in range(1, 256):
        upto.append(total)
        chance *= rate / k
        total += chance
    bounds = np.rint(np.array(upto) * (1 << 16))
    return bounds[bounds < 1 << 16].astype(np.uint16)


def _drawn(seed: int, block: int, tree: int, n: int, bounds: np.ndarray) -> np.ndarray:
    """How often each row of a block is in a tree's sample."""
    rng = np.random.Generator(np.random.SFC64([seed, block, tree]))
    bits = rng.integers(0, 2**64 - 1, -(-n // 4), dtype=np.uint64, endpoint=True).view(np.uint16)[:n]
    times = np.zeros(n, np.uint8)
    for bound in bounds:
        times += (bits >= bound).view(np.uint8)
    return times


class _Block:
    """A block's rows, ready to be counted."""

    def __init__(self, number: int, n: int, bins: bytes, target: bytes, sizes: list[int], groups: list[list[int]]):
        self.number, self.n = number, n
        self.flat = np.frombuffer(bins, np.uint8)
        self.target = np.frombuffer(target)
        by_input = self.flat.reshape(len(sizes), n)
        self.codes = []
        for members in groups:
            cells = int(np.prod([sizes[i] for i in members]))
            code = by_input[members[0]].astype(np.uint8 if cells <= 256 else np.uint16)
            for i in members[1:]:
                code *= code.dtype.type(sizes[i])
                code += by_input[i]
            self.codes.append(code)


def _packing(blocks: list[_Block], most_times: int) -> float | None:
    """A factor by which a count and a sum of whole targets share one exact double, if there is one."""
    total, rows = 0.0, 0
    for block in blocks:
        if not (block.target == np.floor(block.target)).all():
            return None
        total, rows = total + float(block.target.sum()), rows + block.n
    factor = 2.0 ** (int(np.ceil(np.log2(total * most_times + 2))) + 1)
    return factor if factor * (rows * most_times + 1) < 2.0**53 else None


def _counted(blocks: list[_Block], walks: list, sizes: list[int], groups: list[list[int]], bounds: np.ndarray, seed: int) -> Iterator[tuple]:
    """Of each tree that still grows: its number and, by node and bin, rows and sums of targets; then the same by node.

    The arrays of a block's rows are kept and filled again; new ones would cost more than what is computed.
    """
    most, factor = max(sizes, default=1), _packing(blocks, len(bounds))
    cells = [int(np.prod([sizes[i] for i in members])) for members in groups] or [1]
    longest = max(b.n for b in blocks)
    numbers = np.arange(longest)
    whole = [np.empty(longest, np.intp) for _ in range(4)]
    real = [np.empty(longest) for _ in range(3)]
    small = {kind: np.empty(longest, kind) for kind in (np.dtype(np.uint8), np.dtype(np.uint16))}
    for tree, (steps, alive) in enumerate(walks):
        if not alive:
            continue
        tables = []
        for feature, split, left, right in steps:
            beyond = np.arange(most)[None, :] > split[:, None]
            tables.append((feature.astype(np.intp), np.where(beyond, right[:, None], left[:, None]).astype(np.intp).ravel()))
        sums = [np.zeros((1 if factor else 2, (alive + 1) * c)) for c in cells]
        squares = np.zeros(alive + 1)
        for block in blocks:
            drawn = _drawn(seed, block.number, tree, block.n, bounds)
            n = int(np.count_nonzero(drawn))
            rows, node, place, spare = (x[:n] for x in whole)
            weight, total, packed = (x[:n] for x in real)
            byte = small[np.dtype(np.uint8)][:n]
            np.compress(drawn > 0, numbers[: block.n], out=rows)
            node[:] = 0
            for feature, after in tables:
                (feature * block.n).take(node, out=place, mode="clip")
                place += rows
                block.flat.take(place, out=byte, mode="clip")
                node *= most
                node += byte
                after.take(node, out=spare, mode="clip")
                node, spare = spare, node
            drawn.take(rows, out=byte, mode="clip")
            weight[:] = byte
            block.target.take(rows, out=packed, mode="clip")
            np.multiply(weight, packed, out=total)
            packed *= total
            np.add.at(squares, node, packed)
            if factor:
                weight *= factor
                weight += total
            for k, size in enumerate(cells):
                np.multiply(node, size, out=place)
                if groups:
                    code = block.codes[k].take(rows, out=small[block.codes[k].dtype][:n], mode="clip")
                    place += code
                np.add.at(sums[k][0], place, weight)
                if not factor:
                    np.add.at(sums[k][1], place, total)
        parts = []
        for k, size in enumerate(cells):
            pair = tuple(sums[k])
            if factor:
                count = np.floor(pair[0] / factor)
                pair = (count, pair[0] - count * factor)
            parts.append([x.reshape(alive + 1, size)[:alive] for x in pair])
        by_input = [None] * len(sizes)
        for members, pair in zip(groups, parts):
            for at, i in enumerate(members):
                others = tuple(1 + o for o in range(len(members)) if o != at)
                by_input[i] = [x.reshape(alive, *[sizes[m] for m in members]).sum(axis=others) for x in pair]
        used = [pair for pair in by_input if pair is not None]
        n, total = (np.concatenate([pair[j] for pair in used], axis=1) if used else np.zeros((alive, 0)) for j in (0, 1))
        yield tree, n, total, np.stack([parts[0][0].sum(axis=1), parts[0][1].sum(axis=1), squares[:alive]], axis=1)


def _partials(walks: list, sizes: list[int], groups: list[list[int]], shape: Shape):
    """Function over blocks that gives each tree's tables by ranges of nodes."""
    bounds, seed, depth = _draw_bounds(shape.rate), shape.seed, 1 << shape.depth

    def sent(blocks):
        for tree, n, total, node in _counted(blocks, walks, sizes, groups, bounds, seed):
            firsts = range(0, len(node), NODE_RANGE)
            pick = [slice(f, f + NODE_RANGE) for f in firsts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree * depth + f for f in firsts], pa.int64()),
                    pa.array([tree] * len(pick), pa.int32()),
                    pa.array(list(firsts), pa.int32()),
                    pa.array([n[s].astype(np.uint32).tobytes() for s in pick], pa.binary()),
                    pa.array([total[s].tobytes() for s in pick], pa.binary()),
                    pa.array([node[s].tobytes() for s in pick], pa.binary()),
                ],
                names=["part", "tree", "first", "n", "total", "node"],
            )

    def run(batches):
        blocks, n = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                blocks.append(_Block(*row, sizes, groups))
                n += row[1]
                if n >= TASK_ROWS:
                    yield from sent(blocks)
                    blocks, n = [], 0
        if blocks:
            yield from sent(blocks)

    return run


def _best(sizes: list[int], shape: Shape):
    """Function over the tables of a range of nodes that gives each node's best split."""
    used = [i for i, size in enumerate(sizes) if size > 1]
    width = sum(sizes[i] for i in used)

    def run(table: pa.Table) -> pa.Table:
        n = total = node = 0
        for one, two, three in zip(table["n"], table["total"], table["node"]):
            n = n + np.frombuffer(one.as_buffer(), np.uint32).astype(np.float64).reshape(-1, width)
            total = total + np.frombuffer(two.as_buffer()).reshape(-1, width)
            node = node + np.frombuffer(three.as_buffer()).reshape(-1, 3)
        rows, whole, squares = node.T
        gain, feature, place = np.full(len(node), -1.0), np.full(len(node), -1), np.zeros(len(node), int)
        left_n, left_total = np.zeros(len(node)), np.zeros(len(node))
        at, each = 0, np.arange(len(node))
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = squares / rows - (whole / rows) ** 2
            for i in used:
                ln, lt = (np.cumsum(x[:, at : at + sizes[i]], axis=1)[:, :-1] for x in (n, total))
                at += sizes[i]
                rn, rt = rows[:, None] - ln, whole[:, None] - lt
                found = (lt**2 / ln + rt**2 / rn - (whole**2 / rows)[:, None]) / rows[:, None]
                found = np.where((ln >= shape.least) & (rn >= shape.least), found, -1.0)
                best = found.argmax(axis=1)
                better = found[each, best] > gain
                for out, new in ((gain, found[each, best]), (feature, i), (place, best), (left_n, ln[each, best]), (left_total, lt[each, best])):
                    out[better] = new[better] if isinstance(new, np.ndarray) else new
        # a gain that is no more than what rounding leaves is none
        none = ~(gain > np.maximum(1e-12 * np.abs(squares / np.maximum(rows, 1)), 0)) | (gain < shape.least_gain) | ~(impurity > 1e-12)
        feature[none] = -1
        tree, first = table["tree"][0].as_py(), table["first"][0].as_py()
        columns = [np.full(len(node), tree), first + each, rows, whole, squares, feature, place, gain, left_n, left_total]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64()]
        names = [field.split()[0] for field in SPLIT.split(", ")]
        return pa.table([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=names)

    return run


def _places(tree: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of their trees: each one's number in its tree, and how many a tree has."""
    counts = np.bincount(tree, minlength=trees)
    return np.arange(len(tree)) - (np.cumsum(counts) - counts)[tree], counts


def grown(blocks: DataFrame, sizes: list[int], shape: Shape) -> dict[str, np.ndarray]:
    """The nodes of all trees, numbered within each, parents before children; sums are of targets above the lowest."""
    trees = shape.trees
    steps: list[list] = [[] for _ in range(trees)]
    alive = np.ones(trees, int)  # nodes of this level that may be split
    ids = np.zeros(trees, int)  # their numbers, tree after tree
    made = np.ones(trees, int)
    out: list[dict[str, np.ndarray]] = []
    for level in range(max(shape.depth, 1)):
        walks = [(steps[t], int(alive[t])) for t in range(trees)]
        groups = _joined(sizes, min(MOST_BINS, max(LEAST_BINS, NEAR_CELLS // (int(alive.max()) + 1))))
        sums = blocks.mapInArrow(_partials(walks, sizes, groups, shape), PARTIAL)
        found = sums.groupBy("part").applyInArrow(_best(sizes, shape), SPLIT).toArrow()
        found = {name: found[name].to_numpy() for name in found.column_names}
        order = np.lexsort((found["node"], found["tree"]))
        found = {name: column[order] for name, column in found.items()}
        tree = found["tree"]
        split = (found["feature"] >= 0) & (level < shape.depth)
        parent, (number, splits) = tree[split], _places(tree[split], trees)
        left, right = np.full(len(tree), -1), np.full(len(tree), -1)
        left[split] = made[parent] + 2 * number
        right[split] = left[split] + 1
        made += 2 * splits
        feature = np.where(split, found["feature"], -1)
        out.append({"tree": tree, "id": ids, "left": left, "right": right, "feature": feature, "bin": found["bin"], "gain": found["gain"],
                    "n": found["n"], "total": found["total"], "squares": found["squares"]})
        # children, left and right of a parent next to each other
        ln, lt = found["left_n"][split], found["left_total"][split]
        children = {
            "tree": np.repeat(parent, 2),
            "id": np.stack([left[split], right[split]], axis=1).ravel(),
            "n": np.stack([ln, found["n"][split] - ln], axis=1).ravel(),
            "total": np.stack([lt, found["total"][split] - lt], axis=1).ravel(),
        }
        grows = (children["n"] >= 2 * shape.least) & (children["n"] >= 2) & (level + 1 < shape.depth)
        ends = {name: column[~grows] for name, column in children.items()}
        nothing = np.full(len(ends["tree"]), -1)
        out.append({**ends, "left": nothing, "right": nothing, "feature": nothing, "bin": nothing, "gain": nothing.astype(float), "squares": np.full(len(nothing), np.nan)})
        # where a row of a node goes, with one more node for rows that have arrived
        next_place, next_alive = _places(children["tree"][grows], trees)
        goes = next_alive[children["tree"]]
        goes[grows] = next_place
        to_left, to_right = (np.full(len(tree), 0) for _ in range(2))
        to_left[split], to_right[split] = goes[0::2], goes[1::2]
        ended = next_alive[tree]
        to_left, to_right = np.where(split, to_left, ended), np.where(split, to_right, ended)
        starts = np.searchsorted(tree, np.arange(trees + 1))
        for t in range(trees):
            s = slice(starts[t], starts[t + 1])
            end = np.array([next_alive[t]])
            steps[t].append((
                np.append(np.maximum(feature[s], 0), 0).astype(np.int16), np.append(found["bin"][s], 0).astype(np.uint8),
                np.append(to_left[s], end).astype(np.int32), np.append(to_right[s], end).astype(np.int32),
            ))
        alive, ids = next_alive, children["id"][grows]
        if not alive.any():
            break
    return {name: np.concatenate([part[name] for part in out]) for name in out[0]}


# --- the model --------------------------------------------------------------


def _described(kind: str, uid: str, regressor: RandomForestRegressor, leave_out=(), **more) -> str:
    values = {"paramMap": {}, "defaultParamMap": {}}
    for param in regressor.params:
        if param.name in leave_out:
            continue
        if regressor.isSet(param):
            values["paramMap"][param.name] = regressor.getOrDefault(param)
        if regressor.hasDefault(param):
            values["defaultParamMap"][param.name] = regressor._defaultParamMap[param]
    version = SparkSession.active().version
    base = {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": version, "uid": uid}
    return json.dumps(base | values | more)


def _as_model(spark: SparkSession, nodes: dict, thresholds: list[np.ndarray], low: float, regressor, width: int) -> RandomForestRegressionModel:
    """The nodes as a model of Spark's, by way of its saved form. The impurity of a leaf is stated where it was measured."""
    n = nodes["n"].astype(float)
    mean = nodes["total"] / n
    impurity = np.where(np.isnan(nodes["squares"]), UNMEASURED, np.maximum(nodes["squares"] / n - mean**2, 0.0))
    squares = np.nan_to_num(nodes["squares"]) + 2 * low * nodes["total"] + low * low * n
    threshold = np.array([thresholds[f][b] if f >= 0 else 0.0 for f, b in zip(nodes["feature"], nodes["bin"])], float)
    gain = np.where(nodes["feature"] >= 0, nodes["gain"], -1.0)
    flat = pa.table({
        "tree": nodes["tree"].astype(np.int32), "id": nodes["id"].astype(np.int32), "prediction": mean + low, "impurity": impurity,
        "n": nodes["n"].astype(np.int64), "total": nodes["total"] + low * n, "squares": squares, "gain": gain,
        "left": nodes["left"].astype(np.int32), "right": nodes["right"].astype(np.int32),
        "feature": nodes["feature"].astype(np.int32), "threshold": threshold,
    })
    inner = F.col("feature") >= 0
    where = F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>"))
    split = F.struct(F.col("feature").alias("featureIndex"), where.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct(
        "id", "prediction", "impurity", F.array(F.col("n").cast("double"), "total", "squares").alias("impurityStats"), F.col("n").alias("rawCount"),
        "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    trees = int(nodes["tree"].max()) + 1
    path = f"{shared_folder(spark)}/forest-model-{uuid.uuid4().hex}"
    whole = _described("RandomForestRegressionModel", regressor.uid, regressor, numFeatures=width, numTrees=trees)
    of_forest = ("bootstrap", "numTrees", "subsamplingRate", "featureSubsetStrategy")
    each = [(t, _described("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", regressor, of_forest), 1.0) for t in range(trees)]
    try:
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(flat).select(F.col("tree").alias("treeID"), node.alias("nodeData")).coalesce(1).write.parquet(f"{path}/data")
        return RandomForestRegressionModel.load(path)
    finally:
        _without(spark, path)


def _without(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


# --- scoring ----------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Nodes by their numbers: the input they ask for (none: -1) and its threshold's place, children, and the leaf's value."""

    feature: np.ndarray
    place: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def trees_of(model: RandomForestRegressionModel) -> tuple[list[Tree], list[np.ndarray]] | None:
    """The model's trees and each input's thresholds, by way of its saved form; nothing if a split is not by a threshold."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/forest-model-{uuid.uuid4().hex}"
    try:
        model.write().save(path)
        n = F.col("nodeData")
        saved = spark.read.parquet(f"{path}/data").select(
            "treeID", n.id.alias("id"), n.prediction.alias("value"), n.leftChild.alias("left"), n.rightChild.alias("right"),
            n.split.featureIndex.alias("feature"), F.get(n.split.leftCategoriesOrThreshold, 0).alias("threshold"),
            n.split.numCategories.alias("categories"),
        ).orderBy("treeID", "id").toArrow()
    finally:
        _without(spark, path)
    c = {name: saved[name].to_numpy() for name in saved.column_names}
    if (c["categories"] != -1).any():
        return None
    inner = c["feature"] >= 0
    thresholds = [np.unique(c["threshold"][inner & (c["feature"] == i)]) for i in range(model.numFeatures)]
    place = np.zeros(len(inner), np.intp)
    for i, cuts in enumerate(thresholds):
        mine = inner & (c["feature"] == i)
        place[mine] = np.searchsorted(cuts, c["threshold"][mine])
    starts = np.searchsorted(c["treeID"], np.arange(c["treeID"].max() + 2))
    spans = [slice(a, b) for a, b in zip(starts, starts[1:])]
    return [Tree(c["feature"][s], place[s], c["left"][s], c["right"][s], c["value"][s]) for s in spans], thresholds


def _cut_down(tree: Tree, fixed: dict[int, int], most: int) -> tuple:
    """What is left of a tree where some inputs' bins are known: inputs of its nodes, where a bin leads, values, and its depth."""
    jump = np.arange(len(tree.feature))
    for feature, b in fixed.items():
        known = tree.feature == feature
        jump[known] = np.where(b <= tree.place[known], tree.left[known], tree.right[known])
    for _ in range(len(bin(len(jump)))):
        jump = jump[jump]
    level, levels = jump[:1], [jump[:1]]
    while True:
        inner = level[tree.feature[level] >= 0]
        if not len(inner):
            break
        level = np.concatenate([jump[tree.left[inner]], jump[tree.right[inner]]])
        levels.append(level)
    ids = np.concatenate(levels)
    label = np.zeros(len(jump), np.intp)
    label[ids] = np.arange(len(ids))
    feature = tree.feature[ids]
    stays = feature < 0
    left = np.where(stays, label[ids], label[jump[tree.left[ids]]])
    right = np.where(stays, label[ids], label[jump[tree.right[ids]]])
    goes = np.where(np.arange(most)[None, :] <= tree.place[ids][:, None], left[:, None], right[:, None])
    return np.maximum(feature, 0).astype(np.intp), goes.astype(np.int32).ravel(), tree.value[ids], len(levels) - 1


def _combinations(bins: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Inputs of which the rows have few combinations of bins, and the number of each row's."""
    n = bins.shape[1]
    code, count, members = np.zeros(n, np.intp), 1, []
    for i in np.argsort([len(np.unique(b)) for b in bins], kind="stable"):
        found, next_code = np.unique(code * (int(bins[i].max()) + 1) + bins[i], return_inverse=True)
        if len(found) > max(1, min(MOST_COMBINATIONS, n // COMBINATION_ROWS)):
            break
        code, count = next_code, len(found)
        members.append(int(i))
    return members, code


def scorer(trees: list[Tree], thresholds: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Function that gives the mean of the trees' values for columns of inputs, added in the trees' order as Spark does.

    Rows are dealt by inputs of which few combinations occur (a forecast day's calendar), and walk trees cut down to what
    those leave open. Trees of a combination are kept.
    """
    most = max(len(t) for t in thresholds) + 1
    kept: dict[tuple, list[tuple]] = {}

    def score(columns: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(t, c) for t, c in zip(thresholds, columns)])
        members, code = _combinations(bins)
        out = np.empty(bins.shape[1])
        for number in range(code.max() + 1 if len(code) else 0):
            rows = np.flatnonzero(code == number)
            known = {i: int(bins[i, rows[0]]) for i in members}
            key = tuple(sorted(known.items()))
            if key not in kept:
                if len(kept) >= 2 * MOST_COMBINATIONS:
                    kept.clear()
                kept[key] = [_cut_down(tree, known, most) for tree in trees]
            n = len(rows)
            flat = bins[:, rows].astype(np.uint8 if most <= 256 else np.uint32).ravel()
            numbers, place, total = np.arange(n), np.empty(n, np.intp), np.zeros(n)
            byte, at, value = np.empty(n, flat.dtype), np.empty(n, np.int32), np.empty(n)
            for feature, goes, values, depth in kept[key]:
                starts = feature * n
                node = np.zeros(n, np.intp)
                for _ in range(depth):
                    starts.take(node, out=place, mode="clip")
                    place += numbers
                    flat.take(place, out=byte, mode="clip")
                    node *= most
                    node += byte
                    goes.take(node, out=at, mode="clip")
                    node[:] = at
                values.take(node, out=value, mode="clip")
                total += value
            out[rows] = total / len(trees)
        return out

    return score


def predicted(model: RandomForestRegressionModel, inputs: list[str], rows: DataFrame, output: str) -> DataFrame | None:
    """Rows with the model's prediction, equal to what its ``transform`` gives; nothing where that has to be asked."""
    found = trees_of(model)
    if found is None:
        return None
    trees, thresholds = found
    ship_package(rows.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        run = scorer(trees, thresholds)

        def done(held):
            scores = run(np.concatenate([x for _, x in held], axis=1))
            for at, (n, _) in zip(np.cumsum([0, *[n for n, _ in held]]), held):
                yield pa.array(scores[at : at + n])

        held, n = [], 0
        for columns in batches:
            if any(c.null_count for c in columns):
                raise ValueError("a row without all inputs can't be scored")
            held.append((len(columns[0]), np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])))
            n += len(columns[0])
            if n >= SCORED_ROWS:
                yield from done(held)
                held, n = [], 0
        if held:
            yield from done(held)

    return rows.withColumn(output, score(*[F.col(c).cast("double") for c in inputs]))
