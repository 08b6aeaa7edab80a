"""A random forest whose trees are grown, kept and applied by the executors.

MLlib sends the sums of all bins of every node from every partition, and holds all
nodes on the driver. In a deep forest nodes are as many as rows times trees, so both
are far larger than the rows. Here only nodes of more than ``GROUP_ROWS`` rows are
split by such sums. The rows of a smaller one meet in one task, which grows the
rest of its tree. Trees are rows of a table; the driver holds the few nodes at their top.

Settings come from the MLlib estimator and mean the same: Poisson weights, cuts at
quantiles, a random choice of columns per node, the least sum of squares. Every draw
is a hash of seed, tree, node or row, and sums that decide are of whole numbers, so
no result depends on how the rows are dealt.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorframe.session import stage_table

# A node of more rows is split by sums over all partitions.
GROUP_ROWS = 50_000
QUANTILE_ERROR = 1e-3
SUBTREE = (
    "tree int, node int, feature array<int>, cut array<int>, left array<int>, value array<double>, weights array<double>"
)
_POISSON = np.cumsum(np.exp(-1.0) / np.array([math.factorial(i) for i in range(12)]))


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of whole numbers (splitmix64)."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            h = h ^ np.asarray(part).astype(np.int64).view(np.uint64)
            h = h + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


@dataclass(frozen=True)
class Plan:
    """What every task must know: settings, cuts per column, and how labels become whole numbers."""

    trees: int
    depth: int
    least: int
    tried: int
    seed: int
    cuts: list[np.ndarray]
    rows: int
    center: float
    scale: float
    quantum: float

    @property
    def bins(self) -> int:
        return max((len(c) for c in self.cuts), default=0) + 1

    def weights(self, tree: int, key: np.ndarray) -> np.ndarray:
        """How often each row is in the sample of the tree."""
        share = (_mixed(self.seed, tree, key) >> np.uint64(11)).astype(float) / 2.0**53
        return np.searchsorted(_POISSON, share, side="right").astype(np.int64)

    def columns(self, tree: np.ndarray, path: np.ndarray) -> np.ndarray:
        """The columns tried at each node."""
        draw = _mixed(self.seed, tree[:, None], path[:, None], np.arange(len(self.cuts))[None, :])
        return np.argsort(draw, axis=1, kind="stable")[:, : self.tried]

    def whole(self, label: np.ndarray) -> np.ndarray:
        return np.round((label - self.center) * self.scale)


@dataclass
class Top:
    """The nodes above the tables; the first ones are the roots. A closed node is a leaf."""

    tree: np.ndarray
    path: np.ndarray
    depth: np.ndarray
    count: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    closed: np.ndarray
    value: np.ndarray
    gain: np.ndarray


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    """Bins as a matrix of bytes."""
    values = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _bins(cols: list[str], cuts: list[np.ndarray]) -> Column:
    """The bins of a row's columns, a byte each."""

    @F.pandas_udf("binary")
    def binned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x = part.to_numpy(float)
            if np.isnan(x).any():
                raise ValueError("a row without a value in a column of the forest")
            found = np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)])
            yield pd.Series([row.tobytes() for row in found.astype(np.uint8)])

    return binned(F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))


def _walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, start: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The leaf each row comes to."""
    at, rows = start.copy(), np.arange(len(bins))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        here = at[rows]
        at[rows] = left[here] + (bins[rows, feature[here]] > cut[here])
    return at


def _sums(plan: Plan, at: np.ndarray, nodes: int, feature: np.ndarray, bins: np.ndarray, w: np.ndarray, wy: np.ndarray):
    """Weights and weighted labels per node and bin of the column ``feature`` of the node."""
    key = at * plan.bins + bins[np.arange(len(at)), feature[at]]
    size = nodes * plan.bins
    shape = (nodes, plan.bins)
    return np.bincount(key, w, size).reshape(shape), np.bincount(key, wy, size).reshape(shape)


def _best(plan: Plan, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the best cut of a column, what it scores, and the weight left of it."""
    n, s = counts.sum(1, keepdims=True), sums.sum(1, keepdims=True)
    nl, sl = counts.cumsum(1)[:, :-1], sums.cumsum(1)[:, :-1]
    nr, sr = n - nl, s - sl
    allowed = (nl >= plan.least) & (nr >= plan.least)
    score = np.where(allowed, sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1) - s**2 / n, -1.0)
    if not score.shape[1]:
        return np.zeros(len(n), int), np.full(len(n), -1.0), np.zeros(len(n))
    cut = score.argmax(1)
    rows = np.arange(len(n))
    return cut, score[rows, cut], nl[rows, cut]


def _splits(gain: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Whether a gain is one, and not what rounding left."""
    return gain > 1e-12 * squares


def grow(plan: Plan, tree: int, path: int, depth: int, bins: np.ndarray, label: np.ndarray, w: np.ndarray) -> dict:
    """The nodes below one node, level by level."""
    y = plan.whole(label)
    at = np.zeros(len(y), int)  # among the nodes of this level
    rows, wf = np.arange(len(y)), w.astype(float)
    paths, first = np.array([path], np.int64), 0
    out: dict[str, list] = {"feature": [], "cut": [], "left": [], "value": []}
    importance = np.zeros(len(plan.cuts))
    while len(paths):
        nodes = len(paths)
        n = np.bincount(at, wf[rows], nodes)
        squares = np.bincount(at, wf[rows] * y[rows] ** 2, nodes)
        mean = np.bincount(at, wf[rows] * label[rows], nodes) / n
        out["value"].append(np.round(mean / plan.quantum) * plan.quantum)
        feature, cut, gain = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        if depth < plan.depth:
            tried = plan.columns(np.full(nodes, tree), paths)
            here, some = bins[rows], wf[rows]
            for f in tried.T:
                c, g, _ = _best(plan, *_sums(plan, at, nodes, f, here, some, some * y[rows]))
                better = (g > gain) & _splits(g, squares)
                feature, cut, gain = np.where(better, f, feature), np.where(better, c, cut), np.where(better, g, gain)
        split = feature >= 0
        rank = np.cumsum(split) - 1
        out["feature"].append(feature)
        out["cut"].append(cut)
        out["left"].append(np.where(split, first + nodes + 2 * rank, -1))
        np.add.at(importance, feature[split], gain[split])
        stay = split[at]
        rows, at = rows[stay], at[stay]
        at = 2 * rank[at] + (bins[rows, feature[at]] > cut[at])
        paths = np.column_stack([2 * paths[split], 2 * paths[split] + 1]).ravel()
        first, depth = first + nodes, depth + 1
    return {**{k: np.concatenate(v) for k, v in out.items()}, "weights": importance}


def _top_sums(plan: Plan, top: Top, wanted: np.ndarray):
    """Partial sums of the nodes to be split, a row per node and partition."""
    place = np.full(len(top.tree), -1)
    place[wanted] = np.arange(len(wanted))
    tried = plan.columns(top.tree[wanted], top.path[wanted])
    trees = np.unique(top.tree[wanted])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(wanted), plan.tried, plan.bins)
        counts, sums, squares = np.zeros(shape), np.zeros(shape), np.zeros(len(wanted))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, key = _matrix(batch["bins"]), batch["key"].to_numpy()
            y = plan.whole(batch["label"].to_numpy())
            for tree in trees:
                w = plan.weights(tree, key)
                at = place[_walk(top.feature, top.cut, top.left, np.full(len(key), tree), bins)]
                mine = np.flatnonzero((w > 0) & (at >= 0))
                at, b, wf, wy = at[mine], bins[mine], w[mine].astype(float), w[mine] * y[mine]
                squares += np.bincount(at, wy * y[mine], len(wanted))
                for j, f in enumerate(tried.T):
                    c, s = _sums(plan, at, len(wanted), f, b, wf, wy)
                    counts[:, j] += c
                    sums[:, j] += s
        for i in np.flatnonzero(counts.any((1, 2))):
            yield pa.RecordBatch.from_pydict(
                {"i": [i], "counts": [counts[i].ravel()], "sums": [sums[i].ravel()], "squares": [squares[i]]},
                pa.schema([("i", pa.int32()), ("counts", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64())), ("squares", pa.float64())]),
            )

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        i = int(part["i"].iloc[0])
        counts, sums = (np.sum(np.stack(part[c]), 0).reshape(plan.tried, plan.bins) for c in ("counts", "sums"))
        cut, gain, n_left = _best(plan, counts, sums)
        j = int(gain.argmax())
        n, s = counts[0].sum(), sums[0].sum()
        good = bool(_splits(gain[j], part["squares"].sum()))
        value = s / n / plan.scale + plan.center
        return pd.DataFrame([(i, int(tried[i, j]) if good else -1, int(cut[j]), float(gain[j]), n, float(n_left[j]), value)])

    return add_up, choose


def _grow_top(plan: Plan, rows: DataFrame) -> Top:
    """Split nodes by sums over all partitions until each holds few enough rows for a task."""
    t = plan.trees
    whole = lambda v: np.full(t, v)
    top = Top(
        np.arange(t), whole(1).astype(np.int64), whole(0), whole(float(plan.rows)), whole(-1), whole(0), whole(-1),
        whole(False), whole(0.0), whole(0.0),
    )
    while True:
        wanted = np.flatnonzero((top.feature < 0) & ~top.closed & (top.count > GROUP_ROWS) & (top.depth < plan.depth))
        if not len(wanted):
            return top
        add_up, choose = _top_sums(plan, top, wanted)
        partial = rows.mapInArrow(add_up, "i int, counts array<double>, sums array<double>, squares double")
        best = partial.groupBy("i").applyInPandas(
            choose, "i int, feature int, cut int, gain double, n double, n_left double, value double"
        )
        for r in sorted(best.collect()):  # a row per node to be split
            node = wanted[r["i"]]
            top.count[node], top.value[node] = r["n"], np.round(r["value"] / plan.quantum) * plan.quantum
            if r["feature"] < 0:
                top.closed[node] = True
                continue
            top.feature[node], top.cut[node], top.left[node], top.gain[node] = r["feature"], r["cut"], len(top.tree), r["gain"]
            child = {
                "tree": [top.tree[node]] * 2, "path": [2 * top.path[node], 2 * top.path[node] + 1],
                "depth": [top.depth[node] + 1] * 2, "count": [r["n_left"], r["n"] - r["n_left"]], "feature": [-1, -1],
                "cut": [0, 0], "left": [-1, -1], "closed": [False, False], "value": [0.0, 0.0], "gain": [0.0, 0.0],
            }
            for name, two in child.items():
                setattr(top, name, np.append(getattr(top, name), two))


def _tasks(spark: SparkSession, groups: int) -> int:
    """As many tasks as groups, up to some for each core; a given number is not merged."""
    return max(1, min(groups, 8 * spark.sparkContext.defaultParallelism))


class ForestModel:
    """A fitted forest: the driver's nodes, and a table with a row per tree below each of them."""

    def __init__(self, cols: list[str], plan: Plan, top: Top, below: DataFrame) -> None:
        self.cols, self.plan, self.top, self.below = cols, plan, top, below

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its ``prediction``, the mean over the trees.

        Rows in the same bins have the same prediction. A task gets one subtree
        and the rows that come to it, in shares where there are more of them than in training.
        """
        plan, top, spark = self.plan, self.top, df.sparkSession
        binned = stage_table(df.withColumn("_bins", _bins(self.cols, plan.cuts)), "binned")
        distinct = binned.select("_bins").distinct()
        shares = max(1, math.ceil(binned.count() / max(plan.rows, 1)))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = _matrix(batch["_bins"])
                    share = (_mixed(batch["share"].to_numpy()) % np.uint64(shares)).astype(np.int32)
                    for tree in range(plan.trees):
                        node = _walk(top.feature, top.cut, top.left, np.full(len(bins), tree), bins)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(node.astype(np.int32)), pa.array(share), batch["_bins"]], ["node", "share", "_bins"]
                        )

        def apply(trees: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"_bins": [], "p": []})
            (tree,) = trees.to_dict("records")
            leaf = _walk(tree["feature"], tree["cut"], tree["left"], np.zeros(len(rows), int), _matrix(rows["_bins"]))
            return pd.DataFrame({"_bins": rows["_bins"], "p": tree["value"][leaf]})

        groups = int((top.feature < 0).sum()) * shares
        tasks = _tasks(spark, groups)
        sent = distinct.withColumn("share", F.xxhash64("_bins")).mapInArrow(send, "node int, share int, _bins binary")
        shared = self.below.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        guesses = (
            shared.repartition(tasks, "node", "share").groupBy("node", "share")
            .cogroup(sent.repartition(tasks, "node", "share").groupBy("node", "share"))
            .applyInPandas(apply, "_bins binary, p double")
        )
        mean = guesses.groupBy("_bins").agg((F.sum("p") / plan.trees).alias("prediction"))
        return binned.join(mean, "_bins").drop("_bins")

    def importances(self) -> np.ndarray:
        """Shares of the columns in the gains, each tree with the same say."""
        k = len(self.cols)
        found = (
            self.below.select("tree", F.posexplode("weights").alias("f", "gain"))
            .groupBy("tree", "f").agg(F.sum("gain").alias("gain")).collect()  # trees times columns
        )
        total = np.zeros((self.plan.trees, k))
        for r in found:
            total[r["tree"], r["f"]] = r["gain"]
        split = self.top.feature >= 0
        np.add.at(total, (self.top.tree[split], self.top.feature[split]), self.top.gain[split])
        each = total.sum(1, keepdims=True)
        shares = np.divide(total, each, out=np.zeros_like(total), where=each > 0).sum(0)
        return shares / shares.sum() if shares.sum() else shares

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        plan = {**self.plan.__dict__, "cuts": [c.tolist() for c in self.plan.cuts]}
        top = {name: values.tolist() for name, values in self.top.__dict__.items()}
        self.below.write.mode("overwrite").parquet(f"{path}/stages/forest")
        settings = spark.createDataFrame([(json.dumps({"cols": self.cols, "plan": plan, "top": top}),)], "settings string")
        settings.coalesce(1).write.mode("overwrite").parquet(f"{path}/stages/settings")


def load_forest(spark: SparkSession, path: str) -> ForestModel | None:
    """The forest saved at ``path``, or nothing if that is another model."""
    try:
        known = json.loads(spark.read.parquet(f"{path}/stages/settings").first()["settings"])
    except AnalysisException:
        return None
    plan = Plan(**{**known["plan"], "cuts": [np.array(c, float) for c in known["plan"]["cuts"]]})
    top = Top(**{name: np.array(values) for name, values in known["top"].items()})
    return ForestModel(known["cols"], plan, top, spark.read.schema(SUBTREE).parquet(f"{path}/stages/forest"))


def fit_forest(train: DataFrame, cols: list[str], settings: RandomForestRegressor) -> ForestModel:
    """A forest of ``train`` (``cols`` and ``label``) with the settings of the estimator."""
    spark = train.sparkSession
    n, center, low, high = train.agg(F.count("*"), F.avg("label"), F.min("label"), F.max("label")).first()
    if not n:
        raise ValueError("no rows to fit a forest")
    steps = settings.getMaxBins() - 1
    at = train.approxQuantile(list(cols), [i / steps for i in range(steps + 1)], QUANTILE_ERROR)
    values = [np.unique(q) for q in at]
    largest = max(abs(low), abs(high), high - low, 1e-300)
    # sums over the rows, and over the trees, stay whole numbers of at most 52 bits
    bits = lambda size: 2.0 ** math.floor(52 - math.log2(largest) - math.log2(size))
    plan = Plan(
        trees=settings.getNumTrees(), depth=settings.getMaxDepth(), least=settings.getMinInstancesPerNode(),
        tried=math.ceil(math.sqrt(len(cols))), seed=settings.getSeed(), cuts=[(v[1:] + v[:-1]) / 2 for v in values],
        rows=n, center=center, scale=bits(4 * n + 64), quantum=1.0 / bits(settings.getNumTrees()),
    )
    key = F.xxhash64(*train.columns)
    rows = stage_table(train.select(key.alias("key"), F.col("label").cast("double"), _bins(cols, plan.cuts).alias("bins")), "bins")
    top = _grow_top(plan, rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, key = _matrix(batch["bins"]), batch["key"].to_numpy()
            for tree in range(plan.trees):
                w = plan.weights(tree, key)
                node = _walk(top.feature, top.cut, top.left, np.full(len(key), tree), bins)
                mine = np.flatnonzero((w > 0) & ~top.closed[node])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[mine].astype(np.int32)), pa.array(w[mine].astype(np.int8)),
                        batch["label"].take(pa.array(mine)), batch["bins"].take(pa.array(mine)),
                    ],
                    ["node", "w", "label", "bins"],
                )

    def below(part: pd.DataFrame) -> pd.DataFrame:
        node = int(part["node"].iloc[0])
        tree = int(top.tree[node])
        # equal rows in the same order, whatever the shuffle made of it
        part = part.sort_values(["bins", "label", "w"])
        found = grow(
            plan, tree, int(top.path[node]), int(top.depth[node]),
            _matrix(part["bins"]), part["label"].to_numpy(), part["w"].to_numpy().astype(int),
        )
        return pd.DataFrame([{"tree": tree, "node": node, **found}])

    tasks = _tasks(spark, int((top.feature < 0).sum()))
    sent = rows.mapInArrow(send, "node int, w byte, label double, bins binary")
    table = sent.repartition(tasks, "node").groupBy("node").applyInPandas(below, SUBTREE)
    # leaves above the table; and a tree whose sample is empty says the mean
    alone = [i for i in np.flatnonzero(top.feature < 0) if top.closed[i]]
    leaf = lambda i, value: (int(top.tree[i]), int(i), [-1], [0], [-1], [value], [0.0] * len(cols))
    extra = [leaf(i, float(top.value[i])) for i in alone]
    made = stage_table(table if not extra else table.unionByName(spark.createDataFrame(extra, SUBTREE)), "forest")
    open_nodes = {int(i) for i in np.flatnonzero((top.feature < 0) & ~top.closed)}
    if n < 64 and (lost := open_nodes - {r["node"] for r in made.select("node").collect()}):
        made = stage_table(made.unionByName(spark.createDataFrame([leaf(i, float(center)) for i in sorted(lost)], SUBTREE)), "forest")
    return ForestModel(list(cols), plan, top, made)
