"""Unsupervised kick detectors: PCA reconstruction error, isolation forest, one-class margin."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import require_columns
from ..operators.scale import FittedScale, fit_scale
from ..quantiles import quantile
from ..stats import gather
from .common import at_least_parallel, linear, principal_axes, second_moments


def _save(model, path: str, spark: SparkSession, metadata: dict) -> None:
    about = {"model": asdict(model), "metadata": metadata}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _load(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(path).first()[0])["model"]


def _normal_rows(df: DataFrame, features: Sequence[str], label: str | None) -> DataFrame:
    require_columns(df, features)
    normal = df.where(F.col(label) == 0) if label else df
    return normal.select(*[F.col(c).cast("double").alias(c) for c in features]).dropna()


def _score_quantile(model, data: DataFrame, share: float) -> float:
    """Quantile of the model's scores; they are kept, as the quantile reads them more than once."""
    scores = model.transform(data).select("score").persist()
    try:
        return float(quantile(scores, "score", share))
    finally:
        scores.unpersist()


# ---- reconstruction error ---------------------------------------------------------


@dataclass
class PcaDetector:
    """Squared prediction error outside the leading principal components."""

    features: list[str]
    centre: list[float]
    width: list[float]
    basis: list[list[float]]
    explained: float
    threshold: float

    def _scaled(self) -> list[Column]:
        return [
            (F.coalesce(F.col(f).cast("double"), F.lit(m)) - F.lit(m)) / F.lit(w)
            for f, m, w in zip(self.features, self.centre, self.width)
        ]

    def _work(self, df: DataFrame) -> DataFrame:
        """Scaled inputs and projections as columns, each computed once per row."""
        require_columns(df, self.features)
        z = {f"_z{i}": c for i, c in enumerate(self._scaled())}
        k = len(self.basis[0])
        projected = {f"_t{j}": linear([(f"_z{i}", row[j]) for i, row in enumerate(self.basis)]) for j in range(k)}
        return df.withColumns(z).withColumns(projected)

    def _residual(self, i: int) -> Column:
        return F.col(f"_z{i}") - linear([(f"_t{j}", v) for j, v in enumerate(self.basis[i])])

    def transform(self, df: DataFrame, output: str = "prediction", score: str = "spe") -> DataFrame:
        work = self._work(df)
        spe = F.lit(0.0)
        for i in range(len(self.features)):
            spe = spe + self._residual(i) * self._residual(i)
        out = work.withColumn(score, spe).withColumn(output, (F.col(score) > F.lit(self.threshold)).cast("int"))
        return out.drop(*[c for c in work.columns if c not in df.columns])

    def contributions(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Each feature's share of the squared prediction error."""
        work = self._work(df)
        parts = [(self._residual(i) * self._residual(i)).alias(f"{f}_contribution") for i, f in enumerate(self.features)]
        return work.select(*keep, *parts)

    def save(self, path: str, spark: SparkSession, **metadata: object) -> None:
        _save(self, path, spark, metadata)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "PcaDetector":
        return PcaDetector(**_load(path, spark))


def fit_pca_detector(
    df: DataFrame, features: Sequence[str], label: str | None = None, variance: float = 0.9, percentile: float = 99.99
) -> PcaDetector:
    """Fit on normal rows; the threshold is a percentile of their own error."""
    features = list(features)
    normal = _normal_rows(df, features, label)
    mean, std, correlation = second_moments(normal, features)
    values, axes = principal_axes(correlation)
    shares = values / values.sum()
    k = min(len(features), int(np.searchsorted(np.cumsum(shares), variance, side="right")) + 1)
    detector = PcaDetector(
        features, [float(v) for v in mean], [float(v) or 1.0 for v in std], axes[:, :k].tolist(), float(shares[:k].sum()), float("inf"),
    )
    detector.threshold = float(quantile(detector.transform(normal).select("spe"), "spe", percentile / 100))
    return detector


# ---- isolation forest ---------------------------------------------------------------


def _path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Random trees as flat node tables; at most trees × 511 nodes in all."""

    features: list[str]
    means: list[float]
    sample: int
    nodes: list[dict]
    threshold: float

    def transform(self, df: DataFrame, output: str = "prediction", score: str = "score") -> DataFrame:
        require_columns(df, self.features)
        # leaves lead back to themselves, so every row takes the same number of steps
        trees, steps = [], 0
        for t in self.nodes:
            left, right = np.array(t["left"]), np.array(t["right"])
            leaf = np.where(left < 0)[0]
            left[leaf], right[leaf] = leaf, leaf
            ways = np.stack([left, right], axis=1).ravel().astype(np.int32)
            trees.append((np.array(t["feature"], dtype=np.int32), np.array(t["cut"]), ways, np.array(t["depth"])))
        steps = max(1, math.ceil(math.log2(max(self.sample, 2))))
        scale = float(_path_length(self.sample)) or 1.0

        @F.pandas_udf("double")
        def isolation(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            flat, start = x.ravel(), np.arange(len(x), dtype=np.int32) * x.shape[1]
            total = np.zeros(len(x))
            for feature, cut, ways, depth in trees:
                at = np.zeros(len(x), dtype=np.int32)
                for _ in range(steps):
                    right = flat.take(start + feature.take(at)) >= cut.take(at)
                    at = ways.take(2 * at + right)
                total += depth.take(at)
            return pd.Series(2.0 ** (-total / len(trees) / scale))

        inputs = [F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in zip(self.features, self.means)]
        df = at_least_parallel(df)
        return df.withColumn(score, isolation(*inputs)).withColumn(output, (F.col(score) > F.lit(self.threshold)).cast("int"))

    def save(self, path: str, spark: SparkSession, **metadata: object) -> None:
        _save(self, path, spark, metadata)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "IsolationForest":
        return IsolationForest(**_load(path, spark))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """One isolation tree over at most a few hundred rows."""
    node: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "depth": []}
    waiting = [(np.arange(len(x)), 0, -1, "left")]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        me = len(node["feature"])
        if parent >= 0:
            node[side][parent] = me
        part = x[rows]
        split = depth < limit and len(rows) > 1
        if split:
            low, high = part.min(axis=0), part.max(axis=0)
            spread = np.flatnonzero(high > low)
            split = len(spread) > 0
        if not split:
            node["feature"].append(0)
            node["cut"].append(0.0)
            node["left"].append(-1)
            node["right"].append(-1)
            node["depth"].append(depth + float(_path_length(len(rows))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(low[f], high[f]))
        node["feature"].append(f)
        node["cut"].append(cut)
        node["left"].append(0)
        node["right"].append(0)
        node["depth"].append(float(depth))
        goes_left = part[:, f] < cut
        waiting.append((rows[goes_left], depth + 1, me, "left"))
        waiting.append((rows[~goes_left], depth + 1, me, "right"))
    return node


def fit_isolation_forest(
    df: DataFrame, features: Sequence[str], label: str | None = None, trees: int = 100, sample: int = 256,
    contamination: float = 0.1, seed: int = 42,
) -> IsolationForest:
    """Each tree is grown in its own task on a bounded random sample of the rows."""
    features = list(features)
    data = _normal_rows(df, features, label)
    got = gather(data, {"\0n": F.count(F.lit(1)), **{f: F.avg(f) for f in features}})
    n = got["\0n"]
    size = min(sample, n)
    # about four candidates per wanted row; a Bernoulli pre-sample keeps the spread small
    share = min(1.0, 4.0 * size / n) if n else 0.0
    candidates = min(1.0, trees * 4.0 * size / n) if n else 0.0
    pool = data.sample(False, candidates, seed) if candidates < 1.0 else data
    # a pool row takes part in trees·keep trees on average: a random first tree, then even strides
    keep = share / candidates if candidates else 0.0
    drawn = pool.withColumn("_copies", F.floor(F.lit(trees * keep) + F.rand(seed))).where("_copies > 0")
    drawn = drawn.withColumn("_first", F.floor(F.rand(seed + 1) * trees))
    stride = F.greatest(F.lit(1), F.floor(F.lit(trees) / F.col("_copies")))
    spread = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
    spread = spread.withColumns(
        {"_tree": F.pmod(F.col("_first") + F.col("_copy") * stride, F.lit(trees)).cast("int"), "_draw": F.rand(seed + 2)}
    )
    # a fixed number of partitions: the rows are few, the growing is the work
    spread = spread.repartition(trees, "_tree")
    per_tree = Window.partitionBy("_tree").orderBy("_draw")
    chosen = spread.withColumn("_rank", F.row_number().over(per_tree)).where(F.col("_rank") <= size)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = _grow(part[features].to_numpy(float), np.random.default_rng([seed, int(key[0])]), limit)
        return pd.DataFrame({"tree": [int(key[0])], "node": [json.dumps(tree)]})

    grown = chosen.groupBy("_tree").applyInPandas(build, "tree int, node string").orderBy("tree").collect()
    forest = IsolationForest(
        features, [float(got[f]) for f in features], size, [json.loads(g["node"]) for g in grown], float("inf")
    )
    forest.threshold = _score_quantile(forest, data, 1 - contamination)
    return forest


# ---- one-class margin -------------------------------------------------------------------


@dataclass
class OneClassMargin:
    """Linear one-class separator on random Fourier features of the scaled inputs."""

    features: list[str]
    centre: list[float]
    width: list[float]
    frequencies: list[list[float]]
    phases: list[float]
    weights: list[float]
    threshold: float

    def _map(self, x: np.ndarray) -> np.ndarray:
        waves = ((x - np.array(self.centre)) / np.array(self.width)) @ np.array(self.frequencies)
        waves += np.array(self.phases)
        np.cos(waves, out=waves)
        waves *= math.sqrt(2 / len(self.phases))
        return waves

    def transform(self, df: DataFrame, output: str = "prediction", score: str = "score") -> DataFrame:
        """The score is the negated margin, so larger means stranger."""
        require_columns(df, self.features)
        fourier, weights = self._map, np.array(self.weights)

        @F.pandas_udf("double")
        def strangeness(*columns: pd.Series) -> pd.Series:
            return pd.Series(-(fourier(np.column_stack([c.to_numpy(float) for c in columns])) @ weights))

        inputs = [F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in zip(self.features, self.centre)]
        df = at_least_parallel(df)
        return df.withColumn(score, strangeness(*inputs)).withColumn(output, (F.col(score) > F.lit(self.threshold)).cast("int"))

    def save(self, path: str, spark: SparkSession, **metadata: object) -> None:
        _save(self, path, spark, metadata)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "OneClassMargin":
        return OneClassMargin(**_load(path, spark))


#: Rows that are worked on at once: few enough for their features to stay in a core's cache.
BLOCK = 1024
#: From LARGE rows on, a search begins at the minimum over about START rows drawn from them.
LARGE, START = 1_000_000, 100_000


def _tree_sums(data: DataFrame, features: Sequence[str], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of an array that ``part`` makes of a block: added up in the tasks, then by position."""

    def summed(frames):
        total = None
        for frame in frames:
            rows = frame[list(features)].to_numpy(float)
            for at in range(0, len(rows), BLOCK):
                own = part(rows[at : at + BLOCK])
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"g": [total.tolist()]})

    rows = data.mapInPandas(summed, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    return np.array([r["s"] for r in sorted(rows, key=lambda r: r["pos"])])


def _least(
    data: DataFrame, features: Sequence[str], fourier: Callable[[np.ndarray], np.ndarray], n: float, point: np.ndarray,
    nu: float, rounds: int, tolerance: float, smoothing: float,
) -> np.ndarray:
    """Weights and offset that Newton's method reaches from ``point`` over the ``n`` rows of ``data``."""
    size = len(point)
    best, best_point, step, decrement = math.inf, point, None, math.inf
    for _ in range(rounds):
        at = point.copy()

        def part(x: np.ndarray) -> np.ndarray:
            waves = fourier(x)
            short = at[-1] - waves @ at[:-1]
            slope = np.clip(short / smoothing, 0.0, 1.0)
            waves = waves[short > 0]  # the others add nothing
            held = slope[short > 0]
            bent = np.column_stack([-waves[held < 1.0], np.ones(int((held < 1.0).sum()))])
            loss = np.where(short >= smoothing, short - smoothing / 2, slope * short / 2).sum()
            return np.concatenate([[loss], -(held @ waves), [held.sum()], (bent.T @ bent).ravel()])

        got = _tree_sums(data, features, part) / (nu * n)
        value = float(at[:-1] @ at[:-1]) / 2 - float(at[-1]) + float(got[0])
        if step is not None and value > best - 1e-4 * decrement:
            step = step / 2
            if float(np.abs(step).max()) < 1e-12:
                break
            point = best_point + step
            decrement /= 2
            continue
        best, best_point = value, at
        gradient = np.append(at[:-1], -1.0) + got[1:size + 1]
        curve = np.diag(np.append(np.ones(size - 1), 1e-6)) + got[size + 1:].reshape(size, size) / smoothing
        step = -np.linalg.solve(curve, gradient)
        step *= min(1.0, 1.0 / float(np.linalg.norm(step)))
        decrement = float(-gradient @ step)
        if decrement < tolerance * max(1.0, abs(value)):
            break
        point = at + step
    return best_point


def fit_one_class(
    df: DataFrame, features: Sequence[str], label: str | None = None, nu: float = 0.1, dimensions: int = 64,
    gamma: float | None = None, rounds: int = 100, seed: int = 42, tolerance: float = 1e-6, smoothing: float = 0.01,
) -> OneClassMargin:
    """Newton's method on the one-class objective with a smoothed hinge, until the decrement is below ``tolerance``.

    The objective is |w|²/2 - r + mean(hinge(r - w·x)) / nu; smoothing the hinge over a width changes it by less than
    that width / 2nu. Every round sums gradient, curvature and objective inside the partitions (a bounded array a task);
    a round that made the objective worse halves its step. ``rounds`` only ends a search that does not converge.
    On LARGE tables the search begins where it ended over a sample; it ends by the same test over all rows.
    """
    features = list(features)
    data = _normal_rows(df, features, label)
    scaling: FittedScale = fit_scale(data, "standard", features)
    if any(f not in scaling.parameters for f in features):
        raise ValueError("no complete rows to fit on")
    centre = [float(scaling.parameters[f][0]) for f in features]
    width = [float(scaling.parameters[f][1]) or 1.0 for f in features]
    rng = np.random.default_rng(seed)
    gamma = gamma if gamma is not None else 1.0 / len(features)
    model = OneClassMargin(
        features, centre, width,
        rng.normal(0.0, math.sqrt(2 * gamma), (len(features), dimensions)).tolist(),
        rng.uniform(0, 2 * math.pi, dimensions).tolist(), [0.0] * dimensions, float("inf"),
    )
    data = at_least_parallel(data).persist()
    try:
        fourier = model._map
        total = _tree_sums(data, features, lambda x: np.append(fourier(x).sum(axis=0), float(len(x))))
        n = float(total[-1]) if len(total) else 0.0
        if not n:
            raise ValueError("no complete rows to fit on")
        mean = total[:-1] / n
        point = np.append(mean, float(mean @ mean))  # weights, then the offset
        if n >= LARGE:
            drawn = data.sample(False, START / n, seed).persist()
            try:
                point = _least(drawn, features, fourier, float(drawn.count()), point, nu, rounds, tolerance, smoothing)
            finally:
                drawn.unpersist()
        best_point = _least(data, features, fourier, n, point, nu, rounds, tolerance, smoothing)
        model.weights = [float(v) for v in best_point[:-1]]
        model.threshold = _score_quantile(model, data, 1 - nu)
    finally:
        data.unpersist()
    return model
