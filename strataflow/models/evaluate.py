"""Fitting with validation, search, cross-validation, importance, robustness and confidence."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import mse, r2, regression_columns
from ..operators.split import hash_number, random_sample
from ..series import Series, SeriesLike, number_rows
from ..session import materialise, shuffles_freed
from ..sources.files import read_checked_csv
from ..stats import gather, literal_table
from . import supervised
from .common import assemble, stored

Fit = Callable[[DataFrame], object]

# fixed values: published search ranges
SEARCH_SPACES = {
    "gradient_boosting": {"maxIter": (50, 300), "maxDepth": (3, 10), "stepSize": (0.01, 0.3), "subsamplingRate": (0.6, 1.0)},
    "random_forest": {"numTrees": (50, 300), "maxDepth": (5, 20), "minInstancesPerNode": (1, 10)},
    "pcr": {"components": (2, 10)},
}
PRESETS = {
    "simple": {"formation_pressure": ["pcr"], "kick_detection": ["pca"]},
    "advanced": {"formation_pressure": ["gradient_boosting"], "kick_detection": ["isolation_forest"]},
    "production": {"formation_pressure": ["pcr", "gradient_boosting"], "kick_detection": ["pca", "isolation_forest"]},
    "research": {
        "formation_pressure": ["pcr", "gradient_boosting", "random_forest", "pls"],
        "kick_detection": ["pca", "isolation_forest", "one_class"],
    },
}


_ADDED: dict[str, dict[str, Callable]] = {}


def register(task: str, name: str, fitter: Callable) -> None:
    """Offer a model of the user's own: ``fitter(df, features, target, **params)`` returns what has ``transform(df)``.

    It can then be fitted, evaluated and compared by its name; a name that is taken is refused.
    """
    if name in registry().get(task, {}):
        raise ValueError(f"there is a model {task}/{name}")
    _ADDED.setdefault(task, {})[name] = fitter


def registry() -> dict[str, dict[str, Callable]]:
    """Fit functions by task and model name, the user's own among them."""
    from . import anomaly, pressure

    def regressor(kind):
        return lambda df, features, target, **p: supervised.fit_regressor(df, features, target, kind, **p)

    def classifier(kind):
        return lambda df, features, label, **p: supervised.fit_classifier(df, features, label, kind, **p)

    own = {
        "formation_pressure": {
            **{k: regressor(k) for k in supervised.REGRESSORS}, "pcr": pressure.fit_pcr, "pls": pressure.fit_pls,
        },
        "kick_detection": {
            **{k: classifier(k) for k in supervised.CLASSIFIERS},
            "pca": anomaly.fit_pca_detector, "isolation_forest": anomaly.fit_isolation_forest, "one_class": anomaly.fit_one_class,
        },
    }
    return {task: {**own.get(task, {}), **_ADDED.get(task, {})} for task in {**own, **_ADDED}}


def fit(task: str, name: str, df: DataFrame, features: Sequence[str], target: str, **params):
    known = registry().get(task, {})
    if name not in known:
        raise ValueError(f"unknown model {task}/{name}")
    return known[name](df, features, target, **params)


def fit_preset(preset: str, task: str, df: DataFrame, features: Sequence[str], target: str) -> dict[str, object]:
    return {name: fit(task, name, df, features, target) for name in PRESETS[preset][task]}


def fit_evaluate(df: DataFrame, series: SeriesLike, target: str, fitter: Fit, share: float = 0.2):
    """Fit on the first part of the series; r2, rmse and mae on both parts."""
    from ..operators.split import holdout_split

    parts = holdout_split(df, series, share)
    model = fitter(parts.where("split = 'train'"))
    y, p = F.col(target).cast("double"), F.col("prediction")
    # `split` may not be carried by the model, so both parts are scored from their own rows
    rows = []
    for part in ("train", "val"):
        scored = model.transform(parts.where(F.col("split") == part))
        got = gather(scored, {"r2": r2(y, p), "rmse": F.sqrt(mse(y, p)), "mae": F.avg(F.abs(y - p))})
        rows += [(f"{part}_{m}", float(v)) for m, v in got.items() if v is not None]
    return model, literal_table(df.sparkSession, rows, "metric string, value double")


def evaluate(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    return df.agg(*[c.alias(n) for n, c in regression_columns(y, p).items()])


# ---- search -------------------------------------------------------------------------


def _grid(estimator, grid: Mapping[str, Sequence]):
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def _history(spark, maps, scores, metric: str) -> DataFrame:
    rows = []
    for i, (params, score) in enumerate(zip(maps, scores)):
        text = ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda t: t[0].name))
        rows.append((i, text, float(score)))
    return literal_table(spark, rows, f"trial int, parameters string, {metric} double")


def _fits_at_once(rows: DataFrame, parallelism: int) -> int:
    """Fits that run side by side: as many as the cores can take; each holds its training rows in memory."""
    return max(1, min(parallelism, rows.sparkSession.sparkContext.defaultParallelism // max(1, rows.rdd.getNumPartitions())))


def _search(df: DataFrame, features: Sequence[str], target: str, kind: str, maps_of: Callable, metric: str, share: float, parallelism: int):
    """The model of the best parameters, fitted on all rows, and every trial's score on one held-out part.

    Rows are computed once and stored with the number that deals them to the parts. Fits are kept apart once
    one of them fills the cores, so that what is held in memory does not grow with the number of trials.
    """
    rows = stored(df.select(*features, F.col(target).cast("double").alias(target), F.rand(supervised.SEED).alias("_draw"))).persist()
    try:
        data = assemble(rows, features)
        train, held = data.where(F.col("_draw") < 1 - share), data.where(F.col("_draw") >= 1 - share)
        estimator = supervised._regressor(kind, target, data, {})
        maps = maps_of(estimator)
        evaluator = RegressionEvaluator(labelCol=target, metricName=metric)
        with ThreadPoolExecutor(max_workers=_fits_at_once(rows, parallelism)) as pool:
            scores = list(pool.map(lambda m: evaluator.evaluate(estimator.fit(train, m).transform(held)), maps))
        found = estimator.fit(data, maps[int(np.argmax(scores) if evaluator.isLargerBetter() else np.argmin(scores))])
    finally:
        rows.unpersist()
    return supervised.FittedModel(kind, list(features), found, target), _history(df.sparkSession, maps, scores, metric)


def grid_search(
    df: DataFrame, features: Sequence[str], target: str, kind: str, grid: Mapping[str, Sequence], metric: str = "rmse",
    share: float = 0.2, parallelism: int = 4,
):
    """Best model and the score of every combination on one held-out part."""
    return _search(df, features, target, kind, lambda estimator: _grid(estimator, grid), metric, share, parallelism)


def sample_parameters(kind: str, trials: int, seed: int = supervised.SEED) -> list[dict]:
    """Random draws from the search space of a model."""
    rng = random.Random(seed)
    space = SEARCH_SPACES[kind]
    return [
        {n: rng.randint(a, b) if isinstance(a, int) else rng.uniform(a, b) for n, (a, b) in space.items()}
        for _ in range(trials)
    ]


def random_search(
    df: DataFrame, features: Sequence[str], target: str, kind: str, trials: int = 10, metric: str = "rmse",
    share: float = 0.2, parallelism: int = 4, draws: Sequence[Mapping] | None = None,
):
    draws = list(draws if draws is not None else sample_parameters(kind, trials))
    if not draws:
        raise ValueError("no parameters to try")
    return _search(df, features, target, kind, lambda estimator: [{estimator.getParam(n): v for n, v in d.items()} for d in draws], metric, share, parallelism)


def cross_validate(
    df: DataFrame, features: Sequence[str], target: str, kinds: Sequence[str], keys: Sequence[str], folds: int = 5,
    metric: str = "rmse", parallelism: int = 4,
) -> DataFrame:
    """Mean, deviation and range of the fold scores per model, with folds drawn from the row keys.

    Rows are stored once with their fold; each model is fitted once on the other folds and scored once on its own.
    """
    folded = df.select(*features, F.col(target).cast("double").alias(target), fold_column(keys, folds).alias("_fold"))
    data = assemble(materialise(folded), features)
    evaluator = RegressionEvaluator(labelCol=target, metricName=metric)
    estimators = {kind: supervised._regressor(kind, target, data, {}) for kind in kinds}

    def score(work: tuple[str, int]) -> float:
        kind, i = work
        model = estimators[kind].fit(data.where(F.col("_fold") != i))
        return evaluator.evaluate(model.transform(data.where(F.col("_fold") == i)))

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        found = list(pool.map(score, [(kind, i) for kind in kinds for i in range(folds)]))
    rows = []
    for k, kind in enumerate(kinds):
        scores = found[k * folds : (k + 1) * folds]
        rows.append((kind, float(np.mean(scores)), float(np.std(scores)), float(np.min(scores)), float(np.max(scores))))
    smaller = metric in ("rmse", "mse", "mae")
    rows.sort(key=lambda t: t[1] if smaller else -t[1])
    return literal_table(df.sparkSession, rows, "model string, mean_score double, std_score double, min_score double, max_score double")


# ---- any kind of model: out-of-fold predictions, comparison, trials -----------------


def fold_column(keys: Sequence[str], folds: int):
    """The fold of a row, drawn from its keys."""
    return F.pmod(hash_number(*keys), F.lit(folds)).cast("int")


def out_of_fold(df: DataFrame, fitters: Mapping[str, Fit], keys: Sequence[str], folds: int = 5, name: str = "fold", parallelism: int = 4) -> DataFrame:
    """All rows with their fold and a column per model, predicted by a fit on the other folds alone.

    Works for whatever ``fitter(train)`` returns that has ``transform(df, output=...)``: regressors, classifiers,
    detectors, models of the user's own. Rows are stored once, each is scored once per model.
    """
    kept = materialise(df.withColumn(name, fold_column(keys, folds)))
    # fits wait for their slowest tasks many times; others run meanwhile
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        fitted = list(pool.map(lambda w: w[1](kept.where(F.col(name) != w[0]).drop(name)), [(i, fitter) for i in range(folds) for fitter in fitters.values()]))
    parts = None
    for i in range(folds):
        part = kept.where(F.col(name) == i)
        for k, model in enumerate(fitters):
            part = fitted[i * len(fitters) + k].transform(part, output=model)
        part = part.select(*kept.columns, *[F.col(m).cast("double").alias(m) for m in fitters])
        parts = part if parts is None else parts.unionByName(part)
    return materialise(parts)


def _score(metric: str, target: str, prediction: str):
    """A metric as an aggregate; classes are 0 and 1."""
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    hit, seen, true = F.count_if((y == 1) & (p == 1)), F.count_if(p == 1), F.count_if(y == 1)
    known = {
        "rmse": lambda: F.sqrt(mse(y, p)), "mse": lambda: mse(y, p), "mae": lambda: F.avg(F.abs(y - p)), "r2": lambda: r2(y, p),
        "accuracy": lambda: F.avg((y == p).cast("double")),
        "precision": lambda: F.coalesce(F.try_divide(hit, seen), F.lit(0.0)), "recall": lambda: F.coalesce(F.try_divide(hit, true), F.lit(0.0)),
        "f1": lambda: F.coalesce(F.try_divide(2 * hit, seen + true), F.lit(0.0)),
    }
    if metric not in known:
        raise ValueError(f"unknown metric {metric}")
    return known[metric]().cast("double")


def compare_by_folds(
    df: DataFrame, fitters: Mapping[str, Fit], target: str, keys: Sequence[str], folds: int = 5, metric: str = "rmse",
) -> DataFrame:
    """Mean, deviation and range of the fold scores of models of any kind: one scored table, one aggregation."""
    scored = out_of_fold(df, fitters, keys, folds, "_fold")
    rows = scored.groupBy("_fold").agg(*[_score(metric, target, m).alias(m) for m in fitters]).collect()  # one row per fold
    out = []
    for m in fitters:
        got = [r[m] for r in rows if r[m] is not None]
        if got:
            out.append((m, float(np.mean(got)), float(np.std(got)), float(min(got)), float(max(got))))
    out.sort(key=lambda t: t[1] if metric in ("rmse", "mse", "mae") else -t[1])
    return literal_table(df.sparkSession, out, "model string, mean_score double, std_score double, min_score double, max_score double")


def search_trials(
    df: DataFrame, fitter: Callable[..., object], draws: Sequence[Mapping], target: str, keys: Sequence[str], metric: str = "rmse",
    folds: int = 5, keep: float = 0.5,
) -> tuple[object, DataFrame]:
    """(best model on all rows, history) over parameters of any kind of model, by successive halving on folds.

    A trial is ``fitter(train, **draw)``. After each fold the best ``keep`` share of the trials, by mean score so far,
    goes on to the next; the last one standing needs no further folds. History: trial, parameters, folds, score.
    """
    if not draws:
        raise ValueError("no parameters to try")
    kept = materialise(df.withColumn("_fold", fold_column(keys, folds)))
    alive, scores = list(range(len(draws))), [[] for _ in draws]
    sign = 1 if metric in ("rmse", "mse", "mae") else -1
    mean = lambda i: sign * float(np.mean(scores[i])) if scores[i] else float("inf")
    for i in range(folds):
        train, part = kept.where(F.col("_fold") != i).drop("_fold"), kept.where(F.col("_fold") == i)
        for t in alive:
            part = fitter(train, **draws[t]).transform(part, output=f"_trial{t}")
        got = gather(part, {str(t): _score(metric, target, f"_trial{t}") for t in alive})
        for t in alive:
            if got[str(t)] is not None:
                scores[t].append(float(got[str(t)]))
        if len(alive) == 1:
            break
        alive = sorted(alive, key=lambda t: (mean(t), t))[: max(1, int(np.ceil(len(alive) * keep)))]
    best = min(alive, key=lambda t: (mean(t), t))
    rows = [
        (t, ", ".join(f"{k}={v}" for k, v in sorted(draws[t].items())), len(scores[t]), float(np.mean(scores[t])) if scores[t] else None)
        for t in range(len(draws))
    ]
    model = fitter(df, **draws[best])
    return model, literal_table(df.sparkSession, rows, f"trial int, parameters string, folds int, {metric} double")


def search_model(
    df: DataFrame, task: str, name: str, features: Sequence[str], target: str, keys: Sequence[str], trials: int = 10,
    draws: Sequence[Mapping] | None = None, **how,
) -> tuple[object, DataFrame]:
    """``search_trials`` for a registered model of either task, with draws from its range unless given."""
    draws = list(draws if draws is not None else sample_parameters(name, trials))
    return search_trials(df, lambda train, **p: fit(task, name, train, features, target, **p), draws, target, keys, **how)


def time_series_scores(df: DataFrame, series: SeriesLike, target: str, fitter: Fit, k: int = 5) -> DataFrame:
    """r2 and rmse on each expanding fold."""
    from ..operators.split import expanding_folds, fold_parts

    folded = expanding_folds(df, series, k)
    y, p = F.col(target).cast("double"), F.col("prediction")
    rows = []
    for i in range(1, k + 1):
        train, test = fold_parts(folded, i)
        got = gather(fitter(train).transform(test), {"r2": r2(y, p), "rmse": F.sqrt(mse(y, p))})
        rows.append((i, got["r2"], got["rmse"]))
    return literal_table(df.sparkSession, rows, "fold int, r2 double, rmse double")


# ---- importance, robustness, confidence --------------------------------------------


#: Copies of rows, one for each feature and repeat, that a task scores.
COPIES_PER_TASK = 2_000_000
#: Copies whose shuffle files are on disk at one time; a pass has one cell at least.
COPIES_PER_PASS = 200_000_000
#: Rows of a block: values move as slices of blocks.
BLOCK_ROWS = 1024


def _blocks(numbered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_block, columns): the values of BLOCK_ROWS rows that follow each other, a list for each column, in their order."""
    block = F.floor(F.col("_i") / F.lit(BLOCK_ROWS)).cast("long").alias("_block")
    held = numbered.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("_i", *columns))).alias("_rows"))
    return held.select("_block", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def _slices(blocks: DataFrame, shifts: Sequence[tuple[int, int, int]], features: Sequence[str], n: int) -> DataFrame:
    """(_block, cell, _f, _from, _given): what a block's rows, from its row ``_from`` on, are given in a cell, for its feature.

    ``shifts`` has a cell, its feature, and how much further on, around the end of the n rows, its values stand.
    """
    size = F.lit(BLOCK_ROWS)
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(f).alias("_f"), F.lit(s).cast("long").alias("_s")) for c, f, s in shifts])
    out = blocks.select(F.col("_block").alias("_b"), *features, F.explode(cells).alias("_c")).select("_b", *features, "_c.*")
    low = F.col("_b") * size
    high = F.least(low + size, F.lit(n))
    # givers below the distance serve rows before the end, the others rows from the beginning on
    turn = F.least(F.greatest(F.col("_s"), low), high)
    part = lambda at, to, off: F.struct(at.alias("at"), to.alias("to"), (F.col("_s") - off).alias("off"))
    parts = F.filter(F.array(part(low, turn, F.lit(n)), part(turn, high, F.lit(0))), lambda p: p["at"] < p["to"])
    out = out.select("*", F.explode(parts).alias("_p"))
    first, last = F.col("_p.at") - F.col("_p.off"), F.col("_p.to") - F.col("_p.off")
    served = F.sequence(F.floor(first / size).cast("long"), F.floor((last - 1) / size).cast("long"))
    out = out.select("*", first.alias("_first"), last.alias("_last"), F.explode(served).alias("_block"))
    start, end = F.greatest(F.col("_first"), F.col("_block") * size), F.least(F.col("_last"), (F.col("_block") + 1) * size)
    given = F.lit(None)
    for i, f in enumerate(features):
        at = (start + F.col("_p.off") - low + 1).cast("int")
        given = F.when(F.col("_f") == i, F.slice(F.col(f).cast("array<double>"), at, (end - start).cast("int"))).otherwise(given)
    return out.select("_block", "cell", "_f", (start - F.col("_block") * size).cast("int").alias("_from"), given.alias("_given"))


def permutation_importance(
    df: DataFrame, model, target: str, keys: Sequence[str], repeats: int = 5, rows: int | None = None, seed: int = supervised.SEED
) -> DataFrame:
    """Mean rise of the squared error when one feature is shuffled, over all rows; ``rows`` asks for a sample instead.

    Rows are numbered once in the order of a hash of their keys. Each repeat takes a feature's values from the rows
    a drawn distance further on, around the end, so every value is used once and no repeat needs a sort of its own.
    Only that feature's values move, as slices of blocks, and those of a bounded number of copies at a time.
    """
    features = list(model.features)
    base = df.select(*dict.fromkeys([*keys, *features, target]))
    if rows is not None:
        base = random_sample(base, keys, rows)
    order = Series((), ("_hash", *keys))
    numbered = number_rows(base.withColumn("_hash", hash_number(*keys)), order, "_i")
    columns = list(dict.fromkeys([*features, target]))
    blocks = materialise(_blocks(numbered.select("_i", *columns), columns))
    n = gather(blocks, {"n": F.sum(F.size(target))})["n"] or 0
    rng = random.Random(seed)
    # a cell is a feature and a repeat, as one number; the rows as they are have cell -1
    shifts = [(c, c // repeats, (1 + math.floor(rng.random() * (n - 1))) % n if n else 0) for c in range(len(features) * repeats)]
    # tasks of bounded size: each keeps its blocks in a small table, and the many copies need no sort
    spark = df.sparkSession
    each = max(1, COPIES_PER_PASS // max(1, n))
    held = blocks.select("_block", *[F.col(c).alias(f"_of_{i}") for i, c in enumerate(columns)])
    plain = blocks.select(F.lit(-1).alias("cell"), F.explode(F.arrays_zip(*columns)).alias("_r")).select("cell", "_r.*")
    errors = []
    for at in range(0, len(shifts), each):
        now = shifts[at : at + each]
        parts = max(spark.sparkContext.defaultParallelism, -(-n * len(now) // COPIES_PER_TASK))
        given = _slices(blocks.select("_block", *features), now, features, n)
        met = given.repartition(parts, "_block").join(held.repartition(parts, "_block").hint("shuffle_hash"), "_block")
        copies = met.select("*", F.posexplode("_given").alias("_at", "_new"))
        own = [F.get(f"_of_{i}", F.col("_from") + F.col("_at")) for i in range(len(columns))]
        taken = [F.when(F.col("_f") == i, F.col("_new")).otherwise(own[i]) if c in features else own[i] for i, c in enumerate(columns)]
        copies = copies.select("cell", *[v.alias(c) for v, c in zip(taken, columns)])
        scored = model.transform(copies if at else plain.unionByName(copies))
        # one row per feature and repeat
        with shuffles_freed(spark):
            errors += scored.groupBy("cell").agg(mse(F.col(target).cast("double"), F.col("prediction")).alias("e")).collect()
    start = next((r["e"] for r in errors if r["cell"] == -1), None)
    out = []
    for i, f in enumerate(features):
        rises = [r["e"] - start for r in sorted(errors, key=lambda r: r["cell"]) if r["cell"] >= 0 and r["cell"] // repeats == i and r["e"] is not None]
        if rises:
            out.append((f, float(np.mean(rises)), float(np.std(rises))))
    out.sort(key=lambda t: -t[1])
    return literal_table(df.sparkSession, out, "feature string, importance double, deviation double")


def robustness(df: DataFrame, model, target: str, levels: Sequence[float] = (0.01, 0.05, 0.1, 0.2), seed: int = 42) -> DataFrame:
    """r2 of the model under Gaussian noise of each share of the columns' deviation."""
    features = list(model.features)
    got = gather(df, {f: F.stddev_samp(f) for f in features})
    noisy = df.select(*features, target).withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    noisy = noisy.withColumns(
        {f: F.col(f) + F.randn(seed + i) * F.col("level") * F.lit(float(got[f] or 0.0)) for i, f in enumerate(features)}
    )
    y, p = F.col(target).cast("double"), F.col("prediction")
    return model.transform(noisy).groupBy("level").agg(r2(y, p).alias("r2"))


def noise_confidence(df: DataFrame, model, draws: int = 5, sigma: float = 0.01, seed: int = 42, name: str = "confidence") -> DataFrame:
    """1 / (1 + variance / mean²) of the predictions of a few noisy copies of every row.

    Copies stay beside their row, so nothing is shuffled.
    """
    features = list(model.features)
    work = df
    columns = []
    for d in range(draws):
        noisy = work.withColumns({f"_keep_{f}": F.col(f) for f in features})
        noisy = noisy.withColumns({f: F.col(f) + F.randn(seed + 1000 * d + i) * F.lit(sigma) for i, f in enumerate(features)})
        scored = model.transform(noisy, output=f"_draw{d}")
        work = scored.withColumns({f: F.col(f"_keep_{f}") for f in features}).drop(*[f"_keep_{f}" for f in features])
        columns.append(F.col(f"_draw{d}"))
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    mean = total / F.lit(float(draws))
    squares = (columns[0] - mean) * (columns[0] - mean)
    for c in columns[1:]:
        squares = squares + (c - mean) * (c - mean)
    variance = squares / F.lit(float(draws))
    confidence = F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.try_divide(variance, mean * mean)), F.lit(0.5))
    return work.withColumn(name, F.least(confidence, F.lit(1.0))).drop(*[f"_draw{d}" for d in range(draws)])


def score_csv_files(spark: SparkSession, pattern: str, model, features: Sequence[str], folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summary, errors): scores per source file, and the files that could not be scored with the reason.

    All files are one read; a bad file takes none of the others with it.
    """
    rows, errors = read_checked_csv(spark, pattern, features, folders)
    return score_files(model, rows), errors


def score_files(model, files: DataFrame, source: str = "source_file") -> DataFrame:
    """Predictions summarised per source file: count, mean, population deviation and range."""
    return model.transform(files).groupBy(source).agg(
        F.count("prediction").alias("count"), F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("std"),
        F.min("prediction").alias("min"), F.max("prediction").alias("max"),
    )
