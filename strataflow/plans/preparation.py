"""End-to-end preparation and feature plans for the two drilling tasks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..channels import FORMATION_CHANNELS, FORMATION_TARGET, KICK_CHANNELS, numeric_columns
from ..operators import clean, features, impute, ordered, scale
from ..series import Layout, Series, SeriesLike
from ..session import materialise


def _frame_columns(series: SeriesLike) -> list[str]:
    return [*series.keys, *[c for c in series.order if c not in series.keys]]


def first_of_duplicates(df: DataFrame, series: SeriesLike, channels: Sequence[str]) -> DataFrame:
    """One row per series and channel values: the earliest one.

    A grouped minimum, so copies of a row shrink before they are shuffled.
    """
    keys, order = list(series.keys), list(series.order)
    place = F.struct(*[F.col(c) for c in order])
    values = [c for c in channels if c not in keys and c not in order]
    group = [*keys, *values, *[c for c in channels if c in order]]
    extra = [c for c in order if c not in group]
    if not extra:
        return df.dropDuplicates(group)
    grouped = df.groupBy(*group).agg(F.min(place).alias("_first"))
    return grouped.select(*group, *[F.col(f"_first.{c}").alias(c) for c in extra])


def _settled(df: DataFrame, series: SeriesLike) -> tuple[DataFrame, Layout]:
    """The cleaned rows, written once as several passes follow, and their measure."""
    rows = materialise(df)
    return rows, series.measure(rows)


def _channels(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


@dataclass
class Preparation:
    """What a preparation run learnt, ready to be replayed on new rows."""

    task: str
    channels: list[str]
    fills: dict[str, float]
    scaling: dict[str, tuple[float, float]]

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Duplicates out, fitted fills, fitted scaling; no outlier removal."""
        chosen = clean.require_columns(df, [*keep, *[c for c in self.channels if c not in keep]])
        filled = impute.FittedFill(self.fills).apply(chosen.dropDuplicates())
        return scale.FittedScale(self.scaling).apply(filled)

    def save(self, path: str, spark: SparkSession) -> None:
        text = json.dumps({"task": self.task, "channels": self.channels, "fills": self.fills, "scaling": self.scaling})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "Preparation":
        got = json.loads(spark.read.text(path).first()[0])
        return Preparation(got["task"], got["channels"], got["fills"], {c: tuple(v) for c, v in got["scaling"].items()})


def prepare_formation(
    df: DataFrame, series: SeriesLike, channels: Sequence[str] = FORMATION_CHANNELS, target: str = FORMATION_TARGET,
    derived: Sequence[str] = ("WellDepth", "BTBR", "WBoPress", "RoPen"),
    pairs: Sequence[tuple[str, str]] = (("WellDepth", "BTBR"), ("WBoPress", "HLoad"), ("WoBit", "RoPen")),
) -> tuple[DataFrame, Preparation]:
    """Clean, fill, derivatives, rolling statistics, interactions, smoothing of all but the target."""
    frame = _frame_columns(series)
    values = [*channels, target]
    data = clean.require_columns(df, [*frame, *[c for c in values if c not in frame]])
    data = first_of_duplicates(data, series, values)
    data, layout = _settled(clean.remove_iqr_outliers(data, values, 1.5), series)
    constant = [c for c in clean.constant_columns(data, values) if c not in frame]
    data = data.drop(*constant)
    fitted = impute.fit_fill(data, "median", _channels(data, values))
    data = fitted.apply(data)
    chosen = _channels(data, derived)
    data = ordered.derivative_features(data, layout, chosen)
    data = ordered.rolling_features(data, layout, chosen, (5, 10))
    data = features.pair_interactions(data, pairs)
    smoothed = [c for c in numeric_columns(data, [*frame, target])]
    data = ordered.smooth(data, layout, smoothed)
    return data, Preparation("formation", [c for c in channels if c not in constant], fitted.values, {})


def prepare_kick(
    df: DataFrame, series: SeriesLike, channels: Sequence[str] = KICK_CHANNELS,
    derived: Sequence[str] = ("FRate", "ActiveGL", "SMSpeed", "FIn", "FOut"),
) -> tuple[DataFrame, Preparation]:
    """Clean, nearest-donor fill, lags, rolling statistics, standardise."""
    frame = _frame_columns(series)
    values = [c for c in dict.fromkeys(channels)]
    data = clean.require_columns(df, [*frame, *[c for c in values if c not in frame]])
    data = first_of_duplicates(data, series, values)
    # rows with gaps stay: the nearest donors fill them
    data, layout = _settled(clean.remove_iqr_outliers(data, values, 2.0, keep_gaps=True), series)
    constant = [c for c in clean.constant_columns(data, values) if c not in frame]
    data = data.drop(*constant)
    present = _channels(data, values)
    gaps = impute.columns_with_gaps(data, present)
    if gaps:
        data = materialise(impute.impute_knn(data, gaps))
    chosen = _channels(data, derived)
    data = ordered.lag_features(data, layout, chosen, (1, 2, 3))
    data = ordered.rolling_features(data, layout, chosen, (5, 10, 20))
    data = materialise(data)  # the windows, for the scaling's fit and for its result
    scaling = scale.fit_scale(data, "standard", numeric_columns(data, frame))
    kept = {c: p for c, p in scaling.parameters.items() if c in present}
    means = {c: float(p[0]) for c, p in kept.items()}
    return scaling.apply(data), Preparation("kick", present, means, {c: (float(a), float(b)) for c, (a, b) in kept.items()})


INTERACTIONS: Mapping[str, Sequence[str]] = {
    "pressure": ("WBoPress", "FPress", "DPPress"),
    "mechanical": ("WoBit", "RoPen", "BTBR"),
    "hydraulic": ("FRate", "WBoPress"),
}


def drilling_features(df: DataFrame, series: SeriesLike, task: str = "formation") -> DataFrame:
    """The full feature set of a task, with gaps and infinities filled by column means."""
    layout: Layout = series.measure(df)
    frame = _frame_columns(series)
    original = numeric_columns(df, frame)
    out = features.efficiency_features(df)
    if task == "formation":
        out = features.formation_features(out)
        out = ordered.temporal_features(out, layout, ["WellDepth", "WBoPress", "RoPen", "BTBR"])
        out = features.depth_features(out, layout)
        out = features.physics_features(out)
        out = features.group_interactions(out, INTERACTIONS)
    elif task == "kick":
        out = ordered.kick_features(out, layout)
        out = ordered.temporal_features(out, layout, ["ActiveGL", "FIn", "FOut", "WBoPress", "MRFlow"])
        out = ordered.anomaly_features(out, layout, [c for c in numeric_columns(out, frame) if c in original])
        out = ordered.lag_features(out, layout, _channels(df, ["ActiveGL", "FIn", "FOut", "MRFlow"]), (1, 2, 3, 5))
    else:
        raise ValueError(f"unknown task {task}")
    # read twice: for the means and for the result
    out = materialise(out)
    return impute.fill_with_means(out, numeric_columns(out, frame))


def run_batch(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], task: str, target: str, models: Sequence[str],
    feature_columns: Sequence[str],
) -> tuple[dict[str, object], DataFrame, dict[str, str]]:
    """Fit every model on the leading 80 % of each series and compare them on the rest.

    A model that fails is recorded with its error and the others go on.
    """
    from ..models.evaluate import fit
    from ..operators.metrics import compare_detectors, compare_regressors
    from ..operators.split import holdout_split

    series = Series(tuple(keys), tuple(order))
    parts = holdout_split(df, series, 0.2)
    train, test = parts.where("split = 'train'"), parts.where("split = 'val'")
    fitted, failed = {}, {}
    for name in models:
        try:
            fitted[name] = fit(task, name, train, feature_columns, target)
        except Exception as problem:  # noqa: BLE001 - one model's failure must not end the run
            failed[name] = str(problem)
    scored = test
    for name, model in fitted.items():
        scored = model.transform(scored, output=f"p_{name}")
    columns = {name: f"p_{name}" for name in fitted}
    compare = compare_regressors if task == "formation_pressure" else compare_detectors
    return fitted, compare(scored, target, columns) if fitted else scored.limit(0), failed
