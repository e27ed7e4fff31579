"""Nearest donors by a k-d tree of boxes that is kept as tables.

Different donor rows are counted once and dealt to boxes: each round fits a small k-d tree to a bounded sample of every box
that is still too full, and sends the box's rows down that tree. A split is by a value or by whether a value is
missing. Every level is a table (box, parent, rows, least and largest value of each column, where gaps are), so neither
the driver nor a task holds the tree, and the number of rounds grows with the logarithm of the donors.

A receiver first goes down to the nearest box and takes the k-th distance there as its radius. Then it goes down
again, into every box whose nearest corner lies within the radius, and meets the donors of those boxes. Samples only
place the splits; corners are measured on all rows, so the result is exact. How many boxes a receiver visits
depends on how far the columns hang together: independent columns by the dozen leave little to prune in any tree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Rows of a box that its tree is fitted to, and rows that go down a tree in one group.
SAMPLE, DEALT = 20_000, 100_000
#: Fewest sampled rows in a leaf of a fitted tree.
LEAST = 64
#: Boxes of a level, some hundred bytes each, that are sent to every task; more are shuffled.
BROADCAST_BOXES = 20_000
#: Distances may differ by this share where sums are rounded.
SLACK = 1 + 1e-9


def _split(x: np.ndarray) -> tuple[int, float] | None:
    """(column, cut) for rows x: left where missing or at most the cut; a NaN cut sends only the missing left."""
    gaps = np.isnan(x).mean(axis=0)
    mixed = np.minimum(gaps, 1 - gaps)
    if mixed.max() > 0.05:
        return int(mixed.argmax()), np.nan
    full = np.where(np.isnan(x), -np.inf, x)
    top, low = full.max(axis=0), np.where(np.isnan(x), np.inf, x).min(axis=0)
    spread = np.where(top > low, top - low, 0.0)
    if spread.max() > 0:
        axis = int(spread.argmax())
        known = np.sort(x[~np.isnan(x[:, axis]), axis])
        cut = known[(len(known) - 1) // 2]
        return axis, float(cut if cut < known[-1] else known[known < known[-1]][-1])
    return (int(mixed.argmax()), np.nan) if mixed.max() > 0 else None


def _goes_left(x: np.ndarray, axis: int, cut: float) -> np.ndarray:
    return np.isnan(x[:, axis]) | (x[:, axis] <= cut)


def _fit(x: np.ndarray, leaf: int) -> list[tuple[int, float, int, int]]:
    """Nodes (column, cut, left, right) of a k-d tree; a leaf has column -1 and its number in left."""
    nodes, open_, leaves = [(0, 0.0, 0, 0)], [(0, x)], 0
    while open_:
        at, rows = open_.pop()
        found = _split(rows) if len(rows) > leaf else None
        if found is None:
            nodes[at] = (-1, 0.0, leaves, 0)
            leaves += 1
            continue
        left = _goes_left(rows, *found)
        nodes[at] = (*found, len(nodes), len(nodes) + 1)
        open_ += [(len(nodes), rows[left]), (len(nodes) + 1, rows[~left])]
        nodes += [(0, 0.0, 0, 0)] * 2
    return nodes


def _deal(x: np.ndarray, nodes: Sequence[tuple[int, float, int, int]]) -> np.ndarray:
    """The leaf of every row."""
    out, open_ = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
    while open_:
        at, rows = open_.pop()
        axis, cut, low, high = nodes[at]
        if axis < 0:
            out[rows] = low
            continue
        left = _goes_left(x[rows], axis, cut)
        open_ += [(low, rows[left]), (high, rows[~left])]
    return out


class DonorTree:
    """Boxes of donors, level by level, and the donors with the box each is in."""

    def __init__(self, donors: DataFrame, columns: Sequence[str], leaf: int):
        self.columns, self.leaf = list(columns), leaf
        places = [f"x{i}" for i in range(len(columns))]
        named = donors.select(*[F.col(c).alias(p) for c, p in zip(columns, places)])
        counted = named.groupBy(*places).agg(F.count(F.lit(1)).alias("n"))
        # a name per box is its way from the root
        self.members = materialise(counted.withColumn("box", F.lit("")))
        self.places, self.levels, self.level_sizes = places, [], []
        while True:
            boxes = materialise(self._measured())
            size, fullest = boxes.agg(F.count(F.lit(1)), F.max("rows")).first()
            self.levels.append(boxes)
            self.level_sizes.append(size)
            if (fullest or 0) <= leaf:
                return
            self.members = materialise(self._dealt(boxes))

    def _measured(self) -> DataFrame:
        """A row per box; its parent is its name without the last step."""
        boxes = self.members.groupBy("box").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"),
            F.array(*[F.min(p) for p in self.places]).alias("lo"), F.array(*[F.max(p) for p in self.places]).alias("hi"),
            F.array(*[F.count(p) == F.count(F.lit(1)) for p in self.places]).alias("whole"),
        )
        parent = F.regexp_replace("box", "/[^/]*$", "")
        return boxes.withColumn("parent", parent).withColumn("full", F.col("rows") > self.leaf)

    def _dealt(self, boxes: DataFrame) -> DataFrame:
        """Members of too full boxes in the leaves of trees fitted to samples; the others stay where they are."""
        places, least = self.places, self.leaf
        full = boxes.where("full").select("box", "rows")
        own = self.members.join(full, "box")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            rate = min(1.0, len(pdf) / float(pdf["rows"].iloc[0]))
            nodes = _fit(pdf[places].to_numpy(float), max(1, int(least * rate * 0.75)) if rate == 1 else max(LEAST, int(least * rate * 0.75)))
            table = np.array(nodes, dtype=float).T.tolist()
            return pd.DataFrame({"box": [pdf["box"].iloc[0]], **{n: [v] for n, v in zip(("axis", "cut", "low", "high"), table)}})

        chosen = own.where(F.rand(17) * F.col("rows") < F.lit(SAMPLE))
        trees = materialise(chosen.groupBy("box").applyInPandas(fit, "box string, axis array<double>, cut array<double>, low array<double>, high array<double>"))
        shares = F.ceil(F.col("rows") / DEALT).cast("int")
        salted = own.withColumn("salt", F.pmod(F.xxhash64(*places), shares).cast("int")).drop("rows")
        copies = trees.join(full, "box").withColumnRenamed("box", "own_box").withColumn("own_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("rows")

        def deal(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = left[[*places, "n", "box"]].copy()
            if len(left) and len(right):
                one = right.iloc[0]
                nodes = [(int(a), c, int(b), int(d)) for a, c, b, d in zip(one["axis"], one["cut"], one["low"], one["high"])]
                out["box"] = out["box"] + "/" + pd.Series(_deal(left[places].to_numpy(float), nodes), index=out.index).astype(str)
            return out

        schema = ", ".join([*[f"{p} double" for p in places], "n long", "box string"])
        moved = salted.groupBy("box", "salt").cogroup(copies.groupBy("own_box", "own_salt")).applyInPandas(deal, schema)
        stay = self.members.join(full.select("box"), "box", "left_anti").select(*places, "n", "box")
        return moved.unionByName(stay)

    # -- search --------------------------------------------------------------------

    def _distances(self) -> tuple[Column, Column, Column]:
        """(usable, near, far) of receiver x, target t and box lo, hi, whole: bounds of the gap-aware distance.

        A column counts towards near where every row of the box has it, towards far where any has.
        """
        width = len(self.places)
        near = far = F.lit(0.0)
        most = surely = F.lit(0)
        for i in range(width):
            x, lo, hi, whole = (F.get(c, F.lit(i)) for c in ("x", "lo", "hi", "whole"))
            met = x.isNotNull() & lo.isNotNull()
            gap, off = F.greatest(lo - x, x - hi, F.lit(0.0)), F.greatest(F.abs(x - lo), F.abs(x - hi))
            near = near + F.when(met & whole, gap * gap).otherwise(0.0)
            far = far + F.when(met, off * off).otherwise(0.0)
            most = most + F.when(met, 1).otherwise(0)
            surely = surely + F.when(met & whole, 1).otherwise(0)
        usable = F.get("lo", F.col("t")).isNotNull() & (most > 0)
        sure = F.get("whole", F.col("t")) & (surely > 0)
        return usable, near * width / F.greatest(most, F.lit(1)), F.when(sure, far * width / F.greatest(surely, F.lit(1)))

    def _level(self, i: int) -> DataFrame:
        boxes = self.levels[i]
        return F.broadcast(boxes) if self.level_sizes[i] <= BROADCAST_BOXES else boxes

    def _down(self, asked: DataFrame, i: int) -> DataFrame:
        """Asked (…, parent) with the boxes of level i below the parent, their near and far bounds."""
        usable, near, far = self._distances()
        met = asked.join(self._level(i), "parent").where(usable)
        return met.withColumns({"near": near, "far": far}).drop("lo", "hi", "whole")

    def _searched(self, asked: DataFrame, k: int, slice_rows: int) -> DataFrame:
        """(rid, t, dist, value, copies): of every asked box (rid, t, x, radius, box) the k nearest donors within the radius."""
        places, width = self.places, len(self.places)
        # many receivers of one box are cut into slices, each of which meets the box's rows
        crowds = asked.groupBy("box").agg(F.count(F.lit(1)).alias("asks")).where(F.col("asks") > slice_rows)
        spread = F.ceil(F.coalesce("asks", F.lit(1)) / slice_rows).cast("int")
        asked = asked.join(crowds, "box", "left").withColumn("slice", F.pmod("rid", spread).cast("int")).drop("asks")
        wanted = asked.select(F.col("box").alias("own_box"), F.col("slice").alias("own_slice")).distinct()
        offered = self.members.join(wanted, F.col("box") == F.col("own_box")).drop("box")

        def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            donors, weight = right[places].to_numpy(float), right["n"].to_numpy()
            known = ~np.isnan(donors)
            filled = np.where(known, donors, 0.0)
            for r, t, x, radius in zip(left["rid"], left["t"], left["x"], left["radius"]):
                x = np.asarray(x, dtype=float)
                shared = known & ~np.isnan(x)
                n = shared.sum(axis=1)
                dist = (np.where(shared, filled - np.nan_to_num(x), 0.0) ** 2).sum(axis=1) * width / np.maximum(n, 1)
                ok = (n > 0) & known[:, t]
                if radius is not None and not np.isnan(radius):
                    ok &= dist <= radius * SLACK
                rows = np.flatnonzero(ok)
                if len(rows) > k:
                    rows = rows[dist[rows] <= np.partition(dist[rows], k - 1)[k - 1]]
                # ties in distance are ordered by value, so that the cut into boxes does not matter
                best = rows[np.lexsort((donors[rows, t], dist[rows]))[:k]]
                out += [(r, t, dist[b], donors[b, t], min(int(weight[b]), k)) for b in best]
            return pd.DataFrame(out, columns=["rid", "t", "dist", "value", "copies"])

        found = asked.select("rid", "t", "x", "radius", "box", "slice").groupBy("box", "slice").cogroup(offered.groupBy("own_box", "own_slice"))
        return found.applyInPandas(nearest, "rid long, t int, dist double, value double, copies long")

    def nearest(self, asked: DataFrame, k: int, slice_rows: int) -> DataFrame:
        """(rid, t, dist, value, copies): the k nearest donors, and some more, of every (rid, t, x)."""
        none = F.lit(None).cast("double")
        home, reach = asked.withColumn("parent", F.lit("")).withColumn("radius", none), None
        for i in range(len(self.levels)):
            down = self._down(home, i)
            # a box with k donors bounds the radius by its farthest corner; the way goes on in the nearest one
            bound = F.least("radius", F.when(F.col("n") >= k, F.col("far")))
            best = down.withColumn("radius", bound).groupBy("rid", "t").agg(
                F.min("radius").alias("radius"), F.first("x").alias("x"),
                F.min_by(F.struct("box", "full"), F.struct(F.col("n") < k, F.col("near"), F.col("box"))).alias("c"),
            )
            best = materialise(best.select("rid", "t", "x", "radius", "c.box", "c.full"))
            done = best.where(~F.col("full")).drop("full")
            reach = done if reach is None else reach.unionByName(done)
            home = best.where("full").drop("full").withColumnRenamed("box", "parent")
        first = materialise(self._searched(reach, k, slice_rows))
        if len(self.levels) == 1:
            return first
        kth = first.groupBy("rid", "t").agg(F.when(F.sum("copies") >= k, F.max("dist")).alias("kth"))
        # a receiver whose way down ended without a donor has no radius and looks everywhere
        start = asked.join(reach.select("rid", "t", "radius", F.col("box").alias("home")), ["rid", "t"], "left").join(kth, ["rid", "t"], "left")
        alive, leaves = start.withColumn("radius", F.least("radius", "kth")).drop("kth").withColumn("parent", F.lit("")), None
        for i in range(len(self.levels)):
            down = self._down(alive, i).where(F.col("radius").isNull() | (F.col("near") <= F.col("radius") * SLACK))
            down = materialise(down.select("rid", "t", "x", "radius", "home", "box", "full"))
            ends = down.where(~F.col("full") & (~F.col("box").eqNullSafe(F.col("home")))).drop("full", "home")
            leaves = ends if leaves is None else leaves.unionByName(ends)
            alive = down.where("full").drop("full").withColumnRenamed("box", "parent")
        return first.unionByName(self._searched(materialise(leaves), k, slice_rows))
