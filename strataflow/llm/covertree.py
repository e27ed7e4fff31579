"""Embedding near-duplicates by dual traversal of cover trees.

Every label's different vectors, scaled to length one, form a tree of nested levels whose radii halve: 2, 1, 1/2, ...
A level splits each node with more than LEAF vectors: its children's centres lie further apart than the level's radius,
the node's own centre among them, and every vector goes to the nearest centre, which is within that radius. Centres
come from a small sample of the node first; vectors that none of these covers choose centres among themselves, in
groups of bounded size. The radius that counts for pruning is measured: the distance of a node's furthest vector.
Nodes end as leaves when they are so tight that their vectors are surely linked to each other; the vectors of a wider
node of at most LEAF stand in its parent's list as leaves of their own, with radius zero.

Pairs of nodes are then followed down both trees, a level a round, as rows of a table: centres further apart than the
threshold and both radii cannot hold a link, so the pair goes; centres so close that even the furthest vectors are
linked count as links in whole; the rest is opened, and pairs of leaves are compared vector by vector. Work comes in
tiles of at most TILE x TILE entries. A tile returns counts per entry and a spanning forest of its links, never
the pairs themselves, so a large group of near copies costs no more than its members. Copies are one entry with a weight.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.session import materialise

from .graph import components

COSINE = 0.93
#: The vectors of a node of so many are leaves of their own.
LEAF = 64
#: Vectors of a node that are looked at for centres first.
SAMPLE = 128
#: Vectors that choose further centres among themselves.
GROUP = 4096
#: Entries of either side of a tile.
TILE = 1024
#: Levels; the radius of the last is 2 ** -DEPTH.
DEPTH = 24
#: More than the rounding of distances near zero.
SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _net(vectors: np.ndarray, radius: float, first: int = 0) -> list[int]:
    """Rows further apart than the radius that cover all others; row ``first`` is one."""
    chosen, open_ = [], np.ones(len(vectors), dtype=bool)
    at = first
    while True:
        chosen.append(at)
        open_ &= _distances(vectors, vectors[at : at + 1])[:, 0] > radius
        open_[at] = False
        left = np.flatnonzero(open_)
        if not left.size:
            return chosen
        at = int(left[0])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For links between rows i and j, the smallest row that each of n rows is connected to."""
    label = np.arange(n)
    while (label[i] != label[j]).any():
        lower = np.minimum(label[i], label[j])
        np.minimum.at(label, i, lower)
        np.minimum.at(label, j, lower)
        while (label[label] != label).any():
            label = label[label]
    return label


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, gid, root, v): the unit vector as bytes, a digest of the vector and its label, and the label's tree.

    Without a label, or a vector of finite numbers of which one is not zero, all three are null.
    """
    # vectors of different lengths have no cosine: each length is a tree of its own
    root = F.unhex(F.md5(F.concat_ws(":", F.size("embedding"), F.col("label").cast("string"))))
    own = vectors.select("vec_id", F.when(F.col("label").isNotNull(), root).alias("root"), F.col("embedding").cast("array<double>").alias("x"))
    kind = T.StructType([vectors.schema["vec_id"], *[T.StructField(n, T.BinaryType()) for n in ("gid", "root", "v")]])

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, lists = batch.column(1).to_pylist(), batch.column(2)
            starts = lists.offsets.to_numpy()
            sizes = np.where(np.array(lists.is_valid()), np.diff(starts), 0)
            values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
            gids, units = [None] * len(roots), [None] * len(roots)
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                x = values[starts[at][:, None] + np.arange(size)] + 0.0
                most = np.abs(x).max(axis=1)
                sound = np.isfinite(most) & (most > 0)
                # scaled by the largest component first, so that no square overflows or vanishes
                with np.errstate(invalid="ignore", divide="ignore"):
                    u = x / most[:, None]
                    u = (u / np.sqrt((u * u).sum(axis=1))[:, None]).astype("<f8")
                for i, row in enumerate(at):
                    if sound[i] and roots[row] is not None:
                        gids[row] = hashlib.blake2b(roots[row] + x[i].tobytes(), digest_size=16).digest()
                        units[row] = u[i].tobytes()
            kept = [r if g is not None else None for r, g in zip(roots, gids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.binary()) for c in (gids, kept, units)]], ["vec_id", "gid", "root", "v"])

    return own.mapInArrow(scaled, kind)


_ROWS = "gid binary, node binary, path array<binary>, v binary, weight long, far double, centre boolean"


def _split(radius: float):
    """Vectors of one node (a group of them) and its sampled centres: each vector with its child."""

    def work(rows: pa.Table, sample: pa.Table) -> pa.Table:
        x = _matrix(rows["v"])
        gids, parents, paths = (rows[c].to_pylist() for c in ("gid", "node", "path"))
        # the node's own centre comes first, so it is a centre of this level too
        order = sorted(range(sample.num_rows), key=lambda i: (not sample["own"][i].as_py(), sample["id"][i].as_py()))
        s, names = _matrix(sample["at"])[order], [sample["id"][i].as_py() for i in order]
        chosen = _net(s, radius)
        centres, ids = s[chosen], [names[i] for i in chosen]
        d = _distances(x, centres)
        near = d.argmin(axis=1)
        far = d[np.arange(len(x)), near]
        # a centre is nearest to itself whatever the rounding
        at = {g: i for i, g in enumerate(ids)}
        for i, g in enumerate(gids):
            if g in at:
                near[i], far[i] = at[g], 0.0
        rest = np.flatnonzero(far > radius)
        if rest.size:
            rest = rest[sorted(range(rest.size), key=lambda i: gids[rest[i]])]
            more = rest[_net(x[rest], radius)]
            e = _distances(x[rest], x[more])
            best = e.argmin(axis=1)
            near[rest], far[rest] = len(ids) + best, e[np.arange(len(rest)), best]
            near[more], far[more] = len(ids) + np.arange(len(more)), 0.0
            ids += [gids[i] for i in more]
        child = [hashlib.md5(parents[i] + ids[near[i]]).digest() for i in range(len(gids))]
        return pa.table(
            {
                "gid": rows["gid"], "node": pa.array(child, pa.binary()), "path": pa.array([[*p, c] for p, c in zip(paths, child)], pa.list_(pa.binary())),
                "v": rows["v"], "weight": rows["weight"], "far": pa.array(far, pa.float64()),
                "centre": pa.array([gids[i] == ids[near[i]] for i in range(len(gids))], pa.bool_()),
            }
        )

    return work


def _ended(rows: DataFrame, level: DataFrame, top: bool) -> tuple[DataFrame, DataFrame]:
    """Rows whose node is a leaf; rows of small nodes, as leaves of their own in the parent's list (a top has none)."""
    told = rows.join(level.where("kind <> 'open'").select("node", "kind"), "node")
    above = F.col("path") if top else F.slice("path", 1, F.size("path") - 1)
    leaves = told.where("kind = 'leaf'").select("gid", "node", "path", "v", "weight")
    singles = told.where("kind = 'small'").select("gid", F.col("gid").alias("node"), F.concat(above, F.array("gid")).alias("path"), "v", "weight")
    return leaves, singles


def grown(points: DataFrame, reach: float, leaf: int = LEAF, sample: int = SAMPLE, group: int = GROUP, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The trees of ``points`` (gid, root, v, weight): (nodes, rows), rows with their leaf and the path to it.

    nodes: node, parent (null for a root), v, far, weight, leaf. ``reach`` is the distance of the threshold.
    """
    rows = points.select("gid", F.col("root").alias("node"), F.array("root").alias("path"), "v", "weight")
    tops = points.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.min("gid").alias("gid"))
    small = F.when(F.col("n") <= leaf, "small").otherwise("open").alias("kind")
    level = materialise(tops.join(points.select("gid", "v"), "gid").select(F.col("root").alias("node"), F.lit(None).cast("binary").alias("parent"), "gid", "v", "n", "weight", F.lit(2.0).alias("far"), small))
    nodes, ended = [level.withColumn("leaf", F.lit(False))], []
    for depth in range(1, DEPTH + 2):
        leaves, singles = _ended(rows, level, depth == 1)
        ended += [leaves, singles]
        open_ = level.where("kind = 'open'").select("node", F.col("gid").alias("own"), F.ceil(F.col("n") / group).cast("long").alias("groups"))
        if open_.limit(1).count() == 0:
            break
        going = rows.join(open_, "node")
        # the sample: the node's centre, then the first by a hash
        order = Window.partitionBy("node").orderBy(F.col("gid") != F.col("own"), F.xxhash64("gid", F.lit(depth)), "gid")
        taken = going.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))
        right = taken.select(F.col("node").alias("of"), F.col("gid").alias("id"), F.col("v").alias("at"), (F.col("gid") == F.col("own")).alias("own"), parts.alias("share"))
        left = going.select("gid", "node", "path", "v", "weight", F.pmod(F.xxhash64("gid", F.lit(-depth)), F.col("groups")).alias("part"))
        work = _split(2.0 ** (1 - depth))
        rows = materialise(left.groupBy("node", "part").cogroup(right.groupBy("of", "share")).applyInArrow(work, _ROWS))
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.max("far").alias("far"))
        middle = rows.where("centre").select("node", F.element_at("path", -2).alias("parent"), "gid", "v").dropDuplicates(["node"])
        # all links inside are sure up to reach / 2; large nodes go on, so that fewer of their vectors are compared one by one
        tight = (F.col("far") <= reach / 4) | ((F.col("far") <= reach / 2 - SLACK) & (F.col("n") <= tile)) | F.lit(depth == DEPTH)
        kind = F.when(tight, "leaf").when(F.col("n") <= leaf, "small").otherwise("open")
        level = materialise(middle.join(stats, "node").select("node", "parent", "gid", "v", "n", "weight", "far", kind.alias("kind")))
        nodes.append(level.where("kind <> 'small'").withColumn("leaf", F.col("kind") == "leaf"))
    placed = ended[0]
    for part in ended[1:]:
        placed = placed.unionByName(part)
    placed = materialise(placed)
    every = placed.where(F.col("node") == F.col("gid")).select("node", F.element_at("path", -2).alias("parent"), "v", F.lit(0.0).alias("far"), "weight", F.lit(True).alias("leaf"))
    for part in nodes:
        every = every.unionByName(part.select(every.columns))
    return materialise(every), placed


def _chunked(entries: DataFrame, tile: int) -> DataFrame:
    """``entries`` (owner, ...) with the number of the chunk that each stands in, of about half a tile on average."""
    sizes = entries.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("chunks"))
    return entries.join(sizes, "owner").withColumn("chunk", F.pmod(F.xxhash64("owner", "id"), F.col("chunks")))


_FOUND = "kind string, x binary, y binary, n long, leafx boolean, leafy boolean"


def _tile(reach: float, cosine: float, exact: bool):
    """What a tile of two chunks (side 0 and 1; a chunk with itself: side 0 alone) holds.

    kind pair: opened further; count: n linked vectors for all of x; edge: x and y are connected.
    """

    def work(rows: pa.Table) -> pa.Table:
        ids, side = rows["id"].to_pylist(), np.array(rows["side"].to_pylist())
        order = sorted(range(len(ids)), key=lambda i: (side[i], ids[i]))
        rows, ids, side = rows.take(pa.array(order)), [ids[i] for i in order], side[order]
        x, far, weight = _matrix(rows["v"]), rows["far"].to_numpy(), rows["weight"].to_numpy()
        leaf = np.array(rows["leaf"].to_pylist())
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if (side == 1).any() else a
        alone = b is a
        dots = x[a] @ x[b].T
        if alone:
            np.fill_diagonal(dots, 1.0)
        # what can hold a link at all, then each of these by its own radii
        least = cosine if exact else 1.0 - (far[a].max() + far[b].max() + reach + SLACK) ** 2 / 2
        i, j = np.nonzero(dots >= least)
        if alone:
            upper = i <= j
            i, j = i[upper], j[upper]
        if exact:
            opened = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        else:
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots[i, j]))
            around = far[a[i]] + far[b[j]]
            sure = d + around <= reach - SLACK
            maybe = ~sure & (d - around <= reach + SLACK)
            opened, i, j = (a[i[maybe]], b[j[maybe]]), i[sure], j[sure]
        p, q = a[i], b[j]
        counts = np.zeros(len(ids), dtype=np.int64)
        np.add.at(counts, p, weight[q])
        np.add.at(counts, q[p != q], weight[p[p != q]])
        top = _forest(len(ids), p, q)
        # entries of nodes stand for all their vectors, so one that is linked to itself alone is named too
        named = np.union1d(p, q)
        if exact:
            named = named[top[named] != named]
        held = np.flatnonzero(counts)
        first, second = np.concatenate([opened[0], held, named]), np.concatenate([opened[1], held, top[named]])
        n = np.concatenate([np.zeros(len(opened[0]), dtype=np.int64), counts[held], np.zeros(len(named), dtype=np.int64)])
        said = ["pair"] * len(opened[0]) + ["count"] * len(held) + ["edge"] * len(named)
        found = {"kind": said, "x": [ids[k] for k in first], "y": [ids[k] for k in second], "n": n, "leafx": leaf[first], "leafy": leaf[second]}
        kinds = {"kind": pa.string(), "x": pa.binary(), "y": pa.binary(), "n": pa.int64(), "leafx": pa.bool_(), "leafy": pa.bool_()}
        return pa.table({name: pa.array(values, kinds[name]) for name, values in found.items()})

    return work


def _tiles(pairs: DataFrame, entries: DataFrame, work) -> DataFrame:
    """``work`` over all tiles of the pairs (a, b) of owners; a <= b stands for both orders."""
    chunks = entries.select("owner", "chunks").distinct()
    seq = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    wide = pairs.join(chunks.toDF("a", "na"), "a").join(chunks.toDF("b", "nb"), "b")
    wide = wide.select("a", "b", F.explode(seq("na")).alias("ca"), "nb").select("a", "b", "ca", F.explode(seq("nb")).alias("cb"))
    wide = wide.where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
    same = (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))
    sides = F.when(same, F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("owner"), F.col("ca").alias("chunk")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("owner"), F.col("ca").alias("chunk")), F.struct(F.lit(1).alias("side"), F.col("b").alias("owner"), F.col("cb").alias("chunk")))
    )
    asked = wide.select("a", "b", "ca", "cb", F.explode(sides).alias("s")).select("a", "b", "ca", "cb", "s.*")
    full = asked.join(entries.drop("chunks"), ["owner", "chunk"]).drop("owner", "chunk")
    return full.groupBy("a", "b", "ca", "cb").applyInArrow(work, _FOUND)


def traversed(nodes: DataFrame, rows: DataFrame, cosine: float = COSINE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(counts, edges): linked vectors per node or vector (x, n; a node's hold for all its vectors), connected ones (a, b)."""
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    entry = ["id", "v", "far", "weight", "leaf"]
    children = nodes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("owner"), F.col("node").alias("id"), "v", "far", "weight", "leaf")
    # beside an inner node a leaf is opened as itself
    alone = nodes.where("leaf").select(F.col("node").alias("owner"), F.col("node").alias("id"), "v", "far", "weight", "leaf")
    inner = materialise(_chunked(children.unionByName(alone), tile).select("owner", "chunk", "chunks", *entry))
    members = rows.select(F.col("node").alias("owner"), F.col("gid").alias("id"), "v", F.lit(0.0).alias("far"), "weight", F.lit(True).alias("leaf"))
    leaves = materialise(_chunked(members, tile).select("owner", "chunk", "chunks", *entry))
    roots = nodes.where(F.col("parent").isNull())
    step = roots.select(F.lit("pair").alias("kind"), F.col("node").alias("x"), F.col("node").alias("y"), F.lit(0).cast("long").alias("n"), F.col("leaf").alias("leafx"), F.col("leaf").alias("leafy"))
    step, seen = materialise(step), []
    while True:
        seen.append(step)
        pairs = step.where("kind = 'pair' AND NOT (leafx AND leafy)").select(F.col("x").alias("a"), F.col("y").alias("b"))
        if pairs.limit(1).count() == 0:
            break
        step = materialise(_tiles(pairs, inner, _tile(reach, cosine, exact=False)))
    found = seen[0]
    for part in seen[1:]:
        found = found.unionByName(part)
    last = found.where("kind = 'pair' AND leafx AND leafy").select(F.col("x").alias("a"), F.col("y").alias("b"))
    compared = materialise(_tiles(last, leaves, _tile(reach, cosine, exact=True)))
    every = found.unionByName(compared)
    counts = every.where("kind = 'count'").select("x", "n")
    edges = every.where("kind = 'edge'").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return counts, edges


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF, sample: int = SAMPLE, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept.

    Rows are compared within a label only. A null label, and a null or zero vector or one with null or non-finite
    components, link with nothing; vectors of different lengths have no cosine and are not linked. Repeated rows are
    vectors of their own and linked to each other. A null vec_id keeps its row and gets the smallest id of its component, null if
    there is none; kept compares nulls as equal. An empty table gives no rows.
    """
    rows = materialise(unit_vectors(vectors.select("vec_id", "embedding", "label")))
    points = rows.where(F.col("gid").isNotNull()).groupBy("gid").agg(F.first("root").alias("root"), F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    points = materialise(points)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    nodes, placed = grown(points, reach, leaf, sample, group, tile)
    counts, edges = traversed(nodes, placed, cosine, tile)
    above = placed.select("gid", F.explode(F.array_union("path", F.array("gid"))).alias("x"))
    links = above.join(counts, "x").groupBy("gid").agg(F.sum("n").alias("n"))
    # a node in an edge stands for its vectors: they are connected through it
    named = edges.select("a").union(edges.select("b")).distinct()
    down = above.where(F.col("x") != F.col("gid")).join(named, F.col("x") == F.col("a"), "left_semi").select(F.col("gid").alias("a"), F.col("x").alias("b"))
    joined = materialise(edges.where(F.col("a") != F.col("b")).union(down))
    known = points.select("gid", "least").join(links, "gid").join(components(joined).withColumnRenamed("node", "gid"), "gid", "left")
    known = materialise(known.select("gid", "least", "n", F.coalesce("component", "gid").alias("component")))
    tops = known.groupBy("component").agg(F.min("least").alias("component_id"))
    told = known.join(tops, "component").select("gid", (F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "gid").join(told, "gid", "left")
    component = F.when(F.col("gid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
