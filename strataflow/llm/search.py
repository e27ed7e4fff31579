"""Ranked lexical search: accumulator-limited term-at-a-time over slices of the documents.

Documents are read once, into an index of the words that the items use: one row per document with these words, their
occurrences, and its length. A filter of hashed words of a fixed size decides what goes into the index; what it lets
through by chance is read past later. Items are taken in blocks of bounded size, each against the whole index.

A task walks its documents in slices. For every item it takes the terms rarest first and adds their contributions
to accumulators. Before each term it knows the most that this and all later terms can give; once that is under the
k-th best score so far (of the slice's accumulators and the task's earlier results), documents without an
accumulator cannot reach the list any more and get none, while the others are updated exactly to the last term. Each
task hands on its best k per item, and these are merged by score and doc_id.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.session import materialise

#: Documents that are listed per item.
TOP = 10
#: Different terms of the items that are searched for at once.
BLOCK_TERMS = 200_000
#: Size of the filter of hashed words.
FILTER = 1 << 22
#: Groups in which the tasks' lists are merged first.
SALTS = 64

#: A-Z to a-z; ASCII characters other than letters and digits to a space. Bytes of other characters stay.
_TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _slots(items: DataFrame) -> np.ndarray:
    """Which hashed words the items use, as bits of a fixed number of slots."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {zlib.crc32(t) % FILTER for text in batch.column(0).to_pylist() for t in terms_of(text)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["slot"])

    used = items.select(F.col("text").cast("string").cast("binary")).mapInArrow(hashed, "slot int").distinct()
    bits = np.zeros(FILTER, dtype=bool)
    for row in used.toLocalIterator():  # at most FILTER numbers
        bits[row["slot"]] = True
    return bits


def indexed(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with any word: its length, and the words that pass the items' filter."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(_slots(items)))
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.binary())), ("tfs", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        known: dict[bytes, bool] = {}
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                if len(known) > FILTER:
                    known.clear()
                held = {}
                for t, tf in Counter(words).items():
                    if (has := known.get(t)) is None:
                        has = known[t] = bool(bits[zlib.crc32(t) % FILTER])
                    if has:
                        held[t] = tf
                for column, value in zip(rows, (doc, len(words), list(held), list(held.values()))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, kind)], schema=kind)

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return whole.mapInArrow(read, "doc_id long, n long, terms array<binary>, tfs array<long>")


class _Slice:
    """Contributions of the terms in some documents, without the terms' weights."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: dict[bytes, int], n_docs: int, n_terms: int):
        ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        self.ids = [(doc is None, doc if doc is not None else 0) for doc in ids]
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        codes = np.fromiter((vocabulary.get(t, -1) for t in batch.column(2).flatten().to_pylist()), dtype=np.int64)
        known = codes >= 0
        place = np.repeat(np.arange(len(ids)), sizes)[known]
        tf = batch.column(3).flatten().to_numpy()[known]
        m = np.array([100 - 90 + 90 * n * n_docs // n_terms for n in lengths], dtype=np.int64)
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[place])
        codes = codes[known]
        order = np.argsort(codes, kind="stable")
        codes, self.place, self.part = codes[order], place[order], part[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.array([], dtype=np.int64)
        ends = np.r_[starts[1:], len(codes)]
        self.span = {int(codes[a]): (int(a), int(b)) for a, b in zip(starts, ends)}
        self.most = {c: int(self.part[a:b].max()) for c, (a, b) in self.span.items()}

    def best(self, terms: list[tuple[int, int]], top: int, floor: int) -> tuple[list[tuple[int, tuple]], int]:
        """The ``top`` (score, id) over ``floor`` or equal to it, of terms (code, weight), rarest first; accumulators made."""
        held = [(c, w) for c, w in terms if c in self.span]
        rest = np.cumsum([w * self.most[c] for c, w in held][::-1])[::-1] if held else []
        score = np.zeros(len(self.ids), dtype=np.int64)
        open_, made = True, np.zeros(len(self.ids), dtype=bool)
        for (c, w), bound in zip(held, rest):
            if open_:
                kth = floor
                if int(made.sum()) >= top:
                    kth = max(kth, int(np.partition(score[made], -top)[-top]))
                open_ = bound >= kth  # an equal score still counts: the smaller doc_id wins
            a, b = self.span[c]
            at, part = self.place[a:b], w * self.part[a:b]
            if open_:
                made[at] = True
            else:
                live = made[at]
                at, part = at[live], part[live]
            score[at] += part
        found = np.flatnonzero(made & (score > 0) & (score >= floor))
        if len(found) > top:
            least = np.partition(score[found], -top)[-top]
            found = found[score[found] >= least]
        listed = sorted(((int(score[i]), self.ids[i]) for i in found), key=lambda x: (-x[0], x[1]))[:top]
        return listed, int(made.sum())


def _lists(index: DataFrame, asked: list[tuple[int, list[tuple[bytes, int]]]], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of the items asked for."""
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in asked for t, _ in terms))}
    coded = [(item, [(vocabulary[t], w) for t, w in terms]) for item, terms in asked]
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, coded))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, items = shared.value
        best: dict[int, list] = {}
        for batch in batches:
            here = _Slice(batch, words, n_docs, n_terms)
            for item, terms in items:
                old = best.get(item, [])
                floor = old[-1][0] if len(old) == top else 1
                new, _ = here.best(terms, top, floor)
                if new:
                    best[item] = heapq.nsmallest(top, old + new, key=lambda x: (-x[0], x[1]))
        rows = [(item, None if no else doc, score) for item, listed in best.items() for score, (no, doc) in listed]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item", "doc_id", "score"]
        )

    return index.mapInArrow(walk, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per item: item_id, rank (from 1), doc_id, score of its ``top`` documents with a score above 0.

    Null and empty texts have no terms: such documents count nowhere, such items list none. Every row of ``items`` is an
    item of its own, also with a null or repeated item_id, and every row of ``docs`` a document. Equal scores are
    ordered by doc_id, null last; rows of equal score and doc_id take neighbouring ranks. Empty tables give no rows.
    """
    spark = docs.sparkSession
    index = materialise(indexed(docs.select("doc_id", "text"), items))
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    # an item's terms once each; rows of equal item_id and text are told apart by their number among them
    numbered = items.select("item_id", F.col("text").cast("string").alias("text"))
    same = Window.partitionBy("item_id", "text").orderBy(F.lit(1))
    named = materialise(numbered.withColumn("copy", F.row_number().over(same)).withColumn("item", F.xxhash64(F.col("item_id").cast("string"), F.length("text"), F.sha2("text", 256), "copy")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in dict.fromkeys(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], ["item", "term"])

    uses = named.select("item", F.col("text").cast("binary")).mapInArrow(split, "item long, term binary")
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    wanted = materialise(uses.join(df, "term"))  # terms in no document add nothing
    blocks = max(1, -(-wanted.count() // block_terms))
    place = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for k in range(blocks):
        asked: dict[int, list] = {}
        for row in wanted.where(place == k).collect():  # about block_terms rows
            asked.setdefault(row["item"], []).append((row["df"], bytes(row["term"])))
        queries = [(item, [(t, weight(n_docs, n)) for n, t in sorted(terms)]) for item, terms in sorted(asked.items())]
        part = _lists(index, queries, n_docs, n_terms or 1, top)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = materialise(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = first.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
