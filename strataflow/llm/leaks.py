"""Benchmark passages in documents, by a prefix-filtered join in built-in functions alone.

An item is cut into windows of consecutive words. For an exact containment of a window, one word of it is a necessary
prefix: the rarest over all documents. Documents are searched for these anchor words in place; only where one
stands, and only if the text has room for the window before and after it, a row with the words around it goes on to be
verified word by word. Which words are anchors is told by a bit table of their hashes, so one read of the documents serves
a benchmark of any size; words that share a bit with an anchor are left behind by the join with the windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.session import materialise

from .common import ascii_lower, unused

WINDOW = 10
#: Windows of the benchmark that are sent to every task; more are shuffled to the places of their anchors.
BLOCK = 20_000
#: Bits for each anchor, and the fewest and most bits of the table: a full table costs time, never results.
ANCHOR_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 24
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of letters, digits and all characters beyond ASCII, with A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, item_id): every window of every item; an item of fewer words, but not none, is one window."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).select("words", "item_id").distinct()


def _anchored(windows: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """(words, item_id, anchor, at): the window's rarest word over all documents, and its place (from 0)."""
    needed = materialise(windows.select(F.explode("words").alias("word")).distinct())
    # a word of the documents is counted only if the benchmark has it; counts are summed before the shuffle
    told = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(needed, "word", "left_semi")
    counts = materialise(told.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # windows of equal words are one key here, so the order of rarity is one value per word
    flat = windows.select("words").distinct().select("words", F.posexplode("words").alias("at", "word")).join(counts, "word", "left")
    best = flat.groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("at"))).alias("k"))
    return windows.join(best, "words").select("words", "item_id", F.col("k.word").alias("anchor"), F.col("k.at").alias("at"), F.col("k.n").alias("n"))


def _anchor_test(anchors: DataFrame, n: int):
    """A test of a word: true for every anchor, and for few other words."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (ANCHOR_BITS * n - 1).bit_length()))
    slot = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int")
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    hashed = anchors.select(F.xxhash64("anchor").alias("h"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))
    held = hashed.groupBy(slot(F.col("h")).alias("slot")).agg(F.bit_or(one).alias("bits")).collect()  # at most bits / 64 rows
    table = np.zeros(bits // 64, dtype=np.int64)
    for r in held:
        table[r["slot"]] = r["bits"]
    known = F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<bigint>")
    return lambda w: F.getbit(F.get(known, slot(F.xxhash64(w))), bit(F.xxhash64(w))) == 1


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, row, start, size, item_id): every occurrence of a window in a document; start counts words from 0."""
    anchored = materialise(_anchored(windows_of(items, window), docs, window).where(F.col("n") > 0))
    different = materialise(anchored.select("words", "anchor", "at").distinct())
    n, n_anchors = different.agg(F.count(F.lit(1)), F.count_distinct("anchor")).first()
    is_anchor = _anchor_test(different, n_anchors)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("w"))
    rows = rows.withColumn("held", F.filter(F.transform("w", lambda w, i: F.when(is_anchor(w), i)), lambda i: i.isNotNull()))
    near = F.transform("held", lambda i: F.struct(
        i.alias("i"), F.get("w", i).alias("anchor"), F.least(i, F.lit(window - 1)).alias("before"),
        F.slice("w", F.greatest(i - (window - 1), F.lit(0)) + 1, F.lit(2 * window - 1) - (F.lit(window - 1) - F.least(i, F.lit(window - 1)))).alias("around"),
    ))
    seen = rows.where(F.size("held") > 0).select("doc_id", "row", F.explode(near).alias("c")).select("doc_id", "row", "c.*")
    met = seen.join(F.broadcast(different) if n <= block else different, "anchor")
    # room before and after the anchor, then the words themselves
    first = F.col("before") - F.col("at")
    exact = met.where((first >= 0) & (first + F.size("words") <= F.size("around"))).where(F.slice("around", first + 1, F.size("words")) == F.col("words"))
    found = materialise(exact.select("doc_id", "row", (F.col("i") - F.col("at")).alias("start"), F.size("words").alias("size"), "words").distinct())
    return found.join(anchored.select("words", "item_id"), "words").select("doc_id", "row", "start", "size", "item_id")


def checked(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null has no words. Rows with equal doc_id and text get equal results and keep their number. Items without
    words are left out. An item with a null item_id hits words like any other, but has no name to count or list.
    Empty tables give no hits.
    """
    own = materialise(hits(docs, items, window))
    spans = own.select("doc_id", "row", "start", "size").distinct()
    covered = spans.select("doc_id", "row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = own.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    told = covered.join(listed, (covered["doc_id"].eqNullSafe(listed["doc_id"])) & (covered["row"] == listed["row"])).select(
        covered["doc_id"].alias("_id"), covered["row"].alias("_row"), "n_hit", F.size("ids").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("sha"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any window of an item, whether or not the item has an id."""
    columns = docs.columns
    row, other, key = (unused(columns, n) for n in ("_row", "_other", "_key"))
    found = hits(docs, items, window).select(F.col("doc_id").alias(other), F.col("row").alias(key)).distinct()
    marked = docs.withColumn(row, F.xxhash64(F.col("text")))
    return marked.join(materialise(found), F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(row) == F.col(key)), "left_anti").select(columns)
