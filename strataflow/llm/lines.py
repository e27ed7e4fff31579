"""Near-duplicate lines by an exact set-similarity join, in built-in functions alone.

A line is the set of its lower-cased words. Words are ordered by rarity over all documents, then lines whose sets reach a
Jaccard similarity of SIMILARITY share a word among their rarest few (the prefix). Pairs that meet under such a word
pass length and positional filters and a bitmap filter (the sets' parity bitmaps differ in no more bits than the sets in
words; long sets have wider bitmaps, as 64 bits tell few of them apart), and are then verified on the whole sets. A line goes if any earlier line (by doc_id, then line number) is as similar.

Equal sets are one entry, so copies cost a row each. Where many similar lines meet under a word, each is first
compared with the earliest one there; only lines that this leaves in doubt meet all others. Nothing is cut off.

Rarity is counted over all words in a table of RARITY_BUCKETS hashed words, to a quarter or so of each count: wide enough that
a bucket rarely holds a common word beside others, and a common word always counts as common. The order needs only
be one and the same for all lines, so words that share a bucket cost time, never results. Words are told apart by
56 bits of a hash, and sets by 64 bits of a hash of their words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.session import materialise

from .common import unused

SIMILARITY = 0.8
RARITY_BUCKETS = 1 << 18
#: Places of lines, of 40 bytes each, that are sent to every task.
BROADCAST = 250_000
#: Bits, at most, that tell lines which are asked for from others.
MOST_BITS = 1 << 27
#: Steps of the logarithm of a count: each is a factor of 2 ** (1 / STEPS).
STEPS = 3
#: Longs of the bitmap that pairs are compared by before their sets are; a power of 2.
WIDTH = 8
#: Sets of more words than this meet with bitmaps of MARKS longs, others of one long.
SHORT = 48
MARKS = 4
#: Parts of the prefixes' words that meet one after the other: only one part's shuffle files are on disk at a time.
PASSES = 4


def _words(line: Column) -> Column:
    """Words of a lower-cased text. Blanks become spaces first: splitting at one character needs no pattern."""
    spaced = F.lower(line)
    for blank in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def rarity(docs: DataFrame) -> Column:
    """The logarithm of the frequency of each bucket of words, a byte each, as a literal."""
    hashed = docs.select(F.explode(F.transform(_words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w))).alias("h"))
    counts = hashed.groupBy(F.col("h").bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most RARITY_BUCKETS rows
    table = np.zeros(RARITY_BUCKETS, dtype=np.uint8)
    table[counts["b"].to_numpy()] = np.minimum(127, np.rint(STEPS * np.log2(counts["n"].to_numpy() + 1.0)))
    return F.lit(table.tobytes())


def _commonness(h: Column, rare: Column) -> Column:
    at = h.bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int") + 1
    return F.ascii(F.substring(rare, at, F.lit(1)).cast("string"))


def _split(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, t): every line with any word."""
    split = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return split.where(F.col("t").rlike(r"[^\x20\x09-\x0D]"))


def _ids(line: Column, rare: Column) -> Column:
    """The set of a line's words, rarest first. Elements are known not to be null, so they sort as plain numbers."""
    coded = F.transform(
        F.transform(_words(line), lambda w: F.xxhash64(w)),
        lambda h: F.coalesce(
            F.shiftleft(_commonness(h, rare).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1))),
            F.lit(0).cast("long"),
        ),
    )
    return F.sort_array(F.array_distinct(coded))


def _lines(docs: DataFrame, rare: Column) -> DataFrame:
    """(doc_id, row, line, ids): the words of every line with any, rarest first; commonness above, hash below."""
    return _split(docs).select("doc_id", "row", "line", _ids(F.col("t"), rare).alias("ids"))


def _overlap(a: Column, b: Column, similarity: float) -> Column:
    """The least number of common words of sets of sizes a and b."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (a + b) - F.lit(1e-9))


def _likely(rows: DataFrame, asked: DataFrame, n: int, key: str) -> DataFrame:
    """The rows whose key, a hash, may be among the ``n`` asked ones: a bit stands for every asked key, 8 bits a key up to MOST_BITS.

    Rows of asked keys all stay, so a join that follows finds the same; the bits are sent to every task in bitmaps of 4 KB.
    """
    size = min(MOST_BITS, 1 << max(15, (8 * n - 1).bit_length()))
    place = F.pmod(F.col(key), F.lit(size))
    held, bits, bucket = (unused([*rows.columns, *asked.columns], c) for c in ("_held", "_bits", "_bucket"))
    maps = asked.select(place.alias(held)).groupBy(F.bitmap_bucket_number(held).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(held)).alias(bits))
    met = rows.withColumn(held, place).join(F.broadcast(maps), F.bitmap_bucket_number(held) == F.col(bucket))
    at = F.bitmap_bit_position(held).cast("int")
    octet = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.call_function("shiftright", octet, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def _sets_of(pairs: DataFrame, sets: DataFrame, docs: DataFrame, rare: Column) -> DataFrame:
    """(at, ids, n, s0 ...): the whole sets of the lines in pairs (a, b), read from the documents again, and their bitmaps."""
    asked = pairs.select(F.col("a").alias("at")).union(pairs.select("b")).distinct().join(sets.select("at", "first"), "at")
    asked = materialise(asked.select("at", "first", F.xxhash64("first.doc_id", "first.row", "first.line").alias("_at")))
    own = _split(docs).withColumn("_at", F.xxhash64("doc_id", "row", "line"))
    # few asked lines go to the documents; many meet them in a shuffle of (place, line), which few others enter
    n = asked.count()
    wanted = F.broadcast(asked) if n <= BROADCAST else asked
    own = own if n <= BROADCAST else _likely(own, asked, n, "_at")
    exact = (F.col("row") == F.col("first.row")) & (F.col("line") == F.col("first.line")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    found = own.join(wanted, "_at").where(exact).select("at", "t").dropDuplicates(["at"])
    found = found.select("at", _ids(F.col("t"), rare).alias("ids"))
    return materialise(found.select("at", "ids", F.size("ids").alias("n"), *[_parity("ids", k, WIDTH).alias(f"s{k}") for k in range(WIDTH)]))


def _parity(ids: str, part: int = 0, parts: int = 1) -> Column:
    """64 bits: which of 64 * parts hash values, of those in this part, an odd number of words have."""
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    held = F.filter(ids, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(parts - 1)) == part) if parts > 1 else F.col(ids)
    return F.aggregate(held, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(one(h)))


def _marks(ids: str, n: Column) -> list[Column]:
    """A bitmap of MARKS longs for long sets; the one long of a short set is what the longs of a long one add up to, by XOR."""
    parts = [_parity(ids, k, MARKS) for k in range(MARKS)]
    none = F.lit(0).cast("long")
    return [F.when(n > SHORT, part).otherwise(none if k else _parity(ids)) for k, part in enumerate(parts)]


def _unlike(a: list[Column], b: list[Column], wide: Column) -> Column:
    """In how many bits two bitmaps differ; two wide ones are compared whole, others as one long."""
    differ = [x.bitwiseXOR(y) for x, y in zip(a, b)]
    folded = differ[0]
    for d in differ[1:]:
        folded = folded.bitwiseXOR(d)
    return F.when(wide, sum((F.bit_count(d) for d in differ), F.lit(0))).otherwise(F.bit_count(folded))


def _later(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(at): of pairs (a, b), b the earlier, whose whole sets are similar, the later one.

    Wider bitmaps rule out most pairs before the sets themselves are sent to theirs.
    """
    marks = ["at", "n", *[f"s{k}" for k in range(WIDTH)]]
    seen = lambda p, columns: found.select(*[F.col(c).alias(p if c == "at" else p + c) for c in columns])
    need = _overlap(F.col("an"), F.col("bn"), similarity)
    unlike = sum((F.bit_count(F.col(f"as{k}").bitwiseXOR(F.col(f"bs{k}"))) for k in range(WIDTH)), F.lit(0))
    left = pairs.join(seen("a", marks), "a").join(seen("b", marks), "b").where(unlike <= F.col("an") + F.col("bn") - 2 * need).select("a", "b")
    met = left.join(seen("a", ["at", "ids"]), "a").join(seen("b", ["at", "ids"]), "b")
    alike = met.where(F.size(F.array_intersect("aids", "bids")) >= _overlap(F.size("aids"), F.size("bids"), similarity))
    return alike.select(F.col("a").alias("at")).distinct()


def later_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, line): the lines that an earlier line is as similar to; row tells texts of one doc_id apart.

    Lines without words are never listed. Rows that repeat a doc_id and its text are one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rare = rarity(docs)
    n = F.size("ids")
    least = F.ceil(F.lit(similarity) * n - F.lit(1e-9)).cast("int")
    # sets under this size are similar to none but themselves
    smallest = next(k for k in range(1, 10_000) if k / (k + 1) >= similarity - 1e-9)
    long = n >= smallest
    # rows that repeat a document list its lines again: an entry equal to the first one is never later than it
    lines = materialise(_lines(docs, rare).select(
        "doc_id", "row", "line", F.xxhash64("ids").alias("x"), n.alias("n"),
        *[F.when(long, c).alias(f"b{k}") for k, c in enumerate(_marks("ids", n))],
        # the join's key is a shorter hash of the word: what it confuses, the later filters tell apart
        F.when(long, F.transform(F.slice("ids", F.lit(1), n - least + 1), lambda h: F.hash(h))).alias("prefix"),
    ))
    bits = [f"b{k}" for k in range(MARKS)]
    sets = lines.groupBy("x").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", *bits, "prefix")])
    # the place of a set, in the order of the first lines: one small number, by which sets are named and ordered
    sets = materialise(sets.orderBy("first").withColumn("at", F.monotonically_increasing_id()))
    columns = ["at", *bits, "na"]

    def words(of: DataFrame, turn: int, p: str = "") -> DataFrame:
        """(word, at, b0 ..., na): the prefixes' words of one pass; n and place fit one number, which the shuffle carries in fewer bytes."""
        each = of.where(F.col("prefix").isNotNull()).select("at", *bits, "n", F.posexplode("prefix").alias("i", "word")).where(F.pmod("word", F.lit(PASSES)) == turn)
        na = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long"))
        return each.select("word", *[F.col(c).alias(p + c) for c in ("at", *bits)], na.alias(f"{p}na"))

    size, place = lambda c: F.shiftright(c, 32), lambda c: c.bitwiseAND(F.lit((1 << 32) - 1))

    def may(p: str, q: str) -> Column:
        na, nb, i, j = size(F.col(f"{p}na")), size(F.col(f"{q}na")), place(F.col(f"{p}na")), place(F.col(f"{q}na"))
        need = _overlap(na, nb, similarity)
        alike = _unlike([F.col(p + c) for c in bits], [F.col(q + c) for c in bits], (na > SHORT) & (nb > SHORT)) <= na + nb - 2 * need
        return (F.least(na, nb) >= F.lit(similarity) * F.greatest(na, nb) - F.lit(1e-9)) & (F.least(i, j) + F.least(na - i, nb - j) >= need) & alike

    def in_passes(met: Callable[[int], DataFrame]) -> DataFrame:
        """The pairs (a, b) of all passes, each once; b is the earlier line."""
        parts = [materialise(met(turn).distinct()) for turn in range(PASSES)]
        return reduce(DataFrame.union, parts).distinct()

    def with_first(turn: int) -> DataFrame:
        """Each word's lines meet its earliest one where the shuffle has brought them."""
        own = Window.partitionBy("word")
        met = words(sets, turn, "t").withColumn("c", F.min(F.struct(*[F.col(f"t{c}").alias(c) for c in columns])).over(own))
        met = met.select(*[f"t{c}" for c in columns], *[F.col(f"c.{c}").alias(f"c{c}") for c in columns])
        return met.where((F.col("tat") != F.col("cat")) & may("t", "c")).select(F.col("tat").alias("a"), F.col("cat").alias("b"))

    near = materialise(in_passes(with_first))
    done = materialise(_later(near, _sets_of(near, sets, docs, rare), similarity))
    doubt = sets.join(done, "at", "left_anti")

    def with_others(turn: int) -> DataFrame:
        met = words(doubt, turn, "p").join(words(sets, turn, "q"), "word")
        return met.where((F.col("qat") < F.col("pat")) & may("p", "q")).select(F.col("pat").alias("a"), F.col("qat").alias("b"))

    fresh = materialise(in_passes(with_others).join(near, ["a", "b"], "left_anti"))
    found = _sets_of(fresh, sets, docs, rare)
    # one pair of each line first: it mostly settles the line, and only the others need all of their pairs
    one = materialise(_later(fresh.groupBy("a").agg(F.min("b").alias("b")), found, similarity))
    rest = _later(fresh.join(one.withColumnRenamed("at", "a"), "a", "left_anti"), found, similarity)
    gone = materialise(done.union(one).union(rest).distinct().withColumn("gone", F.lit(True)))
    told = sets.join(gone, "at", "left").where((F.col("copies") > 1) | F.col("gone")).select("x", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    return lines.select("doc_id", "row", "line", "x").join(told, "x").where(F.col("gone") | (F.struct("doc_id", "row", "line") > F.col("first"))).select("doc_id", "row", "line").distinct()


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; every row stays, and a null text stays null.

    Lines without words stay. A text of which every line repeats becomes empty. Ties cannot occur: lines are
    ordered by doc_id (null first), the hash of the text, and their number. Adds ``n_removed``.
    """
    columns = docs.columns
    row, other, key, gone = (unused(columns, n) for n in ("_row", "_other", "_key", "_gone"))
    later = later_lines(docs, similarity).groupBy("doc_id", "row").agg(F.collect_list("line").alias(gone))
    later = materialise(later.select(F.col("doc_id").alias(other), F.col("row").alias(key), gone))
    if (later.agg(F.sum(F.size(gone) + 4)).first()[0] or 0) <= 4 * BROADCAST:  # of few lines the numbers, not the documents, move
        later = F.broadcast(later)
    joined = docs.withColumn(row, F.xxhash64(F.col("text").cast("string"))).join(later, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(row) == F.col(key)), "left")
    kept = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else F.col(c) for c in columns], F.coalesce(F.size(gone), F.lit(0)).alias(unused(columns, "n_removed")))
