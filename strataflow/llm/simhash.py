"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most three bits have, cut into two segments, one segment that
differs in at most one bit. Each fingerprint is indexed under its segments as they are, and under their 32
variants with one bit left out; fingerprints that meet under a key are verified on all bits.
Equal fingerprints are one node, so exact copies cost nothing.

Keys under which very many fingerprints meet are first linked to a few centres each, which takes a row per
member and centre. Where a key still holds more than one component, its members meet by a second cut: the other
segment's four bytes, of which two linked fingerprints share at least one. No link is lost: pairs inside a
component change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.session import materialise

from .common import unused
from .graph import components

BITS = 3
WORDS = 3
SEED = 42
#: Rounds of centres before pairs are formed.
CENTRES = 3

_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit integer; 0 without words."""
    import xxhash

    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z alone, ASCII blanks
    if not own:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(own) < words:
        shingles = [b" ".join(own)]
    else:
        shingles = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False))
    h = np.fromiter((hashed(s, SEED) for s in shingles), dtype="<u8", count=max(1, len(own) - words + 1))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, name: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """``docs`` with the fingerprint of each whole text."""

    @F.pandas_udf("long")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(name, marked(F.col("text").cast("string")))


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, place, fp): place -1 for a whole segment, else the bit that the key leaves out."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    segment = F.explode(F.array(F.struct(F.lit(0).alias("s"), low.alias("v")), F.struct(F.lit(1).alias("s"), high.alias("v"))))
    cut = prints.select("fp", segment.alias("g")).select("fp", F.col("g.s").alias("s"), F.col("g.v").alias("v"), F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("place"))
    left = F.expr("CASE WHEN place < 0 THEN v ELSE v & ~shiftleft(1L, place) END")
    # segment and place in the upper half, the segment's bits in the lower
    key = F.expr("shiftleft(CAST(s * 33 + place + 1 AS BIGINT), 32)").bitwiseOR(left)
    return cut.select(key.alias("key"), "fp")


def _merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles and sorts, whatever size it is taken for.

    An explode's rows are not in Spark's estimate of its size: 66 keys a print, or four bytes a key, look like one row.
    A table that looks small would be sent to the driver whole.
    """
    return df.hint("merge")


def _near(a: str, b: str, bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def linked(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(node, component) of all distinct fingerprints (column fp) that have a link.

    Two segments serve ``bits`` up to 3. The component is the smallest signed fingerprint.
    """
    if bits > 3:
        raise ValueError("two segments with one bit left out find at most three differing bits")
    # a small table still makes 66 rows a print: spread it over all tasks
    keyed = _keyed(prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("c0"), F.max("fp").alias("c1"), F.min_by("fp", F.xxhash64("fp")).alias("c2")).where(F.col("n") > 1)
    met = materialise(keyed.join(_merged(counts.select("key", *[f"c{i}" for i in range(CENTRES)])), "key"))
    stars = [met.where((F.col("fp") != F.col(f"c{i}")) & _near("fp", f"c{i}", bits)).select(F.col("fp").alias("a"), F.col(f"c{i}").alias("b")) for i in range(CENTRES)]
    links = materialise(stars[0].union(stars[1]).union(stars[2]).distinct())
    known = materialise(components(links))
    named = met.select("key", "fp").join(_merged(known.withColumnRenamed("node", "fp")), "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("c"))
    named = materialise(named)
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    other = F.when(F.shiftright("key", 32) < 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    byte = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.shiftleft(i, 8).bitwiseOR(F.call_function("shiftright", F.col("other"), i * 8).bitwiseAND(F.lit(255)).cast("int"))))
    open_keys = named.join(_merged(mixed), "key").withColumn("other", other).select("key", byte.alias("byte"), "fp", "c")
    left, right = open_keys.toDF("key", "byte", "a", "ca"), open_keys.toDF("key", "byte", "b", "cb")
    more = left.join(_merged(right), ["key", "byte"]).where((F.col("ca") < F.col("cb")) & _near("a", "b", bits)).select("ca", "cb").distinct().toDF("a", "b")
    more = materialise(more)
    if more.limit(1).count() == 0:
        return known
    # components of components: the first ones are the nodes
    upper = components(more).toDF("component", "top")
    joined = known.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = upper.join(known.select(F.col("node").alias("component")), "component", "left_anti").toDF("node", "component")
    return joined.union(fresh)


def near_duplicates(docs: DataFrame, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """Per document: doc_id, fingerprint (hex), component_id (smallest doc_id of its component).

    Null and blank texts have fingerprint zero and are linked like any other. A null doc_id keeps its row and gets
    the smallest doc_id of its component, null if there is none. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs.select("doc_id", "text"), "fp", words).select("doc_id", "fp"))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = materialise(groups)
    found = materialise(linked(groups.select("fp"), bits).toDF("fp", "c"))
    named = groups.join(found, "fp", "left").select("fp", "least", F.coalesce("c", "fp").alias("c"))
    tops = named.groupBy("c").agg(F.min("least").alias("component_id"))
    by_print = named.join(tops, "c").select("fp", "component_id")
    out = prints.join(by_print, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """Of each component the row with the smallest doc_id stays; of repeated rows of that id, one.

    Nulls: see near_duplicates; of a component without any doc_id one row stays.
    """
    columns = docs.columns
    fp, told = unused(columns, "_fp"), unused(columns, "_told")
    marked = docs.withColumn(told, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    # texts are read once for their fingerprints, and once more for those that stay
    prints = materialise(fingerprints(marked, fp, words).select(F.col(fp).alias("fp"), "doc_id", F.col(told).alias("told")))
    groups = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = materialise(linked(groups.select("fp"), bits).toDF("fp", "c"))
    named = groups.join(found, "fp", "left").select("fp", "least", F.coalesce("c", "fp").alias("c"))
    # of equal smallest ids in several fingerprints, the smallest fingerprint
    chosen = named.groupBy("c").agg(F.min(F.struct(F.col("least").isNull().alias("no"), F.col("least"), F.col("fp"))).alias("k")).select(F.col("k.fp").alias("fp"), F.col("k.least").alias("least"))
    # of several rows of that id and fingerprint, the first by a hash of all their columns
    best = prints.join(chosen, "fp").where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("fp").agg(F.min("told").alias(told))
    return marked.join(materialise(best.select(told)), told, "left_semi").dropDuplicates([told]).select(columns)
