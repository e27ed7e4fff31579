"""Token ids of whole texts, and a compact store for them.

Texts are cut at places where the tokenizer's own splitting always cuts, and the ids of every
unit are remembered, so that frequent words are encoded once per Python worker. The joined ids
are those of the whole text; tests compare the two on awkward texts.

The store holds blocks of whole documents. In a block, ids are replaced by their frequency rank, and
each rank takes one to four bytes in a data stream, with its byte count in two bits of a
separate control stream. Blocks are binary columns of Parquet files, so tasks can be retried and any file
system that Spark writes to will do.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.session import checkpoint_root

END_ID = 2
#: Units remembered by one worker; then they become the past, from which those still in use are taken over.
UNITS = 600_000
#: A block closes once it holds so many ids.
BLOCK_IDS = 1 << 20

_BLANK = r" \t\n\r\x0b\f"
#: The unit before a word is one space, as in byte-level vocabularies; other blanks stand alone.
_SPACED = re.compile(rf" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]")
_RUNS = ("  ", "\n\n", "\n ", " \n", "\t", "\r", "\x0b", "\x0c")
#: White space beyond ASCII, and separators on which libraries differ: such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_MARKS = (".", ",", b".", b",")


def _four_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Units(dict):
    """The ids of a unit of text as little-endian unsigned 32-bit integers; holds those asked for before."""

    def __init__(self, tokenizer, before: str, lower: bool, plain: Units | None) -> None:
        super().__init__()
        self.tokenizer, self.model, self.before, self.lower = tokenizer, tokenizer.model, before, lower
        self.plain = self if plain is None else plain
        self.past: dict[str | bytes, bytes] = {}
        self.prefix = before.encode().decode("latin-1").translate(_LETTERS)

    def whole(self, text: str) -> bytes:
        return _four_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, letters: str) -> bytes:
        """Letters alone are one piece, which goes to the vocabulary's merges directly; ``letters`` as the vocabulary writes them."""
        return _four_bytes([t.id for t in self.model.tokenize(self.prefix + letters)])

    def __missing__(self, key: str | bytes) -> bytes:
        found = self.past.get(key)
        if found is None:
            found = self.encoded(key)
        if len(key) <= 64:
            if len(self) >= UNITS:
                self.past = dict(self)
                self.clear()
            self[key] = found
        return found

    def encoded(self, key: str | bytes) -> bytes:
        last = key[-1:]
        stem = key[:-1] if last in _MARKS else key
        # most words are ASCII letters, which the vocabulary writes as themselves
        if stem.isascii() and stem.isalpha():
            if stem is not key:  # letters and a mark after them are never merged
                return self[stem] + self.plain[last]
            cased = key.lower() if self.lower else key
            return self.piece(cased.decode() if isinstance(cased, bytes) else cased)
        word = stem.decode() if isinstance(stem, bytes) else stem
        cased = word.lower() if self.lower else word
        if cased.isalpha() and max(cased) < "\u0250":
            return self[stem] + self.plain[last] if stem is not key else self.piece(cased.encode().decode("latin-1").translate(_LETTERS))
        return self.whole(self.before + (key.decode() if isinstance(key, bytes) else key))


class Encoder:
    """Ids of whole texts with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_blanks = self.tokenizer.normalizer is not None
        self.first = Units(self.tokenizer, "", self.drops_blanks, None)
        self.later = Units(self.tokenizer, " ", False, self.first)
        self.whole = self.first.whole
        self.newline = b"" if self.drops_blanks else self.whole("\n")

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self.whole(text)
        if self.drops_blanks:
            return b"".join(map(self.first.__getitem__, text.encode().split()))
        if not text.isascii() and _ODD.search(text):
            return self.whole(text)
        if any(b in text for b in _RUNS) or text[-1] in " \n":
            later, first = self.later, self.first
            return b"".join([later[u[1:]] if u[0] == " " and len(u) > 1 else first[u] for u in _SPACED.findall(text)])
        first, later = self.first.__getitem__, self.later.__getitem__
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(first(head) + b"".join(map(later, rest)))
        return self.newline.join(lines)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- the byte-aligned code ------------------------------------------------------

#: For each control byte, the byte counts of its four values, less one.
_COUNTS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)
#: For each byte count less one, which of a value's four bytes are held: four flags, read as one number.
_HELD = (np.arange(4) <= np.arange(4)[:, None]).view("u4").reshape(-1)


def rank_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by falling frequency (then by id), and the rank of each given id."""
    if not len(ids):
        return ids.astype("<u4"), ids.astype(np.uint32)
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        held = np.flatnonzero(counts)
        order = held[np.argsort(-counts[held], kind="stable")]
        places = np.zeros(len(counts), dtype=np.uint32)
        places[order] = np.arange(len(order), dtype=np.uint32)
        return order.astype("<u4"), places[ids]
    held, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    places = np.empty(len(held), dtype=np.uint32)
    places[order] = np.arange(len(held), dtype=np.uint32)
    return held[order].astype("<u4"), places[where]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits a value) and data bytes (one to four a value, lowest first)."""
    more = (values > 0xFF).view(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = more
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    octets = values.astype("<u4", copy=False).view(np.uint8)
    return control.tobytes(), octets[_HELD[more].view(bool)].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values again: byte counts by table lookup, then one masked gather."""
    counts = _COUNTS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    octets = np.zeros(4 * n, dtype=np.uint8)
    octets[_HELD[counts].view(bool)] = np.frombuffer(data, dtype=np.uint8)
    return octets.view("<u4")


_BLOCK = "shard int, block int, n_ids long, doc_ids binary, lengths binary, ranked binary, control binary, data binary"


def _blocks(path: str, end_id: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, block, held = TaskContext.get().partitionId(), 0, 0
        encode, end = encoder(path).encode, np.array([end_id], dtype="<u4").tobytes()
        doc_ids: list[object] = []
        parts: list[bytes] = []

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            ranked, ranks = rank_ids(ids)
            control, data = pack(ranks)
            lengths = np.array([len(p) // 4 for p in parts], dtype="<u8").tobytes()
            named = np.array([(0, 1) if d is None else (d, 0) for d in doc_ids], dtype=[("id", "<i8"), ("null", "u1")]).tobytes()
            return pd.DataFrame([(shard, block, len(ids), named, lengths, ranked.tobytes(), control, data)], columns=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for doc_id, null, text in zip(batch["doc_id"], batch["no_id"], batch["text"], strict=True):
                doc_ids.append(None if null else int(doc_id))
                parts.append((encode(text) if text else b"") + end)
                held += len(parts[-1]) // 4
                if held >= BLOCK_IDS:
                    yield close()
                    doc_ids, parts, held, block = [], [], 0, block + 1
        if parts:
            yield close()

    return write


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """Write the ids of every document's whole text, and ``end_id``, in ascending doc_id order.

    Null texts are empty; null doc_ids come first; rows of one doc_id are ordered by text.
    Files of the folder are shards in order, and blocks of a shard are in order.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    flat = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    flat.mapInPandas(_blocks(path, end_id), _BLOCK).write.parquet(folder)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for b in batch.itertuples(index=False):
            ids = np.frombuffer(b.ranked, dtype="<u4")[unpack(b.control, b.data, b.n_ids)]
            raw, lengths = memoryview(ids.tobytes()), np.frombuffer(b.lengths, dtype="<u8").astype(np.int64)
            named = np.frombuffer(b.doc_ids, dtype=[("id", "<i8"), ("null", "u1")])
            ends = np.cumsum(lengths)
            starts = ends - lengths
            yield pd.DataFrame({
                "doc_id": named["id"], "no_id": named["null"] == 1, "start": b.before + starts, "n_tokens": lengths,
                "ids_crc32": [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)],
            })


def read_ids(spark, folder: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver sees one total per shard; the places inside a shard come from a window over its blocks.
    """
    blocks = spark.read.schema(_BLOCK).parquet(folder)
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = blocks.select("shard", "block", "n_ids").withColumn("upto", F.sum("n_ids").over(inside))
    total, starts = 0, []
    for shard, n in sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        starts.append((shard, total))
        total += n
    firsts = spark.createDataFrame(starts, "shard int, first long")
    # one row per block: small next to the blocks themselves
    where = places.join(firsts, "shard").select(F.col("shard"), F.col("block"), (F.col("first") + F.col("upto") - F.col("n_ids")).alias("before"))
    out = blocks.join(where, ["shard", "block"]).select("n_ids", "doc_ids", "lengths", "ranked", "control", "data", "before")
    found = out.mapInPandas(_documents, "doc_id long, no_id boolean, start long, n_tokens long, ids_crc32 long")
    return found.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def stored_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the store below the shared checkpoint folder and read it back; an empty table gives an empty result."""
    import uuid

    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, folder, end_id)
    return read_ids(spark, folder)


