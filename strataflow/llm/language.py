"""Language by compression: the language whose dictionary makes the text smallest.

For every language a bounded sample of labelled documents becomes a raw-content dictionary of zstandard. A text is cut
into blocks, so that the dictionary and not the text's own beginning explains it, and every block is encoded
with every dictionary. Close calls are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

UNKNOWN = "und"
#: Bytes of one language's dictionary, and about how many documents are drawn to fill it.
DICTIONARY_BYTES, SAMPLE_DOCS = 96 * 1024, 160
#: Letters (in bytes) drawn for each language, as a multiple of a dictionary: draws by hash vary, and stutter is taken out.
FILL = 3
#: Dictionaries that a worker holds at a time.
HELD = 64
#: From this size on a smaller dictionary is compared with the best one cut to the same size.
EVENED_BYTES = 4096
BLOCK_BYTES = 256
#: Compression level; higher ones start from statistics of their own and tell languages apart less well.
LEVEL = 6
#: Least relative gap between the best and the second size.
MARGIN = 0.004

_OTHERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-cased words of letters, one space between, a word at once after itself only once.

    Case, digits, marks and stutter tell nothing about the language.
    """
    words = _OTHERS.sub(" ", text.lower()).split(" ")
    return " ".join([w for w, before in zip(words, ["", *words], strict=False) if w and w != before])


@dataclass
class Dictionaries:
    languages: list[str]
    contents: list[bytes]
    level: int = LEVEL

    def encoder(self, content: bytes):
        import zstandard as zstd

        # matches from three bytes on: short texts must find their endings in the dictionary
        chosen = zstd.ZstdCompressionParameters.from_level(
            self.level, source_size=BLOCK_BYTES, dict_size=DICTIONARY_BYTES, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=chosen)  # digested once, not for every block
        return zstd.ZstdCompressor(dict_data=held, compression_params=chosen)


def learn(labelled: DataFrame, level: int = LEVEL) -> Dictionaries:
    """Dictionaries of every language from rows with a text and a lang, drawn by the hash of their beginnings.

    Only totals per language and the drawn texts reach the driver. Equal beginnings count and are drawn once.
    """
    share = DICTIONARY_BYTES // SAMPLE_DOCS * 4  # no single long text fills a dictionary
    start = F.substring("text", 1, share)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string"), start.alias("text"))
    letters = F.octet_length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long")
    texts = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.first(letters).alias("size"))
    totals = texts.groupBy("lang").agg(F.sum("n").alias("n"), F.count_if(F.col("size") > 0).alias("texts"), F.sum("size").alias("size")).collect()
    totals = sorted((r for r in totals if r["texts"]), key=lambda r: (-r["n"], r["lang"]))
    if not totals:
        return Dictionaries([], [], level)
    place = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30))
    rates = [(r["lang"], int((1 << 30) * min(1.0, max(SAMPLE_DOCS / r["texts"], FILL * DICTIONARY_BYTES / r["size"])))) for r in totals]
    bounds = labelled.sparkSession.createDataFrame(rates, "lang string, bound long")
    drawn = rows.join(F.broadcast(bounds), "lang").where(place < F.col("bound"))
    sample = drawn.select("lang", F.xxhash64("text").alias("h"), "text").distinct().collect()
    own: dict[str, list[tuple[int, str]]] = {}
    for r in sample:
        own.setdefault(r["lang"], []).append((r["h"], r["text"]))
    languages, contents = [], []
    for lang in (r["lang"] for r in totals):  # the commonest first: it wins ties
        content = " ".join(filter(None, (plain(t) for _, t in sorted(own.get(lang, []))))).encode("utf-8", "replace")[:DICTIONARY_BYTES]
        if content:
            languages.append(lang)
            contents.append(content)
    return Dictionaries(languages, contents, level)


class Judge:
    """Judges texts by dictionaries of any sizes, holding HELD of them at a time."""

    def __init__(self, known: Dictionaries, margin: float = MARGIN) -> None:
        self.known, self.margin, self.held = known, margin, {}

    def encoder(self, k: int, size: int):
        """The encoder of a language's dictionary, cut to ``size``."""
        found = self.held.pop((k, size), None) or self.known.encoder(self.known.contents[k][:size])
        self.held[k, size] = found
        if len(self.held) > HELD:
            del self.held[next(iter(self.held))]
        return found

    def rows(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text: the score is the relative gap to the second, from 0 to 1.

        The best language knows more if its dictionary is larger, so one with a smaller dictionary is compared with the
        best one's beginning of the same size, and its size is put in proportion.
        """
        names, lengths = self.known.languages, [len(c) for c in self.known.contents]
        raw = [plain(t).encode("utf-8", "replace") if t and names else b"" for t in texts]
        blocks = [[r[i : i + BLOCK_BYTES] for i in range(0, len(r), BLOCK_BYTES)] for r in raw]
        sizes = np.zeros((len(texts), len(names)))
        for k in range(len(names)):
            compress = self.encoder(k, lengths[k]).compress
            sizes[:, k] = [sum([len(compress(b)) for b in own]) for own in blocks]
        best = sizes.argmin(axis=1) if names else np.zeros(len(texts), int)
        even = sizes.copy()
        for c in sorted(set(best.tolist())) if names else ():
            at = [i for i in np.flatnonzero(best == c).tolist() if raw[i]]
            for size in sorted({n for n in lengths if EVENED_BYTES <= n < lengths[c]}) if at else ():
                compress = self.encoder(c, size).compress
                cut = np.array([sum([len(compress(b)) for b in blocks[i]]) for i in at])
                for k in (k for k, n in enumerate(lengths) if n == size):
                    even[at, k] = sizes[at, k] * sizes[at, c] / cut
        out = []
        for r, own in zip(raw, even, strict=True):
            if not r:
                out.append((UNKNOWN, 0.0, True))
                continue
            order = np.argsort(own, kind="stable")
            gap = float((own[order[1]] - own[order[0]]) / own[order[1]]) if len(order) > 1 else 1.0
            out.append((names[order[0]], gap, gap < self.margin))
        return out


def classified(docs: DataFrame, known: Dictionaries, name: str = "language", margin: float = MARGIN) -> DataFrame:
    """``docs`` with a struct of lang_pred, score and rejected from the whole text alone.

    Null texts, texts without a letter, and all texts where nothing could be learned are ``und`` and rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)  # DICTIONARY_BYTES a language at most

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(shared.value, margin)
        step = 256 if len(shared.value.languages) <= HELD // 2 else 4096  # more texts for each time a dictionary is digested
        for texts in batches:
            own = [t if isinstance(t, str) else None for t in texts]
            rows = [r for i in range(0, len(own), step) for r in judge.rows(own[i : i + step])]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return docs.withColumn(name, decide(F.col("text").cast("string")))


def keep_identified(docs: DataFrame, known: Dictionaries, margin: float = MARGIN) -> DataFrame:
    """The rows whose language is told clearly."""
    name = unused(docs.columns, "_language")
    return classified(docs, known, name, margin).where(~F.col(name)["rejected"]).drop(name)
