"""Quality rules by counts and by distribution divergence, in built-in functions alone.

A document's histogram of character classes and its histogram of common words are compared with those of each
language by Jensen-Shannon distance. The references are the sums over all documents of a language that pass the
base rules. Languages without a list of common words get theirs from the corpus: the TOP_WORDS words in most documents.
A document is far off if it is far from every language; texts under the length guards, and those whose own language has no
reference, are not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.session import materialise

from .common import words_of

SYMBOLS = "#*$%&|<>"
#: Character classes, taken from the text one after another; what is left is the last class.
CLASSES = ["[a-z]+", "[\\x20\\x09-\\x0D]+", "[A-Z]+", "[.,;:!?'\"()\\-]+", "[0-9]+", "[#*$%&|<>]+", "[^\\x00-\\x7F]+"]
# Very common words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that it for on are be with as was at by this from or an".split(),
    "de": "der die das und ist nicht ein eine zu den mit von im dem auf für des sich auch".split(),
    "fr": "le les des et est une un dans que qui pour pas sur par avec elle du au ce".split(),
    "es": "el los las y que una es por con para su lo no se del al como más".split(),
}
VOCABULARY = sorted({w for own in COMMON_WORDS.values() for w in own})
#: Common words counted for each other language.
TOP_WORDS = 20
#: Guards: fewer characters or words than these are not compared.
MIN_CHARS, MIN_WORDS = 100, 60
#: Farthest Jensen-Shannon distance (base 2) from the nearest language, for characters and for common words.
MAX_CHARS, MAX_WORDS = 0.17, 0.28
WINDOW = 5


def _bare(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(".,;:!?")))


def _codes(n: int) -> list[str]:
    """One character for each common word in a document's string of common words; none is a surrogate."""
    return [chr(0x21 + i if 0x21 + i < 0xD800 else 0x821 + i) for i in range(n)]


def vocabulary(docs: DataFrame) -> list[str]:
    """The listed common words, and the TOP_WORDS words of most documents of every language that has no list."""
    if "lang" not in docs.columns:
        return VOCABULARY
    others = docs.where(F.col("lang").isNotNull() & ~F.col("lang").isin(list(COMMON_WORDS)))
    words = others.select("lang", F.explode(F.array_distinct(F.transform(words_of(F.col("text").cast("string")), _bare))).alias("word")).where(F.col("word") != "")
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("place", place).where(F.col("place") <= TOP_WORDS).select("word").distinct()
    return sorted({*VOCABULARY, *(r["word"] for r in top.collect())})


def measured(docs: DataFrame, known_words: list[str] = VOCABULARY) -> DataFrame:
    """Per row: doc_id, lang, the base counts, and the histograms (arrays) of classes and common words."""
    codes = _codes(len(known_words))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", lang.cast("string").alias("lang"), text.alias("t")).withColumn("w", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    runs = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    common = F.filter(F.transform("w", _bare), lambda w: w.isin(known_words))
    held = F.array(*[F.lit(w) for w in known_words])
    coded = F.array_join(F.transform(common, lambda w: F.substring(F.lit("".join(codes)), F.array_position(held, w), F.lit(1))), "")
    rows = rows.withColumns({"lines": lines, "runs": runs, "coded": coded, "m0": F.length("t")})
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    starts = F.sort_array(F.filter(
        F.transform("placed", lambda x, k: F.when((x["h"] == F.get("placed", k - 1)["h"]) | (x["h"] == F.get("placed", k + 1)["h"]), x["i"])),
        lambda x: x.isNotNull(),
    ))
    rows = rows.withColumn("starts", starts)
    gaps = F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW))))
    left = F.col("t")
    steps = {}
    for k, pattern in enumerate(CLASSES):
        name = f"s{k}"
        rows = rows.withColumn(name, F.regexp_replace(left, pattern, ""))
        left = F.col(name)
        steps[k] = (F.col("m0") if k == 0 else F.length(f"s{k - 1}")) - F.length(name)
    classes = F.array(*[x.cast("long") for x in steps.values()], F.length(left).cast("long"))
    seen = [(F.length("coded") - F.length(F.replace(F.col("coded"), F.lit(c), F.lit("")))).cast("long") for c in codes]
    return rows.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.col("m0") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("m0").cast("long").alias("n_chars"), classes.alias("classes"), F.array(*seen, (F.size("w") - F.length("coded")).cast("long")).alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def distance(counts: Column, reference: list[float], total: Column) -> Column:
    """Jensen-Shannon distance, base 2, between a histogram of counts with their total, and shares that sum to 1."""
    shares = F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    terms = F.zip_with(shares, F.split(F.lit(",".join(repr(float(x)) for x in reference)), ",").cast("array<double>"), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def references(measures: DataFrame, n_words: int = len(VOCABULARY)) -> dict[str, tuple[list[float], list[float]]]:
    """Shares per language over all documents that pass the base rules, for every language there is."""
    bins = {"classes": len(CLASSES) + 1, "common": n_words + 1}
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in bins.items() for i in range(n)]
    out = {}
    for r in measures.where(~base_failed() & F.col("lang").isNotNull()).groupBy("lang").agg(*sums).collect():
        shares = []
        for c, n in bins.items():
            own = [float(r[f"{c}{i}"] or 0) for i in range(n)]
            shares.append([x / max(1.0, sum(own)) for x in own])
        out[r["lang"]] = (shares[0], shares[1])
    return out


def judged(docs: DataFrame, max_chars: float = MAX_CHARS, max_words: float = MAX_WORDS, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    Null text has no words and fails the base rules. Distances are null under the guards and where the
    document's language is null or has no reference; such texts are kept if the base rules pass. Repeated rows keep their number; an empty table gives none.
    """
    words = vocabulary(docs)
    measures = materialise(measured(docs, words))
    known = references(measures, len(words))
    own = F.coalesce(F.col("lang").isin(list(known)), F.lit(False))
    far = lambda c, k, n: F.least(*d) if len(d := [distance(F.col(c), known[x][k], F.col(n)) for x in sorted(known)]) > 1 else (d[0] if d else F.lit(None).cast("double"))
    out = measures.withColumn("base_failed", base_failed()).withColumns({
        "char_distance": F.when(own & (F.col("n_chars") >= min_chars), far("classes", 0, "n_chars")), "word_distance": F.when(own & (F.col("n_words") >= min_words), far("common", 1, "n_words")),
    })
    close = (F.coalesce("char_distance", F.lit(0.0)) <= max_chars) & (F.coalesce("word_distance", F.lit(0.0)) <= max_words)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & close).alias("kept"))
