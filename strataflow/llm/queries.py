"""The registered queries of the text operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, covertree, language, leaks, lines, packing, pages, quality, search, simhash, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(count: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % count


@_query
def op1_quality_rules(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"))


@_query
def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    known = language.learn(docs.where(~held_out).select("text", "lang"))
    out = language.classified(docs.select("doc_id", held_out.alias("held_out"), "text"), known)
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.rejected")


@_query
def op3_line_dedup(spark, sf_dir):
    return lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op5_url_filter(spark, sf_dir):
    return urls.judged_pages(table(spark, sf_dir, "pages"))


@_query
def op6_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@_query
def op7_decontamination(spark, sf_dir):
    return leaks.checked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    sample = toxicity.labelled_sample(docs, labels, held_out)
    net = toxicity.train([r["text"] for r in sample], [r["toxic"] for r in sample])
    out = toxicity.scored(docs.select("doc_id", held_out.alias("held_out"), "text"), net)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@_query
def op9_token_files(spark, sf_dir):
    return tokens.stored_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@_query
def op10_html_text(spark, sf_dir):
    return pages.extracted(table(spark, sf_dir, "pages"))


@_query
def op11_lexical_search(spark, sf_dir):
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op12_embedding_near_duplicates(spark, sf_dir):
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query
def op13_centroid_clustering(spark, sf_dir):
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, w[p:p + 9] AS words
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(words) AS n FROM iw),
dw AS (SELECT doc_id, p, n, w[p:p + n - 1] AS words
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (words)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["op11_lexical_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, t, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, sizes),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM q JOIN tf USING (t) JOIN w USING (t), sizes GROUP BY item_id, doc_id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""

ORACLES["op12_embedding_near_duplicates"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                       WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id, vec_id AS y FROM embeddings UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON reach.y = links.x),
tops AS (SELECT vec_id, min(y) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT tops.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, tops.vec_id = component_id AS kept FROM tops LEFT JOIN counts ON x = vec_id"""


def _kmeans_sql(rounds: int) -> str:
    """Every round as a table of distances to the centroids, and a table of their means."""
    square = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = "SELECT vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT vec_id, v.v, c.k, {} AS d FROM v, c{} c) GROUP BY vec_id"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h LIMIT 8))",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(square, i)})")
        parts.append(f"s{i} AS (SELECT k, place, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(range(64)) AS place, unnest(v) AS x FROM a{i}) GROUP BY k, place)")
        parts.append(f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM s{i} GROUP BY k)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (k))")
    parts.append(f"last AS MATERIALIZED ({nearest.format(square, rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c{rounds}.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM last JOIN c{rounds} USING (k)"""


ORACLES["op13_centroid_clustering"] = _kmeans_sql(10)
