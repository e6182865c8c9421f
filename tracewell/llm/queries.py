"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import (
    divergence, jaccard, near_vectors, neighbours, packing, passages, pieces, pseudonyms, ranking, spellings, substrings, toxicity,
    warc,
)
from tracewell.llm.learning import remainder
from tracewell.session import configure

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    _REGISTRY[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark, sf_dir):
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_ORACLES["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
twice AS (SELECT doc_id, s FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM twice)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query
def op2_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op5_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


_ORACLES["op5_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(c.e, q.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


@query
def op6_jaccard_join(spark, sf_dir):
    return jaccard.join_components(table(spark, sf_dir, "documents"))


_ORACLES["op6_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""


@query
def op3_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    coded = pieces.decode(pieces.encode(docs, "source", "ids"), "ids", "decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("source")).alias("round_trip"),
    )


@query
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id") != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    held_out = (remainder("doc_id") == 0).alias("held_out")
    return scored.select("doc_id", held_out, "expected_severity", "severity", "toxic")


@query
def op7_distribution_rules(spark, sf_dir):
    judged = divergence.judge(table(spark, sf_dir, "documents"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *measures, "base_failed", "kept")


@query
def op8_warc_derivatives(spark, sf_dir):
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")), "page_id")
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest",
        "source_digest", "block",
    )


def _warc_oracle() -> str:
    def text(value: str) -> str:
        for pattern in warc.HIDDEN:
            value = f"regexp_replace({value}, '{pattern}', ' ', 'g')"
        value = f"regexp_replace({value}, '{warc.LINE_TAG}', chr(10), 'g')"
        return f"regexp_replace({value}, '{warc.TAG}', '', 'g')"

    def decoded(value: str) -> str:
        body = "x[2:-2]"
        code = f"CASE WHEN {body} ILIKE '#x%' THEN CAST('0x' || {body}[3:] AS INTEGER) WHEN {body} LIKE '#%' THEN CAST({body}[2:] AS INTEGER) END"
        fine = f"({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111"
        sign = f"CASE WHEN {fine} THEN chr({code}) WHEN {body} NOT LIKE '#%' THEN coalesce(names[{body}], x) ELSE x END"
        found = f"list_transform(regexp_extract_all({value}, '{warc.REFERENCE}'), lambda x: {sign}) || ['']"
        parts = f"list_zip(string_split_regex({value}, '{warc.REFERENCE}'), {found})"
        value = f"array_to_string(list_transform({parts}, lambda p: p[1] || p[2]), '')"
        value = f"regexp_replace({value}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
        value = f"regexp_replace({value}, ' ?\\n[ \\n]*', chr(10), 'g')"
        return f"regexp_replace({value}, '^[ \\n]+|[ \\n]+\\z', '', 'g')"

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def number(value: str) -> str:
        cut = ", ".join(f"substr(md5({value}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'<urn:uuid:' || concat_ws('-', {cut}) || '>'"

    source = number("'response|' || coalesce(url, '') || '|' || sha256(html)")
    end = "chr(13) || chr(10)"
    title = f"CASE WHEN regexp_extract(html, '{warc.TITLE}', 2) <> '' THEN regexp_extract(html, '{warc.TITLE}', 1) ELSE '' END"
    names = ", ".join(f"{quoted(name)}: {quoted(sign)}" for name, sign in warc.ENTITIES.items())
    return rf"""
WITH names AS (SELECT MAP {{{names}}} AS names),
p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
bare AS (
  SELECT *, {source} AS refers_to, 'sha256:' || sha256(html) AS source_digest, {text("html")} AS body, {text(title)} AS title,
         len(regexp_extract_all(html, '{warc.LINK}')) AS links
  FROM p),
s AS (
  SELECT page_id, url, refers_to, source_digest, links, {decoded("body")} AS body, {decoded("title")} AS title FROM bare, names),
c AS (SELECT *, {number("'conversion|' || refers_to")} AS conversion, {number("'metadata|' || refers_to")} AS metadata FROM s),
r AS (
  SELECT page_id, url, refers_to, source_digest, 'metadata' AS record_type, metadata AS record_id,
         'application/warc-fields' AS content_type,
         coalesce('source-uri: ' || url || {end}, '') || 'source-status: 200' || {end} ||
         'source-content-type: text/html; charset=utf-8' || {end} || 'source-payload-digest: ' || source_digest || {end} ||
         'title: ' || replace(title, chr(10), ' ') || {end} || 'links: ' || links || {end} || 'conversion: ' || conversion || {end} ||
         'source-header: Content-Type: text/html; charset=utf-8' || {end} AS block
  FROM c
  UNION ALL
  SELECT page_id, url, refers_to, source_digest, 'conversion', conversion, 'text/plain; charset=utf-8', body FROM c)
SELECT page_id, record_type, record_id, refers_to, url AS target_uri, content_type,
       CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, block
FROM r"""


_ORACLES["op8_warc_derivatives"] = _warc_oracle()


@query
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id") != 0)
    scored = passages.score(docs.select("doc_id", "text"), passages.fit(docs, labels))
    return scored.select(
        "doc_id",
        (remainder("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= passages.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op10_pseudonyms(spark, sf_dir):
    return pseudonyms.protect(table(spark, sf_dir, "documents")).select("doc_id", "n_replaced", "text")


@query
def op11_near_vectors(spark, sf_dir):
    return near_vectors.link(table(spark, sf_dir, "embeddings"))


_ORACLES["op11_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN link l ON l.x = r.other),
component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY x) USING (vec_id)"""


@query
def op12_spelling_variants(spark, sf_dir):
    return spellings.group(table(spark, sf_dir, "documents"))


@query
def op13_ranked_search(spark, sf_dir):
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ORACLES["op13_ranked_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
held AS (
  SELECT doc_id, len_of, term, count(*) AS tf
  FROM (SELECT doc_id, len(t) AS len_of, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked)
  GROUP BY doc_id, len_of, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, total GROUP BY term, docs),
worth AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len_of * docs) // length)))) AS v
  FROM held JOIN weight USING (term), total),
scored AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM asked JOIN worth USING (term) GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
