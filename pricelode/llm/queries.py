"""The registered queries over the corpus tables, with production parameters and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from pricelode.llm import bpe, codes, licenses, lines, maxscore, minhash, packing, quality, repetition, spelling, suffixes, toxicity, warc
from pricelode.llm.corpus import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.replace("{upper}", f"'{ascii_uppercase}'").replace("{small}", f"'{ascii_lowercase}'")
        return fn
    return register


@query("""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper}, {small}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
    c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
    SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""")
def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A calibrated toxicity score of every document, learned from labelled rows that are not held out."""
    docs = table(spark, folder, "documents")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fitted(docs.select("doc_id", "text"), table(spark, folder, "labels"), ~out)
    return toxicity.scored(docs, model).withColumn("held_out", out)


@query()
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM f
""")
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    return warc.archived(table(spark, folder, "pages"), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                 len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) AS n_lines,
                 len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) AS n_different
          FROM t),
    v AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM t WHERE len(w) >= 8),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c,
                 CASE WHEN i + 50 <= len(w) THEN count(*) OVER (PARTITION BY doc_id, i + 50 <= len(w), array_to_string(w[i:i + 50], ' ')) ELSE 1 END AS c51
          FROM v),
    r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM g WHERE c > 1) GROUP BY 1),
    l AS (SELECT DISTINCT doc_id FROM g WHERE c51 > 1),
    a AS (SELECT b.doc_id, n_words, word_chars, n_symbols, n_lines - n_different AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
                 l.doc_id IS NOT NULL AS long
          FROM b LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND 100 * n_repeat_words <= 25 * n_words AND NOT long AS kept
    FROM f
""")
def op5_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the repetition rules for every document."""
    return repetition.rules(table(spark, folder, "documents")).drop("spans", "longest_repeat")


@query()
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of a license in a document."""
    return licenses.scanned(table(spark, folder, "documents"))


@query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """A place in a sequence of 4,096 tokens for every piece of every document."""
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What remains of every document without strings of 100 bytes that start earlier."""
    return suffixes.digest(suffixes.without_repeats(table(spark, folder, "documents")))


@query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
               FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best other vectors of every twentieth vector."""
    vectors = table(spark, folder, "embeddings")
    return maxscore.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
               FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, i, regexp_extract_all(translate(line, {upper}, {small}), '[^\\x20\\x09-\\x0D]+') AS w FROM l),
    s AS (SELECT DISTINCT doc_id, i, unnest(CASE
                WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS x FROM t),
    n AS (SELECT doc_id, i, count(*) AS n, md5(string_agg(x, '|' ORDER BY x)) AS k FROM s GROUP BY 1, 2),
    c AS (SELECT k, any_value(n) AS n, min((doc_id, i)) AS first, row_number() OVER () AS id FROM n GROUP BY k),
    d AS (SELECT c.id, c.first, c.n, s.x FROM c JOIN s ON (s.doc_id, s.i) = c.first),
    p AS (SELECT a.id, a.n AS n, b.n AS m, count(*) AS o FROM d a JOIN d b ON a.x = b.x AND b.first < a.first GROUP BY a.id, b.id, a.n, b.n),
    g AS (SELECT DISTINCT id FROM p WHERE 100 * o >= 75 * (n + m - o)),
    k AS (SELECT first FROM c WHERE id NOT IN (SELECT id FROM g)),
    r AS (SELECT l.doc_id, l.i, line, n.k IS NULL OR (l.doc_id, l.i) IN (SELECT first FROM k) AS stays
          FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.i = l.i)
    SELECT d.doc_id, coalesce(any_value(x.n_lines), 0) AS n_lines, coalesce(any_value(x.n_removed), 0) AS n_removed,
           coalesce(any_value(x.text_md5), md5('')) AS text_md5
    FROM documents d LEFT JOIN (
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
               md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS text_md5
        FROM r GROUP BY 1) x USING (doc_id)
    GROUP BY d.doc_id
""")
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without lines similar to an earlier one."""
    return lines.without_similar_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def _codes_sql() -> str:
    """Rounds of assigning all parts to their codebook's nearest entry and moving the entries, one after the other."""
    def near(entries: str) -> str:
        return f"""SELECT r, p.part, min(CAST(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64
                        + b.entry) AS best FROM p JOIN {entries} b ON b.part = p.part GROUP BY 1, 2"""

    def moved(entries: str, best: str) -> str:
        return f"""SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {entries} b LEFT JOIN (
                SELECT part, entry, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS c FROM (
                    SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (
                        SELECT a.part, best % 64 AS entry, unnest(p.c) AS x, unnest(range(len(p.c))) AS i
                        FROM {best} a JOIN p ON p.r = a.r AND p.part = a.part) GROUP BY 1, 2, 3) GROUP BY 1, 2) m
            ON m.part = b.part AND m.entry = b.entry"""

    return f"""
    WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
               FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT r, part, q[part * len(q) // 16 + 1:(part + 1) * len(q) // 16] AS c FROM v, range(16) t(part)),
    b0 AS MATERIALIZED (SELECT part, r AS entry, c FROM p WHERE r < 64),
    a0 AS MATERIALIZED ({near('b0')}), b1 AS MATERIALIZED ({moved('b0', 'a0')}),
    a1 AS MATERIALIZED ({near('b1')}), b2 AS MATERIALIZED ({moved('b1', 'a1')}),
    a2 AS MATERIALIZED ({near('b2')}),
    e AS (SELECT r, string_agg(format('{{:02x}}', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY 1),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS s FROM b2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT s FROM h) AS codebooks_sha256
    FROM v JOIN e USING (r)
    """


@query(_codes_sql())
def op11_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen codebook indexes for every vector, with the errors they leave."""
    return codes.compressed(table(spark, folder, "embeddings"))


@query()
def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score of every document, learned from labelled rows that are not held out."""
    docs, sizes = table(spark, folder, "documents"), ("n_chars",)
    out = toxicity.held_out(F.col("doc_id"))
    machine = quality.fitted(docs, table(spark, folder, "labels"), ~out, sizes)
    return quality.scored(docs, machine, sizes).withColumn("held_out", out)


@query("""
    WITH RECURSIVE bits AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
                    ORDER BY b) AS t FROM range(256) r(b)),
    r AS (SELECT doc_id, w, count(*) AS c FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, {upper}, {small}), '[a-z\u00C0-\u00FF]+')) AS w FROM documents) GROUP BY 1, 2),
    x AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(s)) + 1),
                     lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::BIGINT)),
                     lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1])), 4294967295) AS h
          FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM r WHERE length(w) >= 5), bits),
    v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM x)
          WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
    d AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
    e AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM d),
    p AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT e.word, e.n, v.word, v.n FROM e JOIN v ON v.word = e.rest
          UNION SELECT v.word, v.n, e.word, e.n FROM e JOIN v ON v.word = e.rest),
    q AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min((-m, near)) AS best FROM p GROUP BY 1),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * v.n THEN best[2] END AS form,
                 CASE WHEN -best[1] >= 2 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN q USING (word)),
    g AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT g.word, f.form, step + 1 FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL),
    o AS (SELECT word, arg_max(root, step) AS root FROM g GROUP BY 1)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN o USING (word)
""")
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """The words of all documents, with the commoner words that they are variants of."""
    return spelling.variants(table(spark, folder, "documents"), slips=97)
