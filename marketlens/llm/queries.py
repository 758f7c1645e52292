"""The registered queries of the package: thin uses of the operators on whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontam, licenses, minhash, packing, periodic, quality, sanitise, secrets, tokenfile, toxicity, variants, vectorgraph, warc
from marketlens.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5),
  lambda j: ((strpos('0123456789abcdef', substr(hex, ((i * 5 + j) // 4)::INT + 1, 1)) - 1) >> (3 - (i * 5 + j) % 4)::INT & 1) << (4 - j)::INT))::INT, 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM f
"""


@query("op3_warc_transactions", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = warc.captures(table(spark, sf_dir, "pages"))
    field = lambda k: F.col("metadata.fields")[k].cast("long")
    return c.select(field("page-id").alias("page_id"), F.coalesce("response.payload_bytes", field("payload-bytes")).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
                    F.col("response.record_type").alias("record_type"), field("refers-to-page").alias("refers_to"))


@query("op6_token_stream_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digests(table(spark, sf_dir, "documents"))


@query("op10_harmonic_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


# ALNUM words, first with A-Z lower-cased, in DuckDB.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, w[i:i + k - 1] AS win FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, w[i:i + k - 1] AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op1_winnowing_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op7_automaton_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_documents(table(spark, sf_dir, "documents")))


@query("op4_license_containment", licenses.containment_sql(_WORDS))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


@query("op8_ordinal_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.grade_documents(docs, model).select("doc_id", quality.held_out().alias("held_out"), "expected_grade", "tail", quality.accepted().alias("accepted"))


OP9_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT doc_id, min(reach) AS m FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query("op9_bbit_minhash", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda c: c * c))) AS n FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) AND a.n > 0 AND b.n > 0 AND isfinite(a.n) AND isfinite(b.n)
  AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS vec_id, a AS reach FROM e UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT vec_id, min(reach) AS m FROM r GROUP BY vec_id), k AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN k USING (vec_id) LEFT JOIN c USING (vec_id)
"""


@query("op2_pruned_graph_near_duplicates", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorgraph.links(table(spark, sf_dir, "embeddings"))


@query("op5_string_kernel_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def planted_period(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The repetition that the contract of operator 11 puts into every tenth text or so."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


@query("op11_dyadic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.find_runs(table(spark, sf_dir, "documents"), planted_period))


# crc32 is no DuckDB function: its table from the generator polynomial, then one step a byte (here latin runs only).
OP12_SQL = """
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::UINTEGER], [0::UINTEGER FOR _ IN range(8)]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256))::UINTEGER AS i))),
runs AS (SELECT translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, doc_id, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS x FROM documents) GROUP BY ALL),
bytes AS (SELECT run, doc_id, c, unhex(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run))) AS b FROM runs WHERE length(run) >= 6),
h AS (SELECT run, c, xor(list_reduce(list_concat([4294967295::UINTEGER], list_transform(range(octet_length(b)), lambda j: ('0x' || substr(hex(b), 2 * j::INT + 1, 2))::UINTEGER)), lambda a, y: xor(a >> 8, t[xor(a, y) % 256 + 1])), 4294967295::UINTEGER) AS h FROM bytes, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
k AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
near AS (SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.p = b.p AND a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, v.word FROM k JOIN v ON v.word = k.p || k.s UNION SELECT v.word, k.word FROM k JOIN v ON v.word = k.p || k.s),
g AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY v.n DESC, encode(b)) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN g USING (word)),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, r.next, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""


@query("op12_trie_pair_variants", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.count_words(table(spark, sf_dir, "documents"), misspell=199))


@query("op13_disclosure_sanitisation")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.private_digests(sanitise.find_private(table(spark, sf_dir, "documents")))
