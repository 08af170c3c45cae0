"""The queries of these operators over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, licenses, mix, ngrams, pii, quality, resample, secrets, spelling, tokens, urls, warc
from .common import materialize, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_secrets(docs).select("doc_id", "secrets.*")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "filter.*")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mix.plan(table(spark, sf_dir, "documents"))
    return p.rows.select("doc_id", "size", "source_size", "target", (F.col("size") * p.taken()).alias("taken"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_text(pages).select("page_id", "url", "main.text", "main.n_chars")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.scan_pii(docs).select("doc_id", "pii.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    feats = materialize(quality.add_features(docs).select("doc_id", "quality.*"), "quality")
    model = quality.fit_on(feats, "votes")
    out = feats.withColumn("p_good", model.posterior(F.col("votes"))).withColumn("base_failed", quality.failed(F.struct("n_words", "n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= quality.THRESHOLD))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.importance(docs, target)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "license.*")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_url_filter, op3_token_output, op4_decontaminate, op5_mix_sources, op6_ngram_jaccard_join, op7_warc_zip, op8_html_text, op9_pii, op10_quality_rules, op11_resample, op12_license_scan, op13_spelling_variants)}


_HOST = "translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 2)"
_WORDS = "|".join(f"(^|[.-]){'[.-]'.join(r.tokens)}([.-]|$)" for r in urls.PATTERNS)


def _nibbles() -> list[int]:
    """The checksum's table for half a byte."""
    out = list(range(16))
    for _ in range(4):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes, by halves of bytes, the lower half first."""
    half = f"strpos('0123456789ABCDEF', substr(hex(encode({text})), xor(i, 1)::INT + 1, 1)) - 1"
    halves = f"list_transform(range(2 * octet_length(encode({text}))), lambda i: {half})"
    step = f"xor(c >> 4, ({_nibbles()})[(xor(c, b) & 15)::INT + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {halves}), lambda c, b: {step}), 4294967295)"


_LOWER = f"translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}')"
_RUNS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_RESAMPLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_RUNS}') AS w FROM documents),
q AS (SELECT regexp_extract_all({_LOWER}, '{_RUNS}') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d), qw AS (SELECT unnest(w) AS w FROM q),
v AS (SELECT w, ({_crc32("w")} % {resample.BUCKETS})::INT AS b FROM (SELECT w FROM dw UNION SELECT w FROM qw)),
s AS (SELECT b, count(*) AS s FROM dw JOIN v USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM qw JOIN v USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM qw) AS t_all),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {resample.BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {resample.BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (b), n),
x AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY doc_id),
h AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, (('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296 AS u FROM d LEFT JOIN x USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM h),
z AS (SELECT *, CASE WHEN n_features >= {resample.LEAST} THEN row_number() OVER (PARTITION BY n_features >= {resample.LEAST} ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= {resample.LEAST}) OVER () AS total FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {resample.PERCENT} * total // 100 THEN place END AS rank FROM z"""

_SPELLING = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents),
each AS (SELECT doc_id, r, count(*) AS n FROM runs WHERE length(r) >= {spelling.LENGTH} GROUP BY ALL),
sums AS (SELECT r, n, ({_crc32("doc_id::VARCHAR || ':' || r")})::BIGINT AS h FROM each),
cut AS (SELECT CASE WHEN h % {spelling.EVERY} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM sums),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {spelling.LENGTH} GROUP BY word HAVING sum(n) >= {spelling.TIMES}),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM words),
less AS MATERIALIZED (SELECT word, n, spot, substr(word, 1, (spot - 1)::INT) || substr(word, (spot + 1)::INT) AS key FROM spots),
pairs AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.key = b.key AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.key = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.key = b.word),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS top FROM pairs GROUP BY word),
found AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= {spelling.RATIO} * w.n THEN other END AS form, CASE WHEN top >= {spelling.RATIO} * w.n THEN top END AS form_n FROM words w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS here, form AS next FROM found UNION ALL SELECT walk.word, found.word, found.form FROM walk JOIN found ON walk.next = found.word)
SELECT f.word, f.form, walk.here AS root, f.n, f.n_near, f.form_n FROM found f JOIN walk ON f.word = walk.word AND walk.next IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_resample": _RESAMPLE,
        "op13_spelling_variants": _SPELLING,
        "op2_url_filter": f"""
WITH parts AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict FROM parts p LEFT JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule,
  CASE WHEN verdict IS NOT NULL THEN verdict WHEN regexp_matches(host, '{_WORDS}') THEN 'block' ELSE 'allow' END AS verdict
FROM hits""",
        "op7_warc_zip": f"""
WITH src AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
meta AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM src),
top AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM meta)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> first THEN first END AS refers_to
FROM top""",
    }
