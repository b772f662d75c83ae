"""Registered queries of the operators, each next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.catalog.registry import table
from sheetwise.llm import byte_bpe, conversation_repair, divergence, embedding_dedup, importance, license_scan, near_dedup, packing, piece_sampling, quality_rules, secret_scan, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query(r"""
WITH url AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule_verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM url JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                     AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM url LEFT JOIN fits USING (page_id)
""")
def op1_url_filter(spark, sf_dir):
    rules = spark.sql("""SELECT * FROM VALUES
        ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/') AS rules(verdict, host, path)""")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


@query()
def op2_quality_rules(spark, sf_dir):
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"measured.{c}").alias(c) for c in names])


@query()
def op3_quality_classifier(spark, sf_dir):
    sampled = importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return sampled.select("doc_id", "sampled.*")


@query()
def op4_secret_scan(spark, sf_dir):
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@query()
def op5_license_scan(spark, sf_dir):
    return license_scan.license_notices(table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op6_best_fit_packing(spark, sf_dir):
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), word_tokenizer())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query()
def op7_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op8_minhash_near_dedup(spark, sf_dir):
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query()
def op9_sentencepiece_sampling(spark, sf_dir):
    sampled = piece_sampling.sample_pieces(table(spark, sf_dir, "documents"), piece_model())
    return sampled.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


@query("""
WITH payload AS (
  SELECT page_id, coalesce(html, '') AS html,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
sized AS (SELECT page_id, strlen(html) AS payload_bytes, payload_digest FROM payload),
first AS (
  SELECT payload_digest, min(page_id) AS first FROM sized
  WHERE payload_bytes >= 100 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM sized LEFT JOIN first USING (payload_digest)
""")
def op10_warc(spark, sf_dir):
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder)


@query(r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT row, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS size FROM counts GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(sizes.size, 0) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sizes USING (lang, source)),
shares AS (
  SELECT lang, g.source, kept.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (g.size + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (total + 2)) // (langs.size + 2 * v) AS q
  FROM groups AS g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances AS d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
""")
def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op12_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    encoded = docs.select("doc_id", byte_bpe.ids_of(F.col("text"), byte_tokenizer()).alias("ids"))
    decoded = encoded.withColumn("decoded", byte_bpe.text_of(F.col("ids"), byte_tokenizer()))
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(r"""
WITH RECURSIVE checks AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    [n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entry),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    [4294967295] || list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, x: xor(c >> 8, entry[1 + (xor(c, x) & 255)]))) % 20 AS kind
  FROM keyed, checks),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM damaged),
rows AS (
  SELECT conv_id, turn, role, text, initial, i,
         CASE WHEN trimmed = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id),
-- a .. d: cheapest way to the states nothing yet, after system, after user, after assistant; u, v: with turns inserted
walk(conv_id, i, a, b, c, d) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]},
         {'cost': 9999999, 'audit': '', 'lines': []::VARCHAR[]}, {'cost': 9999999, 'audit': '', 'lines': []::VARCHAR[]},
         {'cost': 9999999, 'audit': '', 'lines': []::VARCHAR[]}
  FROM conversations
  UNION ALL
  SELECT conv_id, i + 1,
         {'cost': a.cost + 3, 'audit': a.audit || 'D', 'lines': a.lines},
         list_sort([{'cost': b.cost + 3, 'audit': b.audit || 'D', 'lines': b.lines},
                    {'cost': a.cost + stays + CASE WHEN initial = 's' THEN 0 ELSE 9999999 END, 'audit': a.audit || 'K', 'lines': a.lines || [role || ':' || text]}])[1],
         list_sort([{'cost': u.cost + 3, 'audit': u.audit || 'D', 'lines': u.lines}] || flatten(list_transform([a, b, v], lambda x: [
                    {'cost': x.cost + stays + CASE WHEN initial = 'u' THEN 0 ELSE 9999999 END, 'audit': x.audit || 'K', 'lines': x.lines || [role || ':' || text]},
                    {'cost': x.cost + stays + 2, 'audit': x.audit || 'R', 'lines': x.lines || ['user:' || text]}])))[1],
         list_sort([{'cost': v.cost + 3, 'audit': v.audit || 'D', 'lines': v.lines},
                    {'cost': u.cost + stays + CASE WHEN initial = 'a' THEN 0 ELSE 9999999 END, 'audit': u.audit || 'K', 'lines': u.lines || [role || ':' || text]},
                    {'cost': u.cost + stays + 2, 'audit': u.audit || 'R', 'lines': u.lines || ['assistant:' || text]}])[1]
  FROM (
    SELECT *, list_sort([d, {'cost': u.cost + 2, 'audit': u.audit || 'I', 'lines': u.lines || ['assistant:']}])[1] AS v
    FROM (
      SELECT walk.*, role, text, initial,
             CASE fault WHEN 'truncated' THEN 1 WHEN 'fine' THEN 0 ELSE 9999999 END AS stays,
             list_sort([c] || list_transform([a, b, d], lambda x: {'cost': x.cost + 2, 'audit': x.audit || 'I', 'lines': x.lines || ['user:']}))[1] AS u
      FROM walk JOIN rows ON rows.conv_id IS NOT DISTINCT FROM walk.conv_id AND rows.i = walk.i + 1))),
ends AS (
  SELECT conv_id, list_sort([a, d, {'cost': u.cost + 2, 'audit': u.audit || 'I', 'lines': u.lines || ['assistant:']}])[1] AS best
  FROM (SELECT *, list_sort([c] || list_transform([a, b], lambda x: {'cost': x.cost + 2, 'audit': x.audit || 'I', 'lines': x.lines || ['user:']}))[1] AS u
        FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1))
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
       sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ends LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ends.conv_id
""")
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_report(conversation_repair.damage(table(spark, sf_dir, "conversations")))
