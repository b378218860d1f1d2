"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import (
    decontamination,
    language_id,
    line_dedup,
    mixing,
    quality_forest,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    token_counts,
    url_filter,
)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: (rule_id, pattern, action): the list that op1 applies.
URL_RULES = [
    (1, "spam-farm.example.org/", "block"),
    (2, "spam-farm.example.org/en/", "allow"),
    (3, "example.net/es/", "block"),
    (4, "tionsh.example.com/", "block"),
    (5, "blog.tionsh.example.com/en/", "allow"),
    (6, "example.com/de/", "block"),
    (7, "example.org/fr", "block"),
    (8, "m.example.org/", "block"),
    (9, "ththth.example.net/en/", "allow"),
    (10, "example.net/en/25", "block"),
    (11, "www.ththon.example.org/de/", "allow"),
    (12, "example.org/de/", "block"),
    (13, "EXAMPLE.ORG:80/de/#part", "allow"),
    (14, "example.com/fr/825?page=2&ref=x", "block"),
    (15, "192.0.2.7/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule_id long, pattern string, action string")
    return url_filter.match_urls(_table(spark, sf_dir, "pages"), rules)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.keep_bitmaps(_table(spark, sf_dir, "documents")).drop("digest")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents")).drop("digest")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability")


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_quality_forest": op10_quality_forest,
}

_RULES = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in URL_RULES)


def _split_sql(table: str, column: str, keep: str) -> str:
    """The canonical host, path and full path of a URL column in DuckDB SQL."""
    plain = f"trim(coalesce({column}, ''))"
    unreserved = "^(2[DdEe]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])"
    resolved = f"""CASE WHEN NOT contains({plain}, '%') THEN {plain} ELSE array_to_string([
      CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '{unreserved}') THEN chr(CAST(('0x' || substr(p, 1, 2)) AS INTEGER)) || substr(p, 3)
           WHEN regexp_matches(p, '^[0-9A-Fa-f][0-9A-Fa-f]') THEN '%' || upper(substr(p, 1, 2)) || substr(p, 3) ELSE '%' || p END FOR p, i IN string_split({plain}, '%')], '') END"""
    kept = """array_to_string(list_reduce([[s] FOR s IN string_split(CASE WHEN regexp_matches(bare, '/[.][.]?$') THEN bare || '/' ELSE bare END, '/')],
      lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE a || s END), '/')"""
    return f"""
  SELECT {keep}, lower_host AS host, clean AS path, clean || substr(rest, length(bare) + 1) AS full_path
  FROM (SELECT *, CASE WHEN bare = '' THEN '/' WHEN contains(bare, '/.') THEN CASE WHEN kept = '' THEN '/' ELSE kept END ELSE bare END AS clean
        FROM (SELECT *, {kept} AS kept
              FROM (SELECT *, split_part(rest, '?', 1) AS bare,
                           regexp_replace(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')), '^[.]+|[.]+$', '', 'g') AS lower_host
                    FROM (SELECT *, substr(u, length(authority) + 1) AS rest
                          FROM (SELECT *, regexp_extract(u, '^[^/?]*') AS authority
                                FROM (SELECT *, regexp_replace(split_part({resolved}, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
                                      FROM {table}))))))"""


#: Written by hand, apart from the operator's patterns: kind, pattern and expression of the value m.
_SECRETS = [
    ("access_key", "AKIA[A-Z0-9]{16}", "m"),
    (
        "assignment",
        """([Aa][Pp][Ii][-_]?[Kk][Ee][Yy]|[Aa][Cc][Cc][Ee][Ss][Ss][-_]?[Kk][Ee][Yy]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Pp][Aa][Ss][Ss][Ww][Oo]?[Rr]?[Dd])"""
        """[-_.A-Za-z0-9]{0,40}["'']?[]]?[ \\t]{0,40}(:=|=>|:|=)[ \\t]{0,40}"""
        """("[^\\x00-\\x20"]{8,}"|''[^\\x00-\\x20'']{8,}''|[^\\x00-\\x20"''`,;(){}\\[\\]<>$=][^\\x00-\\x20"''`,;(){}\\[\\]<>]{7,}([\\x00-\\x20,;)}\\]]|$))""",
        """CASE WHEN regexp_matches(v0, '^["'']') THEN substr(v0, 2, length(v0) - 2) WHEN regexp_matches(v0, '[0-9]') THEN regexp_replace(v0, '[\\x00-\\x20,;)}\\]]$', '') END""",
    ),
    ("hosting_token", "gh(p|o|u|s|r)_[0-9A-Za-z]{36}", "m"),
    (
        "private_key",
        "-----BEGIN [ A-Z0-9]*PRIVATE KEY( BLOCK)?-----[^-]*(-[^-]+){0,4}",
        """CASE WHEN length(body) >= 16 THEN body END""",
    ),
    ("web_token", "eyJ[-_A-Za-z0-9]{8,}[.][-_A-Za-z0-9]{8,}[.][-_A-Za-z0-9]{8,}", "m"),
    ("chat_token", "xox[abprs]-[-A-Za-z0-9]{10,}", "m"),
    ("service_key", "AIza[-_A-Za-z0-9]{35}|(r|s)k_live_[A-Za-z0-9]{16,}|glpat-[-_A-Za-z0-9]{20}|npm_[A-Za-z0-9]{36}", "m"),
    ("url_password", """://[-+%._A-Za-z0-9]{1,64}:[^\\x00-\\x20/:@"''<>]{4,128}@""", "split_part(substr(m, 4, length(m) - 4), ':', 2)"),
]


def _secrets_sql() -> str:
    parts = [
        f"""SELECT doc_id, repo, '{kind}' AS kind, {value} AS v
  FROM (SELECT *, regexp_replace(m, '^[^:=]*(:=|=>|:|=)[ \\t]*', '') AS v0,
               regexp_replace(regexp_replace(regexp_replace(m, '^-----[ A-Z0-9]*-----', ''), '[\\x00-\\x20"'']', '', 'g'), '\\\\[nr]', '', 'g') AS body
        FROM (SELECT doc_id, coalesce(source, '(none)') AS repo, unnest(regexp_extract_all(coalesce(text, ''), '{pattern}')) AS m FROM documents))"""
        for kind, pattern, value in _SECRETS
    ]
    return (
        "WITH found AS ("
        + " UNION ALL ".join(parts)
        + """),
each AS (SELECT *, sha256(v) AS candidate_hash, len(list_distinct(string_split(v, ''))) AS symbols,
                regexp_matches(lower(v), 'example|changeme|placeholder|dummy|your|xxxx|1234567|abcdefg') AND kind <> 'private_key' AS placeholder FROM found WHERE v IS NOT NULL)
SELECT kind, candidate_hash, count(*) AS occurrences, count(DISTINCT repo) AS repositories, count(DISTINCT split_part(repo, '/', 1)) AS owners,
       min(doc_id) AS first_id,
       CASE WHEN bool_or(placeholder) OR min(symbols) < 8 THEN 'placeholder' WHEN count(DISTINCT split_part(repo, '/', 1)) >= 3 THEN 'copied_example'
            ELSE 'owner_specific' END AS verdict
FROM each GROUP BY kind, candidate_hash"""
    )


ORACLES = {
    "op1_url_filter": f"""
WITH rules(rule_id, pattern, action) AS (VALUES {_RULES}),
ruled AS (SELECT rule_id, action, host || full_path AS expression, len(string_split(host, '.')) AS labels, length(full_path) AS long FROM ({_split_sql("rules", "pattern", "rule_id, action")})),
parts AS ({_split_sql("(SELECT DISTINCT page_id, url FROM pages)", "url", "page_id, url")}),
lists AS (SELECT *, string_split(host, '.') AS hl, string_split(path, '/') AS pl FROM parts),
spread AS (
  SELECT page_id, url,
         CASE WHEN host = '' THEN [] WHEN regexp_matches(host, '^[0-9.]+$|^\\[') THEN [host]
              ELSE [array_to_string(hl[i:], '.') FOR i IN range(1, len(hl) + 1) IF i = 1 OR len(hl) - i >= 1] END AS hosts,
         list_distinct([full_path, path] || [array_to_string(pl[:k], '/') || '/' FOR k IN range(1, len(pl))]) AS paths
  FROM lists),
expressions AS (SELECT page_id, url, h || unnest(paths) AS expression FROM (SELECT page_id, url, paths, unnest(hosts) AS h FROM spread)),
hits AS (
  SELECT page_id, url, rule_id, action, expression,
         row_number() OVER (PARTITION BY page_id, url ORDER BY labels DESC, long DESC, action, rule_id) AS k
  FROM expressions JOIN ruled USING (expression))
SELECT p.page_id, p.url, coalesce(h.action, 'none') AS action, CAST(coalesce(h.rule_id, -1) AS BIGINT) AS rule_id, coalesce(h.expression, '') AS expression
FROM (SELECT DISTINCT page_id, url FROM pages) p
LEFT JOIN hits h ON h.k = 1 AND h.page_id IS NOT DISTINCT FROM p.page_id AND h.url IS NOT DISTINCT FROM p.url
""",
    "op6_secret_scan": _secrets_sql(),
    "op3_line_dedup": """
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
bare AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM lines),
marked AS (
  SELECT doc_id, pos,
         line = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, pos) = 1 AS kept
  FROM bare),
turns AS (
  SELECT *, CASE WHEN kept = lag(kept) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM marked),
runs AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM turns),
lengths AS (SELECT doc_id, run, bool_or(kept) AS kept, count(*) AS n FROM runs GROUP BY doc_id, run)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN kept THEN n ELSE 0 END) AS BIGINT) AS n_kept,
       CASE WHEN bool_or(run = 1 AND NOT kept) THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS keep_bitmap
FROM lengths GROUP BY doc_id
""",
    "op9_mixing": """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l, coalesce(text, '') AS t FROM documents),
formed AS (
  SELECT doc_id, source, lang, s, l,
         CASE WHEN contains(t, 'License') OR contains(t, 'icensed under') THEN 'licence' WHEN contains(t, ' | ') THEN 'table'
              WHEN contains(t, '@') OR contains(t, ' = "') THEN 'contact' ELSE 'prose' END AS topic,
         len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS n
  FROM docs),
cells AS (SELECT s, l, topic, CAST(sum(n) AS DOUBLE) AS have FROM formed GROUP BY s, l, topic),
total AS (SELECT 0.5 * sum(have) AS want FROM cells),
ws AS (SELECT s, pow(sum(have), 0.5) AS p FROM cells GROUP BY s),
wl AS (SELECT l, pow(sum(have), 0.7) AS p FROM cells GROUP BY l),
wt AS (SELECT topic, pow(sum(have), 0.7) AS p FROM cells GROUP BY topic),
goals AS (
  SELECT cells.*, ws.p / (SELECT sum(p) FROM ws) * want AS gs, wl.p / (SELECT sum(p) FROM wl) * want AS gl, wt.p / (SELECT sum(p) FROM wt) * want AS gt
  FROM cells JOIN ws USING (s) JOIN wl USING (l) JOIN wt USING (topic), total),
raked AS (
  SELECT 0 AS k, s, l, topic, have, gs, gl, gt, 0.5 * have AS w FROM goals
  UNION ALL
  SELECT k + 1, s, l, topic, have, gs, gl, gt, least(have, w3) FROM (
    SELECT *, CASE WHEN sum(w2) OVER (PARTITION BY topic) > 0 THEN w2 * gt / sum(w2) OVER (PARTITION BY topic) ELSE 0 END AS w3 FROM (
      SELECT *, CASE WHEN sum(w1) OVER (PARTITION BY l) > 0 THEN w1 * gl / sum(w1) OVER (PARTITION BY l) ELSE 0 END AS w2 FROM (
        SELECT *, CASE WHEN sum(w) OVER (PARTITION BY s) > 0 THEN w * gs / sum(w) OVER (PARTITION BY s) ELSE 0 END AS w1 FROM raked WHERE k < 40)))),
drawn AS (SELECT s, l, topic, round(CASE WHEN have > 0 THEN w / have ELSE 0 END, 6) AS p FROM raked WHERE k = 40)
SELECT doc_id, source, lang, topic, CAST(n AS BIGINT) AS n_tokens, p AS probability
FROM formed JOIN drawn USING (s, l, topic)
WHERE CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix'), 1, 12)) AS BIGINT) / 281474976710656.0 < p
""",
}
