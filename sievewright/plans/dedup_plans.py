"""Tokens, fingerprints, near-duplicates and decontamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions.text import jaccard, let, lines, raw_tokens, sha1_hash32, shingles, token_set, tokens
from sievewright.operators import decontaminate, dedup, minhash, stats
from sievewright.plans.common import sql_lines, sql_tokens, table


def distinct_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(token_set(F.col("text"))).cast("long").alias("n_distinct"))


def shingle_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(shingles(raw_tokens(F.col("text")), 5)).cast("long").alias("n_shingles"))


def token_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", sha1_hash32(F.col("text")).alias("hash"))


def jaccard_neighbours(spark, d):
    """Every document against the one with the next id."""
    # texts travel, not their token sets, which take several times as much
    df = table(spark, d, "documents").select("doc_id", F.col("text").alias("a"))
    df = df.join(df.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    both = F.struct(token_set(F.col("a")).alias("a"), token_set(F.col("b")).alias("b"))
    return df.select("doc_id", F.round(let(both, lambda s: jaccard(s["a"], s["b"])), 9).alias("similarity"))


def minhash_signatures(spark, d):
    """256 permutations over word 5-grams of every document."""
    signed = minhash.signatures(table(spark, d, "documents"), "doc_id", "text", num_perm=256, ngram=5)
    return signed.select(F.col("id").alias("doc_id"), F.posexplode("signature").alias("perm", "value"))


def lsh_buckets(spark, d):
    """Sizes of the buckets with more than one document."""
    n_bands, rows = minhash.best_banding(0.7, 256)
    banded = minhash.bands(minhash.signatures(table(spark, d, "documents"), "doc_id", "text", 256, 5), n_bands, rows)
    return banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1").select("band", "n", "least")


def near_dup_components(spark, d):
    return dedup.collision_clusters(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "component")


def near_dedup_kept(spark, d):
    return dedup.drop_collisions(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "lang", "source", "n_chars")


def near_dedup_extremes(spark, d):
    return dedup.greedy_clusters(table(spark, d, "documents"), "doc_id", "text", "source")


def near_dedup_counts(spark, d):
    df = table(spark, d, "documents")
    return dedup.dedup_counts(df, dedup.greedy_clusters(df, "doc_id", "text", "source"), "doc_id")


def near_dedup_cluster_sizes(spark, d):
    return dedup.cluster_sizes(dedup.greedy_clusters(table(spark, d, "documents"), "doc_id", "text", "source"))


def exact_dedup_kept(spark, d):
    return dedup.drop_exact(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "lang")


def before_after_stats(spark, d):
    df = table(spark, d, "documents")
    out = stats.before_after(df, dedup.drop_exact(df, "doc_id", "text"), "lang", "text")
    return out.select("lang", "rows_before", "rows_after", "size_before", "size_after", F.round("delta_rows_pct", 6).alias("delta_rows_pct"), F.round("delta_size_pct", 6).alias("delta_size_pct"))


def _patterns(spark, d):
    items = table(spark, d, "benchmark")
    name = F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")
    return items.select((F.col("item_id") % 2).cast("int").alias("priority"), name.alias("name"), F.col("text").alias("pattern"))


def exact_decontam(spark, d):
    hits = decontaminate.exact_matches(table(spark, d, "documents"), _patterns(spark, d), "doc_id", "text")
    return hits.select(F.col("id").alias("doc_id"), "reason")


def exact_decontam_reasons(spark, d):
    return decontaminate.reason_counts(decontaminate.exact_matches(table(spark, d, "documents"), _patterns(spark, d), "doc_id", "text"))


def exact_decontam_clean(spark, d):
    df = table(spark, d, "documents")
    clean, _ = decontaminate.split_contaminated(df, decontaminate.exact_matches(df, _patterns(spark, d), "doc_id", "text"), "doc_id")
    return clean.select("doc_id", "lang")


def substring_join(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("pattern"))
    return decontaminate.contains_join(table(spark, d, "documents"), items, "text", "pattern").select("doc_id", "item_id")


def near_decontam_flags(spark, d):
    """Every line of every document against the benchmark."""
    each = table(spark, d, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("line", "text"))
    keyed = each.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string")).alias("place"), "text")
    out = decontaminate.near_matches(keyed, table(spark, d, "benchmark"), "place", "text", "item_id", "text")
    return out.select(F.col("id").alias("place"), F.size("neighbours").cast("long").alias("n_neighbours"), F.round("best", 9).alias("best"))


def benchmark_max_similarity(spark, d):
    """All benchmark items against all turns of the conversations."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    out = decontaminate.greatest_similarity(table(spark, d, "benchmark"), turns, "item_id", "text", "text")
    return out.select(F.col("id").alias("item_id"), F.round("best", 9).alias("best"))


QUERIES = {
    f.__name__: f
    for f in (
        distinct_tokens,
        shingle_counts,
        token_hashes,
        jaccard_neighbours,
        minhash_signatures,
        lsh_buckets,
        near_dup_components,
        near_dedup_kept,
        near_dedup_extremes,
        near_dedup_counts,
        near_dedup_cluster_sizes,
        exact_dedup_kept,
        before_after_stats,
        exact_decontam,
        exact_decontam_reasons,
        exact_decontam_clean,
        substring_join,
        near_decontam_flags,
        benchmark_max_similarity,
    )
}

_HASH = "CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT)"


_LOW32, _TWO32 = "4294967295::UBIGINT", "4294967296::UBIGINT"


def _perms(n: int) -> str:
    """(perm, a, b) with a and b as 32-bit halves, so that 64-bit arithmetic does."""
    low = (1 << 32) - 1
    halves = [(i, int(a) & low, int(a) >> 32, int(b) & low, int(b) >> 32) for i, (a, b) in enumerate(zip(*minhash.permutations(n)))]
    return ", ".join(f"({i}, {', '.join(f'{x}::UBIGINT' for x in xs)})" for i, *xs in halves)


def _signed(table_: str, key: str, perms: int) -> str:
    """WITH parts that give signed(id, perm, value) over word 5-grams."""
    return f"""
perms(perm, a0, a1, b0, b1) AS (VALUES {_perms(perms)}),
words AS (SELECT {key} AS id, string_split_regex(text, '[^A-Za-z_0-9]') AS w FROM {table_}),
grams AS (SELECT id, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) AS g FROM words),
hashed AS (SELECT id, {_HASH}::UBIGINT AS v FROM (SELECT id, sha1(g) AS h FROM grams)),
least AS (
  SELECT id, perm, min((((p >> 32) + v * a1 % {_TWO32} + b1 + (((p & {_LOW32}) + b0) >> 32)) % {_TWO32} * {_TWO32} + (((p & {_LOW32}) + b0) & {_LOW32})) % 2305843009213693951::UBIGINT & {_LOW32}) AS value
  FROM (SELECT id, perm, v, a1, b0, b1, v * a0 AS p FROM hashed, perms) GROUP BY id, perm),
signed AS (SELECT w.id, p.perm, CAST(coalesce(l.value, 4294967295) AS BIGINT) AS value FROM words w CROSS JOIN perms p LEFT JOIN least l ON l.id = w.id AND l.perm = p.perm)"""


_BANDED = """
banded AS (SELECT id, perm // {rows} AS band, string_agg(CAST(value AS VARCHAR), ',' ORDER BY perm) AS key FROM signed WHERE perm < {used} GROUP BY id, perm // {rows})"""
_COMPONENTS = """
buckets AS (SELECT band, key, min(id) AS low FROM banded GROUP BY band, key HAVING count(*) > 1),
edges AS (SELECT DISTINCT b.id AS x, k.low AS y FROM banded b JOIN buckets k USING (band, key) WHERE b.id <> k.low),
ties AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x AS id, x AS r FROM ties UNION SELECT reach.id, ties.y FROM reach JOIN ties ON ties.x = reach.r),
components AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""
_EXACT = "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id FROM documents WHERE text IS NULL"
_HITS = """SELECT d.doc_id, CASE WHEN min(b.item_id % 2) = 0 THEN 'even_match' ELSE 'odd_match' END AS reason
FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY d.doc_id"""



def _near_decontam_sql() -> str:
    """MinHash of the distinct tokens of lines and items, 21 bands of 6 rows, and the exact similarity of what shares one."""
    return f"""
WITH perms(perm, a0, a1, b0, b1) AS (VALUES {_perms(128)}),
each AS (SELECT doc_id, unnest({sql_lines('text')}) AS text, generate_subscripts({sql_lines('text')}, 1) - 1 AS line FROM documents),
texts AS (SELECT doc_id || ':' || line AS place, NULL AS item, list_distinct({sql_tokens('text')}) AS w FROM each
          UNION ALL SELECT NULL, item_id, list_distinct({sql_tokens('text')}) FROM benchmark),
numbered AS (SELECT row_number() OVER () AS id, * FROM texts),
hashed AS (SELECT id, {_HASH}::UBIGINT AS v FROM (SELECT id, sha1(unnest(w)) AS h FROM numbered)),
least AS (
  SELECT id, perm, min((((p >> 32) + v * a1 % {_TWO32} + b1 + (((p & {_LOW32}) + b0) >> 32)) % {_TWO32} * {_TWO32} + (((p & {_LOW32}) + b0) & {_LOW32})) % 2305843009213693951::UBIGINT & {_LOW32}) AS value
  FROM (SELECT id, perm, v, a1, b0, b1, v * a0 AS p FROM hashed, perms) GROUP BY id, perm),
signed AS (SELECT n.id, p.perm, coalesce(l.value, 4294967295) AS value FROM numbered n CROSS JOIN perms p LEFT JOIN least l ON l.id = n.id AND l.perm = p.perm),
banded AS (SELECT id, perm // 6 AS band, string_agg(CAST(value AS VARCHAR), ',' ORDER BY perm) AS key FROM signed WHERE perm < 126 GROUP BY id, perm // 6),
pairs AS (SELECT DISTINCT a.place, a.w AS aw, b.item, b.w AS bw FROM banded x JOIN numbered a ON a.id = x.id AND a.place IS NOT NULL
          JOIN banded y ON y.band = x.band AND y.key = x.key JOIN numbered b ON b.id = y.id AND b.item IS NOT NULL)
SELECT place, count(*) AS n_neighbours, round(max(len(list_intersect(aw, bw)) / greatest(1, len(list_distinct(aw || bw)))), 9) AS best FROM pairs GROUP BY place HAVING best >= 0.58"""


ORACLES = {
    "distinct_tokens": f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({sql_tokens('text')})) AS BIGINT) AS n_distinct FROM documents",
    "shingle_counts": """
WITH w AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '[^A-Za-z_0-9]') AS l FROM documents)),
g AS (SELECT doc_id, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(DISTINCT g) AS n_shingles FROM g GROUP BY doc_id""",
    "token_hashes": f"SELECT doc_id, {_HASH} AS hash FROM (SELECT doc_id, sha1(text) AS h FROM documents)",
    "jaccard_neighbours": f"""
SELECT doc_id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(a || b))), 9) AS similarity
FROM (SELECT doc_id, list_distinct({sql_tokens('text')}) AS a FROM documents) JOIN (SELECT doc_id - 1 AS doc_id, list_distinct({sql_tokens('text')}) AS b FROM documents) USING (doc_id)""",
    "lsh_buckets": f"WITH {_signed('documents', 'doc_id', 256)}, {_BANDED.format(rows=10, used=250)} SELECT CAST(band AS INTEGER) AS band, count(*) AS n, min(id) AS least FROM banded GROUP BY band, key HAVING count(*) > 1",
    "minhash_signatures": f"WITH {_signed('documents', 'doc_id', 256)} SELECT id AS doc_id, CAST(perm AS INTEGER) AS perm, value FROM signed",
    "near_dup_components": f"WITH RECURSIVE {_signed('documents', 'doc_id', 256)}, {_BANDED.format(rows=10, used=250)}, {_COMPONENTS} SELECT id AS doc_id, component FROM components",
    "near_dedup_kept": f"""WITH RECURSIVE {_signed('documents', 'doc_id', 256)}, {_BANDED.format(rows=10, used=250)}, {_COMPONENTS}
SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT id FROM components WHERE id <> component)""",
    "exact_dedup_kept": f"SELECT doc_id, lang FROM documents JOIN ({_EXACT}) USING (doc_id)",
    "before_after_stats": f"""
WITH k AS ({_EXACT}), m AS (SELECT lang, length(text) AS n, doc_id IN (SELECT doc_id FROM k) AS kept FROM documents),
r AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'total' ELSE lang END AS lang, count(*) AS rows_before, count(*) FILTER (kept) AS rows_after,
             CAST(sum(n) AS BIGINT) AS size_before, CAST(sum(CASE WHEN kept THEN n ELSE 0 END) AS BIGINT) AS size_after FROM m GROUP BY ROLLUP (lang))
SELECT *, round((rows_after - rows_before) * 100.0::DOUBLE / rows_before, 6) AS delta_rows_pct, round((size_after - size_before) * 100.0::DOUBLE / size_before, 6) AS delta_size_pct FROM r""",
    "exact_decontam": _HITS,
    "exact_decontam_reasons": f"SELECT reason, count(*) AS n FROM ({_HITS}) GROUP BY reason",
    "exact_decontam_clean": f"SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_HITS}))",
    "substring_join": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))",
    "near_decontam_flags": _near_decontam_sql(),
    "benchmark_max_similarity": f"""
WITH i AS (SELECT item_id, list_distinct({sql_tokens('text')}) AS a FROM benchmark), t AS (SELECT list_distinct({sql_tokens('text')}) AS b FROM conversations)
SELECT item_id, round(max(len(list_intersect(a, b)) / greatest(1, len(list_distinct(a || b)))), 9) AS best FROM i, t GROUP BY item_id""",
}
