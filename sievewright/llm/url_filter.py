"""URL filters: host-suffix and path-prefix rules, found by hash prefixes and confirmed by full digests.

A URL is expanded into every combination of a suffix of its host and a prefix of its path that a
rule could name. Expressions and rules meet in an equi-join on the first 32 bits of their SHA-256;
the whole digest then confirms the hit. Of a URL's hits the most specific rule decides.

Expansion stops at the greatest number of host labels and path segments that occur in the rules:
longer expressions have no counterpart. The rules are broadcast only below BROADCAST_RULES.

URLs and rules are brought to one form first: percent-escapes of letters, digits and "-._~" are
resolved and the digits of others put in capitals (once, as a server does), dot segments of the
path are removed, the host loses its case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 200_000
NO_RULE = "none"


def unescape(url: Column) -> Column:
    """url with unreserved characters for their percent-escapes, and capitals in the other escapes."""
    unreserved = "^(?:2[DdEe]|3[0-9]|4[1-9A-Fa-f]|5[0-9Aa]|5[Ff]|6[1-9A-Fa-f]|7[0-9Aa]|7[Ee])"

    def part(p: Column, i: Column) -> Column:
        code, rest = F.substring(p, 1, 2), F.substr(p, F.lit(3))
        sign = F.char(F.conv(code, 16, 10).cast("long"))
        other = F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), F.upper(code), rest)).otherwise(F.concat(F.lit("%"), p))
        return F.when(i == 0, p).when(p.rlike(unreserved), F.concat(sign, rest)).otherwise(other)

    return F.when(F.contains(url, F.lit("%")), F.array_join(F.transform(F.split(url, "%"), part), "")).otherwise(url)


def without_dots(path: Column) -> Column:
    """path, which begins with a slash, without "." and ".." segments."""
    whole = F.when(path.rlike(r"/[.][.]?$"), F.concat(path, F.lit("/"))).otherwise(path)

    def step(kept: Column, s: Column) -> Column:
        return F.when(s == ".", kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(s)))

    parts = F.aggregate(F.slice(F.split(whole, "/"), 2, 1 << 30), F.array(F.lit("")), step)
    return F.when(F.contains(path, F.lit("/.")), F.when(F.size(parts) == 1, "/").otherwise(F.array_join(parts, "/"))).otherwise(path)


def split_urls(df: DataFrame, url: Column, *keep: str) -> DataFrame:
    """The columns `keep` and (host, path, full) of a URL or of a rule's host/path; full is the path with the query.

    Scheme, user, port and fragment go, the host loses its case and outer dots, an empty path is "/".
    Every step is a column of its own, so that none is evaluated twice.
    """
    c = F.col
    df = df.select(*keep, F.trim(url).alias("u")).withColumn("u", unescape(c("u")))
    df = df.withColumn("u", F.regexp_replace(F.split_part("u", F.lit("#"), F.lit(1)), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    df = df.withColumn("authority", F.regexp_extract("u", r"^[^/?]*", 0)).withColumn("rest", F.substr("u", F.length("authority") + 1))
    df = df.withColumn("host", F.regexp_replace(F.regexp_replace("authority", r"^.*@", ""), r":[0-9]*$", "")).withColumn("bare", F.split_part("rest", F.lit("?"), F.lit(1)))
    df = df.withColumn("host", F.regexp_replace(F.lower("host"), r"^[.]+|[.]+$", "")).withColumn("path", F.when(c("bare") == "", "/").otherwise(without_dots(c("bare"))))
    return df.select(*keep, "host", "path", F.concat("path", F.substr("rest", F.length("bare") + 1)).alias("full"))


def _is_address(host: Column) -> Column:
    return host.rlike(r"^[0-9.]+$|^\[")


def host_suffixes(host: Column, most: int) -> Column:
    """The host and its suffixes of two labels or more, of at most `most` labels; of an address only itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    some = F.filter(cut, lambda s, i: ((i == 0) | (n - i >= 2)) & (n - i <= most))
    return F.when(_is_address(host), F.array(host)).otherwise(some)


def path_prefixes(path: Column, full: Column, most: int) -> Column:
    """The path with its query, the path, and its directories, of at most `most` slashes."""
    parts = F.split(path, "/")
    n = F.size(parts)
    top = F.least(n - 1, F.lit(most))
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    own = F.when(n - 1 <= most, F.array(full, path)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, dirs))


def compile_rules(rules: DataFrame, rule_col: str = "rule_id", pattern_col: str = "pattern", action_col: str = "action") -> DataFrame:
    """Rules with prefix, digest and specificity. A rule without a pattern or an action is left out."""
    given = rules.where(F.col(pattern_col).isNotNull() & F.col(action_col).isNotNull())
    given = given.select(F.col(rule_col).alias("rule_id"), F.col(action_col).alias("action"), F.col(pattern_col).alias("pattern"))
    return (
        split_urls(given, F.col("pattern"), "rule_id", "action")
        .withColumn("expression", F.concat("host", "full"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
        .withColumn("labels", F.size(F.split("host", r"\.")))
        .withColumn("slashes", F.size(F.split("path", "/")) - 1)
    )


def match_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(id_col, url_col, action, rule_id, expression) for every distinct (id, url) of pages.

    rules has (rule_id, pattern, action), action "allow" or "block". Precedence: more host labels,
    then the longer path, then allow before block, then the least rule_id. A URL without a match, a
    null and an empty one have the action "none", rule_id -1 and an empty expression. Repeated rows give one row, other
    columns are ignored, an empty table gives an empty table; without rules nothing matches. The id
    may be of any type and the two columns may have any name; very long URLs are expanded whole, up
    to the labels and slashes of the rules.
    """
    ruled = compile_rules(rules)
    sizes = ruled.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.max("slashes").alias("slashes")).first()
    ruled = ruled.select("prefix", "digest", "rule_id", "action", "labels", F.length("full").alias("long"))
    # size is checked: rules are a few hundred bytes each
    ruled = F.broadcast(ruled) if sizes["n"] <= broadcast_rules else ruled
    # the table is cut down to the two columns, under names of its own, so that none can clash
    page = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"))
    parts = split_urls(page, F.coalesce("url", F.lit("")), "page", "url")
    hosts = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(host_suffixes(F.col("host"), sizes["labels"] or 1))
    each = parts.select("page", "url", F.explode_outer(hosts).alias("suffix"), path_prefixes(F.col("path"), F.col("full"), sizes["slashes"] or 1).alias("prefixes"))
    each = each.select("page", "url", "suffix", F.explode("prefixes").alias("prefixed")).select("page", "url", F.concat("suffix", "prefixed").alias("expression"))
    each = each.withColumn("sha", F.sha2("expression", 256)).withColumn("prefix", F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"))
    hits = each.join(ruled, "prefix", "left")
    rank = F.when(
        F.col("sha") == F.col("digest"),
        F.struct((-F.col("labels")).alias("a"), (-F.col("long")).alias("b"), F.col("action").alias("action"), F.col("rule_id").alias("rule_id"), F.col("expression").alias("expression")),
    )
    best = hits.groupBy("page", "url").agg(F.min(rank).alias("best"))
    out = best.select("page", "url", F.coalesce("best.action", F.lit(NO_RULE)), F.coalesce("best.rule_id", F.lit(-1)), F.coalesce("best.expression", F.lit("")))
    return out.toDF(id_col, url_col, "action", "rule_id", "expression")
