"""Secret scans: candidate credentials judged by who else has them.

Every text is searched by patterns; of a match the value alone is hashed (of a private key the body
without header, line breaks and quotes, of an assignment what is assigned, without quotes). Only a candidate's SHA-256 leaves the row. Candidates are
counted over the whole corpus by distinct repository and owner: what many owners have is a copied
example; what one or two owners have and looks random is probably live.

The counts are nested aggregations (repository, owner, candidate), each combined before its
shuffle, so no distinct-count expands the rows and a candidate that everyone has stays a counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (a substring that every match has, or None; pattern; what is cut out of a match so that its value is left)
PATTERNS = {
    "access_key": ("AKIA", r"AKIA[0-9A-Z]{16}", ""),
    # a keyword, in code, JSON, settings or a subscript, and what is assigned to it: quoted, or unquoted up to a delimiter
    "assignment": (
        None,
        r"(?:[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]|[Aa][Cc][Cc][Ee][Ss][Ss][_-]?[Kk][Ee][Yy]|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo]?[Rr]?[Dd])"
        r"[A-Za-z0-9_.-]{0,40}[\"']?\]?[ \t]{0,40}(?::=|=>|[:=])[ \t]{0,40}"
        r"(?:\"[^\"\x00-\x20]{8,}\"|'[^'\x00-\x20]{8,}'|[^\x00-\x20\"'`,;(){}\[\]<>$=][^\x00-\x20\"'`,;(){}\[\]<>]{7,}(?:[\x00-\x20,;)}\]]|$))",
        r"^[^:=]*(?::=|=>|[:=])[ \t]*",
    ),
    "hosting_token": ("gh", r"gh[pousr]_[A-Za-z0-9]{36}", ""),
    # the body, not the header, up to the footer; encrypted keys have headers with single hyphens
    "private_key": (
        "PRIVATE KEY",
        r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[^-]*(?:-[^-]+){0,4}",
        r"^-----[A-Z0-9 ]*-----|[\x00-\x20\"']|\\[nr]",
    ),
    "web_token": ("eyJ", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ""),
    "chat_token": ("xox", r"xox[abprs]-[A-Za-z0-9-]{10,}", ""),
    "service_key": (None, r"AIza[0-9A-Za-z_-]{35}|[rs]k_live_[0-9A-Za-z]{16,}|glpat-[0-9A-Za-z_-]{20}|npm_[0-9A-Za-z]{36}", ""),
    "url_password": ("://", r"://[A-Za-z0-9._%+-]{1,64}:[^\x00-\x20/:@\"'<>]{4,128}@", r"^://[^:]*:|@$"),
}
LEAST_KEY = 16
MANY_OWNERS = 3
FEW_SYMBOLS = 8
NONE = "(none)"


def _found(text: Column, kind: str) -> Column:
    sure, pattern, cut = PATTERNS[kind]
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if sure:
        got = F.when(F.contains(text, F.lit(sure)), got).otherwise(F.array().cast("array<string>"))
    value = F.transform(got, lambda m: F.regexp_replace(m, cut, "")) if cut else got
    if kind == "private_key":
        value = F.filter(value, lambda v: F.length(v) >= LEAST_KEY)
    if kind == "assignment":
        # one credential is one candidate however it is quoted; without quotes it needs a digit, so that prose is none
        value = F.filter(value, lambda v: v.rlike("^[\"']|[0-9]"))
        value = F.transform(value, lambda v: F.when(v.rlike("^[\"']"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(F.regexp_replace(v, r"[\x00-\x20,;)}\]]$", "")))
    return F.transform(value, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """(id, repo, owner, kind, candidate_hash, symbols, placeholder): a row for each candidate of each document, repeats included."""
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(NONE))
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(
        F.col(id_col).alias("id"), repo.alias("repo"), F.split_part(repo, F.lit("/"), F.lit(1)).alias("owner"), F.explode(F.concat(*(_found(text, k) for k in PATTERNS))).alias("c")
    )
    value = F.col("c.value")
    return each.select(
        "id",
        "repo",
        "owner",
        F.col("c.kind").alias("kind"),
        F.sha2(value, 256).alias("candidate_hash"),
        F.size(F.array_distinct(F.split(value, ""))).alias("symbols"),
        # a key's body is long enough to hold such a word by chance
        (F.lower(value).rlike("example|changeme|placeholder|dummy|your|xxxx|1234567|abcdefg") & (F.col("c.kind") != "private_key")).alias("placeholder"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", many_owners: int = MANY_OWNERS, few_symbols: int = FEW_SYMBOLS) -> DataFrame:
    """(kind, candidate_hash, occurrences, repositories, owners, first_id, verdict) for every candidate of the corpus.

    The owner is what stands before the first "/" of the repository. Verdicts, in this order:
    "placeholder" for values that say so or have fewer than few_symbols distinct characters,
    "copied_example" for those of at least many_owners owners, else "owner_specific". A null
    repository is "(none)"; a null or empty text has no candidate, a very long one is searched whole;
    repeated rows count as often as they occur; first_id is the least id that isn't null. Other columns are ignored; an empty table
    gives an empty table.
    """
    found = candidates(docs, id_col, text_col, repo_col)
    keys = ["kind", "candidate_hash"]
    kept = [F.min("id").alias("id"), F.min("symbols").alias("symbols"), F.bool_or("placeholder").alias("placeholder")]
    by_repo = found.groupBy(*keys, "owner", "repo").agg(F.count("*").alias("n"), *kept)
    by_owner = by_repo.groupBy(*keys, "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), *kept)
    total = by_owner.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.sum("repos").alias("repositories"), F.count("*").alias("owners"), *kept)
    verdict = F.when(F.col("placeholder") | (F.col("symbols") < few_symbols), "placeholder").when(F.col("owners") >= many_owners, "copied_example").otherwise("owner_specific")
    return total.select(*keys, "occurrences", "repositories", "owners", F.col("id").alias("first_id"), verdict.alias("verdict"))
