"""Generated source code: every document's whole text within real programs, as a DataFrame and as SQL.

The text stands in comments, line by line, and as one line in docstrings. Six kinds of Python
programs, by doc_id: classes, decorators and nested functions; async functions; hash signs in
strings; a syntax error; Python 2; a string without an end. Java, JavaScript and Python with the text
in their comments serve the lexers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.plans.common import table

PROGRAMS = [
    '"""{quoted}"""\n{noted}\n@decorate  # first\nclass Holder:\n    """Holds {lang}."""\n    def outer(self):\n        """Outer."""\n        def inner():\n            """Inner."""\n            return 1  # deep\n        return inner\n',
    "async def fetch(x):\n    \"\"\"Not a plain function.\"\"\"\n    await x  # wait\ndef plain():\n    '''Plain {doc_id}.'''\n{noted}\n",
    "x = \"# not a comment\"  # real\n{noted}\ny = '''\n# nor this\n'''\n",
    '"""{quoted}"""\n{noted}\ny = = 2\n',
    '{noted}\nprint "{lang}"  # old\n',
    '{noted}\nx = """open\n',
]
LEXED = {
    "java": '/* {block} */\nclass A {\n  String s = "// no /* no */";\n  int x = 1; // one\n}\n{slashed}\n',
    "javascript": "var s = '// no'; /* {block} */\nlet f = (x) => x / 2; // one\n{slashed}\n",
    "python": "# one\ns = '# no'\n{noted}\n",
    "no such language": "{noted}\n",
}


def _spark(template: str, names: dict[str, Column]) -> Column:
    return F.concat(*(names[p[1:-1]] if re.fullmatch(r"\{[a-z_]+\}", p) else F.lit(p) for p in re.split(r"(\{[a-z_]+\})", template) if p))


def _sql(template: str) -> str:
    return " || ".join(p[1:-1] if re.fullmatch(r"\{[a-z_]+\}", p) else "'" + p.replace("'", "''") + "'" for p in re.split(r"(\{[a-z_]+\})", template) if p)


def _rows(spark, d: str) -> tuple[DataFrame, dict[str, Column]]:
    df = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    words = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    names = {
        "doc_id": F.col("doc_id").cast("string"),
        "lang": F.col("lang"),
        "quoted": F.replace(F.replace(words, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
        "noted": F.concat(F.lit("# "), F.replace(text, F.lit("\n"), F.lit("\n# "))),
        "slashed": F.concat(F.lit("// "), F.replace(text, F.lit("\n"), F.lit("\n// "))),
        "block": F.replace(text, F.lit("*/"), F.lit("* /")),
    }
    return df, names


def python_sources(spark, d: str) -> DataFrame:
    """(doc_id, lang, code)"""
    df, names = _rows(spark, d)
    code = F.lit(None).cast("string")
    for k, program in enumerate(PROGRAMS):
        code = F.when(F.col("doc_id") % len(PROGRAMS) == k, _spark(program, names)).otherwise(code)
    return df.select("doc_id", "lang", code.alias("code"))


def lexed_sources(spark, d: str) -> DataFrame:
    """(doc_id, kind, code)"""
    df, names = _rows(spark, d)
    code, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, program) in enumerate(LEXED.items()):
        here = F.col("doc_id") % len(LEXED) == k
        code, kind = F.when(here, _spark(program, names)).otherwise(code), F.when(here, name).otherwise(kind)
    return df.select("doc_id", kind.alias("kind"), code.alias("code"))


_BASE = r"""
base AS (
  SELECT *, replace(replace(words, '\', '\\'), '"', '\"') AS quoted, '# ' || replace(text, chr(10), chr(10) || '# ') AS noted, '// ' || replace(text, chr(10), chr(10) || '// ') AS slashed,
         replace(text, '*/', '* /') AS block, length(text) - length(replace(text, chr(10), '')) AS breaks
  FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS words FROM documents))"""
#: What the programs hold, by hand: their comments without hash signs, and the list of their docstrings.
PYTHON_SQL = f"""{_BASE},
code AS (
  SELECT doc_id, lang, doc_id % 6 AS k, CASE doc_id % 6 {' '.join(f'WHEN {k} THEN {_sql(p)}' for k, p in enumerate(PROGRAMS))} END AS code,
         replace(replace(noted, chr(10), ''), '#', '') AS note,
         words
  FROM base),
told AS (
  SELECT doc_id, lang, k, code,
         CASE k WHEN 0 THEN note || ' first deep' WHEN 1 THEN ' wait' || note WHEN 2 THEN ' real' || note WHEN 3 THEN note WHEN 4 THEN note || ' old' ELSE '' END AS comments,
         CASE k WHEN 0 THEN ['Holds ' || lang || '.', 'Inner.', 'Outer.'] || (CASE WHEN words = '' THEN [] ELSE [words] END) WHEN 1 THEN ['Plain ' || doc_id || '.'] ELSE [] END AS docstrings
  FROM code)"""
LEXED_SQL = f"""{_BASE},
lexed AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN length('/*  */// one') + length(block) + length(slashed) - breaks WHEN 1 THEN length('/*  */// one') + length(block) + length(slashed) - breaks
                                 WHEN 2 THEN length('# one') + length(noted) - breaks END AS size,
         CASE doc_id % 4 {' '.join(f'WHEN {k} THEN {_sql(p)}' for k, p in enumerate(LEXED.values()))} END AS code
  FROM base)"""
