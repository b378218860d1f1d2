"""Comments, docstrings, compilability and language of source code and text.

Parsing needs Python; every function here is an Arrow-batched UDF that sets up once per batch or
partition. A null source gives null.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def comments_of(source: str, clean: bool = False) -> str:
    """All comments of Python source, one after the other; clean drops every hash sign."""
    found = "".join(t.string for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT)
    return found.replace("#", "") if clean else found


def docstrings_of(source: str) -> list[str]:
    """Docstrings of the module, its classes and its plain functions, in the order of kind and name."""
    kinds = {ast.ClassDef: "Class", ast.FunctionDef: "Function", ast.Module: "Module"}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    named = [(kinds[type(n)], getattr(n, "name", ""), ast.get_docstring(n)) for n in ast.walk(tree) if type(n) in kinds]
    named.sort(key=lambda x: x[:2])
    return [d for _, _, d in named if d]


def natural_text(source: str, comments: bool = True, clean: bool = True) -> str:
    """Docstrings, a blank line, and comments; what can't be parsed counts as empty."""
    parts = []
    for read in (lambda: "\n".join(docstrings_of(source)), lambda: comments_of(source, clean) if comments else ""):
        try:
            parts.append(read())
        except Exception:  # any source may fail to parse in any way
            parts.append("")
    return "\n\n".join(parts).strip()


def _mapped(kind: str, f: Callable):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else f(x)).astype(object)

    return run


def python_comments(source: Column, clean: bool = False) -> Column:
    def safe(s):
        try:
            return comments_of(s, clean)
        except (tokenize.TokenError, SyntaxError, ValueError):
            return ""

    return _mapped("string", safe)(source)


def python_docstrings(source: Column) -> Column:
    def safe(s):
        try:
            return docstrings_of(s)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []

    return _mapped("array<string>", safe)(source)


def with_natural_text(df: DataFrame, source_col: str) -> DataFrame:
    """Adds nl_text, nl_size (characters) and nl_ratio (null for an empty source)."""
    text = df.withColumn("nl_text", _mapped("string", natural_text)(F.col(source_col)))
    return text.withColumn("nl_size", F.length("nl_text").cast("long")).withColumn("nl_ratio", F.try_divide("nl_size", F.length(source_col)))


def comment_size(source: Column, language: Column) -> Column:
    """Characters in line and block comments by the lexer of each row's language; null for an unknown one."""

    @F.arrow_udf("long")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from pygments.lexers import get_lexer_by_name
        from pygments.token import Comment
        from pygments.util import ClassNotFound

        lexers: dict = {}

        def size(text, lang):
            if not text.is_valid or lang is None:
                return None
            if lang not in lexers:
                try:
                    lexers[lang] = get_lexer_by_name(lang)
                except ClassNotFound:
                    lexers[lang] = None
            if lexers[lang] is None:
                return None
            return sum(len(v) for t, v in lexers[lang].get_tokens(text.as_py()) if t in (Comment.Single, Comment.Multiline) and (t is Comment.Single or t is Comment.Multiline))

        # one text at a time leaves its Arrow batch; a batch as Python strings takes several times its size
        for texts, langs in batches:
            yield pa.array([size(t, x.as_py()) for t, x in zip(texts, langs)], pa.int64())

    return run(source, language)


#: Forms of Python 2 alone, and what says the same in Python 3; applied to code outside strings and comments.
_PYTHON2 = (
    (r"(?m)^([ \t]*(?:[^\n#]*?[:;])?[ \t]*)print[ \t]*>>[ \t]*([^,\n;]+),?[ \t]*([^\n;]*)", r"\1print(\3)"),
    (r"(?m)^([ \t]*(?:(?:if|else|elif|for|while|try|except|finally|with|def)\b[^\n#]*?:|[^\n#]*?;)?[ \t]*)print(?=[ \t;\n]|$)(?![ \t]*[=.(\[])[ \t]*([^\n;#]*?),?[ \t]*(?=[;#\n]|$)", r"\1print(\2)"),
    (r"(?m)^([ \t]*)print[ \t]+(\([^\n;#]*\)[^\n;#]*)", r"\1print(\2)"),
    (r"(?m)^([ \t]*)exec[ \t]+(?![=(.])([^\n;#]+)", r"\1exec(\2)"),
    (r"\bexcept[ \t]+([\w.]+|\([^()\n]*\))[ \t]*,[ \t]*(\w+)[ \t]*:", r"except \1 as \2:"),
    (r"(?m)\braise[ \t]+([\w.]+)[ \t]*,[ \t]*([^\n;#]+)", r"raise \1(\2)"),
    (r"<>", "!="),
    (r"`([^`\n]*)`", r"repr(\1)"),
    (r"\b(0[xX][0-9a-fA-F]+|[0-9]+)[lL]\b", r"\1"),
    (r"\b0([0-7]+)\b(?![.eEjJ])", r"0o\1"),
    (r"\b[uU][rR](?=S\d+S)", ""),
)


def as_python3(source: str) -> str:
    """source with the statements and literals of Python 2 alone rewritten; strings and comments stay as they are."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m[0])
        return f"S{len(kept) - 1}S" if m[0][0] != "#" else f"#S{len(kept) - 1}S"

    text = re.sub(r'''"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*''', hide, source, flags=re.S)
    for old, new in _PYTHON2:
        text = re.sub(old, new, text)
    return re.sub(r"#?S(\d+)S", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else m[0], text)


def python_version(source: str) -> int:
    """3 if this interpreter compiles the source, 2 if it does after as_python3(), else 0."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for version, read in ((3, lambda: source), (2, lambda: as_python3(source))):
            try:
                compile(read(), "<source>", "exec")
                return version
            except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
                continue
    return 0


def versions(source: Column) -> Column:
    """python_version() of each source."""
    return _mapped("int", python_version)(source)


def compiles(source: Column) -> Column:
    """Whether Python source compiles as Python 3 or, its Python 2 forms rewritten, as Python 2.

    There is no Python 2 here, so the second is judged by as_python3(): print, exec and raise
    statements, except clauses, <>, backquotes, octal and long literals.
    """
    return _mapped("boolean", lambda s: python_version(s) > 0)(source)


def compile_report(df: DataFrame, source_col: str) -> DataFrame:
    """Sources, how many compile, and the percentage that doesn't."""
    return df.withColumn("__ok", compiles(F.col(source_col))).agg(
        F.count("__ok").alias("total"), F.count_if("__ok").alias("valid"), F.try_divide(F.count_if(~F.col("__ok")) * 100.0, F.count("__ok")).alias("invalid_pct")
    )


def with_comment_ratio(df: DataFrame, source_col: str, language: Column) -> DataFrame:
    """Adds nl_size (characters in comments) and nl_ratio (of the source; null for an empty one) of sources in any language with a lexer."""
    out = df.withColumn("nl_size", comment_size(F.col(source_col), language))
    return out.withColumn("nl_ratio", F.try_divide("nl_size", F.length(source_col)))


class NgramClassifier:
    """Multinomial naive Bayes over hashed character n-grams: the default language classifier.

    Any picklable object with predict(line) -> (label, score) can take its place.
    """

    def __init__(self, sizes: tuple[int, ...] = (1, 2, 3), places: int = 1 << 14):
        self.sizes, self.places = sizes, places
        self.labels: list[str] = []
        self.weights = np.zeros((0, places))

    def _places(self, line: str) -> np.ndarray:
        codes = np.frombuffer(f" {line} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        out = []
        for n in self.sizes:
            h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
            for k in range(n):
                h = h * np.uint64(1_000_003) + codes[k : k + len(h)]
            out.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50))
        return np.concatenate(out).astype(np.int64) % self.places

    def fit(self, rows: list[tuple[str, str]]) -> "NgramClassifier":
        """rows: (text, label)."""
        self.labels = sorted({label for _, label in rows})
        counts = np.ones((len(self.labels), self.places))
        for text, label in rows:
            counts[self.labels.index(label)] += np.bincount(self._places(text.lower()), minlength=self.places)
        self.weights = np.log(counts / counts.sum(1, keepdims=True))
        return self

    def predict(self, line: str) -> tuple[str, float]:
        s = self.weights[:, self._places(line)].sum(1)
        p = np.exp(s - s.max())
        return self.labels[int(p.argmax())], float(p.max() / p.sum())


_LINE = "struct<id_line:int,number_characters_line:int,language_line:string,score_line:double>"


def language_info(text: Column, classifier) -> Column:
    """struct(language, score, on_lines): of the whole lower-cased text, and of each of its lines."""
    kind = f"language string, score double, on_lines array<{_LINE}>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                if t is None:
                    rows.append((None, None, None))
                    continue
                low = t.lower()
                each = [(k, len(x), *classifier.predict(x)) for k, x in enumerate(low.split("\n"))]
                rows.append((*classifier.predict(low.replace("\n", " ")), [dict(zip(("id_line", "number_characters_line", "language_line", "score_line"), e)) for e in each]))
            yield pd.DataFrame(rows, columns=["language", "score", "on_lines"])

    return run(text)


def language_report(df: DataFrame, language: Column, native: str = "en") -> DataFrame:
    """Rows and percentage of every language, and whether it is another than `native`."""
    counted = df.groupBy(language.alias("language")).agg(F.count("*").alias("n"))
    return counted.select("language", "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"), (F.col("language") != native).alias("foreign"))
