"""Running SQL text and SQL files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Fixed pattern: quoted text, a comment, the end of a statement, or a word that opens or closes a block.
_TOKENS = re.compile(
    r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;"""
    r"""|(?<![\w.])(?:BEGIN|CASE|END(?:\s+(?:IF|LOOP|WHILE|REPEAT|FOR|CASE))?)(?!\w)""",
    re.S | re.I,
)
# Fixed pattern: what may stand before the first word of a block.
_LABEL = re.compile(r"(?:\w+\s*:)?", re.S)


def split_statements(text: str) -> list[str]:
    """The statements of a script: cut at ``;``, comments dropped, hints and quoted text left alone.

    A block that a statement starts with, ``BEGIN ... END``, stays whole, with the blocks and ``CASE`` expressions inside it.
    """
    out, held, at, depth = [], "", 0, 0
    for token in _TOKENS.finditer(text):
        held += text[at : token.start()]
        at, word = token.end(), re.sub(r"\s+", " ", token[0]).upper()
        if word == ";" and depth == 0:
            out.append(held)
            held = ""
            continue
        if word[:2] in ("--", "/*") and word[:3] != "/*+":
            held += " "
            continue
        if word == "BEGIN" and (depth or _LABEL.fullmatch(held.strip())) or word == "CASE" and depth:
            depth += 1
        elif word in ("END", "END CASE") and depth:
            depth -= 1
        held += token[0]
    return [s.strip() for s in (*out, held + text[at:]) if s.strip()]


def run_sql(spark: SparkSession, text_or_paths: str | list[str]) -> DataFrame | None:
    """Run a SQL text, or every statement of the listed SQL files, in order; the last result is returned.

    A listed path may be a folder or a pattern: its files run in the order of their paths. Blocks run as Spark's SQL scripts.
    Empty scripts do nothing.
    """
    scripts = [text_or_paths] if isinstance(text_or_paths, str) else [s for p in text_or_paths for s in _scripts(spark, p)]
    result = None
    for script in scripts:
        for statement in split_statements(script):
            result = spark.sql(statement)
    return result


def _scripts(spark: SparkSession, path: str) -> list[str]:
    # Scripts are driver-side input by nature: their statements are submitted one by one.
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path").orderBy("file_path")
    return [r.value for r in files.collect()]
