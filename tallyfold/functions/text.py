"""Text and list helpers, each ``f(col, ...) -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: major.minor.patch, where the first two parts may be empty.
VERSION_PATTERN = r"\d*\.\d*\.\d+"

BLANKS = " \t"


def path_tail(path: Column) -> Column:
    """The part after the last slash; text without a slash is returned unchanged."""
    return F.substring_index(path, "/", -1)


def version_numbers(text: Column) -> Column:
    """Every ``x.y.z`` version found in the text, in order."""
    return F.regexp_extract_all(text, F.lit(VERSION_PATTERN), 0)


def strip_line(text: Column) -> Column:
    """Drop CR and LF anywhere, then blanks and tabs at both ends."""
    return F.btrim(F.translate(text, "\r\n", ""), F.lit(BLANKS))


def translate_with_suffix(text: Column, source: str, target: str, suffix: str = "") -> Column:
    """Map each character of ``source`` to the one at its place in ``target``; then add ``suffix``.

    A shorter ``target`` is padded with its last character.
    """
    if target:
        target = target.ljust(len(source), target[-1])
    return F.concat(F.translate(text, source, target), F.lit(suffix))


def split_list(text: Column, sep: str = ",") -> Column:
    """A separated list as an array."""
    return F.split(text, rf"\Q{sep}\E")


def with_port(text: Column, port: int, path: str = "", sep: str = ",") -> Column:
    """``a,b`` becomes ``a:port,b:port``; every element gets the port, the last one too."""
    tail = f":{port}{path}"
    return F.concat(F.replace(text, F.lit(sep), F.lit(tail + sep)), F.lit(tail))


def address_pairs(text: Column, sep: str = ",") -> Column:
    """``ip:host,ip:host`` as an array of ``(ip, host)``; explode or inline it for rows."""
    return F.transform(
        split_list(text, sep),
        lambda item: F.struct(first_field(item, ":").alias("ip"), last_field(item, ":").alias("host")),
    )


def table_name(path: Column) -> Column:
    """The table a file loads into: its base name without the suffix, ``-`` turned into ``_``."""
    return F.translate(F.regexp_replace(path_tail(path), r"\.[^.]*$", ""), "-", "_")


def integer_part(text: Column) -> Column:
    """What stands before the decimal point."""
    return first_field(text, ".")


def first_field(text: Column, sep: str) -> Column:
    return F.split_part(text, F.lit(sep), F.lit(1))


def last_field(text: Column, sep: str) -> Column:
    return F.split_part(text, F.lit(sep), F.lit(-1))


def path_suffix(path: Column) -> Column:
    """The lower-cased part after the last dot."""
    return F.lower(last_field(path, "."))


def role_of(line: Column) -> Column:
    """``Mode: leader`` gives ``leader``."""
    return F.btrim(last_field(line, ":"), F.lit(BLANKS))


def iso_to_timestamp(text: Column) -> Column:
    """The ISO date and time at the start of the text, as a zone-free timestamp; null if there is none."""
    iso = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})"
    plain = F.concat_ws(" ", F.regexp_extract(text, iso, 1), F.regexp_extract(text, iso, 2))
    return F.nullif(plain, F.lit(" ")).try_cast("timestamp_ntz")


def iso_to_text(text: Column) -> Column:
    """ISO text rewritten as ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(iso_to_timestamp(text), "yyyy-MM-dd HH:mm:ss")
