"""Find the dialect of a CSV source from its first lines: delimiter, quote, escape, header, line breaks.

A bounded head of the file is read; every candidate dialect is scored on it by the agreement of the
field counts, then by the number of fields and by the columns that hold one kind of value
throughout.  The whole file is then read strictly under the winner, so a wrong guess fails the ingest
instead of bending rows.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

HEAD_LINES = 1000  # lines looked at
HEAD_CHARS = 1 << 20  # and characters, whatever the lines' lengths
DELIMITERS = (",", ";", "\t", "|")
QUOTES = ('"', "'")

_KINDS = (
    ("boolean", re.compile(r"(?i)true|false")),
    ("integer", re.compile(r"[+-]?[0-9]+")),
    ("float", re.compile(r"(?i)[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?")),
    ("date", re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")),
    ("datetime", re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?")),
)


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'  # the quote itself: quotes are doubled
    header: bool = True
    multi_line: bool = False
    columns: int = 1


def head_lines(spark: SparkSession, path: str, lines: int = HEAD_LINES, chars: int = HEAD_CHARS) -> list[str]:
    """The first lines of a text source, at most ``lines`` of them and ``chars`` characters in all."""
    from pyspark.sql import functions as F

    rows = spark.read.text(path).limit(lines).select(F.left("value", F.lit(chars)).alias("value")).collect()
    out, size = [], 0
    for r in rows:
        size += len(r["value"]) + 1
        if size > chars and out:
            break
        out.append(r["value"])
    if out:
        out[0] = out[0].removeprefix("﻿")
    return out


def kind_of(value: str) -> str:
    """The kind of a field's text; an empty field has none."""
    value = value.strip()
    if not value:
        return ""
    return next((k for k, pattern in _KINDS if pattern.fullmatch(value)), "string")


def _joined(kinds: set[str]) -> str:
    kinds = kinds - {""}
    if kinds <= {"integer", "float"} and kinds:
        return "float" if "float" in kinds else "integer"
    if kinds <= {"date", "datetime"} and kinds:
        return "datetime" if "datetime" in kinds else "date"
    return kinds.pop() if len(kinds) == 1 else "string" if kinds else ""


def column_kinds(rows: Sequence[Sequence[str]]) -> list[str]:
    """One kind a column over all rows: '' where every field is empty, string where they differ."""
    width = max(map(len, rows), default=0)
    return [_joined({kind_of(r[i]) for r in rows if i < len(r)}) for i in range(width)]


def _parse(lines: Sequence[str], delimiter: str, quote: str, backslash: bool) -> tuple[list[list[str]], bool, bool] | None:
    """(records, whether one spans lines, whether one is open at the end), None if not readable."""
    reader = csv.reader(
        (line + "\n" for line in lines), delimiter=delimiter, quotechar=quote, doublequote=not backslash,
        escapechar="\\" if backslash else None, strict=True,
    )
    records, broken, before = [], False, 0
    try:
        for record in reader:
            broken |= reader.line_num - before > 1
            before = reader.line_num
            if record:
                records.append(record)
    except csv.Error as exc:
        if "unexpected end of data" not in str(exc):
            return None
        return records, True, True  # the head ends inside a quoted field
    return records, broken, False


def _quoted(lines: Sequence[str], delimiter: str, quote: str) -> bool:
    """Whether any field begins with the quote."""
    start = re.compile(f"(^|{re.escape(delimiter)}){re.escape(quote)}")
    return any(start.search(line) for line in lines)


def has_header(records: Sequence[Sequence[str]]) -> bool:
    """The first record is a header unless it fits the columns below it.

    Where all columns are text nothing tells it apart and a header is assumed, as for a single record
    of texts; names that are empty, repeated or all numbers are no header.
    """
    if not records:
        return True
    first, rest = records[0], records[1:]
    names = [f.strip() for f in first]
    kinds = [kind_of(f) for f in first]
    if any(not n for n in names) or len(set(names)) < len(names):
        return False
    if not rest:
        return all(k == "string" for k in kinds)
    below = column_kinds(rest)
    typed = [(a, b) for a, b in zip(kinds, below) if b not in ("", "string")]
    if not typed:
        return all(k == "string" for k in kinds)
    return any(_joined({a, b}) == "string" for a, b in typed)


def sniff_lines(lines: Sequence[str], delimiters: Sequence[str] = DELIMITERS) -> Dialect:
    """The best dialect of the given first lines; one column under the first delimiter for an empty source."""
    best, best_score = None, None
    for delimiter in delimiters:
        for quote in QUOTES:
            if quote != '"' and not _quoted(lines, delimiter, quote):
                continue
            for backslash in (False, True):
                if backslash and not any("\\" + quote in line for line in lines):
                    continue
                parsed = _parse(lines, delimiter, quote, backslash)
                if parsed is None or not parsed[0]:
                    continue
                records, broken, open_end = parsed
                width, agreeing = Counter(map(len, records)).most_common(1)[0]
                body = [r for r in records[1:] if len(r) == width] or records
                typed = sum(k not in ("", "string") for k in column_kinds(body))
                # A quote that opens fields and is read as text loses to one that is understood.
                plain = sum(f.startswith(QUOTES) and f[:1] == f[-1:] and len(f) > 1 for r in records for f in r)
                # Several columns on most lines beat one column: the odd lines are malformed then.
                several = width > 1 and 2 * agreeing > len(records)
                score = (several, agreeing / len(records), not open_end, -plain, width, typed, -broken)
                if best_score is None or score > best_score:
                    best_score = score
                    best = Dialect(delimiter, quote, "\\" if backslash else quote, has_header(records), broken, width)
    return best or Dialect(delimiters[0])


def sniff(spark: SparkSession, path: str, delimiter: str | None = None) -> Dialect:
    return sniff_lines(head_lines(spark, path), (delimiter,) if delimiter else DELIMITERS)


def read_csv(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """The whole source under a dialect; a row that does not fit fails the job.

    Without a header the columns are called column0, column1, ...
    """
    df = (
        spark.read.option("header", dialect.header)
        .option("inferSchema", True)
        .option("mode", "FAILFAST")
        .option("delimiter", dialect.delimiter)
        .option("quote", dialect.quote)
        .option("escape", dialect.escape)
        .option("multiLine", dialect.multi_line)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        .csv(path)
    )
    return df if dialect.header else df.toDF(*(f"column{i}" for i in range(len(df.columns))))
