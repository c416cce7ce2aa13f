"""Texts to chunks of lines, and chunks back to line ranges."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import language_of, split_lines

MAX_BYTES = 400_000
DOC_SUFFIX = r"\.(md|rst|txt)$"


def indexable(text: str = "text"):
    """Texts that are small enough and hold no NUL near their start."""
    return (F.octet_length(text) <= MAX_BYTES) & ~F.substring(text, 1, 4096).contains("\0")


def window_starts(first, last, size: int, overlap: int):
    """Starts of windows over lines ``first..last``; no window after one that reaches the end."""
    step = size - overlap
    n = last - first + 1
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda k: first + k * step)).otherwise(F.array().cast("array<int>"))


def window_chunks(texts: DataFrame, key: str, text: str = "text", size: int = 80, overlap: int = 10) -> DataFrame:
    """``key, start_line, end_line, text``: overlapping windows of lines; windows of blanks alone are dropped."""
    rows = texts.where(F.length(text) > 0).select(key, split_lines(F.col(text)).alias("lines"))
    n = F.size("lines")
    cut = rows.select(key, "lines", F.explode(window_starts(F.lit(1), n, size, overlap)).alias("start_line"))
    end = F.least(F.col("start_line") + size - 1, F.size("lines"))
    body = F.array_join(F.slice("lines", F.col("start_line").cast("int"), (end - F.col("start_line") + 1).cast("int")), "\n")
    return cut.select(key, F.col("start_line").cast("int"), end.cast("int").alias("end_line"), body.alias("text")).where(F.col("text").rlike(r"\S"))


def heading_chunks(texts: DataFrame, key: str, text: str = "text", size: int = 60, overlap: int = 5) -> DataFrame:
    """``key, start_line, end_line, symbol``: sections at headings of one to four signs, long ones in windows."""
    rows = texts.where(F.length(text) > 0).select(key, split_lines(F.col(text)).alias("lines"))
    lines = rows.select(key, F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    heads = lines.where((F.col("pos") == 0) | F.col("line").rlike("^#{1,4} "))
    title = F.when(F.col("line").rlike("^#{1,4} "), F.trim(F.regexp_replace("line", "^#{1,4} ", "")))
    following = F.lead("pos").over(Window.partitionBy(key).orderBy("pos"))
    sections = heads.select(key, (F.col("pos") + 1).alias("first"), F.coalesce(following, F.col("n")).alias("last"), title.alias("symbol"))
    cut = sections.select(key, "last", "symbol", F.explode(window_starts(F.col("first"), F.col("last"), size, overlap)).alias("start_line"))
    return cut.select(key, F.col("start_line").cast("int"), F.least(F.col("start_line") + size - 1, F.col("last")).cast("int").alias("end_line"), "symbol")


def _python_chunks(text: str, max_lines: int) -> list[tuple[int, int, str]]:
    lines = text.splitlines()
    n = len(lines)

    def windows(a: int, b: int, size: int, overlap: int, name: str) -> list[tuple[int, int, str]]:
        out, s = [], a
        while s <= b:
            e = min(s + size - 1, b)
            out.append((s, e, name))
            if e >= b:
                break
            s += size - overlap
        return out

    try:
        body = ast.parse(text.removeprefix("\ufeff")).body
    except (SyntaxError, ValueError, RecursionError):
        return windows(1, n, 80, 10, "")
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    spans: list[tuple[int, int, str]] = []

    def begin(x) -> int:
        return min([x.lineno, *(d.lineno for d in x.decorator_list)])

    def span(a: int, b: int, name: str) -> None:
        spans.extend(windows(a, b, max_lines, 0, name) if b - a + 1 > 1.5 * max_lines else [(a, b, name)])

    for x in body:
        if not isinstance(x, kinds):
            continue
        if isinstance(x, ast.ClassDef) and x.end_lineno - begin(x) + 1 > max_lines:
            at = begin(x)
            for y in x.body:
                if isinstance(y, kinds):
                    if begin(y) > at:
                        span(at, begin(y) - 1, x.name)
                    span(begin(y), y.end_lineno, f"{x.name}.{y.name}")
                    at = y.end_lineno + 1
            if at <= x.end_lineno:
                span(at, x.end_lineno, x.name)
        else:
            span(begin(x), x.end_lineno, x.name)
    out, at = [], 1
    for a, b, name in sorted(spans):
        if a > at:
            out += windows(at, a - 1, max_lines, 0, "<module>")
        out.append((a, b, name))
        at = max(at, b + 1)
    if at <= n:
        out += windows(at, n, max_lines, 0, "<module>")
    return out


def python_chunks(texts: DataFrame, key: str, text: str = "text", max_lines: int = 80) -> DataFrame:
    """``key, start_line, end_line, symbol`` by top-level definitions of Python; gaps are ``<module>``."""
    kind = dict(texts.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                lines = t.splitlines()
                rows += [(k, a, b, s) for a, b, s in _python_chunks(t, max_lines) if "".join(lines[a - 1 : b]).strip()]
            yield pd.DataFrame(rows, columns=[key, "start_line", "end_line", "symbol"])

    return texts.where(F.length(text) > 0).select(key, text).mapInPandas(work, f"{key} {kind}, start_line int, end_line int, symbol string")


def chunk_files(files: DataFrame, key: str, path: str = "path", text: str = "text") -> DataFrame:
    """``key, start_line, end_line, symbol, kind, lang`` of every indexable file, cut by its kind."""
    rows = files.where(indexable(text) & F.col(path).isNotNull()).withColumn("__lang", language_of(F.col(path))).where("__lang is not null")
    docs = F.lower(path).rlike(DOC_SUFFIX)
    parts = [
        (heading_chunks(rows.where(docs), key, text), "doc"),
        (python_chunks(rows.where(F.col("__lang") == "python"), key, text), "code"),
        (window_chunks(rows.where(~docs & (F.col("__lang") != "python")), key, text).drop("text").withColumn("symbol", F.lit("")), "code"),
    ]
    cut = parts[0][0].withColumn("kind", F.lit("doc"))
    for part, kind in parts[1:]:
        cut = cut.unionByName(part.withColumn("kind", F.lit(kind)))
    return cut.join(rows.select(key, F.col("__lang").alias("lang")).dropDuplicates([key]), key)


def rebuild_snippet(chunks: DataFrame, keys: list[str], start: int, end: int, longest: int = 200) -> DataFrame:
    """``keys, line_no, line`` of lines ``start..end`` out of overlapping chunks; the earliest chunk's line counts.

    At most ``longest`` lines after the first are read, one more in all.
    """
    end = min(end, start + longest)
    hit = chunks.where((F.col("start_line") <= end) & (F.coalesce("end_line", F.lit(1 << 30)) >= start))
    lines = hit.select(*keys, "start_line", "chunk_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line_no", F.col("start_line") + F.col("pos")).where(F.col("line_no").between(start, end))
    return lines.groupBy(*keys, "line_no").agg(F.min_by("line", F.struct("start_line", "chunk_id")).alias("line"))
