"""Problem 3: source files that do not parse in the language of their suffix."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import grammars, lexers
from siltstone.llm.derivatives import Grammar
from siltstone.session import spread
from siltstone.sources.tables import table

_SOFT = {
    "js": "of as from type get set async static let".split(),
    "ts": "of as from type get set async static let declare namespace module abstract readonly public private protected interface override implements keyof is infer satisfies asserts unique".split(),
}


def _script_grammar(text: str, soft: list[str]) -> str:
    """Words that are keywords only in some places may be names elsewhere; any word may name a member."""
    text = re.sub(r"\bID\b", "id", text)
    words = sorted(lexers.keywords(text))
    text = re.sub(r"\bKW\b", " | ".join(f"'{w}'" for w in words) + " | KV", text)
    return text + "\nid = ID | " + " | ".join(f"'{w}'" for w in soft if w in words) + " ;"


def _grammars() -> dict[str, tuple[str, Callable]]:
    js, ts = _script_grammar(grammars.JAVASCRIPT, _SOFT["js"]), _script_grammar(grammars.TYPESCRIPT, _SOFT["ts"])
    sql_words = " | ".join(f"'{w}'" for w in sorted(lexers.keywords(grammars.SQL)))
    sql = re.sub(r"\bW\b", sql_words, grammars.SQL)
    return {
        "python": (grammars.PYTHON, lexers.python),
        "json": (grammars.JSON, lexers.json),
        "javascript": (js, lexers.script),
        "typescript": (ts, lexers.script),
        "go": (grammars.GO, lexers.go),
        "java": (grammars.JAVA, lexers.java),
        "sql": (sql, lexers.sql),
        "yaml": (grammars.YAML, lexers.yaml),
    }


LANGUAGES = tuple(_grammars())
_MADE = {"python": ("NL", "DEDENT"), "javascript": ("NL",), "typescript": ("NL",), "go": (";",), "yaml": ("NL", "DEDENT")}
_READY: dict[str, tuple[Grammar, Callable[[str], list[str]]]] = {}


def checker(lang: str) -> tuple[Grammar, Callable[[str], list[str]]]:
    if lang not in _READY:
        text, make = _grammars()[lang]
        _READY[lang] = Grammar(text, "file"), make(text)
    return _READY[lang]


def check_text(lang: str, text: str) -> tuple[bool, int, bool]:
    """``(valid, failing token, truncated)``; the token is -1 for a valid text.

    A text is truncated when no token of it fails, but what they leave to
    follow doesn't hold the empty word.
    """
    grammar, classes = checker(lang)
    text = text.removeprefix("\ufeff")
    if not text.strip():
        return True, -1, False
    seen = classes(text)
    at = grammar.check(seen)
    if at is None:
        return True, -1, False
    # line ends and dedents that no character of the text stands for
    made = _MADE.get(lang, ())
    real = len(seen)
    while real and seen[real - 1] in made and not (seen[real - 1] == ";" and text.rstrip().endswith(";")):
        real -= 1
    return False, at, at >= real


def check_files(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, valid, token_no, truncated`` of every row of ``docs`` (key, text, lang).

    ``token_no`` counts the tokens before the one that can't stand where it
    is; ``truncated`` says that the text ends too early. NULL and empty texts
    and languages without a grammar (markdown, others, NULL) are valid: their
    rows never reach Python. ``lang`` is read without regard to case. Map-only,
    one row out per row in.
    """
    lang = F.lower(F.trim("lang"))
    rows = spread(docs.select(F.col(key), F.col("text"), lang.alias("lang")))
    checked = F.coalesce(F.col("lang").isin(*LANGUAGES) & (F.length("text") > 0), F.lit(False))
    kind = dict(docs.dtypes)[key]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [check_text(g, t) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            ok, at, short = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ok, pa.bool_()), pa.array(at, pa.int32()), pa.array(short, pa.bool_())],
                names=[key, "valid", "token_no", "truncated"],
            )

    free = rows.where(~checked).select(key, F.lit(True).alias("valid"), F.lit(-1).alias("token_no"), F.lit(False).alias("truncated"))
    return rows.where(checked).mapInArrow(check, f"{key} {kind}, valid boolean, token_no int, truncated boolean").unionByName(free)


def invalid_rates(docs: DataFrame) -> DataFrame:
    """Files, broken files and their rate per ``repo`` and ``lang``."""
    flags = check_files(docs.withColumn("__at", F.struct("repo", "lang")).select("__at", "text", "lang"), "__at")
    return (
        flags.groupBy(F.col("__at.repo").alias("repo"), F.col("__at.lang").alias("lang"))
        .agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("broken"))
        .withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_files(table(spark, sf_dir, "documents")).where("not valid").select("doc_id")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(table(spark, sf_dir, "documents"))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
ORACLES: dict[str, str] = {}
