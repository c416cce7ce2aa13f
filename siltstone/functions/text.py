"""Scalar text functions as column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Suffix to language, of code and of documents; and folders a scan never enters.
CODE_LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "kt": "kotlin", "rs": "rust", "rb": "ruby", "php": "php",
    "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "scala": "scala", "swift": "swift",
    "sql": "sql", "sh": "bash", "yaml": "yaml", "yml": "yaml", "toml": "toml",
}
DOCUMENT_LANGUAGES = {"md": "markdown", "rst": "rst", "txt": "text"}
SKIP_DIRS = [".git", ".venv", "venv", "node_modules", "__pycache__", "site-packages", "build", "dist", ".tox", ".mypy_cache", ".pytest_cache", "graphify-out"]
LANGUAGES = CODE_LANGUAGES | DOCUMENT_LANGUAGES
# Fixed value: what makes a path a test's.
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]+$|_test\.\w+$|\.(test|spec)\.\w+$"


def split_lines(text: Column) -> Column:
    """Lines at every kind of line end; no empty line after a last line end."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def bare_path(path: Column) -> Column:
    """The path without leading ``./``."""
    return F.regexp_replace(path, r"^(\./)+", "")


def normalize(text: Column) -> Column:
    """Lower case, and nothing but letters, digits and blanks."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")


def identifier_tokens(text: Column) -> Column:
    """Identifiers in lower case, followed by their camel-case and underscore parts where there are several."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    parts = lambda w: F.regexp_extract_all(w, F.lit(r"[A-Za-z][a-z0-9]*|[0-9]+"), F.lit(0))
    each = lambda w: F.concat(F.array(F.lower(w)), F.when(F.size(parts(w)) > 1, F.transform(parts(w), F.lower)).otherwise(F.array()))
    return F.flatten(F.transform(words, each))


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return table[suffix]


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def line_of_location(location: Column) -> Column:
    """``L12``, ``12`` or a number: the line."""
    return F.nullif(F.regexp_extract(location.cast("string"), r"^L?(\d+)", 1), F.lit("")).cast("int")


def short_symbol(symbol: Column) -> Column:
    """What follows the last ``::``, then the last dot."""
    return F.element_at(F.split(F.element_at(F.split(symbol, "::"), -1), r"\."), -1)


def clean_label(label: Column) -> Column:
    return F.regexp_replace(label, r"[()]+$", "")


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def numbered(lines: Column, first: Column) -> Column:
    """A listing: five places of line number, two blanks, the line."""
    return F.array_join(F.transform(lines, lambda x, i: F.format_string("%5d  %s", (first + i).cast("int"), x)), "\n")


def hash32(word: Column) -> Column:
    """The first 8 hex digits of md5 as a number; one that every engine has."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, from ``sha2``; ``message`` is text."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def signed_by(signature: Column, key: bytes, message: Column) -> Column:
    """Whether ``signature`` is ``sha256=<hex>`` of the message; a missing one is not."""
    return F.coalesce(signature == F.concat(F.lit("sha256="), hmac_sha256(key, message)), F.lit(False))


def commonest(counts: Column) -> Column:
    """A map's entries as ``key n, key n``, by key; empty for an empty map."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), ", ")


def ago(moment: Column, now: Column) -> Column:
    """Time since ``moment`` in its largest fitting unit of s, m and h."""
    s = F.unix_timestamp(now) - F.unix_timestamp(moment)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))


def module_name(path: Column) -> Column:
    """The dotted module of a Python file; of a package's ``__init__`` the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")


def absolute_import(path: Column, module: Column) -> Column:
    """``module`` of an import in the file ``path``, leading dots resolved against the file's package."""
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    rest = F.nullif(F.regexp_replace(module, r"^\.+", ""), F.lit(""))
    parts = F.filter(F.split(module_name(path), r"\."), lambda x: x != "")
    kept = F.size(parts) - dots + F.when(path.rlike(r"(^|/)__init__\.py$"), 1).otherwise(0)
    base = F.nullif(F.array_join(F.slice(parts, F.lit(1), F.greatest(kept, F.lit(0))), "."), F.lit(""))
    return F.when(dots > 0, F.concat_ws(".", base, rest)).otherwise(module)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def job_of_message(key: Column, value: Column) -> Column:
    """The job a message is about: its key, else the id in its body or in the job it holds."""
    return F.coalesce(key, F.get_json_object(value, "$.job_id"), F.get_json_object(value, "$.job.job_id"))
