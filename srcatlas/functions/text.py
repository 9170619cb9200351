"""Column helpers for paths and texts.  All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcatlas.functions.tables import BYTES_PER_TOKEN, EMBED_MAX_TOKENS, LANGUAGES, UNKNOWN_LANGUAGE

# The characters Unicode calls white space (Spark's own trim knows U+0020 only).
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: The same as a SQL literal.
WHITESPACE_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE)) == ""


def byte_len(c: Column) -> Column:
    """Size in bytes; all size limits count bytes, not characters."""
    return F.octet_length(c)


def token_estimate(c: Column) -> Column:
    return F.floor(byte_len(c) / BYTES_PER_TOKEN).cast("long")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last ``.`` and what follows it in the file name; empty without a dot."""
    name = base_name(path)
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def stem(path: Column) -> Column:
    """File name without its last extension (``.py`` has an empty stem)."""
    name = base_name(path)
    return F.left(name, F.char_length(name) - F.char_length(extension(path)))


def directory(path: Column) -> Column:
    """Directory part: ``.`` for a bare name, ``/`` for a file in the root."""
    cut = F.char_length(path) - F.char_length(base_name(path))
    return F.when(cut == 0, ".").when(cut == 1, "/").otherwise(F.left(path, cut - 1))


def depth(path: Column) -> Column:
    """Number of ``/``-separated segments; an absolute path has an empty first one."""
    return (byte_len(path) - byte_len(F.replace(path, F.lit("/"), F.lit(""))) + 1).cast("int")


def language(path: Column) -> Column:
    table = ", ".join(f"'{ext}', '{name}'" for ext, name in LANGUAGES.items())
    return F.coalesce(F.element_at(F.expr(f"map({table})"), extension(path)), F.lit(UNKNOWN_LANGUAGE))


def line_count(text: Column) -> Column:
    return (byte_len(text) - byte_len(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normalize(text: Column) -> Column:
    """Drop leading blank lines, keep the first line's indentation and everything after it.

    The leading white space is cut at its last line feed, which needs no repeated group in a pattern.
    """
    rest = F.ltrim(text, F.lit(WHITESPACE))
    lead = F.left(text, F.char_length(text) - F.char_length(rest))
    keep = F.char_length(F.substring_index(lead, "\n", -1))
    return F.when(rest == "", "").otherwise(F.right(text, F.char_length(rest) + keep))


def skip_reason(text: Column) -> Column:
    """Why a text is not embedded: ``blank``, ``long`` or NULL (it is)."""
    t = normalize(text)
    return F.when(t == "", "blank").when(token_estimate(t) > EMBED_MAX_TOKENS, "long")


def embeddable(text: Column) -> Column:
    """Same rule as a predicate.  Blank is tested on the original: both forms are blank together."""
    return ~is_blank(text) & (token_estimate(normalize(text)) <= EMBED_MAX_TOKENS)
