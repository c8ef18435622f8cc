"""Text as column expressions: code fences, cleaning, tokens, prices, retries."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]"
#: What Python's str.split and str.strip call blank.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same as characters.
BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
EDGES = " \t\n\r" + "-–—" + "".join(chr(c) for c in range(33, 127) if chr(c) in "!'(),.:;<>?[]`{}" or c == 34)


def strip_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{BLANK}+", " ")


def strip_fences(c: Column) -> Column:
    """Text without its Markdown fence lines, if it begins with one; otherwise only stripped."""
    body = strip_blank(c)
    kept = F.filter(F.split(body, "\n"), lambda x: ~F.startswith(strip_blank(x), F.lit("```")))
    return F.when(F.startswith(body, F.lit("```")), F.array_join(kept, "\n")).otherwise(body)


def sanitize(c: Column, longest: int = 200) -> Column:
    """A value fit for a prompt: no control characters, single spaces, cut with dots."""
    plain = F.trim(collapse(F.regexp_replace(c, CONTROL, " ")))
    return F.when(F.length(plain) > longest, F.concat(F.substring(plain, 1, longest), F.lit("..."))).otherwise(plain)


def truncate(c: Column, limit: int, mark: str = "") -> Column:
    """The first ``limit`` characters (all for 0 or less), with ``mark`` behind if any were cut."""
    if limit <= 0:
        return c
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def tokens(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.coalesce(F.length(c), F.lit(0)) / 4).cast("bigint")


def message_tokens(content: Column, role: Column) -> Column:
    return tokens(content) + tokens(role) + 4


def attempt_confidence(attempt: Column) -> Column:
    """1.0 at the first attempt, 0.3 less for each further one, 0.1 at least."""
    return F.round(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.3) * attempt), 2)


def or_default(c: Column, default: Column | str) -> Column:
    """``c``, unless it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def document_label(source: Column, doc_id: Column) -> Column:
    return or_default(source, or_default(doc_id, "unknown"))


@F.udf(T.StringType(), useArrow=False)
def nfkc(value: str | None) -> str | None:
    """Unicode compatibility composition, which Spark has no function for; some rows at a time go to Python, so long texts don't pile up."""
    return value if value is None or value.isascii() else unicodedata.normalize("NFKC", value)


def folded(c: Column, ascii_only: bool = False) -> Column:
    """Text for loose comparison: composed, blanks collapsed, lower case."""
    return F.lower(collapse(c if ascii_only else nfkc(c)))
