"""Text expressions whose results agree with Python's str methods (Unicode white space included)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what Python's \s matches, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def blank_null(c) -> Column:
    """Null to the empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def strip(c) -> Column:
    """Without white space at both ends, as str.strip()."""
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+$", "")


def clean(c) -> Column:
    """Null to empty, then stripped."""
    return strip(blank_null(c))


def collapse(c, to: str = " ") -> Column:
    """Runs of white space become one separator, none at the ends."""
    joined = F.regexp_replace(blank_null(c), f"{SPACE}+", to)
    return F.btrim(joined, F.lit(to)) if len(to) == 1 and to.isspace() else strip(joined)  # no other white space is left


def squeeze(c, also: str = r"\p{P}") -> Column:
    """Without any white space or punctuation."""
    return F.regexp_replace(F.regexp_replace(blank_null(c), f"{SPACE}+", ""), f"[{also}]", "")


def literal_count(c, term: str) -> Column:
    """Non-overlapping occurrences of term, as str.count(); an empty term counts 0."""
    if not term:
        return F.lit(0).cast("bigint")
    c = _col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("bigint")


def count_terms(c, terms: list[str]) -> Column:
    """Sum of literal counts; nested terms each count."""
    total = F.lit(0).cast("bigint")
    for t in terms:
        total = total + literal_count(c, t)
    return total


def matched_terms(c, terms: list[str]) -> Column:
    """Array of the terms that occur, in the given order."""
    c = _col(c)
    return F.array_compact(F.array(*(F.when(F.contains(c, F.lit(t)), F.lit(t)) for t in terms))) if terms else F.array().cast("array<string>")


def alternation(terms: list[str]) -> str:
    """A regular expression that matches the longest term first (ties: alphabetical)."""
    return "|".join("\\Q" + t + "\\E" for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def tokens(c, terms: list[str]) -> Column:
    """Non-overlapping leftmost matches of the terms, longest first."""
    return F.regexp_extract_all(_col(c), F.lit(f"({alternation(terms)})"), F.lit(1))


def first_prefix(c, prefixes: list[tuple[str, str]], otherwise: str = "") -> Column:
    """The value of the first prefix in the list that the text starts with."""
    c = _col(c)
    out = F.lit(otherwise)
    for prefix, value in reversed(prefixes):
        out = F.when(F.startswith(c, F.lit(prefix)), F.lit(value)).otherwise(out)
    return out


def stable_id(c, prefix: str = "", chars: int = 16) -> Column:
    """Prefix and the first hexadecimal digits of the SHA-256 of the stripped text (null counts as empty)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(clean(c).cast("binary"), 256), 1, chars))


def stable_id_sha1(c, prefix: str = "", chars: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(clean(c).cast("binary")), 1, chars))


def text_hash(c) -> Column:
    """SHA-256 of the text with white space collapsed."""
    return F.sha2(collapse(c).cast("binary"), 256)


def safe_name(c, chars: int = 120) -> Column:
    """Letters, digits and underscores only; at most that many characters, no underscore at the ends."""
    return F.substring(F.regexp_replace(F.regexp_replace(blank_null(c), "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""), 1, chars)


def year_in(c) -> Column:
    """The first four digits in a row, as a number."""
    return F.regexp_extract(_col(c), r"(\d{4})", 1).try_cast("int")


def truthy(c) -> Column:
    """True for true, 1, yes, y in any case; else false."""
    return F.coalesce(F.lower(strip(_col(c).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def split_trim(c, separator: str) -> Column:
    """Parts between a literal separator, stripped, empty ones dropped."""
    parts = F.split(blank_null(c), "\\Q" + separator + "\\E", -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def join_nonblank(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, in order."""
    return F.concat_ws(separator, *(F.when(p != "", p) for p in parts))


def chinese_date(c) -> Column:
    """Year, month and day signs to an ISO date; null where there is none."""
    found = F.regexp_extract(blank_null(c), "([0-9]{4})[年/.\\-]([0-9]{1,2})[月/.\\-]([0-9]{1,2})", 0)
    return F.regexp_replace(F.regexp_replace(found, "[年月/.]", "-"), "日", "").try_cast("date")


def escape(term: str) -> str:
    """A term as a literal for Java and RE2 patterns."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def origin(c, segments: int = 0) -> Column:
    """Scheme and host of a URL, and its first path segments."""
    c = _col(c)
    base = F.concat(F.try_parse_url(c, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(c, F.lit("HOST")))
    if not segments:
        return base
    path = F.filter(F.split(F.try_parse_url(c, F.lit("PATH")), "/"), lambda x: x != "")
    return F.concat_ws("/", base, F.array_join(F.slice(path, 1, segments), "/"))
