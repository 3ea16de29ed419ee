"""Text functions: comparison with missing, search, edit, split, numbers, regular expressions.

Missing text is NULL.  White space is the Unicode kind, not only the space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import NAN, col

_WS = r"[\s\p{Z}\x{85}]"


def _lit(p) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


def _quote(p: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c.isspace()) else c for c in p)


def strcmp(a, b) -> Column:
    return F.coalesce(col(a) == _lit(b), F.lit(False))


def strcmpi(a, b) -> Column:
    return F.coalesce(F.lower(col(a)) == F.lower(_lit(b)), F.lit(False))


def strncmp(a, b, n: int) -> Column:
    a, b = col(a), _lit(b)
    long = (F.length(a) >= n) & (F.length(b) >= n)
    return F.coalesce(long & (F.substring(a, 1, n) == F.substring(b, 1, n)), F.lit(False))


def strncmpi(a, b, n: int) -> Column:
    return strncmp(F.lower(col(a)), F.lower(_lit(b)), n)


def strlength(a) -> Column:
    """Code points as a double; NaN for missing."""
    return F.coalesce(F.length(col(a)).cast("double"), F.lit(NAN))


def contains(a, *patterns: str, ignore_case: bool = False) -> Column:
    s = F.lower(col(a)) if ignore_case else col(a)
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(s, F.lit(p.lower() if ignore_case else p))
    return F.coalesce(out, F.lit(False))


def starts_with(a, *patterns: str, ignore_case: bool = False) -> Column:
    s = F.lower(col(a)) if ignore_case else col(a)
    out = F.lit(False)
    for p in patterns:
        out = out | F.startswith(s, F.lit(p.lower() if ignore_case else p))
    return F.coalesce(out, F.lit(False))


def ends_with(a, *patterns: str, ignore_case: bool = False) -> Column:
    s = F.lower(col(a)) if ignore_case else col(a)
    out = F.lit(False)
    for p in patterns:
        out = out | F.endswith(s, F.lit(p.lower() if ignore_case else p))
    return F.coalesce(out, F.lit(False))


def matches(a, *patterns: str, ignore_case: bool = False) -> Column:
    s = F.lower(col(a)) if ignore_case else col(a)
    return F.coalesce(s.isin([p.lower() if ignore_case else p for p in patterns]), F.lit(False))


def strfind(a, p: str) -> Column:
    """1-based starts of all occurrences, overlapping ones too."""
    s = col(a)
    ends = F.greatest(F.length(s) - len(p) + 1, F.lit(0))
    at = F.filter(F.sequence(F.lit(1), F.greatest(ends, F.lit(1))), lambda i: (i <= ends) & (F.substring(s, i, F.lit(len(p))) == p))
    return F.when(F.contains(s, F.lit(p)) & (F.lit(len(p)) > 0), at).when(s.isNotNull(), F.array().cast("array<int>"))


def append(*parts) -> Column:
    return F.concat(*[col(p) for p in parts])


def strcat(*parts) -> Column:
    """Concatenation; each part loses trailing white space."""
    return F.concat(*[deblank(p) for p in parts])


def reverse(a) -> Column:
    return F.reverse(col(a))


def deblank(a) -> Column:
    return F.regexp_replace(col(a), f"(?:{_WS}|\\x00)+$", "")


def strtrim(a) -> Column:
    return F.regexp_replace(col(a), f"^(?:{_WS}|\\x00)+|(?:{_WS}|\\x00)+$", "")


def strip(a, side: str = "both", chars: str | None = None) -> Column:
    cls = _WS if chars is None else "[" + _quote(chars) + "]"
    left, right = f"^{cls}+", f"{cls}+$"
    return F.regexp_replace(col(a), {"left": left, "right": right, "both": f"{left}|{right}"}[side], "")


def pad(a, n: int, side: str = "right", char: str = " ") -> Column:
    s = col(a)
    gap = F.greatest(F.lit(n) - F.length(s), F.lit(0))
    if side == "both":
        return F.concat(F.repeat(F.lit(char), F.floor(gap / 2).cast("int")), s, F.repeat(F.lit(char), F.ceil(gap / 2).cast("int")))
    fill = F.repeat(F.lit(char), gap)
    return F.concat(fill, s) if side == "left" else F.concat(s, fill)


def strjust(a, n: int, side: str = "right") -> Column:
    """Text of width n justified right, left or center."""
    s = strtrim(a)
    return pad(s, n, {"right": "left", "left": "right", "center": "both"}[side])


def lower(a) -> Column:
    return F.lower(col(a))


def upper(a) -> Column:
    return F.upper(col(a))


def replace(a, *pairs: tuple[str, str]) -> Column:
    out = col(a)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new)) if old else out
    return out


def strrep(a, old: str, new: str) -> Column:
    """Literal replacement; an empty pattern inserts the text around every character."""
    if old:
        return F.replace(col(a), F.lit(old), F.lit(new))
    return F.regexp_replace(col(a), F.lit("(?=)"), F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))


def erase(a, *patterns: str) -> Column:
    return replace(a, *[(p, "") for p in patterns])


def erase_urls(a) -> Column:
    return F.regexp_replace(col(a), r"(?i)\b(?:https?://|ftp://|www\.)[^\s<>\"']+", "")


def erase_punctuation(a) -> Column:
    return F.regexp_replace(col(a), r"[\p{P}\p{S}]", "")


def split(a, delimiter: str = " ") -> Column:
    return F.split(col(a), _quote(delimiter), -1)


def splitlines(a) -> Column:
    return F.split(col(a), r"\r\n|\n|\r", -1)


def join(parts: Column, delimiter: str = " ") -> Column:
    """Array elements joined; missing if any is missing."""
    return F.when(F.exists(parts, lambda x: x.isNull()), F.lit(None).cast("string")).otherwise(F.array_join(parts, delimiter))


def strjoin(parts: Column, delimiter: str = " ") -> Column:
    return F.array_join(parts, delimiter)


def _at(s: Column, p) -> Column:
    """1-based place of a pattern, or the position itself; NULL if absent."""
    if isinstance(p, int):
        return F.when((F.length(s) >= p) & (F.lit(p) > 0), F.lit(p))
    k = F.instr(s, p)
    return F.when(k > 0, k)


def extract_before(a, p) -> Column:
    """Text before a pattern or position; missing if it is not there."""
    s = col(a)
    return F.substring(s, F.lit(1), _at(s, p) - 1)


def extract_after(a, p) -> Column:
    s = col(a)
    n = 1 if isinstance(p, int) else len(p)
    return F.substring(s, _at(s, p) + n, F.length(s))


def extract_between(a, start: str, end: str) -> Column:
    """All texts between the delimiters, shortest first."""
    return F.regexp_extract_all(col(a), F.lit(f"(?s){_quote(start)}(.*?){_quote(end)}"), F.lit(1))


def erase_between(a, start: str, end: str) -> Column:
    return F.regexp_replace(col(a), f"(?s)({_quote(start)}).*?({_quote(end)})", "$1$2")


def replace_between(a, start: str, end: str, new: str) -> Column:
    safe = new.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col(a), f"(?s)({_quote(start)}).*?({_quote(end)})", f"$1{safe}$2")


def insert_before(a, p, new: str) -> Column:
    s = col(a)
    if isinstance(p, int):
        return F.concat(F.substring(s, 1, p - 1), F.lit(new), F.substring(s, F.lit(p), F.length(s)))
    return F.replace(s, F.lit(p), F.lit(new + p))


def insert_after(a, p, new: str) -> Column:
    s = col(a)
    if isinstance(p, int):
        return F.concat(F.substring(s, 1, p), F.lit(new), F.substring(s, F.lit(p + 1), F.length(s)))
    return F.replace(s, F.lit(p), F.lit(p + new))


# Numbers and formats -----------------------------------------------------------------------------


def str2double(a) -> Column:
    """A number, with d exponents, thousands commas and Inf; NaN for anything else."""
    s = F.lower(strtrim(a))
    s = F.regexp_replace(F.regexp_replace(s, ",", ""), r"^([+-]?[0-9.]+)d([+-]?[0-9]+)$", "$1e$2")
    s = F.regexp_replace(s, r"^([+-]?)inf(?:inity)?$", "$1Infinity")
    ok = s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?$|^[+-]?Infinity$")
    return F.coalesce(F.when(ok, F.when(s == "+Infinity", F.lit(float("inf"))).otherwise(s.try_cast("double"))), F.lit(NAN))


def int2str(x) -> Column:
    x = col(x).cast("double")
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("bigint").cast("string")


def num2str(x, digits: int = 4) -> Column:
    """Fixed decimals with trailing zeros gone."""
    s = F.format_string(f"%.{digits}f", col(x).cast("double"))
    return F.when(F.isnan(col(x).cast("double")), "NaN").otherwise(F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))


def sprintf(fmt: str, *args) -> Column:
    return F.format_string(fmt, *[col(a) for a in args])


compose = sprintf


def string(x) -> Column:
    return col(x).cast("string")


def char(codes: Column) -> Column:
    """Code points to text."""
    return F.array_join(F.transform(codes, lambda c: F.char(c)), "")


def cellstr(parts: Column) -> Column:
    return F.transform(parts, deblank)


def strings_(n: int) -> Column:
    return F.array_repeat(F.lit(""), n)


def unicode2native(a, charset: str = "UTF-8") -> Column:
    return F.encode(col(a), charset)


def valid_name(a) -> Column:
    """A valid identifier made of any text."""
    s = F.regexp_replace(strtrim(a), r"[^A-Za-z0-9_]+", "_")
    return F.when(s.rlike("^[A-Za-z]"), s).otherwise(F.concat(F.lit("x"), s))


# Regular expressions -----------------------------------------------------------------------------


def regexp(a, pattern: str, what: str = "match", ignore_case: bool = False) -> Column:
    """One output of a search: match (all), tokens (first group of all), once, start (1-based), split, count, has."""
    s, p = col(a), ("(?i)" if ignore_case else "") + pattern
    found, gaps = F.regexp_extract_all(s, F.lit(p), F.lit(0)), F.split(s, p, -1)
    if what == "match":
        return found
    if what == "tokens":
        return F.regexp_extract_all(s, F.lit(p), F.lit(1))
    if what == "once":
        return F.regexp_substr(s, F.lit(p))
    if what == "split":
        return gaps
    if what == "count":
        return F.size(found)
    if what == "has":
        return s.rlike(p)
    size = F.transform(found, lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("g"), F.length(v).alias("n")))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x["g"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["g"])).alias("out"))
    return F.aggregate(size, zero, step, lambda acc: acc["out"])


def regexpi(a, pattern: str, what: str = "match") -> Column:
    return regexp(a, pattern, what, ignore_case=True)


def regexprep(a, pattern: str, new: str) -> Column:
    return F.regexp_replace(col(a), pattern, new)


def named_tokens(a, pattern: str) -> Column:
    """Named groups of the first match as a struct."""
    import re

    names = list(re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groupindex.items())
    return F.struct(*[F.regexp_extract(col(a), pattern, i).alias(n) for n, i in names])


def urlencode(a) -> Column:
    return F.url_encode(col(a))


def urldecode(a) -> Column:
    return F.url_decode(col(a))


def fullfile(*parts) -> Column:
    return F.regexp_replace(F.concat_ws("/", *[col(p) for p in parts]), "/{2,}", "/")


def jsondecode(a, schema: str | None = None) -> Column:
    """Text to a VARIANT, or to the given schema."""
    return F.parse_json(col(a)) if schema is None else F.from_json(col(a), schema)


def jsonencode(x) -> Column:
    return F.to_json(col(x))
