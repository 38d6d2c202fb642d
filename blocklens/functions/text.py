"""Column functions for log lines: headers, block ids, masks, tokens, parameters."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from blocklens import config as C

# Stands in for the delimiter inside block ids while the rest of a line is split.
_KEEP = "\u0001"


def is_blank(line: Column) -> Column:
    return line.rlike(r"^\s*$")


def matches_line_format(line: Column) -> Column:
    return line.rlike(C.LINE_FORMAT)


def has_header(line: Column) -> Column:
    return line.rlike(C.HEADER)


def header_parts(line: Column) -> Column:
    """A line that has a header, cut once into date, time, pid, level and the rest."""
    return F.split(line, r"\s+", 5)


def header_columns(parts: Column, line: Column) -> dict:
    """The header fields and the raw timestamp text from ``header_parts``.

    The component ends at the first colon of the rest, so the header expression is not
    evaluated again for every field (only when blanks alone stand before the colon).
    """
    # Filters on these fields may run before the header filter: no element may be required.
    date, time, pid, level, rest = (F.get(parts, i) for i in range(5))
    component = F.substring_index(rest, ":", 1)
    after = F.substring(rest, F.length(component) + 2, F.length(rest))
    return {
        "date": date,
        "time": time,
        "pid": pid,
        "level": level,
        "component": F.when(component == "", F.regexp_extract(line, C.HEADER, 5)).otherwise(component),
        "content": F.ltrim(after, F.lit(" \t\n\x0b\f\r")),
        "ts_raw": F.concat(date, time),
    }


def first_block_id(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, C.BLOCK_ID, 0), F.lit(""))


def all_block_ids(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(C.BLOCK_ID), F.lit(0)))


def parse_timestamp(ts_raw: Column, pivot_year: int | None = None) -> Column:
    """Text ``yyMMddHHmmss`` to a timestamp, NULL when invalid.

    Two-digit years are read as 20xx; with ``pivot_year`` (69 in most tools) years from
    there on are read as 19xx.
    """
    ts = F.try_to_timestamp(ts_raw, F.lit("yyMMddHHmmss"))
    if pivot_year is None:
        return ts
    old = F.year(ts) % 100 >= pivot_year
    return F.when(old, ts - F.make_interval(years=F.lit(100))).otherwise(ts)


def decode_line(raw: Column) -> Column:
    """Valid UTF-8 as it is, anything else read as Latin-1, decided line by line."""
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1"))


def mask(content: Column) -> Column:
    return reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), C.MASKS, content)


def _split(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, C.EXTRA_DELIMITER, " ")), r"\s+")


def tokens(content: Column) -> Column:
    return _split(mask(content))


def signature(content: Column) -> Column:
    """Masked tokens with digit-bearing ones replaced by the wildcard."""
    wild = F.lit(C.WILDCARD)
    return F.transform(tokens(content), lambda t: F.when(t.rlike(r"\d"), wild).otherwise(t))


def signature_text(content: Column) -> Column:
    """The tokens of ``signature`` joined by blanks, without taking them apart.

    A match starts where a token does and never looks back, so a token without a digit costs
    its length, however long it is.
    """
    spaced = F.trim(F.regexp_replace(mask(content), C.EXTRA_DELIMITER, " "))
    return F.regexp_replace(F.regexp_replace(spaced, r"\s+", " "), r"(?<!\S)[^\s\d]*+\d\S*+", C.WILDCARD)


def raw_tokens(content: Column) -> Column:
    """Unmasked text split exactly where ``tokens`` splits the masked text."""
    kept = F.regexp_replace(content, r"blk_(-?\d+)", f"blk{_KEEP}$1")
    return F.transform(_split(kept), lambda t: F.replace(t, F.lit(_KEEP), F.lit(C.EXTRA_DELIMITER)))


def parameters(content: Column, template_tokens: Column) -> Column:
    """Values behind the masks and wildcards of a template, left to right."""
    any_mask = F.lit("|".join(f"(?:{rx})" for rx, _ in C.MASKS))
    masked = "|".join(name for _, name in C.MASKS)
    none = F.array().cast("array<string>")
    values = F.zip_with(
        raw_tokens(content),
        template_tokens,
        lambda raw, t: F.when(t == C.WILDCARD, F.array(raw))
        .when(t.rlike(masked), F.regexp_extract_all(raw, any_mask, F.lit(0)))
        .otherwise(none),
    )
    return F.flatten(values)
