"""Scalar functions as Column expressions: all JVM-side, inside whole-stage codegen, no Python UDF."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters cut and width kept by the text helpers.
TEXT_LIMIT = 800            # characters of text sent to the embedder
SENTENCE_LIMIT = 140        # characters of a one-line description
MISSING_AGE_HOURS = 9999.0  # age reported when the finished time is unknown

_LATIN_RANGES = ((0x00C0, 0x024F), (0x1E00, 0x1EFF))


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(SRC, DST) for ``translate``: every precomposed Latin letter whose canonical decomposition is one base
    letter plus combining marks, mapped to that base letter. Built from the Unicode database by rule."""
    src, dst = [], []
    for lo, hi in _LATIN_RANGES:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            d = unicodedata.normalize("NFD", ch)
            if len(d) > 1 and d[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in d[1:]):
                src.append(ch)
                dst.append(d[0])
    return "".join(src), "".join(dst)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_accents(col: Column | str) -> Column:
    """NFD fold + drop combining marks + lower case (null → empty string, as the reference's ``s or ''``)."""
    src, dst = accent_table()
    folded = F.regexp_replace(F.translate(F.coalesce(_c(col), F.lit("")), src, dst), r"\p{Mn}+", "")
    return F.lower(folded)


def event_root_id(col: Column | str) -> Column:
    """Text before the first ':' (whole text when there is none)."""
    return F.split_part(_c(col), F.lit(":"), F.lit(1))


def round_money(col: Column | str, digits: int = 2) -> Column:
    """Double → exact decimal → ``digits`` decimals, half away from zero."""
    return F.round(_c(col).cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})")


def truncate_text(col: Column | str, n: int = TEXT_LIMIT) -> Column:
    return F.substring(_c(col), 1, n)


def concat_search_text(*cols: Column | str) -> Column:
    """Blank-joined search document; nulls count as empty text so the spacing is kept."""
    return F.concat_ws(" ", *[F.coalesce(_c(c), F.lit("")) for c in cols])


def salted_hash(value: Column | str, salt: str | Column = "") -> Column:
    """sha-256 hex of salt + value (salt '' gives the plain token hash)."""
    s = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat(s, _c(value).cast("string")), 256)


def first_sentence(col: Column | str, limit: int = SENTENCE_LIMIT) -> Column:
    """Strip '*' and '`', trim, keep the first sentence (up to the first . ! ? followed by white space), cut to
    ``limit`` characters, and turn '|' into '/' so the text fits a table cell."""
    t = F.regexp_replace(F.regexp_replace(_c(col), r"[*`]", ""), r"^\s+|\s+$", "")
    head = F.regexp_extract(t, r"(?s)^(.*?[.!?])\s", 1)
    first = F.when(head == "", t).otherwise(head)
    return F.replace(F.substring(first, 1, limit), F.lit("|"), F.lit("/"))


def _epoch_seconds(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp")) / F.lit(1_000_000.0)


def age_hours(ts: Column | str, now: str | Column) -> Column:
    """Hours from ``ts`` to ``now`` with one decimal; unknown time → 9999."""
    now_c = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    hours = (_epoch_seconds(now_c) - _epoch_seconds(_c(ts))) / F.lit(3600.0)
    return F.coalesce(F.round(hours, 1), F.lit(MISSING_AGE_HOURS))


def pct_used(used: Column | str, total: Column | str, digits: int = 1) -> Column:
    """100·used/total rounded; null when the total is 0 or missing."""
    return F.round(F.try_divide(F.lit(100.0) * _c(used), _c(total).cast("double")), digits)


def json_path(col: Column | str, path: str, default=None) -> Column:
    """Value at a JSON path as text, ``default`` when absent."""
    v = F.get_json_object(_c(col), path)
    return v if default is None else F.coalesce(v, F.lit(default))
