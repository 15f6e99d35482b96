"""Text predicates: whitespace, token matching with veto, code normalising."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squeeze(text) -> Column:
    """B1: runs of whitespace to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def token_pattern(tokens: Iterable[str]) -> str:
    """One case-insensitive alternation anchored at a word start."""
    alternatives = "|".join(tokens)
    if not alternatives:
        raise ValueError("a token section is empty; refusing to build a pattern that matches everything")
    return rf"(?i)\b(?:{alternatives})"


@dataclass(frozen=True)
class TokenLists:
    """The private list's three sections. A missing section is an error, never an empty match."""

    firm: tuple[str, ...]
    not_firm: tuple[str, ...]
    brand: tuple[str, ...]

    @classmethod
    def from_sections(cls, sections: dict[str, list[str]]) -> "TokenLists":
        return cls(
            tuple(sections["firm_tokens"]), tuple(sections["not_firm_tokens"]), tuple(sections["brand_tokens"])
        )


def first_token(text, pattern: str) -> Column:
    """The matched token in lower case, or null."""
    hit = F.lower(F.regexp_extract(squeeze(text), pattern, 0))
    return F.nullif(hit, F.lit(""))


def firm_token(text, lists: TokenLists) -> Column:
    """B2: a firm token unless the same value also matches the veto pattern."""
    vetoed = squeeze(text).rlike(token_pattern(lists.not_firm))
    return F.when(~vetoed, first_token(text, token_pattern(lists.firm)))


def brand_token(text, lists: TokenLists) -> Column:
    return first_token(text, token_pattern(lists.brand))


def normal_code(code) -> Column:
    """Trimmed, without surrounding dashes, upper case."""
    return F.upper(F.regexp_replace(F.trim(_c(code)), "^-+|-+$", ""))


def sorted_distinct(values) -> Column:
    """B11 as an array: non-empty values, distinct, sorted."""
    kept = F.array_remove(F.array_compact(_c(values)), "")
    return F.coalesce(F.sort_array(F.array_distinct(kept)), F.array().cast("array<string>"))


def present(df, name: str) -> Column:
    """True where a key column holds something: not null, and not blank when it is text."""
    c = F.col(name)
    return c.isNotNull() & (c != "") if dict(df.dtypes)[name] == "string" else c.isNotNull()


def joined(values, sep: str = "|") -> Column:
    """Sorted distinct non-empty values joined to one string."""
    return F.array_join(sorted_distinct(values), sep)


def mark_absent_code(codes, queried) -> Column:
    """Append ``code?`` when the queried code is not among the record's own codes."""
    own, q = _c(codes), _c(queried)
    return F.when(F.array_contains(own, q), own).otherwise(F.array_append(own, F.concat(q, F.lit("?"))))


def mentions(text, needle: str = "recall") -> Column:
    """Case-insensitive substring test."""
    return F.coalesce(F.lower(_c(text)).contains(needle.lower()), F.lit(False))


def cites_reports(text) -> Column:
    """Only the flag leaves the row, never the text."""
    return F.coalesce(_c(text).rlike(r"(?i)\b(?:reports?|complaints?)\b"), F.lit(False))


def blank_label(value) -> Column:
    return F.coalesce(F.nullif(_c(value), F.lit("")), F.lit("blank"))


def safe_int(text) -> Column:
    """B16."""
    return _c(text).try_cast("int")
