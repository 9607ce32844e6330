"""Text expressions: cleaning, structure, term matching and match positions.

Every function takes Columns and returns a Column of built-in Spark expressions.  Patterns get
``(?U)`` so that word, digit and space classes are Unicode, as they are in the source rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import fixed_values as fixed

_META = set(r"\.^$|?*+()[]{}")


def java_pattern(pattern: str, flags: str = "") -> str:
    return f"(?U{flags}){pattern}"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` knows blanks only)."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def raw_text(title: Column, body: Column) -> Column:
    return strip(F.concat(title, F.lit("\n\n"), F.coalesce(body, F.lit(""))))


def extract_tag(title: Column) -> Column:
    """Lower-case label in square or round brackets at the start of the title, else null."""
    label = F.regexp_extract(title, java_pattern(fixed.TITLE_TAG_PATTERN), 1)
    return F.when(label != "", F.lower(strip(label)))


def has_email(text: Column) -> Column:
    # The literal test spares most texts the backtracking of the mailbox pattern.
    return F.when(
        F.contains(text, F.lit("@")), text.rlike(java_pattern(fixed.EMAIL_PATTERN))
    ).otherwise(F.lit(False))


def struct_features(text: Column, has_body: Column) -> Column:
    """Size and shape of the raw text as one struct."""
    # A run from the first visible character of a line to its end: one per non-empty line.
    visible_line = java_pattern(r"\S[^\n]*")
    first_line = F.regexp_extract(text, visible_line, 0)
    return F.struct(
        F.length(text).alias("length"),
        F.regexp_count(text, F.lit(visible_line)).alias("line_count"),
        F.regexp_count(text, F.lit(java_pattern(fixed.BULLET_PATTERN, "md"))).alias(
            "bullet_line_count"
        ),
        (F.contains(text, F.lit("http")) & text.rlike(java_pattern(fixed.URL_PATTERN))).alias(
            "has_links"
        ),
        has_email(text).alias("has_email"),
        has_body.alias("has_body"),
        F.endswith(strip(first_line), F.lit("?")).alias("title_is_question"),
    )


def single_blanks(text: Column) -> Column:
    """Each run of blanks and tabs becomes one blank; lone blanks are left untouched."""
    return F.regexp_replace(text, r"[ \t]{2,}|\t", " ")


def normalize_text(text: Column) -> Column:
    plain = F.lower(F.regexp_replace(text, f"[{fixed.MARKDOWN_CHARS}]", ""))
    plain = single_blanks(plain)
    return strip(F.regexp_replace(plain, r"\n{3,}", "\n\n"))


def headline(title: Column, size: int = fixed.HEADLINE_CHARS) -> Column:
    return F.substring(strip(title), 1, size)


def alternation(terms: Iterable[str]) -> str | None:
    """One word-bounded pattern for all terms, longest first; None without terms.

    A look at the first character comes before the Unicode word boundary, which costs many times as
    much and would be worked out at every character of a text.
    """
    terms = list(terms)
    escaped = ["".join("\\" + ch if ch in _META else ch for ch in term) for term in terms]
    if not escaped:
        return None
    firsts = "".join("\\" + ch if ch in _META or ch in "-&" else ch for ch in sorted({t[:1] for t in terms}))
    ahead = f"(?=[{firsts}])" if all(terms) else ""
    return ahead + r"\b(?:" + "|".join(sorted(escaped, key=len, reverse=True)) + r")\b"


def literal_map(entries: Mapping, value_type: str) -> Column:
    pairs = [F.lit(x) for entry in entries.items() for x in entry]
    return F.create_map(*pairs).cast(f"map<string,{value_type}>")


def apply_aliases(text: Column, aliases: Mapping[str, str]) -> Column:
    """Replace every alias in one pass, so that a replacement is never matched again."""
    pattern = alternation(aliases)
    if pattern is None:
        return text
    found = F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))
    between = F.split(text, java_pattern(pattern), -1)
    table = literal_map(aliases, "string")
    pieces = F.zip_with(
        between,
        found,
        lambda gap, term: F.concat(
            gap, F.coalesce(F.try_element_at(table, term), term, F.lit(""))
        ),
    )
    return F.when(text.rlike(java_pattern(pattern)), F.array_join(pieces, "")).otherwise(text)


def matched_terms(text: Column, pattern: str | None) -> Column:
    """Distinct matches in order of first occurrence."""
    if pattern is None:
        return F.array().cast("array<string>")
    return F.array_distinct(
        F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))
    )


def starts_within(text: Column, pattern: str | None, chars: int) -> Column:
    """Whether a match starts before character ``chars``; reads no more than it must."""
    if pattern is None:
        return F.lit(False)
    return text.rlike(java_pattern(rf"\A.{{0,{chars - 1}}}?{pattern}", "s"))


def match_positions(text: Column, pattern: str | None) -> Column:
    """Start of every match, in code points from 0.

    Built from the lengths of the text between matches, because ``regexp_instr`` counts UTF-16
    units.
    """
    if pattern is None:
        return F.array().cast("array<int>")
    gaps = F.split(text, java_pattern(pattern), -1)
    found = F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["gap"])
        return F.struct(
            (begin + F.coalesce(F.length(piece["term"]), F.lit(0))).alias("at"),
            F.when(piece["term"].isNull(), state["starts"])
            .otherwise(F.array_append(state["starts"], begin))
            .alias("starts"),
        )

    pieces = F.zip_with(
        gaps, found, lambda gap, term: F.struct(gap.alias("gap"), term.alias("term"))
    )
    return F.aggregate(pieces, start, step, lambda state: state["starts"])


def token_index(text: Column, position: Column) -> Column:
    """Index of the blank-separated token that holds or precedes a character position."""
    begun = F.regexp_count(
        F.substring(text, F.lit(1), position + 1), F.lit(java_pattern(r"\S+"))
    )
    return F.when(position.isNotNull(), F.greatest(begun - 1, F.lit(0)))


def near(text: Column, a: Column, b: Column, window: int) -> Column:
    """Whether the tokens at two character positions are at most ``window`` tokens apart.

    From a visible character on, only the next ``window`` tokens are read, not all of the text
    before either position.
    """
    between = F.substring(text, F.least(a, b) + 1, F.abs(a - b) + 1)
    beyond = java_pattern(rf"\A(?:\S++\s++){{{window + 1}}}+\S")
    visible = between.rlike(java_pattern(r"\A\S"))
    counted = F.abs(token_index(text, a) - token_index(text, b)) <= window
    return F.when(visible, ~between.rlike(beyond)).otherwise(counted)


def extract_body(html: Column, start: str | None = None, end: str | None = None) -> Column:
    """Text between the two sentinels as ``struct(body, has_body)``.

    ``start`` and ``end`` are patterns; without both sentinels the result is ('', false).
    """
    from gleaner.functions.entities import unescape_twice

    start = fixed.BODY_START_PATTERN if start is None else start
    end = fixed.BODY_END_PATTERN if end is None else end
    # Wrapped in a list so that an empty block still differs from a missing one.
    block = F.try_element_at(
        F.regexp_extract_all(html, F.lit(f"(?s){start}(.*?){end}"), F.lit(1)), F.lit(1)
    )
    body = F.regexp_replace(block, "<[^>]+>", " ")
    body = unescape_twice(body)
    body = single_blanks(body)
    body = strip(F.regexp_replace(body, r"\n{3,}", "\n\n"))
    return F.struct(
        F.coalesce(body, F.lit("")).alias("body"), block.isNotNull().alias("has_body")
    )
