"""Text column functions. Blank means Unicode white space plus U+001C..U+001F; line ends are ``\\n`` only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f]"
# The same characters as a string, for trimming without a regular expression.
BLANK_CHARS = "".join(
    chr(c)
    for first, last in [
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    ]
    for c in range(first, last + 1)
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps costly inputs out of lambda loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANK_CHARS))


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def normalize_newlines(c: Column) -> Column:
    single = F.when(F.contains(c, F.lit("\n\n")), F.regexp_replace(c, r"\n\n+", "\n")).otherwise(c)
    return strip(single)


def split_sections(c: Column) -> Column:
    return F.split(strip(c), rf"(?U)\n{BLANK}*\n+")


def section_title(c: Column) -> Column:
    return rstrip(F.regexp_extract(c, rf"(?U)\A(第{BLANK}*\d+{BLANK}*条[^\n]*)", 1))


def section_content(c: Column, title: Column) -> Column:
    return strip(c.substr(F.char_length(title) + 1, F.char_length(c)))


def format_chunk(title: Column, content: Column) -> Column:
    return F.when(title != "", F.concat(title, F.lit(":\n"), content)).otherwise(content)


def document_chunks(text: Column, collapse: bool = True) -> Column:
    """All chunks of one text, in order, as ``array<string>``.

    With ``collapse`` newline runs become one newline before sections are split, so only lines that
    hold white space separate sections; without it empty lines separate them too.
    """
    sections = split_sections(normalize_newlines(text) if collapse else text)
    titled = F.transform(sections, lambda s: F.struct(s.alias("section"), section_title(s).alias("title")))
    parts = F.transform(
        titled,
        lambda x: F.struct(x["title"].alias("title"), section_content(x["section"], x["title"]).alias("content")),
    )
    return F.transform(
        F.filter(parts, lambda p: p["content"] != ""), lambda p: format_chunk(p["title"], p["content"])
    )


def truncate_text(c: Column, size: int) -> Column:
    return F.when(F.char_length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null nor empty; the last one is returned as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/]*\z", 0)


def has_suffix(c: Column, suffix: str) -> Column:
    return F.lower(c).endswith(suffix.lower())


# Scripts without blanks between words; the long vowel marks belong to Katakana. All their signs lie from U+2E80 on, and a range is
# far quicker to look for than a script, so it stands guard before every script.
HAN, HIRAGANA, KATAKANA = r"\p{IsHan}", r"\p{IsHiragana}", r"\p{IsKatakana}ーｰ"
UNSPACED = f"[{HAN}{HIRAGANA}{KATAKANA}]"
_HIGH = r"[^\x00-\u2e7f]"
_SPACED = rf"[[\p{{L}}&&[\x00-\u2e7f]][\p{{L}}&&{_HIGH}&&[^{HAN}{HIRAGANA}{KATAKANA}]]]"
# Each match looks ahead for the word that begins here and moves on by one letter of an unspaced script or by a whole other word.
_PAIRS = "|".join(f"[{s}]{{2}}|(?<![{s}])[{s}](?![{s}])" for s in (HAN, HIRAGANA, KATAKANA))
MIXED_WORDS = rf"(?=((?={_HIGH})(?:{_PAIRS})|{_SPACED}++))(?:(?={_HIGH}){UNSPACED}|\1)"


def words(c: Column) -> Column:
    """Lower-cased words: runs of letters, cut where the script changes to or from Han, Hiragana or Katakana.

    Runs of these three give their overlapping pairs of letters, a single letter itself, since no blank tells their words apart.
    """
    low = F.lower(c)
    mixed = F.regexp_extract_all(low, F.lit(MIXED_WORDS), F.lit(1))
    plain = F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))
    return F.when(low.rlike(_HIGH) & low.rlike(UNSPACED), mixed).otherwise(plain)


def distinct_words(c: Column) -> Column:
    return F.array_distinct(words(c))


def sentences(c: Column) -> Column:
    """Non-blank sentences: up to and including an end mark, or up to a line end."""
    found = F.regexp_extract_all(c, F.lit(r"[^.!?。！？\n]+[.!?。！？]*"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")
