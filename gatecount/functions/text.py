"""Titles, tags, markup and headlines as column expressions.

Spark has no accent stripping, so one ``translate`` table is derived here from
the Unicode data; the expression stays in generated code.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatecount import rules

# Spacing marks that Unicode counts as diacritics; they vanish, they do not split words.
SPACING_MARKS = "^`¨¯´·¸"


def _accent_table() -> tuple[str, str]:
    """Every precomposed letter of the basic plane whose decomposition is base + marks."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            if len(parts[0]) == 1 and ord(parts[0]) < 0x10000:
                source.append(char)
                target.append(parts[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    # translate() drops characters that have no counterpart: the spacing marks.
    plain = F.translate(text, _ACCENTED + SPACING_MARKS, _PLAIN)
    return F.regexp_replace(plain, r"\p{M}+", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\u00A0]+", " "))


def trim_all(text: Column) -> Column:
    """Trim blanks of every kind, no-break spaces too."""
    return F.regexp_replace(text, r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", "")


def normalize_title(title: Column, noise: tuple[str, ...] = rules.NOISE_PATTERNS) -> Column:
    """Accent-free, lower-case words without version and format noise."""
    text = F.lower(strip_accents(title))
    for pattern in noise:
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def tight_key(title: Column) -> Column:
    return F.replace(normalize_title(title), F.lit(" "), F.lit(""))


def identity(title: Column, original: Column) -> Column:
    """Struct of the keys one title is matched by; no key is ever empty.

    ``match_key`` prefers the original title, ``local_key`` always uses the local
    one, ``tight_key`` is the match key without word breaks.
    """
    local = trim_all(title)
    source = F.nullif(trim_all(original), F.lit(""))
    local_key = F.coalesce(F.nullif(normalize_title(local), F.lit("")), F.lower(local))
    match_key = F.coalesce(F.nullif(normalize_title(source), F.lit("")), local_key)
    return F.struct(
        match_key.alias("match_key"),
        F.replace(match_key, F.lit(" "), F.lit("")).alias("tight_key"),
        local_key.alias("local_key"),
        local.alias("title"),
        source.alias("original_title"),
    )


def normalize_formats(tags: Column, labels: dict[str, str] | None = None) -> Column:
    """Tags on the whitelist under their canonical name, once each, sorted."""
    table = F.create_map(*[F.lit(x) for kv in (labels or rules.FORMAT_LABELS).items() for x in kv])
    known = F.transform(tags, lambda t: F.try_element_at(table, F.lower(trim_all(t))))
    kept = F.sort_array(F.array_distinct(F.filter(known, lambda t: t.isNotNull())))
    return F.coalesce(kept, F.array().cast("array<string>"))


def format_label(formats: Column) -> Column:
    return F.when(F.size(formats) > 0, F.array_join(formats, " + ")).otherwise(F.lit(rules.DEFAULT_FORMAT))


def split_version(title: Column, words: tuple[str, ...] = rules.VERSION_WORDS) -> Column:
    """Struct(title, version): the trailing version word, taken off the title."""
    rest, version = trim_all(title), F.lit(None).cast("string")
    for word in reversed(words):
        pattern = rf"(?i)\s+{word}\s*$"
        hit = title.rlike(pattern)
        rest = F.when(hit, trim_all(F.regexp_replace(title, pattern, ""))).otherwise(rest)
        version = F.when(hit, F.lit(word)).otherwise(version)
    return F.struct(rest.alias("title"), version.alias("version"))


def version_from_tags(tags: Column, words: tuple[str, ...] = rules.VERSION_WORDS) -> Column:
    """The first tag that names a version."""
    named = F.transform(tags, lambda t: F.lower(trim_all(t)))
    return F.try_element_at(F.filter(named, lambda t: t.isin(*words)), F.lit(1))


def version_from_languages(dubbed: Column, subtitled: Column) -> Column:
    dub, sub = rules.VERSION_WORDS
    return F.when(dubbed == rules.DUBBED_ISO, dub).when(
        subtitled.isNotNull() & (subtitled != ""), sub
    )


def version_from_label(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for short, word in rules.VERSION_LABELS.items():
        out = F.when(F.upper(label) == short, F.lit(word)).otherwise(out)
    return out


NAMED_ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&amp;", "&"),
)
_NUMERIC = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def _from_code_point(entity: Column) -> Column:
    body = F.substring_index(F.regexp_replace(entity, "^&#", ""), ";", 1)
    is_hex = F.lower(body).startswith("x")
    code = F.when(is_hex, F.conv(F.regexp_replace(body, "^[xX]", ""), 16, 10)).otherwise(body)
    number = code.try_cast("bigint")
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    decoded = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(valid, decoded).otherwise(entity)


def decode_entities(text: Column) -> Column:
    """Numeric and named entities; ``&amp;`` goes last so nothing is decoded twice.

    Numeric references are cut out with split / regexp_extract_all and put back
    through UTF-32, so no Python worker is involved.
    """
    rest = F.split(text, _NUMERIC, -1)
    found = F.regexp_extract_all(text, F.lit(f"({_NUMERIC})"), 1)
    pieces = F.zip_with(
        rest, found, lambda r, e: F.concat(r, F.coalesce(_from_code_point(e), F.lit("")))
    )
    out = F.when(text.contains("&#"), F.array_join(pieces, "")).otherwise(text)
    for entity, char in NAMED_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_markup(html: Column) -> Column:
    """Text of a fragment: tags become blanks, entities characters, blanks collapse."""
    return collapse_spaces(decode_entities(F.regexp_replace(html, "<[^>]*>", " ")))


def split_headline(headline: Column, after: int = 20) -> Column:
    """Struct(title, publisher) at the last `` - `` that lies beyond ``after`` characters."""
    tail = F.substring_index(headline, " - ", -1)
    position = F.char_length(headline) - F.char_length(tail) - 3
    split = (position > after) & headline.contains(" - ")
    return F.struct(
        F.when(split, F.left(headline, position)).otherwise(headline).alias("title"),
        F.when(split, tail).otherwise(F.lit("")).alias("publisher"),
    )


def is_review(title: Column, pattern: str = rules.REVIEW_PATTERN) -> Column:
    # (?U): word edges next to accented letters count as edges.
    return title.rlike("(?U)" + pattern)


def origin_of(country: Column, title: Column, original: Column) -> Column:
    """'cz' or 'foreign': by country when there is one, else by having an original title."""
    by_country = F.when(trim_all(country).rlike(rules.HOME_COUNTRY_PATTERN), "cz").otherwise("foreign")
    has_original = original.isNotNull() & (original != "")
    return F.when(country.isNotNull() & (country != ""), by_country).otherwise(
        F.when(has_original, "foreign").otherwise("cz")
    )
