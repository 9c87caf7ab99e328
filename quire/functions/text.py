"""Column functions over HTML text: title, sections, markup removal, entities, words."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that are not indexed.
STOP_WORDS = (
    "into", "by", "in", "of", "at", "if", "no", "as", "on", "near", "or", "it", "is", "be", "was", "the", "to", "such",
    "and", "for", "a", "but", "their", "not", "that", "they", "are", "will", "then", "this", "these", "with", "there",
)
MAX_WORD = 99
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
BODY = r"(?is)<body[^>]*>(.*?)</body>"
#: Words. Possessive quantifiers keep Java's matcher from recursing once per character.
WORD = r"(\p{Nd}[\p{L}\p{N}_]*+(?:(?:'[\p{L}\p{N}]|\.\p{Nd})[\p{L}\p{N}_]*+)*+|[\p{L}\p{N}_]++(?:'[\p{L}\p{N}][\p{L}\p{N}_]*+)*+)"
LINK = r"""(?i)(?:src|href)\s*=\s*["']([^"'#?]+)"""
#: The entities that native replacement covers; & comes last, so that each is decoded once.
ENTITIES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def page_title(page: Column) -> Column:
    """The first title without tags, blanks collapsed; entities stay as they are; '' if there is none."""
    inner = F.regexp_replace(F.regexp_extract(page, TITLE, 1), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(inner, r"\s+", " "))


def title_section(page: Column) -> Column:
    return F.regexp_extract(page, TITLE, 1)


def body_section(page: Column) -> Column:
    """The first body; a page without a complete one counts as a whole, its title included."""
    return F.when(page.rlike(BODY), F.regexp_extract(page, BODY, 1)).otherwise(page)


def strip_markup(section: Column) -> Column:
    """Scripts, styles, comments and tags become blanks, in this order; entities are left."""
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>"):
        section = F.regexp_replace(section, pattern, " ")
    return section


def unescape(text: Column) -> Column:
    """Entities of the closed set ENTITIES, natively; exact for texts that hold no others."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def holds_other_entities(text: Column) -> Column:
    names = "|".join(e[1:-1] for e, _ in ENTITIES)
    return text.rlike(rf"&(?!(?:{names});)(?:#|[A-Za-z])")


@F.pandas_udf(T.StringType())
def unescape_all(text: pd.Series) -> pd.Series:
    """Every HTML5 entity, the semicolon-less ones too."""
    return text.map(html.unescape, na_action="ignore")


def unescape_exactly(text: Column) -> Column:
    """All entities decoded. Only texts with entities beyond the closed set are sent to Python, and each is read once."""
    odd = F.coalesce(holds_other_entities(text), F.lit(False))
    return F.coalesce(unescape_all(F.when(odd, text)), unescape(text))


def words(text: Column) -> Column:
    """Lower-case words: letters, digits, _; ' within a word is taken out; a number may hold points; over 99 characters: dropped."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))
    return F.filter(F.transform(found, lambda w: F.replace(w, F.lit("'"), F.lit(""))), lambda w: (F.length(w) >= 1) & (F.length(w) <= MAX_WORD))


def without_stop_words(found: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def canonical_url(url: Column) -> Column:
    """Slashes turned forward, those in front dropped."""
    return F.regexp_replace(F.replace(url, F.lit("\\"), F.lit("/")), r"^/+", "")


def url_key(url: Column) -> Column:
    return F.lower(canonical_url(url))


def links(page: Column) -> Column:
    """Targets of src and href, without external ones."""
    found = F.transform(F.regexp_extract_all(page, F.lit(LINK), F.lit(1)), lambda x: F.replace(x, F.lit("\\"), F.lit("/")))
    outside = ("http://", "https://", "mailto:", "javascript:")
    return F.filter(found, lambda x: ~(x.startswith(outside[0]) | x.startswith(outside[1]) | x.startswith(outside[2]) | x.startswith(outside[3])))


def is_topic(path: Column) -> Column:
    return F.contains(F.lower(F.element_at(F.split(path, "/"), -1)), F.lit(".ht"))


def base_name(path: Column) -> Column:
    """The last part of a path without its extension, in lower case; a name that begins with its only point is whole."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\\\]*)$", 1), r"(?<=[^.])\.[^.]*$", ""))


def directories(path: Column) -> Column:
    """All directories above an absolute path, the root left out, each with its slash."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(F.size(parts) > 2, up).otherwise(F.array().cast("array<string>"))


def collation_key(keyword: Column) -> Column:
    """Sort key: without leading marks in lower case first; then all characters, lower case before upper."""
    bare = F.lower(F.regexp_replace(keyword, r"^[^\p{L}\p{N}]+", ""))
    chars = F.transform(F.split(keyword, ""), lambda c: F.struct(F.lower(c).alias("c"), F.when(c.rlike(r"^\p{Lu}$"), 1).otherwise(0).alias("u")))
    return F.struct(bare.alias("bare"), chars.alias("chars"))


def compound_keyword(path: Column) -> Column:
    """Names of a path joined by ', ': a name that follows nothing is taken alone."""
    return F.aggregate(path, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(", "), x)))
