"""Text cleaning and tokenising as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Unicode white space.
SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def to_lowercase(c: Column) -> Column:
    return F.lower(c)


def remove_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def remove_extra_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+|www\.\S+", "")


def remove_html_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}+", "")


def clean(c: Column, lowercase=True, remove_punct=True, remove_nums=False, remove_links=True, remove_html=True) -> Column:
    """Markup, links, case, punctuation, numbers, white space, in this order; numbers stay unless asked."""
    for wanted, step in ((remove_html, remove_html_tags), (remove_links, remove_urls), (lowercase, to_lowercase), (remove_punct, remove_punctuation), (remove_nums, remove_numbers)):
        c = step(c) if wanted else c
    return remove_extra_whitespace(c)


def word_tokenize(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE), "")


def sentence_tokenize(c: Column) -> Column:
    """Cut behind . ! ? where white space follows; blanks at the ends go, empty sentences too."""
    return F.filter(F.split(F.trim(c), "(?<=[.!?])" + SPACE), lambda s: s != "")


def strip_punct(c: Column, marks: str) -> Column:
    """struct(left, core, right) with the marks at both ends peeled off."""
    p = "[" + marks + "]*"
    left = F.regexp_extract(c, f"^({p})", 1)
    rest = F.substr(c, F.length(left) + 1)
    right = F.regexp_extract(rest, f"({p})$", 1)
    return F.struct(left.alias("left"), F.left(rest, F.length(rest) - F.length(right)).alias("core"), right.alias("right"))
