"""Arabic script: normal forms, marks, the article, letters with their marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of the script, by code point.
FATHATAN, DAMMATAN, KASRATAN = "\u064b", "\u064c", "\u064d"
FATHA, DAMMA, KASRA, SHADDA, SUKUN = "\u064e", "\u064f", "\u0650", "\u0651", "\u0652"
MADDA, HAMZA_ABOVE, HAMZA_BELOW, DAGGER = "\u0653", "\u0654", "\u0655", "\u0670"
SHORT, TANWIN = FATHA + DAMMA + KASRA, FATHATAN + DAMMATAN + KASRATAN
MARKS = SHORT + TANWIN + SUKUN + SHADDA + MADDA + HAMZA_ABOVE + HAMZA_BELOW + DAGGER
MARK = f"[{MARKS}]"
LETTER = "[\u0621-\u063a\u0641-\u064a]"
STRIPPED = "[\u064b-\u065f\u0670]"
SOLAR = "تثدذرزسشصضطظلن"
TATWEEL = "ـ"

#: A test device, not linguistics: Latin letters to Arabic letters and marks, one to one.
LATIN = "abcdefghijklmnopqrstuvwxyz"
ARABIC = FATHA + "بصد" + "ا" + "فغه" + KASRA + "جكلمنو" + SHADDA + "قرست" + DAMMA + SUKUN + "أشيز"


def transliterate(c: Column) -> Column:
    return F.translate(F.lower(c), LATIN, ARABIC)


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, STRIPPED, "")


def strip_key(c: Column) -> Column:
    """Without marks and tatweel: the bare key of closed-class catalogues."""
    return F.regexp_replace(c, f"[\u064b-\u0670{TATWEEL}]", "")


def normalize_hamza(c: Column) -> Column:
    """Carriers of hamza become hamza; alef with madda becomes hamza, fatha, alef."""
    return F.replace(F.translate(c, "أإؤئ", "ءءءء"), F.lit("آ"), F.lit("ء" + FATHA + "ا"))


def normalize_al(c: Column) -> Column:
    """The article at a word's start is hamza, fatha, lam."""
    return F.regexp_replace(c, "(^| )ال", "$1ء" + FATHA + "ل")


def normalize_shadda(c: Column) -> Column:
    """A doubled letter is written twice: first with sukun, then with its other marks."""
    plain = f"[{MARKS.replace(SHADDA, '')}]*"
    for _ in range(3):  # one shadda a letter is left
        c = F.regexp_replace(c, f"{SHADDA}({plain}){SHADDA}", f"{SHADDA}$1")
    return F.regexp_replace(c, f"({LETTER})({plain}){SHADDA}", f"$1{SUKUN}$1$2")


def normalize(c: Column) -> Column:
    return normalize_shadda(normalize_al(normalize_hamza(c)))


def nfc(c: Column) -> Column:
    """Normal form C of Arabic: each letter's marks by combining class, then letter and mark composed."""
    order = TANWIN[0] + TANWIN[1] + TANWIN[2] + FATHA + DAMMA + KASRA + SHADDA + SUKUN + DAGGER + HAMZA_BELOW + MADDA + HAMZA_ABOVE
    pairs = {"آ": "آ", "أ": "ا" + HAMZA_ABOVE, "إ": "ا" + HAMZA_BELOW, "ؤ": "و" + HAMZA_ABOVE, "ئ": "ي" + HAMZA_ABOVE}
    for whole, parts in pairs.items():
        c = F.replace(c, F.lit(whole), F.lit(parts))
    keys = "abcdefghijkl"
    clusters = F.regexp_extract_all(c, F.lit(f"(?s)([^{order}]?)([{order}]*)"), 0)
    marked = F.transform(clusters, lambda x: F.concat(F.regexp_extract(x, f"(?s)^([^{order}]?)", 1), F.translate(F.array_join(F.array_sort(F.split(F.translate(F.regexp_extract(x, f"([{order}]*)$", 1), order, keys), "")), ""), keys, order)))
    c = F.array_join(marked, "")
    for whole, parts in pairs.items():
        c = F.regexp_replace(c, f"{parts[0]}([{order[:9]}]*){parts[1]}", f"{whole}$1")
    return c


def canonical_normalize(c: Column) -> Column:
    """Normal form C, then alef with madda as hamza and fatha (no alef)."""
    return F.replace(nfc(c), F.lit("آ"), F.lit("ء" + FATHA))


def count_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^\u0621-\u063a\u0641-\u064a]", ""))


def starts_with_article(c: Column) -> Column:
    bare = strip_diacritics(c)
    return bare.startswith("ال") & (F.length(bare) > 2)


def article_span(c: Column) -> Column:
    """struct(article, rest, kind): kind is lunar, solar or none; the assimilation shadda goes from a solar rest."""
    article = F.regexp_extract(c, f"^(ا{MARK}*ل{MARK}*)", 1)
    rest = F.substr(c, F.length(article) + 1)
    has = starts_with_article(c)
    solar = rest.rlike(f"^[{SOLAR}]{MARK}*{SHADDA}")
    return F.struct(
        F.when(has, article).otherwise("").alias("article"),
        F.when(has & solar, F.regexp_replace(rest, f"^([{SOLAR}][{MARKS.replace(SHADDA, '')}]*){SHADDA}", "$1")).when(has, rest).otherwise(c).alias("rest"),
        F.when(~has, "none").when(solar, "solar").otherwise("lunar").alias("kind"),
    )


def phones(c: Column) -> Column:
    """Letters with their marks, doubled and madda letters written out; tatweel and other signs fall away."""
    return F.regexp_extract_all(normalize_shadda(F.replace(c, F.lit("آ"), F.lit("ء" + FATHA + "ا"))), F.lit(f"{LETTER}{MARK}*"), 0)


def mark_state(phone: Column) -> Column:
    return (
        F.when(phone.rlike(f"[{TANWIN}]"), "TANWIN").when(phone.rlike(f"[{SHORT}]"), "EXPLICIT_VOWEL").when(phone.contains(SUKUN), "SUKUN").when(F.length(phone) > 1, "OTHER").otherwise("ABSENT")
    )


def diacritic(letter: Column) -> Column:
    """The first short vowel or sukun that a letter carries, or null."""
    return F.nullif(F.regexp_extract(letter, f"([{SHORT}{SUKUN}])", 1), F.lit(""))


def is_silent(letter: Column) -> Column:
    """A letter with sukun, or without a vowel."""
    return F.coalesce(diacritic(letter) == SUKUN, F.lit(True))


def is_moving(letter: Column) -> Column:
    """A letter with a short vowel."""
    return F.coalesce(diacritic(letter) != SUKUN, F.lit(False))


def doubled(letter: Column, vowel: Column) -> Column:
    """struct(first, second) of a doubled letter: silent, then with the vowel; null where that is no short vowel."""
    return F.when(vowel.isin(*SHORT), F.struct(F.concat(letter, F.lit(SUKUN)).alias("first"), F.concat(letter, vowel).alias("second")))


def with_article(c: Column) -> Column:
    """The article (hamza, fatha, silent lam) in front of a word, without assimilation."""
    return F.concat(F.lit("ء" + FATHA + "ل" + SUKUN), c)
