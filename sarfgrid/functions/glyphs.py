"""Letter and mark classes, and the licence of a phone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arabic as ar

# Classes of base letters and marks.
HAMZA_CARRIERS, LONG, OTHER_BASE = "أإؤئآ", "اوي", "ىةء"


def base_class(letter: Column) -> Column:
    return (
        F.when(letter == ar.TATWEEL, "TATWEEL")
        .when(letter == "ء", "HAMZA")
        .when(letter.rlike(f"^[{HAMZA_CARRIERS}]$"), "HAMZA_CARRIER")
        .when(letter.rlike(f"^[{LONG}]$"), "LONG_VOWEL_LETTER")
        .when(letter == "ى", "ALEF_MAQSURA")
        .when(letter == "ة", "TAA_MARBUTA")
        .when(letter.rlike(f"^{ar.LETTER}$"), "CONSONANT")
        .otherwise("UNLICENSED")
    )


def mark_class(mark: Column) -> Column:
    return (
        F.when(mark.rlike(f"^[{ar.SHORT}]$"), "SHORT_VOWEL")
        .when(mark.rlike(f"^[{ar.TANWIN}]$"), "TANWIN")
        .when(mark == ar.SUKUN, "SUKUN")
        .when(mark == ar.SHADDA, "SHADDA")
        .when(mark.rlike(f"^{ar.MARK}$"), "HAMZA_OR_MADDA_MARK")
        .otherwise("UNLICENSED")
    )


def cell_kind(phone: Column) -> Column:
    """CV, C or V of a letter with its marks."""
    vowel = phone.rlike(f"[{ar.SHORT}{ar.TANWIN}]")
    return F.when(phone.rlike("^[اى]") | (phone.rlike("^[وي]") & ~vowel), "V").when(vowel, "CV").otherwise("C")


def licensed(phone: Column) -> Column:
    """One base letter, at most one vowel, no vowel beside sukun."""
    vowels = F.length(F.regexp_replace(phone, f"[^{ar.SHORT}{ar.TANWIN}]", ""))
    return phone.rlike(f"^{ar.LETTER}{ar.MARK}*$") & (vowels <= 1) & ~((vowels == 1) & phone.contains(ar.SUKUN))


def marks_fit(given: Column, candidate: Column) -> Column:
    """Same letters in order, and each letter's given marks are the candidate's; sukun on a long vowel letter equals no mark."""
    pairs = lambda c: F.regexp_extract_all(c, F.lit("[^\u064b-\u065f\u0670][\u064b-\u065f\u0670]*"), 0)

    def fits(g, c):
        gm, cm, same = F.substr(g, F.lit(2)), F.substr(c, F.lit(2)), F.left(g, F.lit(1)) == F.left(c, F.lit(1))
        return same & ((gm == "") | (gm == cm) | ((gm == ar.SUKUN) & (cm == "") & F.left(g, F.lit(1)).isin("ي", "و")))

    return (F.size(pairs(given)) == F.size(pairs(candidate))) & ~F.exists(F.zip_with(pairs(given), pairs(candidate), lambda g, c: ~F.coalesce(fits(g, c), F.lit(False))), lambda x: x)


def marks_compatible(given: Column, catalogue: Column) -> Column:
    """Same letters, and every mark that is given stands in the catalogue's form: a multiset containment."""
    count = lambda c, m: F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))
    out = ar.strip_diacritics(given) == ar.strip_diacritics(catalogue)
    for m in ar.MARKS:
        out = out & (count(given, m) <= count(catalogue, m))
    return out
