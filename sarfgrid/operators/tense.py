"""Tense and imperfect features of a surface form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arabic as ar

PREFIXES = "يتأءن"


def drop_conjunction(c: Column) -> Column:
    """Without a leading vocalised and- or so-particle, if at least four characters come along."""
    return F.when((F.length(c) >= 4) & c.rlike(f"^[وف]{ar.FATHA}"), F.substr(c, F.lit(3))).otherwise(c)


#: Bare endings of the past that a long word with a prefix letter may have.
PAST_ENDS = ["تم", "تما", "تن", "نا", "تا"]


def is_imperfect(c: Column) -> Column:
    """A prefix letter with a vowel, then: sukun behind fatha, damma, a doubled letter (written once or twice), a hollow middle, or five letters without a past ending."""
    s, m = drop_conjunction(c), f"{ar.MARK}*"
    letter, bare = f"{ar.LETTER}{m}", ar.strip_diacritics(s)
    fatha, damma = s.rlike(f"^[{PREFIXES}]{m}{ar.FATHA}"), s.rlike(f"^[{PREFIXES}]{m}{ar.DAMMA}")
    second_sukun = s.rlike(f"^{letter}{ar.LETTER}{m}{ar.SUKUN}")
    third_double = s.rlike(f"^{letter}{letter}{ar.LETTER}{m}{ar.SHADDA}")
    hollow = s.rlike(f"^{letter}{ar.LETTER}{m}[{ar.DAMMA}{ar.KASRA}]{m}[ويا]{m}{ar.LETTER}")
    four = s.rlike(f"^{letter}{letter}{letter}{letter}")
    twice = s.rlike(f"^{letter}(?:{letter})*({ar.LETTER}){m}{ar.SUKUN}{m}\\1")
    past = bare.endswith("وا") | (~bare.endswith("ونا") & bare.rlike("(" + "|".join(PAST_ENDS) + ")$"))
    longer = fatha & four & ~past & (F.length(bare) >= 5) & s.rlike("^[يتن]")
    return s.rlike(f"^{letter}{letter}{letter}") & ((fatha & second_sukun) | damma | (fatha & third_double) | (fatha & hollow) | ((fatha | damma) & four & twice) | longer)


def tense(c: Column) -> Column:
    """IMPERFECT, IMPERATIVE or PAST; past is what nothing else claims, null what is empty."""
    s, m = drop_conjunction(c), f"{ar.MARK}*"
    letter, bare = f"{ar.LETTER}{m}", ar.strip_diacritics(s)
    lam = (F.length(s) >= 4) & s.rlike(f"^ل{ar.SUKUN}")
    fourth = s.rlike(f"^[ءأ]{m}{ar.FATHA}") & s.rlike(f"^{letter}{ar.LETTER}{m}{ar.SUKUN}") & bare.endswith("وا")
    imperative = s.rlike(f"^[اٱ]{m}[^ل{ar.MARKS}]{m}{ar.SUKUN}{m}{ar.LETTER}") & ~(bare.endswith("ان") & (F.length(bare) > 4))
    eighth = s.rlike(f"^[اٱ]{m}{ar.LETTER}{m}{ar.SHADDA}{m}{ar.LETTER}{m}{ar.DAMMA}{m}{ar.LETTER}")
    return F.when(c == "", None).when(lam, "IMPERFECT").when(fourth, "IMPERATIVE").when(is_imperfect(c), "IMPERFECT").when(imperative | eighth, "IMPERATIVE").otherwise("PAST")


def sentence_tense(c: Column) -> Column:
    """tense() of the last word."""
    return tense(F.element_at(F.split(F.trim(c), " +"), -1))


def person_of_prefix(c: Column) -> Column:
    """Person and number that the prefix letter states; ت leaves the person open."""
    first = F.left(drop_conjunction(c), F.lit(1))
    return F.when(first.isin("أ", "ء"), "1 SG").when(first == "ن", "1 PL").when(first == "ت", "2|3 SG").otherwise("3 SG")


def imperfect_ending(c: Column) -> Column:
    """Number, gender and mood that the ending states."""
    bare = ar.strip_diacritics(c)
    last = F.regexp_extract(c, f"({ar.MARK})$", 1)
    mood = F.when(last == ar.FATHA, "SUBJUNCTIVE").when(last == ar.SUKUN, "JUSSIVE").otherwise("INDICATIVE")
    return (
        F.when(bare.endswith("ون") & (F.length(bare) > 4), "PL M INDICATIVE")
        .when(bare.endswith("ين"), "SG F INDICATIVE")
        .when(bare.endswith("ان"), "DU M INDICATIVE")
        .when(bare.endswith("ن") & ~bare.endswith("ون"), "PL F INDICATIVE")
        .when(bare.endswith("وا"), "PL M SUBJUNCTIVE")
        .when(bare.endswith("ي") & bare.startswith("ت"), "SG F SUBJUNCTIVE")
        .when(bare.endswith("ا") & ~bare.endswith("نا") & ~bare.endswith("تا"), "DU M SUBJUNCTIVE")
        .otherwise(F.concat(F.lit("SG M "), mood))
    )
