"""Inflection of sound verbs: forms by person, number, gender, mood and voice; and features back from forms.

A paradigm is a literal array of endings exploded beside each root, so generation is a
projection; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arabic as ar

A, U, I, O = ar.FATHA, ar.DAMMA, ar.KASRA, ar.SUKUN  # noqa: E741
VOWEL = {"a": A, "u": U, "i": I}

# Person, number, gender, what follows the third radical in the past.
PAST = [
    ("3", "SG", "M", A), ("3", "DU", "M", A + "ا"), ("3", "PL", "M", U + "وا"),
    ("3", "SG", "F", A + "ت" + O), ("3", "DU", "F", A + "ت" + A + "ا"), ("3", "PL", "F", O + "ن" + A),
    ("2", "SG", "M", O + "ت" + A), ("2", "DU", "M", O + "ت" + U + "م" + A + "ا"), ("2", "PL", "M", O + "ت" + U + "م" + O),
    ("2", "SG", "F", O + "ت" + I), ("2", "PL", "F", O + "ت" + U + "ن" + ar.SHADDA + A),
    ("1", "SG", "M", O + "ت" + U), ("1", "PL", "M", O + "ن" + A + "ا"),
]
# Person, number, gender, prefix, endings of indicative, subjunctive, jussive.
IMPERFECT = [
    ("3", "SG", "M", "ي", U, A, O), ("3", "DU", "M", "ي", A + "ان" + I, A + "ا", A + "ا"), ("3", "PL", "M", "ي", U + "ون" + A, U + "وا", U + "وا"),
    ("3", "SG", "F", "ت", U, A, O), ("3", "DU", "F", "ت", A + "ان" + I, A + "ا", A + "ا"), ("3", "PL", "F", "ي", O + "ن" + A, O + "ن" + A, O + "ن" + A),
    ("2", "SG", "M", "ت", U, A, O), ("2", "SG", "F", "ت", I + "ين" + A, I + "ي", I + "ي"), ("2", "PL", "M", "ت", U + "ون" + A, U + "وا", U + "وا"), ("2", "PL", "F", "ت", O + "ن" + A, O + "ن" + A, O + "ن" + A),
    ("1", "SG", "M", "أ", U, A, O), ("1", "PL", "M", "ن", U, A, O),
]
MOODS = ["INDICATIVE", "SUBJUNCTIVE", "JUSSIVE"]


def cells(past_vowel: str, imperfect_vowel: str) -> list[tuple[str, ...]]:
    """tense, mood, voice, person, number, gender, and what stands before, between and after the radicals."""
    out = []
    for voice, first, second in (("ACTIVE", A, VOWEL[past_vowel]), ("PASSIVE", U, I)):
        out += [("PAST", None, voice, p, n, g, "", first, second, end) for p, n, g, end in PAST]
    for voice, first, second in (("ACTIVE", A, VOWEL[imperfect_vowel]), ("PASSIVE", U, A)):
        out += [("IMPERFECT", m, voice, p, n, g, pre + first, O, second, ends[k]) for p, n, g, pre, *ends in IMPERFECT for k, m in enumerate(MOODS)]
    return out


def conjugate(roots: DataFrame, past_vowel: str, imperfect_vowel: str, tenses: tuple[str, ...] = ("PAST", "IMPERFECT")) -> DataFrame:
    """root, tense, mood, voice, person, number, gender, form of every sound root."""
    names = ["tense", "mood", "voice", "person", "number", "gender", "pre", "first", "second", "ending"]
    t = F.explode(F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, row, strict=True)]) for row in cells(past_vowel, imperfect_vowel) if row[0] in tenses]))
    df = roots.select("root", t.alias("t")).select("root", "t.*")
    c = [F.substring("root", k, 1) for k in (1, 2, 3)]
    return df.select("root", *names[:6], F.concat("pre", c[0], "first", c[1], "second", c[2], "ending").alias("form"))


def past_features(surface: Column) -> Column:
    """struct(person, number, gender, voice) by the ending; the citation form is third masculine singular."""
    bare, cell = ar.strip_diacritics(surface), F.regexp_extract_all(surface, F.lit(f"{ar.LETTER}{ar.MARK}*"), 0)
    passive = F.get(cell, F.lit(0)).contains(U) & F.get(cell, F.lit(1)).contains(I)
    tests = [
        (surface.endswith("ت" + U + "ن" + ar.SHADDA + A), "2 PL F"), (bare.endswith("تما"), "2 DU M"), (bare.endswith("تم"), "2 PL M"), (bare.endswith("نا"), "1 PL M"), (bare.endswith("وا"), "3 PL M"),
        (surface.endswith(O + "ن" + A), "3 PL F"), (surface.endswith("ت" + A + "ا"), "3 DU F"), (bare.endswith("ا") & ~bare.endswith("تا"), "3 DU M"),
        (surface.endswith("ت" + I), "2 SG F"), (surface.endswith("ت" + A), "2 SG M"), (surface.endswith("ت" + U), "1 SG M"), (surface.endswith("ت" + O), "3 SG F"),
    ]
    png = F.lit("3 SG M")
    for test, value in reversed(tests):
        png = F.when(test, value).otherwise(png)
    p = F.split(png, " ")
    return F.struct(F.get(p, F.lit(0)).alias("person"), F.get(p, F.lit(1)).alias("number"), F.get(p, F.lit(2)).alias("gender"), F.when(passive, "PASSIVE").otherwise("ACTIVE").alias("voice"))
