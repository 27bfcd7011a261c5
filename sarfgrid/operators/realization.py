"""Surface forms of verbs of every root class, by a paradigm table built from rules.

A template holds the radicals as 1, 2, 3, the vowels of the second radical as P (past) and
I (imperfect) and the helping vowel of the imperative as H. The table has a few hundred
rows whatever the input, so it is joined to the verbs by a broadcast; a class without
rows, or a vowel that no bab states, defers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arabic as ar

A, U, I, O, D = ar.FATHA, ar.DAMMA, ar.KASRA, ar.SUKUN, ar.SHADDA  # noqa: E741
# Vowels of the second radical in past and imperfect, by bab.
BABS = [("BAB_I_NASARA", A, U), ("BAB_II_DARABA", A, I), ("BAB_III_FATAHA", A, A), ("BAB_IV_SAMIA", I, A), ("BAB_V_KARUMA", U, U), ("BAB_VI_HASIBA", I, I)]
# What a class takes where no bab is given.
DEFAULTS = {"SOUND": (A, None), "DEFECTIVE_WAW": (A, U), "DEFECTIVE_YAA": (A, I), "ASSIMILATED_WAW": (I, I), "GEMINATED": (A, U), "HAMZATED": (A, A)}
# Person, number, gender, and the past's ending behind the third radical.
PAST_ENDS = [
    ("1", "SG", "M", O + "ت" + U), ("1", "SG", "F", O + "ت" + U), ("1", "PL", "M", O + "ن" + A + "ا"), ("1", "PL", "F", O + "ن" + A + "ا"),
    ("2", "SG", "M", O + "ت" + A), ("2", "SG", "F", O + "ت" + I), ("2", "DU", "M", O + "ت" + U + "م" + A + "ا"), ("2", "DU", "F", O + "ت" + U + "م" + A + "ا"), ("2", "PL", "M", O + "ت" + U + "م" + O), ("2", "PL", "F", O + "ت" + U + "ن" + D + A),
    ("3", "SG", "M", A), ("3", "SG", "F", A + "ت" + O), ("3", "DU", "M", A + "ا"), ("3", "DU", "F", A + "ت" + A + "ا"), ("3", "PL", "M", U + "وا"), ("3", "PL", "F", O + "ن" + A),
]
MOODS = {"INDICATIVE": U, "SUBJUNCTIVE": A, "JUSSIVE": O}
HAMZAS = "ءأإؤئآ"


def root_class(root: Column) -> Column:
    """The class of three radicals: doubled, twice weak, hollow, defective, assimilated, hamzated, sound; in this order."""
    c1, c2, c3 = (F.substring(root, k, 1) for k in (1, 2, 3))
    weak = lambda c: c.isin("و", "ي")
    return (
        F.when(root.isNull() | (F.length(root) < 3), "SOUND")
        .when((c2 == c3) & ~weak(c2), "GEMINATED")
        .when(weak(c1) & weak(c3), "LAFIF_MAFRUQ")
        .when(weak(c2) & weak(c3), "LAFIF_MAQRUN")
        .when(c2 == "و", "HOLLOW_WAW")
        .when(c2 == "ي", "HOLLOW_YAA")
        .when(c3 == "و", "DEFECTIVE_WAW")
        .when(c3.isin("ي", "ى"), "DEFECTIVE_YAA")
        .when(c1 == "و", "ASSIMILATED_WAW")
        .when(c1 == "ي", "ASSIMILATED_YAA")
        .when(c1.isin(*HAMZAS), "HAMZATED_C1")
        .when(c2.isin(*HAMZAS), "HAMZATED_C2")
        .when(c3.isin(*HAMZAS), "HAMZATED_C3")
        .otherwise("SOUND")
    )


def prefix(p: str, n: str, g: str) -> str:
    if p == "1":
        return "أ" if n == "SG" else "ن"
    return "ت" if p == "2" or (g == "F" and n != "PL") else "ي"


def imperfect_end(mood: str, p: str, n: str, g: str) -> str:
    """Behind the third radical: vowel and, for some persons, a tail that loses its nun outside the indicative."""
    full = mood == "INDICATIVE"
    if n == "DU":
        return A + ("ان" + I if full else "ا")
    if n == "PL" and p != "1":
        return O + "ن" + A if g == "F" else U + ("ون" + A if full else "وا")
    if (p, n, g) == ("2", "SG", "F"):
        return I + ("ين" + A if full else "ي")
    return MOODS[mood]


def defective_past(c: str, key: tuple[str, str, str], end: str) -> str:
    at = {("3", "SG", "M"): "ا" if c == "و" else "ى", ("3", "SG", "F"): "ت" + O, ("3", "PL", "M"): "و" + O + "ا", ("3", "PL", "F"): "و" + O + "ن" + A}
    return "1" + A + "2P" + at.get(key, c + end)


def defective_imperfect(c: str, mood: str, key: tuple[str, str, str]) -> str:
    end, full = imperfect_end(mood, *key), mood == "INDICATIVE"
    if end in MOODS.values():
        return "" if mood == "JUSSIVE" else c
    if key[1:] == ("PL", "F"):
        return end
    vowel = I if key == ("2", "SG", "F") else U if full else A
    return c + vowel + end[1:]


def geminated_past(key: tuple[str, str, str], end: str) -> str:
    if key == ("3", "SG", "M"):
        return "1" + A + "2" + D + "P"
    if key == ("3", "PL", "F"):
        return "1" + A + "2" + A + "3" + end
    return "1" + A + "2P3" + end if end.startswith(O) else "1" + A + "2" + D + end


def paradigm() -> list[tuple[str, ...]]:
    """root_class, tense, mood, voice, person, number, gender, template."""
    out = []
    for cls in ("SOUND", "HAMZATED", "ASSIMILATED_WAW", "HOLLOW_WAW", "HOLLOW_YAA", "DEFECTIVE_WAW", "DEFECTIVE_YAA", "GEMINATED"):
        c = "و" if cls.endswith("WAW") else "ي"
        v = U if c == "و" else I
        hollow, defective = cls.startswith("HOLLOW"), cls.startswith("DEFECTIVE")
        plain = cls in ("SOUND", "HAMZATED", "ASSIMILATED_WAW")
        for *key, end in PAST_ENDS:
            k = tuple(key)
            stem = defective_past(c, k, end) if defective else geminated_past(k, end) if cls == "GEMINATED" else ("1" + v + "3" if end.startswith(O) else "1" + A + "ا3") + end if hollow else "1" + A + "2P3" + end
            out.append((cls, "PAST", None, "ACTIVE", *k, stem))
            if plain:
                out.append((cls, "PAST", None, "PASSIVE", *k, "1" + U + "2" + I + "3" + end))
            if cls == "GEMINATED" and k == ("3", "SG", "M"):
                out.append((cls, "PAST", None, "PASSIVE", *k, "1" + U + "2" + D + A))
            for mood in MOODS:
                pre, end_ = prefix(*k), imperfect_end(mood, *k)
                if hollow:
                    stem = "1" + v + ("" if mood == "JUSSIVE" and end_ == O else c) + "3" + end_
                elif defective:
                    stem = "1" + O + "2I" + defective_imperfect(c, mood, k)
                elif cls == "GEMINATED":
                    stem = "1I2" + D + (A if mood == "JUSSIVE" and end_ == O else end_)
                else:
                    stem = ("" if cls == "ASSIMILATED_WAW" else "1" + O) + "2I3" + end_
                out.append((cls, "IMPERFECT", mood, "ACTIVE", *k, pre + A + stem))
                if cls in ("SOUND", "HAMZATED"):
                    out.append((cls, "IMPERFECT", mood, "PASSIVE", *k, pre + U + "1" + O + "2" + A + "3" + end_))
        order = {"ASSIMILATED_WAW": "2I3" + O, "HOLLOW_WAW": "1" + v + "3" + O, "HOLLOW_YAA": "1" + v + "3" + O, "DEFECTIVE_WAW": "ا" + v + "1" + O + "2I", "DEFECTIVE_YAA": "ا" + v + "1" + O + "2I", "GEMINATED": "اH1" + O + "2" + D + A}
        out.append((cls, "IMPERATIVE", None, "ACTIVE", "2", "SG", "M", order.get(cls, "اH1" + O + "2I3" + O)))
    return out


def hamza_seats(c: Column) -> Column:
    """Bare hamza on its seat: ya by a kasra, alef before other vowels; without a vowel it stays bare."""
    c = F.regexp_replace(c, f"({I}{D}?)ء(?=[{A}{U}])", "$1ئ")
    c = F.regexp_replace(c, f"ء(?={I})", "ئ")
    return F.regexp_replace(c, f"ء(?!{O}|$)", "أ")


def realize(verbs: DataFrame) -> DataFrame:
    """verbs (root, bab_id) -> root, bab_id, root_class, tense, mood, voice, person, number, gender, form, confidence, residual.

    Repeated verbs give repeated rows; a null bab takes its class's vowels; a class without
    a paradigm gives one row without a form. Other columns stay.
    """
    spark = verbs.sparkSession
    table = F.broadcast(spark.createDataFrame(paradigm(), "cls string, tense string, mood string, voice string, person string, number string, gender string, template string"))  # fixed size
    babs = F.broadcast(spark.createDataFrame(BABS, "bab string, past string, imperfect string"))
    given = F.broadcast(spark.createDataFrame([(k, *v) for k, v in DEFAULTS.items()], "of string, past0 string, imperfect0 string"))
    v = verbs.withColumn("root_class", root_class(F.col("root")))
    v = v.withColumn("cls", F.regexp_replace("root_class", "^HAMZATED_C.$", "HAMZATED"))
    v = v.join(babs, v["bab_id"] == babs["bab"], "left").join(given, v["cls"] == given["of"], "left")
    v = v.withColumn("p", F.coalesce("past", "past0")).withColumn("i", F.coalesce("imperfect", "imperfect0")).drop("bab", "past", "imperfect", "of", "past0", "imperfect0")
    v = v.join(table.withColumnRenamed("cls", "c"), v["cls"] == F.col("c"), "left")
    form = F.col("template")
    for k in (1, 2, 3):
        form = F.replace(form, F.lit(str(k)), F.substring("root", k, 1))
    uses = F.col("template").rlike("[IH]")
    form = F.replace(form, F.lit("P"), F.coalesce("p", F.lit(A)))
    form = F.replace(F.replace(form, F.lit("H"), F.when(F.col("i") == U, U).otherwise(I)), F.lit("I"), F.coalesce("i", F.lit("")))
    ok = F.col("template").isNotNull() & (F.length("root") == 3) & ~(uses & F.col("i").isNull())
    residual = F.when(F.col("template").isNull(), F.concat(F.lit("defer:inflection:root_class_not_implemented:"), F.col("root_class"))).when(~ok, "defer:inflection:imperfect_vowel_unknown")
    out = v.withColumn("form", F.when(ok, hamza_seats(ar.nfc(form)))).withColumn("confidence", F.when(ok, "HIGH").otherwise("DEFER_REQUIRED")).withColumn("residual", residual)
    return out.drop("cls", "c", "p", "i", "template")
