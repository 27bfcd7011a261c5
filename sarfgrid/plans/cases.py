"""Operators over public example words, each beside the rows it must give, stated as data.

The expected rows are not derived from the engine's tables: they are the published answers
for these words, so a wrong rule shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..operators import alignment, claims, eligibility, functional, lookup, radicals, realization, segmentation, tense, wordclass
from ..sources import catalogs
from . import sql

QUERIES, ORACLES = {}, {}


def case(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return keep


# Word; bare particles, article, host, pronoun.
SEGMENTS = [
    ("بِدَيْنٍ", "ب", None, "دين", None), ("بِالْعَدْلِ", "ب", "ال", "عدل", None), ("وَلْيَكْتُبْ", "و+ل", None, "يكتب", None), ("فَلْيَكْتُبْ", "ف+ل", None, "يكتب", None), ("فَإِنْ", "ف", None, "إن", None), ("وَإِنْ", "و", None, "إن", None), ("وَلَا", "و", None, "لا", None), ("فَلَا", "ف", None, "لا", None),
    ("لِلشَّهَادَةِ", "ل", "ل", "شهادة", None), ("لِلْكِتَابِ", "ل", "ل", "كتاب", None), ("لِلرَّجُلِ", "ل", "ل", "رجل", None), ("لِلشَّمْسِ", "ل", "ل", "شمس", None), ("لِلنَّاسِ", "ل", "ل", "ناس", None), ("لِلْعَدْلِ", "ل", "ل", "عدل", None), ("لِلْأَمْرِ", "ل", "ل", "أمر", None), ("لِلسَّمَاءِ", "ل", "ل", "سماء", None), ("لِلْمُسْلِمِينَ", "ل", "ل", "مسلمين", None),
    ("سَيَكْتُبُ", "س", None, "يكتب", None), ("سَيَفْعَلُ", "س", None, "يفعل", None), ("سَنَفْعَلُ", "س", None, "نفعل", None), ("سَتَكْتُبُ", "س", None, "تكتب", None), ("سَأَكْتُبُ", "س", None, "أكتب", None), ("سَفِيهًا", "", None, "سفيها", None), ("سَمِعَ", "", None, "سمع", None), ("سَبِيلٌ", "", None, "سبيل", None), ("سَعِيدٌ", "", None, "سعيد", None), ("سَلَامٌ", "", None, "سلام", None),
    ("وَعَدَ", "", None, "وعد", None), ("وَجَدَ", "", None, "وجد", None), ("وَلَدَ", "", None, "ولد", None), ("وَالْكِتَابُ", "و", "ال", "كتاب", None), ("وَأَشْهِدُوا", "و", None, "أشهدوا", None), ("وَاللَّهُ", "و", None, "الله", None), ("اللَّهُ", "", None, "الله", None), ("وَلِيُّهُ", "", None, "ولي", "ه"),
    ("كَاتِبٌ", "", None, "كاتب", None), ("كَبِيرٌ", "", None, "كبير", None), ("كِتَابٌ", "", None, "كتاب", None), ("فُسُوقٌ", "", None, "فسوق", None), ("فَقِيرٌ", "", None, "فقير", None), ("لَبِسَ", "", None, "لبس", None), ("لَعِبَ", "", None, "لعب", None),
    ("هُوَ", "", None, "هو", None), ("هَذَا", "", None, "هذا", None), ("هَذِهِ", "", None, "هذه", None), ("الَّذِي", "", None, "الذي", None), ("ذَلِكَ", "", None, "ذلك", None), ("مِنْهُ", "", None, "من", "ه"), ("بِكُمْ", "ب", None, None, "كم"), ("الْكِتَابُ", "", "ال", "كتاب", None), ("كَتَبَهُ", "", None, "كتب", "ه"), ("كَتَبُوا", "", None, "كتبوا", None), ("يَكْتُبُونَ", "", None, "يكتبون", None), ("يَكُونَا", "", None, "يكونا", None),
]


def _segmented(spark):
    return spark.createDataFrame([(r[0],) for r in SEGMENTS], "surface string").select("surface", segmentation.segment_word(F.col("surface")).alias("x"))


@case(f"SELECT * FROM {sql.values(SEGMENTS, 'surface, proclitics, article, host, pronoun')} AS t")
def segment_token(spark, sf_dir):
    bare = ar.strip_diacritics
    parts = F.array_join(F.transform("x.proclitics", bare), "+")
    return _segmented(spark).select("surface", parts.alias("proclitics"), bare(F.col("x.article")).alias("article"), bare(F.col("x.host")).alias("host"), bare(F.col("x.enclitic")).alias("pronoun"))


@case(f"SELECT surface, nfc_normalize(surface) AS roundtrip, host IS NOT NULL AS host_present, host IS NULL AS clitic_only, length(nfc_normalize(surface))::BIGINT AS last_end FROM {sql.values(SEGMENTS, 'surface, proclitics, article, host, pronoun')} AS t")
def segment_spans(spark, sf_dir):
    """Segments lie end to end and give the normal form back."""
    s = F.col("x.segments")
    return _segmented(spark).select("surface", F.array_join(F.transform(s, lambda p: p["surface"]), "").alias("roundtrip"), "x.host_present", "x.clitic_only", F.array_max(F.transform(s, lambda p: p["end"])).cast("long").alias("last_end"))


# Word and tense.
TENSES = [
    ("تَدَايَنْتُمْ", "PAST"), ("تَبَايَعْتُمْ", "PAST"), ("كَتَبْتُمْ", "PAST"), ("كَتَبْتُنَّ", "PAST"), ("كَتَبْنَا", "PAST"), ("كَتَبْتُ", "PAST"), ("كَتَبَ", "PAST"), ("نَصَرَ", "PAST"), ("ضَرَبَ", "PAST"),
    ("يَتَفَاعَلُ", "IMPERFECT"), ("يَتَفَعَّلُ", "IMPERFECT"), ("تَكْتُبُونَ", "IMPERFECT"), ("تَكْتُبِينَ", "IMPERFECT"), ("يَنْصُرُ", "IMPERFECT"), ("يَنْصُرَ", "IMPERFECT"), ("يَنْصُرْ", "IMPERFECT"), ("يَكْتُبُونَ", "IMPERFECT"), ("يُعَوِّضُهُمْ", "IMPERFECT"), ("يُنْصَرُ", "IMPERFECT"),
    ("يَتَعَلَّمُ", "IMPERFECT"), ("تَضِلْلَ", "IMPERFECT"), ("تَضِلَّ", "IMPERFECT"), ("لْيَكْتُبْ", "IMPERFECT"), ("يَرُدُّ", "IMPERFECT"), ("يَكُونُ", "IMPERFECT"), ("تَبِيعُ", "IMPERFECT"), ("يَكُونَا", "IMPERFECT"),
    ("اِكْتُبْ", "IMPERATIVE"), ("اُكْتُبُوا", "IMPERATIVE"), ("اتَّقُوا", "IMPERATIVE"), ("وَاتَّقُوا", "IMPERATIVE"), ("أَشْهِدُوا", "IMPERATIVE"), ("أَقَامَ", "PAST"), ("لَمْ يَكْتُبْ", "IMPERFECT"), ("", None),
]


@case(f"SELECT * FROM {sql.values(TENSES, 'surface, tense')} AS t")
def identify_tense(spark, sf_dir):
    return spark.createDataFrame([(r[0],) for r in TENSES], "surface string").select("surface", tense.sentence_tense(F.col("surface")).alias("tense"))


# Radicals, verb class, tense, mood, voice, person, number, gender, form.
FORMS = [
    ("نصر", "BAB_I_NASARA", "PAST", None, "ACTIVE", "3", "SG", "M", "نَصَرَ"), ("ضرب", "BAB_II_DARABA", "PAST", None, "ACTIVE", "3", "SG", "M", "ضَرَبَ"), ("سمع", "BAB_IV_SAMIA", "PAST", None, "ACTIVE", "3", "SG", "M", "سَمِعَ"), ("كرم", "BAB_V_KARUMA", "PAST", None, "ACTIVE", "3", "SG", "M", "كَرُمَ"), ("حسب", "BAB_VI_HASIBA", "PAST", None, "ACTIVE", "3", "SG", "M", "حَسِبَ"),
    ("نصر", "BAB_I_NASARA", "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "SG", "M", "يَنْصُرُ"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "SG", "F", "تَنْصُرُ"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "PL", "M", "يَنْصُرُونَ"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "DU", "M", "يَنْصُرَانِ"),
    ("ضرب", "BAB_II_DARABA", "IMPERFECT", "INDICATIVE", "ACTIVE", "2", "SG", "F", "تَضْرِبِينَ"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "INDICATIVE", "ACTIVE", "2", "PL", "M", "تَنْصُرُونَ"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "INDICATIVE", "ACTIVE", "1", "SG", "M", "أَنْصُرُ"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "INDICATIVE", "ACTIVE", "1", "PL", "M", "نَنْصُرُ"),
    ("نصر", "BAB_I_NASARA", "IMPERFECT", "SUBJUNCTIVE", "ACTIVE", "3", "SG", "M", "يَنْصُرَ"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "SUBJUNCTIVE", "ACTIVE", "3", "PL", "M", "يَنْصُرُوا"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "SUBJUNCTIVE", "ACTIVE", "2", "SG", "F", "تَنْصُرِي"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "SUBJUNCTIVE", "ACTIVE", "3", "DU", "M", "يَنْصُرَا"),
    ("نصر", "BAB_I_NASARA", "IMPERFECT", "JUSSIVE", "ACTIVE", "3", "SG", "M", "يَنْصُرْ"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "JUSSIVE", "ACTIVE", "3", "PL", "M", "يَنْصُرُوا"), ("نصر", "BAB_I_NASARA", "IMPERFECT", "JUSSIVE", "ACTIVE", "2", "SG", "F", "تَنْصُرِي"),
    ("قرء", "BAB_III_FATAHA", "PAST", None, "ACTIVE", "3", "SG", "M", "قَرَأَ"), ("قرء", "BAB_III_FATAHA", "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "SG", "M", "يَقْرَأُ"),
    ("قول", None, "PAST", None, "ACTIVE", "3", "SG", "M", "قَالَ"), ("قول", None, "PAST", None, "ACTIVE", "3", "PL", "M", "قَالُوا"), ("قول", None, "PAST", None, "ACTIVE", "1", "SG", "M", "قُلْتُ"), ("قول", None, "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "SG", "M", "يَقُولُ"), ("قول", None, "IMPERFECT", "JUSSIVE", "ACTIVE", "3", "SG", "M", "يَقُلْ"),
    ("بيع", None, "PAST", None, "ACTIVE", "3", "SG", "M", "بَاعَ"), ("بيع", None, "PAST", None, "ACTIVE", "1", "SG", "M", "بِعْتُ"), ("بيع", None, "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "SG", "M", "يَبِيعُ"), ("بيع", None, "IMPERFECT", "JUSSIVE", "ACTIVE", "3", "SG", "M", "يَبِعْ"),
    ("دعو", "BAB_I_NASARA", "PAST", None, "ACTIVE", "3", "SG", "M", "دَعَا"), ("دعو", "BAB_I_NASARA", "PAST", None, "ACTIVE", "3", "PL", "M", "دَعَوْا"), ("دعو", "BAB_I_NASARA", "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "SG", "M", "يَدْعُو"),
    ("رمي", "BAB_II_DARABA", "PAST", None, "ACTIVE", "3", "SG", "M", "رَمَى"), ("رمي", "BAB_II_DARABA", "PAST", None, "ACTIVE", "3", "PL", "M", "رَمَوْا"), ("رمي", "BAB_II_DARABA", "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "SG", "M", "يَرْمِي"),
    ("وعد", "BAB_II_DARABA", "PAST", None, "ACTIVE", "3", "SG", "M", "وَعَدَ"), ("وعد", "BAB_II_DARABA", "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "SG", "M", "يَعِدُ"),
    ("مدد", "BAB_I_NASARA", "PAST", None, "ACTIVE", "3", "SG", "M", "مَدَّ"), ("مدد", "BAB_I_NASARA", "PAST", None, "ACTIVE", "3", "PL", "M", "مَدُّوا"), ("مدد", "BAB_I_NASARA", "PAST", None, "ACTIVE", "2", "SG", "M", "مَدَدْتَ"), ("مدد", "BAB_I_NASARA", "IMPERFECT", "INDICATIVE", "ACTIVE", "3", "SG", "M", "يَمُدُّ"),
]
_CELL = ["root", "bab_id", "tense", "mood", "voice", "person", "number", "gender"]


@case(f"SELECT {', '.join(_CELL)}, nfc_normalize(form) AS form FROM {sql.values(FORMS, ', '.join(_CELL) + ', form')} AS t")
def realize_form(spark, sf_dir):
    """The forms of the stated cells, of all that the verbs' paradigms hold."""
    verbs = spark.createDataFrame(sorted({r[:2] for r in FORMS}, key=str), "root string, bab_id string")
    cells = spark.createDataFrame([r[:8] for r in FORMS], ", ".join(f"w_{c} string" for c in _CELL))
    got = realization.realize(verbs)
    same = [got[c].eqNullSafe(cells[f"w_{c}"]) for c in _CELL]
    return got.join(F.broadcast(cells), same, "left_semi").select(*_CELL, "form")


# Radicals and class.
CLASSES = [("نصر", "SOUND"), ("قول", "HOLLOW_WAW"), ("بيع", "HOLLOW_YAA"), ("دعو", "DEFECTIVE_WAW"), ("رمي", "DEFECTIVE_YAA"), ("وعد", "ASSIMILATED_WAW"), ("يسر", "ASSIMILATED_YAA"), ("مدد", "GEMINATED"), ("قرء", "HAMZATED_C3"), ("سءل", "HAMZATED_C2"), ("ءكل", "HAMZATED_C1"), ("وقي", "LAFIF_MAFRUQ"), ("طوي", "LAFIF_MAQRUN"), (None, "SOUND")]


@case(f"SELECT * FROM {sql.values(CLASSES, 'root, root_class')} AS t")
def classify_root(spark, sf_dir):
    return spark.createDataFrame([(r[0],) for r in CLASSES], "root string").select("root", realization.root_class(F.col("root")).alias("root_class"))


# Paradigm sizes by class: past, imperfect and imperative cells with a form, both voices; one row without a form where a class has no paradigm.
SIZES = [("SOUND", 129, 0), ("HAMZATED_C3", 129, 0), ("ASSIMILATED_WAW", 81, 0), ("HOLLOW_WAW", 65, 0), ("HOLLOW_YAA", 65, 0), ("DEFECTIVE_WAW", 65, 0), ("DEFECTIVE_YAA", 65, 0), ("GEMINATED", 66, 0), ("LAFIF_MAFRUQ", 0, 1)]


@case(f"SELECT root_class, forms::BIGINT AS forms, deferred::BIGINT AS deferred FROM {sql.values(SIZES, 'root_class, forms, deferred')} AS t")
def paradigm_sizes(spark, sf_dir):
    verbs = [("نصر", "BAB_I_NASARA"), ("قرء", "BAB_III_FATAHA"), ("وعد", "BAB_II_DARABA"), ("قول", None), ("بيع", None), ("دعو", "BAB_I_NASARA"), ("رمي", "BAB_II_DARABA"), ("مدد", "BAB_I_NASARA"), ("وقي", None)]
    r = realization.realize(spark.createDataFrame(verbs, "root string, bab_id string"))
    return r.groupBy("root_class").agg(F.count("form").alias("forms"), F.sum((F.col("confidence") != "HIGH").cast("long")).alias("deferred"))


# A small closed-class catalogue: id, vocalised surface, kind of surface, class, family.
MABNI = [
    (1, "M001", "هَذَا", "OVERT", "DEMONSTRATIVE", "NEAR"), (2, "M002", "الَّذِي", "OVERT", "RELATIVE", "SG_M"), (3, "M003", "الَّذِينَ", "OVERT", "RELATIVE", "PL_M"), (4, "M004", "إِنَّ", "OVERT", "PARTICLE", "EMPHASIS"), (5, "M005", "نَعَمْ", "OVERT", "PARTICLE", "ANSWER"),
    (6, "M006", "هُوَ", "OVERT", "PRONOUN", "SG_M"), (7, "M007", "", "LATENT", "PRONOUN", "HIDDEN"), (8, "M008", "بِ", "ATTACHED", "PARTICLE", "GENITIVE"), (9, "M009", "هُوَ", "OVERT", "PRONOUN", "AGAIN"), (10, "M010", "هِوَ", "OVERT", "PRONOUN", "LATER"),
]
# Word, verdict so far, verdict of the catalogue, id.
MABNI_WORDS = [
    ("هَذَا", "ACCEPT", "MABNI_BOUNDARY", "M001"), ("بِ", "ACCEPT", "MABNI_BOUNDARY", "M008"), ("الَّذِي", "ACCEPT", "MABNI_BOUNDARY", "M002"), ("إِنَّ", "ACCEPT", "MABNI_BOUNDARY", "M004"), ("نَعَمْ", "ACCEPT", "MABNI_BOUNDARY", "M005"),
    ("هُوَ", "DEFER", "MABNI_DEFERRED", "M006"), ("هُوَ", "BLOCK", "MABNI_BLOCKED", None), ("يَعْمَلُ", "ACCEPT", "MABNI_NOT_FOUND", None), ("", "ACCEPT", "MABNI_NOT_FOUND", None), ("هو", "ACCEPT", "MABNI_BOUNDARY", "M006"), ("هُوِ", "ACCEPT", "MABNI_NOT_FOUND", None), ("هَوَ", "ACCEPT", "MABNI_NOT_FOUND", None), ("الَّذِيْنَ", "ACCEPT", "MABNI_BOUNDARY", "M003"), (None, "ACCEPT", "MABNI_NOT_FOUND", None),
]


def _mabni(spark):
    rows = spark.createDataFrame(MABNI, "nr long, mabni_id string, surface_vocalized string, surface_kind string, lexical_class string, lexical_family string")
    return rows.withColumns({"blocks_root_path": F.lit("True"), "contract_state": F.lit("CLOSED"), "source_file": F.lit("example")})


@case(f"SELECT surface, verdict, mabni_verdict, mabni_id, mabni_id IS NOT NULL AS blocks_root_path FROM {sql.values(MABNI_WORDS, 'surface, verdict, mabni_verdict, mabni_id')} AS t")
def process_mabni(spark, sf_dir):
    words = spark.createDataFrame([r[:2] for r in MABNI_WORDS], "surface string, verdict string")
    by_vocalized, by_bare, _ = catalogs.mabni_indexes(_mabni(spark))
    return lookup.closed_class(words, by_vocalized, by_bare).select("surface", "verdict", "mabni_verdict", "mabni_id", "blocks_root_path")


@case("SELECT * FROM (VALUES ('هذا'), ('الذي'), ('الذين'), ('إن'), ('نعم'), ('هو'), ('ب')) AS t(surface)")
def get_all_overt_surfaces(spark, sf_dir):
    return catalogs.get_all_overt_surfaces(_mabni(spark))


@case("SELECT 'M007' AS mabni_id, '' AS surface_vocalized, 'HIDDEN' AS lexical_family")
def get_by_id(spark, sf_dir):
    return catalogs.get_by_id(_mabni(spark), "M007").select("mabni_id", "surface_vocalized", "lexical_family")


@case("SELECT * FROM (VALUES ('DEMONSTRATIVE', 1::BIGINT, 1::BIGINT), ('RELATIVE', 2, 2), ('PARTICLE', 3, 3), ('PRONOUN', 4, 3)) AS t(lexical_class, rows, surfaces)")
def mabni_stats(spark, sf_dir):
    return lookup.inventory_stats(_mabni(spark), "lexical_class")


# Verb classes of the bare verb: id, pattern of the past, vowels of the second radical.
ABWAB = [("BAB_I_NASARA", "FA_A_LA", "a", "u"), ("BAB_II_DARABA", "FA_A_LA", "a", "i"), ("BAB_III_FATAHA", "FA_A_LA", "a", "a"), ("BAB_IV_SAMIA", "FA_I_LA", "i", "a"), ("BAB_V_KARUMA", "FA_U_LA", "u", "u"), ("BAB_VI_HASIBA", "FA_I_LA", "i", "i")]
_ABWAB = "bab_id string, past_wazn_id string, past_ayn_vowel string, imperfect_ayn_vowel string"


@case("SELECT * FROM (VALUES ('FA_A_LA', 'BAB_I_NASARA'), ('FA_A_LA', 'BAB_II_DARABA'), ('FA_A_LA', 'BAB_III_FATAHA'), ('FA_I_LA', 'BAB_IV_SAMIA'), ('FA_I_LA', 'BAB_VI_HASIBA'), ('NONE', NULL), (NULL, NULL)) AS t(wazn_id, bab_id)")
def lookup_by_wazn_id(spark, sf_dir):
    words = spark.createDataFrame([("FA_A_LA",), ("FA_I_LA",), ("NONE",), (None,)], "wazn_id string")
    return lookup.by_key(words, spark.createDataFrame(ABWAB, _ABWAB), {"wazn_id": "past_wazn_id"}).select("wazn_id", "entry.bab_id")


@case("SELECT * FROM (VALUES ('a', 'u', 'BAB_I_NASARA'), ('i', 'a', 'BAB_IV_SAMIA'), ('u', 'a', NULL)) AS t(p, i, bab_id)")
def lookup_by_vowels(spark, sf_dir):
    words = spark.createDataFrame([("a", "u"), ("i", "a"), ("u", "a")], "p string, i string")
    return lookup.by_key(words, spark.createDataFrame(ABWAB, _ABWAB), {"p": "past_ayn_vowel", "i": "imperfect_ayn_vowel"}).select("p", "i", "entry.bab_id")


# Host, directive so far; directive, root, residual, type.
ROOTS = [
    ("كَتَبَ", "OPEN", "ACCEPT", "كتب", None, "sound"), ("شَدَّ", "OPEN", "ACCEPT", "شدد", None, "geminate"), ("قَرَأَ", "OPEN", "ACCEPT", "قرء", None, "hamza"), ("كَتَبَ", "DEFER", "DEFER", None, "defer:root:pre_root_directive_defer", None), ("كَتَبَ", "BLOCK", "BLOCK", None, "block:root:pre_root_directive_block", None),
    ("قَالَ", "OPEN", "DEFER", None, "defer:root:hollow_underlying_radical_unresolved", None), ("رَمَى", "OPEN", "DEFER", None, "defer:root:defective_lam_unresolved", None), ("وَعَدَ", "OPEN", "DEFER", None, "defer:root:assimilated_fa_unresolved", None), ("وَقَى", "OPEN", "DEFER", None, "defer:root:lafif_mafruq_unresolved", None), ("طَوَى", "OPEN", "DEFER", None, "defer:root:lafif_maqrun_unresolved", None),
    ("قُلْ", "OPEN", "DEFER", None, "defer:root:two_consonant_form_unresolved", None), ("دَحْرَجَ", "OPEN", "DEFER", None, "defer:root:quadriliteral_beyond_scope", None), ("بِ", "OPEN", "BLOCK", None, "block:root:insufficient_consonants", None),
]


@case(f"SELECT * FROM {sql.values(ROOTS, 'host, pre_root, directive, root, residual, root_type')} AS t")
def resolve_root(spark, sf_dir):
    d = spark.createDataFrame([r[:2] for r in ROOTS], "host string, pre_root string").withColumn("x", radicals.resolve_root(F.col("host"), F.col("pre_root")))
    return d.select("host", "pre_root", "x.directive", "x.root", "x.residual", "x.root_type")


# Host, verbal path; directive, prefix, suffix, form family, roots.
ACCOUNTS = [
    ("يَكْتُبُ", True, "ACCEPT", "يَ", None, "FORM_I_IMPERFECT", "كتب"), ("تَكْتُبُ", True, "ACCEPT", "تَ", None, "FORM_I_IMPERFECT", "كتب"), ("تَكْتُبُو", True, "ACCEPT", "تَ", "و", "FORM_I_IMPERFECT", "كتب"), ("تَسْأَمُوا", True, "ACCEPT", "تَ", "وا", "FORM_I_IMPERFECT", "سءم"), ("تَفْعَلُوا", True, "ACCEPT", "تَ", "وا", "FORM_I_IMPERFECT", "فعل"),
    ("يَذْهَبُ", True, "ACCEPT", "يَ", None, "FORM_I_IMPERFECT", "ذهب"), ("يَشُدُّ", True, "ACCEPT", "يَ", None, "FORM_I_IMPERFECT", "شدد"), ("يَمُدُّ", True, "ACCEPT", "يَ", None, "FORM_I_IMPERFECT", "مدد"), ("تَشُكُّوا", True, "ACCEPT", "تَ", "وا", "FORM_I_IMPERFECT", "شكك"), ("تُدِيرُ", True, "ACCEPT", "تُ", None, "FORM_IV", "دور"),
    ("يَقُولُ", True, "DEFER", "يَ", None, "FORM_I_IMPERFECT", ""), ("قُلْ", True, "DEFER", None, None, None, "قول قيل"), ("بِعْ", True, "DEFER", None, None, None, "بيع بوع"), ("اكْتُبُوا", True, "ACCEPT", None, "وا", "FORM_I", "كتب"), ("نَوْمِ", False, "DEFER", None, None, None, ""),
]


@case(f"SELECT * FROM {sql.values(ACCOUNTS, 'host, verbal, directive, prefix, suffix, form_family, roots')} AS t")
def radical_accounting(spark, sf_dir):
    d = spark.createDataFrame([r[:2] for r in ACCOUNTS], "host string, verbal boolean").withColumn("x", radicals.account(F.col("host"), F.lit("OPEN"), F.col("verbal")))
    return d.select("host", "verbal", "x.directive", "x.prefix", "x.suffix", "x.form_family", F.array_join("x.roots", " ").alias("roots"))


# Kind, pattern, verb class, root class; directive and reason, with the transitivity that the verb class states.
DERIVABLE = [
    ("ISM_FA3IL", "FA_A_LA", "BAB_I_NASARA", "SOUND", "ACCEPT", "fa3il_unconstrained"), ("ISM_FA3IL", "FA3L", None, "SOUND", "NOT_APPLICABLE", "nominal_wazn"), ("ISM_FA3IL", None, None, "SOUND", "DEFER", "wazn_family_unknown"), ("ISM_MAF3UL", "FA_A_LA", "BAB_I_NASARA", "SOUND", "DEFER", "transitivity_unknown"), ("ISM_MAF3UL", "FA33ALA", "BAB_FORM_II", "SOUND", "ACCEPT", "mazid_structural_maf3ul"),
    ("ISM_MAF3UL", "FA_A_LA", "BAB_FORM_II", "SOUND", "ACCEPT", "transitive_verb"), ("ISM_MAF3UL", "FA_A_LA", "BAB_FORM_V", "SOUND", "BLOCK", "intransitive_verb"), ("SIFA_MUSHABBAHA", "FA33ALA", "BAB_FORM_II", "SOUND", "NOT_APPLICABLE", "augmented_not_standard_for_sifa"), ("SIFA_MUSHABBAHA", "FA_A_LA", "BAB_FORM_IV", "SOUND", "BLOCK", "transitive_verb"), ("SIYAG_MUBALAGHAH", "FA_A_LA", None, "SOUND", "ACCEPT", "verbal_root_form_i"),
    ("ISM_ZAMAN", "AF3AL", None, "SOUND", "DEFER", "augmented_ism_zaman_masdar_based"), ("ISM_MAKAN", "FA_A_LA", None, "SOUND", "ACCEPT", "verbal_wazn_form_i"), ("ISM_ALA", "FA_A_LA", None, "SOUND", "DEFER", "transitivity_unknown"), ("ISM_ALA", "FA_A_LA", "BAB_FORM_VII", "SOUND", "DEFER", "intransitive_ism_ala_unusual"),
    ("TAFDHIL", "FA_A_LA", "BAB_I_NASARA", "SOUND", "ACCEPT", "mujarrad_tafdhil_eligible"), ("TAFDHIL", "FA_A_LA", "BAB_I_NASARA", "HOLLOW", "NOT_APPLICABLE", "root_class_incompatible:HOLLOW"), ("TAFDHIL", "FA_A_LA", None, "SOUND", "DEFER", "bab_unknown_tafdhil_ambiguous"), ("TAFDHIL", "FA_A_LA", None, "UNKNOWN", "DEFER", "root_class_ambiguous"), ("OTHER", "FA_A_LA", None, "SOUND", "DEFER", "unknown_mushtaq_type:OTHER"),
]


@case(f"SELECT * FROM {sql.values(DERIVABLE, 'kind, wazn_id, bab_id, root_class, directive, reason')} AS t")
def derivative_eligibility(spark, sf_dir):
    d = spark.createDataFrame([r[:4] for r in DERIVABLE], "kind string, wazn_id string, bab_id string, root_class string")
    x = eligibility.eligible(F.col("kind"), eligibility.family_of(F.col("wazn_id")), F.col("bab_id"), eligibility.transitivity_of(F.col("bab_id")), F.col("root_class"))
    return d.withColumn("x", x).select("kind", "wazn_id", "bab_id", "root_class", "x.directive", "x.reason")


# Article, assimilation, boundary, word class, clitics alone; states and values of the five slots.
CLAIMS = [
    (True, True, None, "ISM", False, "FILLED FILLED NOT_APPLICABLE FILLED FILLED", "AL SOLAR - OPEN_MORPHOLOGY ISM"), (True, False, None, "ISM", False, "FILLED NOT_APPLICABLE NOT_APPLICABLE FILLED FILLED", "AL - - OPEN_MORPHOLOGY ISM"), (False, True, None, None, False, "NOT_APPLICABLE NOT_APPLICABLE NOT_APPLICABLE FILLED UNKNOWN", "- - - OPEN_MORPHOLOGY -"),
    (None, None, "MABNI_BOUNDARY", "ISM", False, "NOT_APPLICABLE NOT_APPLICABLE FILLED BLOCKED FILLED", "- - MABNI_BOUNDARY ROOT_PATH_BLOCKED ISM"), (None, None, None, "OPERATOR", False, "NOT_APPLICABLE NOT_APPLICABLE FILLED BLOCKED FILLED", "- - OPERATOR_BOUNDARY ROOT_PATH_BLOCKED OPERATOR"), (None, None, "JAMID_AALAM_BOUNDARY", "", None, "NOT_APPLICABLE NOT_APPLICABLE FILLED BLOCKED UNKNOWN", "- - JAMID_AALAM_BOUNDARY ROOT_PATH_BLOCKED -"), (None, None, None, None, True, "NOT_APPLICABLE NOT_APPLICABLE NOT_APPLICABLE BLOCKED UNKNOWN", "- - - ROOT_PATH_BLOCKED -"),
]


@case(f"SELECT row_number() OVER () AS nr, states, vals FROM {sql.values([(str(k), r[5], r[6]) for k, r in enumerate(CLAIMS)], 'k, states, vals')} AS t")
def claim_slots(spark, sf_dir):
    """Article, boundary and word class slots of a result row, in order."""
    d = spark.createDataFrame([(k + 1, *r[:5]) for k, r in enumerate(CLAIMS)], "nr long, has_article boolean, solar boolean, boundary string, word_class string, clitic_only boolean")
    every = F.concat(claims.article_slots(F.col("has_article"), F.col("solar")), claims.boundary_slots(F.col("boundary"), F.col("word_class"), F.col("clitic_only")), F.array(claims.word_class_slot(F.col("word_class"))))
    d = d.select("nr", every.alias("s"))
    return d.select("nr", F.array_join(F.transform("s", lambda x: x["state"]), " ").alias("states"), F.array_join(F.transform("s", lambda x: F.coalesce(x["value"], F.lit("-"))), " ").alias("vals"))


@case("SELECT * FROM (VALUES ('ك-ت-ب', 'ك,ت,ب'), ('ك ت ب', 'ك,ت,ب'), ('كتب', 'ك,ت,ب'), ('', ''), (NULL, NULL)) AS t(root, parts)")
def parse_root_string(spark, sf_dir):
    d = spark.createDataFrame([("ك-ت-ب",), ("ك ت ب",), ("كتب",), ("",), (None,)], "root string")
    return d.select("root", F.array_join(claims.root_parts(F.col("root")), ",").alias("parts"))


# Host; both roots of a word of two letters.
COMPRESSED = [("قُلْ", "قول,قيل"), ("بِعْ", "بيع,بوع"), ("خَفْ", None), ("كَتَبَ", None), (None, None)]


@case(f"SELECT * FROM {sql.values(COMPRESSED, 'host, roots')} AS t")
def compressed_roots(spark, sf_dir):
    d = spark.createDataFrame([(r[0],) for r in COMPRESSED], "host string")
    return d.select("host", F.array_join(radicals.compressed_candidates(F.col("host")), ",").alias("roots"))


# Host, root and its directive; directive, pattern, candidates, increase, operations, suffix and residual.
ALIGNED = [
    ("ضَرَبَ", "ضرب", "ACCEPT", "ACCEPT", "FA_A_LA", "FA_A_LA", "", "", "", None), ("قَرَأَ", "قرء", "ACCEPT", "ACCEPT", "FA_A_LA", "FA_A_LA", "", "", "", None), ("مَدَّ", "مدد", "ACCEPT", "ACCEPT", "FA_A_LA", "FA_A_LA", "", "op:weak:mudaaf_gemination_idghaam", "", None),
    ("عَلَّمَ", "علم", "ACCEPT", "ACCEPT", "FA33ALA", "FA33ALA", "ziyadah:gemination_of_AIN", "op:ziyadah:pattern_gemination", "", None), ("كَاتِب", "كتب", "ACCEPT", "ACCEPT", "FA3IL", "FA3IL", "ziyadah:ا@1", "", "", None), ("تَرَكَتْ", "ترك", "ACCEPT", "ACCEPT", "FA_A_LA", "FA_A_LA", "", "", "تْ", None),
    ("ضَرَ", "ضرب", "ACCEPT", "BLOCK", None, "", None, None, None, "block:wazn:no_licensed_pattern"), ("أَطْفَالُ", "طفل", "ACCEPT", "DEFER", None, "", None, None, None, "defer:wazn:unlicensed_but_structural_augment"), ("قَالَ", None, "DEFER", "DEFER", None, "", None, None, None, "defer:wazn:root_candidate_not_resolved"),
    ("قَالَ", "قول", "ACCEPT", "DEFER", None, "", None, None, None, "defer:wazn:catalog_pattern_not_licensed"), ("قَالَ", "قال", "ACCEPT", None, None, "", None, None, None, "contract:prohibited_radical"), ("كَتَبَة", "كتب", "ACCEPT", "DEFER", None, "FA_A_LA", None, None, None, "defer:wazn:nominal_feminine_requires_licensed_wazn"),
    ("ضَرَبَ", "ضرب", "BLOCK", "BLOCK", None, "", None, None, None, "block:wazn:root_candidate_blocked"), ("ضَرَبَ", None, "ACCEPT", None, None, "", None, None, None, "contract:accepted_without_root"), ("ضَرَبَ", "ضر", "ACCEPT", None, None, "", None, None, None, "contract:unsupported_arity"), ("ضَرَبَ", "ضرب", "MAYBE", None, None, "", None, None, None, "contract:unknown_directive"),
]


@case(f"SELECT * FROM {sql.values(ALIGNED, 'host, letters, root_directive, directive, wazn_id, candidates, increase, operations, suffix, residual')} AS t")
def project_wazn(spark, sf_dir):
    d = spark.createDataFrame([r[:3] for r in ALIGNED], "host string, letters string, root_directive string").withColumn("root", F.split("letters", ""))
    joined = [F.array_join(c, " ").alias(c) for c in ("candidates", "increase", "operations", "suffix")]
    return alignment.project(d, alignment.catalogue(spark)).select("host", "letters", "root_directive", F.col("wazn_directive").alias("directive"), "wazn_id", *joined, "residual")


# What a request brings beside nothing; verdict, class, subclass and reason.
REQUESTS = [
    ({}, "DEFERRED", None, None, "NO_MORPHOLOGY_PATH"), ({"path": "another_path"}, "DEFERRED", None, None, "INSUFFICIENT_EVIDENCE"), ({"lexical_verdict": "BLOCK", "mabni_status": "blocked"}, "BLOCKED", None, None, "UPSTREAM_BLOCK"), ({"mabni_status": "blocked", "path": "verbal_root_path"}, "BLOCKED", None, None, "UPSTREAM_BLOCK"),
    ({"lexical_verdict": "OPERATOR_BOUNDARY", "lexical_class": "Closed Function Word"}, "ACCEPTED", "HARF", "CLOSED_FUNCTION_WORD", "LEXICAL_HARF_ENTRY"), ({"lexical_verdict": "OPERATOR_BOUNDARY", "lexical_class": "Numerical Operator"}, "ACCEPTED", "HARF", "NUMERICAL_OPERATOR", "LEXICAL_HARF_ENTRY"), ({"lexical_verdict": "MABNI_BOUNDARY", "lexical_class": "Closed Function Word"}, "ACCEPTED", "HARF", "CLOSED_FUNCTION_WORD", "LEXICAL_HARF_ENTRY"),
    ({"lexical_verdict": "OPERATOR_BOUNDARY", "lexical_class": "Verbal Operator"}, "ACCEPTED", "FI3L", "VERBAL_OPERATOR", "LEXICAL_VERBAL_OPERATOR"), ({"path": "ambiguous_morphology_path", "masdar_accepted": True}, "ACCEPTED", "ISM", "MASDAR", "ACCEPTED_MASDAR"), ({"path": "verbal_root_path", "masdar_accepted": True, "verbal_host": True, "normalized": "كَتَبَ"}, "ACCEPTED", "FI3L", "VERBAL_PAST", "LICENSED_VERBAL_HOST"),
    ({"path": "nominal_morphology_path", "derivative_type": "ISM_FA3IL"}, "ACCEPTED", "ISM", "ISM_FA3IL", "ACCEPTED_DERIVATIVE"), ({"path": "verbal_root_path", "derivative_type": "ISM_FA3IL", "normalized": "كَتَبَ"}, "ACCEPTED", "FI3L", "VERBAL_PAST", "VERBAL_ROOT_PATH"), ({"attachment_route": "MABNI_BOUNDARY", "mabni_class": "DETACHED_PRONOUN", "lexical_verdict": "MABNI_BOUNDARY"}, "ACCEPTED", "ISM", "PRONOUN", "MABNI_BOUNDARY_ISM"), ({"attachment_route": "MABNI_BOUNDARY", "mabni_class": "DEMONSTRATIVE"}, "ACCEPTED", "ISM", "DEMONSTRATIVE", "MABNI_BOUNDARY_ISM"),
    ({"path": "verbal_root_path", "normalized": "يَكْتُبُ"}, "ACCEPTED", "FI3L", "VERBAL_IMPERFECT", "VERBAL_ROOT_PATH"), ({"path": "ambiguous_morphology_path", "verbal_host": True, "bab_id": "BAB_FORM_IV", "wazn_id": "AF3AL", "normalized": "أَقْسَطُ"}, "ACCEPTED", "ISM", "LEXICAL_NOUN", "ELATIVE_AFAL_NOT_VERB"), ({"surface": "فَاكْتُبُوهُ", "path": "ambiguous_morphology_path"}, "ACCEPTED", "FI3L", "VERBAL_IMPERATIVE", "IMPERATIVE_SURFACE_SELF_EVIDENT"), ({"surface": "وَلْيَكْتُبْ", "path": "ambiguous_morphology_path"}, "ACCEPTED", "FI3L", "VERBAL_IMPERFECT", "LAM_AMR_JUSSIVE_IMPERFECT"),
    ({"surface": "كَتَبَ", "normalized": "كَتَبَ", "path": "ambiguous_morphology_path", "wazn_id": "FA_A_LA", "bab_tried": True}, "ACCEPTED", "FI3L", "VERBAL_PAST", "AMBIGUOUS_PATH_P4A_WAZN"), ({"surface": "الْحَقُّ", "path": "ambiguous_morphology_path", "wazn_id": "FA3L", "bab_tried": True}, "ACCEPTED", "ISM", "LEXICAL_NOUN", "DEFINITE_ARTICLE_NOT_VERB"), ({"surface": "بَيْنَكُمْ", "path": "ambiguous_morphology_path", "wazn_id": "FA3L"}, "ACCEPTED", "ISM", "LEXICAL_NOUN", "AMBIGUOUS_NO_P4B_SUPPORT"), ({"surface": "عَلَيْكُمْ", "path": "ambiguous_morphology_path"}, "ACCEPTED", "ISM", "LEXICAL_NOUN", "AMBIGUOUS_NO_VERBAL_EVIDENCE"),
    ({"surface": "يَكُونَا", "normalized": "يَكُونَا", "path": "no_morphology_path"}, "ACCEPTED", "FI3L", "VERBAL_IMPERFECT", "IMPERFECT_PREFIX_NO_MORPH_PATH"), ({"surface": "ذَلِكُمْ", "normalized": "ذَلِكُمْ", "path": "no_morphology_path"}, "ACCEPTED", "ISM", "LEXICAL_NOUN", "NO_MORPHOLOGY_PATH_DEFAULT_ISM"), ({"path": "nominal_morphology_path"}, "ACCEPTED", "ISM", "LEXICAL_NOUN", "NOMINAL_MORPHOLOGY_PATH"), ({"path": "derived_nominal_path"}, "ACCEPTED", "ISM", "LEXICAL_NOUN", "NOMINAL_MORPHOLOGY_PATH"), ({"path": "functional_path"}, "ACCEPTED", "ISM", "CLOSED_FUNCTION_WORD", "NOMINAL_MORPHOLOGY_PATH"),
]


@case(f"SELECT nr::INTEGER AS nr, verdict, word_class, subclass, reason FROM {sql.values([(k, *r[1:]) for k, r in enumerate(REQUESTS)], 'nr, verdict, word_class, subclass, reason')} AS t")
def classify_word_class(spark, sf_dir):
    kinds = {str: "string", bool: "boolean"}
    schema = "nr int, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in wordclass.REQUEST.items())
    d = spark.createDataFrame([(k, *(r[0].get(c) for c in wordclass.REQUEST)) for k, r in enumerate(REQUESTS)], schema)
    return wordclass.decide(d).select("nr", F.col("word_class_verdict").alias("verdict"), "word_class", "subclass", "reason")


# An attachment's note and the id it names.
NOTES = [("whole-token match: HUWA", "HUWA"), ("whole-token match: HADHA ", "HADHA"), ("suffix", ""), ("", ""), (None, "")]


@case(f"SELECT notes, mabni_id FROM {sql.values(NOTES, 'notes, mabni_id')} AS t")
def extract_mabni_id_from_notes(spark, sf_dir):
    d = spark.createDataFrame([(r[0],) for r in NOTES], "notes string")
    return d.select("notes", wordclass.mabni_id_of_note(F.col("notes")).alias("mabni_id"))


# A letter with its marks; its vowel or sukun, silent, moving.
LETTERS = [("بَ", "َ", False, True), ("بْ", "ْ", True, False), ("ب", None, True, False), ("بُّ", "ُ", False, True), ("بٌ", None, True, False), ("", None, True, False)]


@case(f"SELECT * FROM {sql.values(LETTERS, 'letter, mark, silent, moving')} AS t")
def letter_states(spark, sf_dir):
    d = spark.createDataFrame([(r[0],) for r in LETTERS], "letter string")
    c = F.col("letter")
    return d.select("letter", ar.diacritic(c).alias("mark"), ar.is_silent(c).alias("silent"), ar.is_moving(c).alias("moving"))


# Letter and vowel; both parts of the doubled letter, and a word behind the article.
DOUBLED = [("م", "َ", "مْ", "مَ", "ءَلْم"), ("د", "ُ", "دْ", "دُ", "ءَلْد"), ("د", "ْ", None, None, "ءَلْد"), (None, "َ", None, None, None)]


@case(f"SELECT * FROM {sql.values(DOUBLED, 'letter, vowel, first, second, named')} AS t")
def expand_shadda(spark, sf_dir):
    d = spark.createDataFrame([r[:2] for r in DOUBLED], "letter string, vowel string")
    return d.withColumn("x", ar.doubled(F.col("letter"), F.col("vowel"))).select("letter", "vowel", "x.first", "x.second", ar.with_article(F.col("letter")).alias("named"))


# Host; verdict, identity and kind.
NAMED = [
    ("اللَّهُ", "JAMID_AALAM_BOUNDARY", "الله", "divine_name"), ("اللَّهَ", "JAMID_AALAM_BOUNDARY", "الله", "divine_name"), ("اللَّهِ", "JAMID_AALAM_BOUNDARY", "الله", "divine_name"), ("لَّهِ", "JAMID_AALAM_BOUNDARY", "الله", "divine_name"), ("مُحَمَّدٌ", "JAMID_AALAM_BOUNDARY", "محمد", "prophet_name"), ("مَكَّةَ", "JAMID_AALAM_BOUNDARY", "مكة", "place_name"),
    ("كَاتِبٌ", "JAMID_AALAM_OPEN", None, None), ("يَكْتُبُ", "JAMID_AALAM_OPEN", None, None), ("دَيْنٌ", "JAMID_AALAM_OPEN", None, None), ("عَدْلٌ", "JAMID_AALAM_OPEN", None, None), ("حَجَرٌ", "JAMID_AALAM_OPEN", None, None), ("جَبَلٌ", "JAMID_AALAM_OPEN", None, None), ("", "JAMID_AALAM_OPEN", None, None), (None, "JAMID_AALAM_OPEN", None, None),
]


@case(f"SELECT host, verdict, identity, kind, verdict = 'JAMID_AALAM_BOUNDARY' AS blocks_root_path FROM {sql.values(NAMED, 'host, verdict, identity, kind')} AS t")
def process_jamid_aalam(spark, sf_dir):
    d = spark.createDataFrame([(r[0],) for r in NAMED], "host string")
    return d.withColumn("x", lookup.proper_name(F.col("host"))).select("host", "x.verdict", "x.identity", "x.kind", "x.blocks_root_path")


# Surface, group, operator, purpose of some catalogue rows.
INVENTORY = [("إِنَّ", 1, True, "توكيد"), ("كَانَ", 10, True, ""), ("مَا زَالَ", 10, True, ""), ("ظَنَّ", 13, True, "ظن"), ("ظَنَّ", 10, True, "ظن"), ("كَذَا", 8, True, "عدد"), ("كَذَا", 0, False, "كناية"), ("هُوَ", 0, False, "")]
# Surface and structural verdict; lexical verdict, class and number of entries.
PROJECTED = [
    ("إِنَّ", "ACCEPT", "OPERATOR_BOUNDARY", "Closed Function Word", 1), ("إِنَّ", "DEFER", "OPERATOR_DEFERRED", "Closed Function Word", 1), ("إِنَّ", "BLOCK", "BLOCK", None, 0), ("كَانَ", "ACCEPT", "OPERATOR_BOUNDARY", "Verbal Operator", 1), ("مَا زَالَ", "ACCEPT", "OPERATOR_BOUNDARY", "Phrase Operator", 1),
    ("ظَنَّ", "ACCEPT", "OPERATOR_BOUNDARY", "Cognition Verb", 2), ("كَذَا", "ACCEPT", "OPERATOR_BOUNDARY", "Numerical Operator", 2), ("هُوَ", "ACCEPT", "MABNI_BOUNDARY", "Bound Nominal", 1), ("هُوَ", "DEFER", "MABNI_DEFERRED", "Bound Nominal", 1), ("كَتَبَ", "ACCEPT", "OPEN", None, 0), ("كَتَبَ", "DEFER", "OPEN", None, 0), (None, "ACCEPT", "OPEN", None, 0),
]


@case(f"SELECT surface, verdict, lexical_verdict, lexical_class, entries FROM {sql.values(PROJECTED, 'surface, verdict, lexical_verdict, lexical_class, entries')} AS t")
def project_operators(spark, sf_dir):
    words = spark.createDataFrame([r[:2] for r in PROJECTED], "surface string, verdict string")
    return lookup.project_entries(words, spark.createDataFrame(INVENTORY, "surface_vocalized string, group_number int, is_operator boolean, purpose string")).drop("purposes")


# Host; owner, match, form, word class and the forms that collide.
FUNCTIONAL = [
    ("الَّذِي", "MABNI_BOUNDARY", "VOCALIZED", "الَّذِي", "ISM", ""), ("هُوَ", "MABNI_BOUNDARY", "VOCALIZED", "هُوَ", "ISM", ""), ("لِمَا", "OPERATOR_BOUNDARY", "VOCALIZED", "لِمَا", "HARF", ""), ("مِنْ", "OPERATOR_BOUNDARY", "VOCALIZED", "مِنْ", "HARF", ""), ("كَمْ", "MABNI_BOUNDARY", "VOCALIZED", "كَمْ", "ISM", ""), ("هو", "MABNI_BOUNDARY", "BARE", "هُوَ", "ISM", ""),
    ("من", None, "COLLISION", "من", "", "مِنْ مَنْ"), ("أنت", None, "COLLISION", "أنت", "", "أَنْتَ أَنْتِ"), ("إنّ", "OPERATOR_BOUNDARY", "BARE", "إِنَّ", "HARF", ""), ("إن", "OPERATOR_BOUNDARY", "BARE", "إِنْ", "HARF", ""), ("همّا", "MABNI_BOUNDARY", "BARE", "هُمَا", "ISM", ""),
    ("وَهُوَ", "OPERATOR_BOUNDARY", "COMPOUND", "هُوَ", "HARF", ""), ("وَلِمَا", "OPERATOR_BOUNDARY", "COMPOUND", "لِمَا", "HARF", ""), ("فَوَهُوَ", "OPERATOR_BOUNDARY", "COMPOUND", "وَهُوَ", "HARF", ""), ("وَفَوَبِهُوَ", "OPERATOR_BOUNDARY", "COMPOUND", "فَوَبِهُوَ", "HARF", ""), ("وهو", "OPERATOR_BOUNDARY", "COMPOUND", "هُوَ", "HARF", ""),
    ("وأنت", None, None, None, None, None), ("كَتَبَ", None, None, None, None, None), ("الذي", None, None, None, None, None), ("", None, None, None, None, None), (None, None, None, None, None, None),
]
OPERATORS = [(1, "مِنْ", "حروف الجر", True, "operators"), (2, "إِنَّ", "إن وأخواتها", True, "operators"), (3, "إِنْ", "أدوات الشرط", True, "operators"), (4, "كَيْفَ", "استفهام", True, "operators")]


@case(f"SELECT * FROM {sql.values(FUNCTIONAL, 'host, owner, match_type, matched_form, word_class, candidates')} AS t")
def lookup_functional(spark, sf_dir):
    words = spark.createDataFrame([(r[0],) for r in FUNCTIONAL], "host string")
    index = spark.createDataFrame(OPERATORS, functional.INDEX).unionByName(functional.supplement(spark))
    return functional.lookup(words, index).select("host", "owner", "match_type", "matched_form", "word_class", F.array_join("candidates", " ").alias("candidates"))
