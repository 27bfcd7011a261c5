"""Word class by an ordered list of decisions: the first that applies wins, and says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions.binding import let
from . import patterns, segmentation, tense

VERBAL = [w for _, w, family in patterns.WAZN if family.endswith("_verb")]


def classify(c: Column, gate: Column) -> Column:
    """struct(word_class, reason): ISM, FI3L, HARF, or null where the gate blocks."""

    def decide(seg, host, fits, verbs, when):
        return (
            F.when(gate == "BLOCK", "UPSTREAM_BLOCK")
            .when(seg["route"] == "OPERATOR", "OPERATOR")
            .when(seg["route"] == "PROTECTED", "CLOSED_CLASS")
            .when(seg["article"].isNotNull(), "ARTICLE")
            .when(c.rlike(f"[{ar.TANWIN}]"), "TANWIN")
            .when(ar.strip_diacritics(host).endswith("ة"), "TAA_MARBUTA")
            .when(when == "IMPERFECT", "IMPERFECT_PREFIX")
            .when(when == "IMPERATIVE", "IMPERATIVE_SHAPE")
            .when((F.size(fits) > 0) & (verbs == F.size(fits)), "VERBAL_PATTERN")
            .when((F.size(fits) > 0) & (verbs == 0), "NOMINAL_PATTERN")
            .when(F.size(fits) > 0, "AMBIGUOUS_PATTERN")
            .otherwise("NO_PATTERN")
        )

    def kind(reason):
        verbal = reason.isin("IMPERFECT_PREFIX", "IMPERATIVE_SHAPE", "VERBAL_PATTERN", "AMBIGUOUS_PATTERN")
        return F.struct(F.when(reason == "OPERATOR", "HARF").when(verbal, "FI3L").when(reason != "UPSTREAM_BLOCK", "ISM").alias("word_class"), reason.alias("reason"))

    def of_host(seg, host):
        return let(patterns.fits(host), lambda fits: let(F.size(F.filter(fits, lambda x: x["wazn_id"].isin(*VERBAL))), lambda verbs: let(tense.tense(host), lambda when: let(decide(seg, host, fits, verbs, when), kind))))

    return let(segmentation.segment(c), lambda seg: let(seg["host"], lambda host: of_host(seg, host)))


# Catalogue classes by the word class they state, and subclasses by catalogue class and derivative.
HARF_CLASSES = {"Closed Function Word": "CLOSED_FUNCTION_WORD", "Numerical Operator": "NUMERICAL_OPERATOR"}
VERB_CLASSES = ["Verbal Operator", "Phrase Operator", "Cognition Verb"]
BOUNDARIES = ["OPERATOR_BOUNDARY", "MABNI_BOUNDARY", "OPERATOR_DEFERRED", "MABNI_DEFERRED"]
MABNI_SUBCLASS = {
    "DETACHED_PRONOUN": "PRONOUN", "ATTACHED_PRONOUN": "PRONOUN", "DEMONSTRATIVE": "DEMONSTRATIVE", "RELATIVE": "RELATIVE", "RELATIVE_PRONOUN": "RELATIVE",
    "INTERROGATIVE_NOUN": "INTERROGATIVE_NOUN", "INTERROGATIVE_NAME": "INTERROGATIVE_NOUN", "CONDITIONAL_NOUN": "CONDITIONAL_NOUN", "CONDITIONAL_NAME": "CONDITIONAL_NOUN", "JAZM_NAME": "CONDITIONAL_NOUN",
    "ADVERBIAL_MABNI": "ADVERBIAL_MABNI", "VERB_NAME": "VERB_NAME", "NON_VERBAL_SURFACE": "LEXICAL_NOUN",
}
DERIVATIVE_SUBCLASS = {
    "ISM_FA3IL": "ISM_FA3IL", "ISM_MAF3UL": "ISM_MAF3UL", "SIFA_MUSHABBAHA": "SIFA_MUSHABBAHA", "SIYAG_MUBALAGHAH": "MUBALGHA", "MUBALGHA": "MUBALGHA",
    "ISM_ZAMAN": "ISM_ZAMAN_MAKAN", "ISM_MAKAN": "ISM_ZAMAN_MAKAN", "ISM_ZAMAN_MAKAN": "ISM_ZAMAN_MAKAN", "ISM_ALA": "ISM_ALA", "TAFDHIL": "SIFA_MUSHABBAHA",
}
TENSE_SUBCLASS = {"IMPERFECT": "VERBAL_IMPERFECT", "IMPERATIVE": "VERBAL_IMPERATIVE", "PAST": "VERBAL_PAST"}
#: The evidence that a request brings, with what stands for none; a missing or null column counts as none.
REQUEST = {
    "surface": "", "normalized": "", "lexical_verdict": "OPEN", "lexical_class": "", "mabni_status": "open", "path": "", "masdar_accepted": False, "derivative_type": "",
    "verbal_host": False, "bab_id": "", "wazn_id": "", "bab_tried": False, "attachment_route": "", "mabni_class": "",
}


def _named(c: Column, names: dict[str, str]) -> Column:
    """The value that a fixed table gives for c, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def mabni_id_of_note(notes: Column) -> Column:
    """The closed-class id that an attachment's note names, or the empty string."""
    return F.trim(F.regexp_extract(F.coalesce(notes, F.lit("")), "(?s)whole-token match: (.*)$", 1))


def decide(requests: DataFrame) -> DataFrame:
    """requests with word_class_verdict, word_class, subclass, reason, evidence and confidence: the first rule that applies decides.

    Columns are those of REQUEST: the surface as written and in normal form, the lexical
    layer's verdict and class, the morphology path, an accepted verbal noun or derivative
    type, a licensed verbal host with its class, an accepted pattern, and the closed class
    of an attachment (from the catalogue, by its id). A blocked word has no class, a word
    without any evidence is deferred; rows never meet, so repeats and ties need no rule.
    """
    c = {k: F.coalesce(F.col(k), F.lit(v)) if k in requests.columns else F.lit(v) for k, v in REQUEST.items()}
    path, bound = c["path"], c["lexical_verdict"].isin(BOUNDARIES)
    verbal_path = path.isin("verbal_root_path", "ambiguous_morphology_path")
    by_tense = F.coalesce(_named(tense.tense(c["normalized"]), TENSE_SUBCLASS), F.lit("VERBAL_PAST"))
    letter = f"{ar.LETTER}{ar.MARK}*"
    elative = (c["bab_id"] == "BAB_FORM_IV") & (c["wazn_id"] == "AF3AL") & c["normalized"].rlike(f"^{letter}{letter}{ar.LETTER}{ar.MARK}*{ar.FATHA}") & c["normalized"].endswith(ar.DAMMA)
    open_pattern = (path == "ambiguous_morphology_path") & (c["wazn_id"] != "")
    host = c["verbal_host"] & verbal_path
    noun, verb = F.lit("LEXICAL_NOUN"), by_tense
    path_level = F.when(path == "verbal_root_path", "HIGH").otherwise("MEDIUM")
    rules = [  # applies, class, subclass, reason, evidence, confidence
        (bound & c["lexical_class"].isin(*HARF_CLASSES), "HARF", _named(c["lexical_class"], HARF_CLASSES), "LEXICAL_HARF_ENTRY", "LEXICAL_HARF_ENTRY", "HIGH"),
        (bound & c["lexical_class"].isin(VERB_CLASSES), "FI3L", F.lit("VERBAL_OPERATOR"), "LEXICAL_VERBAL_OPERATOR", "LEXICAL_VERBAL_OPERATOR", "HIGH"),
        (c["masdar_accepted"] & ~host, "ISM", F.lit("MASDAR"), "ACCEPTED_MASDAR", "ACCEPTED_MASDAR", "HIGH"),
        ((c["derivative_type"] != "") & path.isin("nominal_morphology_path", "derived_nominal_path"), "ISM", F.coalesce(_named(c["derivative_type"], DERIVATIVE_SUBCLASS), noun), "ACCEPTED_DERIVATIVE", "ACCEPTED_DERIVATIVE", "HIGH"),
        ((c["attachment_route"] == "MABNI_BOUNDARY") & c["mabni_class"].isin(*MABNI_SUBCLASS), "ISM", _named(c["mabni_class"], MABNI_SUBCLASS), "MABNI_BOUNDARY_ISM", "ATTACHMENT_MABNI", "HIGH"),
        (host & elative, "ISM", noun, "ELATIVE_AFAL_NOT_VERB", "MORPHOLOGY_PATH_NOMINAL", "HIGH"),
        (host, "FI3L", verb, "LICENSED_VERBAL_HOST", "LICENSED_VERBAL_HOST", path_level),
        (path == "verbal_root_path", "FI3L", verb, "VERBAL_ROOT_PATH", "MORPHOLOGY_PATH_VERBAL", "HIGH"),
        (F.coalesce(tense.tense(c["surface"]) == "IMPERATIVE", F.lit(False)), "FI3L", F.lit("VERBAL_IMPERATIVE"), "IMPERATIVE_SURFACE_SELF_EVIDENT", "MORPHOLOGY_PATH_VERBAL", "HIGH"),
        (c["surface"].rlike(f"^[وف]{ar.FATHA}ل{ar.SUKUN}"), "FI3L", F.lit("VERBAL_IMPERFECT"), "LAM_AMR_JUSSIVE_IMPERFECT", "MORPHOLOGY_PATH_VERBAL", "HIGH"),
        (open_pattern & c["surface"].startswith("ال"), "ISM", noun, "DEFINITE_ARTICLE_NOT_VERB", "MORPHOLOGY_PATH_NOMINAL", "HIGH"),
        (open_pattern & ~c["bab_tried"] & ~c["verbal_host"], "ISM", noun, "AMBIGUOUS_NO_P4B_SUPPORT", "MORPHOLOGY_PATH_NOMINAL", "MEDIUM"),
        (open_pattern, "FI3L", verb, "AMBIGUOUS_PATH_P4A_WAZN", "ROOT_PATTERN_VERBAL", "MEDIUM"),
        (path == "ambiguous_morphology_path", "ISM", noun, "AMBIGUOUS_NO_VERBAL_EVIDENCE", "MORPHOLOGY_PATH_NOMINAL", "LOW"),
        (path.isin("no_morphology_path", "") & tense.is_imperfect(c["normalized"]), "FI3L", verb, "IMPERFECT_PREFIX_NO_MORPH_PATH", "MORPHOLOGY_PATH_VERBAL", "MEDIUM"),
        (path.isin("nominal_morphology_path", "derived_nominal_path", "functional_path"), "ISM", F.when(path == "functional_path", "CLOSED_FUNCTION_WORD").otherwise(noun), "NOMINAL_MORPHOLOGY_PATH", "MORPHOLOGY_PATH_NOMINAL", "MEDIUM"),
        (path == "no_morphology_path", "ISM", noun, "NO_MORPHOLOGY_PATH_DEFAULT_ISM", "MORPHOLOGY_PATH_NOMINAL", "LOW"),
    ]
    blocked = (c["lexical_verdict"] == "BLOCK") | (c["mabni_status"] == "blocked")

    def row(verdict, word_class=None, subclass=None, reason=None, evidence=None, confidence=None):
        cells = {"word_class_verdict": verdict, "word_class": word_class, "subclass": subclass, "reason": reason, "evidence": evidence, "confidence": confidence}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v).cast("string")).alias(k) for k, v in cells.items()])

    out = F.when(blocked, row("BLOCKED", reason="UPSTREAM_BLOCK"))
    for applies, *rest in rules:
        out = out.when(applies, row("ACCEPTED", *rest))
    out = out.otherwise(row("DEFERRED", reason=F.when(path == "", "NO_MORPHOLOGY_PATH").otherwise("INSUFFICIENT_EVIDENCE")))
    return requests.withColumn("_decided", out).select(*requests.columns, "_decided.*")
