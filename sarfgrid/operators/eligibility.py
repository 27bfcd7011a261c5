"""Which derivatives a verb may have: family of its pattern, transitivity of its class, and the verdict by kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern and family.
FAMILIES = [
    ("FA_A_LA", "triliteral_bare_verb"), ("FA_I_LA", "triliteral_bare_verb"), ("FA_U_LA", "triliteral_bare_verb"), ("FA3L", "triliteral_noun"), ("FI3L", "triliteral_noun"), ("FU3L", "triliteral_noun"), ("FA3IL", "active_participle"), ("MAF3UL", "passive_participle"), ("FA33AL", "intensive_noun"),
    ("FA33ALA", "form_II_verb"), ("FA3ALA", "form_III_verb"), ("AF3AL", "form_IV_verb"), ("TAFA33ALA", "form_V_verb"), ("TAFA3ALA", "form_VI_verb"), ("INFA3ALA", "form_VII_verb"), ("IFTA3ALA", "form_VIII_verb"), ("IFA3LAL", "form_IX_verb"), ("ISTAF3ALA", "form_X_verb"),
    ("MAF3AL", "noun_of_place_or_masdar"), ("MAF3IL", "noun_of_place_or_masdar"), ("MIF3AL", "instrument_noun"),
]
BARE = "triliteral_bare_verb"
AUGMENTED = [f for _, f in FAMILIES if f.startswith("form_")]
NOMINAL = ["triliteral_noun", "active_participle", "passive_participle", "intensive_noun", "noun_of_place_or_masdar", "instrument_noun", "broken_plural", "deverbal_noun"]
TRANSITIVE, INTRANSITIVE = ["BAB_FORM_II", "BAB_FORM_IV", "BAB_FORM_X"], ["BAB_FORM_V", "BAB_FORM_VI", "BAB_FORM_VII", "BAB_FORM_IX"]


def family_of(wazn_id: Column) -> Column:
    out = F.lit(None).cast("string")
    for w, f in FAMILIES:
        out = F.when(wazn_id == w, f).otherwise(out)
    return out


def transitivity_of(bab_id: Column) -> Column:
    """What a verb class states; bare classes state nothing."""
    return F.when(bab_id.isin(TRANSITIVE), "TRANSITIVE").when(bab_id.isin(INTRANSITIVE), "INTRANSITIVE").otherwise("UNKNOWN")


def eligible(kind: Column, family: Column, bab_id: Column, transitivity: Column, root_class: Column) -> Column:
    """struct(directive, reason) of a kind of derivative, by the first rule that speaks."""
    bare, transitive, intransitive, unknown = family == BARE, transitivity == "TRANSITIVE", transitivity == "INTRANSITIVE", transitivity == "UNKNOWN"
    yes = F.lit(True)
    of = lambda k, test: (kind == k) & test
    rules = [
        (family.isin(NOMINAL), "NOT_APPLICABLE", "nominal_wazn"), (family.isNull(), "DEFER", "wazn_family_unknown"), (~family.isin([BARE, *AUGMENTED]), "DEFER", "wazn_family_unclassified"),
        (of("ISM_FA3IL", yes), "ACCEPT", "fa3il_unconstrained"),
        (of("ISM_MAF3UL", ~bare), "ACCEPT", "mazid_structural_maf3ul"), (of("ISM_MAF3UL", intransitive), "BLOCK", "intransitive_verb"), (of("ISM_MAF3UL", unknown), "DEFER", "transitivity_unknown"), (of("ISM_MAF3UL", yes), "ACCEPT", "transitive_verb"),
        (of("SIFA_MUSHABBAHA", ~bare), "NOT_APPLICABLE", "augmented_not_standard_for_sifa"), (of("SIFA_MUSHABBAHA", transitive), "BLOCK", "transitive_verb"), (of("SIFA_MUSHABBAHA", unknown), "DEFER", "transitivity_unknown"), (of("SIFA_MUSHABBAHA", yes), "ACCEPT", "intransitive_stative_verb"),
        (of("SIYAG_MUBALAGHAH", ~bare), "DEFER", "mazid_not_standard_for_mubalaghah"), (of("SIYAG_MUBALAGHAH", yes), "ACCEPT", "verbal_root_form_i"),
        (of("ISM_ZAMAN", ~bare), "DEFER", "augmented_ism_zaman_masdar_based"), (of("ISM_ZAMAN", yes), "ACCEPT", "verbal_wazn_form_i"),
        (of("ISM_MAKAN", ~bare), "DEFER", "augmented_ism_makan_masdar_based"), (of("ISM_MAKAN", yes), "ACCEPT", "verbal_wazn_form_i"),
        (of("ISM_ALA", ~bare), "NOT_APPLICABLE", "augmented_not_standard_for_ism_ala"), (of("ISM_ALA", intransitive), "DEFER", "intransitive_ism_ala_unusual"), (of("ISM_ALA", unknown), "DEFER", "transitivity_unknown"), (of("ISM_ALA", yes), "ACCEPT", "transitive_form_i"),
        (of("TAFDHIL", ~bare), "NOT_APPLICABLE", "augmented_not_eligible_for_tafdhil"), (of("TAFDHIL", root_class.isin("HOLLOW", "QUADRILATERAL", "DEFECTIVE")), "NOT_APPLICABLE", F.concat(F.lit("root_class_incompatible:"), root_class)),
        (of("TAFDHIL", root_class == "UNKNOWN"), "DEFER", "root_class_ambiguous"), (of("TAFDHIL", bab_id.isNull()), "DEFER", "bab_unknown_tafdhil_ambiguous"), (of("TAFDHIL", bab_id == "BAB_FORM_IX"), "NOT_APPLICABLE", "form_ix_uses_afal_for_sifa_not_tafdhil"), (of("TAFDHIL", yes), "ACCEPT", "mujarrad_tafdhil_eligible"),
    ]
    out = F.struct(F.lit("DEFER").alias("directive"), F.concat(F.lit("unknown_mushtaq_type:"), kind).alias("reason"))
    for test, directive, reason in reversed(rules):
        out = F.when(test, F.struct(F.lit(directive).alias("directive"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))).otherwise(out)
    return out
