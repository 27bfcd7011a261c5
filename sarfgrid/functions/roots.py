"""Roots: the verdict on two to four radicals, and their kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def analyse_radicals(r: Column) -> Column:
    """struct(directive, reason, kind) of a string of radicals, in the order of the rules."""
    n, fa, ayn, lam = F.length(r), F.substring(r, 1, 1), F.substring(r, 2, 1), F.substring(r, 3, 1)
    weak_fa, weak_ayn, weak_lam = fa.isin("و", "ي"), ayn.isin("ا", "و"), lam.isin("ا", "ى", "ي")
    reason = (
        F.when(n < 2, "insufficient_consonants")
        .when(n == 2, "two_consonant_form_unresolved")
        .when(n == 4, "quadriliteral_beyond_scope")
        .when(n > 4, "non_standard_consonant_count")
        .when(weak_fa & weak_lam & ~weak_ayn, "lafif_mafruq_unresolved")
        .when(weak_ayn & weak_lam, "lafif_maqrun_unresolved")
        .when(weak_ayn, "hollow_underlying_radical_unresolved")
        .when(weak_lam, "defective_lam_unresolved")
        .when(weak_fa, "assimilated_fa_unresolved")
        .when(r.rlike("[اىأإؤئآ?]"), "prohibited_or_ambiguous_radical")
    )
    return F.struct(
        F.when(n < 2, "BLOCK").when(reason.isNotNull(), "DEFER").otherwise("ACCEPT").alias("directive"),
        reason.alias("reason"),
        F.when(reason.isNull(), F.when(r.contains("ء"), "hamza").when((ayn == lam) | (fa == ayn), "geminate").otherwise("sound")).alias("kind"),
    )
