"""Syllable slots: a fold of a word's phones over the slot grammar, and the word gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arabic import LETTER, MARK, SHORT, TANWIN, phones

#: Fixed values: (open slot, element) -> slot; everything else closes or breaks the slot.
STEPS = {("", "C"): "C", ("C", "V"): "CV", ("CV", "V"): "CVV", ("CV", "C"): "CVC", ("CVV", "C"): "CVVC", ("CVC", "C"): "CVCC", ("CVVC", "C"): "CVVCC"}
WHOLE = ["CV", "CVV", "CVC", "CVVC", "CVCC", "CVVCC"]


def classes(c: Column) -> Column:
    """One letter a phone: M moved by a short vowel, A alef, V other vowel letter, S without a vowel; W and F alefs that carry no sound."""
    vowel = f"[{SHORT}{TANWIN}]"
    s = F.array_join(phones(c), ";")
    s = F.concat(s, F.lit(";"))
    s = F.regexp_replace(s, f"ا{MARK}*;", "A")
    s = F.regexp_replace(s, f"ى{MARK}*;", "V")
    s = F.regexp_replace(s, f"{LETTER}[^;]*{vowel}[^;]*;", "M")
    s = F.regexp_replace(s, f"[وي]{MARK}*;", "V")
    s = F.replace(F.regexp_replace(s, f"{LETTER}{MARK}*;", "S"), F.lit(";"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(s, "^AS", "WS"), "M([VA])A$", "M$1F")


def slots(cls: Column) -> Column:
    """The slots' patterns, joined by blanks; cls as classes() gives it."""

    def step(acc, x):
        open_ = F.element_at(F.split(acc, " ", -1), -1)
        element = F.when(x == "S", "C").otherwise("V")
        to = F.lit(None).cast("string")
        for (a, e), b in STEPS.items():
            to = F.when((open_ == a) & (element == e), b).otherwise(to)
        head = F.left(acc, F.length(acc) - F.length(open_))
        shut = F.when(open_ == "", acc).otherwise(F.concat(acc, F.lit(" ")))
        return (
            F.when(x == "M", F.concat(shut, F.lit("CV")))
            .when(x.isin("W", "F"), F.concat(shut, x, F.lit(" ")))
            .when(to.isNotNull(), F.concat(head, to))
            .when(x == "S", F.concat(shut, F.lit("C")))
            .otherwise(F.concat(acc, F.lit("+V")))
        )

    return F.trim(F.aggregate(F.array_remove(F.split(cls, ""), ""), F.lit(""), step))


def word_gate(patterns: Column) -> Column:
    """BLOCK over DEFER over ACCEPT; a word without slots defers."""
    p = F.split(patterns, " ")
    return (
        F.when(patterns == "", "DEFER")
        .when(F.exists(p, lambda x: ~x.isin(*WHOLE, "C", "W", "F")), "BLOCK")
        .when(F.array_contains(p, "C"), "DEFER")
        .otherwise("ACCEPT")
    )
