"""Typed slots of an analysed word, taken from its result columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MABNI_CLASSES = ["MABNI", "MABNI_ISM"]


def filled(slot_id: str, sort: str, value: Column, otherwise: str) -> Column:
    """struct(slot_id, sort, state, value): FILLED with a value, else the state named."""
    return F.struct(F.lit(slot_id).alias("slot_id"), F.lit(sort).alias("sort"), F.when(value.isNotNull(), "FILLED").otherwise(otherwise).alias("state"), value.cast("string").alias("value"))


def article_slots(has_article: Column, solar: Column) -> Column:
    """The article and its assimilation; without an article neither applies."""
    has = F.coalesce(has_article, F.lit(False))
    return F.array(filled("ARTICLE_SLOT", "ARTICLE", F.when(has, "AL"), "NOT_APPLICABLE"), filled("SOLAR_ASSIMILATION_SLOT", "ARTICLE", F.when(has & F.coalesce(solar, F.lit(False)), "SOLAR"), "NOT_APPLICABLE"))


def boundary_slots(boundary: Column, word_class: Column, clitic_only: Column) -> Column:
    """The closed boundary and the way on: a boundary, or a word of clitics alone, blocks the way to a root."""
    kind = F.when((boundary == "OPERATOR_BOUNDARY") | (word_class == "OPERATOR"), "OPERATOR_BOUNDARY").when((boundary == "MABNI_BOUNDARY") | word_class.isin(MABNI_CLASSES), "MABNI_BOUNDARY").when(boundary == "JAMID_AALAM_BOUNDARY", "JAMID_AALAM_BOUNDARY")
    shut = kind.isNotNull() | F.coalesce(clitic_only, F.lit(False))
    path = F.struct(F.lit("PATH_DIRECTIVE_SLOT").alias("slot_id"), F.lit("BOUNDARY").alias("sort"), F.when(shut, "BLOCKED").otherwise("FILLED").alias("state"), F.when(shut, "ROOT_PATH_BLOCKED").otherwise("OPEN_MORPHOLOGY").alias("value"))
    return F.array(filled("BOUNDARY_TYPE_SLOT", "BOUNDARY", kind, "NOT_APPLICABLE"), path)


def word_class_slot(word_class: Column) -> Column:
    return filled("WORD_CLASS_SLOT", "WORD_CLASS", F.when(word_class != "", word_class), "UNKNOWN")


def root_parts(root: Column) -> Column:
    """Radicals of a root written with hyphens, with blanks or together."""
    parts = F.when(root.contains("-"), F.split(root, "-")).when(root.contains(" "), F.split(root, " +")).otherwise(F.split(root, ""))
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")
