"""Rule catalogues from JSON and CSV files, checked against their contracts while they are read.

Catalogues are small (tens of rows); their faults are collected as rows, and a catalogue
with a fault is refused with the first few of them. Paths go to Spark's readers only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..operators.lookup import first_wins


class CatalogError(ValueError):
    """A catalogue that breaks its contract."""


@dataclass(frozen=True)
class Contract:
    """Where the entries are, their id, the fields they must have and the values they may have."""

    entries: str
    id: str
    schema: str
    required: tuple[str, ...]
    allowed: dict[str, tuple] = field(default_factory=dict)
    active_only: bool = False


_CELL = "array<struct<role:string,vowel:string,letter:string,geminate_of:string>>"
# The catalogues' fields and admitted values.
WAZN = Contract(
    "awzan", "wazn_id",
    f"wazn_id string, pattern string, root_arity int, family string, applicable_surface_classes array<string>, root_slots array<string>, licensed_ziyadah_slots array<string>, licensed_shadda_behavior array<string>, licensed_weak_operations array<string>, evidence_rank int, source string, template {_CELL}",
    ("wazn_id", "pattern", "root_arity", "family", "applicable_surface_classes", "root_slots", "licensed_ziyadah_slots", "licensed_shadda_behavior", "licensed_weak_operations", "evidence_rank", "source", "template"),
    {"root_arity": (3, 4)},
)
BAB = Contract(
    "abwab", "bab_id",
    "bab_id string, family string, past_pattern string, imperfect_pattern string, past_wazn_id string, past_ayn_vowel string, imperfect_ayn_vowel string, root_class_constraints array<string>, required_surface_evidence array<string>, verbal_only boolean, license_status string, evidence_rank int, example_verb string",
    ("bab_id", "family", "past_pattern", "imperfect_pattern", "past_wazn_id", "past_ayn_vowel", "imperfect_ayn_vowel", "required_surface_evidence", "verbal_only", "license_status", "evidence_rank"),
    {"family": ("MUJARRAD", "MAZID"), "past_ayn_vowel": ("a", "i", "u"), "imperfect_ayn_vowel": ("a", "i", "u")},
)
MASDAR = Contract(
    "masadir", "masdar_id",
    "masdar_id string, bab_id string, wazn_id string, family string, masdar_pattern string, source_type string, verbal_only boolean, license_status string, evidence_required array<string>, notes string",
    ("masdar_id", "family", "source_type"),
    {"source_type": ("SAMI3I_REQUIRED", "STRUCTURAL_INFERENCE", "LEXICAL_LICENSED")},
    active_only=True,
)
MUSHTAQ = Contract(
    "mushtaqat", "entry_id",
    "entry_id string, mushtaq_type string, wazn_family string, pattern string, source_type string, transitivity_constraint string, verbal_only boolean, license_status string, evidence_required array<string>, notes string",
    ("entry_id", "mushtaq_type", "wazn_family", "source_type"),
    active_only=True,
)
FUNCTION_WORDS = Contract("words", "normalized", "normalized string, surface_canonical string, word_class string, kind string, root_eligible boolean, note string", ("normalized", "word_class", "kind", "root_eligible"))
ROLES, VOWELS, ROOT_ROLES = ("FA", "AIN", "LAM", "FOURTH", "ZIYADAH"), ("FATHA", "DAMMA", "KASRA", "SUKUN", "FINAL", "MATER", "ANY"), ("FA", "AIN", "LAM", "FOURTH")


def faults(rows: DataFrame, contract: Contract) -> DataFrame:
    """(id, fault): missing fields, values that are not admitted, repeated ids."""
    checks: list[Column] = [F.when(F.col(c).isNull(), F.lit(f"missing field {c}")) for c in contract.required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*ok), F.concat(F.lit(f"bad {c}: "), F.col(c).cast("string"))) for c, ok in contract.allowed.items()]
    found = rows.select(F.col(contract.id).alias("id"), F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("fault"))
    again = rows.groupBy(F.col(contract.id).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("fault"))
    return found.unionByName(again)


def template_faults(rows: DataFrame) -> DataFrame:
    """(id, fault) of pattern templates: roles, one of letter and geminate_of in an added letter, radicals in order and as many as the arity."""
    t, bad = F.col("template"), lambda test, text: F.when(test, F.lit(text))
    added = lambda c: c["role"] == "ZIYADAH"
    radicals = F.transform(F.filter(t, lambda c: ~added(c)), lambda c: c["role"])
    checks = F.array(
        bad(F.size(t) < 1, "empty template"),
        bad(F.exists(t, lambda c: ~F.coalesce(c["role"].isin(*ROLES), F.lit(False))), "bad cell role"),
        bad(F.exists(t, lambda c: ~F.coalesce(c["vowel"], F.lit("ANY")).isin(*VOWELS)), "bad vowel"),
        bad(F.exists(t, lambda c: added(c) & (c["letter"].isNotNull() == c["geminate_of"].isNotNull())), "an added letter needs one of letter and geminate_of"),
        bad(F.exists(t, lambda c: added(c) & c["geminate_of"].isNotNull() & ~c["geminate_of"].isin(*ROOT_ROLES)), "geminate_of must name a radical"),
        bad(radicals != F.slice(F.array(*[F.lit(r) for r in ROOT_ROLES]), F.lit(1), F.col("root_arity")), "radicals are not in order or not as many as the arity"),
    )
    return rows.select(F.col("wazn_id").alias("id"), F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("fault"))


def entries(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The raw entries of a JSON catalogue ({key: [entry, ...]}), typed; a file without the key gives none."""
    inner = ", ".join(_field(x) for x in _fields(contract.schema))
    doc = spark.read.schema(f"{contract.entries} array<struct<{inner}>>").json(path, multiLine=True)
    return doc.select(F.explode(contract.entries).alias("e")).select("e.*")


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def _field(text: str) -> str:
    name, kind = text.split(" ", 1)
    return f"{name}: {kind}"


def load(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The checked entries; raises CatalogError with the first faults."""
    rows = entries(spark, path, contract)
    found = faults(rows, contract)
    if contract is WAZN:
        found = found.unionByName(template_faults(rows))
    bad = found.orderBy("id", "fault").limit(5).collect()  # a message's worth
    if bad or (contract is WAZN and rows.isEmpty()):
        raise CatalogError("; ".join(f"{r['id']}: {r['fault']}" for r in bad) or f"no entries in {contract.entries}")
    return rows.where(F.coalesce("license_status", F.lit("ACTIVE")) == "ACTIVE") if contract.active_only else rows


def load_wazn_catalog(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, WAZN)


def load_bab_catalog(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, BAB)


def load_masdar_catalog(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, MASDAR)


def load_mushtaq_catalog(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, MUSHTAQ)


def load_function_words(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, FUNCTION_WORDS)


def load_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A rule registry, one JSON object a line; lines that are no objects are refused."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = rows.select(*rows.columns).where("_bad IS NOT NULL").limit(1).collect()
    if bad:
        raise CatalogError(f"not a rule: {bad[0]['_bad'][:200]}")
    return rows.drop("_bad")


MABNI_FIELDS = ["mabni_id", "surface_vocalized", "surface_bare", "surface_kind", "lexical_class", "lexical_family", "source_file", "source_record_id", "blocks_root_path", "contract_state", "estimated_form", "attachment_type", "notes"]
OPERATOR_FIELDS = ["Operator", "Arabic Group Name", "English Group Name", "Group Number", "Purpose/Usage", "is_operator"]


def _csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, schema=", ".join(f"`{n}` string" for n in names), enforceSchema=False, multiLine=True)


def load_mabni_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the closed-class catalogue with their number (of the file's order)."""
    return _csv(spark, path, MABNI_FIELDS).withColumn("nr", F.monotonically_increasing_id())


def load_operators(spark: SparkSession, path: str) -> DataFrame:
    """surface, group_ar, group_en, group_number, purpose of the rows that are operators and have a surface."""
    rows = _csv(spark, path, OPERATOR_FIELDS)
    rows = rows.where(F.coalesce(F.lower(F.trim("is_operator")), F.lit("true")).isin("true", "1", "yes") & (F.trim("Operator") != ""))
    names = ["surface", "group_ar", "group_en", "group_number", "purpose"]
    return rows.select(*[F.trim(F.col(f"`{a}`")).alias(b) for a, b in zip(OPERATOR_FIELDS, names, strict=False)])


def mabni_indexes(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """by_vocalized, by_bare and by_id: one row a key, the first in order; latent and empty surfaces are in by_id alone."""
    overt = rows.where((F.col("surface_kind") != "LATENT") & (F.trim("surface_vocalized") != ""))
    overt = overt.withColumn("key_v", ar.nfc(F.col("surface_vocalized"))).withColumn("key_b", ar.strip_key(F.col("key_v")))
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "mabni_id"]), "nr")
    return first_wins(overt, "key_v", "nr"), first_wins(overt, "key_b", "nr"), rows.groupBy("mabni_id").agg(last.alias("r")).select("mabni_id", "r.*")


def get_all_rows(rows: DataFrame) -> DataFrame:
    return rows.drop("nr")


def get_by_id(rows: DataFrame, mabni_id: str) -> DataFrame:
    """The row of an id, the last one where the id is repeated."""
    return mabni_indexes(rows)[2].where(F.col("mabni_id") == mabni_id)


def get_all_overt_surfaces(rows: DataFrame) -> DataFrame:
    """surface: bare keys of all rows but latent ones."""
    return mabni_indexes(rows)[1].select(F.col("key_b").alias("surface"))
