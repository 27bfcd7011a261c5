"""Catalogue look-ups: exact, by bare key with collisions, longest suffix and prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions import glyphs
from ..functions.arabic import nfc, strip_diacritics, strip_key
from ..functions.binding import let


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, that of the least order; a sort-free aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def cascade(words: DataFrame, catalogue: DataFrame) -> DataFrame:
    """surface -> tier (EXACT, BARE, COLLISION, NONE) and owner. catalogue: vocalised, owner; keys are made single rows before any join."""
    exact = catalogue.groupBy(F.col("vocalised").alias("k1")).agg(F.min("owner").alias("exact_owner"))
    bare = catalogue.groupBy(strip_diacritics(F.col("vocalised")).alias("k2")).agg(F.count_distinct("vocalised").alias("forms"), F.min("owner").alias("bare_owner"))
    w = words.withColumn("bare", strip_diacritics(F.col("surface")))
    j = w.join(exact, w["surface"] == exact["k1"], "left").join(bare, w["bare"] == bare["k2"], "left")
    tier = F.when(F.col("k1").isNotNull(), "EXACT").when(F.col("forms") == 1, "BARE").when(F.col("forms") > 1, "COLLISION").otherwise("NONE")
    owner = F.when(F.col("k1").isNotNull(), F.col("exact_owner")).when(F.col("forms") == 1, F.col("bare_owner"))
    return j.select(*words.columns, tier.alias("tier"), owner.alias("owner"))


def longest_affix(c, affixes: list[str], least_rest: int, end: bool):
    """The longest affix that leaves enough letters, or null; a literal chain, no join."""
    out = F.lit(None).cast("string")
    for a in sorted(affixes, key=lambda a: (len(a), a)):
        hit = (c.endswith(a) if end else c.startswith(a)) & (F.length(c) - len(a) >= least_rest)
        out = F.when(hit, a).otherwise(out)
    return out


def closed_class(words: DataFrame, by_vocalized: DataFrame, by_bare: DataFrame) -> DataFrame:
    """words (surface, verdict) with the catalogue's row under three-valued verdicts: a match never lifts a verdict.

    MABNI_BLOCKED where the word is blocked (the catalogue is not asked), MABNI_BOUNDARY and
    MABNI_DEFERRED on a match, else MABNI_NOT_FOUND. The vocalised key is tried first; the
    bare key only where no given mark contradicts the catalogue's. Catalogues are small and
    are sent to all tasks by their size; null and blank words are not found.
    """
    kept = ["mabni_id", "surface_kind", "lexical_class", "lexical_family", "blocks_root_path", "contract_state", "source_file", "surface_vocalized"]
    row = lambda df, key, name: df.select(F.col(key).alias(f"k_{name}"), F.struct(*kept).alias(name))
    w = words.withColumn("k", F.when(F.trim("surface") != "", nfc(F.col("surface")))).withColumn("kb", strip_key(F.col("k")))
    j = w.join(row(by_vocalized, "key_v", "v"), F.col("k") == F.col("k_v"), "left").join(row(by_bare, "key_b", "b"), F.col("kb") == F.col("k_b"), "left")
    hit = F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("b").isNotNull() & glyphs.marks_fit(F.col("k"), F.col("b")["surface_vocalized"]), F.col("b"))
    j = j.withColumn("hit", F.when(F.col("verdict") != "BLOCK", hit))
    found = F.col("hit").isNotNull()
    mabni = F.when(F.col("verdict") == "BLOCK", "MABNI_BLOCKED").when(found & (F.col("verdict") == "ACCEPT"), "MABNI_BOUNDARY").when(found, "MABNI_DEFERRED").otherwise("MABNI_NOT_FOUND")
    blocks = found & (F.lower(F.coalesce(F.col("hit.blocks_root_path"), F.lit("true"))) == "true")
    return j.select(*words.columns, mabni.alias("mabni_verdict"), "hit.mabni_id", "hit.surface_kind", "hit.lexical_class", "hit.lexical_family", blocks.alias("blocks_root_path"), "hit.contract_state", F.col("hit.surface_vocalized").alias("matched_surface"), "hit.source_file")


def by_key(rows: DataFrame, catalogue: DataFrame, keys: dict[str, str], how: str = "left") -> DataFrame:
    """rows beside the catalogue's entries of equal keys (row's column -> entry's column), entries as the struct entry.

    One operator for every look-up by id: verb classes by pattern or by both vowels, verbal
    nouns by verb class, derivatives by pattern family, rules by form family. Null keys match
    nothing; several entries give several rows; clashing names stay apart in the struct.
    """
    c = catalogue.select(*[F.col(e).alias(f"_key{n}") for n, e in enumerate(keys.values())], F.struct(*catalogue.columns).alias("entry"))
    on = [rows[r] == c[f"_key{n}"] for n, r in enumerate(keys)]
    return rows.join(c, on, how).drop(*[f"_key{n}" for n in range(len(keys))])


def one_entry(rows: DataFrame, catalogue: DataFrame, keys: dict[str, str], order: str) -> DataFrame:
    """by_key with at most one entry a key, that of the least order."""
    rest = [c for c in catalogue.columns if c not in keys.values()]
    single = catalogue.groupBy(*keys.values()).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys.values(), "r.*")
    return by_key(rows, single, keys)


def rules_for(rules: DataFrame, form_family: str, **equal: str) -> DataFrame:
    """Rules that name a form family among theirs (or name none), and equal the given fields."""
    out = rules.where(F.array_contains("form_families", form_family) | (F.coalesce(F.size("form_families"), F.lit(0)) <= 0))
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def inventory_stats(catalogue: DataFrame, group: str) -> DataFrame:
    """group, rows, surfaces (distinct vocalised) of a catalogue."""
    return catalogue.groupBy(group).agg(F.count("*").alias("rows"), F.count_distinct("surface_vocalized").alias("surfaces"))


# Proper names by their key (vowels off, doubling kept): identity and kind.
NAMES = {
    "اللّه": ("الله", "divine_name"), "لّه": ("الله", "divine_name"), "ابراهيم": ("إبراهيم", "prophet_name"), "اسماعيل": ("إسماعيل", "prophet_name"), "يعقوب": ("يعقوب", "prophet_name"), "محمد": ("محمد", "prophet_name"),
    "موسى": ("موسى", "prophet_name"), "عيسى": ("عيسى", "prophet_name"), "مكة": ("مكة", "place_name"), "مدينة": ("مدينة", "place_name"), "بغداد": ("بغداد", "place_name"),
}
NAME_CATEGORY = "اسم علم"
# Groups of the operator catalogue that hold verbs, verbs of cognition, and numbers.
VERBAL_GROUPS, COGNITION_GROUP, NUMBER_GROUP = (10, 11, 12), 13, 8


def proper_name(host: Column) -> Column:
    """struct(verdict, matched_key, identity, category, kind, blocks_root_path): JAMID_AALAM_BOUNDARY closes the root path, JAMID_AALAM_OPEN leaves it open. Null and empty hosts are open."""
    marks = ar.TANWIN + ar.SHORT + ar.SUKUN + ar.DAGGER
    named = lambda pairs: F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("identity"), F.lit(x[1]).alias("kind")) for kv in pairs for x in kv])
    bare = {k.replace(ar.SHADDA, ""): v for k, v in NAMES.items()}
    key = F.regexp_replace(host, f"[{marks}]", "")

    def of(k, hit):
        found = hit.isNotNull()
        return F.struct(
            F.when(found, "JAMID_AALAM_BOUNDARY").otherwise("JAMID_AALAM_OPEN").alias("verdict"),
            F.when(found, k).alias("matched_key"),
            hit["identity"].alias("identity"),
            F.when(found, NAME_CATEGORY).alias("category"),
            hit["kind"].alias("kind"),
            found.alias("blocks_root_path"),
        )

    return let(key, lambda k: let(F.coalesce(F.element_at(named(NAMES.items()), k), F.element_at(named(bare.items()), F.replace(k, F.lit(ar.SHADDA), F.lit("")))), lambda hit: of(k, hit)))


def entries_class(entries: Column) -> Column:
    """The lexical class that a word's catalogue entries state together. entries: array of struct(group_number, is_operator, surface_vocalized)."""
    verbal = (F.size(entries) > 0) & F.forall(entries, lambda e: e["group_number"].isin(*VERBAL_GROUPS))
    return (
        F.when(F.exists(entries, lambda e: e["group_number"] == COGNITION_GROUP), "Cognition Verb")
        .when(verbal & F.exists(entries, lambda e: e["surface_vocalized"].contains(" ")), "Phrase Operator")
        .when(verbal, "Verbal Operator")
        .when(F.exists(entries, lambda e: (e["group_number"] == NUMBER_GROUP) & e["is_operator"]), "Numerical Operator")
        .when(F.exists(entries, lambda e: e["is_operator"]), "Closed Function Word")
        .otherwise("Bound Nominal")
    )


def entries_verdict(entries: Column, structural: Column) -> Column:
    """The lexical verdict under the structural one: BLOCK stays, no entry is OPEN, and a deferred word is never lifted to a boundary."""
    kind = F.when(F.exists(entries, lambda e: e["is_operator"]), "OPERATOR").otherwise("MABNI")
    found = F.coalesce(F.size(entries), F.lit(0)) > 0
    return F.when(structural == "BLOCK", "BLOCK").when(~found, "OPEN").otherwise(F.concat(kind, F.when(structural == "DEFER", "_DEFERRED").otherwise("_BOUNDARY")))


def project_entries(words: DataFrame, inventory: DataFrame) -> DataFrame:
    """words (surface, verdict) with lexical_verdict, lexical_class, entries and purposes of the inventory's rows of the same surface.

    inventory: surface_vocalized, group_number, is_operator, purpose. It is grouped to one
    row a surface before the join, so a word stays one row; repeated words are looked up
    each, null and unlisted surfaces are OPEN without a class, and blocked words are not
    looked up at all.
    """
    each = F.struct(F.col("group_number"), F.col("is_operator"), F.col("surface_vocalized"), F.col("purpose"))
    single = inventory.groupBy(F.col("surface_vocalized").alias("_key")).agg(F.array_sort(F.collect_list(each)).alias("_entries"))
    j = words.join(single, (words["surface"] == single["_key"]) & (words["verdict"] != "BLOCK"), "left")
    e = F.col("_entries")
    purposes = F.array_distinct(F.filter(F.transform(e, lambda x: x["purpose"]), lambda p: p != ""))
    return j.select(*words.columns, entries_verdict(e, F.col("verdict")).alias("lexical_verdict"), F.when(e.isNotNull(), entries_class(e)).alias("lexical_class"), F.coalesce(F.size(e), F.lit(0)).alias("entries"), F.coalesce(purposes, F.array().cast("array<string>")).alias("purposes"))
