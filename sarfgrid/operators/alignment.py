"""A resolved root laid over a word through the pattern catalogue.

Every pattern of the root's arity is tried on every word inside the row (the catalogue is
grouped to one row an arity and meets the words by an equi-join; there is no shuffle of
pairs): each template cell must find its letter and vowel, and what follows the template
says how the word ends. One clean fit accepts; several, a feminine ending or a possible
augment defer; an impossible structure blocks. A root's own verdict is never lifted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions.binding import let
from . import patterns

# Letters that a root cannot hold, seats of hamza, letters of increase, weak radicals.
NOT_RADICAL = ["ا", "ى", "أ", "إ", "ؤ", "ئ", "آ"]
HAMZAS = ["ء", "أ", "إ", "ؤ", "ئ", "آ"]
INCREASE = ["ء", "ا", "و", "ي", "ن", "ت", "م", "س", "ل", "ه", "ى", "ة"]
WEAK = ["و", "ي"]
VOWEL_NAMES = {ar.FATHA: "FATHA", ar.DAMMA: "DAMMA", ar.KASRA: "KASRA", ar.SUKUN: "SUKUN"}
FREE = ["FINAL", "ANY", "MATER"]
SLOTS = {"FA": 1, "AIN": 2, "LAM": 3, "FOURTH": 4}
# Order of the patterns as evidence, and the pattern whose equal radicals may merge.
RANK = {
    "FA_A_LA": 10, "FA_I_LA": 12, "FA_U_LA": 14, "FA3L": 20, "FI3L": 21, "FU3L": 22, "FA3IL": 25, "MAF3UL": 26, "FA33AL": 30, "FA33ALA": 31, "AF3AL": 32, "FA3ALA": 33, "MAF3AL": 34, "MAF3IL": 35, "MIF3AL": 36,
    "INFA3ALA": 40, "IFTA3ALA": 41, "ISTAF3ALA": 42, "TAFA33ALA": 43, "TAFA3ALA": 44,
}
MERGES = ["FA_A_LA"]
MERGED, DOUBLED = "op:weak:mudaaf_gemination_idghaam", "op:ziyadah:pattern_gemination"
_CELL = "role string, vowel string, letter string, geminate_of string"


def template(pattern: str) -> list[tuple[str | None, ...]]:
    """A written pattern as cells (role, vowel, letter, geminate_of): its last radical's vowel is free, bare long vowels carry none, the second of a doubled radical is an increase."""
    names, seen, out = dict(zip(patterns.RADICALS, SLOTS, strict=False)), set(), []
    for cell in patterns.template_cells(pattern):
        role, vowel = names.get(cell[0]), VOWEL_NAMES.get(cell[1:])
        if role is None:
            out.append(("ZIYADAH", vowel or "MATER", cell[0], None))
        elif role in seen:
            out.append(("ZIYADAH", vowel, None, role))
        else:
            out.append((role, "FINAL" if role == "LAM" else vowel, None, None))
            seen.add(role)
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    """The engine's own patterns in the form that a catalogue file is read to."""
    rows = [(name, 3, ["geminate_root_idghaam"] if name in MERGES else [], RANK[name], template(pattern)) for pattern, name, _ in patterns.WAZN]
    return spark.createDataFrame(rows, f"wazn_id string, root_arity int, licensed_shadda_behavior array<string>, evidence_rank int, template array<struct<{_CELL.replace(' string', ':string')}>>")


def cells(host: Column) -> Column:
    """array of struct(base, vowel, raw): letters with their marks, hamza seats as hamza and doubled letters written out; blanks fall away."""
    raw = F.regexp_extract_all(ar.normalize_shadda(ar.normalize_hamza(host)), F.lit(f"[^ {ar.MARKS}]{ar.MARK}*"), 0)
    named = F.create_map(*[F.lit(x) for kv in VOWEL_NAMES.items() for x in kv])
    vowel = lambda x: F.element_at(named, F.nullif(F.regexp_extract(x, f"([{''.join(VOWEL_NAMES)}])", 1), F.lit("")))
    return F.transform(raw, lambda x: F.struct(F.left(x, F.lit(1)).alias("base"), vowel(x).alias("vowel"), x.alias("raw")))


def same_letter(a: Column, b: Column) -> Column:
    return (a == b) | (a.isin(HAMZAS) & b.isin(HAMZAS))


def radical_found(radical: Column, base: Column) -> Column:
    """A letter of the word as a radical; letters that a root cannot hold are never found."""
    return ~radical.isin(NOT_RADICAL) & same_letter(radical, base)


def _radical(root: Column, role: Column) -> Column:
    return F.get(root, F.element_at(F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv]), role) - 1)


def ending(rest: Column) -> Column:
    """clean, inflectional (the silent feminine t), nominal (the bound t) or reject."""
    silent = F.forall(rest, lambda x: (x["base"] == "ت") & F.coalesce(x["vowel"] == "SUKUN", F.lit(False)))
    return F.when(F.size(rest) == 0, "clean").when(silent, "inflectional").when(F.exists(rest, lambda x: x["base"] == "ة"), "nominal").otherwise("reject")


def _slot(pattern: Column, root: Column, word: Column, k: Column) -> Column:
    """struct(fault, merged) of one template cell."""

    def judged(t, letter, after, cell):
        radical = t["role"] != "ZIYADAH"
        silent = F.coalesce(cell["vowel"] == "SUKUN", F.lit(False))
        twin = F.coalesce((after["role"] != "ZIYADAH") & (_radical(root, after["role"]) == letter), F.lit(False))
        may_merge = F.array_contains(pattern["licensed_shadda_behavior"], "geminate_root_idghaam")
        letter_ok = F.when(radical, radical_found(letter, cell["base"])).otherwise(same_letter(letter, cell["base"]))
        vowel_ok = t["vowel"].isin(FREE) | F.coalesce(cell["vowel"] == t["vowel"], F.lit(False))
        merged = ~vowel_ok & radical & silent & may_merge & twin
        fault = F.when(~F.coalesce(letter_ok, F.lit(False)), "letter").when(~vowel_ok & ~merged, "vowel").when(radical & silent & (t["vowel"] == "SUKUN") & twin & ~may_merge, "merge")
        return F.struct(fault.alias("fault"), merged.alias("merged"))

    at = lambda a, n: F.get(a, n)
    cell_of = pattern["template"]
    return let(at(cell_of, k), lambda t: let(F.coalesce(t["letter"], _radical(root, F.coalesce(t["geminate_of"], t["role"]))), lambda letter: judged(t, letter, at(cell_of, k + 1), at(word, k))))


def fit(pattern: Column, root: Column, word: Column) -> Column:
    """struct(wazn_id, rank, ending, fault, merged, doubled, increase, suffix) of one pattern on one word's cells. fault: short, or the first misfit's kind."""
    n = F.size(pattern["template"])

    def whole(slots, rest):
        misfit = F.get(F.filter(F.transform(slots, lambda s: s["fault"]), lambda x: x.isNotNull()), F.lit(0))
        end = ending(rest)
        added = F.filter(F.transform(pattern["template"], lambda t, k: F.struct((t["role"] == "ZIYADAH").alias("is"), t["geminate_of"].alias("of"), F.get(word, k)["base"].alias("base"), k.alias("k"))), lambda x: x["is"])
        return F.struct(
            pattern["wazn_id"].alias("wazn_id"),
            pattern["evidence_rank"].alias("rank"),
            end.alias("ending"),
            F.when(F.size(word) < n, "short").when(misfit.isNotNull(), misfit).when(end == "reject", "trailing").alias("fault"),
            F.exists(slots, lambda s: s["merged"]).alias("merged"),
            F.exists(pattern["template"], lambda t: t["geminate_of"].isNotNull()).alias("doubled"),
            F.transform(added, lambda x: F.when(x["of"].isNotNull(), F.concat(F.lit("ziyadah:gemination_of_"), x["of"])).otherwise(F.concat(F.lit("ziyadah:"), x["base"], F.lit("@"), x["k"]))).alias("increase"),
            F.when(end == "inflectional", F.transform(rest, lambda x: x["raw"])).otherwise(F.array().cast("array<string>")).alias("suffix"),
        )

    slots = F.transform(F.sequence(F.lit(0), n - 1), lambda k: _slot(pattern, root, word, k))
    rest = F.when(F.size(word) > n, F.slice(word, n + 1, F.size(word) - n)).otherwise(F.slice(word, 1, 0))
    return let(slots, lambda s: let(rest, lambda r: whole(s, r)))


def in_order(root: Column, word: Column) -> Column:
    """Are the radicals found in the word in their order?"""
    start = F.lit(0)
    step = lambda at, x: F.when(F.get(root, at).isNotNull() & F.coalesce(radical_found(F.get(root, at), x["base"]), F.lit(False)), at + 1).otherwise(at)
    return F.aggregate(word, start, step) == F.size(root)


def rest_is_increase(root: Column, word: Column) -> Column:
    """Are the letters left, once each radical's first occurrence is taken away, letters of increase?"""
    bases = F.transform(word, lambda x: x["base"])

    def without(left, r):
        hits = F.transform(left, lambda b: F.coalesce(radical_found(r, b), F.lit(False)))
        at = F.array_position(hits, True)
        return F.when(at > 0, F.filter(left, lambda b, k: k != at.cast("int") - 1)).otherwise(left)

    return F.forall(F.aggregate(root, bases, without), lambda b: b.isin(INCREASE))


def project(words: DataFrame, patterns_of: DataFrame) -> DataFrame:
    """words (host, root_directive, root: array of letters) with wazn_directive, wazn_id, candidates, increase, operations, suffix and residual.

    patterns_of: a pattern catalogue as its reader gives it. A root that is blocked or
    deferred stays so and no pattern is tried. An accepted root that is missing, not of
    three or four letters, or holds a letter that no root can hold breaks the contract:
    its row has no directive and says so in residual, as does an unknown directive; no row
    is lost. Candidates come by rank; ties by id. An empty catalogue gives no candidates.
    """
    entry = F.struct("evidence_rank", "wazn_id", "licensed_shadda_behavior", "template")
    by_arity = patterns_of.groupBy(F.col("root_arity").alias("_arity")).agg(F.collect_list(entry).alias("_patterns"))
    w = words.withColumn("_cells", F.coalesce(cells(F.col("host")), F.array().cast("array<struct<base:string,vowel:string,raw:string>>")))
    w = w.withColumn("_n", F.size("root")).join(by_arity, F.col("_n") == F.col("_arity"), "left")
    open_ = F.col("root_directive") == "ACCEPT"
    broken = (
        F.when(F.coalesce(~F.col("root_directive").isin("ACCEPT", "DEFER", "BLOCK"), F.lit(True)), "contract:unknown_directive")
        .when(open_ & F.coalesce(F.col("_n") <= 0, F.lit(True)), "contract:accepted_without_root")
        .when(open_ & F.exists("root", lambda r: r.isNull() | r.isin(NOT_RADICAL + ["?", ""])), "contract:prohibited_radical")
        .when(open_ & ~F.col("_n").isin(3, 4), "contract:unsupported_arity")
    )
    fits = F.filter(F.transform("_patterns", lambda p: fit(p, F.col("root"), F.col("_cells"))), lambda x: x["fault"].isNull())
    w = w.withColumn("_broken", broken).withColumn("_fits", F.when(open_ & broken.isNull(), F.coalesce(fits, F.array())))
    w = w.withColumn("_clean", F.filter("_fits", lambda x: x["ending"] != "nominal"))
    one, root, word = F.get("_clean", F.lit(0)), F.col("root"), F.col("_cells")
    chosen = F.size("_clean") == 1
    possible = in_order(root, word) & rest_is_increase(root, word)
    weak = F.exists(root, lambda r: r.isin(WEAK)) & rest_is_increase(root, word)
    residual = (
        F.when(F.col("_broken").isNotNull(), F.col("_broken"))
        .when(F.col("root_directive") == "BLOCK", "block:wazn:root_candidate_blocked")
        .when(F.col("root_directive") == "DEFER", "defer:wazn:root_candidate_not_resolved")
        .when(F.size("_clean") > 1, "defer:wazn:multiple_licensed_patterns")
        .when(~chosen & (F.size("_fits") > 0), "defer:wazn:nominal_feminine_requires_licensed_wazn")
        .when(~chosen & possible, "defer:wazn:unlicensed_but_structural_augment")
        .when(~chosen & weak, "defer:wazn:catalog_pattern_not_licensed")
        .when(~chosen, "block:wazn:no_licensed_pattern")
    )
    w = w.withColumn("_residual", residual)
    directive = F.when(F.col("_broken").isNotNull(), None).when(F.col("_residual").isNull(), "ACCEPT").otherwise(F.upper(F.split("_residual", ":")[0]))
    shown = F.when(F.size("_clean") > 0, F.col("_clean")).otherwise(F.col("_fits"))
    ranked = F.transform(F.array_sort(F.transform(shown, lambda x: F.struct(x["rank"], x["wazn_id"]))), lambda x: x["wazn_id"])
    operations = F.array_compact(F.array(F.when(one["merged"], MERGED), F.when(one["doubled"], DOUBLED)))
    return w.select(
        *words.columns,
        directive.alias("wazn_directive"),
        F.when(chosen, one["wazn_id"]).alias("wazn_id"),
        F.coalesce(ranked, F.array().cast("array<string>")).alias("candidates"),
        F.when(chosen, one["increase"]).alias("increase"),
        F.when(chosen, operations).alias("operations"),
        F.when(chosen, one["suffix"]).alias("suffix"),
        F.col("_residual").alias("residual"),
    )
