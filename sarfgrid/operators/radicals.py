"""Radicals of a host: verbal affixes off, weak and doubled letters settled, candidates kept when several are open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions.binding import let
from ..functions.roots import analyse_radicals

# Verbal endings and their rules, longest first.
SUFFIXES = [
    ("تُمُوا", "INFLECTIONAL_SUFFIX_2PL_MASC_WAW"), ("تِنَّ", "INFLECTIONAL_SUFFIX_2PL_FEM"), ("تُنَّ", "INFLECTIONAL_SUFFIX_2PL_FEM_ALT"), ("تُمْ", "INFLECTIONAL_SUFFIX_2PL_MASC_SUKUUN"), ("تُمَا", "INFLECTIONAL_SUFFIX_2DUAL_MASC"),
    ("ُونَ", "INFLECTIONAL_SUFFIX_NUN_JAMAA_MUDARI"), ("تُم", "INFLECTIONAL_SUFFIX_2PL_MASC_PLAIN"), ("وا", "INFLECTIONAL_SUFFIX_WAW_JAMAA"),
]
BARE_WAW = "INFLECTIONAL_SUFFIX_WAW_JAMAA_BARE"
WEAK = "ويا" + "ىأإؤئآ"
MARKS = "[" + ar.SHORT + ar.TANWIN + ar.SUKUN + ar.SHADDA + ar.MADDA + ar.HAMZA_ABOVE + ar.HAMZA_BELOW + ar.DAGGER + "]"


def normalize_host(c: Column) -> Column:
    """Hamza carriers as hamza, doubled letters written twice."""
    return ar.normalize_shadda(ar.normalize_hamza(c))


def consonants(c: Column) -> Column:
    """The letters in order, without marks and blanks."""
    return F.regexp_replace(c, MARKS + "| ", "")


def resolve_root(host: Column, pre_root: Column) -> Column:
    """struct(directive, root, residual, root_type, radical_count) of a host under the directive so far: a block stays, a deferral is never lifted."""

    def of(letters, x):
        up = F.upper(F.trim(pre_root))
        accepted = x["directive"] == "ACCEPT"
        held = accepted & (up == "DEFER")
        directive = F.when(up == "BLOCK", "BLOCK").when(held, "DEFER").otherwise(x["directive"])
        reason = F.concat(F.when(x["directive"] == "BLOCK", "block:root:").otherwise("defer:root:"), x["reason"])
        residual = F.when(up == "BLOCK", "block:root:pre_root_directive_block").when(held, "defer:root:pre_root_directive_defer").otherwise(reason)
        open_ = directive == "ACCEPT"
        return F.struct(directive.alias("directive"), F.when(open_, letters).alias("root"), residual.alias("residual"), F.when(open_, x["kind"]).alias("root_type"), F.when(open_, F.length(letters)).alias("radical_count"))

    return let(consonants(normalize_host(host)), lambda letters: let(analyse_radicals(letters), lambda x: of(letters, x)))


def radical_alignment(root: Column) -> Column:
    """map of position to radical; null without a root."""
    return F.when(root.isNotNull(), F.map_from_arrays(F.array(F.lit("FA"), F.lit("AYN"), F.lit("LAM")), F.split(root, "")))


def compressed_candidates(host: Column) -> Column:
    """Two roots of a word of two letters, by the first one's vowel: waw before ya behind damma, ya before waw behind kasra; else null."""

    def of(s, letters):
        vowel = F.regexp_extract(s, f"^{MARKS}*[^ ]({MARKS})", 1)
        with_ = lambda mid: F.concat(F.left(letters, F.lit(1)), F.lit(mid), F.substr(letters, F.lit(2)))
        two = F.length(letters) == 2
        return F.when(two & (vowel == ar.DAMMA), F.array(with_("و"), with_("ي"))).when(two & (vowel == ar.KASRA), F.array(with_("ي"), with_("و")))

    return let(normalize_host(host), lambda s: let(consonants(s), lambda letters: of(s, letters)))


def strip_verbal_suffix(host: Column) -> Column:
    """struct(stem, suffix, rule): the longest verbal ending that leaves two letters; a single waw too, of a word whose pronoun went before."""
    left = lambda n: F.left(host, F.length(host) - n)
    out = F.struct(host.alias("stem"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("rule"))
    waw = host.endswith("و") & (F.length(host) >= 4) & (ar.count_letters(left(1)) >= 2)
    out = F.when(waw, F.struct(left(1).alias("stem"), F.lit("و").alias("suffix"), F.lit(BARE_WAW).alias("rule"))).otherwise(out)
    for suffix, rule in reversed(SUFFIXES):
        hit = host.endswith(suffix) & (ar.count_letters(left(len(suffix))) >= 2)
        out = F.when(hit, F.struct(left(len(suffix)).alias("stem"), F.lit(suffix).alias("suffix"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def strip_imperfect_prefix(stem: Column) -> Column:
    """struct(rest, prefix): a vocalised prefix letter before a consonant, if two letters stay."""
    rest = F.substr(stem, F.lit(3))
    hit = (F.length(stem) >= 4) & stem.rlike(f"^[يتنأ][{ar.SHORT}][^واي]") & (ar.count_letters(rest) >= 2)
    return F.struct(F.when(hit, rest).otherwise(stem).alias("rest"), F.when(hit, F.left(stem, F.lit(2))).alias("prefix"))


def hollow_fourth_root(rest: Column) -> Column:
    """Radicals of a hollow verb of the fourth form from its imperfect stem: a kasra and a long vowel in the middle; else null."""
    letter = "[^" + MARKS[1:]
    pattern = f"^({letter}){MARKS}*{ar.KASRA}{MARKS}*[ويا]{MARKS}*({letter})"
    c1, c3 = F.regexp_extract(rest, pattern, 1), F.regexp_extract(rest, pattern, 2)
    weak = f"^[{WEAK}]$"
    return F.when((c1 != "") & ~c1.rlike(weak) & ~c3.rlike(weak), F.concat(c1, F.lit("و"), c3))


def account(host: Column, pre_root: Column, verbal: Column) -> Column:
    """struct(directive, prefix, suffix, suffix_rule, stem, form_family, roots, reason) of a host, bare verbs and hollow verbs of the fourth form.

    Affixes go only on a verbal path. One root is accepted; a word of two letters keeps both
    of its candidates and defers. A missing host or directive and a block stay blocked.
    """

    def of(s, p):
        rest = p["rest"]
        wasl = p["prefix"].isNull() & (F.length(rest) >= 4) & rest.rlike(f"^ا[^ل]{ar.SUKUN}")
        stem = F.when(wasl, F.substr(rest, F.lit(2))).otherwise(rest)
        fourth = F.when(p["prefix"].contains(ar.DAMMA), hollow_fourth_root(rest))
        tentative = F.when(p["prefix"].isNotNull(), "FORM_I_IMPERFECT").when(wasl, "FORM_I")

        def settled(stem, x):
            ok = x["directive"] == "ACCEPT"
            family = F.when(fourth.isNotNull(), "FORM_IV").when(ok, F.coalesce(tentative, F.lit("FORM_I"))).otherwise(tentative)
            found = F.when(fourth.isNotNull(), F.array(fourth)).when(ok, F.array(x["root"])).otherwise(F.coalesce(compressed_candidates(stem), F.array().cast("array<string>")))
            reason = F.when(fourth.isNotNull(), "FORM_IV_HOLLOW_IMPERFECT_ACCEPTED").when(ok, "TRILATERAL_ROOT_ACCEPTED").otherwise(x["residual"])
            return F.struct(F.when(ok | fourth.isNotNull(), "ACCEPT").otherwise("DEFER").alias("directive"), p["prefix"].alias("prefix"), s["suffix"].alias("suffix"), s["rule"].alias("suffix_rule"), stem.alias("stem"), family.alias("form_family"), found.alias("roots"), reason.alias("reason"))

        return let(stem, lambda stem: let(resolve_root(stem, F.lit("OPEN")), lambda x: settled(stem, x)))

    null, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    blocked = lambda why: F.struct(F.lit("BLOCK").alias("directive"), null.alias("prefix"), null.alias("suffix"), null.alias("suffix_rule"), host.alias("stem"), null.alias("form_family"), none.alias("roots"), F.lit(why).alias("reason"))
    plain = F.struct(host.alias("stem"), null.alias("suffix"), null.alias("rule"))
    suffixed = F.when(verbal, strip_verbal_suffix(host)).otherwise(plain)

    def prefixed(s):
        p = F.when(verbal, strip_imperfect_prefix(s["stem"])).otherwise(F.struct(s["stem"].alias("rest"), null.alias("prefix")))
        return let(p, lambda p: of(s, p))

    return F.when((F.coalesce(host, F.lit("")) == "") | pre_root.isNull(), blocked("CRA_GUARD:NO_SEGMENT_HOST_OR_PRE_ROOT")).when(pre_root == "BLOCK", blocked("CRA_PRESERVE_BLOCK:PRE_ROOT_BOUNDARY")).otherwise(let(suffixed, prefixed))
