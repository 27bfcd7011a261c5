"""Word patterns: which templates a word fits, and words made from roots and templates.

Templates are written with ف ع ل for the three radicals. A word is compared with every
template of its length (the catalogues have a few dozen rows, exploded as a literal
array, so there is no join), and the number of fits decides: one accepts, several
defer with all of them kept, none blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions.binding import let

RADICALS = "فعل"

# Template, id and family of the pattern catalogue.
WAZN = [
    ("فَعَل", "FA_A_LA", "triliteral_bare_verb"),
    ("فَعِل", "FA_I_LA", "triliteral_bare_verb"),
    ("فَعُل", "FA_U_LA", "triliteral_bare_verb"),
    ("فَعْل", "FA3L", "triliteral_noun"),
    ("فِعْل", "FI3L", "triliteral_noun"),
    ("فُعْل", "FU3L", "triliteral_noun"),
    ("فَاعِل", "FA3IL", "active_participle"),
    ("مَفْعُول", "MAF3UL", "passive_participle"),
    ("فَعَّال", "FA33AL", "intensive_noun"),
    ("ءَفْعَل", "AF3AL", "form_IV_verb"),
    ("فَعَّل", "FA33ALA", "form_II_verb"),
    ("فَاعَل", "FA3ALA", "form_III_verb"),
    ("اِنْفَعَل", "INFA3ALA", "form_VII_verb"),
    ("اِفْتَعَل", "IFTA3ALA", "form_VIII_verb"),
    ("اِسْتَفْعَل", "ISTAF3ALA", "form_X_verb"),
    ("تَفَعَّل", "TAFA33ALA", "form_V_verb"),
    ("تَفَاعَل", "TAFA3ALA", "form_VI_verb"),
    ("مَفْعَل", "MAF3AL", "noun_of_place_or_masdar"),
    ("مَفْعِل", "MAF3IL", "noun_of_place_or_masdar"),
    ("مِفْعَال", "MIF3AL", "instrument_noun"),
]
# Verb classes: id, family, past and imperfect template, vowels of the second radical.
BAB = [
    ("BAB_I_NASARA", "MUJARRAD", "فَعَلَ", "يَفْعُلُ", "a", "u"),
    ("BAB_II_DARABA", "MUJARRAD", "فَعَلَ", "يَفْعِلُ", "a", "i"),
    ("BAB_III_FATAHA", "MUJARRAD", "فَعَلَ", "يَفْعَلُ", "a", "a"),
    ("BAB_IV_SAMIA", "MUJARRAD", "فَعِلَ", "يَفْعَلُ", "i", "a"),
    ("BAB_V_KARUMA", "MUJARRAD", "فَعُلَ", "يَفْعُلُ", "u", "u"),
    ("BAB_VI_HASIBA", "MUJARRAD", "فَعِلَ", "يَفْعِلُ", "i", "i"),
    ("BAB_FORM_II", "MAZID", "فَعَّلَ", "يُفَعِّلُ", "a", "i"),
    ("BAB_FORM_III", "MAZID", "فَاعَلَ", "يُفَاعِلُ", "a", "i"),
    ("BAB_FORM_IV", "MAZID", "أَفْعَلَ", "يُفْعِلُ", "a", "i"),
    ("BAB_FORM_V", "MAZID", "تَفَعَّلَ", "يَتَفَعَّلُ", "a", "a"),
    ("BAB_FORM_VI", "MAZID", "تَفَاعَلَ", "يَتَفَاعَلُ", "a", "a"),
    ("BAB_FORM_VII", "MAZID", "اِنْفَعَلَ", "يَنْفَعِلُ", "a", "i"),
    ("BAB_FORM_VIII", "MAZID", "اِفْتَعَلَ", "يَفْتَعِلُ", "a", "i"),
    ("BAB_FORM_IX", "MAZID", "اِفْعَلَّ", "يَفْعَلُّ", "a", "a"),
    ("BAB_FORM_X", "MAZID", "اِسْتَفْعَلَ", "يَسْتَفْعِلُ", "a", "i"),
]
# Verbal nouns of the augmented classes; the bare classes need a lexicon.
MASDAR = [
    ("BAB_FORM_II", "تَفْعِيل"),
    ("BAB_FORM_III", "مُفَاعَلَة"),
    ("BAB_FORM_IV", "إِفْعَال"),
    ("BAB_FORM_V", "تَفَعُّل"),
    ("BAB_FORM_VI", "تَفَاعُل"),
    ("BAB_FORM_VII", "اِنْفِعَال"),
    ("BAB_FORM_VIII", "اِفْتِعَال"),
    ("BAB_FORM_IX", "اِفْعِلَال"),
    ("BAB_FORM_X", "اِسْتِفْعَال"),
]
# Derivatives: type, class family, template, transitivity.
DERIVATIVES = [
    ("ISM_FA3IL", "I", "فَاعِل", "UNCONSTRAINED"),
    ("ISM_FA3IL", "II", "مُفَعِّل", "UNCONSTRAINED"),
    ("ISM_FA3IL", "III", "مُفَاعِل", "UNCONSTRAINED"),
    ("ISM_FA3IL", "IV", "مُفْعِل", "UNCONSTRAINED"),
    ("ISM_FA3IL", "V", "مُتَفَعِّل", "UNCONSTRAINED"),
    ("ISM_FA3IL", "VI", "مُتَفَاعِل", "UNCONSTRAINED"),
    ("ISM_FA3IL", "VII", "مُنْفَعِل", "UNCONSTRAINED"),
    ("ISM_FA3IL", "VIII", "مُفْتَعِل", "UNCONSTRAINED"),
    ("ISM_FA3IL", "IX", "مُفْعَلّ", "UNCONSTRAINED"),
    ("ISM_FA3IL", "X", "مُسْتَفْعِل", "UNCONSTRAINED"),
    ("ISM_MAF3UL", "I", "مَفْعُول", "TRANSITIVE"),
    ("ISM_MAF3UL", "II", "مُفَعَّل", "TRANSITIVE"),
    ("ISM_MAF3UL", "III", "مُفَاعَل", "TRANSITIVE"),
    ("ISM_MAF3UL", "IV", "مُفْعَل", "TRANSITIVE"),
    ("ISM_MAF3UL", "V", "مُتَفَعَّل", "TRANSITIVE"),
    ("ISM_MAF3UL", "VI", "مُتَفَاعَل", "TRANSITIVE"),
    ("ISM_MAF3UL", "VIII", "مُفْتَعَل", "TRANSITIVE"),
    ("ISM_MAF3UL", "IX", "مُفْعَلّ", "TRANSITIVE"),
    ("ISM_MAF3UL", "X", "مُسْتَفْعَل", "TRANSITIVE"),
    ("SIFA_MUSHABBAHA", "I", "فَعِيل", "INTRANSITIVE"),
    ("SIFA_MUSHABBAHA", "I", "فَعْلَان", "INTRANSITIVE"),
    ("SIFA_MUSHABBAHA", "I", "أَفْعَل", "INTRANSITIVE"),
    ("SIFA_MUSHABBAHA", "I", "فَعِل", "INTRANSITIVE"),
    ("SIFA_MUSHABBAHA", "I", "فَعْل", "INTRANSITIVE"),
    ("SIYAG_MUBALAGHAH", "I", "فَعَّال", "UNCONSTRAINED"),
    ("SIYAG_MUBALAGHAH", "I", "مِفْعَال", "UNCONSTRAINED"),
    ("SIYAG_MUBALAGHAH", "I", "فَعُول", "UNCONSTRAINED"),
    ("SIYAG_MUBALAGHAH", "I", "فَعِيل", "UNCONSTRAINED"),
    ("SIYAG_MUBALAGHAH", "I", "فَعِل", "UNCONSTRAINED"),
    ("ISM_ZAMAN", "I", "مَفْعَل", "UNCONSTRAINED"),
    ("ISM_ZAMAN", "I", "مَفْعِل", "UNCONSTRAINED"),
    ("ISM_MAKAN", "I", "مَفْعَل", "UNCONSTRAINED"),
    ("ISM_MAKAN", "I", "مَفْعِل", "UNCONSTRAINED"),
    ("ISM_ALA", "I", "مِفْعَل", "TRANSITIVE"),
    ("ISM_ALA", "I", "مِفْعَال", "TRANSITIVE"),
    ("ISM_ALA", "I", "مِفْعَلَة", "TRANSITIVE"),
    ("TAFDHIL", "I", "أَفْعَل", "UNCONSTRAINED"),
]


def apply_root(pattern: Column, root: Column) -> Column:
    """The template with a root's three radicals, which may themselves be ف ع ل."""
    slots = "\ue001\ue002\ue003"
    out = F.translate(pattern, RADICALS, slots)
    for k, c in enumerate(slots):
        out = F.replace(out, F.lit(c), F.substring(root, k + 1, 1))
    return out


def template_cells(pattern: str) -> list[str]:
    """A template's letters with their marks, doubled letters written out."""
    cells: list[str] = []
    for c in pattern:
        if c in ar.MARKS:
            if c == ar.SHADDA:
                cells.append(cells[-1][0] + cells[-1][1:])
                cells[-2] = cells[-2][0] + ar.SUKUN
            else:
                cells[-1] += c
        else:
            cells.append(c)
    return cells


def fits(surface: Column) -> Column:
    """array of struct(wazn_id, root): the templates whose letters and vowels a word has; the last letter's marks are free."""
    return let(ar.phones(surface), _fits)


def _fits(cells: Column) -> Column:
    out = []
    for pattern, name, _ in WAZN:
        want = template_cells(pattern)
        at = {r: next(k for k, c in enumerate(want) if c[0] == r) for r in RADICALS}
        root = F.concat(*[F.left(F.get(cells, F.lit(at[r])), F.lit(1)) for r in RADICALS])
        same = F.size(cells) == len(want)
        for k, cell in enumerate(want):
            have = F.get(cells, F.lit(k))
            letter = F.substring(root, RADICALS.index(cell[0]) + 1, 1) if cell[0] in RADICALS else F.lit(cell[0])
            same = same & (F.left(have, F.lit(1)) == letter)
            if k < len(want) - 1 and cell[0] not in "اوي":
                same = same & (F.substr(have, F.lit(2)) == cell[1:])
        out.append(F.when(same, F.struct(F.lit(name).alias("wazn_id"), root.alias("root"))))
    return F.array_compact(F.array(*out))


def match(words: DataFrame, surface: str = "surface") -> DataFrame:
    """The words with n_fits, verdict, and wazn_ids joined by blanks."""
    w = words.withColumn("fits", fits(F.col(surface)))
    n = F.size("fits")
    return w.select(*words.columns, n.cast("long").alias("n_fits"), F.when(n == 1, "ACCEPT").when(n > 1, "DEFER").otherwise("BLOCK").alias("verdict"), F.array_join(F.transform("fits", lambda x: x["wazn_id"]), " ").alias("wazn_ids"))


def derive(roots: DataFrame, templates: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """roots x templates as an explode of a literal array; the template's column is ``pattern``. roots: root."""
    rows = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, t, strict=True)]) for t in templates]))
    t = roots.withColumn("t", rows).select(*roots.columns, "t.*")
    return t.withColumn("form", apply_root(F.col("pattern"), F.col("root")))
