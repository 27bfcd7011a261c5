"""Clitics: enclitic pronouns at the end, particles in front, with the guards that keep words whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions.binding import let

# Attached pronouns, and endings that inflect and are no pronouns.
ENCLITICS = ["هما", "كما", "هم", "كم", "نا", "ني", "ها", "ه", "ك", "ي"]
INFLECTIONS = ["وا", "ون", "ين", "ان", "تم", "تن", "ن", "ت"]
# Particles, their vowel and kind, by priority; and kinds' least letters of the rest.
PROCLITICS = [("و", ar.FATHA, "CONJUNCTION"), ("ف", ar.FATHA, "CONJUNCTION"), ("ب", ar.KASRA, "PREPOSITION"), ("ل", ar.KASRA, "PREPOSITION"), ("س", ar.FATHA, "FUTURE_PARTICLE")]
LEAST = {"CONJUNCTION": 3, "PREPOSITION": 2, "FUTURE_PARTICLE": 3}


def enclitic(c: Column) -> Column:
    """The attached pronoun's bare letters, or null."""
    bare = ar.strip_diacritics(c)
    ends = lambda xs: F.lit(False) if not xs else bare.rlike("(" + "|".join(xs) + ")$")
    out = F.lit(None).cast("string")
    for e in sorted(ENCLITICS, key=lambda e: (len(e), e)):
        tail = F.regexp_extract(c, "(" + "".join(f"{x}{ar.MARK}*" for x in e) + ")$", 1)
        hit = bare.endswith(e) & (ar.count_letters(F.left(bare, F.length(bare) - len(e))) >= 2) & ~tail.rlike(f"[{ar.TANWIN}]")
        if e == "نا":
            hit = hit & ~bare.endswith("ونا")
        out = F.when(hit, e).otherwise(out)
    return F.when(ends(INFLECTIONS), None).otherwise(out)


def proclitic(c: Column) -> Column:
    """struct(particle, kind, rest) of one leading particle; particle is null without one."""
    bare = ar.strip_diacritics(c)
    particle, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    rest_bare = F.substr(bare, F.lit(2))
    rest = F.regexp_replace(c, f"^.{ar.MARK}*", "")
    article = ar.starts_with_article(rest)
    for letter, vowel, k in reversed(PROCLITICS):
        marks = F.regexp_extract(c, f"^{letter}({ar.MARK}*)", 1)
        fits = bare.startswith(letter) & ((marks == "") | marks.startswith(vowel)) & (article | (ar.count_letters(rest_bare) >= LEAST[k]))
        if k == "FUTURE_PARTICLE":
            fits = fits & rest_bare.rlike("^[يتنأ]")
        particle, kind = F.when(fits, letter).otherwise(particle), F.when(fits, k).otherwise(kind)
    return F.struct(particle.alias("particle"), kind.alias("kind"), F.when(particle.isNotNull(), rest).otherwise(c).alias("rest"))


# Words that stay whole, operators that stay whole, and words whose first letter is a radical.
PROTECTED = [
    "اللَّهُ", "اللَّهِ", "اللَّهَ", "اللَّه", "الله", "اللهِ", "اللهَ", "هَذَا", "هَذِهِ", "هَؤُلَاءِ", "هَذَانِ", "هَاتَانِ", "هُوَ", "هِيَ", "هُمَا", "هُمْ", "هُنَّ", "الَّذِي", "الَّتِي", "الَّذِينَ", "اللَّوَاتِي", "اللَّاتِي",
    "الَّذَانِ", "اللَّذَانِ", "اللَّذَيْنِ", "الَلَّذَيْنِ", "ذَلِكَ", "ذَلِكُمْ", "تِلْكَ", "أُولَئِكَ", "إِذَا", "أَيُّهَا", "أَيَّتُهَا",
]
OPERATORS = [
    "مِنْ", "عَنْ", "إِلَى", "عَلَى", "فِي", "مَعَ", "حَتَّى", "بَيْنَ", "فَوْقَ", "تَحْتَ", "قَبْلَ", "بَعْدَ", "عِنْدَ", "لَدَى", "لَدُنْ", "إِنَّ", "أَنَّ", "كَأَنَّ", "لَكِنَّ", "لَيْتَ", "لَعَلَّ", "لَوْ", "لَوْلَا", "مَا", "لَا", "إِنْ", "لَمَّا", "قَدْ", "لَنْ", "هَلْ", "بَلْ", "أَمَّا", "ثُمَّ", "أَوْ", "أَمْ", "كَمَا",
    "من", "عن", "إلى", "على", "في", "مع", "حتى", "بين", "فوق", "تحت", "قبل", "بعد", "عند", "لدى", "لدن", "إن", "لما", "قد", "لن", "هل", "بل", "أما", "ثم", "أو", "أم", "إنَّ", "أنَّ", "كأنَّ", "لكنَّ", "ليت", "لعل", "لو", "لولا", "ما", "لا", "كما",
]
RADICAL_FIRST = ["كاتب", "كبير", "كتاب", "كريم", "كلام", "كثير", "كافر", "كفر", "فعل", "فتح", "فقير", "فسوق", "فهم", "وعد", "وجد", "ولد", "وزن", "وقف", "وقى", "لبس", "لعب", "لقي", "لها", "سأل", "سمع", "سبق", "سلم", "باب", "بيت", "بكى"]
# Two particles in a row, by their letters, and the second one's kind; the first is a conjunction.
PAIRS = [("ول", "JUSSIVE_LAM"), ("فل", "JUSSIVE_LAM"), ("فب", "PREPOSITION"), ("وب", "PREPOSITION"), ("وك", "PREPOSITION"), ("فك", "PREPOSITION"), ("وس", "FUTURE_PARTICLE"), ("فس", "FUTURE_PARTICLE")]
IMPERFECT_FIRST = "يتنأإآا"


def _plain(word: str) -> str:
    return "".join(c for c in word if not "\u064b" <= c <= "\u065f" and c != "\u0670")


BARE_PROTECTED, BARE_OPERATORS = sorted({_plain(w) for w in PROTECTED}), sorted({_plain(w) for w in OPERATORS})
_LETTER, _MARKS = "[^" + ar.STRIPPED[1:], ar.STRIPPED + "*"


def take(c: Column, n: int) -> Column:
    """The first n letters with their marks."""
    return F.regexp_extract(c, f"^((?:{_LETTER}{_MARKS}){{{n}}})", 1)


def behind(c: Column, front: Column) -> Column:
    return F.substr(c, F.length(front) + 1)


def legal_host(c: Column) -> Column:
    return ar.count_letters(c) >= 2


def split_enclitic(c: Column) -> Column:
    """struct(stem, pronoun): the attached pronoun with its marks; null, with the whole word as stem, without one."""

    def parts(e):
        tail = F.when(e.isNotNull(), F.coalesce(*[F.when(F.length(e) == n, F.regexp_extract(c, f"((?:{_LETTER}{_MARKS}){{{n}}})$", 1)) for n in (1, 2, 3)]))
        return F.struct(F.when(e.isNull(), c).otherwise(F.left(c, F.length(c) - F.length(tail))).alias("stem"), tail.alias("pronoun"))

    return let(enclitic(c), parts)


def proclitics(c: Column) -> Column:
    """struct(parts, kinds, rest): leading particles, two before one; parts is empty without any.

    What is left must be a whole word, begin with the article or have enough letters; a
    conjunction's rest must have them without its pronoun too.
    """
    none = F.array().cast("array<string>")

    def of(bare, one, two):
        rest, rest2 = behind(c, one), behind(c, two)

        def fits(r, least):
            return ar.starts_with_article(r) | (ar.count_letters(r) >= least)

        out = F.struct(none.alias("parts"), none.alias("kinds"), c.alias("rest"))
        for letter, vowel, kind in reversed(PROCLITICS):
            mark = F.left(F.regexp_extract(one, f"^.({_MARKS})", 1), F.lit(1))
            plain = ar.strip_diacritics(rest)
            whole = F.when(rest == plain, plain.isin(BARE_PROTECTED + BARE_OPERATORS)).otherwise(rest.isin(PROTECTED + OPERATORS))
            ok = bare.startswith(letter) & (F.length(bare) > 1) & ((mark == "") | (mark == vowel)) & (whole | fits(rest, LEAST[kind]))
            if kind == "FUTURE_PARTICLE":
                ok = ok & plain.rlike(f"^[{IMPERFECT_FIRST}]")
            if kind == "CONJUNCTION":
                enc = F.lit(0)
                for e in sorted(ENCLITICS, key=lambda e: (len(e), e)):
                    enc = F.when(plain.endswith(e) & (F.length(plain) > len(e)), len(e)).otherwise(enc)
                ok = ok & (whole | ar.starts_with_article(rest) | (ar.count_letters(F.left(plain, F.length(plain) - enc)) >= LEAST[kind]))
            out = F.when(ok, F.struct(F.array(one).alias("parts"), F.array(F.lit(kind)).alias("kinds"), rest.alias("rest"))).otherwise(out)
        plain2 = ar.strip_diacritics(rest2)
        for letters, kind in PAIRS:
            ok = bare.startswith(letters) & (plain2.isin(BARE_PROTECTED + BARE_OPERATORS) | fits(rest2, LEAST["CONJUNCTION"]))
            both = F.struct(F.array(one, behind(two, one)).alias("parts"), F.array(F.lit("CONJUNCTION"), F.lit(kind)).alias("kinds"), rest2.alias("rest"))
            out = F.when(ok, both).otherwise(out)
        return F.when(bare.isin(RADICAL_FIRST), F.struct(none.alias("parts"), none.alias("kinds"), c.alias("rest"))).otherwise(out)

    return let(ar.strip_diacritics(c), lambda bare: let(take(c, 1), lambda one: let(take(c, 2), lambda two: of(bare, one, two))))


def segment_word(c: Column, catalogued: Column | None = None) -> Column:
    """struct(rule, proclitics, kinds, article, host, enclitic, segments, host_present, clitic_only) of a word.

    In order: a catalogued or protected word and an operator stay whole (an operator may
    carry a pronoun); the particle li with a contracted article; particles, then what they
    leave; the article; a pronoun; else the word is its host. A null word gives nulls.
    """
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")

    def row(rule, parts, kinds, article, host, enclitic):
        return F.struct(F.lit(rule).alias("rule") if isinstance(rule, str) else rule.alias("rule"), parts.alias("proclitics"), kinds.alias("kinds"), article.alias("article"), host.alias("host"), enclitic.alias("enclitic"))

    def with_article(s, then):
        """then(article, what follows it), article null where there is none or too little follows."""
        return let(take(s, 2), lambda a: let(behind(s, a), lambda after: let(ar.starts_with_article(s) & legal_host(after), lambda has: let(F.struct(F.when(has, a).alias("a"), F.when(has, after).otherwise(s).alias("s")), lambda x: then(x["a"], x["s"])))))

    def after_particles(p, otherwise):
        def arms(r, plain, e):
            operator = F.when(e["pronoun"].isNotNull(), "PROCLITIC_PLUS_OPERATOR_HOST_WITH_ENCLITIC").otherwise("PROCLITIC_PLUS_OPERATOR_HOST")
            host = with_article(r, lambda a, h: let(split_enclitic(h), lambda x: F.when(legal_host(x["stem"]), row("PROCLITIC_INVENTORY", p["parts"], p["kinds"], a, x["stem"], x["pronoun"]))))
            return (
                F.when(plain.isin(BARE_PROTECTED), row("PROCLITIC_PLUS_PROTECTED_HOST", p["parts"], p["kinds"], null, r, null))
                .when(plain.isin(BARE_OPERATORS), row(operator, p["parts"], p["kinds"], null, e["stem"], e["pronoun"]))
                .when(plain.isin(ENCLITICS), row("CLITIC_ONLY_CONSTRUCTION", p["parts"], p["kinds"], null, null, r))
                .otherwise(host)
            )

        got = let(p["rest"], lambda r: let(ar.strip_diacritics(r), lambda plain: let(split_enclitic(r), lambda e: arms(r, plain, e))))
        return F.coalesce(F.when(F.size(p["parts"]) > 0, got), otherwise)

    def contracted(s, one):
        return let(take(behind(s, one), 1), lambda a: let(split_enclitic(behind(behind(s, one), a)), lambda x: row("CONTRACTED_LI_PLUS_AL", F.array(one), F.array(F.lit("PREPOSITION")), a, x["stem"], x["pronoun"])))

    def of(s, plain, e):
        whole = (F.lit(False) if catalogued is None else F.coalesce(catalogued, F.lit(False)))
        article = with_article(s, lambda a, h: F.when(a.isNotNull(), let(split_enclitic(h), lambda x: row("DEFINITE_ARTICLE_PATTERN", none, none, a, x["stem"], x["pronoun"]))))
        plainly = row(F.when(e["pronoun"].isNotNull(), "ENCLITIC_INVENTORY").otherwise("NO_CLITIC_FOUND"), none, none, null, e["stem"], e["pronoun"])
        operator = F.when(e["pronoun"].isNotNull(), "OPERATOR_HOST_WITH_ENCLITIC").otherwise("OPERATOR_WHOLE_TOKEN")
        li = plain.startswith("لل") & (F.length(plain) >= 4) & legal_host(behind(s, take(s, 2)))
        return (
            F.when(s.isNull(), None)
            .when(whole, row("LEXICAL_WHOLE_TOKEN_PRECEDENCE", none, none, null, s, null))
            .when(plain.isin(BARE_PROTECTED), row("LEXICALLY_PROTECTED_HOST", none, none, null, s, null))
            .when(plain.isin(BARE_OPERATORS), row(operator, none, none, null, e["stem"], e["pronoun"]))
            .when(li, contracted(s, take(s, 1)))
            .otherwise(let(proclitics(s), lambda p: after_particles(p, F.coalesce(article, plainly))))
        )

    x = let(ar.canonical_normalize(c), lambda s: let(ar.strip_diacritics(s), lambda plain: let(split_enclitic(s), lambda e: of(s, plain, e))))
    return let(x, lambda x: F.when(x.isNotNull(), F.struct(*[x[n].alias(n) for n in ("rule", "proclitics", "kinds", "article", "host", "enclitic")], segments(x).alias("segments"), x["host"].isNotNull().alias("host_present"), (x["host"].isNull()).alias("clitic_only"))))


def segments(x: Column) -> Column:
    """The parts in order: array of struct(surface, role, kind, start, end), positions in the normal form."""
    part = lambda s, role, kind: F.struct(s.alias("surface"), F.lit(role).alias("role"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    front = F.zip_with(x["proclitics"], x["kinds"], lambda s, k: part(s, "PROCLITIC", k))
    rest = F.array(part(x["article"], "DEFINITE_ARTICLE", "DEFINITE_ARTICLE"), part(x["host"], "HOST", "LEXICAL_HOST"), part(x["enclitic"], "ENCLITIC", "ATTACHED_PRONOUN"))

    def placed(every):
        at = lambda i: F.aggregate(F.slice(every, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p["surface"]))
        return F.transform(every, lambda p, i: F.struct(p["surface"].alias("surface"), p["role"].alias("role"), p["kind"].alias("kind"), at(i).alias("start"), (at(i) + F.length(p["surface"])).alias("end")))

    return let(F.filter(F.concat(front, rest), lambda p: p["surface"].isNotNull()), placed)


def segment(c: Column) -> Column:
    """struct(route, particle, article, host, pronoun): whole words first, then particle, article and pronoun are peeled off in this order."""

    def parts(p, a, rest, e):
        tail = F.lit("")
        for x in ENCLITICS:
            tail = F.when(e == x, F.regexp_extract(rest, "(" + "".join(f"{k}{ar.MARK}*" for k in x) + ")$", 1)).otherwise(tail)
        whole = F.when(c.isin(*PROTECTED), "PROTECTED").when(c.isin(*OPERATORS), "OPERATOR")
        route = F.concat_ws("+", F.when(p["particle"].isNotNull(), "PROCLITIC"), F.when(a["kind"] != "none", "ARTICLE"), F.lit("HOST"), F.when(e.isNotNull(), "ENCLITIC"))
        return F.struct(
            F.coalesce(whole, route).alias("route"),
            F.when(whole.isNull(), p["particle"]).alias("particle"),
            F.when(whole.isNull() & (a["kind"] != "none"), a["article"]).alias("article"),
            F.when(whole.isNull(), F.left(rest, F.length(rest) - F.length(tail))).otherwise(c).alias("host"),
            F.when(whole.isNull(), e).alias("pronoun"),
        )

    return let(proclitic(c), lambda p: let(p["rest"], lambda r: let(ar.article_span(r), lambda a: let(a["rest"], lambda rest: let(enclitic(rest), lambda e: parts(p, a, rest, e))))))
