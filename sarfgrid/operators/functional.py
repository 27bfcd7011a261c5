"""Functional words by tiers: as written, by the key that keeps doubling, behind proclitics, by the bare key.

A word behind a proclitic is looked up again by the same tiers, so the answer for a word
rests on those for its ends. The ends that proclitics can lead to become rows, meet the
index by equi-joins, and are folded inside one row a word from the shortest to the whole:
the recursion is exact at any depth, and no word is tried against every entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic as ar

# Proclitics in the order they are tried; question words that are nouns though the catalogue calls them operators.
PROCLITICS = ["وَ", "فَ", "بِ", "لِ", "كَ", "وَال", "فَال", "بِال", "لِل"]
QUESTION_WORDS = ["مَنْ", "مَا", "أَيْنَ", "كَيْفَ", "كَمْ", "أَيّ", "مَتَى", "أَنَّى", "مَهْمَا"]
# Relative and detached pronouns and question words that stand beside the catalogue, with their categories.
PRONOUNS = [
    ("الَّذِي", "اسم موصول مفرد مذكر"), ("الَّتِي", "اسم موصول مفرد مؤنث"), ("اللَّذَيْنِ", "اسم موصول مثنى مذكر"), ("اللَّتَيْنِ", "اسم موصول مثنى مؤنث"), ("الَّذِينَ", "اسم موصول جمع مذكر"), ("اللَّاتِي", "اسم موصول جمع مؤنث"), ("اللَّوَاتِي", "اسم موصول جمع مؤنث"),
    ("هُوَ", "ضمير منفصل غائب مذكر مفرد"), ("هِيَ", "ضمير منفصل غائب مؤنث مفرد"), ("هُمَا", "ضمير منفصل غائب مثنى"), ("هُمْ", "ضمير منفصل غائب مذكر جمع"), ("هُنَّ", "ضمير منفصل غائب مؤنث جمع"), ("أَنَا", "ضمير منفصل متكلم مفرد"), ("نَحْنُ", "ضمير منفصل متكلم جمع"),
    ("أَنْتَ", "ضمير منفصل مخاطب مذكر مفرد"), ("أَنْتِ", "ضمير منفصل مخاطب مؤنث مفرد"), ("أَنْتُمَا", "ضمير منفصل مخاطب مثنى"), ("أَنْتُمْ", "ضمير منفصل مخاطب مذكر جمع"), ("أَنْتُنَّ", "ضمير منفصل مخاطب مؤنث جمع"),
    ("كَيْفَ", "اسم استفهام حال"), ("أَيْنَ", "اسم استفهام مكان"), ("مَتَى", "اسم استفهام زمان"), ("كَمْ", "اسم استفهام عدد"), ("مَنْ", "اسم استفهام للعاقل"), ("مَا", "اسم استفهام/موصول لغير العاقل"), ("أَيّ", "اسم استفهام وشرط"),
]
# Particles grown together with a pronoun, with their category.
COMPOUNDS = ["لِمَا", "بِمَا", "فِيمَا", "عَمَّا", "مِمَّا", "كَمَا"]
COMPOUND_CATEGORY = "حرف جر مع ما الموصولة"
INDEX = "nr long, vocalized string, category string, is_operator boolean, source_file string"
AMBIGUOUS = "FUNCTIONAL_CATEGORY_AMBIGUITY"


def supplement(spark: SparkSession) -> DataFrame:
    """The entries that stand beside every catalogue, in index form, numbered behind it."""
    rows = [(w, c, False, "relative_pronouns_and_question_words") for w, c in PRONOUNS] + [(w, COMPOUND_CATEGORY, True, "compound_operators") for w in COMPOUNDS]
    return spark.createDataFrame([((1 << 40) + k, *r) for k, r in enumerate(rows)], INDEX)


def keep_doubling(c: Column) -> Column:
    return F.regexp_replace(c, f"[{ar.TANWIN}{ar.SHORT}{ar.SUKUN}{ar.DAGGER}]", "")


def bare(c: Column) -> Column:
    return F.regexp_replace(c, f"[{ar.TANWIN}{ar.SHORT}{ar.SUKUN}{ar.DAGGER}{ar.SHADDA}]", "")


def _owned(index: DataFrame) -> DataFrame:
    noun = F.col("vocalized").isin(QUESTION_WORDS) | ~F.coalesce("is_operator", F.lit(True))
    owner = F.when(noun, "MABNI_BOUNDARY").otherwise("OPERATOR_BOUNDARY")
    entry = F.struct("nr", "vocalized", owner.alias("owner"), "category", "source_file", F.when(noun, "ISM").otherwise("HARF").alias("word_class"))
    return index.where(F.coalesce(F.trim("vocalized"), F.lit("")) != "").select(entry.alias("e"))


def _result(kind: str, form: Column, e: Column, owner: Column | None = None, word_class: Column | None = None, candidates: Column | None = None, category: Column | None = None) -> Column:
    return F.struct(
        (e["owner"] if owner is None else owner).cast("string").alias("owner"),
        F.lit(kind).alias("match_type"),
        form.alias("matched_form"),
        e["source_file"].alias("source_file"),
        (e["category"] if category is None else category).alias("category"),
        (e["word_class"] if word_class is None else word_class).alias("word_class"),
        (F.array().cast("array<string>") if candidates is None else candidates).alias("candidates"),
    )


def _by_key(text: Column, hit: Column) -> Column:
    """The answer of a key's entries: one vocalised form owns the word, several collide."""
    several = _result("COLLISION", text, hit["e"], F.lit(None), F.lit(""), hit["forms"], F.lit(AMBIGUOUS))
    return F.when(F.size(hit["forms"]) == 1, _result("BARE", hit["e"]["vocalized"], hit["e"])).when(F.size(hit["forms"]) > 1, several)


def _step(done: Column, at: Column, ends: Column) -> Column:
    """done with the answer of one more end. ends: struct(n, text, v, s, b, letters) by length; done: answers of the shorter ends."""
    found = F.when(at["v"].isNotNull(), _result("VOCALIZED", at["v"]["vocalized"], at["v"])).when(at["s"].isNotNull(), _by_key(at["text"], at["s"]))
    harf, operator = F.lit("HARF"), F.lit("OPERATOR_BOUNDARY")
    tries = []
    for p in PROCLITICS:
        rest = F.get(F.filter(done, lambda d: d["n"] == at["n"] - len(p)), F.lit(0))
        deep = rest["answer"]
        fits = at["text"].startswith(p) & (at["n"] > len(p)) & deep.isNotNull() & (deep["match_type"] != "COLLISION")
        form = F.right(at["text"], at["n"] - len(p))
        tries.append(F.when(fits, F.struct(operator.alias("owner"), F.lit("COMPOUND").alias("match_type"), form.alias("matched_form"), deep["source_file"].alias("source_file"), deep["category"].alias("category"), harf.alias("word_class"), F.array().cast("array<string>").alias("candidates"))))
        plain = "".join(c for c in p if c not in ar.MARKS)
        hit = F.get(F.filter(ends, lambda x: x["letters"] == at["letters"] - len(plain)), F.lit(0))["b"]
        fits = bare(at["text"]).startswith(plain) & (at["letters"] > len(plain)) & (F.size(hit["forms"]) == 1)
        tries.append(F.when(fits, _result("COMPOUND", hit["e"]["vocalized"], hit["e"], operator, harf)))
    last = F.when((at["b"].isNotNull()) & (bare(at["text"]) != keep_doubling(at["text"])), _by_key(at["text"], at["b"]))
    return F.concat(done, F.array(F.struct(at["n"].alias("n"), F.coalesce(found, *tries, last).alias("answer"))))


def lookup(words: DataFrame, index: DataFrame, host: str = "host") -> DataFrame:
    """words with owner, match_type, matched_form, source_file, category, word_class and candidates of their host.

    match_type is VOCALIZED, BARE, COMPOUND or COLLISION, and null for words that are not
    functional, among them null and empty ones; a collision has no owner but lists the
    forms it could be, in catalogue order. index: INDEX columns; of entries written alike
    the least nr counts. Distinct hosts are looked up once; repeated rows each get the answer.
    Hosts are words: one that is nothing but proclitics makes a row an end of it.
    """
    e = _owned(index)
    exact = e.groupBy(F.col("e.vocalized").alias("kv")).agg(F.min("e").alias("v"))
    forms = F.array_distinct(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["vocalized"]))
    keyed = e.groupBy(keep_doubling(F.col("e.vocalized")).alias("k")).agg(F.struct(F.min("e").alias("e"), forms.alias("forms")).alias("hit")).where("k <> ''")
    run = f"(?:[وف]{ar.FATHA}|[بل]{ar.KASRA}|ك{ar.FATHA}|ا?ل(?!{ar.KASRA}))*"  # all that chains of proclitics can be made of
    near = F.length(F.regexp_extract("h", f"^{run}{ar.MARK}*(?:[^{ar.MARKS}]{ar.MARK}*){{0,4}}", 0))  # no proclitic leads further in
    ends = words.select(F.col(host).alias("h")).where("h <> ''").distinct().withColumn("n", F.length("h"))
    ends = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(near, F.col("n") - 1)))).select("h", (F.col("n") - F.col("k")).alias("n"), F.right(F.col("h"), F.col("n") - F.col("k")).alias("text"))
    ends = ends.join(exact, F.col("text") == F.col("kv"), "left")
    ends = ends.withColumn("ks", keep_doubling(F.col("text"))).join(keyed.select(F.col("k").alias("k1"), F.col("hit").alias("s")), F.col("ks") == F.col("k1"), "left")
    ends = ends.withColumn("kb", bare(F.col("text"))).join(keyed.select(F.col("k").alias("k2"), F.col("hit").alias("b")), F.col("kb") == F.col("k2"), "left")
    rows = ends.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("n", "text", "v", "s", "b", F.length("kb").alias("letters")))).alias("ends"))
    answer = "struct<owner:string,match_type:string,matched_form:string,source_file:string,category:string,word_class:string,candidates:array<string>>"
    none = F.array().cast(f"array<struct<n:int,answer:{answer}>>")
    folded = F.aggregate("ends", none, lambda done, at: _step(done, at, F.col("ends")))
    got = rows.select(F.col("h").alias("_host"), F.element_at(folded, -1)["answer"].alias("_answer"))
    return words.join(got, words[host] == got["_host"], "left").select(*words.columns, "_answer.*")
