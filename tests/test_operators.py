import json
import random
import unicodedata

from pyspark.sql import functions as F

from sarfgrid.functions import arabic as ar
from sarfgrid.functions import roots, syllable
from sarfgrid.functions import text as tx
from sarfgrid.operators import evaluation, inflection, lookup, patterns, segmentation, spans, tokens
from sarfgrid.sources import io


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def many(spark, values, fn):
    return [r["y"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").select("k", fn(F.col("x")).alias("y")).orderBy("k").collect()]


def test_cleaning(spark):
    assert one(spark, " See <b>THIS</b> https://a.b/c?d=1 now, 42! ", tx.clean) == "see this now 42"
    assert one(spark, "A1 b2", lambda c: tx.clean(c, lowercase=False, remove_nums=True)) == "A b"
    assert one(spark, " Hi there.  How? ok", tx.sentence_tokenize) == ["Hi there.", "How?", "ok"]
    assert one(spark, None, tx.clean) is None and one(spark, "", tx.word_tokenize) == []
    assert tuple(one(spark, "«(a.b)!", lambda c: tx.strip_punct(c, "«()!."))) == ("«(", "a.b", ")!")


def test_normal_forms(spark):
    assert one(spark, "آمَنُوا", ar.normalize) == "ءَامَنُوا"
    assert one(spark, "الرَّجُل", ar.normalize) == "ءَلرْرَجُل"
    assert one(spark, "آمَنَ", ar.canonical_normalize) == "ءَمَنَ"
    r = random.Random(3)
    words = ["".join(r.choice("اويبء") + "".join(r.sample("ًٌٍَُِّْٰ", r.randint(0, 3))) + r.choice(["", "", "ٓ", "ٔ", "ٕ"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    assert many(spark, words, ar.nfc) == [unicodedata.normalize("NFC", w) for w in words]


def test_syllables_and_gate(spark):
    words = ["كَتَبَ", "كِتَاب", "اِسْتَ", "كَتَبُوا", "بَيْتْ", "مَدْدْدْ", "ا", "", "بَاا"]
    got = many(spark, words, lambda c: syllable.slots(syllable.classes(c)))
    assert got[0] == "CV CV CV" and got[1] == "CV CVVC" and got[3] == "CV CV CVV F"
    gates = many(spark, words, lambda c: syllable.word_gate(syllable.slots(syllable.classes(c))))
    assert gates[0] == "ACCEPT" and gates[3] == "ACCEPT" and gates[5] == "DEFER" and gates[6] == "BLOCK" and gates[7] == "DEFER"


def test_roots(spark):
    got = many(spark, ["كتب", "وفي", "قول", "دعي", "وجد", "مدد", "سءل", "ب", "بت", "دحرج", "استفع"], lambda c: F.concat_ws("|", roots.analyse_radicals(c)["directive"], roots.analyse_radicals(c)["kind"], roots.analyse_radicals(c)["reason"]))
    assert [g.split("|")[0] for g in got] == ["ACCEPT", "DEFER", "DEFER", "DEFER", "DEFER", "ACCEPT", "ACCEPT", "BLOCK", "DEFER", "DEFER", "DEFER"]
    assert got[5] == "ACCEPT|geminate" and got[6] == "ACCEPT|hamza"


def test_clitics(spark):
    assert many(spark, ["كِتَابُهُمْ", "كَتَبُوا", "بَيْتُنَا", "هُمْ"], segmentation.enclitic) == ["هم", None, "نا", None]
    got = many(spark, ["وَكَتَبَ", "بِالْقَلَمِ", "سَيَكْتُبُ", "سَكَتَ", "وَلَد"], lambda c: segmentation.proclitic(c)["particle"])
    assert got == ["و", "ب", "س", None, None]
    assert tuple(one(spark, "وَالْكِتَابُ", lambda c: tokens.split_clitic(c, ["كان"]))) == ("وَ", "الْكِتَابُ")
    assert tuple(one(spark, "الشَّمْسُ", ar.article_span)) == ("ال", "شَمْسُ", "solar")


def test_patterns_and_inflection(spark):
    df = spark.createDataFrame([("كَاتِب",), ("مَكْتُوب",), ("كَتَّاب",), ("قرد",)], "surface string")
    got = {r.surface: (r.verdict, r.wazn_ids) for r in patterns.match(df).collect()}
    assert got["كَاتِب"] == ("ACCEPT", "FA3IL") and got["مَكْتُوب"] == ("ACCEPT", "MAF3UL") and got["كَتَّاب"] == ("ACCEPT", "FA33AL") and got["قرد"][0] == "BLOCK"
    r = spark.createDataFrame([("كتب",), ("فعل",), ("عفل",)], "root string")
    forms = {(x.root, x.type, x.pattern): x.form for x in patterns.derive(r, patterns.DERIVATIVES, ["type", "family", "pattern", "transitivity"]).collect()}
    assert forms["كتب", "ISM_MAF3UL", "مَفْعُول"] == "مَكْتُوب" and forms["عفل", "ISM_FA3IL", "فَاعِل"] == "عَافِل"
    c = {(x.tense, x.mood, x.voice, x.person, x.number, x.gender): x.form for x in inflection.conjugate(r.limit(1), "a", "u").collect()}
    assert c["PAST", None, "ACTIVE", "3", "PL", "M"] == "كَتَبُوا" and c["IMPERFECT", "JUSSIVE", "ACTIVE", "3", "PL", "M"] == "يَكْتُبُوا"
    assert c["IMPERFECT", "INDICATIVE", "PASSIVE", "3", "SG", "M"] == "يُكْتَبُ"


def test_lookup_evaluation_spans(spark):
    cat = spark.createDataFrame([("مَنْ", "MABNI", 1), ("مِنْ", "OPERATOR", 2), ("هَلْ", "OPERATOR", 3), ("هَلْ", "LATE", 4)], "vocalised string, owner string, ord int")
    assert {r.vocalised: r.owner for r in lookup.first_wins(cat, "vocalised", "ord").collect()}["هَلْ"] == "OPERATOR"
    w = spark.createDataFrame([("مِنْ",), ("من",), ("هل",), ("كَتَبَ",)], "surface string")
    got = {r.surface: (r.tier, r.owner) for r in lookup.cascade(w, cat.drop("ord")).collect()}
    assert got == {"مِنْ": ("EXACT", "OPERATOR"), "من": ("COLLISION", None), "هل": ("BARE", "LATE"), "كَتَبَ": ("NONE", None)}
    res = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, f string, g string")
    gold = spark.createDataFrame([(1, "a", "y"), (2, "c", None)], "k int, f string, g string")
    assert {r.field: (r.compared, r.mismatches) for r in evaluation.gold_mismatches(res, gold, "k", ["f", "g"]).collect()} == {"f": (2, 1), "g": (1, 1)}
    diff = {r.k: (r.change, r.fields) for r in evaluation.snapshot_diff(res, gold.where("k = 2"), "k", ["f", "g"]).collect()}
    assert diff == {1: ("REMOVED", ""), 2: ("CHANGED", "f,g")}
    s = spans.normalization_spans(spark.createDataFrame([("آدَمُّ",)], "surface string"))
    rows = [tuple(r)[1:] for r in s.orderBy("k").collect()]
    assert rows[0] == (0, 0, 1, 0, 3, "EXPAND") and rows[-1][-1] == "EXPAND" and rows[1][:5] == (1, 1, 3, 3, 5)
    q = spark.createDataFrame([("آدَمُّ", 0, 2)], "surface string, start int, end int")
    assert tuple(spans.project(s, q, "surface").first())[3:] == (0, 5)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\n two \n")
    assert [r.value for r in io.read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"_comment": "x"}\n{"a": 2}\n')
    assert [r.a for r in io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, _comment string", "_comment").collect()] == [1, 2]
    (tmp_path / "a.json").write_text(json.dumps({"a": [1, 2]}, indent=1))
    assert io.read_json(spark, str(tmp_path / "a.json"), "a array<int>").first().a == [1, 2]
    (tmp_path / "c1.csv").write_text("form,x\nab,1\n")
    (tmp_path / "c2.csv").write_text("vocalized,form,y\n,cd,2\nef,gh,3\n")
    c = io.read_catalogue(spark, [str(tmp_path / "c1.csv"), str(tmp_path / "c2.csv")], {"surface": ["vocalized", "form"], "none": ["z"]})
    assert sorted(r.surface for r in c.collect()) == ["ab", "cd", "ef"] and {r.none for r in c.collect()} == {None}
    io.write_csv(c.groupBy("none").agg(F.sort_array(F.collect_list("surface")).alias("all")).drop("none"), str(tmp_path / "out"))
    assert io.read_csv(spark, str(tmp_path / "out")).first()["all"] == "ab; cd; ef"
    io.write_jsonl(c, str(tmp_path / "j"))
    assert io.read_jsonl(spark, str(tmp_path / "j"), "surface string").count() == 3
    assert io.read_text(spark, str(tmp_path / "a.txt")).first().value.startswith("  one")


def test_segmentation_and_word_class(spark):
    from sarfgrid.operators import wordclass

    words = ["وَالْكِتَابُ", "مِنْ", "هَذَا", "بِكِتَابِهِمْ", "يَكْتُبُ", "كَاتِبٌ", "كَتَّاب", "الْكِتَابُ"]
    df = spark.createDataFrame([(w, "ACCEPT") for w in words] + [("مِن", "BLOCK")], "surface string, gate string")
    got = {r.surface: (r.route, r.host) for r in df.select("surface", segmentation.segment(F.col("surface")).alias("s")).select("surface", "s.*").collect()}
    assert got["وَالْكِتَابُ"] == ("PROCLITIC+ARTICLE+HOST", "كِتَابُ") and got["مِنْ"] == ("OPERATOR", "مِنْ") and got["هَذَا"] == ("PROTECTED", "هَذَا")
    assert got["بِكِتَابِهِمْ"] == ("PROCLITIC+HOST+ENCLITIC", "كِتَابِ")
    got = {r.surface: (r.word_class, r.reason) for r in df.select("surface", wordclass.classify(F.col("surface"), F.col("gate")).alias("s")).select("surface", "s.*").collect()}
    assert got["مِنْ"] == ("HARF", "OPERATOR") and got["الْكِتَابُ"] == ("ISM", "ARTICLE") and got["يَكْتُبُ"] == ("FI3L", "IMPERFECT_PREFIX")
    assert got["كَاتِبٌ"] == ("ISM", "TANWIN") and got["كَتَّاب"] == ("ISM", "NOMINAL_PATTERN") and got["مِن"] == (None, "UPSTREAM_BLOCK")


def test_stream_equals_batch(spark, tmp_path):
    from sarfgrid.streaming import gates

    rows = [("2024-01-01 00:0%d:00" % (k % 10), "كَتَبَ مَدْدْدْ بَيْت") for k in range(20)]
    df = spark.createDataFrame(rows, "t string, text string").select(F.col("t").cast("timestamp").alias("t"), "text")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = gates.gate_counts(stream, "t", "text").writeStream.format("memory").queryName("gate_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.verdict: r.n for r in spark.table("gate_counts").collect()} == {"ACCEPT": 40, "DEFER": 20}
