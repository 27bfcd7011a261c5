from pyspark.sql import functions as F

from sarfgrid.operators import alignment, wordclass

WORDS = "id int, host string, root array<string>, root_directive string, wazn_id string"


def test_two_fitting_patterns_defer_with_both(spark):
    own = alignment.catalogue(spark)
    twice = own.unionByName(own.where("wazn_id = 'FA_A_LA'").withColumn("wazn_id", F.lit("AGAIN")).withColumn("evidence_rank", F.lit(9)))
    words = spark.createDataFrame([(1, "ضَرَبَ", list("ضرب"), "ACCEPT", "x")], WORDS).drop("wazn_id")
    row = alignment.project(words, twice).first()
    assert (row.wazn_directive, row.wazn_id, row.candidates, row.residual) == ("DEFER", None, ["AGAIN", "FA_A_LA"], "defer:wazn:multiple_licensed_patterns")


def test_merging_needs_the_pattern_s_licence(spark):
    own = alignment.catalogue(spark)
    words = spark.createDataFrame([(1, "مَدَّ", list("مدد"), "ACCEPT")], "id int, host string, root array<string>, root_directive string")
    row = alignment.project(words, own.where("wazn_id = 'FA3L'")).first()
    assert (row.wazn_directive, row.candidates) == ("DEFER", [])  # all radicals are there, in order, but no pattern fits
    row = alignment.project(words, own.where("wazn_id = 'FA_A_LA'")).first()
    assert (row.wazn_directive, row.operations) == ("ACCEPT", [alignment.MERGED])


def test_no_row_is_lost_or_doubled(spark):
    rows = [(1, "ضَرَبَ", list("ضرب"), "ACCEPT"), (1, "ضَرَبَ", list("ضرب"), "ACCEPT"), (None, None, None, None), (2, "", [], "ACCEPT"), (3, "ضَرَبَ" * 2000, list("ضرب"), "ACCEPT"), (4, "ضَرَبَ", ["ض", None, "ب"], "ACCEPT")]
    words = spark.createDataFrame(rows, "id int, host string, root array<string>, root_directive string")
    got = alignment.project(words, alignment.catalogue(spark)).collect()
    assert sorted((r.id or 0, r.wazn_directive or "", r.residual or "") for r in got) == [(0, "", "contract:unknown_directive"), (1, "ACCEPT", ""), (1, "ACCEPT", ""), (2, "", "contract:accepted_without_root"), (3, "BLOCK", "block:wazn:no_licensed_pattern"), (4, "", "contract:prohibited_radical")]
    assert alignment.project(words.limit(0), alignment.catalogue(spark)).count() == 0
    none = alignment.project(words, alignment.catalogue(spark).limit(0)).where("id = 1").first()
    assert (none.wazn_directive, none.residual) == ("DEFER", "defer:wazn:unlicensed_but_structural_augment")


def test_requests_may_lack_columns_and_values(spark):
    d = spark.createDataFrame([(1, None), (2, "verbal_root_path")], "id int, path string")
    got = {r.id: (r.word_class_verdict, r.subclass, r.evidence) for r in wordclass.decide(d).collect()}
    assert got == {1: ("DEFERRED", None, None), 2: ("ACCEPTED", "VERBAL_PAST", "MORPHOLOGY_PATH_VERBAL")}
    assert wordclass.decide(d.limit(0)).count() == 0
