"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and gives the columns of documents; the last
gives token ids. ``run`` writes each stage's rows to the shared folder and reads them
again, so a lost executor costs one stage at most.

A stage that drops documents first numbers its rows and decides on every row by that
number: rows without a doc_id, and rows that share one, are judged each on their own.
A stage's scratch goes when the next stage has made its own: its rows must be written by then.
Null and empty texts fail the quality rules; empty tables give empty results; columns
beyond those of documents are dropped by every stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarfgrid.llm.common import release, scratch, table, written
from sarfgrid.llm.decontamination import decontaminate
from sarfgrid.llm.jaccard_join import jaccard_components
from sarfgrid.llm.quality_rules import quality_rules
from sarfgrid.llm.sentencepiece_lattice import encode
from sarfgrid.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Smaller chunks and fewer known words than op10 takes: executors still hold the earlier stages' memory.
CHUNK_BYTES, KNOWN = 2_500_000, 1 << 17
#: Near copies: shingles of so many words, and the least Jaccard similarity of their sets.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, written so that it stays the same whenever the rows are read."""
    return written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (numbered) but for the rows whose numbers are in rows' doc_id; Spark broadcasts the numbers only if they are few."""
    gone = rows.select(F.col("doc_id").alias("gone"))
    return docs.join(gone, F.col("row") == F.col("gone"), "left_anti").select(*COLUMNS)


#: Scratch of the stage before.
_held: list[str] = []


def tidied(stage):
    """The stage, deleting the scratch of the stage before at its end."""

    @wraps(stage)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = set(scratch())
        out = stage(spark, docs, sf_dir)
        release(spark, _held)
        _held[:] = [x for x in scratch() if x not in before]
        return out

    return run


@tidied
def good_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules of documents and hosts (the source is the host)."""
    return quality_rules(docs, carry=tuple(COLUMNS)).where("kept").select("carried.*")


@tidied
def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of NEAR_PERCENT of shingles of NEAR_WORDS words, one of least id (none counts as the greatest)."""
    docs = numbered(docs)
    groups = jaccard_components(docs, NEAR_PERCENT, id_col="row", words=NEAR_WORDS).select(F.col("doc_id").alias("of"), "component_id")
    ids = docs.select("row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row").alias("rank"))
    ranked = ids.join(groups, ids["row"] == groups["of"]).select("component_id", "rank")
    first = ranked.groupBy(F.col("component_id").alias("of")).agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = ranked.join(first, ranked["component_id"] == first["of"]).where("rank <> first").select(F.col("rank.row").alias("doc_id"))
    return without(docs, written(gone, "pipeline-gone"))


@tidied
def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that start in an earlier document; documents stay, emptied ones too."""
    rest = docs.withColumn("none", F.col("text").isNull())
    out, cut = remove_repeats(rest, carry=("doc_id", "lang", "source", "n_chars", "none")), F.col("n_removed") > 0
    chars = F.when(cut, F.char_length("kept").cast("long")).otherwise(F.col("carried.n_chars"))
    return out.select("carried.doc_id", F.when(~F.col("carried.none"), F.col("kept")).alias("text"), "carried.lang", "carried.source", chars.alias("n_chars"))


@tidied
def decontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    docs = numbered(docs)
    return without(docs, written(decontaminate(docs, table(spark, sf_dir, "benchmark"), id_col="row").select("doc_id"), "pipeline-gone"))


@tidied
def pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gave the text back."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), size=CHUNK_BYTES, known=KNOWN).select("doc_id", "n_pieces", "ids", "ids_sha256", "round_trip", "decoded_sha256")


STAGES = [
    ("quality_rules", good_documents),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("sentencepiece", pieces),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Byte spans and byte-pair ids are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None
