import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from sarfgrid.llm import sentencepiece_lattice as sl  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    r = random.Random(8)
    some = ["", " ", "  ", "a", " a", "a ", "the  cat   sat\n\n on\tthe mat", "x" * 61, "x" * 62, "x" * 63, "the" * 200, " " * 15 + "a", " " * 16, " " * 37 + "1", "漢字 かな 😀 é ñ", "a▁b", "1234 5.6", "\r\n\t", "aaaa aaaaa aaaaaa", "!!??::", "thntiblere ciónmente Gelichtz"]
    some += ["".join(r.choices("abcdeéthin  ,.\n1A", k=r.randint(1, 120))) for _ in range(300)]
    return some


def test_heap_equals_the_library(library):
    p = sl.pieces(PATH)
    for word in ["the", "x" * 80, "thntiblere", "aaaa", "Gelichtz,", "a" * 33]:
        assert p.ids(p.parts(sl.MARK + word)[0]) == library.encode(word)
    for n in range(1, 60):
        assert p.run(n + 1) == library.encode(" " * n)


def test_words_to_fold_equal_a_plain_choice():
    p = sl.pieces(PATH)
    units = list(dict.fromkeys(u for t in texts() for u in p.split(t))) + ["▁▁xqzv", "▁▁▁the", "é" * 3]
    want = {w for u in units if 1 < len(w := p.word_of(u)) <= sl.MASK_CHARS and w not in p.whole and w[-1] in p.core}
    assert p.to_fold(pa.array(units)).to_pylist() == sorted(want)
    assert p.to_fold(pa.array([], pa.string())).to_pylist() == []


def test_units_by_cuts_equal_units_by_masks(monkeypatch):
    p, r = sl.pieces(PATH), random.Random(3)
    monkeypatch.setattr(sl, "CUTS", 4)
    known = sl.Known([], np.zeros(0, np.int64))
    known.held = {}
    for u in {u for t in texts() for u in p.split(t)}:
        word = p.word_of(u)
        mask = 1 | 1 << len(word) | sum(1 << k for k in range(1, len(word)) if r.random() < 0.5)
        own = {word: mask} if 1 < len(word) <= sl.MASK_CHARS and word[-1] in p.core else {}
        assert known.ids(p, u, own) == np.array(p.unit_ids(u, own.get(word)), np.int32).tobytes()


def test_chunks_of_many_settled_units(spark, library, monkeypatch):
    monkeypatch.setattr(sl, "HELD", 50)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    p, seen = sl.pieces(PATH), {}
    for row in sl.chunks(docs, PATH, 3000).collect():
        ids, _, n_units, numbers, lengths, raw = sl.unpack(bytes(row.payload))
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        names = [raw.tobytes()[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        stop = np.cumsum(n_units)
        for i, a, b in zip(ids, [0, *stop], stop, strict=False):
            seen[int(i)] = [names[k] for k in numbers[a:b]]
    assert seen == {i: p.split(t) for i, t in rows}


def test_encoding_equals_the_library_and_decodes(spark, library):
    rows = [(k, t, 1) for k, t in enumerate(texts())] + [(None, "no id", 1), (5000, None, 1), (3, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for size, known in ((10_000_000, sl.KNOWN), (2000, sl.KNOWN), (2000, 100), (2000, 0)):
        got = sl.decode(sl.encode(df, PATH, size=size, known=known), PATH).collect()
        assert len(got) == len(rows)
        want = sorted((i if i is not None else -1, library.encode(t or "")) for i, t, _ in rows)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got) == want
        assert sorted(r.decoded for r in got) == sorted((t or "").replace("▁", " ") for _, t, _ in rows)
        assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)


def test_documents_equal_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = sl.op10_sentencepiece(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(library.encode(docs[r.doc_id]), np.int32)
        assert (r.n_pieces, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert sl.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
