import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from sarfgrid.llm.token_counts import TokenCounter, count_tokens  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "Hello World's it'll 123 ½²", "a<|endoftext|>b <|startoftext|>", "<|STARTOFTEXT|>", "İstanbul ΣΑΣ ﬁ", "éå", "漢字 かな　x", "!!'s 's", "x\x85y\xa0z\x1cq", "a" * 5000, "😀😀 ok", "Ünïcödé straße", "\x00\x01", "a‍b", "Dž ǅ"]


def test_equals_the_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(PATH), TokenCounter(PATH)
    for t in TEXTS:
        assert own.count(t) == len(tok.encode(t, add_special_tokens=False).ids), t


def test_documents_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = count_tokens(docs, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "a b", 7), (2, "a b", 7)], "doc_id long, text string, n_tokens long")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 3, 2), (2, 3, 2)]
    assert count_tokens(df.limit(0), PATH).count() == 0
