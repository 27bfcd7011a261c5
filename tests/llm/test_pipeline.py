import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import test_decontamination  # noqa: E402
import test_jaccard  # noqa: E402
import test_quality  # noqa: E402

import corpus_pipeline  # noqa: E402
from sarfgrid.llm import decontamination as dc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, i int"


def fixture():
    r = random.Random(31)
    word = lambda: "".join(r.choices("abcdefghé", k=r.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(k, line(18)) for k in range(4)]
    passage, docs = line(30), []
    for k in range(40):
        t = line(r.randint(12, 60))
        if k % 5 == 0:
            t = line(10) + " " + passage + " " + t
        if k % 7 == 3:
            t += " " + items[k % 4][1] + " " + word()
        docs.append(t)
    docs += [docs[3], docs[8], docs[20] + " more", "", "short", line(6) + " x y z x y z x y z x y z x y z x y z", None]
    ids = list(range(len(docs)))
    r.shuffle(ids)
    return [(i, t, "en", "s1", len(t or ""), 1, 2) for i, t in zip(ids, docs)], items


def brute(docs, items):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = []
    for i, t, *_ in docs:
        n, _, _, _, again = test_quality.brute(t)
        if n >= 10 and 100 * again <= 20 * n:
            rows.append((i, t))
    least = {i: c for i, _, c in test_jaccard.brute(rows)}
    rows = [(i, t) for i, t in rows if least[i] == i]
    first = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    cut = []
    for i, t in rows:
        b, gone = t.encode(), set()
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone.update(range(p, p + 50))
        cut.append((i, bytes(c for k, c in enumerate(b) if k not in gone).decode(errors="ignore")))
    normal = [dc.normal(t) for _, t in items]
    clean = [(i, t) for i, t in cut if not any(test_decontamination.brute(x, dc.normal(t)) <= len(x) * 5 // 100 for x in normal)]
    assert len(docs) > len(rows) > len(clean) and cut != rows
    return sorted((i, hashlib.sha256(np.array(sp.encode(t), np.int32).tobytes()).hexdigest()) for i, t in clean)


def test_run_equals_brute_force(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == brute(docs, items)
    assert all(r.round_trip for r in got)


def test_every_stage_takes_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(None, long, None, None, None, 1, 2), (3, long, "en", None, 5, 1, 2), (3, long, "en", None, 5, 1, 2), (4, None, None, "s", None, 1, 2), (5, "", "en", "s", 0, 1, 2)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= len(data)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(data)


def near_copies(rows, words=5, percent=80):
    """Ids that go, by all pairs: linked to a lower id."""
    sets = {i: {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} for i, t in rows if (w := t.lower().split())}
    root = {i: i for i, _ in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {i for i in root if root[i] != i}


def test_near_copies_are_of_five_words_and_four_fifths(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(40, 70))]
        changed, longer = list(base), base + [f"w{r.randrange(10**6)}" for _ in range(len(base) * r.choice([1, 2, 3]) // 12)]
        changed[len(base) // 2] = "other"
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(changed)), (10 * g + 2, " ".join(longer))]
    gone = near_copies(rows)
    assert gone > near_copies(rows, 3, 90)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1, 2) for i, t in rows], SCHEMA)
    got = {x.doc_id for x in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()}
    assert got == {i for i, _ in rows} - gone


def test_every_row_is_decided_on_its_own(spark, tmp_path):
    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    item, a, b, c = line(20), line(40), line(40), line(40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def texts(stage, *rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, 2) for i, t in rows], SCHEMA)
        return sorted((x.doc_id or -1, x.text) for x in stage(spark, docs, str(tmp_path)).collect())

    good = [(k, line(30)) for k in range(20, 40)]
    rejected = [(None, None), (None, "short"), (7, "short"), (None, "")]
    assert texts(corpus_pipeline.good_documents, *good, (None, a), (7, b), *rejected) == sorted([*good, (-1, a), (7, b)])
    near = [(None, a), (None, a + " more"), (None, a), (3, b), (3, b), (3, b + " more"), (None, b), (3, c), (None, None)]
    got = [(i, t and t.removesuffix(" more")) for i, t in texts(corpus_pipeline.one_of_each_group, *near[:-1])]
    assert sorted(got) == sorted([(-1, a), (3, b), (3, c)])
    leaks = [(None, f"{a} {item}"), (5, f"{item} {b}"), (5, f"{item} {b}")]
    assert texts(corpus_pipeline.decontaminated, *leaks, (None, a), (5, b)) == sorted([(-1, a), (5, b)])
