import re
from collections import Counter

import numpy as np

from sarfgrid.llm import quality_model as qm
from sarfgrid.llm import quality_rules as qr

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(wins)
    hit = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


ODD = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 300, "l1 w\nl1 w\n\n \nl1 w", "é# <b> 漢字 $%", "one two three four five six seven eight nine ten one two three four five x y"]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "h", 1, 2) for i, t in enumerate(ODD)] + [(0, "a b", None, 1, 2)], "doc_id long, text string, source string, n_words int, host int")
    got = {(r.doc_id, r.n_words): r for r in qr.quality_rules(df).collect()}
    assert len(got) == len(ODD) + 1
    for i, t in enumerate(ODD):
        b = brute(t)
        r = got[i, b[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, t
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
    assert qr.quality_rules(df.limit(0)).count() == 0


def test_bad_host_goes_with_all_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 == 0 else "bad", "bad.example") for i in range(400)] + [(1000 + i, good, f"ok{i % 20}.example") for i in range(400)]
    got = {r.doc_id: r.kept for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(400)) and all(got[1000 + i] for i in range(400))


def test_trees_learn_and_handle_odd_labels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = qm.BoostedTrees.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.97
    assert qm.BoostedTrees.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((1, 3)))[0] == 0.5
    assert qm.BoostedTrees.fit(x[:5], np.ones(5)).score(x[:1])[0] > 0.8


def test_quality_held_out_accuracy(spark):
    got = {r.doc_id: r for r in qm.op2_quality_classifier(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(got) == 1000 and sum(a == b for a, b in held) / len(held) > 0.97
    docs = spark.createDataFrame([(1, None, 3), (None, "", 4)], "doc_id long, text string, score int")
    out = qm.score_quality(docs, qm.train(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect()
    assert [r.score for r in out] == [0.5, 0.5]


def naive_scores(x, y, trees):
    """Boosting by the definition: every split tried row by row, every tree walked node by node."""
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, qm.BINS + 1)[1:-1]).tolist())) for c in x.T]
    p = (y.sum() + 0.5) / (len(y) + 1)
    z = [float(np.log(p / (1 - p)))] * len(y)

    def gain(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + qm.RIDGE)

    def grow(rows, depth, g, h):
        if depth == qm.DEPTH:
            return -qm.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + qm.RIDGE)
        best, split = 1e-9, None
        for f, edges in enumerate(cuts):
            for e in edges:
                low, high = [i for i in rows if x[i, f] <= e], [i for i in rows if x[i, f] > e]
                if min(len(low), len(high)) >= qm.LEAST:
                    got = gain(low, g, h) + gain(high, g, h) - gain(rows, g, h)
                    if got > best + 1e-12:
                        best, split = got, (f, e, low, high)
        if split is None:
            return None, None, grow(rows, depth + 1, g, h), None
        f, e, low, high = split
        return f, e, grow(low, depth + 1, g, h), grow(high, depth + 1, g, h)

    def walk(node, row):
        while isinstance(node, tuple):
            f, e, low, high = node
            node = low if f is None or row[f] <= e else high
        return node

    for _ in range(trees):
        q = [1 / (1 + np.exp(-v)) for v in z]
        tree = grow(list(range(len(y))), 0, [a - b for a, b in zip(q, y)], [a * (1 - a) for a in q])
        z = [v + walk(tree, row) for v, row in zip(z, x)]
    return 1 / (1 + np.exp(-np.array(z)))


def test_trees_equal_the_naive_search_and_walk(monkeypatch):
    monkeypatch.setattr(qm, "TREES", 3)
    monkeypatch.setattr(qm, "BINS", 9)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = np.round(rng.normal(size=(150, 3)), 2)
        y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=150) * 0.3) > 0).astype(float)
        assert np.allclose(qm.BoostedTrees.fit(x, y).score(x), naive_scores(x, y, 3), atol=1e-9)


def test_empty_documents_and_repeated_rows(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert qm.score_quality(none, qm.train(none, labels)).count() == 0
    same = spark.createDataFrame([(1, "a b c", 7), (1, "a b c", 8), (2, "", 9)], "doc_id long, text string, predicted int")
    got = qm.score_quality(same, qm.train(same, labels)).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 1}) == 1
