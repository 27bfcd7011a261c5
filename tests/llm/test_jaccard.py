import random
import re
import time

import numpy as np
import pytest
import test_common

from sarfgrid.llm import jaccard_join as jj
from sarfgrid.llm.components import connected_components
from sarfgrid.llm.shingles import shingle_set


def brute(rows, percent=90):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    index, parent = {}, list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        count = {}
        for g in s:
            for o in index.get(g, ()):
                count[o] = count.get(o, 0) + 1
            index.setdefault(g, []).append(k)
        for o, c in count.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, key int, n int")
    return sorted(tuple(r) for r in jj.jaccard_components(df).collect())


def corpus(seed, groups=12, copies=9):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(groups):
        base = r.choices(vocab, k=r.choice([2, 5, 30, 90, 400]))
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append(" ".join(t))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2_000_000, 900])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", block)
    rows = corpus(block)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two"), (7, "É a b"), (8, "é a b"), (9, "x " * 5000), (10, "x " * 4000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(5, "a b c d")] * 3) == [(5, 2, 5)] * 3
    assert run(spark, []) == []


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(tuple(r) for r in jj.jaccard_components(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_divide_skip_equals_all_pairs():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10_000, 120, replace=False)).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(120, rng.integers(0, 12), replace=False)] = rng.integers(20_000, 90_000, 1)
        sets.append(np.unique(s))
    lists = jj.Lists(sets)
    for q in range(60):
        want = [x for x in range(60) if x != q and 100 * len(np.intersect1d(sets[x], sets[q])) >= 90 * len(np.union1d(sets[x], sets[q]))]
        assert lists.partners(q, 90, lambda c: np.ones(len(c), bool)).tolist() == want


def test_shingles_tell_words_apart():
    assert len(shingle_set("a b c a b c d")) == 4 and len(shingle_set("ab c d")) == 1
    assert shingle_set("a bc d")[0] != shingle_set("ab c d")[0]


def test_connected_components(spark):
    e = [(k, k + 1) for k in range(50)] + [(100, 99), (7, 7), (200, 300), (300, 201)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(51)) and got[100] == got[99] == 99 and got[300] == got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 900])
def test_every_link_is_given(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", block)
    rows = [*corpus(3), (900, None), (901, ""), (902, "a b c d e"), (903, "a b c d e")]
    sets = {i: set(shingle_set(t).tolist()) for i, t in rows}
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 90 * len(a | b)
    want = {i: sum(j != i and linked(sets[i], sets[j]) for j in sets) for i in sets}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs, pairs = jj.jaccard_links(df)
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: r.n_links for i, r in got.items()} == want and max(want.values()) > 2
    key = {r.set_key: i for i, r in got.items()}
    mine = [tuple(sorted((key[r.a], key[r.b]))) for r in pairs.collect()]
    different = sorted(key.values())
    assert sorted(mine) == [(i, j) for i in different for j in different if i < j and linked(sets[i], sets[j])]


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_partners_share_a_listed_part_and_agree_in_outline(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for n in [*range(2, 40), 60, 130, 500, 2000]:
        for _ in range(12):
            s = np.unique(rng.integers(0, 2**64, n, np.uint64))
            lost, more = sorted(rng.integers(0, max(2, n * (100 - percent) // 90), 2).tolist())
            t = np.unique(np.concatenate([s[lost:], rng.integers(0, 2**64, more - lost, np.uint64)]))
            both = len(np.intersect1d(s, t))
            if 100 * both >= percent * len(np.union1d(s, t)) and (len(s) != both or len(t) != both):
                met += 1
                assert len(np.intersect1d(jj.signatures(s, percent)[0], jj.signatures(t, percent)[0]))
                lines = [dict(zip(*jj.outlines(x, percent), strict=True)) for x in (s, t)]
                assert any(jj.alike(np.arange(2), [x[k] for x in lines], percent) for k in set(lines[0]) & set(lines[1]))
    assert met > 100


def test_a_shared_passage_makes_no_cluster(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**9)}"
    passage = [word() for _ in range(45)]
    rows = [(k, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for k in range(300)]
    rows += [(k + 1000, t + " end") for k, t in rows[:5]]
    sizes, real = [], jj.links

    def links(sets, clusters, *a):
        sizes.extend(x["count"] for x in clusters.groupBy("root").count().collect())
        return real(sets, clusters, *a)

    monkeypatch.setattr(jj, "links", links)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: c for i, _, c in jj.jaccard_components(df, 80, words=5).collect()}
    assert all(got[k + 1000] == k for k in range(5)) and len(set(got.values())) == 300
    assert max(sizes) <= 10


def test_candidate_shuffles_are_gone_before_the_links_are_searched(spark, monkeypatch):
    left, real, before = [], jj.links, test_common.shuffle_files(spark)

    def links(*a):
        deadline = time.time() + 10  # files go in the background
        while test_common.shuffle_files(spark) - before and time.time() < deadline:
            time.sleep(0.1)
        left.append(test_common.shuffle_files(spark) - before)
        return real(*a)

    monkeypatch.setattr(jj, "links", links)
    rows = corpus(6)
    assert run(spark, rows) == brute(rows)
    assert left == [set()]
