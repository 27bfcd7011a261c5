import numpy as np

from sarfgrid.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = [{int(t): int(n) for t, n in zip(rng.choice(50, 6, replace=False), rng.integers(1, 5, 6))} for _ in range(700)]
    index = tx.Index([f"t{i}" for i in range(50)], list(rng.uniform(1, 3, 50)), list(range(700)), list(rng.integers(0, 2, 700)), vectors)
    dense = np.zeros((700, 50))
    for k, (t, w) in enumerate(index.rows):
        dense[k, t] = w
    for k in range(0, 700, 23):
        t, w = index.rows[k]
        docs, cos = index.nearest(t, w)
        want = np.sort(dense[:, t] @ w)[::-1][: tx.NEIGHBOURS]
        assert np.allclose(np.sort(cos)[::-1], want)


def test_held_out_accuracy_and_evidence(spark):
    got = {r.doc_id: r for r in tx.op3_toxicity(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(got) == 1000 and sum(got[r.doc_id].predicted == r.toxic for r in labels) / len(labels) > 0.93
    assert any(r.evidence for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "idiot " * 5, 0.0)], "doc_id long, text string, score double")
    none = tx.build_index(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in tx.score_toxicity(docs, none).collect()] == [0.0, 0.0, 0.0]


def test_every_term_of_the_sample_counts(spark):
    """Few labels bound chi-square; a least chi-square would leave small inputs without any term."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    index = tx.build_index(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(index.ids) and set(index.term) == {t for i in index.ids.tolist() for t in tx.terms_of(text[i] or "")}
    toxic = [i for i, y in zip(index.ids.tolist(), index.labels.tolist()) if y == 1]
    got = {r.doc_id: r for r in tx.score_toxicity(docs, index).collect()}
    assert toxic and all(got[i].score > index.blank and i in got[i].evidence for i in toxic)


def test_dense_table_changes_no_neighbour(monkeypatch):
    rng = np.random.default_rng(8)
    vectors = [{int(t): int(n) for t, n in zip(rng.choice(60, 9, replace=False), rng.integers(1, 5, 9))} for _ in range(300)]
    made = []
    for dense in (0, 7, 512):
        monkeypatch.setattr(tx, "DENSE", dense)
        index = tx.Index([f"t{i}" for i in range(60)], [1.0 + i / 9 for i in range(60)], list(range(300)), [k % 2 for k in range(300)], vectors)
        made.append([np.round(c, 9).tolist() for _, c in index.all_nearest(index.rows, True)])
    assert made[0] == made[1] == made[2]
