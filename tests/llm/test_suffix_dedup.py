import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sarfgrid.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    rows = [(sd.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in rows:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if i == sd.LAST else i, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = sd.remove_repeats(df, **k).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdé", k=r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(10)]
    texts = []
    for _ in range(90):
        t = []
        for _ in range(r.randint(0, 5)):
            t.append(r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 40))))
        t = " ".join(t)
        if r.random() < 0.4 and len(t) > 100:
            k = r.randrange(len(t) - 90)
            t = t[k : k + r.randint(45, 90)] + t
        texts.append(t)
    texts += ["a" * 300, "ab" * 200, "a" * 120, "\0" * 120, "x" + "\0" * 80, "Of Of " * 80, None, "", "é" * 60, "é" * 55]
    texts += r.choices(texts, k=15)
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("size", [8_000_000, 700])
def test_spans_equal_brute_force(spark, size):
    rows = corpus(size)
    assert run(spark, rows, chunk_bytes=size, bucket_bytes=size) == brute(rows)


def test_odd_rows(spark):
    t = "the quick brown fox jumps over the lazy dog and runs away from it"
    rows = [(None, t), (3, t), (3, t), (5, t + "!"), (6, t[:49])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_batches_and_levels_equal_one_batch(monkeypatch):
    rng = np.random.default_rng(2)
    view = rng.integers(97, 99, (400, sd.WIDTH)).astype(np.uint8)
    view[:, 15:70] = view[rng.integers(0, 20, 400), 15:70]
    ids, full = rng.integers(0, 60, 400), np.full(400, sd.REACH, np.uint8)
    one = sd.scan(ids, view, full, full)
    monkeypatch.setattr(sd, "BATCH", 300)
    many = sd.scan(ids, view, full, full)
    assert (one[0] == many[0]).all() and (one[1] == many[1]).all() and (one[1] >= 0).any()


def test_levels_merge_geometrically():
    levels = sd.Levels()
    for k in range(64):
        levels.add(np.array([b"%03d" % k]))
    assert len(levels.levels) <= 7 and levels.holds(np.array([b"000", b"063", b"064"])).tolist() == [True, True, False]


def test_long_text_is_cut_into_slabs(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 5000).astype(np.uint8)
    whole = sd.anchors(raw)
    monkeypatch.setattr(sd, "SLAB", 333)
    parts = sd.anchors(raw)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_every_chunk_gets_its_own_spans():
    rng = np.random.default_rng(8)
    same = rng.integers(97, 123, sd.WIDTH).astype(np.uint8)
    full = np.full(1, sd.REACH, np.uint8)
    blobs = [sd.pack(sd.entry(np.array([k]), np.array([k]), np.array([30 + k]), full, full), same) for k in range(50)]
    got = sd.find_spans(pa.table({"chunk": pa.array(range(50), pa.int64()), "kind": pa.array([1] * 50, pa.int32()), "blob": pa.array(blobs, pa.binary())}))
    spans = {c: [x.tolist() for x in sd.unpack(b)] for c, b in zip(got["chunk"].to_pylist(), got["blob"].to_pylist())}
    assert spans == {k: [[k], [k], [k + sd.WIDTH]] for k in range(1, 50)}


def test_prints_go_to_fewer_buckets_than_surroundings(spark, monkeypatch):
    sent, real = [], sd.send_prints
    monkeypatch.setattr(sd, "send_prints", lambda n: sent.append(n) or real(n))
    rows = corpus(11)
    total = sum(len((t or "").encode()) for _, t in rows)
    assert run(spark, rows, chunk_bytes=700, bucket_bytes=200) == brute(rows)
    assert sent[0] <= max(8, -(-total // 200) // 4 + 1)
