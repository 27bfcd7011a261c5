import random

from sarfgrid.llm import decontamination as dc


def brute(item, text):
    """Least edit distance of item to any substring of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, d in enumerate(item):
            new.append(min(row[k] + (c != d), row[k + 1] + 1, new[k] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(r, t, n):
    t = list(t)
    for _ in range(n):
        k = r.randrange(len(t))
        kind = r.random()
        t[k : k + (kind < 0.7)] = [r.choice("abc ")] if kind > 0.3 else []
    return "".join(t)


def test_myers_equals_the_table():
    r = random.Random(4)
    for _ in range(300):
        item, text = ("".join(r.choices("ab c", k=r.randint(1, n))) for n in (90, 140))
        want = brute(item, text)
        got = dc.best_match(item, text, len(item))
        assert (got[0] if got else len(item)) == want


def test_matches_equal_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(r.choice([2, 20, 45])))) for k in range(15)] + [(90, None), (91, " ."), (92, "Solo"), (3, None)]
    items.append((93, items[4][1].upper() + "!"))
    docs = []
    for k in range(160):
        t = " ".join(word() for _ in range(r.randint(0, 40)))
        if k % 2:
            it = r.choice(items[:15])[1]
            t += " " + edited(r, it, r.randint(0, len(it) // 12)) + " " + word()
        docs.append((k, t))
    docs += [(500, None), (501, ""), (None, "say solo."), (502, "s-o-l-o")]
    want = []
    for i, t in docs:
        hit = sorted({j for j, x in items if dc.normal(x) and brute(dc.normal(x), dc.normal(t)) <= len(dc.normal(x)) * 5 // 100})
        if hit:
            want.append((i, hit))
    key = lambda x: (x[0] is None, x[0] or 0)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for size in (4_000_000, 600):
        got = sorted(((x.doc_id, x.item_ids) for x in dc.decontaminate(d, b, block_chars=size).collect()), key=key)
        assert got == sorted(want, key=key) and len(got) > 30
    assert dc.decontaminate(d, b.limit(0)).count() == 0 and dc.decontaminate(d.limit(0), b).count() == 0


def test_planted_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [dc.normal(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if any(x in dc.normal(r.text) for x in items)}
    got = {r.doc_id for r in dc.op7_decontamination(spark, sf).collect()}
    assert want and want <= got and len(got) <= len(want) + 2


def test_blocks_keep_rows_that_share_an_id(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(12)]
    docs = [(i, f"{word()} {items[k][1]} {word()}") for i, k in ((None, 0), (None, 1), (7, 2), (7, 3), (8, 4))]
    docs += [(None, docs[0][1]), (7, docs[2][1]), (8, docs[4][1]), (9, items[5][1] + " " + items[6][1] + " " + items[7][1])] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, dc.decontaminate(d, b, block_chars=size).collect())) for size in (4_000_000, 300))
    assert one == many and len(one) == len(docs)
