import random

from sarfgrid.functions import arabic as ar
from sarfgrid.operators import functional as fn

KEPT = ar.TANWIN + ar.SHORT + ar.SUKUN + ar.DAGGER


def key(w, off):
    return "".join(c for c in w if c not in off)


def plain(host, entries):
    """(match, form, category) by recursion over one host's ends."""

    def by(k):
        return list(dict.fromkeys(w for w, _ in entries if key(w, KEPT) == k))

    def of_key(k, text):
        forms = by(k)
        if len(forms) == 1:
            return "BARE", forms[0], next(c for w, c in entries if w == forms[0])
        return ("COLLISION", text, fn.AMBIGUOUS) if forms else None

    if not host:
        return None
    for w, c in entries:
        if w == host:
            return "VOCALIZED", w, c
    if got := of_key(key(host, KEPT), host):
        return got
    bare = key(host, KEPT + ar.SHADDA)
    for p in fn.PROCLITICS:
        if host.startswith(p) and len(host) > len(p):
            deep = plain(host[len(p) :], entries)
            if deep and deep[0] != "COLLISION":
                return "COMPOUND", host[len(p) :], deep[2]
        b = key(p, KEPT)
        if bare.startswith(b) and len(bare) > len(b) and len(by(bare[len(b) :])) == 1:
            got = of_key(bare[len(b) :], host)
            return "COMPOUND", got[1], got[2]
    return of_key(bare, host) if bare != key(host, KEPT) else None


def test_answers_equal_plain_recursion(spark):
    r = random.Random(5)
    index = fn.supplement(spark)
    entries = [(w, c) for w, c in fn.PRONOUNS] + [(w, fn.COMPOUND_CATEGORY) for w in fn.COMPOUNDS]
    parts = fn.PROCLITICS + [w for w, _ in entries] + ["و", "ل", "ال", "كتب", "ّ", "ِ", "ا"]
    hosts = {"".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(1500)}
    hosts |= {key(h, KEPT) for h in list(hosts)[:400]} | {key(h, KEPT + ar.SHADDA) for h in list(hosts)[:400]}
    got = fn.lookup(spark.createDataFrame([(h,) for h in sorted(hosts)], "host string"), index).collect()
    assert len(got) == len(hosts)
    assert {r.host: (r.match_type, r.matched_form, r.category) if r.match_type else None for r in got} == {h: plain(h, entries) for h in hosts}


def test_repeats_nulls_and_empty_tables(spark):
    index = fn.supplement(spark)
    words = spark.createDataFrame([(1, "هُوَ"), (2, "هُوَ"), (3, None), (4, ""), (5, "ك" * 5000)], "id int, host string")
    got = {r.id: r.match_type for r in fn.lookup(words, index.unionByName(index)).collect()}
    assert got == {1: "VOCALIZED", 2: "VOCALIZED", 3: None, 4: None, 5: None}
    assert fn.lookup(words.limit(0), index).count() == 0
    assert fn.lookup(words, index.limit(0)).where("match_type IS NOT NULL").count() == 0
