import re

import pytest

from sarfgrid.llm import language_id as li
from sarfgrid.llm import url_filters as uf

SF = "/root/testdata/sf0.01"


def brute_phrases(text, sample):
    n = 0
    for s in range(0, len(text), li.SEGMENT):
        seg, i = text[s : s + li.SEGMENT], 0
        while i < len(seg):
            k = 1
            while i + k < len(seg) and seg[i : i + k + 1] in sample:
                k += 1
            n += 1
            i += k
    return n


def test_phrases_equal_brute_force():
    samples = {"aa": "the cat sat on the mat and the rat", "bb": "der hund sass auf der matte"}
    parser = li.CrossParser(samples)
    texts = ["the rat sat", "auf der katze", "", "the mat " * 200, "x"]
    got = parser.phrases(texts)
    for k, t in enumerate(texts):
        for j, lang in enumerate(parser.langs):
            if all(c in samples["aa"] + samples["bb"] for c in t):
                assert got[k, j] == brute_phrases(t, samples[lang]), (t, lang)


def test_held_out_accuracy(spark):
    got = li.op8_language_id(spark, SF).collect()
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "12 !", "en"), (None, "abc", "en"), (4, "the cat", None), (5, "½ ²", "en")], "doc_id long, text string, lang string")
    got = li.identify(docs, li.CrossParser({"en": "the cat sat", "de": "der hund"})).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "en", "en", "und"]
    assert {r.lang_pred for r in li.identify(docs, li.CrossParser({})).collect()} == {"und"}
    assert li.identify(docs.limit(0), li.train(docs.limit(0))).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [r for r in uf.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len) if fits else None


def test_rules_equal_brute_force(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/en", "x.net/", None, "", "ftp://net/", "ftp://net", "http://example.com/de/1", "http://badexample.com/de/", "http://org/fr/", "http://a.org#/fr/", "a://b://c.net/?x", "HTTP://É.ORG/fr/"]
    rows = [(i, u, "<p>cat dog</p>", "x") for i, u in enumerate(urls)] + [(r.page_id, r.url, r.html, "x") for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.page_id >= 100]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    ruled, seg = uf.with_rules(pages.drop("rule")), uf.train_words(pages)
    want = {r[0]: brute_rule(r[1]) for r in rows}
    for r in uf.judge(ruled, seg, uf.train_bayes(ruled, seg)).collect():
        assert (r.host, r.path, r.rule) == want[r.page_id]
        assert r.verdict in ("allow", "block") and (not r.rule or r.verdict == uf.RULES[r.rule])


def test_segmentation_is_the_best_split():
    seg = uf.Segmenter({"cheap": 50, "pills": 40, "pill": 30, "che": 2, "ap": 2, "s": 1})
    assert seg.split("cheappills") == ("cheap", "pills")
    assert "".join(seg.split("qqcheapzz")) == "qqcheapzz"


def test_rare_words_are_known_to_the_segmenter(spark):
    """More distinct words than any cap of the commonest: the rare ones that urls hold are still there, and the total counts all."""
    rare = ["quagmire", "zephyr", "fr"]
    common = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(31_000)]
    rows = [(k, "http://a.example.org/x", " ".join(common[k::10]) + " " + " ".join(common[k::10])) for k in range(10)]
    rows += [(10, "http://quagmirezephyr.example.org/fr/1", "<p>" + " ".join(rare) + "</p>"), (11, None, None)]
    seg = uf.train_words(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert seg.split("quagmirezephyr") == ("quagmire", "zephyr") and seg.split("fr") == ("fr",)
    whole = uf.Segmenter({w: 2 for w in common} | {w: 1 for w in rare})
    assert seg.letter == whole.letter and all(whole.cost[w] == c for w, c in seg.cost.items())


@pytest.mark.parametrize("width", [128, 30, 1])
def test_every_letter_of_the_samples_counts(monkeypatch, width):
    """Scripts beyond U+3000, and more letters than 60 over all languages."""
    samples = {
        "zh": "今天 天气 很好 我们 一起 去 公园 散步 然后 回家 吃饭", "ja": "きょう は てんき が いい ので こうえん を さんぽ します",
        "ko": "오늘 은 날씨 가 좋아서 공원 에서 산책 을 합니다", "el": "ο καιρός είναι καλός σήμερα και πάμε βόλτα",
        "ru": "сегодня хорошая погода и мы идём гулять в парк", "en": "the quick brown fox jumps over the lazy dog",
    }
    monkeypatch.setattr(li, "DENSE_WIDTH", width)
    parser = li.CrossParser(samples)
    texts = ["我们 去 公园", "こうえん を さんぽ", "공원 에서 산책", "πάμε βόλτα", "мы идём гулять", "the lazy fox"]
    assert [x for x, _ in parser.predict(texts)] == list(samples)
    got = parser.phrases([li.plain(t) for t in texts])
    for k, t in enumerate(texts):
        own = parser.langs.index(list(samples)[k])
        assert got[k, own] == brute_phrases(t, samples[parser.langs[own]])
