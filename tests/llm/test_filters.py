"""URL filters, quality rules, the classifier, HTML extraction and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tideloom.llm import html_extract, quality_cnn, quality_rules, url_filter

URLS = [None, "", "no-scheme.org/x", "http://org", "http://a.ORG/", "https://x.example.org/es/a?b#c", "https://example.org/en/123", "https://example.org/en/23", "http://notexample.org/es/", "ftp://shop.com/fr/1", "http://com/de/", "http://com/d", "http://a.b.c.com?x=/de/", "http://x.com#/fr/", "://", "http://" + "a." * 3000 + "com/de/" + "y" * 9000, "http://é.org/ü/"]


def brute(u):
    m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    hits = [(len(h + p), a, h + p) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(hits)[2], max(hits)[1]) if hits else (host, path, None, "allow")


def test_url_filter(spark):
    rows = [(i, u, "h", i) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, other int")
    out = url_filter.filter_urls(df, url_filter.rules_frame(spark))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["other"]) for r in out.collect())
    assert [(g[1], g[2], g[3], g[4]) for g in got] == [brute(u) for u in URLS * 2] and [g[5] for g in got] == list(range(len(rows)))
    none = url_filter.filter_urls(df, url_filter.rules_frame(spark, [("x.y", "nopath", "block")]))
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_frame(spark)).count() == 0


W = re.compile(r"[^\x20\x09-\x0D]+")


def features(t):
    t = t or ""
    w = W.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many, hit = Counter(tri), [False] * len(w)
    for i, x in enumerate(tri):
        if many[x] > 1:
            hit[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit)


def test_quality_features(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "f of f", "a b c a b c\n\nx\nx\n x\n", "é ü z # $ %", "퟿ \U0001F600 |<>", "fffff\x0cf\x0b\r\nf", "x " * 3000] + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) + "\n" * rng.randint(0, 3) for _ in range(50)]
    df = spark.createDataFrame([(i, t, "en", "c") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string")
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.FEATURES) for r in quality_rules.with_features(df).collect()}
    assert got == {i: features(t) for i, t in enumerate(texts)}


def test_cutoffs_bound_false_rejections(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        sym = 0.5 + rng.random() if bad else 0.3 * (rng.random() < 0.004)
        rows.append((i, "en" if i % 3 else "fr", 100, 500, int(100 * sym), 0, 0, 5))
        labels.append((i, 0 if bad else 1))
    f = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    f = f.unionByName(f.withColumn("doc_id", F.col("doc_id") + 10000).withColumn("lang", F.lit(None).cast("string")))
    f = f.unionByName(f.where("doc_id = 1").withColumn("doc_id", F.lit(-1).cast("long")).withColumn("lang", F.lit("")))
    labels += [(i + 10000, q) for i, q in labels]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    cutoffs = quality_rules.materialize(quality_rules.select_cutoffs(f, lab), "cutoffs")
    cuts = {r["stratum"]: r for r in cutoffs.collect()}
    assert set(cuts) == {"en", "fr", None}  # '' has no labels, and null is apart from it

    def tail(n, k, p):
        total, term = 0.0, (1 - p) ** n
        for i in range(k + 1):
            total += term
            term *= (n - i) / (i + 1) * p / (1 - p)
        return total

    for r in cuts.values():
        assert tail(r["n"], r["k"], quality_rules.EPS) <= quality_rules.ALPHA / 3
    out = quality_rules.apply_rules(f, cutoffs)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    for s in (lambda i: i % 3 == 0, lambda i: i % 3 and i < 10000, lambda i: i >= 10000):  # of each stratum, all rules together
        assert 1 - np.mean([kept[i] for i, q in labels if q == 1 and s(i)]) < quality_rules.EPS
    assert kept[-1] and not any(kept[i] for i, q in labels if q == 0 and i % 3)
    none = quality_rules.select_cutoffs(f, lab.limit(0))
    assert none.count() == 0 and all(r["kept"] for r in quality_rules.apply_rules(f, none).collect())


def test_level_rejects_on_given_tables(spark):
    """On sf0.01 one stratum has enough labels, and its level rejects what the base rule keeps, none of it labelled clean."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules.judge(docs, labels).where("NOT kept AND NOT base_failed").join(labels, "doc_id", "left").collect()
    assert out and {r["lang"] for r in out} == {"en"} and not any(r["quality"] == 1 for r in out)


def test_network_equals_direct_convolution():
    """Scores against filters applied byte by byte, with overlapping chunks cut one by one."""
    rng = np.random.default_rng(6)
    F_, H = quality_cnn.FILTERS, quality_cnn.HALF
    net = quality_cnn.Network(rng.normal(size=(4, 256, F_)).astype(np.float32), rng.normal(size=F_), rng.normal(size=F_), rng.normal(size=F_), 0.1)
    texts = [b"", b"x", bytes(rng.integers(1, 256, 127, dtype=np.uint8)), bytes(rng.integers(1, 256, 1000, dtype=np.uint8)), b"ab " * 200]
    for text, got in zip(texts, net.score(texts, net.tables())):
        halves = -(-(len(text) + 6) // H)
        raw = np.zeros(halves * H + 4, np.uint8)
        raw[3 : 3 + len(text)] = list(text)
        resp = np.array([sum(net.weights[k, raw[i + k]] for k in range(4)) for i in range(halves * H)])
        chunks = np.array([resp[h * H : min(h + 2, halves) * H].max(0) for h in range(halves)])
        feats = np.maximum(chunks + net.bias, 0)
        z = feats.mean(0) @ net.mean + feats.max(0) @ net.top + net.shift
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-5


def test_classifier(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioust") for _ in range(4))
    rows, labels = [(-1, None), (-2, ""), (-3, "x" * 300_000)], []
    for i in range(400):
        bad = i % 3 == 0
        rows.append((i, " ".join(word() + ("###" if bad else "") for _ in range(60))))
        labels.append((i, 0 if bad else 1))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    net = quality_cnn.fit(docs, lab)
    got = {r["doc_id"]: r for r in quality_cnn.score_documents(docs, net).withColumn("held_out", quality_cnn.held_out()).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    test = [(y, got[i]["score"]) for i, y in labels if got[i]["held_out"]]
    assert min(s for y, s in test if y) > max(s for y, s in test if not y)
    alone = quality_cnn.score_documents(docs.where("doc_id = -3"), net).first()["score"]
    assert abs(alone - got[-3]["score"]) < 1e-9
    flat = quality_cnn.fit(docs, lab.where("quality = 1"))
    assert abs(quality_cnn.score_documents(docs.limit(2), flat).first()["score"] - 1) < 1e-3


def test_html():
    m = html_extract.default_model()
    page = "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav><div class='ad'>Buy this now, it is good.</div><article><h1>A heading here</h1><p>First <b>part</b> of it &amp; more,\n text.<br>next<p>Second paragraph, longer than the first one by far.</article><div class=comments><p>Nice article, I liked it very much indeed.</div><footer>&copy; me</footer></body></html>"
    assert m.extract(page) == "A heading here First part of it & more, text. next Second paragraph, longer than the first one by far."
    assert m.extract(None) == m.extract("") == m.extract("<nav>x</nav>") == ""
    assert m.extract("<div>" * 3000 + "x") is not None and m.extract("<p class='" * 50) is not None

    def f1(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))

    score = []
    for page, mark in html_extract.labelled_pages(80, seed=123):
        truth = " ".join("".join(n.text) for n in html_extract.parse(page) if n.text is not None and not any(mark in t for t in n.text))
        score.append(f1(truth, m.extract(page.replace(mark, ""))))
    assert np.mean(score) > 0.9


def test_marginals_are_exact():
    """Sum-product against all assignments of a small tree."""
    from itertools import product
    from math import exp

    m = html_extract.default_model()
    nodes = html_extract.parse("<div class=post><p>some words, here.</p><a class=ad>x</a></div>")
    seen = html_extract.evidence(nodes)
    total = np.zeros((len(nodes), 3))
    for state in product(range(3), repeat=len(nodes)):
        w = m.start[state[0]]
        for i, n in enumerate(nodes):
            if i:
                w *= m.edge[state[n.parent]][state[i]]
            w *= exp(sum(m.facts[f][state[i]] for f in seen[i] if f in m.facts) + (-60.0 - sum(m.facts[f][2] for f in seen[i] if f in m.facts) if n.text is not None and state[i] == 2 else 0))
        for i, k in enumerate(state):
            total[i, k] += w
    want = total / total.sum(1, keepdims=True)
    assert np.allclose(want, np.array(m.marginals(nodes)), atol=1e-9)
