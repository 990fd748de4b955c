import pytest

from tideloom.llm import html_extract, ngram_join, packing

A = " ".join(f"alpha{i}" for i in range(40))
B = " ".join(f"beta{i}" for i in range(40))


def test_rows_of_one_key_are_judged_by_their_texts(spark):
    rows = [(1, A), (1, B), (0, A), (2, A + " more"), (3, B), (4, None), (4, ""), (None, A), (5, "gamma " * 3), (5, "gamma " * 3), (1, B)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _mark string").repartition(3)
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(0, A), (1, B), (4, None), (4, ""), (None, A), (5, "gamma " * 3)], key=str)


def test_no_rows_stay_of_none(spark):
    assert ngram_join.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


LONG = "This paragraph says a number of things, one after another, and ends with a full stop. " * 4
PAGES = {
    "nested": ("<body>{w}<p>" + LONG + "</p>", LONG.strip()),
    "two paragraphs": ("<body>{w}<p>" + LONG + "</p><p>" + LONG + "</p>", f"{LONG.strip()} {LONG.strip()}"),
    "list item": ("<body>{w}<article><h1>Head of it</h1><li>short one</li></article>", "Head of it short one"),
    "code": (f"<body>{{w}}<article><h1>Head of it</h1><p>{LONG}</p><pre><code>x = 1</code></pre></article>", f"Head of it {LONG.strip()} x = 1"),
    "run": (f"<body>{{w}}<article><h1>Head of it</h1><p>{LONG}</p><span>a run of text</span></article>", f"Head of it {LONG.strip()} a run of text"),
    "link": (f"<body>{{w}}<article><h1>Head of it</h1><p>{LONG}</p><p><a href=x>only a link</a></p></article>", f"Head of it {LONG.strip()} only a link"),
    "headline": ("<body>{w}Short headline", "Short headline"),
    "menu and footer": (f"<body>{{w}}<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><article><p>{LONG}</p></article><footer>&copy; 2020 Someone</footer>", LONG.strip()),
    "comments": (f"<body>{{w}}<main><h1>Title words</h1><p>{LONG}</p></main><div class=comments><h3>Comments</h3><div class=comment><b>ann</b><p>Nice one, thanks.</p></div></div>", f"Title words {LONG.strip()}"),
}


@pytest.mark.parametrize("kind", PAGES)
def test_plain_wrappers_never_change_the_text(kind):
    page, want = PAGES[kind]
    model = html_extract.default_model()
    assert [model.extract(page.replace("{w}", "<div>" * n)) for n in (0, 1, 5, 12, 30, 2000)] == [want] * 6


def test_islands_are_never_worse_than_best_fit_decreasing():
    import numpy as np

    for seed in range(3):
        rng = np.random.default_rng(seed)
        sizes = np.minimum(rng.lognormal(5.5, 1.1, 4000).astype(np.int64) + 1, 2048)
        plain = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), 2048)
        for island in (0, 1, 2, 3):
            assert packing.evolve(sizes, [], 2048, island).max() <= plain.max()
