"""Rows with nulls, empty texts, repeats and columns whose names clash with results, through the DataFrame operators."""

from tokenizers import Tokenizer

from tideloom.llm import bpe, embedding_dedup, html_extract, quality_cnn

PAGE = "<body><nav><a href=/>Home</a> <a href=/b>More</a></nav><article><p>A first paragraph that is long enough to be read as text here.</p><p>Second, &eacute; one follows it.</p></article></body>"


def test_encode_repeated_rows_and_clashing_columns(spark):
    path = bpe.tokenizer_path("word_bpe_49k.json")
    rows = [(1, "two words", 5, "x"), (1, "two words", 5, "x"), (2, None, 6, "y"), (None, "", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, decoded string")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids"], r["decoded"]) for r in bpe.encode_documents(docs, path).collect())
    lib = Tokenizer.from_file(path)
    ids = lib.encode("two words", add_special_tokens=False).ids
    once = (1, len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))
    assert got == [(0, 0, "", ""), once, once, (2, 0, "", "")]


def test_html_rows(spark):
    rows = [(1, "u", PAGE, "old", 9), (1, "u", PAGE, "old", 9), (2, None, None, None, None), (3, "v", "", "old", 1), (None, "w", "<script>x</script>", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.extract_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in out.collect())
    text = "A first paragraph that is long enough to be read as text here. Second, é one follows it."
    assert got == [(0, "w", "", 0), (1, "u", text, len(text)), (1, "u", text, len(text)), (2, "", "", 0), (3, "v", "", 0)]


def test_scores_of_repeated_rows_and_clashing_columns(spark):
    rows = [(i, ("## " if i % 2 else "word ") * 30, "mine", 7) for i in range(60)] * 2 + [(None, None, "mine", 7), (99, "", "mine", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    out = quality_cnn.score_documents(docs, quality_cnn.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "predicted"] and dict(out.dtypes)["score"] == "double"
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_id.values()) and by_id[None] == by_id[99]


def test_embeddings_with_clashing_columns_and_repeated_rows(spark):
    v, w = [1.0, 0.0, 0.5, 0.25], [-1.0, 1.0, 0.0, 0.0]
    rows = [(1, v, 0, 9, 9, "x"), (2, v, 0, 9, 9, "x"), (2, v, 0, 9, 9, "x"), (3, w, 0, 9, 9, "x"), (4, v, 1, 9, 9, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int, component_id int, _h string")
    out = embedding_dedup.near_embeddings(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
