"""Empty tables give empty results with the usual columns."""

from tideloom.llm import bpe, html_extract, ngram_join, packing, quality_cnn, quality_rules, token_output


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], labels.schema)
    word = bpe.tokenizer_path("word_bpe_49k.json")
    assert bpe.encode_documents(docs, word).count() == 0
    assert packing.pack_documents(docs, word).count() == 0
    token_output.write_tokens(docs, str(tmp_path / "t"), word)
    assert token_output.read_tokens(spark, str(tmp_path / "t")).count() == 0
    assert ngram_join.ngram_join(docs).count() == 0 and ngram_join.one_of_each(docs).columns == docs.columns
    for lab in (labels, some):
        assert quality_rules.keep_documents(docs, lab).count() == 0
        assert quality_cnn.score_documents(docs, quality_cnn.fit(docs, lab)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_extract.extract_text(pages).columns == ["page_id", "url", "text", "n_chars"]
