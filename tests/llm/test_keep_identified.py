"""Texts of which the language model knows nothing."""

import pytest
from leafseason.llm import langid


@pytest.mark.parametrize("langs", [["en"], ["en", "fr"], ["de", "en", "fr"], ["de", "en", "es", "fr"]])
def test_texts_without_a_known_word_or_ngram_are_dropped(spark, langs):
    rows = [(i, f"the word {x} here", x) for i, x in enumerate(langs * 8)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == langs
    df = spark.createDataFrame([(1, "中文 中文"), (2, "12"), (3, None), (4, f"{langs[0]} {langs[0]}"), (5, f"中文 {langs[0]}")], "doc_id long, text string")
    assert {r.doc_id for r in langid.keep_identified(df, model).collect()} == {4, 5}
