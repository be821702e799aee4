"""Languages of one labelled row."""

from polyadic.llm import lang_id


def test_rare_languages_have_dictionaries(spark):
    rows = [(k, f"word{k} of language number{k} again", f"l{k:02d}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models, sample = lang_id.fit(docs, None, "doc_id", "text", "lang", 400, 96_000)
    assert len(models) == 30 and all(models[lang].decode() == text for _, text, lang in rows)
    assert sample.where("held").count() == 0
