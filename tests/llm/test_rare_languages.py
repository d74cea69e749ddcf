"""Languages that a uniform sample would miss are learnt."""

import random

from seqprism.llm import gru_language


def test_rare_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(gru_language, "SAMPLE_DOCUMENTS", 20)
    words = {"en": ["the", "and", "was"], "de": ["der", "und", "ist"], "fi": ["hän", "oli", "että"]}
    lang = ["fi" if i % 400 == 7 else "de" if i % 2 else "en" for i in range(4000)]
    rows = [(i, " ".join(random.Random(i).choices(words[x], k=20)), x) for i, x in enumerate(lang)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = gru_language.fit(df)
    assert model.languages == ["de", "en", "fi"]
    found = gru_language.predict(df.where("lang = 'fi'"), model).collect()
    assert len(found) == 10 and all(r.lang_pred == "fi" for r in found)
