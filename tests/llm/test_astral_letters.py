"""Characters beyond the first plane."""

from surveymend.llm import langid


def test_emoji_are_no_letters(spark):
    fit = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(50)] + [(100 + i, "der Hund lag auf dem Sofa", "de") for i in range(50)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "😀🎉 😀", "en"), (2, "𐐀𐐁𐐂", "en"), (3, "😀 the cat", "en")], "doc_id long, text string, lang string")
    model = langid.fit(fit)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert (got[1]["lang_pred"], got[1]["score"], got[1]["rejected"]) == ("und", 0, True)
    assert got[2]["lang_pred"] != "und" and got[3]["lang_pred"] == "en"
    assert 1 not in {r["doc_id"] for r in langid.keep(docs, model).collect()}
