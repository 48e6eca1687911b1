"""Languages beyond the first 200 labels."""

from docloom.llm import language_id


def test_every_label_has_a_model(spark):
    # Letters of its own for each label; the last labels in order are the ones that were left out.
    rows = [(2 * k + j, " ".join(chr(0x4E00 + 20 * k + (3 * i + j) % 17) * 3 for i in range(40)), f"x{k:03d}", "h") for k in range(215) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit_on(df)
    assert model.languages == [f"x{k:03d}" for k in range(215)]
    assert all(model.languages[int(model.likelihoods(text).argmax())] == lang for _, text, lang, _ in rows if lang in ("x000", "x199", "x200", "x214"))
    assert language_id.keep_known(df).count() == len(rows)
