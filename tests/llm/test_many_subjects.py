"""No subject is left out, however many there are."""

from docfathom.llm import subjects as S


def test_over_a_thousand_subjects(spark, monkeypatch):
    seen = []

    def fitted(sample, names):
        seen.extend(names)
        return S.SubjectModels.__new__(S.SubjectModels)

    monkeypatch.setattr(S, "fit_models", fitted)
    names = spark.range(1200).selectExpr("concat('s', lpad(cast(id as string), 5, '0')) as subject")
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    S.subjects_of(docs, labels, names)
    assert len(seen) == 1200 and seen[-1] == "s01199"
