"""Models and thresholds come from all labelled texts, however many there are and however they are dealt out."""

import random
from functools import partial

import numpy as np
from pyspark.sql import functions as F
from test_subjects import TERMS, labelled, text

from docfathom.llm import subjects as S


def test_no_labelled_text_is_left_out(spark):
    rng = random.Random(2)
    ids = [r.id for r in spark.range(4200).orderBy(F.xxhash64("id"), "id").collect()]
    own = {d: "audio" if k >= 4100 else rng.choice(("sport", "law")) for k, d in enumerate(ids)}
    docs = spark.createDataFrame([(d, text(rng, s, n=2, chat=1)) for d, s in own.items()] + [(9000, text(rng, "audio")), (9001, text(rng, "law"))], "doc_id long, text string")
    labels = spark.createDataFrame(list(own.items()), "doc_id long, subject string")
    names = spark.createDataFrame([(x,) for x in TERMS], "subject string")
    got = {(r.doc_id, r.subject) for r in S.subjects_of(docs, labels, names).where("doc_id >= 9000").collect()}
    assert got == {(9000, "audio"), (9001, "law")}


def test_the_same_models_however_the_texts_are_dealt_out(spark):
    df = spark.createDataFrame(labelled(random.Random(3)), "text string, subjects array<string>")
    one, many = (S.fit_models(df.repartition(n), sorted(TERMS)) for n in (1, 7))
    assert one.accept.tolist() == many.accept.tolist() and one.languages.keys() == many.languages.keys() and one.languages
    for a, b in ((one.languages[k], many.languages[k]) for k in one.languages):
        assert a.number == b.number and np.array_equal(a.pairs, b.pairs) and np.array_equal(a.gain, b.gain)


def test_thresholds_are_judged_on_every_labelled_text(monkeypatch):
    seen, chosen = [], S._thresholds
    monkeypatch.setattr(S, "_thresholds", lambda texts, own: seen.append(texts.sums(partial(S._agreement, own=own))) or chosen(texts, own))
    texts = labelled(random.Random(4))
    S.fit_models(texts, sorted(TERMS))
    hit, _, miss = seen[0][1].reshape(len(S.THRESHOLDS), 3, len(TERMS)).transpose(1, 0, 2)
    assert (hit + miss).sum(1).tolist() == [len(texts)] * len(S.THRESHOLDS)


def test_the_faster_patterns_cut_the_same():
    rng = random.Random(5)
    for _ in range(20_000):
        x = "".join(rng.choices("aZßé中㐀_19٣.!?。！？ \n\t　\x1c-²İ"[: rng.choice((3, 9, 26))] + "_1. \n", k=rng.randint(0, 24)))
        whole = (S._UNIT.findall(y) for y in S._SENTENCE.split(S.plain_text(x)))
        shapes = S._Shapes()
        assert S.sentences_of(x) == [[shapes[u] for u in own] for own in whole if own], repr(x)
