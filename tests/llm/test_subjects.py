import random

from docfathom.llm import subjects as S

TERMS = {"sport": ["penalty kick", "league table", "goal keeper"], "law": ["licence clause", "warranty claim", "audit trail"], "audio": ["echo canceller", "noise floor", "wake word"]}
FRAMES = ["If the {} stays silent, check the {} again.", "We saw the {} recover while the {} did not.", "Most teams check the {} before the {}."]
CHAT = "Thanks for the detailed report, we will come back to it soon."


def text(rng, *subjects, n=6, chat=2):
    own = [rng.choice(FRAMES).format(*rng.sample(TERMS[subjects[k % len(subjects)]], 2)) for k in range(n)] + [CHAT] * chat
    rng.shuffle(own)
    return " ".join(own)


def labelled(rng, n=150):
    out = []
    for _ in range(n):
        s = rng.choice(list(TERMS))
        out.append((text(rng, s), [s if rng.random() > 0.05 else rng.choice(list(TERMS))]))
    return out


def test_held_out_accuracy():
    rng = random.Random(0)
    models = S.fit_models(labelled(rng), sorted(TERMS))
    right = 0
    for _ in range(100):
        own = rng.sample(list(TERMS), rng.choice((1, 2)))
        got = {models.subjects[k] for k, v in models.shares(text(rng, *own)).items() if v >= S.LEAST_SHARE - 1e-9}
        right += got == set(own)
    assert right >= 95
    assert models.shares(" ".join([CHAT] * 5)) == {} == models.shares(None) == models.shares("")


def test_operator_over_odd_tables(spark):
    rng = random.Random(1)
    train = labelled(rng)
    docs = [(k, t, 0.5) for k, (t, _) in enumerate(train)] + [(900, None, 0.5), (901, "", 0.5), (902, CHAT, 0.5), (903, text(rng, "law", n=3000, chat=0), 0.5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, share double")
    labels = spark.createDataFrame([(k, s[0], "r") for k, (_, s) in enumerate(train)] + [(0, train[0][1][0], "r"), (None, None, None)], "doc_id long, subject string, rater string")
    names = spark.createDataFrame([(x,) for x in TERMS] + [(None,)], "subject string")
    got = {(r.doc_id, r.subject) for r in S.subjects_of(df, labels, names).collect()}
    assert (903, "law") in got and not {d for d, _ in got} & {900, 901, 902}
    assert sum((k, s[0]) in got for k, (_, s) in enumerate(train)) > 0.85 * len(train)
    assert S.subjects_of(df, labels.limit(0), names).count() == 0
    assert S.subjects_of(df.limit(0), labels, names).count() == 0
    assert S.subjects_of(df, labels, names.limit(0)).count() == 0
