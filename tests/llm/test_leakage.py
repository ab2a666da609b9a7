import random

import pyarrow as pa

from docfathom.llm import leakage as L

EN = "A narrow technician on the bench must install 389 build cache units before sys_lane_limit reaches 1883, otherwise shell wrapper drifts by 5 cyclic steps today"
ZH = "借用的样机需要先录制四百七十七个音频编解码器再把混音延迟调到两千六百五十否则采样时钟会偏移九步然后重新开始"
SHORT = "how do I reset the board"


def items(spark):
    rows = [(1, EN, "en"), (2, ZH, "zh"), (3, SHORT, "en"), (4, None, "en"), (1, EN, "en")]
    return spark.createDataFrame(rows, "item_id long, passage string, lang string")


def found(spark, texts):
    df = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, share double")
    return {(r.doc_id, r.item_id) for r in L.leaks(df, items(spark)).collect()}


def test_leaks_with_changes_and_near_misses(spark):
    w = EN.split()
    half = " ".join(w[: len(w) // 2 + 1])
    changed = w.copy()
    for k in range(4, len(w), 9):
        changed[k] = "other"
    many = [x if k % 3 else "other" for k, x in enumerate(w)]
    texts = ["Before. " + EN + " After.", half.upper().replace(" ", "\n"), " ".join(w[: len(w) // 3]), " ".join(changed), " ".join(many), "x " * 5000 + "<b>" + "</b> <i>".join(w) + "</i>",
             "前言。" + ZH, "前言" + ZH[:26] + "结束", ZH[:15], ZH.replace("音频", "視頻", 1), SHORT * 3, None, "", "\u0430".join(EN.split("a"))]
    assert found(spark, texts) == {(0, 1), (1, 1), (3, 1), (5, 1), (6, 2), (7, 2), (9, 2), (13, 1)}


def test_every_long_enough_span_shares_a_fingerprint():
    rng = random.Random(0)
    for k, window in ((3, 2), (4, 2), (6, 2), (4, 5)):
        for _ in range(100):
            span = [str(rng.randrange(30)) for _ in range(k + window - 1)]
            a, b = ([str(rng.randrange(30)) for _ in range(20)] + span + [str(rng.randrange(30)) for _ in range(9)] for _ in range(2))
            assert set(L.winnow(a, k, window).values()) & set(L.winnow(b, k, window).values())


def searched(passages, texts, by_chars=False):
    index = L.Index([L.Item(k, p, by_chars) for k, p in enumerate(passages)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    (out,) = L._search(iter([batch]), index, 0.5)
    return {(r["doc_id"], r["item_id"]): r["share"] for r in out.to_pylist()}


def changed_part(rng, words, p, kind):
    """A stretch of at least half of a passage with one word in eight changed, left out, put in, or replaced by a hyphenated one."""
    size = rng.randrange(-(-len(p) // 2), len(p) + 1)
    at = rng.randrange(len(p) - size + 1)
    part = p[at : at + size]
    places = sorted(rng.sample(range(1, size - 1), min(size // 8, size - 2)), reverse=True)
    for k in places:
        how = rng.choice(("changed", "hyphenated")) if kind == "mixed" else kind
        if how == "put in":
            part.insert(k, rng.choice(words))
        else:
            part[k] = "other" if how == "changed" else f"other-{rng.choice(words)}"
    return part


def test_random_leaks_of_all_lengths():
    """Recall against what was planted, items of 15 to 500 words: 0.99 at least, here all of them."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    passages = [[rng.choice(words) for _ in range(rng.choice((15, 16, 20, 31, 32, 40, 47, 48, 60, 100, 160, 250, 500)))] for _ in range(80)]
    for kind in ("changed", "hyphenated", "put in", "mixed"):
        texts, wanted = [], []
        for k in range(150):
            n = rng.randrange(len(passages))
            around = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(2)]
            texts.append(" ".join([around[0], *changed_part(rng, words, passages[n], kind), around[1]]))
            wanted.append((k, n))
        found = searched([" ".join(p) for p in passages], texts)
        lost = [w for w in wanted if w not in found]
        assert len(lost) <= 0.01 * len(wanted), (kind, [len(passages[n]) for _, n in lost])
        assert len(found) <= len(wanted) + 2


def test_hyphenated_words_in_one_of_nine_or_ten():
    words = [f"v{k}" for k in range(160)]
    for every in (9, 10):
        text = [f"other-part{k}" if k % every == 4 else x for k, x in enumerate(words)]
        assert searched([" ".join(words)], [" ".join(text)]) == {(0, 0): 1.0}


def test_chinese_items_by_brute_force():
    rng = random.Random(2)
    signs = [chr(0x4E00 + k) for k in range(2000)]
    passages = ["".join(rng.choice(signs) for _ in range(rng.choice((30, 33, 47, 48, 80, 112, 200)))) for _ in range(40)]
    texts, wanted = [], []
    for k in range(120):
        n = rng.randrange(len(passages))
        part = changed_part(rng, signs, list(passages[n]), "changed")
        texts.append("前" * 9 + "".join("变" if x == "other" else x for x in part) + "后" * 9)
        wanted.append((k, n))
    found = searched(passages, texts, True)
    assert all(w in found for w in wanted)


def test_chinese_item_that_is_mostly_a_command():
    item = "运行 flash_tool --device /dev/ttyUSB0 --image boot_stage_two.img --verify --reset-after 然后重启"
    assert searched([item], ["Type flash_tool --device /dev/ttyUSB0 --image boot_stage_two.img --verify --reset-after and wait", "nothing of it at all, only latin text"], True).keys() == {(0, 0)}


def test_blocks_of_items_give_the_same_rows(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate((EN, "x " + EN.upper(), ZH, "nothing"))], "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(L.leaks(texts, items(spark), block_chars=60)) == rows(L.leaks(texts, items(spark))) != []


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.leaks(df, items(spark)).count() == 0
    assert L.leaks(spark.createDataFrame([(1, EN)], "doc_id long, text string"), items(spark).limit(0)).count() == 0
