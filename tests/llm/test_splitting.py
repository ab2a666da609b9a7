from hypothesis import given, settings
from hypothesis import strategies as st

from docfathom.llm import splitting as S

TEXTS = st.text(alphabet="ab é\n.。,# 中e\u0301", max_size=400)


@settings(deadline=None, max_examples=200)
@given(TEXTS, st.integers(20, 80), st.integers(0, 30))
def test_pieces_cover_the_text_within_the_limit(text, room, overlap):
    parts = S.split_text(text, room, overlap)
    assert "".join(text[own:end] for _, own, end, _ in parts) == text
    for k, (start, own, end, _) in enumerate(parts):
        assert end - start <= room and start <= own < end or not text
        assert own - start <= min(overlap, room // 2)
        if k:
            assert start >= parts[k - 1][1]


def test_strongest_boundary_near_the_middle():
    text = "One sentence. " * 6 + "\n\n" + "Other words. " * 6
    parts = S.split_text(text, 110, 0)
    assert parts[1][3] == "paragraph"


def test_forced_stretch():
    assert S.longest_stretch("a" * 2001) == 2001 and S.longest_stretch("a" * 1000 + " " + "b" * 1500) == 1500
    assert all(kind in ("start", "forced") for *_, kind in S.split_text("a" * 5000, 2000, 200))


def test_operator_over_odd_rows(spark):
    rows = [(1, "w " * 3000, ["a", None, "b"]), (1, "w " * 3000, None), (2, "short", ["x" * 3000]), (3, None, ["x" * 3000]), (4, "", []), (5, "y" * 2000, []), (6, "z" * 9000, ["c"]), (None, "q. " * 900, ["d"])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "row_id long, text string, breadcrumbs array<string>, piece_no int")
    got = S.split_oversized(df).collect()
    assert sorted({str(r.row_id) for r in got}) == ["1", "2", "6", "None"]
    assert all(len(r.heading) + len(r.piece) <= 2000 for r in got)
    own = [r for r in got if r.row_id == 6]
    assert "".join(r.piece[r.shared_chars :] for r in sorted(own, key=lambda r: r.piece_no)) == "z" * 9000
    assert {r.forced for r in own} == {1} and {r.forced for r in got if r.row_id == 1} == {0}
    assert len({(r.row_id, r.piece_no) for r in got if r.row_id == 1}) * 2 == sum(r.row_id == 1 for r in got)
    assert S.split_oversized(df.limit(0)).count() == 0


def test_long_breadcrumbs_stay_whole_where_they_leave_room(spark):
    df = spark.createDataFrame([(1, "word " * 400, ["b" * 1500]), (2, "word " * 400, ["b" * 1900])], "row_id long, text string, breadcrumbs array<string>")
    got = S.split_oversized(df).collect()
    assert {r.heading for r in got if r.row_id == 1} == {"b" * 1500}
    assert {len(r.heading) for r in got if r.row_id == 2} == {1600} and all(len(r.heading) + len(r.piece) <= 2000 for r in got)
