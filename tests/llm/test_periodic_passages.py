"""A passage that repeats itself has few distinct fingerprints and is found all the same."""

import pyarrow as pa

from docfathom.llm import leakage as L


def test_verbatim_copy_of_a_repeated_line():
    passages = [" ".join(" ".join(f"w{n}x{k}" for k in range(10)) for _ in range(10)) for n in range(40)]
    index = L.Index([L.Item(n, p, False) for n, p in enumerate(passages)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([f"before it {p} after it" for p in passages])], names=["doc_id", "text"])
    (out,) = L._search(iter([batch]), index, 0.5)
    assert {(r["doc_id"], r["item_id"], r["share"]) for r in out.to_pylist()} == {(n, n, 1.0) for n in range(40)}


def test_fewest_hashes():
    assert L._fewest({1: [0, 3, 6], 2: [1, 4], 3: [2]}, {1, 2, 3}, 4) == 2
    assert L._fewest({1: [0], 2: [1], 3: [2]}, {1, 2, 3}, 2) == 2 and L._fewest({}, set(), 3) == 1
