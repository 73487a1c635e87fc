import hashlib
import random

import numpy as np
import pytest

from lumipair.llm import substring_dedup as s
from lumipair.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_kept(rows, window):
    """For each (doc_id, text): the words that stay. A null id counts as the largest."""
    order = lambda i: s.LARGEST if i is None else i
    least = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            least[key] = min(least.get(key, order(i)), order(i))
    found = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = {k + j for k in range(len(words) - window + 1) if least[tuple(words[k:k + window])] < order(i) for j in range(window)}
        found.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(found, key=str)


@pytest.mark.parametrize("bits", [None, 16])
def test_query_matches_brute_force(spark, bits):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_kept([(r.doc_id, r.text) for r in docs.collect()], s.WINDOW)
    assert sum(r[2] for r in want) > 0
    if bits:
        got = s.remove_repeated(docs, bits=bits)
        assert sorted(map(tuple, got.collect()), key=str) == want
    else:
        got = {r.doc_id: tuple(r) for r in QUERIES["op12_substring_dedup"](spark, SF).collect()}
        assert got == {i: (i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in want}


def test_nulls_ties_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(rng.choice([None, *range(20)]), " ".join(rng.choice(["a", "b", passage, f"w{rng.randrange(9)}"]) for _ in range(rng.randrange(40)))) for _ in range(60)]
    rows += [(3, None), (4, ""), (None, passage), (None, passage), (5, passage), (5, passage), (6, "a " * 500)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, owner int, windows string").repartition(4)
    for hot, most in ((s.HOT, 100), (3, 100), (3, 2)):
        monkeypatch.setattr(s, "MOST_HOT", most)
        assert sorted(map(tuple, s.remove_repeated(docs, 5, hot=hot).collect()), key=str) == slow_kept(rows, 5)
    assert s.remove_repeated(docs.limit(0), 5).count() == 0


def test_packed_offsets():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 65536):
        offsets = np.sort(rng.choice(65536, n, replace=False))
        assert s.unpacked(s.packed(offsets)).tolist() == offsets.tolist()


def test_sketch_never_underestimates(spark):
    """In a sketch of few cells every window found twice has all its bits, and in a large one few others have."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(300)) for _ in range(200)] + ["x y z"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    windows = s.Windows([t.encode().split() for t in texts], 3)
    first, everything = windows.first, windows.second(np.arange(len(windows.first)))
    assert (windows.second(np.arange(0, len(first), 50)) == everything[::50]).all()
    values, times = np.unique(first, return_counts=True)
    often = np.isin(first, values[times > 1])
    passed = []
    for bits in (16, 22):
        table, hot = s.merged_sketch(docs, bits, 3, 5)
        found = s.has_bits(table, first, bits)
        assert s.is_hot(hot, first, bits)[np.isin(first, values[times > 5])].all()
        assert found[often].all()
        passed.append((found & ~often).sum())
    assert passed[0] > 10 * passed[1]
