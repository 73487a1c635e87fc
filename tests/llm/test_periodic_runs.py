import hashlib
import random

import numpy as np
import pytest

from lumipair.llm import periodic_runs as p
from lumipair.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_runs(words):
    """All runs of a list by comparing at every distance; smallest periods first."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(s <= i and i + length <= s + n0 and q % q0 == 0 for s, n0, q0 in found):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, k = rng.choice([0, 1, 5, 6, 7, 8, 20, 60, 150, 400]), rng.choice([1, 2, 3, 50])
    words = [b"%d" % rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 4:
            begin = rng.randrange(n)
            period, end = rng.randint(1, max(1, (n - begin) // 3)), rng.randint(begin, n)
            for i in range(begin + period, end):
                words[i] = words[i - period]
    return words


@pytest.mark.parametrize("seed", range(12))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(6):
        docs = [random_words(rng) for _ in range(rng.randint(1, 25))]
        assert p.runs_of_documents(docs) == [slow_runs(d) for d in docs]


def test_coinciding_projections_lose_nothing(monkeypatch):
    """One bit for each word: most places match in the projection, and only the words decide."""
    monkeypatch.setattr(p, "SUM_BITS", 2)
    rng = random.Random(99)
    docs = [random_words(rng) for _ in range(60)]
    assert p.runs_of_documents(docs) == [slow_runs(d) for d in docs]


@pytest.mark.parametrize("size", [2, 8, 64, 1024])
def test_transform_is_exact(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(0, p.PRIME, (size, 3)).astype(np.uint64) for _ in range(2))
    assert (p.inverse_transform(p.transform(a)) == a).all()
    if size <= 64:
        got = p.inverse_transform(p._reduced(p.transform(a) * p.transform(b)))
        for k in range(size):
            want = [sum(int(a[i, c]) * int(b[(k - i) % size, c]) for i in range(size)) % p.PRIME for c in range(3)]
            assert got[k].tolist() == want


def test_long_texts_of_one_word():
    texts = [[b"a"] * 60_000, [b"a"] * 20_000 + [b"b"] + [b"a"] * 20_000]
    assert p.runs_of_documents(texts) == [[(0, 60_000, 1)], [(0, 20_000, 1), (20_001, 20_000, 1)]]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    n_runs = 0
    for d in docs:
        words = p.repeated_words((d.text or "").encode().split(), d.doc_id)
        if len(words) > 3000:
            continue
        runs = slow_runs(words)
        n_runs += len(runs)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        r = got[d.doc_id]
        assert r.n_runs == len(runs) and r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert r.start is r.length is r.period is r.exponent_milli is None
    assert n_runs > 10


def test_nulls_empty_and_repeated_rows(spark):
    rows = [(None, "a b " * 5, "x"), (1, None, "x"), (1, "", "x"), (2, "a a a a a a", None), (2, "a a a a a a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = p.find_runs(docs).collect()
    assert sorted(len(r.runs) for r in got) == [0, 0, 1, 1, 1]
    assert p.find_runs(docs.limit(0)).count() == 0
