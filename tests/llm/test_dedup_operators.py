import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lumipair.llm import exact_dedup, near_dedup
from lumipair.llm.components import components
from lumipair.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, page long, order string, number int, fp long"


@pytest.fixture(scope="module")
def rows():
    """Nulls, copies, one very large group, repeated rows, a long text."""
    found = [(i, f"text {i % 17}") for i in range(60)] + [(100 + i, "hot copy " * 30) for i in range(200)]
    found += [(400, None), (401, ""), (402, "long " * 60_000), (403, "Text 1"), (403, "Text 1"), (None, "text 1"), (None, "alone"), (None, None)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", 7, None, 1, 2) for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("options", [{}, {"hash_bits": 2}, {"page_bytes": 2000}, {"page_bytes": 2000, "hash_bits": 4}])
def test_exact_groups(docs, rows, options):
    got = exact_dedup.duplicate_groups(docs, **options).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert all((r.keep_id, r.group_size) == keep[r.text_sha256] for r in got)
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(keep)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("page_bytes", [32 << 20, 2000])
def test_survivors_keep_all_columns(docs, rows, page_bytes):
    got = exact_dedup.drop_copies(docs, page_bytes=page_bytes)
    assert got.columns == docs.columns
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert {(r.text or ""): -1 if r.doc_id is None else r.doc_id for r in got.collect()} == best
    assert {r.page for r in got.collect()} == {7}


def test_directory_splits_overfull_pages(spark):
    cells = spark.createDataFrame([(0, 10), (1, 10), (2, 90), (3, 250), (9, 5)], "cell long, bytes long")
    got = {r.cell: r.page for r in exact_dedup.page_directory(cells, 100, 4).collect()}
    # Cells 0-1 share a page, cell 2 fills one, cell 3 stays overfull, 9 is alone in the upper half.
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 9: 3}


def _index(spark, rows, **options):
    return exact_dedup.Index(spark.createDataFrame(rows, "__id long, __text string").repartition(8), 2000, **options)


def test_a_full_directory_makes_no_chains_without_copies(spark):
    index = _index(spark, [(i, f"text {i}") for i in range(2000)], max_depth=4)
    assert index.depth == 4 and not index.has_chains and index.pages <= 16
    copies = [(5000 + i, "copy " * 500) for i in range(100)]
    index = _index(spark, [(i, f"text {i}") for i in range(2000)] + copies, max_depth=4)
    assert [r.cell for r in index.chains.collect()] and index.chains.count() == 1


def test_hot_rows_without_ids_spread_over_their_chain(spark):
    index = _index(spark, [(None, "copy " * 20)] * 4000)
    assert index.has_chains
    counts = [r["n"] for r in index.grouped(exact_dedup.F.count(exact_dedup.F.lit(1)).alias("n")).collect()]
    assert sum(counts) == 4000 and len(counts) >= 5 and max(counts) <= 2000


def test_exact_dedup_plan_has_no_python(spark):
    plan = QUERIES["op10_exact_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_golay_keys_meet_within_two_bits():
    codes = near_dedup.nearest_code(np.arange(1 << 16, dtype=np.int64) * 127 % (1 << 23))
    assert codes.min() >= 0 and codes.max() < 4096
    rng = np.random.default_rng(3)
    for width in (21, 22):
        x = rng.integers(0, 1 << width, 3000)
        y = x ^ (1 << rng.integers(0, width, 3000)) ^ np.where(rng.random(3000) < 0.7, 1 << rng.integers(0, width, 3000), 0)
        mine, theirs = ([set() for _ in x] for _ in range(2))
        for where, words in ((mine, x), (theirs, y)):
            for row, code in zip(*near_dedup.fuzzy_keys(words, width), strict=True):
                where[row].add(code)
        assert all(a & b for a, b in zip(mine, theirs, strict=True))
        assert max(map(len, mine)) <= 6


def classes(n, edges):
    root = list(range(n))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((of(a), of(b)))
        root[b] = a
    return [of(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 290)] + [(300, 301 + i) for i in range(120)]
    want = classes(500, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    of = classes(len(fps), near)
    first = {}
    for i, c in zip(ids, of, strict=True):
        first[c] = min(first.get(c, 1 << 62), i if i is not None else 1 << 61)
    return [first[c] if first[c] < 1 << 61 else None for c in of]


@pytest.mark.parametrize("large", [near_dedup.LARGE, 3])
def test_components_of_dense_fingerprints(spark, large):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = []
    for _ in range(600):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    rows = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "doc_id long, fp long")
    rows = rows.withColumn("order", near_dedup._null_last("doc_id"))
    got = {r.doc_id: r.id for r in rows.join(near_dedup._component_of(rows, large), "fp").select("doc_id", "first.id").collect()}
    assert [got[i] for i in range(600)] == slow_components(range(600), fps)


def test_near_duplicates_match_brute_force(spark, docs, rows):
    got = near_dedup.near_duplicates(docs).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    want = slow_components([i for i, _ in rows], fps)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(i), f"{f:016x}", str(c)) for (i, _), f, c in zip(rows, fps, want, strict=True))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, {slow: slow for slow in want}))


def test_near_duplicates_of_the_documents(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = [slow_fingerprint(t) for _, t in texts]
    want = dict(zip([i for i, _ in texts], slow_components([i for i, _ in texts], fps), strict=True))
    assert {r.doc_id: r.component_id for r in QUERIES["op7_simhash"](spark, SF).collect()} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.keep_one(none).count() == 0
