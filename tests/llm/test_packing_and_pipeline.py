import random

import corpus_pipeline
from test_similar import slow_kept

from lumipair.llm import packing, pii, quality_rules
from lumipair.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin string, row string"


def slow_pack(rows, capacity):
    """The tightest compatible bin for each document, by looking at all bins; the oldest of bins in equal state."""
    sources = {s: 1 << k for k, s in enumerate(sorted({s for _, _, s, _ in rows if s is not None}))}
    clusters = [c for *_, c in rows if c is not None]
    bits = {c: 1 << k for k, c in enumerate(c for c in sorted(set(clusters)) if clusters.count(c) > 1)}
    bins, placed, since = [], {}, 0
    for i, n, s, c in sorted(rows, key=lambda r: (-r[1], r[0], r[3] is not None, r[3] or 0)):
        n %= capacity
        fits = [k for k, b in enumerate(bins) if b[0] >= n and not b[1] & sources.get(s, 0) and not b[2] & bits.get(c, 0)]
        if fits:
            k = min(fits, key=lambda k: (tuple(bins[k][:3]), bins[k][3]))
        else:
            k = len(bins)
            bins.append([capacity, 0, 0, 0])
        since += 1
        b = bins[k]
        placed[i] = (k, capacity - b[0])
        bins[k] = [b[0] - n, b[1] | sources.get(s, 0), b[2] | bits.get(c, 0), since]
    return placed


def test_best_fit_matches_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(i, rng.randint(1, 40), rng.choice([None, "a", "b", "c", "d", "e"]), rng.choice([None, *range(10)])) for i in range(rng.randint(0, 60))]
        rows = [r for r in rows if r[1] != 40]
        got = {i: (int(b.split("-")[1]), begin) for i, _, b, begin, _ in packing.pack_shard(rows, 0, 40)}
        assert got == slow_pack(rows, 40)


def test_hot_copies_are_one_class():
    rows = [(i, 30, "hot", 7) for i in range(20_000)] + [(50_000 + i, 9, "b", 100 + i) for i in range(20_000)]
    got = list(packing.pack_shard(rows, 0, 40))
    assert len({b for _, _, b, *_ in got}) == 20_000


def test_pieces_conflicts_and_room(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice([None, 0, 3, 500, 2048, 5000, 100_000]), rng.choice([None, "s1", "s2"]), rng.choice([None, 1, 2, i])) for i in range(300)]
    rows += [(7, 12, "s1", 1), (7, 12, "s1", 1), (None, 12, "s1", 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long"), 2048, 400_000).collect()
    assert sum(r.n_tokens for r in got) == sum(max(1, n or 1) for _, n, *_ in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    known = {i: (s, c) for i, _, s, c in rows if i not in (7, None)}
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.begin):
            assert r.begin == at
            at += r.n_tokens
        assert at <= 2048
        for k in (0, 1):
            held = [known[r.doc_id][k] for r in members if r.doc_id in known and known[r.doc_id][k] is not None]
            assert len(held) == len(set(held))
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long, source string, cluster long")).count() == 0


def test_equal_rows_spread_over_shards(spark):
    rows = [(None, 12, "s", None)] * 4000 + [(i, 12, "s", None) for i in range(2000)] + [(5, 12, None, 7)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long")
    cut = packing.portions(docs, 8000, 33)
    hot = cut.filter("doc_id is null").groupBy("shard").sum("times").collect()
    assert sum(r[1] for r in hot) == 4000 and len(hot) > 20 and max(r[1] for r in hot) < 4000 / 5
    assert cut.agg({"times": "sum"}).first()[0] == len(rows)
    got = packing.pack(docs, 2048, 8000)
    assert got.groupBy("doc_id").count().exceptAll(docs.groupBy("doc_id").count()).count() == 0
    assert got.filter("doc_id = 5").count() == 5 - 1


def test_clusters_of_near_copies_conflict(spark):
    words = [f"word{i}" for i in range(200)]
    near = [" ".join(words[:k] + ["other"] + words[k + 1:]) for k in (50, 120)]
    rows = [(1, near[0], "a"), (2, near[1], "b"), (3, "short text", "c"), (4, "?!", "d"), (5, "--", "e"), (6, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = {r.doc_id: r.bin for r in packing.pack_documents(docs, 10_000).collect()}
    assert len(set(own.values())) == 1  # nothing is a copy by letters and digits; texts without them have no cluster
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "doc_id long, cluster long")
    apart = {r.doc_id: r.bin for r in packing.pack_documents(docs, 10_000, clusters=clusters).collect()}
    assert apart.keys() == own.keys() and apart[1] != apart[2] and len(set(apart.values())) == 2


def test_cluster_keys_are_made_once(spark):
    """Same clusters as the plain text's hash, null without a letter or digit, with one replacement for each text."""
    texts = ["A b", "a, B!", None, "", " \n", "?!", "\u0130x", "i\u0307X", "\u00c9t\u00e9 9", "7", "\u0301", "\u00bd"]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    found = packing.packable(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    plain = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\\\p{L}\\\\p{N}]+', ' '))"
    want = docs.selectExpr("doc_id", f"if({plain} = '', null, xxhash64({plain})) as cluster")
    assert dict(found.select("doc_id", "cluster").collect()) == dict(want.collect())
    assert [r.doc_id for r in found.filter("cluster is null").orderBy("doc_id").collect()] == [2, 3, 4, 5, 10]


def test_packing_query_holds_every_document(spark):
    got = QUERIES["op2_packing"](spark, SF)
    lengths = packing.packable(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got.groupBy("doc_id").agg({"n_tokens": "sum"}).exceptAll(lengths.selectExpr("doc_id", "n_tokens")).count() == 0
    assert got.select("doc_id").distinct().count() == lengths.count()
    used, n_bins = got.selectExpr("sum(n_tokens)", "count(distinct bin)").first()
    assert used > 0.9 * n_bins * packing.CAPACITY


def slow_pipeline(rows):
    """doc_ids and texts that stages 1 to 4 leave of [(doc_id, text)]."""
    bits = quality_rules.mask(quality_rules.PRODUCTION)
    kept = []
    for i, t in rows:
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure_text(t or ""), strict=True))
        fails = {r.name: eval(r.fails, {}, m) for r in quality_rules.RULES}
        if not any(fails[name] and quality_rules.BIT[name] & bits for name in fails):
            kept.append((i, t))
    best = {}
    for i, t in kept:
        best[t] = max(best.get(t, i), i)
    kept = [(i, t) for t, i in best.items()]
    kept.sort()
    return {kept[k][0]: pii.redacted(kept[k][1]) for k in slow_kept([t for _, t in kept])}


def test_pipeline_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = slow_pipeline(rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    assert {r.doc_id: r.text for r in docs.collect()} == want
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(want)
    assert packed.agg({"n_tokens": "sum"}).first()[0] == packing.packable(docs).agg({"n_tokens": "sum"}).first()[0]


def test_stages_take_nulls_and_nothing(spark):
    text, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in ("word", "else", "third"))
    rows = [(1, text, None, None, None, "x", "y"), (1, text, None, None, None, "x", "y"), (None, other, None, "s", 3, None, None), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, None, None), (4, third + " a@b.cd", "en", "s", 0, "b", "r")]
    for found in (rows, []):
        docs = spark.createDataFrame(found, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(packed) == docs.count() == (len({r[1] for r in rows if r[1]}) if found else 0)


def test_remembering_goes_by_the_bytes_given():
    from lumipair.llm import tokens

    class Seen:
        groups: list[int] = []

        def each(self, groups):
            self.groups.append(len(groups))
            return [[len(p) for p in g] for g in groups]

    class Words:
        pieces = staticmethod(bytes.split)

    seen = Seen()
    assert list(tokens.remembered([b"aa b"] * 10, Words, seen, 12)) == [[2, 1]] * 10 and seen.groups == [3, 3, 3, 1]


def test_lengths_are_counted_without_offsets(monkeypatch):
    from lumipair.llm import tokens

    path, called = tokens.vocabulary_path(), []
    library = tokens.library_tokenizer(path)

    class Fast:
        def encode_batch_fast(self, texts, **options):
            called.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(packing, "library_tokenizer", lambda _: Fast())
    texts = ["Plain words, 12 of them.", "Été it's naïvé 中文", "", "<|endoftext|> a b"]
    memory = packing._library_counts.__wrapped__(path, 1_000_000)
    got = [sum(f) for f in tokens.remembered([t.encode() for t in texts], tokens.vocabulary(path), memory)]
    assert got == [len(library.encode(t, add_special_tokens=False)) for t in texts] and called
