import random
from itertools import combinations
from pathlib import Path

import corpus_pipeline
import pytest
from test_dedup_operators import classes

from lumipair.llm import near_dedup, similar
from lumipair.shared import remove_tables, written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, s string"


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(texts):
    sets = [slow_shingles(t) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return sorted(i for i, c in enumerate(classes(len(sets), near)) if i == c)


def planted(rng):
    """Edited copies with similarities around 0.8, chains of them, unlike texts with a passage in common, short texts, nothing."""
    word = lambda: f"w{rng.randrange(100_000)}"
    passage = " ".join(word() for _ in range(25))
    texts = []
    for size in (20, 60, 100, 400):
        for _ in range(6):
            words = [word() for _ in range(size)]
            for _ in range(6):
                words = list(words)
                for _ in range(max(1, size * rng.randint(1, 6) // 200)):
                    words[rng.randrange(size)] = word()
                texts.append(" ".join(words))
    texts += [" ".join([*(word() for _ in range(40)), passage]) for _ in range(30)]
    return texts + [passage, passage.upper(), None, "", " \n", "one", "One", "one two", "a b c d e f", "a b c d e f g"]


@pytest.mark.parametrize("small", [similar.SMALL, 2])
def test_planted_near_copies_match_brute_force(spark, monkeypatch, small):
    texts = planted(random.Random(5))
    monkeypatch.setattr(similar.links, "__defaults__", (small, 16 if small < similar.SMALL else similar.PIECE))
    monkeypatch.setattr(similar, "SAMPLE", 50)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == slow_kept(texts)


def test_stage_drops_copies_with_one_word_changed(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(100_000)}" for _ in range(100)]
        texts += [" ".join(words), " ".join([*words[:50], "changed", *words[51:]])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == list(range(0, 80, 2))


def test_group_of_near_copies(spark):
    """A group above the size of a small bucket, of which most pairs are just below or just above the limit."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(100_000)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(150)] = f"w{rng.randrange(100_000)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == slow_kept(texts)


def test_texts_with_a_common_passage_make_few_rows(spark, monkeypatch):
    """2,000 texts that share three quarters of their words, none of them similar enough."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(33))
    texts = [" ".join([*(f"w{rng.randrange(10 ** 9)}" for _ in range(5)), passage]) for _ in range(2000)]
    made = []
    plain = similar.written
    monkeypatch.setattr(similar, "written", lambda df, label: made.append((label, plain(df, label))) or made[-1][1])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    assert near_dedup.keep_one(docs).count() == 2000
    rows = {label: df.count() for label, df in made if label in ("similar-candidates", "similar-pairs", "similar-placed")}
    assert sum(rows.values()) < 5 * 2000, rows


def test_fingerprints_link_first_and_the_rest_follows(spark, monkeypatch):
    """Copies with a word more among many are within two bits; the links that these miss come from the prefixes."""
    rng = random.Random(9)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(100_000)}" for _ in range(1500)]
        texts += [" ".join(words), " ".join([*words, "more"])]
    texts += planted(rng)
    made = {}
    plain = similar.written
    monkeypatch.setattr(similar, "written", lambda df, label: made.update({label: plain(df, label)}) or made[label])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == slow_kept(texts)
    early = {(min(r), max(r)) for r in made["fingerprint-links"].collect()}
    assert len(early) >= 15 and len(early) <= made["fingerprint-candidates"].count()
    assert not early & {(min(r), max(r)) for r in made["similar-candidates"].collect()}
    assert made["similar-links"].count() > 0
    prints = {r.fp: r.print % 2 ** 64 for r in made["similar-distinct"].select("fp", "print").collect()}
    assert all((prints[u] ^ prints[v]).bit_count() <= near_dedup.DISTANCE for u, v in early)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*")}


def test_stage_leaves_no_shuffles_and_moves_no_text_to_drop_copies(spark):
    texts = planted(random.Random(8))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    before = shuffle_files(spark)
    kept = near_dedup.keep_one(docs)
    # What is counted beside the tables that are written is a few numbers for each file.
    assert sum(f.stat().st_size for f in shuffle_files(spark) - before if f.exists()) < 20_000
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(number" not in plan


def test_tables_that_are_read_no_more_are_removed(spark):
    table = written(spark.range(5), "test")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    other = spark.range(3)
    assert folder.exists()
    remove_tables(table, other)
    assert not folder.exists()


def test_pairs_are_verified_in_rounds(spark, monkeypatch):
    """Many pairs to a set are verified a part at a time, and none is left out."""
    texts = planted(random.Random(5))
    monkeypatch.setattr(similar, "PAIRS_A_SET", 0.3)
    made = []
    plain = similar.written
    monkeypatch.setattr(similar, "written", lambda df, label: made.append(label) or plain(df, label))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == slow_kept(texts)
    assert made.count("similar-links") > 2
