import hashlib
import random
import zlib

import numpy as np
import pytest

from lumipair.llm import bpe, token_counts, token_files
from lumipair.llm.queries import QUERIES
from lumipair.llm.tokens import Memory, library_tokenizer, vocabulary, vocabulary_path
from lumipair.shared import new_table_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, n_tokens string"
ODD = [
    None, "", "   \n\t", "word", "Word word WORD, word. word!!! (word) 'word'", "I'll we've'S 'd''s don't", "a" * 3000,
    "ab" * 2000 + " zz", "<|endoftext|>a<|startoftext|>b <|ENDOFTEXT|> x<|endof", "123४५ a1b2 x9", "İstanbul ΣΑΣ ǅ ﬁ é é",
    "中文字符 العربية 😀👩‍👩‍👧", "nbsp and em\u0085nel \x1c\x1d", "don't!!!??? ...—“”", "&&&word*** $$$word.,", "it'", "it's.'t",
]


@pytest.fixture(scope="module")
def library():
    return library_tokenizer(vocabulary_path())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None)], SCHEMA)


def naive_merge(symbols, ranks):
    """Join the leftmost lowest pair until there is none."""
    symbols = list(symbols)
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]:
        _, i = min(pairs)
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def test_heap_and_tree_merge_like_the_naive_loop():
    rng = random.Random(5)
    for _ in range(300):
        letters = "abc"
        tokens = list(letters)
        pairs = []
        for _ in range(rng.randint(0, 12)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair not in pairs:
                pairs.append(pair)
                tokens.append(pair[0] + pair[1])
        ranks = {p: r for r, p in enumerate(pairs)}
        word = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        want = naive_merge(word, ranks)
        assert token_counts.count_of_word(word, ranks) == len(want)
        ids = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        merges = {(ids[a], ids[b]): (r, ids[a + b]) for (a, b), r in ranks.items()}
        assert bpe.encode_word([ids[s] for s in word], merges) == [ids[s] for s in want]


def test_parts_are_tokenized_like_the_whole(library):
    rng, parts = random.Random(6), vocabulary(vocabulary_path()).parts
    for _ in range(2000):
        piece = "".join(rng.choice(["a", "B", "é", "É", ".", "'", "s", "!", "1", "|", "<", "ß", "-"]) for _ in range(rng.randint(1, 8)))
        joined = [i for p in parts(piece.encode()) for i in library.encode(p.decode(), add_special_tokens=False).ids]
        assert joined == library.encode(piece, add_special_tokens=False).ids, piece


def test_every_letter_with_a_mark_behind(library):
    own = vocabulary(vocabulary_path())
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    for before, mark in (("", '"'), ("a", "'"), ("\u0e01", "-")):
        pieces = [before + c + mark for c in letters]
        whole = [e.ids for e in library.encode_batch(pieces, add_special_tokens=False)]
        cut = [own.parts(p.encode()) for p in pieces]
        flat = library.encode_batch([p.decode() for c in cut for p in c], add_special_tokens=False)
        at, wrong = 0, []
        for piece, want, parts in zip(pieces, whole, cut, strict=True):
            got = [i for e in flat[at:at + len(parts)] for i in e.ids]
            at += len(parts)
            if got != want:
                wrong.append(piece)
        assert not wrong


def test_memory_is_bounded_by_bytes():
    memory = Memory(lambda pieces: [p * 2 for p in pieces], 50_000)
    for i in range(200):
        pieces = [b"%d-%d" % (i, k) for k in range(20)] + [b"x" * 1000]
        assert memory.of(pieces) == [p * 2 for p in pieces]
        assert memory.held <= 60_000 and len(memory.known) <= 400 and b"x" * 1000 not in memory.known


def test_common_pieces_are_made_once():
    made = []
    memory = Memory(lambda pieces: made.extend(pieces) or pieces, 20_000)
    for i in range(50):
        memory.of([b"common", *(b"%d-%d" % (i, k) for k in range(50))])
    assert made.count(b"common") == 1 and len(memory.known) < 250


def test_encode_decode_and_counts_match_the_library(odd, library):
    got = bpe.decode(bpe.encode(odd)).join(token_counts.token_counts(odd).dropDuplicates(), "doc_id").collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r["n_bytes"] == len((ODD[r.doc_id] or "").encode())
        assert r.over_limit == (len(ids) > 2048)
    assert token_counts.token_counts(odd).count() == len(ODD) + 2


def test_byte_vocabulary_round_trip(odd):
    path = vocabulary_path("byte_bpe_50k.json")
    for r in bpe.decode(bpe.encode(odd, path), path).filter("doc_id is not null").collect():
        assert r.decoded == (ODD[r.doc_id] or "")
        assert r.ids == library_tokenizer(path).encode(ODD[r.doc_id] or "", add_special_tokens=False).ids


def test_vocabulary_with_other_rules_is_refused(tmp_path):
    import json

    spec = json.load(open(vocabulary_path()))
    spec["model"]["byte_fallback"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        vocabulary(str(tmp_path / "v.json"))


def test_token_files(spark, odd, library):
    folder = new_table_path(spark, "test-token-files")
    manifest = token_files.write_token_files(odd, folder, length=16, file_bytes=3000)
    files = manifest.orderBy("part").collect()
    assert sum(f.n_tokens > 0 for f in files) > 1
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    order = sorted([(i, t or "") for i, t in enumerate(ODD)] + [(3, ODD[3])])
    rows = [(None, "no id"), *order]
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    start = 0
    for r, (_, text) in zip(got, rows, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        with token_files.TokenFile(r.file) as tokens:
            assert np.concatenate(list(tokens.ids(r.begin, r.begin + r.n_tokens))).tolist() == ids
        start += len(ids)
    for f in files:
        if f.n_tokens:
            with token_files.TokenFile(f.file) as tokens:
                n = -(-f.n_tokens // 16)
                masks = [tokens.sequence(i)[1] for i in range(n)]
                assert all(len(m) == 16 for m in masks) and sum(m.sum() for m in masks) == f.n_tokens
                assert not tokens.sequence(0)[0].flags.owndata  # a view of the mapped file


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.decode(bpe.encode(none)).count() == 0
    assert token_counts.token_counts(none).count() == 0
    manifest = token_files.write_token_files(none, new_table_path(spark, "test-token-files"))
    assert token_files.read_token_files(manifest).count() == 0


def test_queries_over_the_documents(spark, library):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs}
    start = 0
    got = {r.doc_id: r for r in QUERIES["op1_token_files"](spark, SF).collect()}
    for i, _ in docs:
        ended = [*ids[i], 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ended), zlib.crc32(np.array(ended, "<u4").tobytes()))
        start += len(ended)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_bpe"](spark, SF).collect()}
    assert got == {i: (len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op4_token_counts"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 2048) for i, t in docs}
