"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

A leaf of the tree holds the rank of the pair that starts at a symbol, an inner node the smaller of its two children.
The root is the lowest rank of the word; walking down to the left child whenever it holds that rank finds the leftmost
such pair. Joining it changes three leaves, each mended on its way to the root, so that a word of n symbols takes
O(n log n) steps whatever it looks like.

Defined results: a null or empty text has no ids and decodes to an empty text; special strings inside a text are their
own ids; ids without a token are skipped in decoding, as is null; every row is encoded on its own, whole, copies and
repeated ids included; an empty table gives an empty result; other columns stay as they are, but for those named like a
result, which it replaces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.llm.common import batches, documents, texts_of
from lumipair.llm.tokens import Memory, by_parts, remembered, vocabulary, vocabulary_path

NO_PAIR = 1 << 40


@lru_cache(maxsize=4)
def _merges(path: str) -> dict[tuple[int, int], tuple[int, int]]:
    """(left id, right id) to (rank, joined id)."""
    ids = vocabulary(path).ids
    return {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(vocabulary(path).pairs)}


def encode_word(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    n = len(ids)
    if n < 2:
        return ids
    ids, size = list(ids), 1 << (n - 1).bit_length()
    nothing = (NO_PAIR, -1)
    joined = [merges.get(p, nothing) for p in zip(ids, ids[1:], strict=False)]
    tree = [NO_PAIR] * (2 * size)
    tree[size:size + n - 1] = [rank for rank, _ in joined]
    joined.append(nothing)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, pair: tuple[int, int]) -> None:
        joined[i] = pair
        node, tree[size + i] = size + i, pair[0]
        while node > 1:
            node >>= 1
            lowest = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == lowest:
                break
            tree[node] = lowest

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    while (lowest := tree[1]) != NO_PAIR:
        node = 1
        while node < size:
            node = 2 * node if tree[2 * node] == lowest else 2 * node + 1
        i = node - size
        j, ids[i] = after[i], joined[i][1]
        alive[j] = False
        after[i] = k = after[j]
        put(j, nothing)
        if k < n:
            before[k] = i
            put(i, merges.get((ids[i], ids[k]), nothing))
        else:
            put(i, nothing)
        if (h := before[i]) >= 0:
            put(h, merges.get((ids[h], ids[i]), nothing))
    return [x for x, there in zip(ids, alive, strict=True) if there]


@lru_cache(maxsize=4)
def _encoder(path: str) -> Memory:
    own, merges = vocabulary(path), _merges(path)

    def ids(part: bytes) -> bytes:
        found: list[int] = []
        for word in own.words(part):
            if isinstance(word, int):
                found.append(word)
            else:
                found.extend(encode_word([own.ids[s] for s in own.symbols(word)], merges))
        return np.array(found, "<i4").tobytes()

    return by_parts(own, lambda parts: list(map(ids, parts)), b"".join)


def _encode_batch(batch: pa.RecordBatch, path: str, text: str, ids: str) -> pa.RecordBatch:
    own, encoder, at = vocabulary(path), _encoder(path), batch.schema.get_field_index(text)
    encoded = list(map(b"".join, remembered(texts_of(batch.column(at)), own, encoder)))
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32())
    return batch.remove_column(at).append_column(ids, pa.ListArray.from_arrays(pa.array(offsets), values))


def _decode_batch(batch: pa.RecordBatch, path: str, ids: str, text: str) -> pa.RecordBatch:
    tokens, by_bytes = vocabulary(path).token, vocabulary(path).decoder == "ByteLevel"
    texts = []
    for row in batch.column(ids):
        found = _tokens_of(row.values.to_numpy(zero_copy_only=False).tolist(), tokens) if row.is_valid else []
        texts.append(_text_of_symbols(found) if by_bytes else " ".join(found))
    return batch.append_column(text, pa.array(texts, pa.string()))


def _tokens_of(ids: list[int], tokens: dict[int, str]) -> list[str]:
    try:
        return list(map(tokens.__getitem__, ids))
    except KeyError:
        return [tokens[i] for i in ids if i in tokens]


def _columns(df: DataFrame, but: tuple[str, ...]) -> str:
    return "".join(f"`{name}` {kind}, " for name, kind in df.dtypes if name not in but)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a new array column ``ids``; ``text`` itself is left out."""
    path = path or vocabulary_path()
    rows = docs.drop(ids)
    return batches(rows, lambda b: _encode_batch(b, path, text, ids), f"{_columns(rows, (text,))}`{ids}` array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with a new column ``text``: what the ids decode to, special tokens included."""
    path = path or vocabulary_path()
    rows = encoded.drop(text)
    return batches(rows, lambda b: _decode_batch(b, path, ids, text), f"{_columns(rows, ())}`{text}` string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``decode(encode(docs))`` in one pass: ``text`` gives way to ``ids`` and ``decoded``."""
    path = path or vocabulary_path()
    rows = docs.drop("ids", "decoded")
    schema = f"{_columns(rows, ('text',))}ids array<int>, decoded string"
    return batches(rows, lambda b: _decode_batch(_encode_batch(b, path, "text", "ids"), path, "ids", "decoded"), schema)


@lru_cache(maxsize=1)
def _byte_of_symbol() -> dict[str, int]:
    """Printable stand-ins of bytes: bytes that print stand for themselves, the rest count up from 256."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}


def _text_of_symbols(tokens: list[str]) -> str:
    table = _byte_of_symbol()
    return b"".join(bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t in tokens).decode("utf-8", "replace")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(documents(spark, sf_dir).select("doc_id", "text"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
