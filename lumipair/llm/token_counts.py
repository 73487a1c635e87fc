"""Token counts by byte-pair merging with a heap over a linked list.

The symbols of a word form a linked list; a heap holds the adjacent pairs that have a merge, by rank and then position.
Popping the lowest pair joins its two symbols and offers the two new neighbouring pairs. An entry whose symbols have
meanwhile changed is skipped. The count is the number of initial symbols minus the number of merges; no identifier is
looked up.

Defined results: a null or empty text has 0 tokens; special strings count as one token each; a text of any length is
counted whole; rows are counted one by one, whatever ids or copies they have; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.llm.common import batches, documents, texts_of
from lumipair.llm.tokens import Memory, by_parts, remembered, vocabulary, vocabulary_path

TOKEN_LIMIT = 2048


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[tuple[str, str], int]:
    return {pair: rank for rank, pair in enumerate(vocabulary(path).pairs)}


def count_of_word(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
    heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i] if symbols[i] == left else n
        if j >= n or symbols[j] != right:
            continue
        merges += 1
        symbols[i], symbols[j] = left + right, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (pair := (symbols[i], symbols[k])) in ranks:
                heappush(heap, (ranks[pair], i, *pair))
        if (h := before[i]) >= 0 and (pair := (symbols[h], symbols[i])) in ranks:
            heappush(heap, (ranks[pair], h, *pair))
    return n - merges


@lru_cache(maxsize=4)
def _counter(path: str) -> Memory:
    own, ranks = vocabulary(path), _ranks(path)

    def count(part: bytes) -> int:
        words = own.words(part)
        return sum(1 if isinstance(w, int) else count_of_word(own.symbols(w), ranks) for w in words)

    return by_parts(own, lambda parts: list(map(count, parts)), sum)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or vocabulary_path()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, counter = vocabulary(path), _counter(path)
        texts = texts_of(batch.column(1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(sum, remembered(texts, own, counter)), pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    counted = batches(docs.select("doc_id", "text"), count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
