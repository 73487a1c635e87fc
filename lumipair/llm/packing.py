"""Packing of documents into training sequences by best fit under conflicts.

A sequence (bin) holds at most one document of each source and of each cluster of duplicates. Bins carry a bitmap of the
sources and one of the clusters they hold and are ordered by residual, the room that is left. Documents come largest
first; the search starts at the smallest residual that holds the document and goes on to the successors until neither
bitmap meets the document's bits: that is the tightest compatible bin. If there is none, a new bin is opened.

Bins in the same state (residual and both bitmaps) form one class, so that a group of copies, each in a bin of its own,
is one step of the search and not thousands. Bitmaps are exact: bits are numbered inside a shard, and only clusters that
occur there more than once have one.

Documents are dealt by hash to shards of about ``SHARD_TOKENS`` tokens, which are packed independently of each other; a
source or cluster of any size spreads over all of them. Equal rows are counted first and dealt in portions of at most an
eighth of a shard, so that a third of all rows with one null id and one length spread as well. A document longer than a bin is cut: its full pieces are bins of
their own and the rest is packed like any other, as part of the same document.

Defined results: a null source or cluster conflicts with nothing; a length that is null or below 1 counts as 1, the end
of the document; documents of equal length come by id, null first, then by cluster; repeated rows are packed one by one;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumipair.llm import tokens
from lumipair.llm.common import documents, each_slice, ship
from lumipair.llm.tokens import GROUP_BYTES, Memory, by_parts, library_tokenizer, remembered, vocabulary, vocabulary_path
from lumipair.shared import written

CAPACITY = 2048
SHARD_TOKENS = 6_000_000
ROW_TOKENS = 32  # what a document counts besides its tokens, so that a shard of short ones stays small
# What workers remember of token counts where other stages of a pipeline use the same workers; a packing of its own
# remembers as much as other token operators.
REMEMBERED_BYTES = 16_000_000
PACKED = "doc_id long, piece int, bin string, begin int, n_tokens int"


class Bins:
    """Bins of one shard by class: (residual, source bits, cluster bits), with the numbers of the bins in that state."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.order: list[tuple[int, int, int]] = []
        self.members: dict[tuple[int, int, int], deque[int]] = {}

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, room used before) for a document with its source bit and cluster bit, 0 for none."""
        at = bisect_left(self.order, (size, 0, 0))
        while at < len(self.order) and (self.order[at][1] & source or self.order[at][2] & cluster):
            at += 1
        if at < len(self.order):
            state = self.order[at]
            number = self.members[state].popleft()
            if not self.members[state]:
                del self.members[state], self.order[at]
        else:
            state, number, self.n = (self.capacity, 0, 0), self.n, self.n + 1
        left = (state[0] - size, state[1] | source, state[2] | cluster)
        if left[0]:
            if left not in self.members:
                self.members[left] = deque()
                insort(self.order, left)
            self.members[left].append(number)
        return number, self.capacity - state[0]


def pack_shard(rows: Iterable[tuple[int | None, int | None, str | None, int | None]], shard: int, capacity: int) -> Iterator[tuple]:
    """(doc_id, piece, bin, begin, n_tokens) from (doc_id, n_tokens, source, cluster)."""
    known = [(i, max(1, n or 1), s, c) for i, n, s, c in rows]
    times = Counter(c for *_, c in known if c is not None)
    # Bits are numbered in order of the names, so that a task that is run again gives the same bins.
    clusters = {c: 1 << k for k, c in enumerate(sorted(c for c, n in times.items() if n > 1))}
    sources = {s: 1 << k for k, s in enumerate(sorted({s for _, _, s, _ in known if s is not None}))}
    n_full, rest = 0, []
    for i, n, s, c in known:
        pieces, left = divmod(n, capacity)
        for piece in range(pieces):
            yield i, piece, f"{shard}-full-{n_full}", 0, capacity
            n_full += 1
        if left:
            rest.append((-left, i is not None, i or 0, c is not None, c or 0, i, pieces, s, c))
    bins = Bins(capacity)
    for size, *_, i, piece, s, c in sorted(rest, key=lambda r: (*r[:5], r[6], r[7] or "")):
        number, begin = bins.place(-size, sources.get(s, 0), clusters.get(c, 0))
        yield i, piece, f"{shard}-{number}", begin, -size


def portions(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, n_shards: int = 1) -> DataFrame:
    """(doc_id, n_tokens, source, cluster, times, shard): equal rows as portions of at most an eighth of a shard."""
    row = ["doc_id", "n_tokens", "source", "cluster"]
    kinds = ["long", "long", "string", "long"]
    counted = docs.select(*[F.col(c).cast(k) for c, k in zip(row, kinds, strict=True)]).groupBy(*row).agg(F.count(F.lit(1)).alias("_all"))
    most = F.greatest(F.lit(1), F.floor(F.lit(shard_tokens / 8) / _size()))
    cut = counted.withColumn("_most", most).withColumn("_portion", F.explode(F.sequence(F.lit(0), F.floor((F.col("_all") - 1) / F.col("_most")))))
    times = F.least("_most", F.col("_all") - F.col("_portion") * F.col("_most")).cast("long")
    shard = F.pmod(F.xxhash64(*row, "_portion"), F.lit(n_shards)).cast("int")
    return cut.select(*row, times.alias("times"), shard.alias("shard"))


def _size() -> Column:
    return (F.greatest(F.lit(1), F.coalesce("n_tokens", F.lit(1))) + ROW_TOKENS).cast("long")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pack (doc_id, n_tokens, source, cluster): one row for each piece, with the bin and its place there."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(_size())).first()[0] or 0
    n_shards = max(1, -(-int(total) // shard_tokens))

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        shard = 0
        for item in items:
            columns = [c.to_pylist() for c in item.columns]
            for *row, times, shard in zip(*columns, strict=True):
                rows.extend([tuple(row)] * times)
        held: list[tuple] = []
        for row in pack_shard(rows, shard, capacity):
            held.append(row)
            if len(held) == 50_000:
                yield _batch(held)
                held = []
        yield _batch(held)

    return portions(docs, shard_tokens, n_shards).repartitionById(n_shards, "shard").mapInArrow(run, PACKED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "bin", "begin", "n_tokens"])


@lru_cache(maxsize=1)
def _library_counts(path: str, most_bytes: int) -> Memory:
    """Piece of text to the number of its tokens, by the tokenizers library."""
    tokenizer = library_tokenizer(path)

    def count(parts: list[bytes]) -> list[int]:
        # Lengths need no offsets, which the fast way leaves out.
        found = tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)
        return list(map(len, found))

    return by_parts(vocabulary(path), count, sum, most_bytes)


def _token_lengths(most_bytes: int):
    """Tokens of each text, with the end of the document."""

    @F.arrow_udf(T.LongType())
    def lengths(texts: pa.Array) -> pa.Array:
        path = vocabulary_path()
        own, known = vocabulary(path), _library_counts(path, most_bytes)
        # The pieces at hand take several times the bytes of their text.
        group = min(GROUP_BYTES, most_bytes // 16)
        return each_slice(texts, lambda part: pa.array([1 + sum(f) for f in remembered(part, own, known, group)], pa.int64()))

    return lengths


def packable(docs: DataFrame, clusters: DataFrame | None = None, remembered_bytes: int = REMEMBERED_BYTES) -> DataFrame:
    """(doc_id, n_tokens, source, cluster) of documents.

    ``clusters`` (doc_id, cluster), an id once at most, are the clusters of a near-duplicate operator, such as its
    components; a document that is not listed has none. Without them a cluster holds the texts with the same letters and
    digits, whatever their case, punctuation and white space; a text without a letter or digit has none.
    """
    ship(docs.sparkSession)
    n_tokens = _token_lengths(remembered_bytes)("text").alias("n_tokens")
    if clusters is not None:
        lengths = docs.select("doc_id", n_tokens, "source")
        return lengths.join(clusters.select("doc_id", F.col("cluster").cast("long")), "doc_id", "left")
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    # The condition reads the text and not ``plain``, which would be made for it and once more for the hash.
    return docs.select("doc_id", n_tokens, "source", F.when(F.col("text").rlike(r"[\p{L}\p{N}]"), F.xxhash64(plain)).alias("cluster"))


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, clusters: DataFrame | None = None,
    remembered_bytes: int = REMEMBERED_BYTES,
) -> DataFrame:
    return pack(written(packable(docs, clusters, remembered_bytes), "packable"), capacity, shard_tokens)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), remembered_bytes=tokens.REMEMBERED_BYTES)
