"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

The binary Golay code of length 23 has 4096 words, and every 23-bit string is within 3 bits of exactly one. The code
words within 4 bits of a string are those its own neighbours at one bit decode to: one, or six where the string lies at
distance 3. Two strings that differ in at most 2 bits have a string within one bit of both, so that they share one of
these code words. They are the string's fuzzy keys.

A fingerprint of 64 bits has three segments of 22, 21 and 21 bits. If two fingerprints differ in at most 2 bits, one
segment is equal in both (pigeonhole) and the next one differs in at most 2 bits. So the keys of a fingerprint are, for
each segment, its value with each fuzzy key of the next segment: 34 bits, about 15 keys. Distinct fingerprints of equal
key meet in a bucket, where the actual distance is verified.

1. Fingerprints of whole texts are written; equal ones are counted as one from then on.
2. Keys are dealt by hash and sorted. A task reads its buckets one after the other and connects what is verified to the
   smallest fingerprint it is linked with inside the bucket: one row for each member at most, not one for each pair.
   A bucket above ``LARGE`` distinct fingerprints is first split by pigeonhole over its remaining bits, which loses
   no link either.
3. Components of these links, then of documents.

Defined results: A-Z are lowered, words are runs of anything but ASCII white space; a text of fewer words than a shingle
is one shingle; a null text or one without words has fingerprint 0, which links like any other; repeated rows are in one
component; null ids count as larger than all others; an empty table gives an empty result.

``keep_one`` links texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints of these shingles
go steps 1 to 3, with every link verified on the whole sets; as they lie more than 2 bits apart for many such texts,
``similar`` finds the links between the components that this leaves, so that none is missed. It keeps all other columns, whatever their names, and of each component the row with the smallest doc_id,
whichever of repeated rows; texts without words are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumipair.llm import similar
from lumipair.llm.common import SEED, batches, documents, ship
from lumipair.llm.components import components
from lumipair.shared import lookup_join, written

SHINGLE_WORDS = 3
DISTANCE = 2
SEGMENTS = [(0, 22), (22, 21), (43, 21)]  # first bit and width
LARGE = 50_000
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the binary Golay code


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not words:
        return 0
    runs = [words[i:] for i in range(min(shingle_words, len(words)))]
    return of_hashes(np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*runs, strict=False)], np.uint64))


def of_hashes(hashed: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones, octets = np.zeros(64, np.int64), hashed.view(np.uint8).reshape(-1, 8)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for i in range(8):
        ones[8 * i:8 * i + 8] = np.bincount(octets[:, i], minlength=256) @ bits
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle_words: int):
    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64))

    return run


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits of a word, and the error pattern of each remainder."""
    low = np.array([_remainder(w) for w in range(1 << 12)], np.int64)
    high = np.array([_remainder(w << 12) for w in range(1 << 11)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in range(1, 4):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            errors[_remainder(pattern)] = pattern
    return low, high, errors


def nearest_code(words: np.ndarray) -> np.ndarray:
    """The number (12 bits) of the code word nearest to each 23-bit word."""
    low, high, errors = _decoder()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) for the code words within reach of one bit of each word of ``width`` bits."""
    near = np.sort(nearest_code(words[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])[None, :]), axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, at = np.nonzero(fresh)
    return rows, near[rows, at]


def _segment(fps: np.ndarray, first: int, width: int) -> np.ndarray:
    return ((fps.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for every key of each fingerprint (int64)."""
    keys, rows = [], []
    for i, (first, width) in enumerate(SEGMENTS):
        second = SEGMENTS[(i + 1) % 3]
        row, code = fuzzy_keys(_segment(fps, *second), second[1])
        keys.append((i << 34) | (_segment(fps, first, width)[row] << 12) | code)
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _emit_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    fps = batch.column(0).to_numpy(zero_copy_only=False)
    keys, rows = bucket_keys(fps)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])


def _split_large(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Three rows for one: the part of the remaining bits that is taken as equal, and its value, become part of the key."""
    keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    made: list[tuple[np.ndarray, np.ndarray]] = []
    for i, (first, width) in enumerate(SEGMENTS):
        own = fps[keys >> 34 == i]
        rest = [b for b in range(64) if not first <= b < first + width]
        for part in range(3):
            bits = np.uint64(sum(1 << b for b in rest[part::3]))
            made.append((np.bitwise_xor(keys[keys >> 34 == i] * 4 + part + 1, (own.view(np.uint64) & bits).view(np.int64)), own))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[0] for m in made])), pa.array(np.concatenate([m[1] for m in made]))], names=["key", "fp"])


def link_bucket(fps: np.ndarray, direct: bool = False) -> list[tuple[int, int]]:
    """(fingerprint, smallest one reachable inside the bucket by links of at most DISTANCE bits), others only.

    ``direct`` gives the one it was reached from instead, which is within DISTANCE bits itself.
    """
    found, left = [], np.unique(fps)
    while len(left) > 1:
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            here = frontier.pop()
            near = np.bitwise_count(left.view(np.uint64) ^ np.int64(here).view(np.uint64)) <= DISTANCE
            if near.any():
                joined = left[near].tolist()
                found.extend((x, int(here if direct else root)) for x in joined)
                frontier.extend(joined)
                left = left[~near]
    return found


def _link(items: Iterator[pa.RecordBatch], direct: bool = False) -> Iterator[pa.RecordBatch]:
    """Buckets of a partition sorted by key, one after the other; the last one of a batch may go on in the next."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def linked(ends: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for b, e in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist(), strict=True):
            found.extend(link_bucket(fps[b:e], direct))
        table = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["u", "v"])

    for item in items:
        keys = np.concatenate([keys, item.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, item.column(1).to_numpy(zero_copy_only=False)])
        ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(ends):
            yield linked(ends)
            keys, fps = keys[ends[-1]:], fps[ends[-1]:]
    yield linked(np.array([len(keys)])[:len(keys)])


def links(distinct: DataFrame, large: int = LARGE, direct: bool = False) -> DataFrame:
    """Links (u, v) that connect all fingerprints (column fp, distinct) within DISTANCE bits of each other."""
    keys = written(batches(distinct.select("fp"), _emit_keys, "key long, fp long"), "fingerprint-keys")
    crowded = keys.groupBy("key").count().filter(F.col("count") > large).select("key")
    if not crowded.isEmpty():
        crowded = written(crowded, "crowded-keys")
        split = batches(keys.join(crowded, "key", "left_semi").select("key", "fp"), _split_large, "key long, fp long")
        keys = keys.join(crowded, "key", "left_anti").select("key", "fp").unionByName(split)
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_link, direct=direct), "u long, v long")


def _component_of(rows: DataFrame, large: int = LARGE, linked: DataFrame | None = None) -> DataFrame:
    """(fp, first) from rows with fp and an orderable ``order``: the smallest ``order`` of the component of each fp.

    ``linked`` has the links; without it they are those of fingerprints.
    """
    distinct = written(rows.groupBy("fp").agg(F.min("order").alias("order")), "fingerprints-distinct")
    roots = written(components(links(distinct, large) if linked is None else linked), "fingerprint-roots")
    linked = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "order")
    firsts = linked.groupBy("root").agg(F.min("order").alias("first"))
    linked = linked.join(firsts, "root").select("fp", "first")
    found = distinct.join(linked, "fp", "left").select("fp", F.coalesce("first", "order").alias("first"))
    # Written, so that the join with all rows, where one fingerprint may be hot, is a plain one that Spark can split.
    return written(found, "fingerprint-components")


def _null_last(name: str):
    return F.struct(F.col(name).isNull().alias("unknown"), F.col(name).alias("id"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, large: int = LARGE) -> DataFrame:
    """One row per document: doc_id, fingerprint (hexadecimal), component_id (smallest doc_id of the component)."""
    ship(docs.sparkSession)
    rows = written(docs.select("doc_id", _fingerprints(shingle_words)("text").alias("fp")), "fingerprints")
    found = _component_of(rows.withColumn("order", _null_last("doc_id")), large)
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id")
    )


def close_texts(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of the texts (fp, print) that connect what fingerprints within DISTANCE bits connect, to be verified."""
    holders = written(distinct.groupBy("print").agg(F.min("fp").alias("holder")), "fingerprint-holders")
    equal = distinct.join(holders, "print").filter("fp <> holder").select(F.col("holder").alias("u"), F.col("fp").alias("v"))
    pairs = links(holders.select(F.col("print").alias("fp")), direct=True).distinct()
    for end in ("u", "v"):
        of_end = holders.select(F.col("print").alias(end), F.col("holder").alias(f"holder_{end}"))
        pairs = pairs.join(of_end, end)
    return equal.unionByName(pairs.select(F.col("holder_u").alias("u"), F.col("holder_v").alias("v")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of each component of similar texts, with all their columns."""
    ship(docs.sparkSession)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    found = similar.described(similar.common_shingles(docs), of_hashes)(docs["text"]).alias("s")
    # Written with a number for each row, so that one of several equal rows can be told from the others.
    rows = written(docs.select(row, _null_last("doc_id").alias("id"), found).withColumn("number", F.monotonically_increasing_id()), "similar-rows")
    slim = rows.select(F.col("s.fp").alias("fp"), "number", F.struct("id.unknown", "id.id", "number").alias("order"))
    first = _component_of(slim, linked=similar.links(rows.select("number", F.col("row.text").alias("text"), "s"), first=close_texts))
    dropped = slim.join(first, "fp").filter("first.number <> number").select("number")
    # Looked up by its measured size: a join that Spark plans shuffles the texts before it knows that little is dropped.
    return lookup_join(rows, dropped, ["number"], "left_anti").select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
