"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; none is missed.

Two sets of similarity 0.8 or more share at least four fifths of the larger one. So, with all shingles in one order, the
first n - ceil(0.8 n) + 1 shingles of each (n is the size of the set) have one in common: its prefix, the keys of a text.
Texts that meet under a key are candidates, and every candidate is verified on the whole sets.

1. The order takes shingles that are common in a sample of ``SAMPLE`` texts last, the others by hash, so that texts with
   a common passage do not meet because of it. Any order finds all links; the sample only makes the buckets small.
2. A key of up to ``SMALL`` texts yields its pairs. What two sets share begins with their first common key, so the shorter
   rest behind it bounds their overlap, and all they share up to the end of one prefix are keys of both. Pairs whose
   keys are too few or too late (``_needed``, ``_overlap``) are not verified.
3. A crowded key is dealt over tasks in pieces of ``PIECE`` texts; each text is paired with the next one in an order of
   its own. Verified pairs of 2 and 3 give components.
4. Of the texts of a crowded key those outside of its most frequent component meet all others, piece by piece; sets that
   cannot have the overlap, by their sizes and the places of the key, and those that met under an earlier key are passed
   over. What a group of near
   copies needs is thus close to its size, as few are left outside after 3; texts with a passage in common and too many
   words of their own have the key too late.

Sets are compared by their 64-bit hashes, and texts with the same set are one text.

Links that another method proposes (``first``) are verified before all that; two texts that these connect are no candidates
any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumipair.llm.common import SEED, each_slice, give_back
from lumipair.llm.components import components
from lumipair.shared import lookup_join, remove_tables, written

SHINGLE_WORDS = 5
SMALL = 64
PIECE = 16_384
SAMPLE = 8000
COMMON = 2  # texts of the sample that hold a common shingle
MOST_COMMON = 200_000
PAIRS_A_SET = 4  # pairs that are verified at once, for each set in them


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of the shingles of a text, ascending."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    runs = [words[i:] for i in range(min(SHINGLE_WORDS, len(words)))]
    found = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*runs, strict=False)]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def digest(found: np.ndarray) -> int:
    """One number for a set of shingles, 0 for none."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)) if len(found) else 0


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys of a set; ``common`` has the common shingles, the most common one last."""
    n = len(found)
    rank = np.zeros(n, np.int64)
    if len(common):
        by_value = np.argsort(common)
        at = np.minimum(np.searchsorted(common, found, sorter=by_value), len(common) - 1)
        rank = np.where(common[by_value[at]] == found, by_value[at] + 1, 0)
    return found[np.argsort(rank, kind="stable")[:n - -(-4 * n // 5) + 1]]


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingles_of(texts: pa.Array) -> pa.Array:
    return each_slice(texts, lambda part: _lists(list(map(shingles, part))))


def described(common: np.ndarray, fingerprint: Callable[[np.ndarray], int]):
    """A text's digest (fp), the size of its set (n), its keys and the fingerprint of the set."""

    def of_slice(part: list[bytes]) -> pa.Array:
        fps, sizes, keys, prints = [], [], [], []
        for t in part:
            found = shingles(t)
            fps.append(digest(found))
            sizes.append(len(found))
            keys.append(prefix(found, common))
            prints.append(fingerprint(found.view(np.uint64)))
        columns = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), _lists(keys), pa.array(np.array(prints, np.uint64).view(np.int64))]
        return pa.StructArray.from_arrays(columns, names=["fp", "n", "keys", "print"])

    @F.arrow_udf("fp long, n int, keys array<long>, print long")
    def run(texts: pa.Array) -> pa.Array:
        return each_slice(texts, of_slice)

    return run


def common_shingles(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The common shingles of a sample, by number of texts."""
    share = min(1.0, sample / max(1, docs.count()))
    found = docs.sample(share, seed=SEED).select(F.explode(shingles_of("text")).alias("key")).groupBy("key").count()
    found = found.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST_COMMON).toArrow()
    return found.column("key").to_numpy()[::-1].copy()


def _buckets(items: Iterator[pa.RecordBatch], n_keys: int = 1) -> Iterator[list[np.ndarray]]:
    """Columns of each bucket of two rows or more of a partition sorted by its first ``n_keys`` columns."""
    held: list[list[np.ndarray]] = []

    def whole() -> Iterator[list[np.ndarray]]:
        if sum(len(h[0]) for h in held) > 1:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    for item in items:
        new = [c.to_numpy(zero_copy_only=False) for c in item.columns]
        if not item.num_rows:
            continue
        differs = np.zeros(item.num_rows, bool)
        for c in new[:n_keys]:
            differs[1:] |= c[1:] != c[:-1]
        differs[0] = bool(held) and any(c[0] != h[-1] for c, h in zip(new[:n_keys], held[-1], strict=False))
        begins = np.flatnonzero(differs)
        if not len(begins):
            held.append(new)
            continue
        if begins[0]:
            held.append([c[:begins[0]] for c in new])
        yield from whole()
        many = np.flatnonzero(np.diff(begins) > 1)
        for b, e in zip(begins[many].tolist(), begins[many + 1].tolist(), strict=True):
            yield [c[b:e] for c in new]
        held = [[c[begins[-1]:] for c in new]]
    yield from whole()


def _sent(parts: Iterator[list[np.ndarray]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Columns as batches of some size."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
    give_back()


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles that sets of these sizes share at least if their similarity is 0.8 or more."""
    return -(-4 * (a + b) // 9)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys that sets of these sizes share at least if their similarity is 0.8 or more."""
    return np.maximum(1, _overlap(a, b) - -(-4 * np.maximum(a, b) // 5) + 1)


def _ordered(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(fps[i], fps[j]), np.maximum(fps[i], fps[j])


PAIRS = "u long, v long, needed int, spare int"
PAIR_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _small_pairs(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp, n, place): each pair of a key with the keys it needs and by how much the rests behind this one exceed the overlap."""

    def parts() -> Iterator[list[np.ndarray]]:
        for _, fps, sizes, places in _buckets(items):
            i, j = np.triu_indices(len(fps), 1)
            like = _alike(sizes[i], sizes[j])
            i, j = i[like], j[like]
            rest = np.minimum(sizes[i] - places[i], sizes[j] - places[j])
            yield [*_ordered(fps, i, j), _needed(sizes[i], sizes[j]), rest - _overlap(sizes[i], sizes[j])]

    return _sent(parts(), ["u", "v", "needed", "spare"], PAIR_KINDS)


def _neighbours(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, piece, fp, n, place), sorted: a pair of each text with the next one of its piece, in a random order."""

    def parts() -> Iterator[list[np.ndarray]]:
        for keys, _, fps, sizes, _ in _buckets(items, 2):
            by = np.argsort((fps.view(np.uint64) ^ keys.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
            i, j = by[:-1], by[1:]
            like = _alike(sizes[i], sizes[j])
            yield list(_ordered(fps, i[like], j[like]))

    return _sent(parts(), ["u", "v"], PAIR_KINDS[:2])


def _outsiders(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, piece, fp, n, place, root, guest, keys), sorted: pairs of guests with the texts of the piece in other components.

    A pair is made under its first common key only.
    """

    def parts() -> Iterator[list[np.ndarray]]:
        for _, _, fps, sizes, places, roots, guests, keys in _buckets(items, 2):
            guest, own = np.flatnonzero(guests), np.flatnonzero(~guests)
            if not len(guest) or not len(own):
                continue
            before = [keys[i][:places[i]] for i in own.tolist()]
            owner = np.repeat(np.arange(len(own)), [len(k) for k in before])
            flat = np.concatenate([np.zeros(0, np.int64), *before])
            for g in guest.tolist():
                a, b = int(sizes[g]), sizes[own]
                rest = np.minimum(a - int(places[g]), b - places[own])
                met = (roots[own] != roots[g]) & _alike(a, b) & (rest >= _overlap(a, b))
                met[owner[np.isin(flat, keys[g][:places[g]])]] = False
                if met.any():
                    yield list(_ordered(fps, np.full(int(met.sum()), g), own[met]))

    return _sent(parts(), ["u", "v"], PAIR_KINDS[:2])


def _verified(pairs: DataFrame, rows: DataFrame, one: DataFrame, label: str) -> DataFrame:
    """The pairs (u, v) of similarity 0.8 or more, written. ``one`` has the number of one row for each digest."""
    nodes = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    texts = lookup_join(rows.select("number", "text"), one.join(nodes, "fp").select("number", "fp"), ["number"])
    sets = written(texts.select("fp", shingles_of("text").alias("s")), "candidate-shingles")
    # A pair carries a set to the other one, so that pairs are taken in rounds that move a few times the sets each; a write
    # removes its shuffles, and what lies on the disk at once does not grow with the number of pairs to a set.
    n_rounds = max(1, ceil(pairs.count() / max(1, PAIRS_A_SET * sets.count())))
    found = []
    for turn in range(n_rounds):
        part = pairs.filter(F.pmod(F.xxhash64("u", "v"), F.lit(n_rounds)) == turn) if n_rounds > 1 else pairs
        both = part.join(sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u")
        both = both.join(sets.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v")
        alike = 9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))
        found.append(written(both.filter(alike).select("u", "v"), label))
    remove_tables(sets)
    return reduce(DataFrame.unionByName, found)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) that do not lie in one component of ``roots`` (node, root)."""
    for end in ("u", "v"):
        pairs = lookup_join(pairs, roots.withColumnsRenamed({"node": end, "root": f"root_{end}"}), [end], "left")
    return pairs.filter("root_u is null or root_v is null or root_u <> root_v").select("u", "v")


def links(
    rows: DataFrame, small: int = SMALL, piece: int = PIECE, *, first: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Links (u, v) between digests, at least one path for each two texts of similarity 0.8 or more.

    ``rows`` has number, text and s (fp, n, keys, print). Sets of equal digests are one text, and those without shingles have
    no links; neither nulls nor ties play a part, as digests are numbers and any row of a set stands for it. ``first`` makes
    the pairs (u, v) that are verified first from the distinct texts (fp, print).
    """
    one = rows.filter("s.n > 0").groupBy("s.fp").agg(F.min(F.struct("number", "s.n", "s.print")).alias("one")).select("fp", "one.*")
    one = written(one, "similar-distinct")
    # Keys stay where they are, but those of rows that another row stands for.
    others = rows.filter("s.n > 0").select("number").join(one, "number", "left_anti")
    described = lookup_join(rows.filter("s.n > 0").select("number", "s.fp", "s.n", "s.keys"), others, ["number"], "left_anti")
    early = _verified(written(first(one.select("fp", "print")), "fingerprint-candidates"), rows, one, "fingerprint-links")
    connected = written(components(early), "fingerprint-roots")
    keys = described.select(F.posexplode("keys").alias("place", "key"), "fp", "n").select("key", "fp", "n", "place")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    counts = written(counts, "similar-keys")
    kept = keys.join(counts, "key")
    kept = written(kept.select("key", "fp", "n", "place", "texts"), "similar-met")
    remove_tables(counts)
    few = kept.filter(F.col("texts") <= small).select("key", "fp", "n", "place").repartition("key").sortWithinPartitions("key")
    found = few.mapInArrow(_small_pairs, PAIRS).groupBy("u", "v").agg(
        F.count(F.lit(1)).alias("met"), F.min("needed").alias("needed"), F.max("spare").alias("spare")
    )
    n_pieces = F.ceil(F.col("texts") / piece).cast("int")
    crowded = kept.filter(F.col("texts") > small).withColumn("pieces", n_pieces)
    if crowded.isEmpty():
        pairs = written(_apart(found.filter("met >= needed and spare >= 0").select("u", "v"), connected), "similar-candidates")
        return early.unionByName(_verified(pairs, rows, one, "similar-links"))
    # Keys that are not counted here, as they are crowded, may make up for missing ones.
    hidden = written(crowded.groupBy("fp").agg(F.count(F.lit(1)).cast("int").alias("hidden")), "similar-hidden")
    for end in ("u", "v"):
        found = found.join(hidden.withColumnsRenamed({"fp": end, "hidden": f"hidden_{end}"}), end, "left")
    more = F.least(F.coalesce("hidden_u", F.lit(0)), F.coalesce("hidden_v", F.lit(0)))
    found = found.filter((F.col("met") + more >= F.col("needed")) & (F.col("spare") + more >= 0)).select("u", "v")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("pieces")).cast("int")
    pieces = crowded.select("key", own.alias("piece"), "fp", "n", "place")
    near = pieces.repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(_neighbours, "u long, v long")
    pairs = written(_apart(found.unionByName(near).distinct(), connected), "similar-candidates")
    sure = early.unionByName(_verified(pairs, rows, one, "similar-links"))
    roots = written(components(sure), "similar-roots").withColumnRenamed("node", "fp")
    placed = crowded.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = written(placed.select("key", own.alias("piece"), "pieces", "fp", "n", "place", "root"), "similar-placed")
    most = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("roots")
    )
    most = written(most.filter("roots > 1").select("key", "main"), "similar-main")
    mixed = placed.join(most, "key")
    mixed = written(mixed, "similar-mixed")
    remove_tables(kept, hidden)
    its_keys = lookup_join(described.select("fp", "keys"), mixed.select("fp").distinct(), ["fp"])
    mixed = mixed.join(its_keys, "fp")
    names = ["key", "piece", "fp", "n", "place", "root", "guest", "keys"]
    guests = mixed.filter("root <> main").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    both = mixed.withColumn("guest", F.lit(False)).select(names).unionByName(guests.withColumn("guest", F.lit(True)).select(names))
    apart = both.repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(_outsiders, "u long, v long")
    apart = written(apart.distinct().join(pairs, ["u", "v"], "left_anti"), "similar-pairs")
    return sure.unionByName(_verified(apart, rows, one, "similar-links"))
