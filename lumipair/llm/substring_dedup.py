"""Passages of many words that repeat across documents, found exactly behind a count-min prefilter.

A window is a number of consecutive words of one document (``WINDOW``). A word goes if a window over it also starts in a
document with a smaller id.

1. *Partition sketches.* Every task counts its windows in a count-min sketch of ``ROWS`` rows of cells and sends what is not
   zero: for each segment of 65,536 cells the cells met once and those met more often, as differences of a byte.
2. *Merged sketch.* Segments are dealt over tasks and added up as a stream. A bit is kept of a cell, met more than once, and
   the cells of the first row that were met more than ``HOT`` times are listed. The count of a window is never underestimated, so that a window found twice has
   its bit in every row.
3. *Exact pass.* Windows with all bits set are dealt by their 96-bit hashes, once, and sorted by id, so that a task reads the
   smallest id of a window first and passes on the rows behind it. For windows that are hot by the sketch the smallest
   ids are combined before a shuffle of their own, and their rows are dealt to ``SALTS`` places, each of which is
   given that id.
4. The words of the windows found are dropped, in the tasks that hold the texts.

The sketch has about three cells for each window up to ``2 ** MAX_BITS`` cells a row (128 MB of bits in all, and at most 16 MB of
hot cells, the bound of what is broadcast; with more hot cells all windows count as hot). Above some hundred million windows its bits fill up, and more and more windows take part in the exact
pass, which needs no sketch to be right: no window is lost at any size.

Defined results: words are runs of anything but ASCII white space; null and empty texts have none; texts of any length are
treated whole; a null id counts as the largest one; windows are properties of an id, so rows that repeat an id do not
remove each other's words, and repeated rows are returned as often; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.llm.common import SEED, batches, documents, give_back, ship, slices, texts_of
from lumipair.shared import written

WINDOW = 50
ROWS = 2
MIN_BITS, MAX_BITS = 16, 29
SEGMENT_BITS = 16
BYTES_A_CELL = 2  # of text; a window takes about six
HOT = 10_000
SALTS = 64
MOST_HOT = 1 << 22
# Windows a task holds before it sends what it has counted.
HELD = 1 << 22
LARGEST = (1 << 63) - 1
BASE = 0xD6E8FEB86659FD93  # odd: multiplication by it can be undone modulo 2 ** 64


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.cumprod(found)


def _rolling(values: np.ndarray, window: int) -> np.ndarray:
    """A hash of each ``window`` values in a row: sum of value * BASE ** -place, modulo 2 ** 64."""
    size = 1 << (len(values) + 1).bit_length()
    inverse = pow(BASE, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(size, inverse)[:len(values)])])
    return (sums[window:] - sums[:-window]) * _powers(size, BASE)[:len(values) - window + 1]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (values ^ (values >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)


class Windows:
    """The windows of some texts, in order: ``first`` hashes, ``owner`` (number of the text), and second hashes on demand."""

    def __init__(self, texts: list[list[bytes]], window: int):
        number: dict[bytes, int] = defaultdict(count().__next__)
        self.window, sizes = window, np.array([len(words) for words in texts], np.int64)
        self.ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in texts)])
        n = len(self.ids) - window + 1
        self.first, self.owner, self.starts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < 1:
            return
        self.digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, SEED) for w in number), np.uint64).reshape(-1, 2)
        owner = np.repeat(np.arange(len(texts)), sizes)
        self.starts = np.flatnonzero(owner[:n] == owner[window - 1:])
        self.owner = owner[self.starts]
        self.first = _mixed(_rolling(self.digests[self.ids, 0], window)[self.starts])

    def second(self, found: np.ndarray) -> np.ndarray:
        """Second hashes of the chosen windows; of few ones from their own words only."""
        starts = self.starts[found]
        if not len(starts):
            return np.zeros(0, np.uint64)
        if len(starts) * self.window > len(self.ids):
            return _mixed(_rolling(self.digests[self.ids, 1], self.window)[starts])
        powers = _powers(self.window, pow(BASE, -1, 1 << 64))
        words = self.digests[self.ids[starts[:, None] + np.arange(self.window)], 1]
        return _mixed((words * powers).sum(axis=1, dtype=np.uint64))


def _cells(first: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each window in each row of the sketch."""
    shift = np.uint64(64 - bits)
    return [(first >> shift).astype(np.uint32), (_mixed(first + np.uint64(BASE)) >> shift).astype(np.uint32)]


def packed(offsets: np.ndarray) -> bytes:
    """Rising numbers as the bytes of their differences; 255 stands for 255 more to come."""
    steps = np.diff(offsets, prepend=0)
    ends = np.cumsum(steps // 255 + 1) - 1
    made = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    made[ends] = steps % 255
    return made.tobytes()


def unpacked(held: bytes) -> np.ndarray:
    steps = np.frombuffer(held, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def _sent(cells: list[np.ndarray], row: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(row, segment, offsets of cells met once, offsets of cells met more often, how often)."""
    sorted_cells = np.sort(np.concatenate(cells))
    starts = np.flatnonzero(np.concatenate([[True], sorted_cells[1:] != sorted_cells[:-1]]))
    distinct, times = sorted_cells[starts], np.diff(np.append(starts, len(sorted_cells))).astype(np.uint32)
    segments = distinct >> SEGMENT_BITS
    begins = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]]))
    offsets = (distinct & ((1 << SEGMENT_BITS) - 1)).astype(np.int64)
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(distinct)], strict=True):
        own, more = offsets[begin:end], times[begin:end] > 1
        yield row, int(segments[begin]), packed(own[~more]), packed(own[more]), times[begin:end][more].tobytes()


def _partition_sketch(bits: int, window: int):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "segment", "once", "often", "times"])

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        n = 0
        for item in items:
            for part in slices(item):
                first = Windows([t.split() for t in texts_of(part.column(0))], window).first
                for cells, own in zip(held, _cells(first, bits), strict=True):
                    cells.append(own)
                n += len(first)
                if n >= HELD:
                    yield from (batch(list(_sent(cells, row))) for row, cells in enumerate(held))
                    held, n = [[] for _ in range(ROWS)], 0
        if n:
            yield from (batch(list(_sent(cells, row))) for row, cells in enumerate(held))

    return run


def _merged(hot: int):
    """Add up sketches sorted by row and segment, one segment at a time: bits of the cells met more than once, numbers of the hot ones."""
    names, kinds = ["row", "segment", "repeated", "hot"], [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def done(key: tuple[int, int], counts: np.ndarray) -> pa.RecordBatch:
        cells = np.flatnonzero(counts > hot) + (key[1] << SEGMENT_BITS) if key[0] == 0 else []
        made = *key, np.packbits(counts > 1, bitorder="little").tobytes(), list(cells)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(made, kinds, strict=True)], names=names)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(1 << SEGMENT_BITS, np.int64)
        for item in items:
            for row, segment, once, often, times in zip(*(c.to_pylist() for c in item.columns), strict=True):
                if (row, segment) != current:
                    if current is not None:
                        yield done(current, counts)
                    current, counts = (row, segment), np.zeros(1 << SEGMENT_BITS, np.int64)
                counts[unpacked(once)] += 1
                counts[unpacked(often)] += np.frombuffer(times, np.uint32)
        if current is not None:
            yield done(current, counts)
        give_back()

    return run


def sketch_bits(docs: DataFrame) -> int:
    """log2 of the cells of a row: about three cells for each window, ``2 ** MAX_BITS`` at most."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, (int(size) // BYTES_A_CELL).bit_length()))


def merged_sketch(docs: DataFrame, bits: int, window: int = WINDOW, hot: int = HOT) -> tuple[np.ndarray, np.ndarray | None]:
    """The bits of all cells by row, at most ``ROWS * 2 ** MAX_BITS``, and the hot cells of the first row, None for all."""
    ship(docs.sparkSession)
    sent = docs.select("text").mapInArrow(_partition_sketch(bits, window), "row int, segment int, once binary, often binary, times binary")
    dealt = sent.repartition("row", "segment").sortWithinPartitions("row", "segment")
    merged = written(dealt.mapInArrow(_merged(hot), "row int, segment int, repeated binary, hot array<long>"), "window-sketch")
    table = np.zeros((ROWS, 1 << (bits - SEGMENT_BITS), 1 << (SEGMENT_BITS - 3)), np.uint8)
    for row in range(ROWS):
        found = merged.filter(F.col("row") == row).select("segment", "repeated").toArrow()
        for segment, repeated in zip(found.column(0), found.column(1), strict=True):
            table[row, segment.as_py()] = np.frombuffer(repeated.as_py(), np.uint8)
    crowded = merged.select(F.explode("hot").alias("cell"))
    cells = None if crowded.count() > MOST_HOT else np.sort(np.array(crowded.toArrow().column(0).to_pylist(), np.uint32))
    return table.reshape(ROWS, -1), cells


def is_hot(cells: np.ndarray | None, first: np.ndarray, bits: int) -> np.ndarray:
    """Whether a window is counted as hot by the first row of the sketch."""
    if cells is None or not len(cells):
        return np.full(len(first), cells is None)
    own = (first >> np.uint64(64 - bits)).astype(np.uint32)
    return cells[np.minimum(np.searchsorted(cells, own), len(cells) - 1)] == own


def has_bits(table: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Whether the cells of a window have their bit in every row."""
    found = np.ones(len(first), bool)
    for row, cells in enumerate(_cells(first, bits)):
        found &= (table[row][cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _key() -> list:
    """What the windows of a row are gathered by: its id, and bits of its text so that no id gathers many rows."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)).alias("owner")
    return [order, F.hash(F.coalesce("text", F.lit(""))).alias("part")]


def _later(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (h, g, salt, owner, part), sorted: (owner, part, h) of the rows behind the smallest owner of their window."""
    current, least = None, 0
    for item in items:
        h, g, salt, owner, part = (c.to_numpy(zero_copy_only=False) for c in item.columns)
        if not len(h):
            continue
        starts = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])])
        first = owner[np.maximum.accumulate(np.where(starts, np.arange(len(h)), 0))]
        if (h[0], g[0], salt[0]) == current:
            ends = np.flatnonzero(starts[1:])
            first[:ends[0] + 1 if len(ends) else len(h)] = least
        current, least = (h[-1], g[-1], salt[-1]), first[-1]
        behind = owner > first
        yield pa.RecordBatch.from_arrays([pa.array(c[behind]) for c in (owner, part, h)], names=["owner", "part", "h"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, bits: int | None = None, hot: int = HOT) -> DataFrame:
    """(owner, part, windows): for rows with windows to be removed, the first hashes of these windows."""
    spark = docs.sparkSession
    bits = sketch_bits(docs) if bits is None else bits
    tables = merged_sketch(docs, bits, window, hot)
    sketch = spark.sparkContext.broadcast(tables)

    def suspected(only_hot: bool):
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            repeated, hot_cells = sketch.value
            windows = Windows([t.split() for t in texts_of(batch.column(2))], window)
            found = np.flatnonzero(is_hot(hot_cells, windows.first, bits)) if only_hot else np.arange(len(windows.first))
            found = found[has_bits(repeated, windows.first[found], bits)]
            first, second, owner = windows.first[found], windows.second(found), windows.owner[found]
            ids = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            place = (_mixed(ids.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32)
            salt = np.where(is_hot(hot_cells, first, bits), 1 + place, 0).astype(np.int32)
            columns = first.view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32), salt, ids
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(1).take(pa.array(owner))], names=["h", "g", "salt", "owner", "part"])

        return batches(docs.select(*_key(), "text"), make, "h long, g int, salt int, owner long, part int")

    windows = suspected(False)
    if tables[1] is None or len(tables[1]):
        least = written(suspected(True).groupBy("h", "g").agg(F.min("owner").alias("owner")), "hot-windows")
        every = F.explode(F.sequence(F.lit(1), F.lit(SALTS))).alias("salt")
        windows = windows.unionByName(least.select("h", "g", every, "owner", F.lit(0).alias("part")))
    dealt = windows.repartition("h", "g", "salt").sortWithinPartitions("h", "g", "salt", "owner")
    later = dealt.mapInArrow(_later, "owner long, part int, h long")
    return later.groupBy("owner", "part").agg(F.collect_set("h").alias("windows"))


def _kept(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    texts = [t.split() for t in texts_of(batch.column(1))]
    windows = batch.column(2)
    chosen = [i for i in range(len(texts)) if windows[i].is_valid]
    windows_of = Windows([texts[i] for i in chosen], window)
    first, owner = windows_of.first, windows_of.owner
    bounds = np.searchsorted(owner, np.arange(len(chosen) + 1))
    removed = np.zeros(len(texts), np.int64)
    for k, i in enumerate(chosen):
        own = np.isin(first[bounds[k]:bounds[k + 1]].view(np.int64), windows[i].values.to_numpy(zero_copy_only=False))
        change = np.zeros(len(texts[i]) + 1, np.int64)
        change[:len(own)] += own
        change[window:window + len(own)] -= own
        left = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
        removed[i] = len(texts[i]) - len(left)
        texts[i] = [texts[i][j] for j in left]
    sizes = np.array([len(t) for t in texts], np.int64) + removed
    text = pa.array([b" ".join(t).decode() for t in texts], pa.string())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(removed), text], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeated(docs: DataFrame, window: int = WINDOW, bits: int | None = None, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    rows = docs.select("doc_id", "text", *_key())
    found = rows.join(repeated_windows(docs, window, bits, hot), ["owner", "part"], "left").select("doc_id", "text", "windows")
    return batches(found, lambda batch: _kept(batch, window), "doc_id long, n_words long, n_removed long, kept_text string")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
