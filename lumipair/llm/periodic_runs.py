"""Periodic runs of words, found by block convolution.

A run of period q is a stretch of words in which words q apart are identical. At the dyadic scale B the words of a batch
are cut into aligned blocks of B words, and each block is compared with all places B to 2B - 1 words behind it at once:
the sum of squared differences of block and place is S(block) + S(place) - 2 C, where S are prefix sums of squares and C
is a correlation, computed by a number-theoretic transform of length 2B. A place where the sum is zero is a zero-mismatch
occurrence, and its distance d is a candidate for the period.

* *Exact sums.* Words are numbered in the batch, and at scale B a number is projected to few enough bits for all sums to
  stay below the modulus, so that they are exact integers. Equal words stay equal, so no occurrence is lost; unlike words
  may coincide, which the extension on the words themselves finds out.
* *Seeds.* A run of period d, B <= d < 2B, and length 4 d or more holds ``(3 d - B + 1) // B`` (two or more) neighbouring
  blocks with an occurrence at distance d. Shorter chains of blocks are no seeds.
* *Extension.* A chain is extended word by word to both sides, all chains of a scale together and in steps that double.
* *Smallest period.* If a place lies in a run that a smaller scale has found, that run's period divides d, and
  the candidate is none of its own. So runs come out once, with their smallest period.

All documents of a slice of a batch are one sequence, with a word of its own behind each, the longest first, so that a
scale only looks at documents that can hold its runs. There is no shuffle.

Defined results: words are runs of anything but ASCII white space; a null or empty text has no words and no runs; texts
of any length are treated whole; repeated rows give repeated results; a null id counts as the empty string where the
query repeats words; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumipair.llm.common import batches, documents, texts_of

PRIME = 998_244_353  # 119 * 2 ** 23 + 1, with primitive root 3
ROOT = 3
LONGEST_TRANSFORM = 1 << 23
SUM_BITS = 29  # 2 ** 29 < PRIME bounds every correlation
FEWEST_WORDS = 6
FEWEST_PERIODS = 4
# Numbers transformed together, so that they stay in a processor's cache.
TOGETHER = 1 << 16
SCHEMA = """doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string,
collapsed_sha256 string"""

Run = tuple[int, int, int]  # start, length, period


def _reduced(a: np.ndarray) -> np.ndarray:
    """``a`` modulo PRIME, by a division that numpy vectorises."""
    return a - a // np.uint64(PRIME) * np.uint64(PRIME)


@lru_cache(maxsize=64)
def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    root = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    found = np.ones(1, np.uint64)
    step = root
    while len(found) < half:
        # found holds 1 .. root ** (k - 1); step is root ** k for k = len(found)
        step = pow(root, len(found), PRIME)
        found = np.concatenate([found, _reduced(found * np.uint64(step))])
    return found[:half]


def transform(columns: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each column (a power of two long), in bit-reversed order."""
    n, n_columns = columns.shape
    prime, half = np.uint64(PRIME), n // 2
    while half:
        view = columns.reshape(-1, 2, half, n_columns)
        a, b = view[:, 0], view[:, 1]
        made = np.empty_like(view)
        np.add(a, b, out=made[:, 0])
        np.minimum(made[:, 0], made[:, 0] - prime, out=made[:, 0])
        turned = a + prime - b
        made[:, 1] = _reduced(turned * _powers(half, False)[:, None]) if half > 1 else np.minimum(turned, turned - prime)
        columns = made.reshape(n, n_columns)
        half //= 2
    return columns


def inverse_transform(columns: np.ndarray) -> np.ndarray:
    """From bit-reversed to natural order, the inverse of ``transform``."""
    n, n_columns = columns.shape
    prime, half = np.uint64(PRIME), 1
    while half < n:
        view = columns.reshape(-1, 2, half, n_columns)
        a, b = view[:, 0], view[:, 1]
        b = _reduced(b * _powers(half, True)[:, None]) if half > 1 else b
        made = np.empty_like(view)
        np.add(a, b, out=made[:, 0])
        np.minimum(made[:, 0], made[:, 0] - prime, out=made[:, 0])
        less = a + prime - b
        np.minimum(less, less - prime, out=made[:, 1])
        columns = made.reshape(n, n_columns)
        half *= 2
    return _reduced(columns * np.uint64(pow(n, PRIME - 2, PRIME)))


def _projected(words: np.ndarray, block: int) -> np.ndarray:
    """Word numbers as numbers below 2 ** bits, with block * 4 ** bits <= 2 ** SUM_BITS."""
    bits = max(1, (SUM_BITS - (block.bit_length() - 1)) // 2)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed >> np.uint64(64 - bits)


def occurrences(words: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of a block, distance) of the zero-mismatch occurrences ``block`` to 2 * ``block`` - 1 words behind each block."""
    n_blocks, size = -(-len(words) // block), 2 * block
    if size > LONGEST_TRANSFORM:
        raise ValueError(f"documents of more than {LONGEST_TRANSFORM * 2} words are not supported")
    values = np.zeros((n_blocks + 3) * block, np.uint64)
    values[:len(words)] = _projected(words, block)
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * values)])
    sums = squares[block:] - squares[:-block]  # of the block words from each place on
    windows = np.lib.stride_tricks.sliding_window_view(values, size)[block::block][:n_blocks]
    step, blocks, distances = max(1, TOGETHER // size), [], []
    place = (-np.arange(block)) % size
    for begin in range(0, n_blocks, step):
        end = min(begin + step, n_blocks)
        turned = np.zeros((size, end - begin), np.uint64)
        turned[place] = values[begin * block:end * block].reshape(-1, block).T
        product = _reduced(transform(turned) * transform(np.ascontiguousarray(windows[begin:end].T)))
        met = inverse_transform(product)[:block]
        at = np.arange(begin, end) * block
        near = np.lib.stride_tricks.sliding_window_view(sums, block)[at + block].T
        distance, row = np.nonzero(sums[at] + near == 2 * met)
        blocks.append(row + begin)
        distances.append(distance + block)
    return np.concatenate(blocks), np.concatenate(distances)


def _extended(words: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, in direction ``step`` (1 or -1), equal those ``distance`` behind them."""
    found, alive, width = np.zeros(len(at), np.int64), np.arange(len(at)), 8
    last = len(words) - 1
    while len(alive):
        for part in np.array_split(alive, -(-len(alive) * width // (1 << 20))):
            where = at[part, None] + step * (found[part, None] + np.arange(width))
            other = where + distance[part, None]
            equal = (where >= 0) & (other <= last)
            equal &= words[np.clip(where, 0, last)] == words[np.clip(other, 0, last)]
            found[part] += np.where(equal.all(axis=1), width, np.argmin(equal, axis=1))
        # Those that did not stop inside this step go on.
        ends = at[alive] + step * found[alive]
        inside = (ends >= 0) & (ends + distance[alive] <= last)
        ends = np.where(inside, ends, 0)
        inside &= words[ends] == words[np.minimum(ends + distance[alive], last)]
        alive, width = alive[inside], min(2 * width, 1 << 14)
    return found


def runs_of_sequence(words: np.ndarray, reach: dict[int, int]) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``words``, numbers; ``reach`` has the words to look at for each scale."""
    known = np.zeros((0, 3), np.int64)
    for block, size in sorted(reach.items()):
        blocks, distance = occurrences(words[:size], block)
        begin = blocks * block
        covered = np.zeros(size + 1, np.int64)
        inside = known[known[:, 0] < size]
        np.maximum.at(covered, inside[:, 0], inside[:, 0] + inside[:, 1])
        fresh = np.maximum.accumulate(covered)[begin] < begin + block + distance
        blocks, distance = blocks[fresh], distance[fresh]
        order = np.lexsort((blocks, distance))
        blocks, distance = blocks[order], distance[order]
        breaks = np.flatnonzero((np.diff(distance) != 0) | (np.diff(blocks) != 1)) + 1
        first = np.concatenate([[0], breaks])[:len(blocks)]
        last = np.concatenate([breaks, [len(blocks)]])[:len(blocks)] - 1
        distance = distance[first]
        long = last - first + 1 >= (3 * distance - block + 1) // block
        first, last, distance = first[long], last[long], distance[long]
        if not len(first):
            continue
        # The blocks between are equal in the projection only: extend from the first word, then check where that ends.
        start = blocks[first] * block
        forward = _extended(words, start, distance, 1)
        backward = _extended(words, start - 1, distance, -1)
        seeds = [np.stack([start - backward, forward + backward + distance, distance], axis=1)]
        # A chain with a false match inside may hold a run behind it, which begins at one of its later blocks.
        short = np.flatnonzero(forward < (last - first + 1) * block)
        for i in short.tolist():
            others = blocks[first[i]:last[i] + 1] * block
            d = np.full(len(others), distance[i])
            ahead, behind = _extended(words, others, d, 1), _extended(words, others - 1, d, -1)
            seeds.append(np.stack([others - behind, ahead + behind + d, d], axis=1))
        found = np.unique(np.concatenate(seeds), axis=0)
        found = found[found[:, 1] >= np.maximum(FEWEST_WORDS, FEWEST_PERIODS * found[:, 2])]
        covered = np.zeros(len(words) + 1, np.int64)
        np.maximum.at(covered, known[:, 0], known[:, 0] + known[:, 1])
        found = found[np.maximum.accumulate(covered)[found[:, 0]] < found[:, 0] + found[:, 1]]
        known = np.concatenate([known, found])
    return known


def runs_of_documents(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each document, given by its words: (start, length, period), by start, then period."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    numbered = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    order = [i for i in order if len(texts[i]) >= FEWEST_WORDS]
    found: list[list[Run]] = [[] for _ in texts]
    if not order:
        return found
    alone = len(number)  # a word behind each document that is nowhere else
    sequence = np.concatenate([x for k, i in enumerate(order) for x in (numbered[i], np.array([alone + k]))])
    sizes = np.array([len(texts[i]) for i in order])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    reach, block = {}, 1
    while FEWEST_PERIODS * block <= sizes[0]:
        reach[block] = int(begins[np.count_nonzero(sizes >= FEWEST_PERIODS * block)])
        block *= 2
    runs = runs_of_sequence(sequence, reach)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    for k, (start, length, period) in zip(owner.tolist(), runs.tolist(), strict=True):
        found[order[k]].append((start - int(begins[k]), length, period))
    return found


def strongest(runs: list[Run]) -> Run:
    """The run with the greatest length by its period; of equal ones the first, then the one of the smallest period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that stay: of each run the first period, unless another run drops it."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, words (array), runs (array of start, length, period)."""
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.split() for t in texts_of(batch.column(1))]
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs_of_documents(words)]
        text = pa.array([[w.decode() for w in found] for found in words], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(runs, kinds)], names=["doc_id", "words", "runs"])

    return batches(docs.select("doc_id", "text"), make, "doc_id long, words array<string>, runs array<struct<start: long, length: long, period: long>>")


def repeated_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query reads them: every tenth document by its hash repeats a stretch up to its end."""
    hashed = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), hashed // 10
    if hashed % 10 or not n:
        return words
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    tail = n - begin
    return words[:begin] + (words[begin:begin + period] * -(-tail // period))[:tail]


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column(0).to_pylist()
    words = [repeated_words(t.split(), i) for t, i in zip(texts_of(batch.column(1)), ids, strict=True)]
    rows = []
    for own, runs in zip(words, runs_of_documents(words), strict=True):
        start, length, period = strongest(runs) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(collapsed(own, runs))
        rows.append((
            len(runs), start, length, period, 1000 * length // period if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
        ))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(documents(spark, sf_dir).select("doc_id", "text"), _digest, SCHEMA)
