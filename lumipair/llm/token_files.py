"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned by doc_id and every partition becomes one file: the ids of its documents, one after the
other, each document closed by an end id, cut into sequences of ``length`` ids. A file is an Arrow stream with footer
whose record batches have two fixed-size-list columns, ``ids`` and ``mask``; the last sequence is filled up and its
mask false there. All batches but the last have ``SEQUENCES`` rows, so that id number p of a file is in batch
p div (length * SEQUENCES), at a known place of one flat buffer: ``TokenFile`` maps the file and takes views, nothing
is parsed or copied. Beside each file stands an Arrow file with the place of every document.

Ids are stored in 16 bits where the vocabulary allows it, else in 32.

Files have a name of their own for each task attempt and are listed in the manifest, a Parquet table that Spark commits.
A task that runs again leaves a file behind that no manifest names.

Defined results: a null or empty text is the end id alone; rows with equal doc_id follow each other by a hash of their
text, null ids come first; an empty table makes one file without sequences; the other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.llm.common import documents, ship, texts_of, whole_text
from lumipair.llm.tokens import Memory, by_parts, library_tokenizer, remembered, vocabulary, vocabulary_path
from lumipair.shared import new_table_path

LENGTH = 2048
SEQUENCES = 256
END_ID = 1
FILE_BYTES = 24 * 1024 * 1024  # of text
MANIFEST = "part int, file string, n_tokens long, n_documents long"


@lru_cache(maxsize=4)
def library_memory(path: str, dtype: str) -> Memory:
    """Piece of text to its ids, as bytes, by the tokenizers library."""
    tokenizer, own = library_tokenizer(path), vocabulary(path)

    def ids(parts: list[bytes]) -> list[bytes]:
        found = tokenizer.encode_batch([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)
        return [np.array(f.ids, dtype).tobytes() for f in found]

    return by_parts(own, ids, b"".join)


class TokenWriter:
    """Writes ids to an Arrow file of fixed-length sequences, holding one record batch at a time."""

    def __init__(self, stream, length: int, dtype: str):
        self.length, self.dtype = length, dtype
        values = pa.uint16() if dtype == "<u2" else pa.uint32()
        self.types = pa.list_(values, length), pa.list_(pa.bool_(), length)
        self.writer = pa.ipc.new_file(stream, pa.schema([("ids", self.types[0]), ("mask", self.types[1])]))
        self.held, self.n_held, self.n_tokens = [], 0, 0

    def append(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids) // np.dtype(self.dtype).itemsize
        if self.n_held >= self.length * SEQUENCES * np.dtype(self.dtype).itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        step = self.length * SEQUENCES
        full = len(ids) // step * step
        for begin in range(0, full, step):
            self._write(ids[begin:begin + step], step)
        rest = ids[full:]
        if last and len(rest):
            self._write(rest, -(-len(rest) // self.length) * self.length)
            rest = rest[:0]
        self.held, self.n_held = [rest.tobytes()], rest.nbytes

    def _write(self, ids: np.ndarray, size: int) -> None:
        padded = np.zeros(size, self.dtype)
        padded[:len(ids)] = ids
        arrays = [
            pa.FixedSizeListArray.from_arrays(pa.array(padded), type=self.types[0]),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(size) < len(ids)), type=self.types[1]),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, names=["ids", "mask"]))

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


class TokenFile:
    """Random access to a written file; local files are mapped into memory."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        local = isinstance(where, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else where.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def _flat(self, batch: int, column: str) -> np.ndarray:
        found = self.reader.get_batch(batch).column(column).flatten()
        return found.to_numpy(zero_copy_only=column == "ids")

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one sequence."""
        batch, row = divmod(number, SEQUENCES)
        part = slice(row * self.length, (row + 1) * self.length)
        return self._flat(batch, "ids")[part], self._flat(batch, "mask")[part]

    def ids(self, begin: int, end: int) -> Iterator[np.ndarray]:
        """The ids from place ``begin`` to ``end``, as views, one for each record batch."""
        step = self.length * SEQUENCES
        while begin < end:
            batch, at = divmod(begin, step)
            stop = min(step, at + end - begin)
            yield self._flat(batch, "ids")[at:stop]
            begin += stop - at


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write the token files of ``docs`` under ``folder``, which all executors share; returns the manifest, written there
    too: (part, file, n_tokens, n_documents), one row per file in doc_id order."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    ship(spark)
    dtype = "<u2" if max(library_tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select("doc_id", whole_text().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    n_files = max(1, -(-total // file_bytes))

    def write(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, own, part = library_memory(path, dtype), vocabulary(path), TaskContext.get().partitionId()
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        end, n_documents = np.array([end_id], dtype).tobytes(), 0
        with where.open_output_stream(f"{base}/{name}") as stream, where.open_output_stream(f"{base}/{name}.documents") as index:
            writer, places = TokenWriter(stream, length, dtype), None
            for item in items:
                begins, counts = [], []
                for found in remembered(texts_of(item.column(1)), own, library):
                    ids = b"".join([*found, end])
                    begins.append(writer.n_tokens)
                    writer.append(ids)
                    counts.append(writer.n_tokens - begins[-1])
                listed = pa.RecordBatch.from_arrays([item.column(0), pa.array(begins, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "begin", "n_tokens"])
                places = places or pa.ipc.new_file(index, listed.schema)
                places.write_batch(listed)
                n_documents += len(counts)
            writer.close()
            if places:
                places.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_tokens": [writer.n_tokens], "n_documents": [n_documents]})

    # Bounds of the ranges come from a sample of these columns, so that no text goes to the driver.
    ordered = rows.withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(int(n_files), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of written files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, file, begin."""
    ship(manifest.sparkSession)
    # One row per file.
    based = manifest.filter("n_documents > 0").selectExpr(
        "part", "file", "sum(n_tokens) over (order by part rows between unbounded preceding and current row) - n_tokens as base"
    )
    n_files = max(1, manifest.count())

    def read(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in items:
            for row in item.to_pylist():
                where, place = fs.FileSystem.from_uri(f"{row['file']}.documents")
                with TokenFile(row["file"]) as tokens, where.open_input_file(place) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        found = index.get_batch(i)
                        begin, n = found.column("begin").to_numpy(), found.column("n_tokens").to_numpy()
                        sums = [_crc32(tokens, b, b + k) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [found.column("doc_id"), pa.array(begin + row["base"]), found.column("n_tokens"), pa.array(sums, pa.int64()), pa.array([row["file"]] * len(n)), found.column("begin")],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "begin"],
                        )

    dealt = based.repartitionById(n_files, F.col("part"))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, begin long")


def _crc32(tokens: TokenFile, begin: int, end: int) -> int:
    crc = 0
    for ids in tokens.ids(begin, end):
        crc = zlib.crc32(ids.astype("<u4"), crc)
    return crc


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(documents(spark, sf_dir), new_table_path(spark, "token-files"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
