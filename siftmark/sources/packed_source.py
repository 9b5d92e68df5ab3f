"""Packed token files as a data source: ``spark.read.format("packed")`` and ``df.write.format("packed")``.

A written set appears whole or not at all: tasks write to a hidden folder beside the
target, which takes the target's name when all have ended, and goes when one fails.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from siftmark import fixed_values as fixed
from siftmark.sources.packed import LAYOUT, bundled_chunks, chunk_of, dtype_for, packed_files

#: A task reads about so many bytes.
SPLIT_BYTES = 16 << 20


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


@dataclass
class Blocks(InputPartition):
    """Some blocks of a file, or of several: (name, first block, blocks); a tar is read whole."""

    files: list[tuple[str, int, int]]


class PackedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.prefix = options["path"], options.get("prefix", "train")
        self.block = int(options.get("blocksize", 1 << 20))
        if self.block < 1:
            raise ValueError("a block has at least one token")

    def partitions(self) -> list[InputPartition]:
        """Files of the set by name; a large one is cut between blocks."""
        system, folder = _place(self.path)
        parts: list[Blocks] = []
        files, size = [], 0
        found = system.get_file_info(pyarrow.fs.FileSelector(folder))
        for info in sorted(found, key=lambda x: x.base_name):
            if not info.base_name.startswith(f"{self.prefix}_") or not info.base_name.endswith((".bin", ".tar")):
                continue
            if info.base_name.endswith(".tar"):
                files.append((info.path, 0, 1))
                size += info.size
                if size >= SPLIT_BYTES:
                    parts.append(Blocks(files))
                    files, size = [], 0
                continue
            step = 2 * self.block  # bytes of a block at least
            blocks = max(1, -(-(info.size - fixed.PACKED_HEADER_BYTES) // step))
            each = max(1, SPLIT_BYTES // step)
            for first in range(0, blocks, each):
                files.append((info.path, first, min(each, blocks - first)))
                size += min(each, blocks - first) * step
                if size >= SPLIT_BYTES:
                    parts.append(Blocks(files))
                    files, size = [], 0
        return [*parts, Blocks(files)] if files or not parts else parts

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        for name, first, blocks in partition.files:
            if name.endswith(".tar"):
                with system.open_input_file(name) as file:
                    yield self.blocks_of([*bundled_chunks(file.read())])
                continue
            with system.open_input_file(name) as file:
                magic, version, code, size = struct.unpack(LAYOUT, file.read(fixed.PACKED_HEADER_BYTES))
                if magic != fixed.PACKED_MAGIC or version != fixed.PACKED_VERSION:
                    raise ValueError(f"{name} is not a packed token file of version 1")
                kind = np.dtype(fixed.PACKED_DTYPES[code]).newbyteorder("<")
                if file.size() < fixed.PACKED_HEADER_BYTES + size * kind.itemsize:
                    raise ValueError(f"{name} ends before its chunk does")
                chunk = chunk_of(name)
                for number in range(first, first + blocks):
                    start = number * self.block
                    count = min(self.block, size - start)
                    if count <= 0 and number:
                        break
                    file.seek(fixed.PACKED_HEADER_BYTES + start * kind.itemsize)
                    values = np.frombuffer(file.read(max(count, 0) * kind.itemsize), kind).astype(np.int64)
                    tokens = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                    columns = [pa.array([chunk], pa.int64()), pa.array([number], pa.int64()), tokens]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "block_no", "tokens"])


    def blocks_of(self, chunks: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        """The blocks of whole chunks; an empty chunk is one empty block."""
        counts = [max(1, -(-len(tokens) // self.block)) for _, tokens in chunks]
        lengths = [min(self.block, len(tokens) - b * self.block) for (_, tokens), n in zip(chunks, counts) for b in range(n)]
        ends = pa.array(np.cumsum([0, *lengths]), pa.int32())
        tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([t for _, t in chunks]).astype(np.int64)))
        ids = pa.array(np.repeat([c for c, _ in chunks], counts), pa.int64())
        numbers = pa.array(np.concatenate([np.arange(n) for n in counts]), pa.int64())
        return pa.RecordBatch.from_arrays([ids, numbers, tokens], names=["chunk_id", "block_no", "tokens"])


@dataclass
class Written(WriterCommitMessage):
    files: int


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.prefix, self.overwrite = options["path"].rstrip("/"), options.get("prefix", "train"), overwrite
        self.dtype = dtype_for(int(options.get("vocabulary", fixed.PACKED_UINT16_VOCAB)))
        self.bundle = int(options.get("bundle", 1))
        if self.bundle < 1:
            raise ValueError("a file has at least one chunk")
        parent, _, name = self.path.rpartition("/")
        self.hidden = f"{parent}/.{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _place(self.hidden)
        system.create_dir(folder, recursive=True)
        attempt, files = TaskContext.get().taskAttemptId(), 0

        def rows() -> Iterator[tuple[int, np.ndarray]]:
            for batch in iterator:
                for chunk, tokens in zip(batch.column("chunk_id"), batch.column("tokens")):
                    yield chunk.as_py(), tokens.values.to_numpy(zero_copy_only=False)

        for name, content in packed_files(rows(), self.prefix, self.dtype, self.bundle):
            with system.open_output_stream(f"{folder}/.{name}.{attempt}") as out:
                out.write(content)
            # a repeated task replaces a file by an equal one
            system.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
            files += 1
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _place(self.path)
        hidden = _place(self.hidden)[1]
        system.create_dir(hidden, recursive=True)  # there may have been no rows
        found = system.get_file_info(pyarrow.fs.FileSelector(hidden))
        files = sum(x.base_name.endswith((".bin", ".tar")) for x in found)
        if files != sum(m.files for m in messages if m):
            self.abort(messages)
            raise ValueError("chunk ids are not unique, or the rows of a tar do not lie together")
        if system.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            system.delete_dir(folder)
        system.move(hidden, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, hidden = _place(self.hidden)
        if system.get_file_info(hidden).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(hidden)


class PackedSource(DataSource):
    """Options: ``path``, ``prefix`` ("train"), when reading ``blockSize`` in tokens, when
    writing ``vocabulary``, which decides the width of a number, and ``bundle``, how many
    successive ids' files become one tar (1: no tars); ``bundled_together`` lays their rows for it.

    Read rows are (chunk_id, block_no, tokens); written ones (chunk_id, tokens), a file for
    each, with unique chunk ids that are not null. A target that is there stops the job unless the mode is
    overwrite or append, which both replace it. The folder must be one that all executors reach.
    """

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return "chunk_id long, block_no long, tokens array<long>"

    def reader(self, schema: T.StructType) -> PackedReader:
        return PackedReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> PackedWriter:
        if not {"chunk_id", "tokens"} <= set(schema.names):
            raise ValueError("rows to pack have chunk_id and tokens")
        return PackedWriter(self.options, overwrite)


def register_packed(spark: SparkSession) -> None:
    spark.dataSource.register(PackedSource)
