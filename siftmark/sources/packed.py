"""Packed token files: a 24-byte header, then one chunk of fixed-size numbers."""

from __future__ import annotations

import io
import itertools
import struct
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark import fixed_values as fixed

LAYOUT = "<7sQBQ"  # magic, version, number code, chunk size


def dtype_for(vocab_size: int) -> str:
    return "uint16" if vocab_size < fixed.PACKED_UINT16_VOCAB else "int32"


def dtype_code(name: str) -> int:
    for code, dtype in fixed.PACKED_DTYPES.items():
        if dtype == name:
            return code
    raise ValueError(f"no code for {name}")


def encode_chunk(tokens, dtype: str) -> bytes:
    header = struct.pack(LAYOUT, fixed.PACKED_MAGIC, fixed.PACKED_VERSION, dtype_code(dtype), len(tokens))
    return header + np.asarray(tokens, dtype=np.dtype(dtype).newbyteorder("<")).tobytes()


def decode_chunk(content: bytes) -> np.ndarray:
    magic, version, code, size = struct.unpack_from(LAYOUT, content)
    if magic != fixed.PACKED_MAGIC or version != fixed.PACKED_VERSION:
        raise ValueError("not a packed token file of version 1")
    dtype = np.dtype(fixed.PACKED_DTYPES[code]).newbyteorder("<")
    return np.frombuffer(content, dtype=dtype, count=size, offset=fixed.PACKED_HEADER_BYTES)


def bundle_content(members: list[tuple[str, bytes]]) -> bytes:
    """A tar of packed files, by which many small ones are one in storage."""
    with io.BytesIO() as out:
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as bundle:
            for name, content in members:
                entry = tarfile.TarInfo(name)
                entry.size = len(content)
                bundle.addfile(entry, io.BytesIO(content))
        return out.getvalue()


def bundled_chunks(content: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk_id, tokens) of a tar's packed files."""
    with tarfile.open(fileobj=io.BytesIO(content)) as bundle:
        for entry in bundle:
            yield chunk_of(entry.name), decode_chunk(bundle.extractfile(entry).read())


def chunk_of(name: str) -> int:
    return int(name.rsplit("_", 1)[1].removesuffix(".bin"))


def packed_files(rows: Iterator[tuple[int, np.ndarray]], prefix: str, dtype: str, bundle: int) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the files for (chunk_id, tokens): a file each, or tars of the chunks of ``bundle`` successive ids.

    The rows of a tar must follow each other.
    """
    for number, found in itertools.groupby(rows, lambda r: r[0] // bundle):
        members = [(f"{prefix}_{chunk:010d}.bin", encode_chunk(tokens, dtype)) for chunk, tokens in found]
        if bundle > 1:
            yield f"{prefix}_{number:010d}.tar", bundle_content(members)
        else:
            yield from members


def bundled_together(chunks: DataFrame, bundle: int) -> DataFrame:
    """The rows of each tar in one task, by chunk id."""
    return chunks.repartition(F.floor(F.col("chunk_id") / bundle)).sortWithinPartitions("chunk_id")


def write_packed(chunks: DataFrame, uri: str, prefix: str, dtype: str, bundle: int = 1) -> int:
    """Write ``<prefix>_<chunk_id>.bin`` per (chunk_id, tokens) row; returns the number of chunks.

    With a ``bundle`` of several, the files of so many successive ids are put in
    one tar, so that storage and listing are not dealing with a file per chunk.
    ``uri`` must name storage every executor can reach. A file is written
    under a name of its own try and then moved, so repeated tasks are harmless.
    """

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        system, folder = pyarrow.fs.FileSystem.from_uri(uri)
        system.create_dir(folder, recursive=True)
        chunks = 0

        def rows() -> Iterator[tuple[int, np.ndarray]]:
            nonlocal chunks
            for batch in batches:
                chunks += len(batch)
                yield from zip(batch["chunk_id"], batch["tokens"])

        for name, content in packed_files(rows(), prefix, dtype, bundle):
            attempt = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(attempt) as out:
                out.write(content)
            system.move(attempt, f"{folder}/{name}")
        yield pd.DataFrame({"chunks": [chunks]})

    rows = chunks.select("chunk_id", "tokens")
    written = (bundled_together(rows, bundle) if bundle > 1 else rows).mapInPandas(store, "chunks long")
    return written.agg(F.coalesce(F.sum("chunks"), F.lit(0).cast("long")).alias("n")).head().n


def read_packed(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(chunk_id, tokens) of packed files, also of those in tars, as longs."""

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                found = [*bundled_chunks(data)] if name.endswith(".tar") else [(chunk_of(name), decode_chunk(data))]
                ids, tokens = zip(*found)
                ends = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], names=["chunk_id", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*.{{bin,tar}}").load(path)
    return files.select("path", "content").mapInArrow(chunks_of, "chunk_id long, tokens array<long>")
