"""Token ids of a corpus as binary shard files with a shared compression dictionary.

A shard holds documents in ascending order of their id.  Layout of a file::

    4 bytes "TLZ1" | 1 byte: bytes per id (2 or 4) | 32 bytes: SHA-256 of the dictionary
    one zstandard frame per document
    Arrow IPC table: doc_id, n_tokens, offset, length of each frame
    8 bytes: length of that table, little-endian | 4 bytes "TLZ1"

The dictionary is trained on serialized id arrays of a bounded sample, so that a short document compresses well by itself
and can be read alone through the index: :func:`document_ids` fetches one frame.  Files are written under a new name
by each attempt of a task and count only once the task's row in the manifest is committed, so a lost executor leaves at most an
unused file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklume.llm.text import blocks
from tracklume.llm.tokens import encoder, finished
from tracklume.sources.tables import new_location

MAGIC = b"TLZ1"
HEADER = len(MAGIC) + 1 + 32
INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
ROWS_PER_BATCH = 256


@dataclass(frozen=True)
class TokenFiles:
    """A written set of shards: the manifest (shard, path, n_docs, n_tokens, bytes) and the dictionary."""

    folder: str
    manifest: DataFrame
    dictionary: bytes


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    if not dictionary:
        return zstandard.ZstdDecompressor()
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def train_dictionary(docs: DataFrame, tokenizer: str, sample: int = 1000, size: int = 1 << 16, most_chars: int = 20_000) -> bytes:
    """Dictionary from the id arrays of about ``sample`` documents, chosen by a hash of the id.

    Only documents of at most ``most_chars`` characters are chosen, so the sample that reaches the driver is bounded by
    ``2 * sample * most_chars`` characters.  It serves compression alone; every document is stored whole.  Too few samples give an
    empty dictionary, and frames are then compressed without one.
    """
    spark = docs.sparkSession
    short = docs.where(F.length("text").between(1, most_chars)).select("doc_id", "text")
    n = docs.count()
    share = min(1.0, 1.5 * sample / max(1, n))
    picked = short.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for block in blocks(batch, "text"):
                found, counts = encode.encode(block.column("text"))
                kind = "<u2" if encode.narrow else "<u4"
                parts = np.split(found.astype(kind), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in picked.mapInArrow(ids, "ids binary").collect()]
    size = min(size, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, sorted(samples)).as_bytes()
    except zstandard.ZstdError:  # samples without anything in common
        return b""


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shards: int | None = None, level: int = 3
) -> TokenFiles:
    """Encode ``text`` of every document, append ``end_id``, and write the ids as shard files in ascending ``doc_id``.

    Null text is empty (one id, the end).  Rows whose ``doc_id`` is null come first; repeated ids stay, next to each other in
    an order of their own; other columns are not read.  An empty table gives no shard.  Shards are ranges of ``doc_id``
    between quantiles, so they hold about the same number of documents, and documents reach their shard
    as compressed frames: text is read once and never shuffled.
    """
    spark = docs.sparkSession
    folder = folder or new_location(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dictionary = train_dictionary(docs, tokenizer)
    steps = [i / shards for i in range(1, shards)]
    lowest = np.iinfo(np.int64).min
    known = F.coalesce("doc_id", F.lit(int(lowest)))  # null first
    found = docs.agg(F.percentile_approx(known, steps, 20 * shards).alias("at")).first().at if steps else []
    borders = np.asarray(found or [], np.int64)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = encoder(tokenizer), _compressor(dictionary, level)
        kind = "<u2" if encode.narrow and end_id < 1 << 16 else "<u4"
        turn = 0
        for batch in batches:
            for block in blocks(batch, "text"):
                ids, counts = encode.encode(block.column("text"))
                parts = np.split(ids.astype(kind), np.cumsum(counts)[:-1])
                end = np.asarray([end_id], kind).tobytes()
                packed = [pack.compress(p.tobytes() + end) for p in parts]
                key = block.column("doc_id")
                value = key.fill_null(lowest).to_numpy()
                shard, most = np.searchsorted(borders, value, side="left"), np.searchsorted(borders, value, side="right")
                # an id that is several borders at once has rows enough for several shards: dealt in turn
                shard = shard + (turn + np.arange(len(value))) % np.where(most - shard > 1, most - shard, 1)
                turn += len(value)
                columns = [pa.array(shard, pa.int32()), key, pa.array(counts + 1, pa.int64()), pa.array([int(kind[-1])] * len(parts), pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "n_tokens", "width", "frame"])
        del encode
        finished()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        width, shard, at, index = 4, 0, HEADER, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                width, shard = batch.column("width")[0].as_py(), batch.column("shard")[0].as_py()
                path = f"{folder}/shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                system, place = _filesystem(path)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
                out.write(MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest())
            sizes = []
            for frame in batch.column("frame"):
                out.write(frame.as_buffer())
                sizes.append(len(frame.as_buffer()))
            ends = at + np.cumsum(sizes)
            index.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(ends - sizes), pa.array(sizes, pa.int64())], schema=INDEX))
            at = int(ends[-1])
        if out is None:
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, INDEX) as writer:
            for part in index:
                writer.write_batch(part)
        table = sink.getvalue()
        out.write(table)
        out.write(struct.pack("<Q", len(table)) + MAGIC)
        out.close()
        n_docs, n_tokens = sum(b.num_rows for b in index), sum(int(b.column("n_tokens").to_numpy().sum()) for b in index)
        row = {"shard": [shard], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens], "bytes": [at + len(table) + 12]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())]))

    written = (
        docs.mapInArrow(frames, "shard int, doc_id long, n_tokens long, width int, frame binary")
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first())
        .mapInArrow(write, "shard int, path string, n_docs long, n_tokens long, bytes long")
    )
    place = f"{folder}/manifest"
    written.write.parquet(place)
    return TokenFiles(folder, spark.read.schema(written.schema).parquet(place), dictionary)


def _open(path: str, dictionary: bytes):
    system, place = _filesystem(path)
    file = system.open_input_file(place)
    head = file.read_at(HEADER, 0)
    if head[:4] != MAGIC or head[5:] != hashlib.sha256(dictionary).digest():
        raise ValueError(f"{path} is no shard of this dictionary")
    size = file.size()
    (length,) = struct.unpack("<Q", file.read_at(8, size - 12))
    table = pa.ipc.open_stream(file.read_at(length, size - 12 - length)).read_all()
    return file, head[4], table


def document_ids(path: str, doc_id: int, dictionary: bytes) -> np.ndarray | None:
    """Ids of one document of a shard, read through the index without the rest of the file."""
    file, width, table = _open(path, dictionary)
    keys = table.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
    at = int(np.searchsorted(keys, doc_id))
    if at == len(keys) or keys[at] != doc_id:
        return None
    frame = file.read_at(table.column("length")[at].as_py(), table.column("offset")[at].as_py())
    return np.frombuffer(_decompressor(dictionary).decompress(frame), f"<u{width}").astype(np.uint32)


def read_token_files(files: TokenFiles) -> DataFrame:
    """Documents of all shards: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (uint32 bytes).

    The running total over shards is over the manifest, which has a row per file.
    """
    spark, dictionary = files.manifest.sparkSession, files.dictionary
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.manifest.withColumn("base", F.coalesce(before, F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _decompressor(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                file, width, table = _open(row["path"], dictionary)
                base = row["base"]
                for part in table.combine_chunks().to_batches(ROWS_PER_BATCH):
                    counts = part.column("n_tokens").to_numpy()
                    places, sizes = part.column("offset").to_numpy(), part.column("length").to_numpy()
                    raw = file.read_at(int(places[-1] + sizes[-1] - places[0]), int(places[0]))
                    ids = [
                        np.frombuffer(unpack.decompress(raw[a - places[0] : a - places[0] + n]), f"<u{width}").astype("<u4").tobytes()
                        for a, n in zip(places, sizes, strict=True)
                    ]
                    starts = base + np.cumsum(counts) - counts
                    base += int(counts.sum())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return listed.select("path", "base", "shard").repartitionById(shards, F.pmod(F.col("shard"), F.lit(shards))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


