"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A shard holds the documents of one range of ascending doc_id. Its bytes, all little-endian:

    magic "STID1\\n", then 4 unsigned 64-bit integers: documents, tokens, ranked ids, bytes of data
    for each document: signed 64-bit doc_id, unsigned 32-bit tokens; then ceil(documents / 8) bytes of bits that are 1 where doc_id is null
    the ranked ids, unsigned 32-bit, most frequent in the shard first: rank r stands for the r-th
    ceil(tokens / 4) control bytes: 2 bits a token, lowest first, its number of data bytes less one
    the ranks' data bytes, low byte first

Ranks are counted over all tokens of the shard, so a shard can be read alone and added without ranking a corpus anew; the
256 most frequent take one byte. Reading looks four lengths at a time up in a table of 256 control bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch, table
from .token_ids import default_vocabulary, encoder

MAGIC = b"STID1\n"
END_ID = 2
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    n = len(ranks)
    lengths = np.ones(n, np.uint8)
    for bits in (8, 16, 24):
        lengths += ranks >= 1 << bits
    code = np.zeros(-(-n // 4) * 4, np.uint8)
    code[:n] = lengths - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    width = 2 if n and lengths.max() <= 2 else 4
    each = ranks.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    return control.astype(np.uint8).tobytes(), each[np.arange(width) < lengths[:, None]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = _LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def shard_bytes(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    counts = np.bincount(ids)
    ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank_of = np.zeros(max(len(counts), 1), np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    # a block at a time: the spread-out bytes of all ranks at once would take four times the shard
    step = 1 << 20
    packed = [pack_ranks(rank_of[ids[i : i + step]]) for i in range(0, len(ids), step)]
    data = b"".join(d for _, d in packed)
    index = np.zeros(len(docs), np.dtype([("doc_id", "<i8"), ("n", "<u4")]))
    index["doc_id"], index["n"] = [d or 0 for d in doc_ids], [len(d) for d in docs]
    head = np.array([len(docs), len(ids), len(ranked), len(data)], "<u8")
    return b"".join([MAGIC, head.tobytes(), index.tobytes(), np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes(), ranked.tobytes(), *(c for c, _ in packed), data])


def read_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, the documents' numbers of tokens, all ids."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id shard")
    at = len(MAGIC)
    n_docs, n, n_ranked, n_data = map(int, np.frombuffer(raw, "<u8", 4, at))
    at += 32
    index = np.frombuffer(raw, np.dtype([("doc_id", "<i8"), ("n", "<u4")]), n_docs, at)
    at += 12 * n_docs
    null = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n_docs // 8), at), count=n_docs).astype(bool)
    at += -(-n_docs // 8)
    ranked = np.frombuffer(raw, "<u4", n_ranked, at)
    at += 4 * n_ranked
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    at += -(-n // 4)
    data = np.frombuffer(raw, np.uint8, n_data, at)
    ids = ranked[unpack_ranks(control, data, n)] if n else np.zeros(0, np.uint32)
    return [None if x else int(d) for d, x in zip(index["doc_id"], null)], index["n"].astype(np.int64), ids


def _write_file(path: str, raw: bytes) -> None:
    """Written beside its place and then moved there, so that a lost or repeated task leaves no half of a file."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    part = f"{name.rpartition('/')[0]}/_part-{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        out.write(raw)
    if where.get_file_info(name).type != fs.FileType.NotFound:
        where.delete_file(name)  # of an attempt that was lost after its move
    where.move(part, name)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs as shards under path, a folder all executors share, in ascending doc_id order (nulls first).

    Returns a row a shard: shard, n_docs, n_tokens, start (the ids of all shards before it), file. The texts are shuffled
    once, by range; a shard is one partition, which adaptive execution sizes.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names = [], []
        end = np.array([end_id], np.uint32)
        for b in batches:
            names += b.column(0).to_pylist()
            for at in range(0, b.num_rows, 256):  # so many texts at once as Python strings
                small = np.uint16 if end_id < 65536 else np.uint32
                for x in encoder(vocabulary).encode(b.column(1).slice(at, 256).to_pylist()):
                    full = np.concatenate((x, end))
                    ids.append(full.astype(small) if not len(full) or full.max() < 65536 else full)
        if names:
            shard = TaskContext.get().partitionId()
            file = f"{path}/shard-{shard:08d}.stid"
            _write_file(file, shard_bytes(names, ids))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([sum(map(len, ids))], pa.int64()), "file": [file]})

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    shards = cut(ordered.mapInArrow(encode, "shard long, n_docs long, n_tokens long, file string"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read(shards: DataFrame, path: str) -> DataFrame:
    """Reads the shards under path: doc_id, start, n_tokens, ids_crc32 for each document."""
    spark = shards.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.stid").load(path)
    named = files.select(F.regexp_extract("path", r"shard-(\d+)\.stid$", 1).cast("long").alias("shard"), "content")
    placed = named.join(shards.select("shard", "start"), "shard").select("start", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, raw in zip(b.column(0).to_pylist(), b.column(1)):
                doc_ids, lengths, ids = read_shard(raw.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    shards = write(table(spark, sf_dir, "documents"), path, default_vocabulary())
    return read(shards, path)
