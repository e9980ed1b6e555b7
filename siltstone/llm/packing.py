"""Packing token sequences by order-preserving dynamic programming.

Documents in ascending doc_id order are one stream of ids. Where to cut it is chosen among the ends of documents and
sentences so that padding plus the penalties of cuts within documents is least. With p the ids before a cut, the least cost
f of a stream up to it is f[j] = penalty[j] + L - p[j] + min(f[i] + p[i]) over the cuts i with p[j] - p[i] <= L, so a
monotone queue of f + p gives each cut in constant time. A sentence longer than STRIDE may be cut every STRIDE ids.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .token_ids import default_vocabulary, encoder

LENGTH = 2048
END_ID = 1
#: In ids of padding: what a cut costs at the end of a sentence, or inside one. The end of a document costs nothing.
SENTENCE_PENALTY, INSIDE_PENALTY, STRIDE = 2.0, 8.0, 32
#: A worker packs so many ids at once; the last sequence of a block is packed again with the next block.
BLOCK_IDS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(ends: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """The chosen ones of ascending candidate cuts (ids before each; the last is the end of the stream), the end included.

    Needs gaps between candidates, and before the first, of at most length.
    """
    p = [0, *ends.tolist()]
    pen = [0.0, *penalties.tolist()]
    f, back = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(p)):
        at = p[j]
        while p[queue[0][1]] < at - length:
            queue.popleft()
        least, i = queue[0]
        # the end's own padding is settled later, by powers of two
        f[j] = cost = pen[j] + length - at + least
        back[j] = i
        key = cost + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = back[j]
    return out[::-1]


def candidates(docs_ends: np.ndarray, sentence_ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cuts and their penalties: ends of documents, of sentences, and every stride ids within longer sentences."""
    soft = np.union1d(docs_ends, sentence_ends)
    before = np.concatenate(([0], soft[:-1]))
    extra = (soft - before - 1) // stride
    inside = np.repeat(before, extra) + stride * (np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    ends = np.concatenate((soft, inside))
    penalties = np.concatenate((np.where(np.isin(soft, docs_ends, assume_unique=True), 0.0, SENTENCE_PENALTY), np.full(len(inside), INSIDE_PENALTY)))
    order = np.argsort(ends, kind="stable")
    return ends[order], penalties[order]


def powers(n: int) -> list[int]:
    """n as descending powers of two."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class _Packer:
    """Packs one ordered stream of documents; only a block of ids and the open sequence are in memory."""

    def __init__(self, first_id: int, ends_sentence: np.ndarray, length: int):
        self.next_id, self.ends_sentence, self.length = first_id, ends_sentence, length
        self.docs: list[list] = []  # doc_id, ids not yet packed, ids packed before, ids in all
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0, len(ids)])
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        stream = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        known = stream < len(self.ends_sentence)
        sentence = np.flatnonzero(self.ends_sentence[np.where(known, stream, 0)] & known) + 1
        cuts = choose_cuts(*candidates(doc_ends, sentence[sentence < len(stream)]), self.length)
        tail = cuts.pop()
        begin = cuts[-1] if cuts else 0
        if last:
            cuts += (begin + np.cumsum(powers(tail - begin))).tolist() if tail - begin < self.length else [tail]
        done = cuts[-1] if cuts else 0
        at = k = 0
        for cut_at in cuts:
            first = at
            while at < cut_at:
                doc = self.docs[k]
                n = min(cut_at, int(doc_ends[k])) - at
                yield doc[0], doc[2], n, zlib.crc32(stream[at : at + n].astype("<u4").tobytes()), doc[3], self.next_id, at - first
                doc[2] += n
                at += n
                if at == doc_ends[k]:
                    k += 1
            self.next_id += 1
        rest = self.docs[k:]
        if rest:
            rest[0][1] = rest[0][1][len(rest[0][1]) - (int(doc_ends[k]) - done) :]
        self.docs, self.held = rest, len(stream) - done


def _sentence_ends(vocabulary: str) -> np.ndarray:
    """Which ids' tokens end a sentence or a line."""
    t = encoder(vocabulary).tokenizer
    n = t.get_vocab_size(with_added_tokens=True)
    return np.array([bool((x := t.id_to_token(i) or "") and (x[-1] in ".!?" or "Ċ" in x)) for i in range(n)])


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece of a document, SCHEMA. Null texts are empty, so their document is its end id alone; each row of docs is
    a document of its own, in order of (doc_id, hash of the text), null doc_id first.

    The texts are shuffled once, by range. A partition packs its own stream: its last sequence is parted into powers of two, which
    need no padding. sequence_id ascends with the stream: the partition times 2**40, plus the sequence there.
    """
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId() << 40, _sentence_ends(vocabulary), length)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        end = np.array([end_id], np.uint32)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    ids = encoder(vocabulary).encode(b.column(1).slice(at, 256).to_pylist())
                    for name, x in zip(b.column(0).slice(at, 256).to_pylist(), ids):
                        yield from packer.add(name, np.concatenate((x, end)))
            yield from packer.pack(last=True)

        held: list[tuple] = []
        for row in rows():
            held.append(row)
            if len(held) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=names)

    return ordered.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
