"""Token ids in Huffman-coded blocks: canonical, length-limited codes from global counts.

The store at ``path`` has three Parquet tables, written by Spark so that a lost task is simply run again:

* ``codebook``: (id, bits), the code length of every id that occurs; canonical codes follow from the lengths.
* ``blocks``: (part, block, first, n_tokens, data), ``first`` the tokens before the block in its part; ``data`` one
  independent block: the header ``<4sIII`` (magic, documents, tokens, checkpoint spacing), doc_ids as int64, a null flag a
  document, ids a document as uint32, the bit offset of every ``SPACING``-th id as uint32, then the bit stream, most
  significant bit first.
* ``staged``: the encoded ids before coding, one row a document.

Parts hold ascending ranges of doc_id and blocks are ascending inside a part.  A block is decoded from all its
checkpoints at once, with one table lookup an id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored, work_dir
from tidemark.llm.tokens import encoder, vocabulary_path

MAGIC = b"TMH1"
SPACING = 64
BLOCK_TOKENS = 1 << 18
MOST_BITS = 18


def limited_lengths(counts: np.ndarray, most_bits: int) -> np.ndarray:
    """Code lengths of least total size for positive ``counts``, none over ``most_bits`` (package-merge)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.uint8)
    if n > 1 << most_bits:
        raise ValueError("more symbols than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    kinds, packages = [], np.empty(0, np.int64)
    for _ in range(most_bits):
        weight = np.concatenate([leaves, packages])
        by = np.argsort(weight, kind="stable")
        kinds.append(by < n)
        weight = weight[by]
        packages = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(1)
    length, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(kinds):
        own = int(leaf[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.uint8)
    out[order] = length
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, code): ids by (length, id) take consecutive codes, shifted left where the length grows."""
    order = np.lexsort((ids, bits))
    long = bits[order].astype(np.int64)
    # The first code of each entry, aligned to the longest length, is the sum of the space taken before it.
    top = int(long.max())
    space = np.left_shift(np.int64(1), top - long)
    return order, (np.cumsum(space) - space) >> (top - long)


class Codes:
    """Arrays for coding and decoding, made from (id, bits)."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order, code = canonical(ids, bits)
        self.top = int(bits.max())
        size = int(ids.max()) + 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids[order]], self.bits[ids[order]] = code, bits[order]
        repeat = np.left_shift(1, self.top - bits[order].astype(np.int64))
        fill = (1 << self.top) - int(repeat.sum())  # only a code of one symbol leaves codes unused
        self.symbol = np.concatenate([np.repeat(ids[order], repeat), np.zeros(fill, ids.dtype)]).astype(np.uint32)
        self.step = np.concatenate([np.repeat(bits[order], repeat), np.ones(fill, bits.dtype)]).astype(np.int64)

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(bit offset of every SPACING-th id, stream)."""
        bits = self.bits[ids]
        end = np.cumsum(bits)
        at = end - bits
        words = np.zeros(int(end[-1] + 95) // 32 + 1, np.uint64)
        both = self.code[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        spot = word[first]
        words[spot] += np.add.reduceat(both >> np.uint64(32), first)  # bits of one word do not overlap: sums are unions
        words[spot + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
        return at[::SPACING].astype("<u4"), words.astype(">u4").tobytes()

    def unpack(self, checkpoints: np.ndarray, stream: bytes, n: int, spacing: int) -> np.ndarray:
        raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
        peek = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((len(at), spacing), np.uint32)
        mask, last = (1 << self.top) - 1, len(peek) - 1
        for i in range(spacing):
            key = (peek[np.minimum(at >> 3, last)] >> (32 - self.top - (at & 7)).astype(np.uint32)) & mask
            out[:, i] = self.symbol[key]
            at += self.step[key]
        return out.reshape(-1)[:n]


def write_block(codes: Codes, doc_ids: list[int | None], parts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(parts)
    checkpoints, stream = codes.pack(ids)
    head = struct.pack("<4sIII", MAGIC, len(doc_ids), len(ids), SPACING)
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return head + keys + np.array([len(p) for p in parts], "<u4").tobytes() + checkpoints.tobytes() + stream


def read_block(codes: Codes, data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, docs, tokens, spacing = struct.unpack_from("<4sIII", data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at, marks = 16, -(-tokens // spacing)
    keys = np.frombuffer(data, "<i8", docs, at).tolist()
    null = data[at + 8 * docs : at + 9 * docs]
    at += 9 * docs
    sizes = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    ids = codes.unpack(np.frombuffer(data, "<u4", marks, at), data[at + 4 * marks :], tokens, spacing)
    return [None if z else k for k, z in zip(keys, null, strict=True)], np.split(ids, np.cumsum(sizes)[:-1])


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids): packed ids of every text with ``end_id`` appended; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        end = np.array([end_id], e.kind).tobytes()
        for batch in batches:
            for part in slices(batch):
                ids = [x + end for x in e.encode(part["text"].to_pylist())]
                yield pa.record_batch([part["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def _counts(staged: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch):
                n = np.bincount(np.frombuffer(b"".join(part["ids"].to_pylist()), kind))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    return staged.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, most_bits: int = MOST_BITS) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write the store at ``path``.

    The codebook has at most one row an entry of the vocabulary, so it is collected and sent to the tasks whatever the
    corpus size.  Repeated rows are stored each; rows without doc_id come first.  An empty table writes empty tables.
    """
    vocabulary = vocabulary or vocabulary_path()
    kind = encoder(vocabulary).kind.str
    spark = docs.sparkSession
    staged = stored(encoded(docs, vocabulary, end_id), f"{path}/staged")
    rows = _counts(staged, kind).toArrow()
    ids, counts = rows["id"].to_numpy(), rows["n"].to_numpy()
    by = np.argsort(ids)
    ids, counts = ids[by], counts[by]
    bits = limited_lengths(counts, max(most_bits, int(len(ids)).bit_length())) if len(ids) else np.zeros(0, np.uint8)
    book = pa.table({"id": pa.array(ids, pa.int32()), "bits": pa.array(bits.astype(np.int32), pa.int32())})
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = (Codes(ids, bits) if len(ids) else None), TaskContext.get().partitionId()
        keys, parts, held, first, block = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = write_block(codes, keys, parts)
            cols = [[part], [block], [first], [held], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "block", "first", "n_tokens", "data"])

        for batch in batches:
            for key, x in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                now = np.frombuffer(x, kind)
                if keys and held + len(now) > BLOCK_TOKENS:
                    yield flush()
                    first, block, keys, parts, held = first + held, block + 1, [], [], 0
                keys.append(key)
                parts.append(now)
                held += len(now)
        if keys:
            yield flush()

    ordered = staged.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, "part int, block int, first long, n_tokens long, data binary").write.mode("overwrite").parquet(f"{path}/blocks")


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Every stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (uint32 packed).

    ``with_ids`` False leaves ``ids`` null, for those who need the figures alone.
    """
    book = spark.read.schema("id int, bits int").parquet(f"{path}/codebook").toArrow()
    ids, bits = book["id"].to_numpy(), book["bits"].to_numpy()
    blocks = spark.read.schema("part int, block int, first long, n_tokens long, data binary").parquet(f"{path}/blocks")
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row a part
    before, total = {}, 0
    for part in sorted(totals):
        before[part], total = total, total + totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(ids, bits) if len(ids) else None
        for batch in batches:
            for part, first, data in zip(batch["part"].to_pylist(), batch["first"].to_pylist(), batch["data"].to_pylist(), strict=True):
                keys, found = read_block(codes, data)
                sizes = np.array([len(x) for x in found], np.int64)
                start = before[part] + first + np.cumsum(sizes) - sizes
                packed = [x.tobytes() for x in found]
                sums = pa.array(map(zlib.crc32, packed), pa.int64())
                yield pa.record_batch(
                    [pa.array(keys, pa.int64()), pa.array(start), pa.array(sizes), sums, pa.array(packed if with_ids else [None] * len(keys), pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.select("part", "first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_store(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Write ``docs`` to a store in the shared folder and read it back."""
    path = work_dir(docs.sparkSession) + "/tokens"
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path, with_ids)
