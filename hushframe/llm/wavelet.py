"""Token-id files as wavelet matrices: one succinct, compressed file per shard of documents.

Documents are range-partitioned by doc_id, tokenized in that order and written as
shards.  A shard holds one bit-plane per id bit with a rank directory, the ids and
lengths of its documents, and answers token access, counting and occurrence lookup
without being unpacked.

Defined cases: a null text is empty and yields its end id alone; a null doc_id comes
first; repeated rows are written as often as they occur; an empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.common import bounded_batches
from hushframe.llm.tokens import default_tokenizer, encoder
from hushframe.session import ensure_checkpoint_dir

END = 2
# Tokens after which a shard is closed; a document is never cut, so one may exceed it.
SHARD_TOKENS = 2 << 20
SHARDS = "part int, shard int, n_tokens long, bits int, zeros array<long>, planes binary, ranks binary, doc_ids array<long>, lengths array<long>"
# Rows of one doc_id beyond which they are spread over several ranges.
REPEATED = 1_000
# Bits between two entries of the rank directory.
BLOCK = 512


class WaveletMatrix:
    """Bit-planes of one shard, highest bit first; each plane lists the zeros of the one above first."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: bytes, ranks: bytes):
        self.n, self.bits, self.zeros = n, bits, list(zeros)
        width, entries = -(-n // 8), n // BLOCK + 1
        self.planes = np.frombuffer(planes, np.uint8).reshape(bits, width)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(bits, entries)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        """``ids`` as unsigned integers below 2**bits."""
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        padded = np.zeros((len(now) // BLOCK + 1) * BLOCK // 8, np.uint8)
        for bit in range(bits - 1, -1, -1):
            mask = (now & now.dtype.type(1 << bit)) != 0
            packed = np.packbits(mask)
            padded[:len(packed)] = packed
            # eight bytes are counted at once
            per_block = np.bitwise_count(padded.view(np.uint64).reshape(-1, BLOCK // 64)).sum(1, dtype=np.uint32)
            planes.append(packed)
            ranks.append(np.concatenate(([0], np.cumsum(per_block)[:-1])).astype("<u4"))
            if bit:
                # zeros first, either part in its order
                low, high = np.compress(~mask, now), np.compress(mask, now)
                zeros.append(len(low))
                now = np.concatenate((low, high))
            else:
                zeros.append(len(now) - int(np.count_nonzero(mask)))
        return cls(len(ids), bits, zeros, b"".join(p.tobytes() for p in planes), b"".join(r.tobytes() for r in ranks))

    def _ones(self, plane: int, i: int) -> int:
        """Ones of the plane before position ``i``."""
        block = i // BLOCK
        bits = self.planes[plane, block * BLOCK // 8:-(-i // 8)]
        count = int(self.ranks[plane, block]) + int(np.bitwise_count(bits).sum())
        spare = -i % 8
        return count - (int(bits[-1] & ((1 << spare) - 1)).bit_count() if spare and len(bits) else 0)

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane, i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        out = 0
        for plane in range(self.bits):
            bit = self._bit(plane, i)
            ones = self._ones(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._ones(plane, low), self._ones(plane, high)
            if token >> (self.bits - 1 - plane) & 1:
                low, high = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, i: int | None = None) -> int:
        """Occurrences of ``token`` before position ``i``."""
        low, high = self._range(token, self.n if i is None else i)
        return high - low

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of the plane: its block by the directory, then inside the block."""
        before = self.ranks[plane].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[plane, block * BLOCK // 8:(block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before[block]])

    def positions(self, token: int) -> np.ndarray:
        """Positions of all occurrences of ``token``, in order: one pass over every plane."""
        low, high = self._range(token, self.n)
        at = np.arange(low, high)
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            if not len(at):
                break
            places = np.flatnonzero(np.unpackbits(self.planes[plane], count=self.n) == bit)
            at = places[at - (self.zeros[plane] if bit else 0)]
        return at

    def find(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[plane], count=self.n).view(bool)
            low, high = now[:self.zeros[plane]], now[self.zeros[plane]:]
            back = np.empty_like(now)
            # by places: several times faster than by mask
            back[np.flatnonzero(~ones)] = low
            back[np.flatnonzero(ones)] = high | now.dtype.type(1 << (self.bits - 1 - plane))
            now = back
        return now


def write_shards(documents: DataFrame, path: str, end: int = END, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes shard files in ascending doc_id order, one shard per file."""
    bounded_batches(documents)
    source = tokenizer or default_tokenizer()

    def shards(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, shard = TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u4").tobytes()
        bits = max(encoder(source, added=True).ids - 1, end).bit_length()
        docs: list = []
        raws: list[bytes] = []
        size = 0

        def image():
            ids = np.frombuffer(b"".join(raws), "<u4")
            m = WaveletMatrix.build(ids, bits)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            row = (part, shard, len(ids), bits, m.zeros, m.planes.tobytes(), m.ranks.tobytes(), docs, [len(r) // 4 for r in raws])
            names = [f.split()[0] for f in SHARDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                for doc, raw in zip(few.column(0).to_pylist(), encoder(source, added=True).encode(few.column(1).to_pylist())):
                    docs.append(doc)
                    raws.append(raw + tail)
                    size += len(raw) // 4 + 1
                    if size >= shard_tokens:
                        yield image()
                        shard, size = shard + 1, 0
                        docs.clear()
                        raws.clear()
        if docs:
            yield image()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    # ranges are cut by the id alone, without reading a text, unless one id has very many rows
    most = documents.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    ordered = rows.repartitionByRange(*(order if most > REPEATED else ["doc_id"])).sortWithinPartitions(*order)
    ordered.mapInArrow(shards, SHARDS).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """First token position of every shard: sums per part, then inside each part."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (
        shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_inside"))
        .join(firsts, "part")
        .select("part", "shard", (F.col("_first") + F.col("_inside")).alias("shard_start"))
    )


def token_positions(shards: DataFrame, token: int) -> DataFrame:
    """Every occurrence of ``token`` as (part, shard, position in the shard), from the files alone.

    A token beyond the vocabulary occurs nowhere; no shard gives no row.
    """

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                m = WaveletMatrix(row["n_tokens"], row["bits"], row["zeros"], row["planes"], row["ranks"])
                found = m.positions(token)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(found, pa.int64())],
                    ["part", "shard", "position"],
                )

    return shards.mapInArrow(look, "part int, shard int, position long")


def read_documents(shards: DataFrame, ids: bool = True) -> DataFrame:
    """Decodes every shard: part, shard, doc_id, first (position in the shard), n_tokens, ids_crc32 and ``ids``.

    The ids are little-endian unsigned 32-bit integers, and the checksum is theirs;
    without ``ids`` it is all that leaves the task.
    """
    names = ["part", "shard", "doc_id", "first", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                part, shard, n, bits = (one[c].as_py() for c in ("part", "shard", "n_tokens", "bits"))
                m = WaveletMatrix(n, bits, one["zeros"].as_py(), one["planes"].as_buffer(), one["ranks"].as_buffer())
                raw = memoryview(m.decode().astype("<u4")).cast("B")
                doc_ids, lengths = one["doc_ids"].values, one["lengths"].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                for at in range(0, len(ends), 512):
                    a, b = starts[at:at + 512], ends[at:at + 512]
                    spans = list(zip((4 * a).tolist(), (4 * b).tolist()))
                    columns = [
                        pa.array(np.full(len(a), part, np.int32)), pa.array(np.full(len(a), shard, np.int32)), doc_ids.slice(at, 512), pa.array(a), pa.array(b - a),
                        pa.array([zlib.crc32(raw[x:y]) for x, y in spans], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([bytes(raw[x:y]) for x, y in spans], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "part int, shard int, doc_id long, first long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    return shards.mapInArrow(decode, schema)


def document_tokens(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the shard files, reads them back and returns one row per document."""
    spark = documents.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wavelet-{uuid.uuid4().hex}"
    write_shards(documents, path, tokenizer=tokenizer)
    shards = read_shards(spark, path)
    return read_documents(shards, ids=False).join(shard_starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
