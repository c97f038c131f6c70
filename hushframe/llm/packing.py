"""Packing into fixed-length sequences, shortest pack first over the length histogram.

Documents are tokenized once and cut into full pieces and one remainder.  Only the
histogram of piece lengths (at most ``size`` numbers) reaches the driver; there the
lengths are placed longest first into the pack with most room, as counts of packing
patterns.  Pieces find their place by their rank among the pieces of their length.

Defined cases: a null text is empty and yields its end token alone; repeated rows are
packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import bounded_batches, release_memory
from hushframe.llm.tokens import default_tokenizer, encoder
from hushframe.session import ensure_checkpoint_dir

SIZE = 1024
END = 0
PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long, split int, place long"


def pack_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with their counts.

    ``room`` keeps, per free space, the open patterns and how many packs follow each.
    The shortest pack, the one with most room, is filled first; a pack takes several
    pieces of one length where there are more pieces than packs.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, group in room.items() if group and s >= length), default=None)
            if space is None:
                # new packs take as many pieces of this length as fit, when there are that many
                pieces = min(size // length, left)
                pattern, packs, space = (), left // pieces, size
            else:
                pattern, packs = room[space].pop()
                pieces = min(space // length, -(-left // packs))
                used = min(packs, left // pieces)
                if packs > used:
                    room[space].append((pattern, packs - used))
                packs = used
            room.setdefault(space - pieces * length, []).append((pattern + (length,) * pieces, packs))
            left -= pieces * packs
    return [(pattern, count) for group in room.values() for pattern, count in group]


def _ranges(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset) per slot of each pattern."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in sorted(patterns, key=lambda p: (p[0], p[1]), reverse=True):
        offset = 0
        for length in pattern:
            first = ranks.get(length, 0)
            out.append((length, first, first + count - 1, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return out


def cut_pieces(documents: DataFrame, size: int = SIZE, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """Token pieces of every document, staged once in the shared folder.

    ``split`` and ``place`` number the pieces of one length as their task met them.
    """
    bounded_batches(documents)
    path = tokenizer or default_tokenizer()

    def pieces(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not encoder.cache_info().currsize:
            release_memory()
        met: dict[int, int] = {}
        split = TaskContext.get().partitionId()
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, raw in zip(part.column(0).to_pylist(), encoder(path, added=True).encode(part.column(1).to_pylist())):
                    raw += tail
                    total = len(raw) // 4
                    for start in range(0, total, size):
                        length = min(size, total - start)
                        place = met.get(length, 0)
                        met[length] = place + 1
                        rows.append((doc, start, length, raw[4 * start:4 * (start + length)], total, split, place))
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "split", "place"],
                )

    spark = documents.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pieces-{_unique()}"
    cut = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)
    cut.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(cut.schema).parquet(folder)


def _unique() -> str:
    import uuid

    return uuid.uuid4().hex


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to staged pieces; other columns are carried along.

    The table of slots has a few ranges per length and pattern, however many pieces
    there are, so it is broadcast.  Repeated rows are pieces of their own; no piece gives
    no row.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "split").agg(F.count("*").alias("_n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = spark.createDataFrame(
        _ranges(pack_patterns(histogram, size)), "_length int, _first long, _last long, _sequence long, offset long"
    )
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(firsts, ["length", "split"]).withColumn("_rank", F.col("_before") + F.col("place"))
    inside = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    return (
        ranked.join(F.broadcast(slots), inside)
        .withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_first"))
        .drop("split", "place", "_before", "_rank", "_length", "_first", "_last", "_sequence")
    )


def sequences(packed: DataFrame, size: int = SIZE, pad: int = END) -> DataFrame:
    """The training rows: sequence_id, ids (little-endian, padded) and the real token count.

    A total that is a power of two is left as it is, any other is padded to ``size``; no
    piece gives no sequence.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    hexes = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    tokens = F.aggregate("parts", F.lit(0), lambda n, p: n + p["length"])
    padding = F.lit(f"{pad:08X}" if pad == 0 else pad.to_bytes(4, "little").hex())
    whole = F.bit_count(tokens) == 1
    return rows.select("sequence_id", tokens.alias("tokens"), F.unhex(F.when(whole, hexes).otherwise(F.concat(hexes, F.repeat(padding, F.lit(size) - tokens)))).alias("ids"))


def document_pieces(documents: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """One row per piece with its place in the sequences; checksums come from the staged ids."""
    pieces = cut_pieces(documents, size, tokenizer=tokenizer).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "split", "place"
    )
    return pack(pieces, size).select(
        "doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
