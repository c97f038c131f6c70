"""Phrase collocations by Rabin-Karp fingerprints of word n-grams.

A task cuts its texts into words, block by block, and hashes every n-gram of a block by
differences of one prefix polynomial over the words' hashes (modulo 2**64).  A block
sends one row per distinct n-gram: fingerprint, count and a pointer (row of the
document, word in it) to one occurrence.  Counts are summed by fingerprint; the
pointers of frequent fingerprints alone are followed back to their texts, and the final
counts are per phrase text, so that fingerprints that collide are told apart.  Rows of
three words are sent only where both pairs inside are frequent: the frequent pairs'
fingerprints set bits in a table of fixed size, in which a wrong hit costs a row but
changes no count.

Defined cases: a null or blank text has no word; a null language is ``und``; a null
doc_id and repeated rows count like any other document; text is split at separators as
long as they come, and phrases never cross one; an empty table gives an empty result;
columns beside text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import fresh, with_place
from hushframe.session import stage

LEAST = 10
LONGEST = 3
TOP = 2_000
# Words (and separators) that are counted together in memory.
BLOCK = 2_000_000
# Bytes after which a text is cut at its next separator.
SEGMENT = 4 << 20
# Bits of the table of frequent pairs, and of a chunk of it.
TABLE_BITS, CHUNK_BITS = 26, 16
# spot: word of the document times SPOTS, plus the number of words
ROWS = "fp long, f int, row long, spot long"
SPOTS = 16
# A separator between pieces is this token; no word contains it.
CUT = b"."
# Fixed by the contract: the separators, and the two spaces between words.
_TABLE = bytes(CUT[0] if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
# An odd base of the polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def segments(text: str | None, size: int = SEGMENT) -> Iterator[list[bytes]]:
    """Words and separators of a whole text, cut after separators into lists of bounded size."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(CUT, at + size) + 1 or len(raw)
        yield raw[at:end].replace(CUT, b" . ").split()
        at = end


class _Words(dict):
    """Numbers of the words of a block in the order they come; the separator is 0."""

    def __init__(self):
        self[CUT] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """Numbered words of documents in one language."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.starts: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, row: int, at: int, numbers: np.ndarray) -> None:
        """Words of document ``row`` from its word ``at`` on, closed by a separator."""
        self.starts.append((self.size, row, at))
        self.parts += [numbers, np.zeros(1, np.int64)]
        self.size += len(numbers) + 1

    def grams(self, hashes: np.ndarray, sizes: tuple[int, ...], bits: int, pairs: np.ndarray | None, pair: np.uint64):
        """(n, fingerprints, counts, rows, word indexes): one entry per distinct n-gram.

        ``pair`` is what the keys of pairs are mixed with in the table ``pairs``.
        """
        ids = np.concatenate(self.parts)
        power = np.full(len(ids), BASE, np.uint64)
        power[0] = 1
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[ids] * np.cumprod(power, dtype=np.uint64), dtype=np.uint64)))
        power[1:] = INVERSE
        back = np.cumprod(power, dtype=np.uint64)
        word = ids > 0
        first, rows, ats = np.array(self.starts, np.int64).T
        for n in sizes:
            last = len(ids) - n + 1
            if last < 1:
                continue
            whole = word[:last].copy()
            for k in range(1, n):
                whole &= word[k:k + last]
            if pairs is not None and n > 2:
                two = self._prints(prefix, back, 2, bits) ^ pair
                often = (pairs[(two & np.uint64(len(pairs) * 8 - 1)) >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                for k in range(n - 1):
                    whole &= often[k:k + last]
            where = np.nonzero(whole)[0]
            key = ids[where]
            for k in range(1, n):
                key = key * len(hashes) + ids[where + k]
            _, at, count = np.unique(key, return_index=True, return_counts=True)
            at = where[at]
            doc = np.searchsorted(first, at, "right") - 1
            yield n, self._prints(prefix, back, n, bits)[at].view(np.int64), count, rows[doc], ats[doc] + at - first[doc]

    @staticmethod
    def _prints(prefix: np.ndarray, back: np.ndarray, n: int, bits: int) -> np.ndarray:
        last = len(back) - n + 1
        fp = (prefix[n:] - prefix[:-n]) * back[:last]
        # low bits of a product know only low bits: fold the high ones in
        fp ^= fp >> np.uint64(32)
        return fp & np.uint64((1 << bits) - 1)


def gram_rows(docs: DataFrame, sizes: tuple[int, ...], bits: int = 64, pairs=None, block: int = BLOCK) -> DataFrame:
    """One row per block and distinct n-gram of ``docs`` (row, lang, text); one of no word counts all words."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        table = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        words, blocks, size = _Words(), {}, 0

        def flush():
            hashes = np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))
            for lang, b in blocks.items():
                total = sum(int((p > 0).sum()) for p in b.parts)
                if 1 in sizes and total:
                    yield rows(lang, 0, np.zeros(1, np.int64), np.array([total]), np.array([b.starts[0][1]]), np.zeros(1, np.int64))
                pair = np.uint64(xxh64_intdigest(f"2 {lang}"))
                for n, *found in b.grams(hashes, sizes, bits, table, pair):
                    for at in range(0, len(found[0]), 65_536):
                        yield rows(lang, n, *[f[at:at + 65_536] for f in found])

        def rows(lang, n, fp, f, row, at):
            # language and size are part of the key; keys that meet by chance only choose more pointers
            key = fp ^ np.uint64(xxh64_intdigest(f"{n} {lang}")).view(np.int64)
            values = (pa.array(key), pa.array(f.astype(np.int32)), pa.array(row), pa.array(at * SPOTS + n))
            return pa.RecordBatch.from_arrays(list(values), ["fp", "f", "row", "spot"])

        for batch in batches:
            for i in range(batch.num_rows):
                row, lang, text = (batch.column(c)[i].as_py() for c in range(3))
                at = 0
                for tokens in segments(text):
                    if lang not in blocks:
                        blocks[lang] = _Block()
                    blocks[lang].add(row, at, np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)))
                    at += len(tokens)
                    size += len(tokens) + 1
                    # the product of three word numbers has to stay below 2**63
                    if size >= block:
                        yield from flush()
                        words, blocks, size = _Words(), {}, 0
        if blocks:
            yield from flush()

    return docs.select("row", "lang", "text").mapInArrow(count, ROWS)


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """The rows whose key occurs ``least`` times or more, with all their pointers."""
    total = F.sum("f").over(Window.partitionBy("fp"))
    return rows.withColumn("_total", total).filter((F.col("_total") >= least) | (F.col("spot") % SPOTS == 0)).drop("_total")


def pair_table(pairs: DataFrame) -> bytes:
    """Bits of the fingerprints ``fp`` as one table of 2**TABLE_BITS bits, whatever their number."""
    place = F.col("fp").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    bits = pairs.select(F.shiftright(place, CHUNK_BITS).cast("int").alias("chunk"), place.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int").alias("bit"))

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            which, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(which).tolist():
                mine = bit[which == c]
                table = chunks.setdefault(c, np.zeros(1 << CHUNK_BITS - 3, np.uint8))
                np.bitwise_or.at(table, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        for c, table in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["chunk", "bits"])

    whole = bytearray(1 << TABLE_BITS - 3)
    # every chunk is filled by one task and is 8 KB
    for c, bits in bits.distinct().repartition("chunk").mapInArrow(fill, "chunk int, bits binary").collect():
        whole[c << CHUNK_BITS - 3:(c + 1) << CHUNK_BITS - 3] = bits
    return bytes(whole)


def phrase_texts(docs: DataFrame, pointers: DataFrame) -> DataFrame:
    """(lang, n, phrase, f): the text that every pointer of ``pointers`` shows, read from ``docs``."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                lang, text = (batch.column(c)[i].as_py() for c in range(2))
                tokens = [t for part in segments(text) for t in part]
                spots = batch.column(2)[i].values
                at, size = np.divmod(spots.field("spot").to_numpy(), SPOTS)
                phrases = [tokens[a] if n == 1 else b" ".join(tokens[a:a + n]) for a, n in zip(at.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(at), np.int64))), pa.array(size.astype(np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), spots.field("f")],
                    ["lang", "n", "phrase", "f"],
                )

    # a document has no more pointers than n-grams
    spots = pointers.groupBy("row").agg(F.collect_list(F.struct("spot", "f")).alias("spots"))
    return docs.join(spots, "row").select("lang", "text", "spots").mapInArrow(read, "lang string, n int, phrase string, f int")


def phrase_counts(documents: DataFrame, least: int = LEAST, bits: int = 64, block: int = BLOCK) -> DataFrame:
    """(lang, n, phrase, f) of all phrases of up to LONGEST words that occur ``least`` times or more.

    ``documents`` is a plain scan of files.  n = 0 is the language's number of words.
    """
    row = fresh(documents, "row")[0]
    docs = with_place(documents.select("text", "lang"), row).select(
        F.col(row).alias("row"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    )
    short = stage(frequent(gram_rows(docs, (1, 2), bits, None, block), least))
    table = pair_table(short.filter(F.col("spot") % SPOTS == 2))
    pairs = documents.sparkSession.sparkContext.broadcast(table)
    longer = stage(frequent(gram_rows(docs, tuple(range(3, LONGEST + 1)), bits, pairs, block), least))
    # keys only chose the pointers: counts are summed by the texts themselves
    exact = phrase_texts(docs, short.unionByName(longer)).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return stage(exact.filter((F.col("f") >= least) | (F.col("n") == 0)))


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, n, a, l, r, score): the lowest-scoring cut, the first of equal ones."""
    phrases = counts.filter("n > 0").select("lang", "phrase", "f")
    candidates = counts.filter("n > 1").select("lang", "phrase", "n", F.col("f").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    # words hold no space, so a cut lies at the k-th one
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - n)"))
    part = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("_over", F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a")).withColumn("_under", whole("l") * whole("r"))
    cuts = cuts.withColumn("score", F.expr("cast(_over div _under as bigint)"))
    least = cuts.groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return least.select("lang", "phrase", "n", "a", "m.l", "m.r", "m.score")


def uncontained(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Without the candidates that half or more of the time occur inside one longer candidate."""
    longer = counts.filter("n > 2").select("lang", "n", F.split("phrase", " ").alias("w"), "f")
    inside = longer.withColumn("m", F.explode(F.expr("sequence(2, n - 1)"))).withColumn("i", F.explode(F.expr("sequence(1, n - m + 1)")))
    most = inside.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    rows = candidates.join(most, ["lang", "phrase"], "left")
    return rows.filter(F.coalesce(F.col("_most") * 100 < F.col("a") * 50, F.lit(True))).drop("_most")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, bits: int = 64, block: int = BLOCK) -> DataFrame:
    """The first ``top`` phrases of every language; ``documents`` is a plain scan of files."""
    counts = phrase_counts(documents, least, bits, block)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = uncontained(scored(counts), counts).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    words = counts.filter("n = 0").select("lang", F.col("f").alias("words"))
    return ranked.drop("n").join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
