"""Token files: one concatenated id array a segment, with Elias-Fano coded document boundaries.

Documents are range-partitioned by id; each task encodes its sorted documents and writes segments
of a bounded number of ids.  A segment is one block of bytes:

    magic ``NPTS``, version, id width in bytes, low bits l, documents n, ids m     (6 x uint32)
    document ids: n x int64 and n null flags (bytes)
    boundaries 0 = b_0 <= ... <= b_n = m, Elias-Fano coded: n+1 lower parts of l bits,
        the upper parts in unary as a bit vector, and every 64th one's place (uint32)
    ids: m x uint16 or uint32, little-endian

Boundaries take about 2 + log2(m/n) bits each instead of 64, and ``select`` finds any of them from
the sampled places without decoding the others.  Segments are the rows of a Parquet table, so any
file system and commit protocol that Spark knows will do, and a lost task is simply run again.

Defined results: a null text is empty and holds the end id alone; null ids sort first; rows that
repeat an id are separate documents next to each other, in the order of a hash of their texts, then of
the texts, and may lie in several partitions; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpath.llm.bpe import LATIN, PLAIN, byte_characters, default_path
from nearpath.llm.common import documents, intermediate, shuffle_partitions, tidy

#: Ids of a segment after which the next document starts a new one.
SEGMENT_IDS = 1 << 20
END_ID = 2
_SAMPLE = 64
#: Bytes of texts whose pieces are found at once; a longer text is split alone.
SPLIT_BYTES = 4 << 20
#: Unseen pieces of one call of the model.
MODEL_PIECES = 64
#: Pieces after which a worker's memo starts a new generation, beside the one before, and their longest.
MEMO_PIECES = 200_000
MEMO_BYTES = 64


class EliasFano:
    """A sorted list of n integers up to ``most`` in about 2 + log2(most / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), at[::_SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        return struct.pack("<III", len(self.low), len(self.high), len(self.places)) + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def read(cls, block: memoryview, n: int, low_bits: int) -> tuple[EliasFano, int]:
        a, b, c = struct.unpack_from("<III", block)
        u8 = np.frombuffer(block, dtype=np.uint8, count=a + b, offset=12)
        places = np.frombuffer(block, dtype="<u4", count=c, offset=12 + a + b)
        return cls(n, low_bits, u8[:a], u8[a:], places), 12 + a + b + 4 * c

    def _low(self, i: int) -> int:
        value = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            value |= (int(self.low[at >> 3]) >> (at & 7) & 1) << k
        return value

    def select(self, i: int) -> int:
        """The i-th value, from the sampled place before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.places[i // _SAMPLE]), i % _SAMPLE
        byte = at >> 3
        value = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := value.bit_count()) <= left:
            left -= ones
            byte += 1
            value = int(self.high[byte])
        for _ in range(left):
            value &= value - 1
        place = (byte << 3) + (value & -value).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
            out = out | (bits << np.arange(self.low_bits)).sum(axis=1)
        return out


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    ends = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    code = EliasFano.of(ends)
    head = struct.pack("<4s5I", b"NPTS", 1, width, code.low_bits, len(lengths), len(ids))
    keys = np.asarray([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes() + bytes(d is None for d in doc_ids)
    return head + keys + code.tobytes() + ids.astype("<u2" if width == 2 else "<u4").tobytes()


class Segment:
    """A segment read back from its bytes."""

    def __init__(self, block: bytes):
        view = memoryview(block)
        magic, version, width, low_bits, n, m = struct.unpack_from("<4s5I", view)
        if magic != b"NPTS" or version != 1:
            raise ValueError("not a token segment")
        at = 24
        self.doc_ids = [None if null else int(d) for d, null in zip(np.frombuffer(view, "<i8", n, at), view[at + 8 * n : at + 9 * n])]
        self.bounds, used = EliasFano.read(view[at + 9 * n :], n + 1, low_bits)
        self.ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", m, at + 9 * n + used)

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


#: Characters that count as digits in plain texts.
_NUMBER = "0-9²³¹¼-¾"
#: Classes of the characters of plain texts; 0 is any other character.
_LETTER, _DIGIT, _SIGN, _SPACE, _BREAK = range(1, 6)


def _class(c: str) -> int:
    if PLAIN.search(c):
        return 0
    return _SPACE if c == " " else _BREAK if c.isspace() else _LETTER if re.match(f"[{LATIN}]", c) else _DIGIT if re.match(f"[{_NUMBER}]", c) else _SIGN


class Splitter:
    """Starts of the pieces of plain texts, found in the bytes of many texts at once."""

    def __init__(self):
        self.one = bytes(_class(chr(b)) if b < 128 else 0 for b in range(256))
        self.two = np.zeros(1 << 16, dtype=np.uint8)
        for code in range(0x80, 0x800):
            a, b = chr(code).encode()
            self.two[a << 8 | b] = _class(chr(code))

    def classes(self, data: np.ndarray) -> np.ndarray:
        """Class of the character that each byte belongs to."""
        found = np.frombuffer(bytearray(data.tobytes().translate(self.one)), dtype=np.uint8)
        at = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        kinds = self.two[data[at].astype(np.uint16) << 8 | data[at + 1]]
        found[at], found[at + 1] = kinds, kinds
        return found

    @staticmethod
    def starts(data: np.ndarray, kinds: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Places where pieces start, of texts that start at ``texts`` and are of known classes."""
        n = len(data)
        space = kinds >= _SPACE
        edge = np.zeros(n + 3, dtype=bool)
        edge[texts] = True
        edge[n] = True
        start = np.zeros(n + 3, dtype=bool)
        # a space goes to what follows it
        start[1:n] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _SPACE)
        # of a run of white space, the last character is apart if the text goes on
        more = np.flatnonzero(space[1:] & space[:-1]) + 1
        start[more] = ~(edge[more + 1] | np.append(space, True)[more + 1])
        start[texts] = True
        start[n:] = False
        mark = np.flatnonzero(data == 0x27)
        mark = mark[start[mark]]
        after = np.append(data, np.zeros(2, dtype=np.uint8))
        first, second = after[mark + 1], after[mark + 2]
        short = mark[np.isin(first, list(b"stmd")) & ~edge[mark + 1]]
        long = mark[np.isin(first.astype(np.uint16) << 8 | second, [a << 8 | b for a, b in (b"re", b"ve", b"ll")]) & ~edge[mark + 1] & ~edge[mark + 2]]
        start[short + 1], start[long + 1] = False, False
        start[short + 2], start[long + 3] = True, True
        return np.flatnonzero(start[:n])


class LibraryEncoder:
    """The tokenizers library behind a memo of pieces, which the file's splitter makes independent.

    Plain texts are split here, many at a time, and their unseen pieces go to the library's BPE model,
    many a call; texts with special tokens or rarer characters go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.type = "<u2" if self.width == 2 else "<u4"
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.code = "H" if self.width == 2 else "I"
        self.chars = np.asarray(list(map(ord, byte_characters())), dtype="<u2")
        self.apart = self._apart()
        self.splitter = Splitter()
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _apart(self) -> int | None:
        """Id of the byte 255, which is in no UTF-8 text, if no merge takes it: merges do not cross it."""
        model, vocab, c = self.tok.model, self.tok.get_vocab(with_added_tokens=False), byte_characters()[255]
        if model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix or sum(c in t for t in vocab) != 1:
            return None
        return vocab.get(c)

    def _model(self, block: bytes) -> list[int]:
        """Ids of bytes by the library's model, which takes byte characters."""
        return [t.id for t in self.tok.model.tokenize(self.chars[np.frombuffer(block, dtype=np.uint8)].tobytes().decode("utf-16-le"))]

    def _unseen(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        if self.apart is None:
            return [array(self.code, self._model(p)).tobytes() for p in pieces]
        ids = array(self.code)
        for at in range(0, len(pieces), MODEL_PIECES):
            ids.extend(self._model(b"\xff".join(pieces[at : at + MODEL_PIECES])))
            ids.append(self.apart)
        block, ends = ids.tobytes(), (np.flatnonzero(np.asarray(ids) == self.apart) * self.width).tolist()
        return [block[a:b] for a, b in zip([0, *(e + self.width for e in ends)], ends)]

    def _packed(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pieces, from the memo if they are there."""
        found = list(map(self.memo.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i in new:
            found[i] = self.older.get(pieces[i])
        unseen = [i for i in new if found[i] is None]
        for i, ids in zip(unseen, self._unseen([pieces[i] for i in unseen])):
            found[i] = ids
        self.memo.update((pieces[i], found[i]) for i in new if len(pieces[i]) <= MEMO_BYTES)
        if len(self.memo) >= MEMO_PIECES:
            self.memo, self.older = {}, self.memo
        return found

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed ids of each text (null: none), of which about ``SPLIT_BYTES`` are split at once."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + SPLIT_BYTES, "right")))
            yield from self._encode_some(pc.fill_null(texts.slice(at, upto - at), ""))
            at = upto

    def _encode_some(self, texts: pa.Array) -> Iterator[bytes]:
        texts.validate(full=True)  # else bytes of two texts could pass for a character
        bounds, data = self._bytes(texts)
        kinds = self.splitter.classes(data)
        whole = np.zeros(len(texts), dtype=bool)
        whole[np.searchsorted(bounds, np.flatnonzero(kinds == 0), "right") - 1] = True
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if whole.any():
            bounds, data = self._bytes(texts.filter(pa.array(~whole)))
            kinds = self.splitter.classes(data)
        plain = self._encode_plain(bounds, data, kinds)
        for i, rare in enumerate(whole.tolist()):
            yield array(self.code, self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids).tobytes() if rare else next(plain)

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the texts in their bytes, and the bytes."""
        _, offsets, data = texts.buffers()
        if not len(texts) or data is None:
            return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        bounds = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        return bounds - bounds[0], np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]

    def _encode_plain(self, bounds: np.ndarray, data: np.ndarray, kinds: np.ndarray) -> Iterator[bytes]:
        starts = self.splitter.starts(data, kinds, bounds[:-1])
        places = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._packed(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        _, offsets, block = ids.buffers()
        cuts = np.frombuffer(offsets, dtype=np.int64)[ids.offset + np.searchsorted(starts, bounds)].tolist()
        block = memoryview(block or b"")
        return (block[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


SEGMENTS = "part int, seg int, n_docs long, n_tokens long, block binary"


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode all documents and write them, in ascending id order, as a table of segments."""
    path = path or default_path("byte_bpe_50k.json")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = _encoder(path), TaskContext.get().partitionId()
        end = np.asarray([end_id], dtype=enc.type).tobytes()
        keys, lengths, blocks, held, seg = [], [], [], 0, 0

        def flush():
            block = write_segment(keys, lengths, np.frombuffer(b"".join(blocks), dtype=enc.type), enc.width)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([block], pa.binary())],
                names=["part", "seg", "n_docs", "n_tokens", "block"],
            )

        for batch in batches:
            for key, packed in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                keys.append(key)
                blocks += (packed, end)
                lengths.append(len(packed) // enc.width + 1)
                held += lengths[-1]
                if held >= SEGMENT_IDS:
                    yield flush()
                    keys, lengths, blocks, held, seg = [], [], [], 0, seg + 1
        if keys:
            yield flush()

    n = partitions or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ("doc_id", "mark", "text")
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(n, "doc_id", "mark").sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(run, SEGMENTS).write.parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written segments."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("s"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("part").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    own = segments.select("part", "seg", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("own"))
    bases = own.join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("seg").alias("g"), (F.col("before") + F.col("own")).alias("base"))
    rows = segments.select("part", "seg", "block").join(bases, (F.col("part") == F.col("p")) & (F.col("seg") == F.col("g"))).select("base", "block")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                seg = Segment(block.as_py())
                bounds = seg.bounds.all()
                wide = seg.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].data) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, pa.int64()), pa.array(base + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intermediate(spark, "tokens")
    write_tokens(documents(spark, sf_dir), out)
    return read_tokens(spark, out)


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
