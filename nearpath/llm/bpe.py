"""BPE encoding and decoding through a minimal acyclic transducer of the corpus's frequent words.

Word counts over all documents choose the words; the driver compiles them with their ids into a
shared-suffix automaton (a documented number of words, so the broadcast is bounded), which each
worker memory-maps.  A word that is not in it is merged exactly, lowest rank and leftmost first.
Results are those of the tokenizer file's own normaliser, splitter, merges and special tokens: texts
of plain Latin are split by ``re``; of others, only the chunks between white space that hold rarer
characters are normalised by the library and split by classes learned from its splitter.  All pieces
go through the same memo, transducer and merges.

Defined results: null counts as empty and gives no ids; strings of special tokens inside a text
are those tokens, as in the library; very long words are merged with a heap, never cut; repeated
rows and ids are encoded row by row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm import lexicon
from nearpath.llm.common import documents, kept, tidy, tidy_driver

#: Most frequent words of the corpus that are compiled; bounds the broadcast.
LEXICON_WORDS = 50_000
#: Bytes of the longest word that is compiled; longer ones are merged where they occur.
LEXICON_BYTES = 96
#: Words remembered by a worker in front of the automaton, in two generations, and their longest.
MEMO_WORDS = 150_000
MEMO_CHARS = 64

#: Letters below U+02B0.  Texts that hold nothing but these, digits, printable ASCII, Latin-1 signs
#: and plain white space are split by ``re``.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
PLAIN = re.compile("[^\\t\\n\\r -~¡-ʯ]")
#: The same, less the letters whose lower case leaves the range.
PLAIN_LOWER = re.compile("[^\\t\\n\\r -~¡-ʯ]|[" + "".join(c for c in map(chr, range(0xA1, 0x2B0)) if PLAIN.search(c.lower())) + "]")
#: White space that the normaliser replaces; nothing composes or splits across it.
_GAPS = re.compile("[\\t\\n\\r ]+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte, by its published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Memo(dict):
    """word -> ids as packed 16 or 32 bit integers; older words are forgotten a generation at a time.

    Words of more than ``MEMO_CHARS`` characters are made anew each time, so the memory is bounded.
    """

    def __init__(self, make, limit: int = MEMO_WORDS):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, word):
        value = self._old.get(word)
        if value is None:
            value = self._make(word)
        if len(word) > MEMO_CHARS:
            return value
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[word] = value
        return value


class Classes(dict):
    """Code point -> an ASCII character of the same class (letter, digit, white space, sign), as the
    tokenizer file's splitter sees it; most of ASCII stands for itself."""

    def __init__(self, tok: WordBpe):
        super().__init__((c, c) for c in (*range(28), *range(32, 128)))  # ``re`` takes the four others for space
        self._tok = tok

    def __missing__(self, code: int) -> int:
        c, split = chr(code), self._tok.library.pre_tokenizer.pre_tokenize_str
        if not split(c):
            kind = " "
        elif len(split(f"x{c}x")) == 1:
            kind = "x"
        else:
            kind = "0" if len(split(c + c)) == 2 else "!"
        self[code] = ord(kind)
        return self[code]


class WordBpe:
    """A BPE tokenizer with end-of-word marks, read from a tokenizer file."""

    def __init__(self, path: str, compiled: bytes | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.vocab, self.end = path, model["vocab"], model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(a, b): (rank, a + b) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chars = byte_characters()
        self.lexicon = lexicon.Lexicon(compiled) if compiled else None
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.memo = Memo(lambda word: np.asarray(self.encode_word(word), dtype="<u4").tobytes())
        self.chunks = Memo(self._chunk, MEMO_WORDS // 2)
        self.classes = Classes(self)
        self._word = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[" + LATIN + "]+|[0-9²³¹¼-¾]|[^\\s" + LATIN + "0-9²³¹¼-¾]+")

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merge(self, parts: list[str]) -> list[str]:
        """Apply merges in order of (rank, place)."""
        if len(parts) <= 48:
            while len(parts) > 1:
                best = None
                for i, pair in enumerate(zip(parts, parts[1:])):
                    found = self.merges.get(pair)
                    if found is not None and (best is None or found[0] < best[0]):
                        best = (found[0], i, found[1])
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [best[2]]
            return parts
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (found := self.merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merges[a, b][1], ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (found := self.merges.get((parts[p], parts[q]))):
                    heapq.heappush(heap, (found[0], p, parts[p], parts[q]))
        return [p for p in parts if p]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece already written in byte characters."""
        parts = list(piece)
        parts[-1] += self.end
        return [self.vocab[p] for p in self.merge(parts)]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        if self.lexicon is not None:
            ids = self.lexicon.get(raw)
            if ids is not None:
                return ids
        return self.encode_piece("".join([self.chars[b] for b in raw]))

    def _segment(self, text: str) -> bytes:
        if PLAIN_LOWER.search(text) is None:
            return b"".join(map(self.memo.__getitem__, self._word.findall(text.lower())))
        return b"".join(map(self.chunks.__getitem__, _GAPS.split(text)))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without plain white space."""
        if PLAIN_LOWER.search(chunk) is None:
            return b"".join(map(self.memo.__getitem__, self._word.findall(chunk.lower())))
        shown = self.library.normalizer.normalize_str(chunk)
        spans = (m.span() for m in self._word.finditer(shown.translate(self.classes)))
        return b"".join([self.memo[shown[a:b]] for a, b in spans])

    def encode(self, text: str) -> np.ndarray:
        if self.special_split is not None and "<|" in text:
            parts = self.special_split.split(text)
            block = b"".join(np.asarray([self.special[p]], "<u4").tobytes() if p in self.special else self._segment(p) for p in parts if p)
        else:
            block = self._segment(text)
        return np.frombuffer(block, dtype="<u4")

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens joined by single spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS, text_col: str = "text") -> list[str]:
    """The n most frequent lower-case letter runs over all documents.

    A histogram of the counts by powers of two finds a bound that at least n words reach; only
    those words are sorted and sent to the driver, in whichever number of tasks.  Words of more than
    ``LEXICON_BYTES`` bytes are left to the merges, so the broadcast is bounded in bytes too.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("w")).filter(F.octet_length("w").between(1, LEXICON_BYTES))
    counts = kept(words.groupBy("w").count().filter("count > 1"))
    sizes = dict(counts.groupBy(F.floor(F.log2("count")).alias("power")).count().collect())
    least, held = 0, 0
    for power in sorted(sizes, reverse=True):
        least, held = power, held + sizes[power]
        if held >= n:
            break
    # the last power may hold far more words than are wanted: ties beyond the limit go by the word
    rows = counts.filter(F.col("count") >= 2**least).orderBy(F.desc("count"), "w").limit(n).select("w")
    found = [r[0] for r in rows.collect()]
    counts.unpersist()
    return found


def compile_lexicon(words: list[str], path: str) -> bytes:
    plain = WordBpe(path)
    return lexicon.build((w.encode(), plain.encode_word(w)) for w in dict.fromkeys(words) if w)


@functools.lru_cache(maxsize=2)
def _worker(path: str, token: str, holder) -> WordBpe:
    return WordBpe(path, holder.value)


class _Keyed:
    """A broadcast that hashes by its name, so that a worker compiles it once."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.name = broadcast, name

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self):
        return hash(self.name)

    def __eq__(self, other):
        return self.name == other.name


def encoder(docs: DataFrame, path: str | None = None, text_col: str = "text"):
    """A function, for use in tasks, that returns the worker's tokenizer with the corpus lexicon."""
    path = path or default_path("word_bpe_49k.json")
    block = compile_lexicon(frequent_words(docs, text_col=text_col), path)
    tidy_driver(docs.sparkSession)
    held = _Keyed(docs.sparkSession.sparkContext.broadcast(block), hashlib.sha256(block).hexdigest())
    return lambda: _worker(path, held.name, held)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids``, the array of token ids."""
    make = encoder(docs, path, text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [tok.encode(t or "") for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again: id, n_tokens and digests of both."""
    make = encoder(docs, path, text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = make()
        names = list(map(str, range(len(tok.tokens))))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, digest, back = [], [], []
                for text in part.column(1).to_pylist():
                    ids = tok.encode(text or "").tolist()
                    n.append(len(ids))
                    digest.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(tok.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
