"""Substring dedup over a compacted de Bruijn graph of word k-mers.

A window is ``span`` consecutive words.  Words are removed that a window covers whose word
sequence starts anywhere else too.  Counting every window would shuffle the whole corpus as
hashes, so the graph is built on minimizers: of the 16-word k-mers that a window holds, the one
with the smallest hash.  Equal windows have equal minimizers, so only windows whose minimizer
repeats can repeat.

1. Nodes are minimizer k-mers; the stretch of words from one to the end of the next is an edge.
   Entries (k-mer, edges on both sides, source coordinate) meet by k-mer.  A node that occurs once is
   dropped.  A node whose occurrences are all entered and left by the same edges does not branch.
2. The marks return to their sources by a join on the document.  Consecutive nodes that do not
   branch compact into paths, up to the ends of the edges around them.  A window inside such a path whose
   minimizer does not branch repeats wherever that minimizer does.  The remaining windows with a repeated
   minimizer are verified at their source coordinates: they meet by the digest of their words.
3. The repeated windows return to their documents, and the words under them are removed.

Edges and windows count as equal if the 128-bit BLAKE2b digests of their words are.  The rolling hash
that chooses minimizers and brings entries together decides nothing: a collision costs work.

Entries travel as packed arrays of a slice of documents.  Within a slice, entries that repeat are
answered at once and leave it as a single mark, once a task, so a very frequent passage costs few
entries.  Documents are dealt by a hash of id and text; no group of documents is gathered.  Buckets
and cells follow the bytes of the texts, so what a task holds at once does not grow with the table.

Defined results: null text has no words; texts shorter than a window keep everything; rows with the
same id and text are separate sources (each repeats the other); null ids are allowed; an empty
table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm.common import SPACES, buckets_for, documents, tidied, tidy
from nearpath.llm.wordcore import DIGEST, Tokens, mix, slices, window_hash

SPAN = 35
KMER = 16

_U = np.uint64
_NULL_ID = -(1 << 63)
_WORDS_ROOT = 0xD6E8FEB86659FD93 | 1

_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("ids", "tags", "counts", "a", "b", "c")]])
_PACKED_SQL = "bucket int, kind int, ids binary, tags binary, counts binary, a binary, b binary, c binary"
_QUERY, _MARK, _ANSWER = 0, 1, 2


def pack(bucket: np.ndarray, kind: int, owner: np.ndarray | None, ids: np.ndarray, tags: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a bucket: the documents that have entries, their numbers of entries, and the entries."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns] + [np.zeros(0, np.uint32)] * (3 - len(columns))
    owner = owner[order] if owner is not None else None
    edges = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for low, high in zip(np.r_[0, edges].tolist(), np.r_[edges, len(bucket)].tolist()):
        if owner is None:
            table = (b"", b"", b"")
        else:
            own = owner[low:high]
            first = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
            table = (ids[own[first]].tobytes(), tags[own[first]].tobytes(), np.diff(np.r_[first, high - low]).astype(np.uint32).tobytes())
        rows.append((int(bucket[low]), kind, *table, *(c[low:high].tobytes() for c in columns)))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACKED.types)], schema=_PACKED)


class Entries:
    """Packed rows of one kind put together again."""

    def __init__(self, table: pa.Table, kind: int, types: tuple):
        rows = [r for r in table.select(["kind", "ids", "tags", "counts", "a", "b", "c"]).to_pylist() if r["kind"] == kind]
        join = lambda name, dtype: np.frombuffer(b"".join(r[name] for r in rows), dtype=dtype)
        ids, tags, counts = join("ids", np.int64), join("tags", np.uint32), join("counts", np.uint32)
        self.ids, self.tags = np.repeat(ids, counts), np.repeat(tags, counts)
        self.columns = [join(n, t) for n, t in zip("abc", types)]

    def __len__(self) -> int:
        return len(self.columns[0])


class Once:
    """Marks that a task has not sent yet, among the last ``limit``."""

    def __init__(self, limit: int = 1 << 18):
        self._sent: set = set()
        self._limit = limit

    def new(self, *columns: np.ndarray) -> np.ndarray:
        """Flags of the rows that are new."""
        if len(self._sent) > self._limit:
            self._sent.clear()
        rows = columns[0].tolist() if len(columns) == 1 else list(zip(*(c.tolist() for c in columns)))
        new = np.fromiter((r not in self._sent for r in rows), dtype=bool, count=len(rows))
        self._sent.update(rows)
        return new


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of every ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = best(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = best(out[: len(out) - rest], out[rest:])
    return out


class Graph:
    """Minimizer nodes of a slice of documents."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, span: int, kmer: int):
        self.words = w = Tokens(raw, offsets)
        self.span, self.kmer, self.reach = span, kmer, span - kmer + 1
        n = len(w.hash)
        self.windows = max(0, n - span + 1)
        if not self.windows:
            self.valid = np.zeros(0, bool)
            self.nodes = np.zeros(0, np.int64)
            return
        self.kmers = window_hash(w.hash, kmer, _WORDS_ROOT)
        self.valid = w.doc[: self.windows] == w.doc[span - 1 :]
        self.least = _sliding(self.kmers, self.reach, np.minimum)
        # a k-mer is a node if some window inside its document has it as smallest
        padded = np.zeros(self.windows + 2 * (self.reach - 1), dtype=np.uint64)
        padded[self.reach - 1 : self.reach - 1 + self.windows] = np.where(self.valid, self.least, _U(0))
        self.nodes = np.flatnonzero(_sliding(padded, self.reach, np.maximum)[: len(self.kmers)] == self.kmers)
        self.nodes = self.nodes[self.kmers[self.nodes] != 0]

    def edges(self) -> np.ndarray:
        """Digest of the stretch from the node before each to the end of the one after it; 0 where its
        document has none on a side."""
        out = np.zeros(len(self.nodes), dtype=DIGEST)
        doc = self.words.doc[self.nodes]
        inner = np.flatnonzero((doc[:-2] == doc[1:-1]) & (doc[1:-1] == doc[2:])) + 1
        out[inner] = self.words.digests(self.nodes[inner - 1], self.nodes[inner + 1] + self.kmer)
        return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start flag of each run of equal keys in that order)."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    start = np.ones(len(order), dtype=bool)
    if len(order):
        start[1:] = False
        for k in keys:
            s = k[order]
            start[1:] |= s[1:] != s[:-1]
    return order, start


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key) % _U(n)).astype(np.int32)


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column("doc_id").combine_chunks().fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
    tags = batch.column("tag").to_numpy() if isinstance(batch, pa.Table) else batch.column("tag").to_numpy(zero_copy_only=False)
    return ids.astype(np.int64), tags.astype(np.uint32)


def _text(batch):
    column = batch.column("text")
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Repeats:
    """The three passes; ``rows`` has doc_id, text, tag (32 hash bits of both) and cell."""

    def __init__(self, span: int, kmer: int, buckets: int, cells: int):
        self.span, self.kmer, self.buckets, self.cells = span, kmer, buckets, cells

    def _cell(self, tags: np.ndarray) -> np.ndarray:
        return (tags % np.uint32(self.cells)).astype(np.int32)

    def nodes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once()
        for batch in batches:
            ids, tags = _columns(batch)
            for at, to, offsets, raw in slices(_text(batch)):
                g = Graph(offsets, raw, self.span, self.kmer)
                if not len(g.nodes):
                    continue
                key, edge, owner = g.kmers[g.nodes], g.edges(), g.words.doc[g.nodes]
                place = (g.nodes - g.words.first[owner]).astype(np.uint32)
                order, start = _runs(key)
                number = np.cumsum(start) - 1
                many = np.bincount(number)[number] > 1
                single, twice = np.sort(order[~many]), np.sort(order[many])
                own_ids, own_tags = ids[at:to], tags[at:to]
                yield from pack(_bucket(key[single], self.buckets), _QUERY, owner[single], own_ids, own_tags, key[single], edge[single], place[single])
                mark = key[order[start & many]]
                mark = mark[once.new(mark)]
                yield from pack(_bucket(mark, self.buckets), _MARK, None, own_ids, own_tags, mark)
                yield from pack(self._cell(own_tags[owner[twice]]) % self.buckets, _ANSWER, owner[twice], own_ids, own_tags, place[twice], np.zeros(len(twice), np.uint8))

    def join_nodes(self, table: pa.Table) -> pa.Table:
        asked, marked, known = Entries(table, _QUERY, (np.uint64, DIGEST, np.uint32)), Entries(table, _MARK, (np.uint64,)), Entries(table, _ANSWER, (np.uint32, np.uint8))
        key, edge, place = asked.columns
        order, start = _runs(key)
        number = np.cumsum(start) - 1
        key = key[order]
        elsewhere = np.isin(key, marked.columns[0])
        repeated = (np.bincount(number)[number] > 1) | elsewhere if len(key) else elsewhere
        x, y = edge["x"][order], edge["y"][order]
        first = np.flatnonzero(start)[number] if len(key) else number
        apart = (x != x[first]) | (y != y[first]) | ((x == 0) & (y == 0)) | elsewhere
        differs = np.bincount(number, weights=apart)[number] > 0 if len(key) else elsewhere
        found = order[repeated]
        straight = (~differs[repeated]).astype(np.uint8)
        return self._answers([(asked.ids[found], asked.tags[found], place[found], straight), (known.ids, known.tags, known.columns[0], known.columns[1])])

    def _answers(self, parts) -> pa.Table:
        ids, tags, a, b = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((a, tags, ids))
        ids, tags, a, b = ids[order], tags[order], a[order], b[order]
        owner = np.zeros(len(ids), dtype=np.int64)
        if len(ids):
            owner[1:] = np.cumsum((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))
        out = list(pack(self._cell(tags), _ANSWER, owner, *self._table(ids, tags, owner), a, b))
        return pa.Table.from_batches(out, schema=_PACKED)

    @staticmethod
    def _table(ids, tags, owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else owner
        return ids[first], tags[first]

    @staticmethod
    def _by_document(answers: Entries) -> tuple[dict, list[np.ndarray]]:
        order = np.lexsort((answers.columns[0], answers.tags, answers.ids))
        ids, tags = answers.ids[order], answers.tags[order]
        columns = [c[order] for c in answers.columns]
        new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]) if len(ids) else np.zeros(0, np.int64)
        ends = np.r_[new[1:], len(ids)]
        return {(i, t): (a, b) for i, t, a, b in zip(ids[new].tolist(), tags[new].tolist(), new.tolist(), ends.tolist())}, columns

    def windows(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, tags = _columns(docs)
        where, (places, straight) = self._by_document(Entries(answers, _ANSWER, (np.uint32, np.uint8)))
        out: list[pa.RecordBatch] = []
        once = Once()
        for at, to, offsets, raw in slices(_text(docs)):
            own_ids, own_tags = ids[at:to], tags[at:to]
            hits = [(d, where[k]) for d, k in enumerate(zip(own_ids.tolist(), own_tags.tolist())) if k in where]
            if not hits:
                continue
            g = Graph(offsets, raw, self.span, self.kmer)
            if not g.windows:
                continue
            w = g.words
            repeated = np.zeros(len(w.hash), dtype=bool)
            plain = np.zeros(len(w.hash), dtype=bool)
            for d, (a, b) in hits:
                repeated[w.first[d] + places[a:b]] = True
                plain[w.first[d] + places[a:b]] = straight[a:b] > 0
            kept = np.where(repeated[: len(g.kmers)], g.kmers, _U(0xFFFFFFFFFFFFFFFF))
            candidate = g.valid & (_sliding(kept, g.reach, np.minimum)[: g.windows] == g.least)
            # paths: consecutive nodes that do not branch, with the edges that enter and leave them
            inside = np.zeros(g.windows + 1, dtype=np.int32)
            go = plain[g.nodes]
            follows = np.r_[False, go[:-1] & (w.doc[g.nodes[1:]] == w.doc[g.nodes[:-1]])] if len(go) else go
            heads, tails = np.flatnonzero(go & ~follows), np.flatnonzero(go & ~np.r_[follows[1:] & go[1:], False])
            low = g.nodes[heads - 1]
            high = g.nodes[tails + 1] + self.kmer - self.span + 1
            fits = high > low
            np.add.at(inside, low[fits], 1)
            np.add.at(inside, high[fits], -1)
            straight_ = np.where(plain[: len(g.kmers)], g.kmers, _U(0xFFFFFFFFFFFFFFFF))
            on_path = (np.cumsum(inside[:-1]) > 0) & (_sliding(straight_, g.reach, np.minimum)[: g.windows] == g.least)
            open_ = np.flatnonzero(candidate & ~on_path)
            known = on_path & g.valid
            digest = w.digests(open_, open_ + self.span)
            key, check = np.ascontiguousarray(digest["x"]), np.ascontiguousarray(digest["y"])
            order, start = _runs(key, check)
            number = np.cumsum(start) - 1
            many = np.bincount(number)[number] > 1 if len(order) else start
            known[open_[order[many]]] = True
            single = np.sort(order[~many])
            owner = w.doc[open_[single]]
            out += pack(_bucket(key[single], self.buckets), _QUERY, owner, own_ids, own_tags, key[single], check[single], (open_[single] - w.first[owner]).astype(np.uint32))
            mark = order[start & many]
            mark = mark[once.new(key[mark])]
            out += pack(_bucket(key[mark], self.buckets), _MARK, None, own_ids, own_tags, key[mark], check[mark])
            first, length = self._spans(known, w)
            owner = w.doc[first]
            out += pack(self._cell(own_tags[owner]) % self.buckets, _ANSWER, owner, own_ids, own_tags, (first - w.first[owner]).astype(np.uint32), length)
        return pa.Table.from_batches(out, schema=_PACKED)

    @staticmethod
    def _spans(known: np.ndarray, w: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of repeated windows within a document: (first window, windows)."""
        at = np.flatnonzero(known)
        if not len(at):
            return at, np.zeros(0, np.uint32)
        new = np.r_[True, (np.diff(at) > 1) | (w.doc[at[1:]] != w.doc[at[:-1]])]
        first = np.flatnonzero(new)
        return at[first], np.diff(np.r_[first, len(at)]).astype(np.uint32)

    def join_windows(self, table: pa.Table) -> pa.Table:
        asked, marked, known = Entries(table, _QUERY, (np.uint64, np.uint64, np.uint32)), Entries(table, _MARK, (np.uint64, np.uint64)), Entries(table, _ANSWER, (np.uint32, np.uint32))
        key, check = (np.concatenate([x, y]) for x, y in zip(asked.columns[:2], marked.columns))
        order, start = _runs(key, check)
        number = np.cumsum(start) - 1
        weight = np.where(order < len(asked), 1, 2)
        repeated = np.bincount(number, weights=weight)[number] > 1 if len(order) else start
        found = order[repeated & (order < len(asked))]
        return self._answers([(asked.ids[found], asked.tags[found], asked.columns[2][found], np.ones(len(found), np.uint32)), (known.ids, known.tags, *known.columns)])

    def covered(self, docs: pa.Table, answers: pa.Table) -> Iterator[tuple[int, bytes, np.ndarray | None]]:
        """(row, text bytes, mask of removed words or None) of each document."""
        ids, tags = _columns(docs)
        where, (first, length) = self._by_document(Entries(answers, _ANSWER, (np.uint32, np.uint32)))
        text = _text(docs)
        for row, key in enumerate(zip(ids.tolist(), tags.tolist())):
            raw = (text[row].as_py() or "").encode()
            if key not in where:
                yield row, raw, None
                continue
            a, b = where[key]
            low, high = first[a:b].astype(np.int64), first[a:b].astype(np.int64) + length[a:b] + self.span - 1
            change = np.zeros(int(high.max()) + 1, dtype=np.int32)
            np.add.at(change, low, 1)
            np.add.at(change, high, -1)
            yield row, raw, np.cumsum(change[:-1]) > 0


def _answered(docs: DataFrame, span: int, kmer: int, id_col: str, text_col: str):
    n = buckets_for(docs, text_col)
    job = Repeats(span, kmer, n, n)
    key = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit(0xFFFFFFFF))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("tag")).withColumn("cell", (F.col("tag") % job.cells).cast("int"))
    by_cell = lambda df: df.withColumnRenamed("bucket", "cell").groupBy("cell")
    nodes = rows.select("doc_id", "text", "tag").mapInArrow(tidy(job.nodes), _PACKED_SQL)
    marks = nodes.groupBy("bucket").applyInArrow(lambda t: tidied(job.join_nodes(t)), _PACKED_SQL)
    windows = rows.groupBy("cell").cogroup(by_cell(marks)).applyInArrow(lambda a, b: tidied(job.windows(a, b)), _PACKED_SQL)
    spans = windows.groupBy("bucket").applyInArrow(lambda t: tidied(job.join_windows(t)), _PACKED_SQL)
    return job, rows.groupBy("cell").cogroup(by_cell(spans))


def remove_repeats(docs: DataFrame, span: int = SPAN, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the remaining words joined by one space."""
    job, grouped = _answered(docs, span, kmer, id_col, text_col)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        n, gone, kept = [], [], []
        for _, raw, mask in job.covered(table, answers):
            words = raw.split()
            n.append(len(words))
            gone.append(0 if mask is None else int(mask.sum()))
            if mask is not None:
                keep = np.ones(len(words), dtype=bool)
                keep[: len(mask)] = ~mask
                words = compress(words, keep)
            kept.append(b" ".join(words).decode())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())})

    return grouped.applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def repeated_spans(docs: DataFrame, span: int = SPAN, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, end_word (exclusive) of every maximal removed stretch."""
    job, grouped = _answered(docs, span, kmer, id_col, text_col)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, low, high = [], [], []
        keys = table.column("doc_id").to_pylist()
        for row, _, mask in job.covered(table, answers):
            if mask is not None:
                edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
                ids += [keys[row]] * (len(edge) // 2)
                low += edge[::2].tolist()
                high += edge[1::2].tolist()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "first_word": pa.array(low, pa.int64()), "end_word": pa.array(high, pa.int64())})

    return grouped.applyInArrow(run, "doc_id long, first_word long, end_word long")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_substring": op7_substring}
ORACLES = {
    "op7_substring": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT rid, i, count(*) OVER (PARTITION BY array_to_string(w[i:i+{SPAN - 1}], ' ')) AS n FROM d, unnest(range(1, len(w) - {SPAN - 2})) AS u(i)),
g AS (SELECT DISTINCT rid, i + k AS j FROM v, range({SPAN}) AS r(k) WHERE n > 1),
p AS (SELECT rid, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(j)),
k AS (SELECT p.rid, count(g.j) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.j) FILTER (g.j IS NULL), '') AS kept FROM p LEFT JOIN g ON p.rid = g.rid AND p.j = g.j GROUP BY p.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
}
