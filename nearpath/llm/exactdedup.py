"""Exact dedup: partitions by length and content hash, each owning a compressed radix trie of whole texts.

Texts are compared as full byte strings after every run of separators became one space.  Each
scan task first combines its own copies in a trie, so a text with very many copies leaves a task
once, not once a row.  Distinct texts are then dealt by (length, content hash) and inserted into
the tries of their partitions; terminal nodes hold the smallest identifier and the number of rows.
A trie over its memory bound spills its largest subtree: the scan side hands it on as partial
groups, the owner side writes it as a sorted run in its scratch space and merges the runs at the end
(scratch of one task: if its executor is lost, the task starts again).  Verdicts return to the rows by
the digest of the text; the few largest groups are broadcast, so their rows are not gathered.

Defined results: null counts as empty text; rows without an id join the group of their text and
never own it unless no row has an id (then ``keep_id`` is null and nothing is kept); rows that
repeat an id within a group are one document and share its verdict; an empty table gives no rows;
only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm.common import SPACES, documents, row_key, settled, tidy, unused_names

#: Bytes of trie (labels plus a fixed charge a node) before a subtree is spilled.
SCAN_BYTES = 48 << 20
OWNER_BYTES = 128 << 20
_NODE = 240
_BATCH = 4 << 20


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Patricia trie of byte strings; a node is [label, children, value] with value None inside.

    A value is (smallest id or None, rows, content hash); inserting a key again merges values.
    """

    def __init__(self) -> None:
        self.children: dict[int, list] = {}
        self.root_value = None
        self.bytes = 0
        self.weight: dict[int, int] = {}

    @staticmethod
    def merged(a, b):
        if a is None:
            return b
        owner = b[0] if a[0] is None else a[0] if b[0] is None else min(a[0], b[0])
        return (owner, a[1] + b[1], a[2])

    def insert(self, key: bytes, value: tuple) -> None:
        if not key:
            self.root_value = self.merged(self.root_value, value)
            return
        head, children, at, grown = key[0], self.children, 0, 0
        while True:
            node = children.get(key[at])
            if node is None:
                children[key[at]] = [key[at:], {}, value]
                grown += _NODE + len(key) - at
                break
            label = node[0]
            if key.startswith(label, at):
                at += len(label)
                if at == len(key):
                    node[2] = self.merged(node[2], value)
                    break
                children = node[1]
                continue
            n = _common(label, key, at)
            upper = [label[:n], {label[n]: node}, None]
            node[0] = label[n:]
            children[key[at]] = upper
            grown += _NODE
            if at + n == len(key):
                upper[2] = value
            else:
                upper[1][key[at + n]] = [key[at + n :], {}, value]
                grown += _NODE + len(key) - at - n
            break
        if grown:
            self.bytes += grown
            self.weight[head] = self.weight.get(head, 0) + grown

    def items(self, head: int | None = None) -> Iterator[tuple[bytes, tuple]]:
        """(key, value) in key order, of one subtree of the root or of all."""
        if head is None and self.root_value is not None:
            yield b"", self.root_value
        stack = [(b"", self.children[h]) for h in sorted(self.children if head is None else [head], reverse=True)]
        while stack:
            prefix, (label, children, value) = stack.pop()
            key = prefix + label
            if value is not None:
                yield key, value
            stack.extend((key, children[c]) for c in sorted(children, reverse=True))

    def heaviest(self) -> int:
        return max(self.weight, key=self.weight.get)

    def drop(self, head: int) -> None:
        self.bytes -= self.weight.pop(head)
        del self.children[head]


_SCHEMA = pa.schema([("keep_id", pa.int64()), ("rows", pa.int64()), ("h", pa.int64()), ("norm", pa.binary())])


def _batches(rows: Iterator[tuple[bytes, tuple]], schema: pa.Schema, whole: bool) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for key, (owner, n, h) in rows:
        out.append((owner, n, h, key if whole else None))
        size += len(key) if whole else 32
        if size >= _BATCH or len(out) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, tuple]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(part.column(3).to_pylist(), zip(*(part.column(i).to_pylist() for i in range(3))))


def combine_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan side: one partial group a distinct text, subtrees handed on when the trie is full."""

    def groups():
        trie = RadixTrie()
        for key, value in _rows(batches):
            trie.insert(key, value)
            while trie.bytes > SCAN_BYTES and trie.weight:
                head = trie.heaviest()
                yield from trie.items(head)
                trie.drop(head)
        yield from trie.items()

    yield from _batches(groups(), _SCHEMA, True)


def _read_run(file) -> Iterator[tuple[bytes, tuple]]:
    file.seek(0)
    while True:
        try:
            yield from pickle.load(file)
        except EOFError:
            return


def own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner side: merge the partial groups of a partition; spilled subtrees are sorted runs."""
    trie, runs = RadixTrie(), []
    for key, value in _rows(batches):
        trie.insert(key, value)
        while trie.bytes > OWNER_BYTES and trie.weight:
            head, run, part, size = trie.heaviest(), tempfile.TemporaryFile(), [], 0
            for item in trie.items(head):
                part.append(item)
                size += len(item[0])
                if size > _BATCH:
                    pickle.dump(part, run)
                    part, size = [], 0
            pickle.dump(part, run)
            trie.drop(head)
            runs.append(run)

    def merged():
        held = None
        for key, value in heapq.merge(trie.items(), *map(_read_run, runs), key=lambda item: item[0]):
            if held is not None and held[0] == key:
                held = (key, RadixTrie.merged(held[1], value))
            else:
                if held is not None:
                    yield held
                held = (key, value)
        if held is not None:
            yield held

    yield from _batches(merged(), _SCHEMA, True)


def normal_text(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a distinct text: keep_id, group_size and the digest of the normalised text."""
    norm = normal_text(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("rows"), F.xxhash64(norm).alias("h"), norm.cast("binary").alias("norm"))
    kind = "keep_id long, rows long, h long, norm binary"
    partial = rows.mapInArrow(tidy(combine_copies), kind)
    owners = partial.repartition(F.octet_length("norm"), F.col("h")).mapInArrow(tidy(own_texts), kind)
    return owners.select(F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", F.col("rows").alias("group_size"))


def _digest(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(normal_text(text).cast("binary"), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: int = 5_000) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    ``largest`` bounds the broadcast: groups of more than one in so many rows, at most that many groups.
    """
    owners = settled(text_owners(docs, id_col, text_col), "exact-owners")
    least = owners.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0] // largest + 64
    rows = docs.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("digest"))
    big = owners.filter(F.col("group_size") > least).select(F.col("digest").alias("big"), F.col("keep_id").alias("big_id"), F.col("group_size").alias("big_size"))
    met = rows.join(F.broadcast(big), F.col("digest") == F.col("big"), "left")
    # rows of the largest groups are done: their key, of another length, spreads them and meets nothing
    aside = F.xxhash64("doc_id", F.spark_partition_id()).cast("string").cast("binary")
    key = F.when(F.col("big").isNull(), F.col("digest")).otherwise(aside)
    met = met.withColumn("key", key).join(owners.select(F.col("digest").alias("own"), "keep_id", "group_size"), F.col("key") == F.col("own"), "left")
    keep_id = F.when(F.col("big").isNull(), F.col("keep_id")).otherwise(F.col("big_id"))
    size = F.when(F.col("big").isNull(), F.col("group_size")).otherwise(F.col("big_size"))
    found = met.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), "digest")
    return found.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each distinct text: the smallest id (null last), then the smallest hash of all columns;
    columns as they came.

    Rows are judged, not ids: other texts under the same id stay.  Of rows alike in all columns one stays.
    """
    key, = unused_names(docs, "key")
    owners = text_owners(docs).select(F.col("digest").alias("own"), "keep_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _digest(F.col("text")).alias("digest"), row_key(docs).alias("row"))
    # the owner's id is part of the key, so the copies of a text are not gathered
    own = rows.join(owners, (F.col("digest") == F.col("own")) & F.col("id").eqNullSafe(F.col("keep_id")))
    first = settled(own.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("n"), F.countDistinct("row").alias("different")), "exact-first")
    left = docs.withColumn(key, row_key(docs)).join(first.select(F.col("row").alias(key)), key, "left_semi").drop(key)
    return left if first.filter("n > different").isEmpty() else left.dropDuplicates()


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
}
