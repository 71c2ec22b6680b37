"""N-gram Jaccard join by adaptive multi-match prefixes, and the groups that its links form.

A document's set holds its distinct k-word shingles (lower case).  Similar sets
share at least ``t = ceil(threshold * n)`` shingles, so with any global order of shingles the first
``n - t + l`` of each share at least ``l`` (the smaller ``l`` of the two): a longer prefix asks for
more matches.

Shingles travel as 64-bit hashes made of those of their words.  They count the sets' sizes and find
candidates; classes go by a 128-bit BLAKE2b digest of all words; and a pair links only if the shingles of
its two texts, compared word by word, say so.

1. Texts of the same words, or of one and the same shingle, form a class, represented by its smallest
   id; only representatives go on.
2. Filter: with shingles in hash order and l growing with n, prefix entries meet by shingle.
   Representatives with too few shared entries can have no partner.
3. The others get the exact document frequency of each shingle.  Shared shingles are ordered by
   frequency, and each document takes the l of least estimated cost: entries to compare plus
   candidates to verify.  Sets with fewer than t shared shingles are out.
4. In two rounds, every document is verified against one hub of its frequent shingles, the most
   central document outside its component; the links found make components.  Then all pairs of
   different components are verified that share enough entries of the prefixes that the overlap
   for their two sizes asks for, which are shorter than those for any size.  Pairs within a component are already
   connected, so a large group of near copies never produces its pairs.
5. Links are joined to components by alternating large-star and small-star steps.

Joins by a shingle or a hub are salted by the number of its entries or pairs, so a frequent one is
spread over tasks.

Defined results: texts without words and null texts have no shingles and link with nothing; fewer
than k words are one shingle; rows with a null id are counted but not linked (component null); rows
that repeat an id are one node; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm.common import SPACES, buckets_for, cut, documents, row_key, settled, tidied, tidy, tidy_driver, unused_names
from nearpath.llm.substring import _ANSWER, _MARK, _PACKED_SQL, _QUERY, Entries, Once, _bucket, _columns, _runs, _text, pack
from nearpath.llm.wordcore import Tokens, slices

_U = np.uint64


@dataclass(frozen=True)
class JoinSetup:
    """Threshold ``num / den``; the filter's prefix is lengthened by ``lead`` percent of the set.

    ``bitmap_bits`` bounds the broadcast that marks documents passing the filter: collisions only let
    more documents pass.  ``heavy_tokens`` bounds the broadcast list of very frequent shingles.
    ``star_over`` is the frequency above which a shingle's documents are first tried with its hub;
    ``salt_over`` the number of entries of a shingle, or pairs of a hub, that a task takes at once.
    """

    words: int = 5
    num: int = 3
    den: int = 4
    lead: int = 10
    bitmap_bits: int = 1 << 27
    heavy_tokens: int = 500_000
    star_over: int = 8
    salt_over: int = 1024

    def least(self, n):
        return (self.num * n + self.den - 1) // self.den

    def overlap(self, n, m):
        """Shingles that linked sets of these sizes share at least."""
        return (self.num * (n + m) + self.num + self.den - 1) // (self.num + self.den)

    def matches(self, n):
        return 1 + n * self.lead // 100


def shingle_sets(w: Tokens, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle) sorted and distinct, set sizes and starts for a slice of documents."""
    at, h = w.windows(k)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, w.digests(w.first[short], w.first[short + 1])["x"]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        doc, h = doc[new], h[new]
    n = np.bincount(doc, minlength=len(w.count))
    return doc, h, n, np.r_[0, np.cumsum(n)]


def word_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()


class SetJoin:
    """Task-side work of the join."""

    def __init__(self, setup: JoinSetup, buckets: int, cells: int):
        self.setup, self.buckets, self.cells = setup, buckets, cells

    def info(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, offsets, raw in slices(_text(batch)):
                w = Tokens(raw, offsets, lower=True)
                n = shingle_sets(w, self.setup.words)[2]
                prints, some = np.zeros((to - at, 2), dtype=np.int64), np.flatnonzero(w.count)
                low, high = w.first[some], w.first[some + 1]
                high = np.where(n[some] == 1, np.minimum(low + self.setup.words, high), high)  # one shingle, however often
                prints[some] = w.digests(low, high).view(np.int64).reshape(-1, 2)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(n.astype(np.int64)), *map(pa.array, prints.T)], names=["doc_id", "tag", "n", "fp1", "fp2"])

    def prefixes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, once = self.setup, Once()
        for batch in batches:
            ids, tags = _columns(batch)
            for at, to, offsets, raw in slices(_text(batch)):
                doc, h, n, start = shingle_sets(Tokens(raw, offsets, lower=True), s.words)
                length = np.where(n > 1, np.minimum(n, n - s.least(n) + s.matches(n)), 0)
                in_prefix = np.arange(len(h)) - start[doc] < length[doc]
                doc, h = doc[in_prefix], h[in_prefix]
                order, first = _runs(h)
                number = np.cumsum(first) - 1
                many = np.bincount(number)[number] > 1
                own_ids, own_tags = ids[at:to], tags[at:to]
                single = np.sort(order[~many])
                yield from pack(_bucket(h[single], self.buckets), _QUERY, doc[single], own_ids, own_tags, h[single])
                mark = h[order[first & many]]
                mark = mark[once.new(mark)]
                yield from pack(_bucket(mark, self.buckets), _MARK, None, own_ids, own_tags, mark)
                hits = np.bincount(doc[order[many]], minlength=to - at)
                known = np.flatnonzero(hits)
                yield from pack(own_tags[known].astype(np.int64) % self.buckets, _ANSWER, known, own_ids, own_tags, hits[known].astype(np.uint32))

    def join_prefixes(self, table: pa.Table) -> pa.Table:
        asked, marked, known = Entries(table, _QUERY, (_U,)), Entries(table, _MARK, (_U,)), Entries(table, _ANSWER, (np.uint32,))
        key = asked.columns[0]
        order, first = _runs(key)
        number = np.cumsum(first) - 1
        repeated = np.isin(key[order], marked.columns[0])
        if len(key):
            repeated |= np.bincount(number)[number] > 1
        found = order[repeated]
        ids, tags = np.r_[asked.ids[found], known.ids], np.r_[asked.tags[found], known.tags]
        hits = np.r_[np.ones(len(found), np.int64), known.columns[0].astype(np.int64)]
        ids, tags, hits = self._summed(ids, tags, hits)
        cell = (tags % np.uint32(self.cells)).astype(np.int32)
        return pa.Table.from_batches(list(pack(cell, _ANSWER, np.arange(len(ids)), ids, tags, hits.astype(np.uint32))), schema=pa.schema(_PACKED_ARROW))

    @staticmethod
    def _summed(ids: np.ndarray, tags: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, first = _runs(ids, tags)
        at = np.flatnonzero(first)
        return ids[order[at]], tags[order[at]], np.add.reduceat(hits[order], at) if len(at) else hits[:0]

    def sum_hits(self, table: pa.Table) -> pa.Table:
        e = Entries(table, _ANSWER, (np.uint32,))
        ids, tags, hits = self._summed(e.ids, e.tags, e.columns[0].astype(np.int64))
        return pa.table({"doc_id": pa.array(ids), "tag": pa.array(tags.astype(np.int64)), "hits": pa.array(hits)})

    def sets(self, bitmap, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the documents that pass, with their texts; a task sends a repeated row once."""
        bits, once = np.frombuffer(bitmap.value, dtype=np.uint8), Once(1 << 16)
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            passing = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            if not len(passing):
                continue
            batch = batch.take(pa.array(passing))
            for at, to, offsets, raw in slices(_text(batch)):
                _, h, n, start = shingle_sets(Tokens(raw, offsets, lower=True), self.setup.words)
                part = batch.slice(at, to - at)
                some = np.flatnonzero((n > 1) & once.new(*_columns(part)))
                if len(some):
                    lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(h.view(np.int64)))
                    out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "tag", "text")), lists], names=["doc_id", "tag", "text", "toks"])
                    yield out.take(pa.array(some))

    @staticmethod
    def local_counts(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles that a partition holds ``least`` times or more."""
        tokens = [b.column("toks").flatten().to_numpy() for b in batches]
        if tokens:
            token, count = np.unique(np.concatenate(tokens), return_counts=True)
            many = count >= least
            yield pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(count[many].astype(np.int64))], names=["token", "df"])

    def entries(self, heavy, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_tokens, heavy_df = heavy.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                ids, tags = _columns(part)
                lists = part.column("toks")
                h = lists.flatten().to_numpy().view(_U)
                count = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(count)), count)
                if len(heavy_tokens):
                    place = np.minimum(np.searchsorted(heavy_tokens, h), len(heavy_tokens) - 1)
                    is_heavy = heavy_tokens[place] == h
                else:
                    place, is_heavy = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                size = count[doc].astype(np.uint32)
                light = np.flatnonzero(~is_heavy)
                yield from pack(_bucket(h[light], self.buckets), _QUERY, doc[light], ids, tags, h[light], size[light])
                own = np.flatnonzero(is_heavy)
                cell = (tags[doc[own]] % np.uint32(self.cells)).astype(np.int32)
                yield from pack(cell % self.buckets, _ANSWER, doc[own], ids, tags, h[own], size[own], heavy_df[place[own]].astype(np.uint32))

    def frequencies(self, table: pa.Table) -> pa.Table:
        asked, known = Entries(table, _QUERY, (_U, np.uint32)), Entries(table, _ANSWER, (_U, np.uint32, np.uint32))
        key, size = asked.columns
        order, first = _runs(key)
        number = np.cumsum(first) - 1
        df = np.bincount(number)[number] if len(key) else np.zeros(0, np.int64)
        many = df > 1
        found = order[many]
        ids, tags = np.r_[asked.ids[found], known.ids], np.r_[asked.tags[found], known.tags]
        columns = [np.r_[key[found], known.columns[0]], np.r_[size[found], known.columns[1]], np.r_[df[many].astype(np.uint32), known.columns[2]]]
        order = np.lexsort((tags, ids))
        ids, tags = ids[order], tags[order]
        owner = np.zeros(len(ids), np.int64)
        if len(ids):
            owner[1:] = np.cumsum((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))
        at = np.flatnonzero(np.diff(owner, prepend=-1))
        cell = (tags % np.uint32(self.cells)).astype(np.int32)
        return pa.Table.from_batches(list(pack(cell, _ANSWER, owner, ids[at], tags[at], *(c[order] for c in columns))), schema=pa.schema(_PACKED_ARROW))

    def choose(self, table: pa.Table) -> pa.Table:
        """Per document: n, l, shared shingles by frequency, their frequencies, length of the prefix."""
        e = Entries(table, _ANSWER, (_U, np.uint32, np.uint32))
        token, size, df = e.columns
        order = np.lexsort((token, df, e.tags, e.ids))
        ids, tags = e.ids[order], e.tags[order]
        token, size, df = token[order].view(np.int64), size[order].astype(np.int64), df[order].astype(np.int64)
        # repeated rows share id and tag: their shingles stand here once for each row
        once = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (token[1:] != token[:-1])]) if len(ids) else np.zeros(0, np.int64)
        ids, tags, token, size, df = ids[once], tags[once], token[once], size[once], df[once]
        at = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]) if len(ids) else np.zeros(0, np.int64)
        rows = []
        for low, high in zip(at.tolist(), np.r_[at[1:], len(ids)].tolist()):
            n = int(size[low])
            t = self.setup.least(n)
            shared = high - low
            if shared < t:
                continue
            work = np.r_[0, np.cumsum(df[low:high])]
            ell = np.arange(1, t + 1)
            prefix = np.minimum(np.maximum(n - t + ell - (n - shared), 0), shared)
            # costs are those of the likeliest partner, one of the same size
            likely = np.clip(shared - self.setup.overlap(n, n) + ell, 0, shared)
            candidates = (work[likely] - likely) / ell
            best = int(np.argmin(work[likely] + candidates * (n / 16)))
            rows.append((int(ids[low]), n, best + 1, int(prefix[best]), shared, float(work[-1]) / n, token[low:high], df[low : low + int(prefix[best])]))
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = (*[pa.int64()] * 5, pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({name: pa.array(list(c), t) for name, c, t in zip(("doc_id", "n", "ell", "prefix", "shared", "central", "toks", "dfs"), columns, kinds)})

    def verify(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose sets of shingles, taken from the texts, are similar enough."""
        num, den, k = self.setup.num, self.setup.den, self.setup.words
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"))):
                x, y = word_set(x.as_py(), k), word_set(y.as_py(), k)
                same = len(x & y)
                if same and den * same >= num * (len(x) + len(y) - same):
                    good.append(i)
            keep = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


_PACKED_ARROW = [("bucket", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("ids", "tags", "counts", "a", "b", "c")]]


def _contract(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links as stars around the smallest node of what they connect, ``limit`` links at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs) if pairs else ((), ()))], names=["u", "v"])

    held = 0
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            x, y = root(u), root(v)
            parent[max(x, y)] = min(x, y)
            held += 1
            if held % limit == 0:
                yield stars()
                parent.clear()
    yield stars()


def components(links: DataFrame, name: str = "links", at_once: int = 500_000) -> DataFrame:
    """(node, component) of every node with a link (a, b); component is the smallest node.

    Tasks first contract their own links, ``at_once`` at a time; if that was one task and one lot, the
    components are whole.  Otherwise rounds of large-star and small-star steps follow, each written to the
    shared folder.
    """
    plain = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = settled(plain, name, at_once)
    whole = edges.rdd.getNumPartitions() <= 1 and edges.count() < at_once
    edges = settled(edges.mapInArrow(tidy(lambda b: _contract(at_once, b)), "u long, v long"), name)
    signature = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = None if whole else signature(edges)
    while not whole:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = moved.groupBy("u").agg(F.min("v").alias("m"))
        moved = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = settled(moved, name)
        after = signature(edges)
        whole, before = after == before, after
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """Bits of the slots in ``keys``, put together block by block on the executors."""
    block = 1 << 18

    def fill(table: pa.Table) -> pa.Table:
        slot = table.column("slot").to_numpy()
        have = np.zeros(block, dtype=np.uint8)
        have[slot % block] = 1
        return pa.table({"block": pa.array([int(slot[0]) // block]), "bits": pa.array([np.packbits(have, bitorder="little").tobytes()])})

    rows = keys.select("slot").distinct().withColumn("block", F.expr(f"slot div {block}")).groupBy("block").applyInArrow(lambda t: fill(t), "block long, bits binary").collect()
    out = bytearray(max(bits, block) // 8)
    for r in rows:
        out[r.block * block // 8 : (r.block + 1) * block // 8] = r.bits
    return bytes(out)


def shingle_links(docs: DataFrame, setup: JoinSetup = JoinSetup(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(info, classes, links): set sizes and class marks of all rows, class representatives, and
    verified links between representatives that connect every group."""
    spark = docs.sparkSession
    n_parts = buckets_for(docs, text_col)
    job = SetJoin(setup, n_parts, n_parts)
    tag = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tag)
    info = cut(rows.mapInArrow(tidy(job.info), "doc_id long, tag long, n long, fp1 long, fp2 long"), "near-info")
    usable = info.filter("n > 0 AND doc_id IS NOT NULL")
    classes = settled(usable.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "tag")).alias("rep"), F.count("*").alias("copies")).select("fp1", "fp2", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.tag").alias("rep_tag"), "copies"), "near-classes")

    packed = rows.filter("doc_id IS NOT NULL").mapInArrow(tidy(job.prefixes), _PACKED_SQL)
    found = packed.groupBy("bucket").applyInArrow(lambda t: tidied(job.join_prefixes(t)), _PACKED_SQL)
    hits = found.groupBy("bucket").applyInArrow(lambda t: tidied(job.sum_hits(t)), "doc_id long, tag long, hits long")
    need = F.expr(f"1 + (({setup.num} * n + {setup.den - 1}) div {setup.den}) * {setup.lead} div 100")
    passing = settled(hits.join(classes, (F.col("doc_id") == F.col("rep")) & (F.col("tag") == F.col("rep_tag"))).filter(F.col("hits") >= need).select("doc_id", "tag", "n"), "near-passing")
    count, tokens = passing.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(setup.bitmap_bits, max(1 << 18, 1 << int(64 * count).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(bits)).alias("slot")
    bitmap = spark.sparkContext.broadcast(_bitmap(passing.select(slot), bits))
    few = rows.filter("doc_id IS NOT NULL").select("doc_id", "text", "tag", slot).mapInArrow(tidy(lambda b: job.sets(bitmap, b)), "doc_id long, tag long, text string, toks array<bigint>")
    if count > bits // 8:  # too many for the bitmap to tell apart; the same result either way
        few = few.join(passing.select("doc_id", "tag"), ["doc_id", "tag"], "left_semi")
    if not info.groupBy("doc_id", "tag").count().filter("doc_id IS NOT NULL AND count > 1").isEmpty():
        few = few.dropDuplicates(["doc_id", "tag"])
    sets = cut(few, "near-sets")

    parts = max(1, sets.rdd.getNumPartitions())
    heavy_df = max(256, 4 * parts, 2 * tokens // setup.heavy_tokens)
    local = max(2, heavy_df // (2 * parts))
    heavy = sets.mapInArrow(tidy(lambda b: job.local_counts(local, b)), "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= heavy_df // 2).toArrow()
    token, df = (np.asarray(heavy.column(c).to_numpy(), dtype=np.int64) for c in ("token", "df"))
    order = np.argsort(token.view(_U))
    listed = (token.view(_U)[order], df[order] + heavy_df)
    held = spark.sparkContext.broadcast(listed)
    entries = sets.mapInArrow(tidy(lambda b: job.entries(held, b)), _PACKED_SQL)
    answers = entries.groupBy("bucket").applyInArrow(lambda t: tidied(job.frequencies(t)), _PACKED_SQL)
    chosen = cut(answers.groupBy("bucket").applyInArrow(lambda t: tidied(job.choose(t)), "doc_id long, n long, ell long, prefix long, shared long, central double, toks array<bigint>, dfs array<bigint>"), "near-chosen")

    zipped = F.arrays_zip(F.slice("toks", 1, F.col("prefix").cast("int")).alias("token"), F.col("dfs").alias("df"))
    plain = ("doc_id", "n", "ell", "shared", "central")
    posts = chosen.filter("prefix > 0").select(*plain, F.posexplode(zipped).alias("i", "z")).select(*plain, "z.token", "z.df", (F.col("n") - F.col("shared") + F.col("i")).alias("place"))
    texts = sets.select("doc_id", "text")

    def fits(x: str, y: str) -> F.Column:
        """Sizes n and numbers of shared shingles that allow a link."""
        least = F.least(F.col(x + "shared"), F.col(y + "shared"))
        return (setup.num + setup.den) * least >= setup.num * (F.col(x + "n") + F.col(y + "n"))

    def dealt(entries: DataFrame) -> DataFrame:
        """One of the salts of its shingle for each entry."""
        return entries.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / setup.salt_over)))

    def spread(per_token: DataFrame) -> DataFrame:
        """A row for every salt of its shingle."""
        return per_token.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("df") / setup.salt_over) - 1))).drop("df")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs of a and b that are links; a, the hub of a star, may have very many."""
        pairs = settled(pairs, "near-candidates")
        many = pairs.groupBy("a").count().filter(F.col("count") > max(setup.salt_over, pairs.count() // 10_000))
        many = F.broadcast(many.select(F.col("a").alias("hub"), F.ceil(F.col("count") / setup.salt_over).alias("parts")))  # at most 10,000 rows
        salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0).cast("long"))
        left = texts.join(many, F.col("doc_id") == F.col("hub"), "left").select(F.col("doc_id").alias("x"), F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part"))
        right = texts.select(F.col("doc_id").alias("y"), F.col("text").alias("tb"))
        asked = pairs.join(many, F.col("a") == F.col("hub"), "left").select("a", "b", salt.alias("salt"))
        both = asked.join(right, F.col("b") == F.col("y")).join(left, (F.col("a") == F.col("x")) & (F.col("salt") == F.col("part")))
        return both.select("a", "b", "ta", "tb").mapInArrow(tidy(job.verify), "a long, b long")

    def labelled(links: DataFrame, name: str) -> DataFrame:
        found = components(links, name)
        return settled(posts.join(found, F.col("doc_id") == F.col("node"), "left").select(*plain, "token", "df", "place", F.coalesce("component", "doc_id").alias("comp")), name)

    def stars(own: DataFrame) -> DataFrame:
        """One pair a document: itself and the hub that it shares the most frequent shingles with."""
        often = own.filter(F.col("df") > setup.star_over)
        hubs = often.groupBy("token").agg(F.max(F.struct("central", "doc_id", "n", "shared", "comp")).alias("h"), F.max("df").alias("df"))
        hubs = hubs.select("token", "df", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("hn"), F.col("h.shared").alias("hshared"), F.col("h.comp").alias("hcomp"))
        met = dealt(often).join(spread(hubs), ["token", "salt"]).filter("comp <> hcomp").filter(fits("", "h")).groupBy("hub", "doc_id").count()
        return met.groupBy("doc_id").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub")).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))

    def mixed_runs(own: DataFrame) -> DataFrame:
        """Entries of shingles that more than one component holds, and the main component of each."""
        runs = own.groupBy("token").agg(F.max(F.struct("central", "doc_id", "comp")).alias("h"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("df").alias("df"))
        return dealt(own).join(spread(runs.filter("low <> high").select("token", "df", F.col("h.comp").alias("main"))), ["token", "salt"])

    links = settled(verified(stars(posts.withColumn("comp", F.col("doc_id")))), "near-stars")
    own = labelled(links, "near-first")
    tidy_driver(spark)
    links = links.union(settled(verified(stars(mixed_runs(own).filter("comp <> main"))), "near-stars"))
    own = labelled(links, "near-second")

    # with the overlap that the two sizes ask for, only entries this early count
    overlap = f"(({setup.num} * (xn + yn) + {setup.num + setup.den - 1}) div {setup.num + setup.den})"
    in_reach = F.expr(f"xplace < xn - {overlap} + least(xell, yell) AND yplace < yn - {overlap} + least(xell, yell)")
    members = mixed_runs(own)
    as_side = lambda df, side: df.select("token", "main", "df", "salt", *[F.col(c).alias(side + c) for c in ("doc_id", "n", "ell", "shared", "comp", "place")])
    x, y = as_side(members.filter("comp <> main"), "x").drop("main", "df"), spread(as_side(members, "y").drop("salt"))
    on = [x["token"] == y["token"], x["salt"] == y["salt"], F.col("xcomp") != F.col("ycomp"), (F.col("ycomp") == F.col("main")) | (F.col("xdoc_id") < F.col("ydoc_id")), fits("x", "y"), in_reach]
    met = x.join(y, on).select(F.least("xdoc_id", "ydoc_id").alias("a"), F.greatest("xdoc_id", "ydoc_id").alias("b"), F.least("xell", "yell").alias("ell"))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("ell").alias("ell")).filter("shared >= ell").select("a", "b")
    second = settled(verified(pairs), "near-pairs")
    tidy_driver(spark)
    return info, classes, links.union(second)


def near_groups(docs: DataFrame, setup: JoinSetup = JoinSetup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, copies (rows with the same words)."""
    info, classes, links = shingle_links(docs, setup, id_col, text_col)
    groups = components(links, "near-groups")
    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select(F.col("fp1").alias("k1"), F.col("fp2").alias("k2"), F.col("n").alias("kn"), F.coalesce("component", "rep").alias("group"), "copies")
    out = info.join(named, (F.col("fp1") == F.col("k1")) & (F.col("fp2") == F.col("k2")) & (F.col("n") == F.col("kn")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id")).alias("component_id"), "copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id (null last), all columns as they came.

    Rows are judged, not ids: rows that repeat an id, or have none, stand for themselves, and of rows
    alike in all columns one stays.  Texts without words are in no group, and all of them stay.
    """
    node, = unused_names(docs, "node")
    rows = docs.withColumn(node, row_key(docs))
    keyed = rows.select(F.col(node).alias("node"), F.col("doc_id").cast("long").alias("id"), "text")
    groups = near_groups(keyed, id_col="node")
    named = cut(groups.filter("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id").distinct().join(keyed.select("node", "id").distinct(), "node"), "near-named")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("f")).select("f.node")
    gone = named.select("node").join(first, "node", "left_anti").select(F.col("node").alias(node))
    left = rows.join(gone, node, "left_anti")
    if not keyed.groupBy("node").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([node])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op4_ngram_jaccard": op4_ngram_jaccard}
ORACLES = {
    "op4_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT p.y, r.root FROM r JOIN p ON r.node = p.x),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s LEFT JOIN c ON doc_id = node
"""
}
