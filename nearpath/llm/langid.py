"""Language ID by compression: the language whose dictionary makes the text smallest.

``fit`` takes, per language, a bounded sample of labelled rows (whole texts in the order of a hash of
their ids, at most ``sample_rows`` rows) as a zstandard raw-content dictionary of at most
``dictionary_bytes`` bytes.  One scan draws the samples of all languages; each language's dictionary is
put together by a task of its own, and only dictionaries reach the driver.  ``identify`` reduces a whole text to its lower-case letter runs, compresses it in
blocks with every dictionary and adds up the sizes.  A margin below ``margin_bits`` bits a byte
marks the answer as rejected.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; equal
sizes go to the language that sorts first; without labelled rows everything is ``und``; very long
texts are compressed block by block; rows are judged alone, so repeated rows agree.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm.common import documents, tidied, tidy

UNDETERMINED = "und"
_BLOCK = 16 << 10


@dataclass(frozen=True)
class Setup:
    sample_rows: int = 400
    dictionary_bytes: int = 64 << 10
    level: int = 6
    margin_bits: float = 0.05


#: ``\w`` also takes numbers that are no digits, such as one half; those of Latin-1 are named here.
_NOT_LETTERS = re.compile(r"[\W\d_²³¹¼-¾]+")
_BEYOND_LATIN = re.compile("[^\x00-\u02ff]")


@functools.cache
def _numbers() -> dict[int, str]:
    """The others, as spaces; there are none from U+0100 to U+02FF."""
    return {c: " " for c in range(0x300, sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha()}


def letters(text: str) -> bytes:
    text = text.lower()
    if _BEYOND_LATIN.search(text):
        text = text.translate(_numbers())
    return _NOT_LETTERS.sub(" ", text).strip().encode()


def fit(labelled: DataFrame, setup: Setup = Setup(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """language -> dictionary bytes, of every language in the table."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return {}
    # a hash threshold keeps about twice the wanted rows of a language before the exact cut
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 40)).alias("draw")
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1 << 40, int((1 << 40) * 2 * setup.sample_rows / n) + 1)))])
    few = rows.select(F.col(lang_col).alias("lang"), draw, F.col(text_col).alias("text")).filter(F.col("draw") < share[F.col("lang")])

    def dictionary(table: pa.Table) -> pa.Table:
        found = bytearray()
        for row in table.sort_by([("draw", "ascending"), ("text", "ascending")]).slice(0, setup.sample_rows).column("text"):
            if len(found) >= setup.dictionary_bytes:
                break
            found += letters(row.as_py()) + b" "
        return pa.table({"lang": table.column("lang").slice(0, 1), "content": pa.array([bytes(found[: setup.dictionary_bytes])])})

    made = few.groupBy("lang").applyInArrow(lambda t: tidied(dictionary(t)), "lang string, content binary").collect()
    return {r.lang: bytes(r.content) for r in sorted(made, key=lambda r: r.lang) if len(r.content) >= 8}


@functools.lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...], level: int):
    import zstandard

    out = []
    for lang, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def judge(text: str | None, compressors, margin_bits: float) -> tuple[str, float, bool]:
    """(language, score, rejected); the score is the best language's share if a byte is one bit."""
    raw = letters(text) if text else b""
    if not raw or not compressors:
        return UNDETERMINED, 0.0, True
    blocks = [raw[a : a + _BLOCK] for a in range(0, len(raw), _BLOCK)]
    sizes = [(sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors]
    best, lang = min(sizes)
    score = 1.0 / sum(2.0 ** -min(60, s - best) for s, _ in sizes)
    second = min((s for s, other in sizes if other != lang), default=best + len(raw))
    return lang, score, 8 * (second - best) < margin_bits * len(raw)


def identify(docs: DataFrame, model: dict[str, bytes], setup: Setup = Setup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    frozen, level, margin = tuple(sorted(model.items())), setup.level, setup.margin_bits

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(frozen, level)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [judge(t, compressors, margin) for t in part.column(1).to_pylist()]
                lang, score, rejected = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(id_col: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_language": op2_language}
ORACLES: dict[str, str] = {}
