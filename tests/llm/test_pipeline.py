"""The pipeline's stages against plain versions, and the registered SQL."""

import collections
import glob
import os

import duckdb
import pytest

import corpus_pipeline
from nearpath.llm import registry
from tests.test_entry import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows_of(registry.queries()[name](spark, SF).toPandas()) == rows_of(con.sql(registry.oracle_sql()[name]).df())


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.dtypes == docs.dtypes
        kept[name] = (docs.collect(), after.collect())
        docs = after
    ids = lambda rows: collections.Counter(r.doc_id for r in rows)
    for name in ("toxicity", "exact_dedup", "near_dedup"):
        before, after = kept[name]
        assert ids(after) <= ids(before)
    before, after = kept["exact_dedup"]
    norm = lambda t: " ".join(("x" + (t or "") + "x").split())
    owners = {}
    for r in before:
        owners[norm(r.text)] = min(r.doc_id, owners.get(norm(r.text), r.doc_id))
    assert set(ids(after)) == set(owners.values())
    before, after = kept["mix"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 3
    before, after = kept["encode"]
    assert ids(after) == ids(before) and all(len(r.ids_sha256) == 64 for r in after)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated and missing ids, empty texts, clashing names: each stage against a plain version of it."""
    import hashlib
    import random
    import re

    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from nearpath.llm import mixing, toxicity
    from nearpath.llm.common import row_key
    from tests.llm.test_corpus import SCHEMA, make_rows
    from tests.llm.test_exactness import plain_scores

    rng = random.Random(3)
    rows = make_rows()
    rows += [(5, "another text of the same id", "en", "s0", 0, None, 1, "a"), (5, rows[20][1], "en", "s1", 0, None, 1, "a"), (None, rows[20][1] + " x", None, None, None, None, None, None), rows[12], rows[12]]
    rows += [(1000 + i, " ".join(rng.choices("the of stone light river".split(), k=20)) + (" vilest" if i % 3 == 0 else f" n{i}"), "en", "s0", 1, True, 1, "z") for i in range(60)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000 + i, None, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, columns = [list(map(tuple, docs.collect()))], docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        if name == "near_dedup":
            assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "mix":
            mixed = {r.k: (r.size, r.taken) for r in mixing.mix(docs.withColumn("k", row_key(docs)), id_col="k").withColumnRenamed("doc_id", "k").collect()}
            keyed = [(r.k, tuple(r)[:-1]) for r in docs.withColumn("k", row_key(docs)).collect()]
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or n == 4
        kept.append(list(map(tuple, docs.collect())))
    count = collections.Counter

    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = plain_scores([r[1] for r in kept[0]], model)
    assert count(kept[1]) == count(r for r, s in zip(kept[0], scores) if s < 0.5) and any(s >= 0.5 for s in scores)

    owners = {}
    for r in kept[1]:
        owners.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    by_id = lambda r: (r[0] is None, r[0] or 0)
    left = count(kept[2])
    assert sum(left.values()) == len(owners) and left <= count(kept[1])
    assert all(min(map(by_id, group)) in [by_id(r) for r in group if left[r]] and sum(left[r] for r in set(group)) == 1 for group in owners.values())

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, group = [shingles(r[1]) for r in kept[2]], list(range(len(kept[2])))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    linked = collections.defaultdict(list)
    for i, r in enumerate(kept[2]):
        linked[find(i)].append(r)
    left = count(kept[3])
    assert sum(left.values()) == len(linked) < len(kept[2])
    assert all(sum(left[r] for r in rs) == 1 and min(map(by_id, rs)) in [by_id(r) for r in rs if left[r]] for rs in linked.values())

    want = count()
    for k, r in keyed:
        size, taken = mixed[k]
        want[r] += int(taken / max(size, 1) + 0.5)
    assert count(kept[4]) == +want

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    encoded = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids) for r in kept[4]]
    assert count(kept[5]) == count((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))) for i, ids in encoded)


def test_driver_is_tidy_before_it_trains(spark, monkeypatch):
    """What reading the sample took is given back before the training takes its own."""
    from nearpath.llm import toxicity

    done = []
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(8)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "tidy_driver", lambda session: done.append("tidy"))
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, setup: done.append(sorted(zip(texts, toxic))))
    toxicity.fit(docs, marks)
    kept = [i for i, out in docs.select("doc_id", toxicity.held_out(docs.doc_id)).collect() if not out]
    assert done == ["tidy", sorted((f"some words {i}", i % 2) for i in kept), "tidy"]


def test_driver_heap_is_given_back(spark):
    """After tidying, the JVM holds little more heap than it uses; its settings are as before."""
    import subprocess

    from nearpath.llm.common import tidy_driver

    jvm = spark._jvm
    runtime, pid = jvm.java.lang.Runtime.getRuntime(), str(jvm.java.lang.ProcessHandle.current().pid())
    flags = lambda: sorted(x.split("{")[0] for x in subprocess.run(["jcmd", pid, "VM.flags", "-all"], capture_output=True, text=True).stdout.splitlines() if "HeapFreeRatio" in x)
    before = flags()
    held = spark.sparkContext._gateway.new_array(jvm.byte, 600, 1 << 20)  # a heap that has grown
    spark.sparkContext._gateway.detach(held)
    del held
    tidy_driver(spark)
    assert runtime.freeMemory() < 0.3 * runtime.totalMemory() + (24 << 20)
    assert flags() == before and len(before) == 2


def test_training_keeps_little_of_its_texts():
    """A vocabulary over many slices equals that of one slice, and holds one slice's arrays at a time."""
    import random
    import tracemalloc

    import numpy as np

    from nearpath.llm import toxicity, wordcore

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=1500)) for _ in range(700)]
    setup, size = toxicity.FitSetup(), sum(len(t.encode()) for t in texts)
    assert size > 6 * wordcore.SLICE_BYTES
    toxicity.Vocabulary.of_texts(texts[:200], setup)  # tables of powers, kept by the process
    tracemalloc.start()
    many = toxicity.Vocabulary.of_texts(texts, setup)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * size
    one = toxicity.Vocabulary(*wordcore.text_buffers(toxicity.pa.array(texts)), setup)
    for name in ("distinct", "at", "word_slot", "edge", "char_slot"):
        assert np.array_equal(getattr(many, name), getattr(one, name))
    assert np.array_equal(many.words.count, one.words.count) and np.array_equal(many.words.first, one.words.first)
