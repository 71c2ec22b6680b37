"""Cases that once went wrong, and plain versions of what no SQL expresses."""

import collections
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearpath.llm import bpe, exactdedup, langid, mixing, neardup, pii, quality, substring, tokenfile, toxicity
from nearpath.llm.common import noted, sweep

WORDS = "the of and le la und der que house river stone light table green mountain window".split()


# BPE

def word_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return bpe.WordBpe(path, bpe.compile_lexicon(WORDS, path)), lambda t: library.encode(t, add_special_tokens=False).ids


def test_bpe_every_code_point():
    own, library = word_tokenizers()
    wrong = [hex(c) for c in range(1, 0x3000) for t in [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}' {chr(c)}'s x{chr(c)}"] if own.encode(t).tolist() != library(t)]
    assert not wrong


def test_bpe_mixed_scripts():
    own, library = word_tokenizers()
    rng = random.Random(21)
    pieces = ["don't", "of", "—", " ", "Ⱥw", "Ⱦ", "é", "é", "中文", "Σας", "'s", "'ll", "“", "1²½", "<|endoftext|>", "<|x", "　", "\x1c", "İ", "\n", "한글", "\U0001f600", *WORDS]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 15)))
        assert own.encode(t).tolist() == library(t), t


def test_bpe_memo_is_bounded():
    own, library = word_tokenizers()
    t = "中" * 5000 + " " + "q" * 300
    assert own.encode(t).tolist() == library(t)
    assert max(map(len, own.memo), default=0) <= bpe.MEMO_CHARS and max(map(len, own.chunks), default=0) <= bpe.MEMO_CHARS


def test_bpe_lexicon_leaves_very_long_words(spark):
    docs = spark.createDataFrame([(1, "ab " + "y" * 500), (2, "ab " + "y" * 500), (3, None)], "doc_id long, text string")
    assert bpe.frequent_words(docs) == ["ab"]


# languages

def test_language_sizes_recomputed(spark):
    """Labels, scores and margins from whole-text compression without the operator's code."""
    rng = random.Random(3)
    lex = {"aa": "ka ra to mi su ne".split(), "bb": "blor wex ild grun fesk ohm".split(), "cc": "zin kel mur tos".split()}
    rows = [(i, " ".join(rng.choice(lex[l]) + rng.choice(lex[l]) for _ in range(rng.randint(1, 60))), l, "x", 1.5) for i, l in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(500, "Ka-ra ½ ① " + "tomi suNE 12 " * 6000, None, None, None), (501, "½ ² ① Ⅷ 12 !", "aa", None, None), (502, "blorwex", "bb", None, None), (502, "blorwex", "bb", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(docs.filter("doc_id < 60"))
    got = [tuple(r) for r in langid.identify(docs, model).collect()]

    def plain(text):
        raw = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
        if not raw:
            return "und", 0.0, True
        size = {}
        for lang, content in model.items():
            size[lang] = 0
            for at in range(0, len(raw), 1 << 14):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c = zstandard.ZstdCompressor(dict_data=d, level=6, write_content_size=False, write_checksum=False, write_dict_id=False)
                size[lang] += len(c.compress(raw[at : at + (1 << 14)]))
        best = min(size, key=lambda l: (size[l], l))
        others = sorted(s for l, s in size.items() if l != best)
        return best, 1 / sum(2.0 ** -min(60, s - size[best]) for s in size.values()), 8 * (others[0] - size[best]) < 0.05 * len(raw)

    assert collections.Counter(got) == collections.Counter((r[0], *plain(r[1])) for r in rows)


def test_language_dictionaries_hold_whole_texts(spark):
    texts = [(i, "anfang " * 3 + f"w{'abcdefghij'[i % 10]} " * 4000 + "ende", "de") for i in range(3)]
    model = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"), langid.Setup(dictionary_bytes=1 << 20))
    assert model["de"].count(b"ende") == 3


# token files and rules

def test_token_files_order_of_repeated_ids(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", *[" ".join(rng.choices(WORDS, k=k)) for k in range(1, 9)]])) for _ in range(300)]
    starts = []
    for n in (1, 2):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n * 3)
        tokenfile.write_tokens(docs, str(tmp_path / str(n)), partitions=5)
        found = tokenfile.read_tokens(spark, str(tmp_path / str(n))).orderBy("start").collect()
        starts.append([tuple(r) for r in found])
        rng.shuffle(rows)
    assert starts[0] == starts[1]
    assert [r[0] for r in starts[0]] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    assert collections.Counter((r[0], r[2], r[3]) for r in starts[0]) == collections.Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids))


def token_encoders():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return tokenfile.LibraryEncoder(path), lambda t: np.asarray(library.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes()


def test_token_files_split_as_the_library(monkeypatch):
    own, library = token_encoders()
    monkeypatch.setattr(tokenfile, "MEMO_PIECES", 40)
    rng = random.Random(23)
    plain = ["don't", "'s", "'re", "'ve", "'ll", "'d", "'", "''", "r", "e", "l", "s", "t", " ", "  ", "\n", "\t", "\r\n", "é", "ʯ", "ª", "×", "²", "½", "9", "12", "!", "?!", "¡", "\u00ad", "x" * 90, *WORDS]
    rare = ["ʰ", "\u00a0", "\u0085", "—", "中", "<|endoftext|>", "<|x", "\x0b", "\x1c", "\x00", "\x7f", "\U0001f600"]
    for n in range(600):
        pool = plain + rare * (n % 3 == 0)
        texts = [rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 9))]
        monkeypatch.setattr(tokenfile, "SPLIT_BYTES", rng.choice([1, 8, 40, 4 << 20]))
        column = pa.array(["xé's", None, *texts], rng.choice([pa.string(), pa.large_string()])).slice(2)
        assert list(own.encode_all(column)) == list(map(library, texts)), texts
    own, _ = token_encoders()
    texts = [t for c in map(chr, range(1, 0x800)) for t in (f"a{c}b 1{c}2 {c}{c}' {c}'s x{c}", f"{c}'ll{c} {c}\n {c}")]
    assert [t for t, ids in zip(texts, own.encode_all(pa.array(texts))) if ids != library(t)] == []


def test_token_files_work_grows_with_distinct_pieces(monkeypatch):
    own, library = token_encoders()
    rng = random.Random(29)
    texts = [" ".join(rng.choices([f"{a}{b}" for a in WORDS for b in WORDS], k=400)) for _ in range(200)]
    looked_up, calls, packed, model = [], [], own._packed, own._model
    monkeypatch.setattr(own, "_packed", lambda pieces: looked_up.extend(pieces) or packed(pieces))
    monkeypatch.setattr(own, "_model", lambda block: calls.append(block) or model(block))
    assert list(own.encode_all(pa.array(texts))) == list(map(library, texts))
    distinct = {p for t in texts for p in (t.split()[0], *(f" {w}" for w in t.split()[1:]))}
    assert len(looked_up) == len(distinct) and len(calls) <= len(distinct) // tokenfile.MODEL_PIECES + 1
    own.apart = None  # as for a tokenizer that merges the byte which keeps pieces apart
    own.memo.clear()
    assert list(own.encode_all(pa.array(texts[:9]))) == list(map(library, texts[:9]))


def test_rule_without_bounds_breaks_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert quality.score_quality(docs, (quality.Rule("none", "n_words"),)).select(F.size("broken")).first()[0] == 0


# words compared as words

def twins(n=2048):
    """Two words of n letters that polynomial hashes modulo 2**64 take for one (Thue-Morse)."""
    bit = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bit), "".join("ba"[b] for b in bit)


def test_substring_tells_words_apart(spark):
    head = " ".join(f"w{i}" for i in range(34))
    x, y = twins()
    docs = spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(docs).collect()] == [0, 0]
    again = docs.union(docs.filter("doc_id = 2"))
    assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(again).collect()) == [(1, 0), (2, 35), (2, 35)]


def test_substring_of_passages_entered_and_left_anywhere(spark):
    """Copies that begin and end at any word of a few passages, in one slice or many."""
    rng = random.Random(40)
    span, kmer = 9, 4
    passages = [[f"p{k}w{rng.randint(0, 30)}" for _ in range(60)] for k in range(6)]
    texts = []
    for i in range(500):
        w = []
        for _ in range(rng.randint(1, 3)):
            p, a = rng.choice(passages), rng.randint(0, 50)
            w += p[a : a + rng.randint(3, 30)] + [f"x{i}y{j}" for j in range(rng.randint(0, 4))]
        texts.append(" ".join(w))
    # few copies a stretch: most nodes do not branch
    texts += [" ".join([f"q{i // 2}w{j}" for j in range(rng.randint(0, 12), 40 - rng.randint(0, 12))]) for i in range(300)]
    texts += [" ".join([f"q{i}w{j}" for j in range(a, a + 14)]) for i in range(0, 150, 3) for a in (rng.randint(0, 20),)]
    rng.shuffle(texts)
    split = [t.split() for t in texts]
    count = collections.Counter(tuple(w[k : k + span]) for w in split for k in range(len(w) - span + 1))
    want = {}
    for i, w in enumerate(split):
        gone = set()
        for k in range(len(w) - span + 1):
            if count[tuple(w[k : k + span])] > 1:
                gone.update(range(k, k + span))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 16):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs.repartition(parts), span, kmer).collect()}
        assert got == want


def test_near_groups_tell_words_apart(spark):
    x, y = twins()
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x} a b c d"), (4, f"{y} a b c d"), (5, x.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_groups(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_sets_are_equal_though_texts_differ(spark):
    texts = ["a a a a a", "A a a a a a a", "a a a a", "b c d e f b c d e f b c", "c d e f b c d e f b c d e f", "b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(docs).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (5, 3), 4: (5, 3), 5: (1, 5)}


def test_hubs_and_shingles_are_salted(spark):
    """Tiny salts give the same groups."""
    rng = random.Random(6)
    base = [f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(docs, neardup.JoinSetup(salt_over=s)).collect()} for s in (1, 7, 1024)]
    assert found[0] == found[1] == found[2]


# rows, not ids

ROWS = [
    (1, "same text here", "a", 1), (5, "same  text here", "a", 1), (5, "a different text", "b", 2), (None, "no id", "a", 3), (None, "no\tid", None, 3),
    (None, "same text here", "c", 4), (7, None, None, None), (8, "", None, None), (9, "twice", "a", 5), (9, "twice", "a", 5), (9, "twice", "b", 5),
]
SCHEMA = "doc_id long, text string, source string, key long"


def test_drop_copies_judges_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    left = exactdedup.drop_copies(docs)
    got = collections.Counter((r.doc_id, r.text) for r in left.collect())
    assert left.columns == docs.columns and got[5, "a different text"] == 1 and got[1, "same text here"] == 1 and got[9, "twice"] == 1
    assert got[7, None] == 1 and got[8, ""] == 0 and got[5, "same  text here"] == 0 and got[None, "same text here"] == 0
    assert got[None, "no id"] + got[None, "no\tid"] == 1 and sum(got.values()) == 5
    assert exactdedup.drop_copies(docs.limit(0)).count() == 0


def test_exact_dedup_with_large_groups(spark):
    rows = [(i if i % 7 else None, ("most common text" if i % 3 else "  ") if i % 5 else f"text {i}") for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for largest in (1, 5_000):
        got = collections.Counter(map(tuple, exactdedup.exact_dedup(docs, largest=largest).select("doc_id", "keep_id", "group_size", "kept").collect()))
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[t.strip()].append(i)
        first = {t: min(i for i in ids if i is not None) if any(ids) else None for t, ids in groups.items()}
        assert got == collections.Counter((i, first[t.strip()], len(groups[t.strip()]), i is not None and i == first[t.strip()]) for i, t in rows)


def test_keep_one_judges_rows(spark):
    say = lambda k: " ".join(f"{WORDS[j % 15]}{j * k}" for j in range(60))
    a, b = say(3), say(5)
    near = a.replace("the0", "The0 more")
    rows = [(4, a, "x", 1), (2, near, "x", 1), (2, b, "x", 1), (None, a.upper(), "x", 1), (None, b + " end", "x", 1), (None, None, "x", 1), (None, "", "x", 2), (6, say(7), "x", 1), (6, say(7), "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, component_id long")
    left = neardup.keep_one(docs)
    assert left.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter([(2, near), (2, b), (None, None), (None, ""), (6, say(7))])
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_resample_repeats_rows(spark):
    rows = [(1, "a b c d e f", "s", 0), (1, "g", "s", 0), (None, "h i", "s", 0), (None, "j k l", None, 0), (2, None, "s", 0), (3, "m n", "t", 1), (3, "m n", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times long")
    found = mixing.resample(docs)
    got = collections.Counter(map(tuple, found.collect()))
    assert found.columns == docs.columns and set(got) <= set(rows) and (2, None, "s", 0) not in got
    taken = collections.Counter()
    for r in mixing.mix(docs.withColumn("key", F.xxhash64("doc_id", "text", "source", "times"))).collect():
        taken[r.source] += r.taken
    assert mixing.resample(docs.limit(0)).count() == 0 and max(got.values()) <= 6


def test_drop_toxic_judges_rows(spark):
    rng = random.Random(6)
    say = lambda n: [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]
    rows, marks = [], []
    for i in range(200):
        w, bad = say(rng.randint(5, 50)), i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = "vilest"
        rows.append((i, " ".join(w), 0.1))
        marks.append((i, int(bad)))
    odd = [(1000, "so vilest here", 1.0), (1000, " ".join(say(20)), 1.0), (None, "you vilest one", None), (None, None, None), (1001, "", None)]
    docs, labels = spark.createDataFrame(rows + odd, "doc_id long, text string, score double"), spark.createDataFrame(marks, "doc_id long, toxic int")
    left = toxicity.drop_toxic(docs, labels)
    got = collections.Counter(map(tuple, left.collect()))
    assert left.schema == docs.schema and [got[r] for r in odd] == [0, 1, 0, 1, 1]
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows) + len(odd)


def test_intermediates_are_swept(spark):
    before = len(noted(spark))
    neardup.near_groups(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    paths = noted(spark)[before:]
    sweep(spark, before)
    path = spark._jvm.org.apache.hadoop.fs.Path
    assert paths and noted(spark)[before:] == [] and not any(path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p)) for p in paths)


# toxicity

def plain_scores(texts, model):
    """Scores by loops over words, characters and steps, without the operator's arrays."""
    s, p, low = model.setup, model.params, 2**64 - 1
    from nearpath.llm import wordcore

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & low
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & low
        return x ^ (x >> 31)

    def hashed(piece):
        total, power = 0, 1
        for b in piece:
            total, power = (total + int(wordcore._LOWER[b]) * power) & low, power * wordcore._ROOT & low
        return mixed(total)

    def char_slots(word):
        found = [(word[:n], n) for n in range(3, 9) if len(word) >= n] + [(word[-n:], 16 + n) for n in (3, 5) if len(word) >= n]
        found += [(word[at : at + 4], 32) for at in range(1, 24) if len(word) >= at + 4]
        return [((hashed(piece) * 0x9E3779B97F4A7C15 + salt * 0x632BE59BD9B4E019 & low) >> 40) % s.char_slots for piece, salt in found]

    def vector(word):
        v, slots = p["Ew"][(hashed(word) >> 33) % s.word_slots].astype(float), char_slots(word)
        return v + sum(p["Ec"][c].astype(float) for c in slots) / len(slots) if slots else v

    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(d, xs):
        h, out = np.zeros(s.hidden), []
        for x in xs:
            a = x @ p[f"W{d}"] + p[f"b{d}"]
            zr = sigmoid(a[: 2 * s.hidden] + h @ p[f"U{d}"])
            z, r = zr[: s.hidden], zr[s.hidden :]
            h = h + z * (np.tanh(a[2 * s.hidden :] + (r * h) @ p[f"V{d}"]) - h)
            out.append(h)
        return out

    def window(words):
        xs = [vector(w) for w in words]
        H = [np.concatenate(t) for t in zip(states("f", xs), states("b", xs[::-1])[::-1], xs)]
        weight = np.exp([np.tanh(h @ p["Wa"] + p["ba"]) @ p["va"] for h in H])
        return sum(w * h for w, h in zip(weight / weight.sum(), H)) @ p["wo"] + p["bo"][0]

    out = []
    for t in texts:
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t or "").encode().split(b" ")
        words = [w for w in words if w]
        starts = [0]
        while starts[-1] + s.window < len(words):
            starts.append(starts[-1] + s.stride)
        out.append(sigmoid(max(window(words[a : a + s.window]) for a in starts) - model.shift) if words else 0.0)
    return out


def test_toxicity_scores_by_a_plain_network():
    setup = toxicity.FitSetup(embed=5, hidden=3, attend=4, word_slots=64, char_slots=128, window=8, stride=6)
    params = {k: v * 3 for k, v in toxicity.Network.initial(setup).p.items()}
    model = toxicity.Model(params, setup, 0.2)
    rng = random.Random(13)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ingly", "-Ü9", "!"]) for _ in range(n)) for n in (1, 5, 8, 9, 14, 15, 40, 200)] + ["", None, "?! .", "A B\tc\nLONGestWordOfAllTheWordsThatThereAre é"]
    got = model.score(*toxicity.slices.__globals__["text_buffers"](toxicity.pa.array(texts)))
    assert np.allclose(got, plain_scores(texts, model), atol=1e-4)


def test_toxicity_network_has_many_live_inputs():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=60)) + (" vilest" if i % 4 == 0 else "") for i in range(400)]
    model = toxicity.train(texts, [int(i % 4 == 0) for i in range(400)], toxicity.FitSetup(updates=20, epochs=2))
    assert np.abs(model.params["Ew"]).any(axis=1).sum() > 300 and np.abs(model.params["Ec"]).any(axis=1).sum() > 1000


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(100)] + [(2, "b"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic long")
    assert sorted((r.toxic, r.text) for r in toxicity.sample(docs, marks).collect()) == [(0, "b"), (1, "text 0")]


# personal data

def test_pii_many_matches_and_long_texts(spark):
    from tests.llm.test_corpus import pii_base

    rng = random.Random(17)
    bits = [f"u{i}@mail{i % 7}.example.com" for i in range(900)] + ["\U0001f600é", "10.0.0.1", "+1 (017) 555-7713", "word", "中文 a"] * 60
    rng.shuffle(bits)
    texts = [" ".join(bits), "x" * 255 + " a@b.c", "x" * 256 + " a@b.c " + "y" * 700 + "\n10.9.8.7", "+1 10.0.0.1 a1@b.c.1.2.3.4", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(k, s.start, s.end) for k in pii.KINDS for s in r[k]] for r in pii.private_spans(docs).collect()}
    assert got == {i: pii_base(t or "") for i, t in enumerate(texts)}
    clean = {r.doc_id: r.clean for r in pii.sanitise(docs, pii.Sanitiser(contexts=9)).collect()}
    for i, t in enumerate(texts):
        want, at = "", 0
        for low, high, kind in sorted((s, e, k) for k, s, e in got[i]):
            if low >= at:
                want += t[at:low] + f"[{kind.upper()}]"
            at = max(at, high)
        assert clean[i] == want + (t or "")[at:]


def test_pii_time_is_linear(spark):
    """Four times the matches in a text take far less than sixteen times as long."""
    took = []
    for n in (20_000, 80_000):
        docs = spark.createDataFrame([(1, " ".join(f"a{i}@b.cd" for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        assert docs.select(F.size(pii.base_spans(F.col("text"), "email")).alias("n")).first().n == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 2
