"""Every corpus operator against a brute-force version on a small table with odd rows.

The table has nulls, empty and white-space texts, repeated rows, ties, a long text, special tokens,
rare characters, and extra columns whose names clash with those of the results.
"""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearpath.llm import bpe, exactdedup, langid, lexicon, mixing, neardup, pii, quality, substring, tokenfile, toxicity, wordcore

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, tag long, digest string"
WORDS = "the of and le la und der que house river stone light table green mountain window".split()


def make_rows():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))
    base, passage = say(220), say(60)
    texts = [None, "", " \n\t ", "one", "ONE", "one  two\nthree four", base, base, base.replace(" ", "\n"), base.upper(), say(3000)]
    for _ in range(25):  # near copies, some just under the threshold
        w = base.split()
        for _ in range(rng.randint(0, 11)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [say(rng.randint(5, 60)) + " " + passage + " " + say(rng.randint(0, 40)) for _ in range(8)]
    texts += ["a b c " * 40, "x " * 34, "y " * 35, "Tab\tand <|endoftext|> Σας 中文 1²½ don't ###*** é́ \U0001f600", "q" * 3000 + " end"]
    texts += [
        "mail joe.x@mail.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111, host 10.0.0.255 and 300.1.1.1",
        "call Zebulon Quartz at joe.x@mail.example.com now", "ask Zebulon Quartz, joe.x@mail.example.com, today", "a@b.c_d@e.f.g 1.2.3.4.5.6.7.8 " + "9" * 400,
    ]
    texts += [say(rng.randint(20, 90)) for _ in range(20)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], -1, i % 2 == 0, 7, "x") for i, t in enumerate(texts)]
    return [*rows, (6, base, "en", "s0", 0, None, None, None), (None, base, None, None, None, None, None, None), (None, "no id here", "en", "s1", 1, True, 1, "d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    a, b = collections.Counter(map(tuple, got)), collections.Counter(map(tuple, want))
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def words(text):
    return text.encode().split()


def test_quality(docs, rows, empty):
    def brute(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))

    out = quality.score_quality(docs)
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), [brute(i, t) for i, t, _ in rows])
    assert out.filter("base_failed AND kept").count() == 0 and out.filter("kept").count() > 0
    assert quality.score_quality(empty).count() == 0


def test_quality_rules_are_compiled(docs):
    rules = (quality.Rule("few", "n_words", least=100), quality.Rule("many", "n_words", most=2000))
    got = {(r.doc_id, tuple(r.broken)) for r in quality.score_quality(docs, rules).collect() if r.doc_id in (3, 6, 10)}
    assert got == {(3, ("few",)), (6, ()), (10, ("many",))}


def test_language(spark):
    rng = random.Random(2)
    lex = {"aa": "ka ra to mi su ne".split(), "bb": "blor wex ild grun fesk ohm".split()}
    rows = [(i, " ".join(rng.choice(lex[l]) + rng.choice(lex[l]) for _ in range(rng.randint(5, 60))), l) for i, l in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "aa"), (None, "ka ra", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter(~langid.held_out(F.col("doc_id"))))
    assert set(model) == {"aa", "bb"}
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert sum(got[i].lang_pred == l for i, _, l in rows[:120]) >= 118
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [r.lang_pred for r in langid.identify(df.limit(3), {}).collect()] == ["und"] * 3
    assert langid.fit(df.limit(0)) == {} and langid.identify(df.limit(0), model).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"text of language number {'abcdefghij'[i // 10] * 5} {'abcdefghij'[i % 10] * 5}", f"l{i:02}") for i in range(70)]
    assert set(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == {r[2] for r in rows}


def test_exact_dedup(docs, rows, empty):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t, _ in rows]
    group = collections.defaultdict(list)
    for i, t in norm:
        group[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in group.items()}
    want = [(i, keep[t], len(group[t]), i is not None and i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]
    same(exactdedup.exact_dedup(docs).collect(), want)
    left = exactdedup.drop_copies(docs)
    assert left.columns == docs.columns and left.filter("doc_id = 7").count() == 0 and left.filter("doc_id = 6").count() == 1
    assert exactdedup.exact_dedup(empty).count() == 0


def test_trie_spills(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = {}
    for i, t in enumerate(texts):
        want[t] = (min(i, want.get(t, (i, 0))[0]), want.get(t, (i, 0))[1] + 1)
    trie = exactdedup.RadixTrie()
    for i, t in enumerate(texts):
        trie.insert(t, (i, 1, 0))
    found = list(trie.items())
    assert [k for k, _ in found] == sorted(want) and {k: v[:2] for k, v in found} == want
    monkeypatch.setattr(exactdedup, "OWNER_BYTES", 20_000)
    monkeypatch.setattr(exactdedup, "SCAN_BYTES", 5_000)
    batch = exactdedup.pa.RecordBatch.from_arrays([exactdedup.pa.array(c, t) for c, t in zip(zip(*[(i, 1, 0, t) for i, t in enumerate(texts)]), exactdedup._SCHEMA.types)], schema=exactdedup._SCHEMA)
    out = list(exactdedup.own_texts(exactdedup.combine_copies(iter([batch]))))
    got = {k: (o, n) for b in out for o, n, k in zip(*(b.column(c).to_pylist() for c in (0, 1, 3)))}
    assert got == want


def brute_groups(rows, k=5):
    sets = {}
    for i, t, _ in rows:
        w = [x.lower() for x in words(t)]
        sets.setdefault(i, set()).update([tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups(docs, rows, empty):
    got = neardup.near_groups(docs)
    want = brute_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect() if r.doc_id is not None} == want
    assert {r.component_id for r in got.filter("doc_id IS NULL").collect()} == {None} and got.count() == len(rows)
    left = neardup.keep_one(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.filter("doc_id IS NOT NULL").collect()} == {c for _, c in want.values()}
    assert neardup.near_groups(empty).count() == 0


@pytest.mark.parametrize("lead,star", [(0, 1), (25, 3), (10, 10**6)])
def test_near_groups_do_not_depend_on_the_costs(docs, rows, lead, star):
    setup = neardup.JoinSetup(lead=lead, star_over=star, heavy_tokens=50, bitmap_bits=1 << 18)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(docs, setup).collect() if r.doc_id is not None}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("star", [1, 10**6])
def test_repeated_rows_are_one_node(spark, star):
    """A row that stands twice shares a long passage, too short for a link, with another document."""
    rng = random.Random(4)
    say = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 9999)}" for _ in range(n))
    passage, tail = say(120), say(90)
    one = f"{passage} {say(90)}"
    texts = [(1, one), (1, one), (2, f"{passage} {tail}"), *[(k, f"{say(120)} {tail}") for k in range(3, 10)]]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(rows, neardup.JoinSetup(star_over=star, lead=0)).collect()}
    assert got == brute_groups([(i, t, None) for i, t in texts]) and got[2][1] == 2


def test_components_of_a_path(spark):
    links = spark.range(40).selectExpr("(id * 7) % 41 AS a", "((id + 1) * 7) % 41 AS b").unionByName(spark.createDataFrame([(100, 101), (101, 101)], "a long, b long"))
    for at_once in (500_000, 42, 41, 5, 1):  # one lot, or several and rounds of stars
        found = neardup.components(links, at_once=at_once).collect()
        assert {r.node: r.component for r in found} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100} and len(found) == 43
    assert neardup.components(links.limit(0)).count() == 0


@pytest.mark.parametrize("span,kmer", [(35, 16), (6, 3), (4, 4)])
def test_substring(docs, rows, empty, span, kmer):
    split = [words(t) for _, t, _ in rows]
    count = collections.Counter(tuple(w[k : k + span]) for w in split for k in range(len(w) - span + 1))
    want, spans = [], []
    for (i, _, _), w in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if count[tuple(w[k : k + span])] > 1:
                gone[k : k + span] = [True] * span
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
        edge = [k for k in range(len(w) + 1) if (gone[k] if k < len(w) else False) != (gone[k - 1] if k else False)]
        spans += [(i, a, b) for a, b in zip(edge[::2], edge[1::2])]
    same(substring.remove_repeats(docs, span, kmer).collect(), want)
    same(substring.repeated_spans(docs, span, kmer).collect(), spans)
    assert any(n for _, _, n, _ in want) and substring.remove_repeats(empty).count() == 0


def test_bpe_round_trip(docs, rows, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe.round_trip(docs).collect(), want)
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs.filter("doc_id < 6")).collect()}
    assert ids == {i: tok.encode(t, add_special_tokens=False).ids for i, t, _ in rows if i is not None and i < 6}
    assert bpe.round_trip(empty).count() == 0


def test_lexicon():
    rng = random.Random(5)
    entries = {bytes(rng.choice(b"abcxyz\xc3\xa9") for _ in range(rng.randint(1, 9))): [rng.randrange(50_000) for _ in range(rng.randint(0, 5))] for _ in range(2000)}
    lex = lexicon.Lexicon(lexicon.build(entries.items()))
    assert all(lex.get(w) == ids for w, ids in entries.items())
    assert all(lex.rank(w) == n for n, w in enumerate(sorted(entries)))
    for w in list(entries)[:200]:
        for other in (w[:-1], w + b"a", b"\xff" + w):
            assert (lex.get(other) is None) == (other not in entries)
    none = lexicon.Lexicon(lexicon.build([]))
    assert none.get(b"a") is None and none.get(b"") is None


def test_token_files(spark, docs, rows, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 500)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenfile.write_tokens(docs, str(tmp_path / "t"))
    got = tokenfile.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i))
    at, texts = 0, collections.defaultdict(list)
    for i, t, _ in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        texts[i].append((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        at += r.n_tokens
    tokenfile.write_tokens(empty, str(tmp_path / "e"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, most in ((1, 0), (2, 10**6), (500, 400), (1000, 10**9), (130, 0)):
        values = np.sort(rng.integers(0, most + 1, n))
        code = tokenfile.EliasFano.of(values)
        again, used = tokenfile.EliasFano.read(memoryview(code.tobytes()), n, code.low_bits)
        assert used == len(code.tobytes()) and (again.all() == values).all() and [again.select(i) for i in range(n)] == values.tolist()
        if n == 1000:
            assert len(code.tobytes()) < n * (2 + math.log2(most / n)) / 8 + n / 16 + 64 < n * 8
    seg = tokenfile.Segment(tokenfile.write_segment([5, None, 9], [2, 0, 3], np.array([1, 2, 3, 4, 70_000]), 4))
    assert seg.doc_ids == [5, None, 9] and seg.tokens(2).tolist() == [3, 4, 70_000] and seg.tokens(1).tolist() == []


def test_mix(docs, rows, empty):
    plan = mixing.MixPlan(slots=1 << 12)
    got = mixing.mix(docs, plan).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, total, capped = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s, v in share.items() if v > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: share.get(s, 3.0 * sizes[s]) for s in names}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    same([(r.doc_id, r.source, r.size) for r in got], [(i, s, len(words(t))) for i, t, s in rows])
    assert all(abs(taken[s] - target[s]) <= max(2, 0.02 * target[s]) for s in names)
    same(got, mixing.mix(docs, plan).collect())
    assert mixing.mix(empty, plan).count() == 0 and mixing.resample(docs, plan).columns == docs.columns


def test_schedule_is_spread(docs):
    """Every prefix of the slots holds each source near its share."""
    plan = mixing.MixPlan(slots=1 << 10)
    per_source = mixing.targets(mixing.sized(docs), plan).cache()
    total = sum(r.want for r in per_source.collect())
    block = max(1, -(-total // plan.slots))
    slots = sorted((r.slot, r.source, r.length) for r in mixing.schedule(per_source, block, int(total / block * 1.02) + 64).collect())
    share = {r.source: r.want / total for r in per_source.collect()}
    seen = collections.Counter()
    for n, (_, s, _) in enumerate(slots[: len(slots) * 9 // 10], 1):
        seen[s] += 1
        assert all(abs(seen[x] - n * p) < 8 for x, p in share.items())


def test_schedule_meets_the_targets_of_small_sources(spark):
    plan = mixing.MixPlan(slots=1 << 10)
    for sizes in ([4_000_000, 500, 2_000, 5_000, 50_000, 1], [4_600_000_000_000, 100]):
        rows = [(k, None if k == 2 else f"s{k}", n) for k, n in enumerate(sizes)]
        per_source = mixing.targets(spark.createDataFrame(rows, "doc_id long, source string, size long"), plan).cache()
        total = sum(sizes)
        block = max(1, -(-total // plan.slots))
        slots = mixing.schedule(per_source, block, int(-(-total // block) * (1 + plan.slack)) + 64).collect()
        got = collections.Counter()
        for s in slots:
            got[s.source] += s.length
        assert got == {r.source: r.want for r in per_source.collect()} and len({s.slot for s in slots}) == len(slots)
        assert len({(s.source, s.rank) for s in slots}) == len(slots)


def pii_base(t):
    found = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def test_pii(docs, rows, empty):
    out = pii.private_spans(docs)
    got = [(r.doc_id, tuple((k, s.start, s.end) for k in pii.KINDS for s in r[k])) for r in out.collect()]
    same(got, [(i, tuple(pii_base(t))) for i, t, _ in rows])
    text = dict((i, t) for i, t, _ in rows)
    terms = collections.defaultdict(set)
    for r in out.collect():
        for s in r.term:
            terms[text[r.doc_id][s.start : s.end]].add(r.doc_id)
            assert s.disclosure >= pii.Sanitiser().threshold
    assert {"Zebulon", "Quartz"} <= set(terms) and len(terms["Quartz"]) == 2
    clean = {r.doc_id: r.clean for r in pii.sanitise(docs).collect() if r.doc_id is not None}
    who = next(i for i, t in text.items() if t.startswith("call Zebulon"))
    assert clean[who] == "call   at [EMAIL] now" and clean[1] == "" and pii.private_spans(empty).count() == 0
    assert not any(pii_base(c) for i, c in clean.items() if i is not None and "300.1" not in c and "a@b" not in text[i])


def test_pii_counts_whole_texts(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [say(60) for _ in range(60)]
    for i in range(3):  # a long and a short name, far from the entity, and twice in a text
        texts[i] = f"Quartz {say(40)} Bo {say(40)} z{i}@mail.example.com joe@mail.example.com {say(40)} QUARTZ"
    texts[3] = "Quartz " + say(20)
    texts[4] = texts[5] = "copied once joe2@mail.example.com"  # one text only
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(texts[r.doc_id][s.start : s.end], round(s.disclosure, 6)) for s in r.term] for r in pii.private_spans(docs).collect()}
    quartz = round(1 - math.log2(4 / 3) / math.log2(60 / 3), 6)
    assert all(got[i] == [("Quartz", quartz), ("Bo", 1.0), ("QUARTZ", quartz)] for i in range(3))
    assert not any(got[i] for i in range(3, 60))


def test_toxicity(spark):
    rng = random.Random(6)
    say = lambda n: [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]
    rows, marks = [], []
    for i in range(500):
        w, bad = say(rng.randint(5, 150)), i % 4 == 0
        for _ in range(max(1, len(w) // 30) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["vile", "vilest", "grubbish", "grubbier"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "?! ..."), (None, "vile vile"), (1003, "calm " * 5000 + "vilest"), (0, rows[0][1])]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    held = [(i, m) for i, m in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(m) for i, m in held) >= 0.9 * len(held)
    assert all(got[i] == 0 for i in (1000, 1001, 1002)) and all(0 <= s <= 1 for s in got.values())
    assert got[1003] >= 0.5  # the last window counts as the first does
    assert toxicity.fit(docs, labels.limit(0)) is None and {r.score for r in toxicity.score_documents(docs, None).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_toxicity_trains_on_whole_texts(spark):
    rng = random.Random(8)
    say = lambda n: [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]
    texts, marks = [], []
    for i in range(120):
        w, bad = say(rng.randint(1100, 1300)), i % 3 == 0
        if bad:  # only after the first thousand words
            w[rng.randint(1000, len(w) - 1)] = "vilest"
        texts.append(" ".join(w))
        marks.append(int(bad))
    docs, labels = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    assert sorted(r.text for r in toxicity.sample(docs, labels).collect()) == sorted(texts)
    model = toxicity.train(texts[:90], marks[:90], toxicity.FitSetup(updates=60))
    offsets, raw = wordcore.text_buffers(toxicity.pa.array(texts[90:]))
    assert ((model.score(offsets, raw) >= 0.5) == np.array(marks[90:])).all()


def test_toxicity_learns_rarer_words():
    rng = random.Random(9)
    say = lambda n: [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]
    rare = ["".join(rng.choices("bcdfghjkmpqvwxyz", k=7)) for _ in range(12)]
    texts, marks = [], []
    for i in range(12 * 8 * 4):
        w, bad = say(rng.randint(20, 50)), i % 4 == 0
        if bad:  # each word in eight toxic texts
            w[rng.randrange(len(w))] = rare[i // 4 % 12]
        texts.append(" ".join(w))
        marks.append(int(bad))
    model = toxicity.train(texts, marks)
    asked = [" ".join([*say(15), w, *say(15)]) for w in rare] + [" ".join(say(30)) for _ in range(40)]
    got = model.score(*wordcore.text_buffers(toxicity.pa.array(asked))) >= 0.5
    assert got[:12].sum() >= 11 and got[12:].sum() <= 2


def test_toxicity_gradients():
    setup = toxicity.FitSetup(embed=3, hidden=2, attend=2, word_slots=16, char_slots=16)
    net = toxicity.Network.initial(setup)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    table, at, mask = rng.normal(size=(7, 3)), rng.integers(0, 6, (5, 4)), np.ones((5, 4))
    table[6], mask[3:, 1], at[3:, 1] = 0, 0, 6
    y, weight = np.array([0, 1, 1, 0.0]), np.array([1, 2, 1, 1.0])

    def loss():
        o = net.logits(at, mask, table)
        return (weight * (np.log1p(np.exp(o)) - y * o)).sum() / weight.sum()

    g, dx, _ = net.gradients(at, mask, table, y, weight)
    for k in g:
        flat = net.p[k].reshape(-1)
        for i in range(min(4, len(flat))):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            slope = (up - loss()) / 2e-4
            flat[i] = old
            assert g[k].reshape(-1)[i] == pytest.approx(slope, abs=2e-5)
