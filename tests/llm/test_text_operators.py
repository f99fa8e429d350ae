"""Operators over texts against brute force, and their edge cases."""

import codecs
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, common, language, mixing, near, quality, token_counts, token_files, words

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a\n b  c", "x<|endoftext|>y <|endoftext|>", "'s it's\n\nfoo\tbar", "a b", " lead", "trail ", "it's, don't! 12.5", "▁x ▁▁y", "é́  x", "😀 a😀\n😀", "<s> x</s>", "日本 語\n x\n", "\x01a \x01b", "a\x00b c", "word " * 3000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, held_out string, h string, seed string"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang"), f"s{i % 3}" if i % 7 else None, 0, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# -- token files and counts


@given(st.lists(st.text(st.sampled_from(list("ab, .\n\t'é▁日1<|>")), max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoders_equal_the_libraries(texts):
    enc = token_files.encoder(BPE)
    assert enc.encode(texts) == [np.array(enc.library.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    c = token_counts.counter(PIECES)
    assert c.count(texts) == [len(c.sp.encode(t)) for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"w{i} and {'x' * (i % 7)}y" for i in range(300)]
    enc, c = token_files.encoder(BPE), token_counts.counter(PIECES)
    want, n = enc.encode(texts), c.count(texts)
    monkeypatch.setattr(token_files, "REMEMBERED", 10)
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    assert [x for t in texts for x in enc.encode([t])] == want and [x for t in texts for x in c.count([t])] == n


def _word(rnd):
    letters = rnd.choice(["abcdefghilmnoprstu", "aeioénrçtöß", "ÀÿØöþXYZ"])
    return "".join(rnd.choices(letters, k=rnd.randrange(2, 14))) + rnd.choice(["", "", "", ".", ",", "?!", "$$$", ".***", "'s", "'", "-x", "<|endoftext|>", "×", "7", "é'll", "日本", "œuf"])


def test_bytes_are_written_as_the_library_writes_them():
    chars = "".join(map(chr, [*range(11, 0xD800), *range(0xE000, 0x110000, 37)]))
    pre = token_files.encoder(BPE).library.pre_tokenizer.__class__(add_prefix_space=False, use_regex=False)
    assert pre.pre_tokenize_str(chars)[0][0] == codecs.charmap_decode(chars.encode(), "strict", token_files._BYTES)[0]


def test_new_words_of_any_ending_equal_the_librarys():
    rnd = random.Random(2)
    texts = ["".join(_word(rnd) + rnd.choice("   \n") for _ in range(60)).strip() for _ in range(400)]
    enc = token_files.WordEncoder(BPE)
    want = [np.array(e.ids, enc.dtype).tobytes() for e in enc.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want and enc.encode(texts[::-1]) == want[::-1]
    assert enc.encode(pa.array(["cut off", *texts]).slice(1)) == want


def test_plain_words_are_not_told_apart_twice(real):
    """What the library is given as text costs pre-tokenization again: of new words that is hardly anything."""
    texts, sent = [r.text for r in real.collect() if r.text], []
    enc = token_files.WordEncoder(BPE)

    class Library:
        def encode_batch_fast(self, parts, **how):
            sent.extend(parts)
            return token_files.encoder(BPE).library.encode_batch_fast(parts, **how)

    enc.library = Library()
    plain = [t for t in texts if token_files._plain(t)]
    assert len(plain) > len(texts) / 2
    want = [np.array(token_files.encoder(BPE).library.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in plain]
    assert enc.encode(plain) == want
    assert sum(map(len, sent)) < 0.05 * sum(map(len, {w for t in plain for w in t.split()}))


def test_token_files(spark, real):
    enc = token_files.encoder(BPE)
    df = docs(spark, ODD).select("doc_id", "text").unionByName(real.select((F.col("doc_id") + 100).alias("doc_id"), "text")).unionByName(spark.createDataFrame([(None, "no id"), (3, "again")], "doc_id long, text string"))
    uri = common.scratch(spark, "t")
    manifest = token_files.write(df, uri, BPE)
    rows = token_files.read(spark, uri, manifest).orderBy("start").collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
    start = 0
    for got, (there, key, text) in zip(rows, want, strict=True):
        ids = np.array([*enc.library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (key if there else None, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert manifest["n_ids"] == start
    assert token_files.encoded(df.limit(0), BPE).count() == 0


def test_token_counts(spark):
    sp = token_counts.counter(PIECES).sp
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, ODD), PIECES).collect()}
    for i, t in enumerate(ODD):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(sp.encode(t or "")), len((t or "").encode()))
        assert got[i].over_limit == (got[i].n_tokens > 4096)
    assert token_counts.count_tokens(docs(spark, ODD).limit(0), PIECES).count() == 0


# -- mixing


def test_mix_hits_its_targets(spark):
    rnd = random.Random(0)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 5, 80])), rnd.choice(["a", "a", "a", "b", "ü", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.copies(df).collect()
    total, by = sum(r.size for r in out), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    names = [*sorted(k for k in by if k), None]
    size = {k: sum(r.size for r in v) for k, v in by.items()}
    weight, left, target, free = {k: 1 + i % 3 for i, k in enumerate(names)}, total, {}, list(names)
    while free:
        level = left / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * level > 3 * size[k]]
        if not over:
            target |= {k: weight[k] * level for k in free}
            break
        for k in over:
            target[k], left = 3.0 * size[k], left - 3 * size[k]
            free.remove(k)
    for k, v in by.items():
        assert abs(v[0].target - target[k]) < 1e-6 and abs(sum(r.taken for r in v) - target[k]) <= 80
    assert sorted(out, key=str) == sorted(mixing.copies(df.repartition(7)).collect(), key=str)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.copies(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.copies(spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")).collect()] == [0, 0]


# -- chat


@given(st.text(st.sampled_from(list("\\<>/s[]INST|\nNa")), max_size=40), st.text(st.sampled_from(list("\\<s>\nNab")), max_size=12))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible(text, role):
    window = chat.format_turn(role, text)[0] + chat.format_turn("user", "next")[0]
    assert [(r, t) for r, t, _, _ in chat.parse(window)] == [(role, text), ("user", "next")]
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_windows(spark):
    rnd, rows = random.Random(1), []
    for c in range(12):
        for t in range(rnd.randrange(1, 14)):
            role = "system" if t == 0 and c % 2 else "user" if t % 2 else "assistant"
            rows.append((c, t, role, rnd.choice([None, "", "hello </s> you", "word " * rnd.randrange(1, 90)])))
    rows += [(None, 0, "user", "who"), (None, None, None, "first"), (5, 0, "system", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    made = chat.format_windows(df, BPE, budget=120, history=40)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for w in made.collect():
        turns = chat.parse(w.text)
        assert w.n_turns == len(turns) and (w.n_tokens <= 120 or w.over_budget)
        if w.conv_id in (1, 3, 7, 9, 11):
            assert turns[0][0] == "system"
        if w.over_budget:  # only where a single new turn, with the system turn, is too long
            assert w.n_turns - w.n_repeated <= 2
    assert chat.digests(chat.format_windows(df.limit(0), BPE)).count() == 0


# -- near-duplicates


def test_signatures_are_unbiased():
    a, b = (np.array([1, 2, 3], "u8"), np.array([7, 2, 1])), (np.array([1, 2, 4], "u8"), np.array([3, 5, 1]))
    s = near.signatures([a, b], 20_000)
    assert abs((s[0] == s[1]).mean() - near.weighted_jaccard(a, b)) < 0.015
    assert (near.signatures([a])[0] == near.signatures([b, a, b])[1]).all()


def test_all_similar_is_exact():
    rng = np.random.default_rng(0)
    s = [near.multiset(" ".join(f"w{i}" for i in rng.integers(0, 6, rng.integers(5, 60)))) for _ in range(20)]
    want = [[near.weighted_jaccard(a, b) for b in s[8:]] for a in s[:8]]
    assert np.allclose(near.all_similar(s[:8], s[8:]), want, atol=1e-6)


def near_texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randrange(20, 150))]
        for edits in (0, 0, 1, 1, 2, 3, 6, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [*texts, "one two", "One, two!", "three", "", None, "!!!", "rep " * 400, "rep " * 390]


def test_near_groups_equal_brute_force(spark):
    texts = near_texts()
    sets = {i: near.multiset(t) for i, t in enumerate(texts) if t and len(near.multiset(t)[0])}
    above = {}

    def root(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and near.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                above[b] = a
    got = {r.doc_id: r for r in near.near_groups(docs(spark, texts)).collect()}
    assert {i: r.group_id for i, r in got.items()} == {i: root(i) if i in sets else i for i in range(len(texts))}
    assert all(r.keep == (r.doc_id == r.group_id) for r in got.values())
    again = docs(spark, texts).unionByName(docs(spark, texts))
    assert sorted(r.doc_id for r in near.one_of_each(again).collect()) == sorted(i for i, r in got.items() if r.keep)
    assert near.near_groups(docs(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 256])
def test_groups_that_no_centre_settles(spark, monkeypatch, block):
    """Chains of edits, lengths and repeated rows: all pairs by brute force, with blocks of three members and of many."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "HOT_ROWS", 3)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(4):
        now = [word() for _ in range(120)]
        for _ in range(14):
            texts.append(" ".join(now))
            now = list(now)
            for _ in range(2):
                now[rnd.randrange(len(now))] = word()
            now += [word() for _ in range(rnd.randrange(0, 9))]
    texts += [texts[0]] * 6 + ["long " * 60_000, "long " * 59_000]
    sets = {i: near.multiset(t) for i, t in enumerate(texts)}
    above = {}

    def root(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and near.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                above[b] = a
    got = {r.doc_id: r.group_id for r in near.near_groups(docs(spark, texts)).collect()}
    assert got == {i: root(i) for i in sets}


def test_near_groups_of_a_table_equal_brute_force(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = real.select("doc_id", "text").collect()
    index: dict = {}
    sets = {}
    for r in rows:
        if r.text and len((m := near.multiset(r.text))[0]):
            sets[r.doc_id] = m
            for u in m[0].tolist():
                index.setdefault(u, []).append(r.doc_id)
    pairs = {(min(a, b), max(a, b)) for ids in index.values() if len(ids) > 1 for a in ids for b in ids if a != b}
    links = [p for p in pairs if near.weighted_jaccard(sets[p[0]], sets[p[1]]) >= 0.8]
    got = {r.doc_id: r.group_id for r in near.near_groups(real).collect()}
    assert len(links) > 50 and all(got[a] == got[b] for a, b in links)  # recall 1 where 0.9 is asked for
    linked = {x for p in links for x in p}
    assert all(g == d for d, g in got.items() if d not in linked)


# -- learned operators


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    p, expected, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in product(range(3), repeat=4):
        w = sum(np.exp(moves[i, path[0]]) for i in range(3)) / 3 * np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, y in enumerate(path):
            p[t, y] += w
        for a, b in zip(path, path[1:]):
            expected[a, b] += w
    got, e = language.forward_backward(scores, np.array([4]), moves)
    assert np.allclose(got, p / total) and np.allclose(e, expected / total)


def test_chunks_and_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    scores, moves, lengths = rng.normal(size=(600, 3)), rng.normal(size=(3, 3)), np.array([1, 70, 129, 400])
    a = language.forward_backward(scores, lengths, moves)
    share = language.shares(lambda i, j: scores[i:j], lengths, moves)
    monkeypatch.setattr(language, "CHUNK", 1000)
    b = language.forward_backward(scores, lengths, moves)
    monkeypatch.setattr(language, "BLOCK_VALUES", 90)
    monkeypatch.setattr(language, "CHUNK", 8)
    c = language.forward_backward(scores, lengths, moves)
    for other in (b, c):
        assert np.allclose(a[0], other[0]) and np.allclose(a[1], other[1])
    ends = np.cumsum(lengths)
    assert np.allclose(share, [a[0][e - n : e].mean(0) for n, e in zip(lengths, ends, strict=True)])
    assert np.allclose(share, language.shares(lambda i, j: scores[i:j], lengths, moves))


def test_rare_languages_are_learned(spark):
    rnd = random.Random(2)
    say = lambda letters: " ".join("".join(rnd.choices(letters, k=5)) for _ in range(40))
    rows = [(i, say("abcde"), "aa", "s") for i in range(900)] + [(i, say("vwxyz"), "zz", "s") for i in range(900, 906)]
    rows += [(None, say("vwxyz"), "zz", "s"), (3, None, "aa", "s"), (4, "word " * 200_000, "aa", "s"), (905, say("vwxyz"), None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language.fit(df, max_train=60, max_chars=30_000)
    assert model.langs == ["aa", "zz"]
    got = language.identify(df, model).collect()
    assert len(got) == len(rows) and sum(r.lang_pred == "zz" for r in got) == 8


def test_languages(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(real, language.fit(real)).join(real.select("doc_id", "lang"), "doc_id").filter(common.remainder("doc_id", 4) == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) >= 0.95 and all(0 <= r.score <= 1 for r in out)
    none = language.identify(docs(spark, ODD), language.fit(docs(spark, ODD))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    model = language.fit(real)
    edge = {r.doc_id: r for r in language.identify(docs(spark, [None, "", "12 34 ...", "the and of that"]), model).collect()}
    assert [edge[i].lang_pred for i in range(4)] == ["und", "und", "und", "en"]
    assert language.identify(real.limit(0), model).count() == 0


def test_isotonic():
    x, v = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4, 0.9]), np.array([0, 1, 0, 1, 0, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(v) >= 0).all() and v.min() > 0 and v.max() < 1


def test_quality_equals_a_direct_solution(spark):
    """Weights by one least-squares solve over all rows, calibration by projections onto monotone sequences; then every row's score."""
    d = "/root/testdata/sf0.01"
    real, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: float(r.quality) for r in labels.collect()}
    rows = real.collect()
    known = [(r.doc_id, quality.statistics(r.text), y[r.doc_id]) for r in rows if r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 5]
    x = np.array([k[1] for k in known])
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    model = quality.Model(mean, scale, np.zeros(0), np.zeros(0), np.zeros(0))
    part = np.array([zlib.crc32(str(k[0]).encode()) % 5 for k in known])
    z, t = model.features(x), np.array([k[2] for k in known])
    ridge = np.sqrt(np.append(np.full(quality.FEATURES, quality.RIDGE), 1e-9))
    fit = part > 1
    model.weights = np.linalg.lstsq(np.vstack([z[fit], np.diag(ridge)]), np.append(2 * t[fit] - 1, np.zeros(len(ridge))), rcond=None)[0]
    raw, truth = model.raw(x[part == 1]), t[part == 1]
    at, where = np.unique(raw, return_inverse=True)
    n, s = np.bincount(where).astype("f8"), np.bincount(where, truth)
    level = np.array([min(max(s[i : k + 1].sum() / n[i : k + 1].sum() for i in range(j + 1)) for k in range(j, len(at))) for j in range(len(at))])  # the min-max formula
    knots, values = [], []
    for v in np.unique(np.round(level, 12)):
        own = np.abs(level - v) < 1e-9
        knots.append((at[own] * n[own]).sum() / n[own].sum())
        values.append((s[own].sum() + 0.5) / (n[own].sum() + 1))
    want = {r.doc_id: float(np.interp(model.raw(np.array([quality.statistics(r.text)])), knots, values)[0]) for r in rows}
    got = quality.op1_quality_scores(spark, d).collect()
    assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 1e-4 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    real, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(real.select("doc_id", "text"), labels)
    held = real.join(labels.withColumnRenamed("doc_id", "k"), F.col("doc_id") == F.col("k")).filter(common.remainder("doc_id", 5) == 0)
    got = quality.score(held, model).select("quality", "quality_score").collect()
    assert np.mean([(r.quality_score >= quality.THRESHOLD) == bool(r.quality) for r in got]) > 0.95
    odd = quality.score(docs(spark, ODD).withColumn("quality_score", F.lit("clash")), model)
    assert odd.count() == len(ODD) and odd.filter("quality_score between 0 and 1").count() == len(ODD)
    blank = quality.fit(docs(spark, ODD), labels.limit(0))
    assert {r.quality_score for r in quality.score(docs(spark, ODD), blank).collect()} == {0.5}


def test_words():
    assert words.words_of("Ab, c_d\nÉ!") == ["ab", "c_d", "é"]
    h = words.hashes(list("abcdef"))
    assert len(words.grams(h, 5)) == 2 and len(words.grams(h[:3], 5)) == 1 and len(words.grams(h[:0], 5)) == 0
