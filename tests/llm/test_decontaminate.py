"""Decontamination against brute force, and its edge cases."""

import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, seed string, item_id string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, None, "s", 0, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
    return h.max()


@given(st.lists(st.integers(0, 4), min_size=1, max_size=14), st.lists(st.integers(0, 4), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_alignment(a, b):
    score, start, end = decontaminate.align(np.array(a, "u8"), np.array(b, "u8"))
    assert score == smith_waterman(a, b)
    assert smith_waterman(a, b[start:end]) == score if score else start == end or score == 0


def test_contamination(spark):
    rnd = random.Random(7)
    fresh = lambda n: [f"{rnd.choice('bcdfg')}{rnd.randrange(900)}" for _ in range(n)]
    items = [fresh(rnd.randrange(15, 50)) for _ in range(6)]
    texts, want = [], set()
    for k, item in enumerate(items):
        for share in (0, 0.1, 0.2):
            copy = [w if rnd.random() >= share else fresh(1)[0] for w in item]
            want.add((len(texts), k))
            texts.append(" ".join([*fresh(60), *copy, *fresh(500)]))
        texts.append(" ".join(fresh(200)))
        texts.append(" ".join([*fresh(60), *item[: len(item) // 4], *fresh(60)]))
    texts += [None, "", "a b"]
    bench = spark.createDataFrame([*((k, " ".join(i)) for k, i in enumerate(items)), (97, None), (98, ""), (99, "!?")], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(0.5 <= r.score <= 1 for r in found) and sum(r.score == 1 for r in found) >= 6
    kept = decontaminate.clean(docs(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == docs(spark, []).columns
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs(spark, texts).limit(0), bench).count() == 0


def _edited(item, rnd, fresh):
    """A copy with a quarter of the words replaced."""
    gone = set(rnd.sample(range(len(item)), len(item) // 4))
    return [fresh(1)[0] if i in gone else w for i, w in enumerate(item)]


@pytest.mark.parametrize("n", [10, 300])
def test_edited_copies_in_a_third_of_documents(spark, n):
    """None of an item's seeds is rare then, and most of those that are occur by chance."""
    rnd = random.Random(3)
    fresh = lambda n: [f"{rnd.choice('bcdfg')}{rnd.randrange(900)}" for _ in range(n)]
    item = fresh(40)
    copy = _edited(item, rnd, fresh)
    seeds = [item[i : i + 3] for i in range(38)]
    lost = [s for s in seeds if " ".join(s) not in " ".join(copy)]
    assert len(lost) > len(seeds) / 2
    texts = [" ".join([*fresh(60), *(copy if i % 3 == 0 else fresh(40)), *fresh(100)]) for i in range(n)]
    held = {i for i in range(n) if i % 3 == 0}
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs(spark, texts), bench).collect()} == held
    texts[1::3] = [f"{t} {' '.join(lost[i % len(lost)])}" for i, t in enumerate(texts[1::3])]
    assert {r.doc_id for r in decontaminate.contaminated(docs(spark, texts), bench).collect()} == held
    assert {r.doc_id for r in decontaminate.clean(docs(spark, texts), bench).collect()} == set(range(n)) - held


@given(st.lists(st.integers(0, 4), min_size=8, max_size=14), st.lists(st.integers(0, 9), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_no_alignment_beats_the_bound(a, b):
    items = decontaminate.Items([])
    items.words = [np.array(a, "u8")]
    assert items.most(0, np.array(b, "u8")) >= smith_waterman(a, b)


def test_query_equals_brute_force(spark):
    """All documents with all items by a plain table, over whole texts."""
    d = "/root/testdata/sf0.001"
    real, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    bench = bench.unionByName(spark.createDataFrame([(1_000_000, " ".join(words.words_of(real.filter("length(text) > 400").first().text)[20:26]))], "item_id long, text string"), allowMissingColumns=True)
    items = {r.item_id: words.hashes(words.words_of(r.text)) for r in bench.collect()}
    want = {}
    for r in real.collect():
        h = words.hashes(words.words_of(r.text or ""))
        for k, item in items.items():
            n = len(item)
            if not np.isin(item, h).sum() * 2 >= n:  # too few of its words to score half
                continue
            row, best = np.zeros(len(h) + 1), 0.0
            ramp = 0.5 * np.arange(len(h) + 1)
            for w in item:
                new = np.maximum(row - 0.5, 0)
                new[1:] = np.maximum(new[1:], row[:-1] + np.where(h == w, 1.0, -0.5))
                row = np.maximum.accumulate(new + ramp) - ramp
                best = max(best, row.max())
            if best >= (n if n < 8 else n / 2):
                want[r.doc_id, k] = best / n
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(real, bench).collect()}
    assert got == want and len(want) >= 5


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "yes"), (3, "one two"), (4, "one two"), (5, "a b c")], "item_id long, text string")
    texts = ["so, what is the Capital of france I asked", "what is the capital city of france", "yes, and more of it", "Yes!", "one two", "x a b c y", "a c b", None, ""]
    got = {(r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 1, 1.0, 1, 7), (3, 2, 1.0, 0, 1), (4, 3, 1.0, 0, 2), (4, 4, 1.0, 0, 2), (5, 5, 1.0, 1, 4)}


def test_rows_are_cleaned_for_their_own_texts(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (None, "gone gone gone")], "item_id long, text string")
    texts, ids = [item, "clean", f"x {item} y", "clean too", f"{item}", item], [None, None, 7, 7, 8, 8]
    df = docs(spark, texts, ids)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == {(None, 1), (7, 1), (8, 1)}
    kept = decontaminate.clean(df, bench)
    assert sorted(r.text for r in kept.collect()) == ["clean", "clean too"] and kept.columns == df.columns


def test_long_items_need_little_memory(spark):
    rnd = random.Random(9)
    item = [f"v{rnd.randrange(50_000)}" for _ in range(20_000)]
    copy = [w if rnd.random() > 0.1 else "other" for w in item]
    text = " ".join([*(f"u{i}" for i in range(500)), *copy, *(f"u{i}" for i in range(500))])
    items = decontaminate.Items([(3, " ".join(item))])
    tracemalloc.start()
    (item_id, score, first, end), = items.matches(words.hashes(words.words_of(text)))
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    assert item_id == 3 and 0.8 < score < 0.9 and abs(first - 500) < 50 and abs(end - 20_500) < 50
    bench = spark.createDataFrame([(3, " ".join(item))], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(docs(spark, ["x y z", text]), bench).collect()] == [1]


def test_blocks_of_items(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    real, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.contaminated(real, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 4_000)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_DOCS", 0)
    assert sorted(map(tuple, decontaminate.contaminated(real.repartition(5), bench).collect())) == want
