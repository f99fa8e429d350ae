"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them.

First pass, over all documents: which runs of SEED words of the test items does each hold? The document frequencies say which
of them are rare. Second pass, over the documents with a rare seed: the passages around its seeds are aligned locally, word
by word, with the item, unless a bound proves that they can't reach the threshold. So are passages that hold common seeds alone:
an item that many documents hold has no rare seed. Short items are sought as they are. Test items are few beside the corpus, yet
they aren't assumed to fit anywhere at once: they go through in blocks of bounded size.

A text is known by its digest, so that rows of any id, null too, are found and removed each for its own text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

SEED = 3
#: A seed is rare if it is in at most this share of documents, or as common as its item is itself: twice the median of its seeds that occur.
RARE_SHARE = 0.005
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Of an item's best possible score; with substitutions alone, up to a third of its words may differ.
THRESHOLD = 0.5
#: Items of fewer words than the first are found only word for word; of fewer than the second, only as whole documents.
LEAST_WORDS, LEAST_RUN = 8, 3
BLOCK_CHARS = 16_000_000
MAX_BROADCAST_DOCS = 1_000_000


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Twice the score of the best local alignment, and the first word of the passage after one. Two rows of the table are held."""
    match, mismatch, gap = (int(2 * x) for x in (MATCH, MISMATCH, GAP))
    ramp = -gap * np.arange(len(passage) + 1, dtype="i4")
    above, best, end = np.zeros(len(passage) + 1, "i4"), 0, 0
    for word in item:
        row = np.maximum(above + gap, 0)
        np.maximum(row[1:], above[:-1] + np.where(passage == word, match, mismatch), out=row[1:])
        # gaps along the row: the best earlier cell less the way from it
        row += ramp
        above = np.maximum.accumulate(row) - ramp
        if (j := int(above.argmax())) and above[j] > best:
            best, end = int(above[j]), j
    return best, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score, and the first and the end word of the passage in it. The start is where an alignment of the reversed words
    ends, so that memory is in proportion to the passage."""
    best, end = _best(item, passage)
    if not best:
        return 0.0, 0, 0
    _, back = _best(item[::-1], passage[:end][::-1])
    return best / 2, end - back, end


class Items:
    """One block of test items and its seeds; ``whole`` has those of fewer words than LEAST_RUN."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, seeds, owners = [], [], [], []
        self.whole: dict[bytes, list[int]] = {}
        for item_id, text in rows:
            h = words.hashes(words.words_of(text))
            if len(h) < LEAST_RUN:
                if len(h):
                    self.whole.setdefault(h.tobytes(), []).append(item_id)
                continue
            own = np.unique(words.grams(h, SEED))
            seeds.append(own)
            owners.append(np.full(len(own), len(self.ids)))
            self.ids.append(item_id)
            self.words.append(h)
        seed, owner = (np.concatenate(x) if x else np.zeros(0, "u8") for x in (seeds, owners))
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[order], owner[order].astype("i8")

    def least(self, k: int) -> float:
        """The least score that counts as holding the item: all of a short one's."""
        n = len(self.words[k])
        return MATCH * (n if n < LEAST_WORDS else THRESHOLD * n)

    def most(self, k: int, passage: np.ndarray) -> float:
        """No alignment scores more: a word of the passage that the item lacks costs a mismatch or a gap, any other gains a match at most."""
        total = np.concatenate([[0.0], np.cumsum(np.where(np.isin(passage, self.words[k]), MATCH, max(MISMATCH, GAP)))])
        return float((total - np.minimum.accumulate(total)).max())

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, indexes of seeds); where several items share a seed, each has its own index."""
        g = words.grams(h, SEED) if len(h) >= SEED else h[:0]
        if not len(self.seed) or not len(g):
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        first = np.searchsorted(self.seed, g, "left")
        found = np.flatnonzero(self.seed[np.minimum(first, len(self.seed) - 1)] == g)
        first, last = first[found], np.searchsorted(self.seed, g[found], "right")
        n = last - first
        at = np.repeat(found, n)
        return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)

    def passages(self, at: np.ndarray, seed: np.ndarray, n: int):
        """(item, its reach, first word, end word): the surroundings of hits in a text of n words."""
        item = self.owner[seed]
        for k in np.unique(item):
            own = item == k
            order = np.argsort(at[own], kind="stable")
            where = at[own][order]
            length = len(self.words[k])
            reach = length + length // 2 + SEED
            cuts = np.flatnonzero(np.diff(where) > 2 * reach) + 1
            for some in np.split(where, cuts):
                yield k, reach, max(0, int(some[0]) - reach), min(n, int(some[-1]) + SEED + reach)

    def could(self, h: np.ndarray, at: np.ndarray, seed: np.ndarray) -> bool:
        """Whether the bound allows that the text holds an item."""
        if len(h) < LEAST_RUN:
            return h.tobytes() in self.whole
        return any(self.most(k, h[lo:hi]) >= self.least(k) for k, _, lo, hi in self.passages(at, seed, len(h)))

    def matches(self, h: np.ndarray):
        """(item_id, score, first word, end word): each item's best passage that reaches the threshold."""
        found: dict[int, tuple[float, int, int]] = {}
        for item_id in self.whole.get(h.tobytes(), ()) if len(h) < LEAST_RUN else ():
            yield item_id, 1.0, 0, len(h)
        for k, reach, lo, hi in self.passages(*self.hits(h), len(h)):
            if self.most(k, h[lo:hi]) < self.least(k):
                continue
            step = 16 * len(self.words[k])
            for a in range(lo, hi, step):  # passages overlap by more than an item's reach
                score, start, end = align(self.words[k], h[a : min(hi, a + step + 2 * reach)])
                if score > found.get(k, (0.0, 0, 0))[0]:
                    found[k] = (score, a + start, a + end)
        for k, best in found.items():
            if best[0] >= self.least(k):
                yield self.ids[k], best[0] / len(self.words[k]), best[1], best[2]


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """digest, doc_id, item_id, score, first_word, end_word: what each row's text holds."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    thin = thin.withColumn("digest", _digest(F.col("text")))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    out = None
    n_docs = docs.count() if blocks else 0
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # BLOCK_CHARS or so
        found = _block(thin, n_docs, Items([(r.item_id, r.text) for r in rows]))
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], _FOUND) if out is None else out


_FOUND = "digest binary, doc_id long, item_id long, score double, first_word long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (0.5 to 1), first_word, end_word: the best passage of each document for each item it holds.

    Words are runs of letters and digits in lower case. Items of 8 words and more are found where a passage that shares three words in a
    row with them reaches half of their best score; items of 3 to 7 words where they stand word for word, with score 1; items of one or
    two words only where the document consists of them, since most texts hold such words. Null items and those without a word match
    nothing, and neither do null and empty documents. Items of one text match alike. Rows of one doc_id, null too, are looked at one by one;
    the best of them counts. Runs jobs over the documents while it is called.
    """
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word")))
    return _found(docs, benchmark).groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def _block(docs: DataFrame, n_docs: int, items: Items) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(items)

    def seeds(batches):
        for batch in batches:
            for part in common.parts(batch, 1, rows=4096):
                at_rows, found, could = [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    h = words.hashes(words.words_of(text))
                    at, seed = held.value.hits(h)
                    if len(seed) or (len(h) < LEAST_RUN and held.value.could(h, at, seed)):
                        at_rows.append(row)
                        found.append(np.unique(seed).tolist())
                        could.append(held.value.could(h, at, seed))
                yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(at_rows, pa.int64())), pa.array(found, pa.list_(pa.int32())), pa.array(could, pa.bool_())], ["digest", "seeds", "could"])

    held_seeds = common.written(docs.mapInArrow(common.lean(seeds, "words"), "digest binary, seeds array<int>, could boolean"), "seed-hits")
    hits = held_seeds.select("digest", F.explode("seeds").alias("seed"))
    count = np.zeros(len(items.seed), "i8")
    counted = hits.groupBy("seed").count().toArrow()  # a row for each seed of the block at most
    count[counted.column("seed").to_numpy()] = counted.column("count").to_numpy()
    there = pd.Series(count[count > 0]).groupby(items.owner[count > 0]).median()
    usual = there.reindex(range(len(items.ids)), fill_value=0.0).to_numpy()
    rare = count <= np.maximum(RARE_SHARE * n_docs, 2 * usual[items.owner])
    rare_seeds = docs.sparkSession.createDataFrame(pa.table({"seed": pa.array(np.flatnonzero(rare & (count > 0)), pa.int32())}))
    near = common.written(hits.join(F.broadcast(rare_seeds), "seed").select("digest").union(held_seeds.filter("could").select("digest")).distinct(), "near")

    def passages(batches):
        for batch in batches:
            for part in common.parts(batch, 1, rows=4096):
                rows = [(row, *m) for row, text in enumerate(part.column(1).to_pylist()) for m in held.value.matches(words.hashes(words.words_of(text)))]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(2).take(at), part.column(0).take(at), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()), 1))], ["digest", "doc_id", "item_id", "score", "first_word", "end_word"])

    return docs.join(common.small(near, MAX_BROADCAST_DOCS), "digest", "left_semi").select("doc_id", "text", "digest").mapInArrow(common.lean(passages, "words"), _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose texts hold no test item, as they are, whatever their ids; null and empty texts stay."""
    gone = common.written(_found(docs, benchmark).select("digest").distinct(), "contaminated")
    return docs.join(common.small(gone, MAX_BROADCAST_DOCS), _digest(docs["text"]) == gone["digest"], "left_anti").select(*docs.columns)


def op7_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
