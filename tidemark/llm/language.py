"""Language identification: a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams, and the lexicons (words that a learned language all but owns).
Emission weights of the features and transition weights between languages are learned together by gradient ascent on
the likelihood, over sequences put together from fragments of documents of several languages, since that is what
code-switched text looks like. Forward-backward then gives every word of a whole text the probability of each language; a
document's language is the one with the largest share of them.

Chains of any length run at once: texts are cut into chunks, each chunk's transfer matrix is multiplied up, the
matrices carry the messages from chunk to chunk, and the words inside follow. That is forward-backward exactly.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents, and characters of them, that a fit takes at most: dealt over the languages, spread by a hash of the id, read whole.
MAX_TRAIN, MAX_CHARS = 1_200, 16_000_000
#: Potentials that forward-backward holds at a time: words times languages.
BLOCK_VALUES = 1_000_000
BUCKETS, CHUNK, FRAGMENT, EPOCHS, RATE, SEED = 1 << 16, 64, 40, 3, 0.3, 11
LEXICON = 20_000
#: Distinct words whose emissions one worker remembers; beyond, it starts anew.
REMEMBERED = 400_000
_HELD: dict = {}
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    n = len(word)
    w = word.encode()
    own = [b"w" + w, *(b"p" + word[:k].encode() for k in (1, 2, 3) if k <= n), *(b"s" + word[-k:].encode() for k in (1, 2, 3, 4) if k <= n)]
    own += [b"2" + word[i : i + 2].encode() for i in range(n - 1)]
    own += [b"3" + word[i : i + 3].encode() for i in range(n - 2)]
    if (lang := lexicon.get(word)) is not None:
        own.append(b"l%d" % lang)
    return [zlib.crc32(x) & (BUCKETS - 1) for x in own]


@dataclass
class Model:
    langs: list[str]
    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), "f4"))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __getstate__(self):
        return {"langs": self.langs, "lexicon": self.lexicon, "weights": self.weights, "moves": self.moves}


class Emissions:
    """Scores of each language for each distinct word met."""

    def __init__(self, model: Model):
        self.model, self.index, self.rows = model, {}, np.zeros((0, len(model.langs)), "f4")

    def of(self, docs: list[list[str]]) -> np.ndarray:
        """Of each word, the row of ``rows`` that has its scores."""
        if len(self.index) > REMEMBERED:
            self.index, self.rows = {}, self.rows[:0]
        index = self.index
        new = list({w for words in docs for w in words}.difference(index))
        if new:
            flat, ends = [], []
            for w in new:
                flat += features(w, self.model.lexicon)
                ends.append(len(flat))
            sums = np.add.reduceat(self.model.weights[np.array(flat)], [0, *ends[:-1]], axis=0)
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, sums])
        return np.array([index[w] for words in docs for w in words])


class Chains:
    """Forward-backward over chains laid end to end, in chunks; a block of chunks at a time is in memory.

    scores(a, b): (b - a, L) log potentials of words a to b; lengths: of the chains, none 0; moves: (L, L) log potentials.
    The move into a chain's first word starts from all languages alike.
    """

    def __init__(self, scores, lengths: np.ndarray, moves: np.ndarray):
        self.scores, self.size = scores, len(moves)
        self.move = np.exp(moves - moves.max())
        width = max(CHUNK, 16 * self.size)  # of a chunk: transfer matrices take no more room than the words
        chunks = -(-lengths // width)
        self.chain = np.repeat(np.arange(len(lengths)), chunks)
        self.nth = np.arange(len(self.chain)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        self.start = np.repeat(np.cumsum(lengths) - lengths, chunks) + self.nth * width
        self.length = np.minimum(width, np.repeat(lengths, chunks) - self.nth * width)
        room = max(1, BLOCK_VALUES // self.size)
        block = (np.cumsum(self.length) - 1) // room
        self.blocks = [(int(a), int(a + n)) for a, n in zip(*np.unique(block, return_index=True, return_counts=True)[1:], strict=True)]
        self._messages(chunks)

    def _emitted(self, a: int, b: int):
        """(chunks, steps, L) potentials of chunks a to b, and which steps there are."""
        lo, hi = int(self.start[a]), int(self.start[b - 1] + self.length[b - 1])
        s = self.scores(lo, hi)
        there = np.arange(int(self.length[a:b].max())) < self.length[a:b, None]
        e = np.ones((*there.shape, self.size))
        e[there] = np.exp(s - s.max(1, keepdims=True))
        return e, there

    def _messages(self, chunks: np.ndarray) -> None:
        """What comes into each chunk from both sides: transfer matrices, multiplied up from chunk to chunk."""
        total, size = len(self.chain), self.size
        transfer = np.empty((total, size, size))
        for a, b in self.blocks:
            e, there = self._emitted(a, b)
            own = np.broadcast_to(np.eye(size), (b - a, size, size)).copy()
            for t in range(e.shape[1]):
                step = (own.reshape(-1, size) @ self.move).reshape(b - a, size, size) * e[:, None, t]
                step /= step.sum((1, 2), keepdims=True)
                own = np.where(there[:, t, None, None], step, own)
            transfer[a:b] = own
        self.before, self.after = np.full((total, size), 1.0 / size), np.ones((total, size))
        first, last = np.cumsum(chunks) - chunks, np.cumsum(chunks) - 1
        order = np.argsort(-chunks, kind="stable")
        for k in range(1, int(chunks.max(initial=0))):
            own = order[: np.searchsorted(-chunks[order], -k, "left")]  # chains of more than k chunks
            now = first[own] + k
            x = np.einsum("ci,cij->cj", self.before[now - 1], transfer[now - 1])
            self.before[now] = x / x.sum(1, keepdims=True)
            now = last[own] - k
            x = np.einsum("cij,cj->ci", transfer[now + 1], self.after[now + 1])
            self.after[now] = x / x.sum(1, keepdims=True)

    def marginals(self):
        """Of each block: its chunks, its words' chains, their marginals, and the parts of the moves into them."""
        for a, b in self.blocks:
            e, there = self._emitted(a, b)
            prior, alpha, beta = np.empty_like(e), np.empty_like(e), np.empty_like(e)
            x = self.before[a:b]
            for t in range(e.shape[1]):
                prior[:, t] = x
                y = (x @ self.move) * e[:, t]
                x = np.where(there[:, t, None], y / y.sum(1, keepdims=True), x)
                alpha[:, t] = x
            x = self.after[a:b]
            for t in range(e.shape[1] - 1, -1, -1):
                beta[:, t] = x
                y = (e[:, t] * x) @ self.move.T
                x = np.where(there[:, t, None], y / y.sum(1, keepdims=True), x)
            p = (alpha * beta)[there]
            p /= p.sum(1, keepdims=True)
            inner = there.copy()
            inner[self.nth[a:b] == 0, 0] = False  # a chain's first word has no move into it
            yield np.repeat(self.chain[a:b], self.length[a:b]), p, prior[inner], (e * beta)[inner]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray):
    """Marginals of each word, of chains laid end to end, and the expected number of each move between words of a chain."""
    chains = Chains(lambda a, b: scores[a:b], lengths, moves)
    found, expected = [np.zeros((0, len(moves)))], np.zeros(moves.shape)
    for _, p, left, right in chains.marginals():
        found.append(p)
        norm = ((left @ chains.move) * right).sum(1)
        expected += left.T @ (right / norm[:, None])
    return np.concatenate(found), chains.move * expected


def shares(scores, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Mean probability of each language over the words of each chain; blocks of words are in memory, never all of a long text's."""
    total = np.zeros((len(lengths), len(moves)))
    for chain, p, _, _ in Chains(scores, lengths, moves).marginals():
        at, first = np.unique(chain, return_index=True)
        total[at] += np.add.reduceat(p, first, axis=0)
    return total / lengths[:, None]


def _sample(docs: DataFrame, max_train: int, max_chars: int) -> list:
    """(text, lang) of documents to learn from. The bounds are dealt over the languages, so that a rare one keeps what it has; what a language
    leaves goes to the others."""
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and doc_id is not null and text is not null").filter(common.remainder("doc_id", 4) != 2)
    sizes = {r.lang: (r.n, r.chars or 0) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}  # a row a language
    share: dict[str, float] = {}
    for bound, of in ((max_train, 0), (max_chars, 1)):
        left, n = bound, len(sizes)
        for lang, size in sorted(sizes.items(), key=lambda x: (x[1][of], x[0])):
            quota = min(size[of], left / n)
            share[lang] = min(share.get(lang, 1.0), quota / size[of] if size[of] else 1.0)
            left, n = left - quota, n - 1
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if all(x == 1.0 for x in share.values()):
        taken = known
    else:
        part = docs.sparkSession.createDataFrame([(k, int(v * (1 << 30))) for k, v in share.items()], "its_lang string, part long")
        taken = known.join(F.broadcast(part), F.col("lang") == F.col("its_lang")).filter(place < F.col("part"))
    rows, room = [], Counter()
    for r in taken.orderBy(place, "doc_id", "text").toLocalIterator():  # about the bounds; what hashes put beyond is left out a language at a time
        if room[r.lang, 0] < 1.25 * share[r.lang] * sizes[r.lang][0] and room[r.lang, 1] <= 1.25 * share[r.lang] * sizes[r.lang][1]:
            room[r.lang, 0] += 1
            room[r.lang, 1] += len(r.text)
            rows.append(r)
    return rows


def fit(docs: DataFrame, *, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS) -> Model:
    """Learn from text and lang of documents whose crc32(doc_id) mod 4 isn't 2, about ``max_train`` documents and ``max_chars`` of text at most.

    Every language has its share of the bounds, however rare it is. Rows of null lang, doc_id or text, or without a letter, teach nothing;
    rows that share a doc_id are taken together or not at all. Without any row the model knows no language and says ``und``. Runs jobs while it is
    called: the model is an object on the driver.
    """
    rows = _sample(docs, max_train, max_chars)
    texts = [(words_of(r.text), r.lang) for r in rows]
    texts = [(w, lang) for w, lang in texts if w]
    langs = sorted({lang for _, lang in texts})
    model = Model(langs, weights=np.zeros((BUCKETS, len(langs)), "f4"), moves=np.zeros((len(langs), len(langs))))
    if len(langs) < 2:
        return model
    code = {lang: i for i, lang in enumerate(langs)}
    count = [Counter() for _ in langs]
    for words, lang in texts:
        count[code[lang]].update(set(words))
    whole = sum(count, Counter())
    for i, own in enumerate(count):
        model.lexicon.update((w, i) for w, c in own.most_common(LEXICON) if c >= 3 and c >= 0.9 * whole[w])
    _learn(model, [(words, code[lang]) for words, lang in texts])
    return model


def _learn(model: Model, texts: list[tuple[list[str], int]]) -> None:
    rng, size = np.random.default_rng(SEED), len(model.langs)
    vocabulary = {w: i for i, w in enumerate({w: None for words, _ in texts for w in words})}
    flat = [features(w, model.lexicon) for w in vocabulary]
    count = np.array([len(f) for f in flat])
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    flat = np.array([x for f in flat for x in f])
    fragments = [(np.array([vocabulary[w] for w in words[i : i + FRAGMENT]]), lang) for words, lang in texts for i in range(0, len(words), FRAGMENT)]
    power_w, power_m = np.full((BUCKETS, size), 1e-6, "f4"), np.full((size, size), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(fragments))
        for at in range(0, len(order), 512):  # 128 chains of 4 fragments
            own = [fragments[i] for i in order[at : at + 512]]
            ids = np.concatenate([f for f, _ in own])
            label = np.repeat([y for _, y in own], [len(f) for f, _ in own])
            lengths = np.array([sum(len(f) for f, _ in own[i : i + 4]) for i in range(0, len(own), 4)])
            used, back = np.unique(ids, return_inverse=True)
            pos = np.repeat(begin[used] - np.concatenate([[0], np.cumsum(count[used])[:-1]]), count[used]) + np.arange(count[used].sum())
            feats = flat[pos]
            starts = np.concatenate([[0], np.cumsum(count[used])[:-1]])
            scores = np.add.reduceat(model.weights[feats], starts, axis=0)[back]
            p, expected = forward_backward(scores, lengths, model.moves)
            slope = -p
            slope[np.arange(len(ids)), label] += 1
            by_word = np.zeros((len(used), size))
            np.add.at(by_word, back, slope)
            grad = np.zeros((BUCKETS, size), "f4")
            np.add.at(grad, feats, np.repeat(by_word, count[used], axis=0).astype("f4"))
            power_w += grad**2
            model.weights += RATE * grad / np.sqrt(power_w)
            seen = np.zeros((size, size))
            inner = np.ones(len(ids), bool)
            inner[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
            np.add.at(seen, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
            step = seen - expected
            power_m += step**2
            model.moves += RATE * step / np.sqrt(power_m)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its words' mean probability) of every row of (doc_id, text), over the whole text.

    ``und`` and 0 where the text is null or has no letter. Of languages with equal shares the first by name is taken. Rows are answered each for
    its own text, whatever their ids; other columns are ignored, and an empty table stays empty. Very long texts pass in blocks.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    thin = docs.select("doc_id", "text")
    kind = thin.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        m = held.value
        if _HELD.get("model") is not m:  # a worker serves many tasks
            _HELD.update(model=m, emissions=Emissions(m))
        emissions = _HELD["emissions"]
        for batch in batches:
            for part in common.parts(batch, 1):
                docs_words = [words_of(t) if m.langs else [] for t in part.column(1).to_pylist()]
                lengths = np.array([len(w) for w in docs_words])
                full = np.flatnonzero(lengths)
                lang, score = ["und"] * len(docs_words), np.zeros(len(docs_words))
                if len(full):
                    at = emissions.of(docs_words)
                    share = shares(lambda a, b, at=at: emissions.rows[at[a:b]], lengths[full], m.moves)
                    for i, k in zip(full, share.argmax(1), strict=True):
                        lang[i] = m.langs[k]
                    score[full] = np.clip(share.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return thin.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", F.coalesce(common.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
