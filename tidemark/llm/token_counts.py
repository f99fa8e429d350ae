"""Token counts with the whole-token shortcut for sentencepiece BPE models.

Proved once for a model, before any text is read (``Proof``):

* cuts: a merge makes pieces only, so where no piece holds character a before character b, no merge crosses from an
  a to a b. If no piece has a space mark after another character, a text falls into words at its spaces, and each
  is merged alone; if no piece holds a line end, so do the lines.
* whole tokens: every piece "<mark>word" that the library itself turns into that one piece counts 1 without merging.

Words that match a whole token are counted directly; only the rest is merged, once per distinct word and worker.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Distinct words that one worker remembers; beyond, it starts anew. Bounds memory, never results.
REMEMBERED = 600_000
MARK = "▁"
_COUNTERS: dict = {}


class Proof:
    def __init__(self, sp):
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        plain = "fi ﬁ １  Á x"
        kept = sp.decode(sp.encode(plain)) == plain and sp.encode("ab", out_type=str)[0].startswith(MARK)
        self.words = kept and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.lines = self.words and not any("\n" in p for p in pieces) and sp.encode("\nx", out_type=str)[:2] == [MARK, "<0x0A>"]
        heads = [p for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]]
        self.whole = [p[1:] for p, ids in zip(heads, sp.encode([p[1:] for p in heads], num_threads=1), strict=True) if len(ids) == 1] if self.words else []


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.proof = Proof(self.sp)
        self.whole = dict.fromkeys(self.proof.whole, 1)
        self.known = dict(self.whole)
        self.tails: dict[str, int] = {}

    def _merge(self, words: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(words, num_threads=1)] if words else []

    def _learn(self, words: set[str]) -> None:
        """words: texts without a space, or a run of spaces before or alone; each stands after one space mark."""
        plain = [w for w in words if not self.proof.lines or "\n" not in w]
        self.known.update(zip(plain, self._merge(plain), strict=True))
        self.known[""] = 1  # the mark alone
        cut = {w: w.split("\n") for w in words.difference(plain)}
        heads = list({x[0] for x in cut.values() if x[0] not in self.known})
        tails = list({t for x in cut.values() for t in x[1:] if t and t not in self.tails})
        self.known.update(zip(heads, self._merge(heads), strict=True))
        self.tails.update((t, n - 2) for t, n in zip(tails, self._merge([f"\n{t}" for t in tails]), strict=True))
        for w, (head, *rest) in cut.items():
            self.known[w] = self.known[head] + sum(1 + (self.tails[t] if t else 0) for t in rest)

    def count(self, texts: list[str]) -> list[int]:
        if not self.proof.words:
            return self._merge(texts)
        out, cut = [], []
        for text in texts:
            text = text.replace(MARK, " ")
            # the library puts one mark before the text; every further space of a run belongs to the word after it
            cut.append([] if not text else text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [x[1:] for x in re.findall(r" +[^ ]*", f" {text}")])
        known = self.known
        self._learn({w for words in cut for w in words if w not in known})
        out = [sum([known[w] for w in words]) for words in cut]
        if len(known) + len(self.tails) > REMEMBERED:
            self.known, self.tails = dict(self.whole), {}
        return out


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; a null text counts as empty, an empty one has 0 tokens.
    Repeated rows and ids stay as they are; other columns are ignored."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()

    def counted(batches):
        c = counter(model)
        for batch in batches:
            for part in common.parts(batch, 1, rows=512):
                texts = part.column(1).to_pylist()
                n = c.count(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return thin.mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
