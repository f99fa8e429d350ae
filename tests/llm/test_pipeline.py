"""The stages together, on the smallest documents, against what single operators and plain code say."""

import re
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import common, mixing, near, quality, token_files, words

DIR = "/root/testdata/sf0.01"


def test_stages_keep_the_contract(spark):
    docs = common.table(spark, DIR, "documents")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "token_files"]
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = common.written(stage(spark, docs, DIR), "t")
        assert out.schema.simpleString() == docs.schema.simpleString()
        now = [r.doc_id for r in out.select("doc_id").collect()]
        assert now and set(now) <= ids
        if name == "quality":
            labels = {r.doc_id: r.quality for r in common.table(spark, DIR, "labels").collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert np.mean([i in set(now) for i in good]) > 0.97
            assert np.mean([i in set(now) for i, q in labels.items() if q == 0]) < 0.2
        if name == "near_dedup":
            kept = {r.doc_id for r in near.near_groups(docs).filter("keep").collect()}
            assert sorted(now) == sorted(kept)
        if name == "decontaminate":
            items = [" ".join(r.text.lower().split()) for r in common.table(spark, DIR, "benchmark").collect()]
            held = {r.doc_id for r in docs.collect() if any(i in " ".join(r.text.lower().split()) for i in items)}
            assert held and held.isdisjoint(now) and len(docs.select("doc_id").collect()) - len(now) <= 3 * len(held)
        if name == "mix":
            want = {r.doc_id: r.copies for r in mixing.copies(docs).collect() if r.copies}
            assert {i: now.count(i) for i in set(now)} == want
        docs = out
    last = cp.STAGES[-1][1](spark, docs, DIR).collect()
    enc = token_files.encoder(P.path(cp.TOKENIZER))
    n = {r.doc_id: len(enc.library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert all(r.n_tokens == n[r.doc_id] for r in last) and len(last) == docs.count()


def test_run_is_the_stages(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.agg(F.count("*"), F.count_distinct("start")).first()[0] > 0


def _held() -> float:
    """MB of this process, without mapped files."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_a_reused_worker_holds_nothing_of_the_stages_before(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    work, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: work.append(f) or plain(self, f, *a, **k))
    labels = common.table(spark, "/root/testdata/sf0.001", "labels")
    quality.score(docs, quality.fit(docs, labels))
    before = _held()
    token_files.encoder(P.path(cp.TOKENIZER)).encode(["words of the stage before"])
    words.hashes(["word"])
    freed = [pa.array([str(i) * 1000] * 2000) for i in range(50)]
    del freed
    batch = docs.limit(50).toArrow().combine_chunks().to_batches()[0]
    assert sum(b.num_rows for b in work[-1](iter([batch, batch]))) == 100
    assert not token_files._ENCODERS and not words._KNOWN
    assert _held() < before + 60
    # a stage keeps what it uses itself, from task to task
    words.hashes(["word"])
    near._signed(docs)
    assert sum(b.num_rows for b in work[-1](iter([batch]))) == 50
    assert len(words._KNOWN) > 1 and "word" in words._KNOWN
