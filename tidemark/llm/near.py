"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, verified multiset overlap.

A text is the multiset of its runs of five words. Every (run, weight cell) is a Poisson process of points (time, component);
a signature's component is the earliest time among the processes of all cells that the text's counts cover. The cells
are discretised in a hierarchy: cells 1, 2, 3-4, 5-8, ... share a process each, whose points are thinned to the cell
they fall into, so that a count w costs log w processes. Times beyond the limit at which all components are known
with great likelihood are never drawn (and the limit is doubled where one is still open), so a signature costs a hash for
each run and about m ln m points instead of m hashes for each run.

Texts of one multiset are one class. Classes that share a band form a bucket; every member is verified against the
bucket's best connected class, first of all the one that it meets most often, which settles most copies, in any number, with one
pair each; then against those that it isn't linked with yet. Buckets that still hold several components are compared exactly: their members are
cut by size, since texts that are alike to 0.8 differ by a quarter at most, and into blocks of bounded numbers and bytes, each of one
large component or of small ones; blocks that can hold a link are compared pair by pair, and only links leave a task. Links make
components; the smallest document of a component stands for it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8^5)^28 = 1.5e-5.
BANDS, ROWS = 28, 5
SIZE = BANDS * ROWS
#: Members that one task compares with each other, and with one centre; groups of any size are dealt to as many tasks as they need.
BLOCK, STAR = 256, 1024
#: Bytes of text in a block; one text may have more.
BLOCK_BYTES = 4_000_000
#: Documents of one class from which its name is broadcast; a share of all, so that such classes are few in tables of any size.
HOT_ROWS, HOT_SHARE = 20_000, 1e-5
#: Ids beyond this are joined by Spark's own choice instead of a broadcast.
MAX_BROADCAST_IDS = 1_000_000


def multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(words.grams(words.hashes(words.words_of(text)), SHINGLE), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 1.0


def _draw(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state and 64 bits of every process."""
    state = state + np.uint64(0x9E3779B97F4A7C15)
    return state, words.mix(state)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = SIZE) -> np.ndarray:
    """A row of m earliest times for each non-empty multiset, all drawn together."""
    run, doc, count, low, width = [], [], [], [], []
    for d, (u, c) in enumerate(sets):
        level, size = 0, 1
        while (covered := c > level).any():  # cells level+1 ... level+size
            n = int(covered.sum())
            run.append(words.mix(u[covered] + np.uint64(level * 0x632BE59BD9B4E019 & (2**64 - 1))))
            doc.append(np.full(n, d))
            count.append(c[covered])
            low.append(np.full(n, level))
            width.append(np.full(n, size))
            level, size = level + size, level + size
    out = np.full((len(sets), m), np.inf)
    if not run:
        return out
    state0, doc0, count0, low0, width0 = map(np.concatenate, (run, doc, count, low, width))
    limit = (np.log(m) + 4) / np.array([max(1, c.sum()) for _, c in sets])
    open_docs = np.ones(len(sets), bool)
    open_docs[[i for i, (u, _) in enumerate(sets) if not len(u)]] = False
    while open_docs.any():
        own = open_docs[doc0]
        state, doc, count, low, width = state0[own], doc0[own], count0[own], low0[own], width0[own]
        time = np.zeros(len(state))
        while len(state):
            state, bits = _draw(state)
            time = time - np.log(((bits >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / (m * width)
            near = time <= limit[doc]
            state, doc, count, low, width, time, bits = (x[near] for x in (state, doc, count, low, width, time, bits))
            place = words.mix(bits ^ np.uint64(0xD1B54A32D192ED03))
            part = ((place >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype("i8")
            cell = low + 1 + ((place & np.uint64(0xFFFFFFFF)) * width.astype("u8") >> np.uint64(32)).astype("i8")
            hit = cell <= count
            np.minimum.at(out, (doc[hit], part[hit]), time[hit])
        open_docs &= ~np.isfinite(out).all(1)
        limit = np.where(open_docs, limit * 2, limit)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, cls (128 bits of the multiset; null if the text has no word), bands, runs (how many) and bytes."""

    def sign(batches):
        for batch in batches:
            for part in common.parts(batch, 1, size=4_000_000):  # a run of words takes some 100 bytes here
                sets = [multiset(t) if t else (np.zeros(0, "u8"), np.zeros(0, "i8")) for t in part.column(1).to_pylist()]
                bits = signatures(sets).view("u8")
                keys = words.mix((words.mix(bits).reshape(len(sets), BANDS, ROWS) * words._PRIMES[:ROWS]).sum(2, dtype="u8")).view("i8")
                full = [len(u) > 0 for u, _ in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([xxhash.xxh3_128_digest(u.tobytes() + c.tobytes()) if f else None for (u, c), f in zip(sets, full, strict=True)], pa.binary()), pa.array([k.tolist() if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())), pa.array([int(c.sum()) for _, c in sets], pa.int64()), pc.fill_null(pc.cast(pc.binary_length(part.column(1)), pa.int64()), 0)],
                    ["doc_id", "cls", "bands", "runs", "bytes"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.lean(sign, "words"), "doc_id long, cls binary, bands array<long>, runs long, bytes long")


def _with_text(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """ids, which has a doc_id, and the documents' whole texts."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("whole_text"))
    return own.join(common.small(ids, MAX_BROADCAST_IDS), "doc_id")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the written, distinct pairs (centre a, member b) those whose whole texts reach the threshold, with their similarity.

    A centre's text comes first, then its members'; a centre of many has its members dealt to salts, each with the centre's text. A member's
    text is shuffled once for each pair that it is in.
    """
    sizes = common.written(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")), "centres")
    members = _with_text(pairs.select(F.col("b").alias("doc_id"), "a"), docs)
    members = members.join(common.small(sizes, MAX_BROADCAST_IDS), "a").select("a", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "whole_text")
    centres = _with_text(sizes.select(F.col("a").alias("doc_id"), "salts"), docs)
    centres = centres.select(F.col("doc_id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "doc_id", "whole_text")
    dealt = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def verify(batches):
        key, held = None, []
        for batch in batches:
            out: list = [[], [], []]
            for a, salt, kind, b, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, salt) != key:
                    key, held = (a, salt), []
                own = multiset(text or "")
                if not kind:
                    held.append(own)
                elif (same := max((weighted_jaccard(h, own) for h in held), default=0.0)) >= THRESHOLD:
                    for col, v in zip(out, (a, b, same), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])

    return dealt.mapInArrow(common.lean(verify, "words"), "a long, b long, similarity double")


def all_similar(left: list, right: list) -> np.ndarray:
    """Weighted Jaccard similarities of all multisets of one list with all of another: exact, by products of incidence matrices.

    The k-th copy of a run counts as an element of its own, so that shared elements number the sum of the smaller counts. Elements
    of a single multiset can't be shared and are left out.
    """

    def elements(sets):
        ids, rows = [], []
        for row, (u, c) in enumerate(sets):
            copy = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            ids.append(words.mix(np.repeat(u, c) + copy.astype("u8") * np.uint64(0x9E3779B97F4A7C15)))
            rows.append(np.full(len(copy), row))
        return (np.concatenate(x) for x in (ids, rows))

    (a, at), (b, bt) = elements(left), elements(right)
    shared = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), "f4")
    ka, kb = np.isin(a, shared), np.isin(b, shared)
    ca, cb, at, bt = np.searchsorted(shared, a[ka]), np.searchsorted(shared, b[kb]), at[ka], bt[kb]
    for lo in range(0, len(shared), 8192):
        x, y = np.zeros((len(left), 8192), "f4"), np.zeros((len(right), 8192), "f4")
        own, other = (ca >= lo) & (ca < lo + 8192), (cb >= lo) & (cb < lo + 8192)
        x[at[own], ca[own] - lo] = 1
        y[bt[other], cb[other] - lo] = 1
        total += x @ y.T
    n, m = (np.array([c.sum() for _, c in sets], "f8") for sets in (left, right))
    return total / (n[:, None] + m[None] - total)


_PLACE = ["band", "pool", "k"]


def _links_between(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join components of one group of buckets; of the links between two components within two blocks, one.

    members: (grp, doc_id, component, runs, bytes). A group is cut into bands of sizes that grow by 1 / THRESHOLD, so that links are within a band or
    between neighbours. A band's members are dealt to blocks by a hash: those of a component that fills a block to blocks of its own, which aren't compared
    with each other, the others to common ones. So no task holds more than two blocks, whatever the group's size, and no pair but a link leaves it.
    """
    width = F.lit(-math.log(THRESHOLD) * (1 + 1e-9))
    banded = members.withColumn("band", F.floor(F.log(F.greatest("runs", F.lit(1))) / width).cast("long"))
    full = banded.groupBy("grp", "band", "component").agg(F.count("*").alias("n")).filter(F.col("n") >= BLOCK).select("grp", "band", "component", F.col("component").alias("pool"))
    pooled = common.written(banded.join(full, ["grp", "band", "component"], "left").withColumn("pool", F.coalesce("pool", F.lit(-(2**63)))), "pooled")
    counts = pooled.groupBy("grp", "band", "pool").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    cut = common.written(pooled.join(counts, ["grp", "band", "pool"]).withColumn("k", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).drop("blocks"), "members")
    blocks = cut.select("grp", *_PLACE).distinct()
    left, right = (blocks.select("grp", *[F.col(c).alias(side + c) for c in _PLACE]) for side in "lr")
    same = left.join(right.withColumn("lband", F.col("rband")), ["grp", "lband"]).filter("struct(lpool, lk) <= struct(rpool, rk)")
    above = left.join(right.withColumn("lband", F.col("rband") - 1), ["grp", "lband"])
    many = F.lit(-(2**63))
    pairs = same.unionByName(above).filter((F.col("lpool") != F.col("rpool")) | (F.col("lpool") == many)).select("grp", *[side + c for side in "lr" for c in _PLACE])
    pairs = common.written(pairs, "block-pairs")
    texts = _with_text(cut.drop("bytes", "runs"), docs)

    def sent(side: str) -> DataFrame:
        own = common.small(pairs.withColumnsRenamed({side + c: c for c in _PLACE}), MAX_BROADCAST_IDS)
        out = texts.join(own, ["grp", *_PLACE]).withColumnsRenamed({c: side + c for c in _PLACE})
        return out.select("grp", *[s + c for s in "lr" for c in _PLACE], F.lit(side).alias("side"), "doc_id", "component", "whole_text")

    itself = F.expr("lband = rband AND lpool = rpool AND lk = rk")
    both = sent("l").unionByName(sent("r").filter(~itself))  # a block compared with itself comes once

    def compare(key, table):
        ids, comp = (np.asarray(table.column(c)) for c in ("doc_id", "component"))
        left = np.asarray([s == "l" for s in table.column("side").to_pylist()])
        found: list = [[], []]
        left, right = np.flatnonzero(left), np.flatnonzero(~left)
        if key[1:4] == key[4:7]:
            right = left
        if len(left) and len(right) and len(np.unique(comp)) > 1:
            texts = table.column("whole_text").to_pylist()
            sets = {int(k): multiset(texts[k] or "") for k in np.union1d(left, right)}
            same = all_similar([sets[int(k)] for k in left], [sets[int(k)] for k in right])
            x, y = np.nonzero((same >= THRESHOLD - 1e-6) & (comp[left][:, None] != comp[right][None]))
            above: dict = {}

            def root(c):
                while above.get(c, c) != c:
                    c = above[c]
                return c

            for p, q in zip(left[x].tolist(), right[y].tolist(), strict=True):
                u, v = root(int(comp[p])), root(int(comp[q]))
                if u != v and weighted_jaccard(sets[p], sets[q]) >= THRESHOLD:
                    above[max(u, v)] = min(u, v)
                    found[0].append(min(int(ids[p]), int(ids[q])))
                    found[1].append(max(int(ids[p]), int(ids[q])))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return both.groupBy("grp", *[side + c for side in "lr" for c in _PLACE]).applyInArrow(compare, "a long, b long")


def _named(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, class_id of every row. Classes of a great many rows are few and broadcast, so that no task gets all rows of one."""
    least = max(HOT_ROWS, int(HOT_SHARE * signed.count()))
    hot = classes.filter(F.col("n") >= least).select("cls", "rep")  # 1 / HOT_SHARE rows at most
    with_hot = signed.select("doc_id", "cls").filter("cls is not null").join(F.broadcast(hot), "cls", "left")
    rest = with_hot.filter("rep is null").drop("rep").join(classes.filter(F.col("n") < least).select("cls", "rep"), "cls", "left")
    known = with_hot.filter("rep is not null").unionByName(rest).select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"))
    return known.unionByName(signed.filter("cls is null").select("doc_id", F.col("doc_id").alias("class_id")))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, group_id, keep of every row of (doc_id, text).

    class_id is the smallest document of the same multiset of shingles, group_id the smallest of the component of
    links of weighted Jaccard similarity 0.8 or more, keep marks it. Texts of fewer than five words are one shingle. Null
    texts and those without a word belong to no group: they stand alone, as do rows of null doc_id. Rows that share a
    doc_id count as one document. Very long texts are read whole, slices and blocks are bounded by bytes; an empty table gives an empty one.
    Other columns are ignored. Runs jobs while it is called.
    """
    signed = common.written(_signed(docs), "signed")
    known = signed.filter("cls is not null and doc_id is not null")
    classes = common.written(known.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("runs").alias("runs"), F.max("bytes").alias("bytes"), F.count("*").alias("n")), "classes")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    buckets = common.written(banded.join(shared.select("band", "key", "n"), ["band", "key"]), "buckets")
    # the member that meets most others: among copies edited from one text, the one that was edited least
    meets = buckets.groupBy("rep").agg(F.sum("n").alias("meets"))
    ranked = common.written(buckets.join(meets, "rep"), "ranked")
    most = F.max(F.struct("meets", (-F.col("rep")).alias("rep")))
    centres = ranked.groupBy("band", "key").agg(most.alias("most")).select("band", "key", (-F.col("most.rep")).alias("centre"))
    met = ranked.join(centres, ["band", "key"]).filter("rep <> centre").groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("n"))
    best = F.max_by("a", F.struct("n", -F.col("a")))
    met = common.written(met, "met")
    pairs = common.written(met.groupBy("b").agg(best.alias("a")).select("a", "b"), "pairs")
    # rows of one doc_id with other texts are one document
    twice = known.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("doc_id")
    again = known.join(twice, "doc_id").select("doc_id", "cls").distinct().join(classes.select("cls", "rep"), "cls").filter("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    links = common.written(_verified(pairs, docs).select("a", "b").unionByName(again), "links")
    labels = components(links)
    # a member's other centres, unless it is linked with them by now
    at, to = (labels.select(F.col("node").alias(c), F.col("component").alias("c" + c)) for c in "ab")
    others = met.select("a", "b").join(pairs, ["a", "b"], "left_anti").join(at, "a", "left").join(to, "b", "left")
    others = common.written(others.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "pairs")
    if others.limit(1).count():
        links = common.written(links.unionByName(_verified(others, docs).select("a", "b")), "links")
        labels = components(links)
    labelled = buckets.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("band", "key", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = common.written(labelled, "labelled")
    mixed = labelled.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2").select("band", "key", F.col("lo").alias("first"))
    within = common.written(labelled.join(mixed, ["band", "key"]).select("first", "rep", "component").distinct(), "mixed")
    if within.limit(1).count():
        # buckets that share components are one group: a member is then compared once, not once for each of its bands
        grouped = components(within.select(F.col("first").alias("a"), F.col("component").alias("b")).distinct())
        named = grouped.select(F.col("node").alias("component"), F.col("component").alias("grp"))
        members = within.select("rep", "component").distinct().join(named, "component").join(classes.select("rep", "runs", "bytes"), "rep").select("grp", F.col("rep").alias("doc_id"), "component", "runs", "bytes")
        links = common.written(links.unionByName(_links_between(members, docs)), "links")
        labels = components(links)
    grouped = _named(signed, classes).join(labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    return grouped.select("doc_id", "class_id", F.coalesce("component", "class_id").alias("group_id")).withColumn("keep", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those whose group has a smaller one; of rows that share a kept doc_id one stays."""
    groups = common.written(near_groups(docs), "near-groups")
    gone = groups.filter("not keep").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = groups.filter("keep and doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if twice:
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
    return kept


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents"))
