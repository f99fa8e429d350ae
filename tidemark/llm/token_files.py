"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, memory-mapped.

A data set is a folder of shards. Shard k has

* ``<name>.ids``   little-endian unsigned ids, 2 bytes each where the vocabulary allows it, else 4;
* ``<name>.off``   little-endian int64: the shard's n_docs + 1 offsets, in ids, from the shard's start;
* ``<name>.key``   little-endian int64: the document ids, and
* ``<name>.nul``   one byte a document: 1 where the document id is null.

``manifest.json`` lists the shards in order with the number of ids before each one (``base``): the prefix sums of
the shards' own counts, so that a document's place in the whole is base + offset. Shards are written by the tasks
themselves under names that no two attempts share; the manifest names those of the attempts that succeeded.
"""

from __future__ import annotations

import codecs
import json
import re
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Distinct words that one worker remembers; beyond, it starts anew. Bounds memory, never results.
REMEMBERED = 900_000
#: What stands before a word (a line end, HEAD or a space that isn't there), its letters, and ASCII punctuation after them, without
#: apostrophes ("'s" is a pre-token). Letters, with a space before them or not, are one pre-token, and so is the ending.
_WORD = re.compile(r"([\x01\n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
#: The character that byte-level pre-tokenization has for each byte, but for the line end, which parts the words here.
_BYTES = "".join(chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(256 + b if b < 33 else 256 + 33 + b - 127 if b < 161 else 323) for b in range(256)).replace(chr(256 + 10), "\n")
_ENCODERS: dict = common.remembered("encoders", {})


class WordEncoder:
    """Ids of whole texts from a byte-level BPE of the tokenizers library, word by word.

    Byte-level pre-tokenization never joins a character that isn't white space to the space after it, and so a text
    cut before every single space between two such characters encodes as its parts do. Parts are looked up; of those not
    met before, letters are a pre-token and go to the library's model as such, without the cost of telling pre-tokens
    apart, and others to the library as texts, many at a time. Texts with other white space in such places go to it whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        pre = json.loads(self.library.to_str())
        self.by_word = not pre.get("normalizer") and (pre.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not (pre["pre_tokenizer"].get("add_prefix_space")) and not any(" " in s for s in self.special)
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.end_of_line = np.array(line, self.dtype).tobytes()
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, parts: list[str]) -> list[bytes]:
        """Ids of single parts, encoded as one text of a line each: a lone line end between two characters that aren't
        white space is a token of its own."""
        text = "\n".join(parts)
        if self.line is None or any(s in text for s in self.special):
            return self._library(parts)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        cut = np.flatnonzero(ids == self.line)
        if len(cut) != len(parts) - 1:
            return self._library(parts)
        return self._cut(ids, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)])

    def _cut(self, ids: np.ndarray, begins: list[int], ends: list[int]) -> list[bytes]:
        raw, width = ids.tobytes(), self.dtype.itemsize
        return [raw[a * width : b * width] for a, b in zip(begins, ends, strict=True)]

    def _pretokens(self, words: list[str]) -> list[bytes]:
        """Ids of words that are a pre-token each, with the space before them that they have."""
        tokenize, ids, ends = self.model.tokenize, [], []
        for word in codecs.charmap_decode("\n".join(words).encode(), "strict", _BYTES)[0].split("\n"):
            ids += [t.id for t in tokenize(word)]
            ends.append(len(ids))
        return self._cut(np.array(ids, self.dtype), [0, *ends[:-1]], ends)

    def _learn(self, words: list[str]) -> None:
        """Words not met before: put together from their certain parts, and the parts encoded, many at a time.

        A word is known by what it is and what stands before it: a space, a line end (its first character), or nothing (HEAD).
        """
        known, text = self.known, "\n".join(words)
        special = [s for s in self.special if s in text]
        stems, others = {}, {}
        joined, names, tails = [], [], []
        for w in words:
            m = _WORD.match(w)
            if m and not (special and any(s in w for s in special)):
                before, stem, ending = m.groups()
                name, tail = HEAD + stem if before else stem, HEAD + ending if ending else ""
                if name not in known:
                    stems[name] = stem if before else " " + stem
                if tail and tail not in known:
                    others[tail] = ending
            elif w[0] == "\n":
                name, tail = HEAD + w[1:], ""
                if name not in known:
                    others[name] = w[1:]
            else:
                name, tail = w, ""
                others[w] = w[1:] if w[0] == HEAD else " " + w
            if name != w:
                joined.append(w)
                names.append(name)
                tails.append(tail)
        for parts, encoded in ((stems, self._pretokens), (others, self._lines)):
            own, some = list(parts), list(parts.values())
            for at in range(0, len(some), 20_000):
                known.update(zip(own[at : at + 20_000], encoded(some[at : at + 20_000]), strict=True))
        line = self.end_of_line
        for w, name, tail in zip(joined, names, tails, strict=True):
            ids = known[name] + known[tail] if tail else known[name]
            known[w] = line + ids if w[0] == "\n" else ids

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids as bytes, one for each text. Words are told apart by Arrow's dictionaries; Python sees each distinct one once a call."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        said = texts.to_numpy(zero_copy_only=False).tolist()
        out: list = [b""] * len(said)
        plain = [bool(t) and self.by_word and _plain(t) for t in said]
        cut = [i for i, p in enumerate(plain) if p]
        whole = [i for i, p in enumerate(plain) if said[i] and not p]
        if cut:
            own = texts if len(cut) == len(said) else texts.filter(pa.array(plain))
            lists = pc.split_pattern(pc.binary_join_element_wise(HEAD, pc.replace_substring(own, "\n", " \n"), ""), " ")
            coded = lists.flatten().dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(self.known) > REMEMBERED:
                self.known.clear()
            ids = list(map(self.known.get, distinct))
            if new := [k for k, x in enumerate(ids) if x is None]:
                self._learn([distinct[k] for k in new])
                for k in new:
                    ids[k] = self.known[distinct[k]]
            taken = pa.array(ids, pa.large_binary()).take(coded.indices)
            at = np.frombuffer(taken.buffers()[1], "<i8")[lists.offsets.to_numpy()].tolist()
            raw = memoryview(taken.buffers()[2] or b"")
            for i, a, b in zip(cut, at[:-1], at[1:], strict=True):
                out[i] = raw[a:b].tobytes()
        if whole:
            for i, ids in zip(whole, self._library([said[i] for i in whole]), strict=True):
                out[i] = ids
        return out


#: Stands before a text's first word; texts that have it themselves are encoded whole.
HEAD = "\x01"
#: White space other than the space and the line end, by code point.
_SPACES = ("\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")


def _plain(text: str) -> bool:
    """No white space but lone spaces and lone line ends between other characters."""
    return not (HEAD in text or text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(map(text.__contains__, _SPACES)))


def encoder(path: str) -> WordEncoder:
    """One for each worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, uri: str, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode all documents in ascending id order into the folder ``uri``; returns its manifest.

    Texts that are null count as empty and have the end id alone. Documents of one id stand in the order of their
    texts; a null id comes first. An empty table gives a manifest without shards. Columns other than the two named are ignored.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = keyed.repartitionByRange("key").sortWithinPartitions("key", "text")

    def shard(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        keys, nulls, lengths = [], [], []
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"

        def ids():
            for batch in batches:
                key = batch.column(0)
                keys.append(np.asarray(key.fill_null(0), "<i8"))
                nulls.append(np.asarray(key.is_null()).astype("u1"))
                for part in common.parts(batch, 1, rows=2048):
                    found = enc.encode(part.column(1))
                    lengths.extend(len(x) // enc.dtype.itemsize + 1 for x in found)
                    yield end.join(found) + end

        first = next(stream := ids(), None)
        if first is None:
            return
        common.write_bytes(f"{uri}/{name}.ids", (c for part in ([first], stream) for c in part))
        off = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        common.write_bytes(f"{uri}/{name}.off", [off.tobytes()])
        common.write_bytes(f"{uri}/{name}.key", [np.concatenate(keys).tobytes()])
        common.write_bytes(f"{uri}/{name}.nul", [np.concatenate(nulls).tobytes()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "name": [name], "n_docs": pa.array([len(lengths)], pa.int64()), "n_ids": pa.array([int(off[-1])], pa.int64()), "width": pa.array([enc.dtype.itemsize], pa.int32())})

    done = sorted(ordered.mapInArrow(common.lean(shard, "encoders"), "part long, name string, n_docs long, n_ids long, width int").collect())
    bases = [0, *accumulate(r.n_ids for r in done)]
    manifest = {"tokenizer": tokenizer.rpartition("/")[2], "end_id": end_id, "n_ids": bases[-1], "shards": [{"name": r.name, "n_docs": r.n_docs, "n_ids": r.n_ids, "width": r.width, "base": b} for r, b in zip(done, bases, strict=False)]}
    common.write_bytes(f"{uri}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def documents_of(uri: str, shard: dict):
    """(keys, null marks, global starts, ids of each document) of one shard, from memory maps; yields one tuple a document."""
    with common.mapped_file(f"{uri}/{shard['name']}.ids") as a, common.mapped_file(f"{uri}/{shard['name']}.off") as b, common.mapped_file(f"{uri}/{shard['name']}.key") as c, common.mapped_file(f"{uri}/{shard['name']}.nul") as d:
        # plain arrays over the maps: a slice of a map costs several times a slice of an array
        ids, off, key, nul = (np.asarray(np.memmap(f, kind, "r")) for f, kind in ((a, f"<u{shard['width']}"), (b, "<i8"), (c, "<i8"), (d, "u1")))
        for i in range(shard["n_docs"]):
            yield None if nul[i] else int(key[i]), shard["base"] + int(off[i]), ids[off[i] : off[i + 1]]


def read(spark: SparkSession, uri: str, manifest: dict) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shards = manifest["shards"]
    if not shards:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(s["name"], s["n_docs"], s["n_ids"], s["width"], s["base"]) for s in shards], "name string, n_docs long, n_ids long, width int, base long").repartition(len(shards))

    def digest(batches):
        for batch in batches:
            for s in batch.to_pylist():
                cols: list = [[], [], [], []]
                for key, start, ids in documents_of(uri, s):
                    for col, x in zip(cols, (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        col.append(x)
                    if len(cols[0]) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        cols = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(common.lean(digest, "encoders"), schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a data set into the shared folder and return what its files say of each document."""
    uri = common.scratch(docs.sparkSession, "token-files")
    return read(docs.sparkSession, uri, write(docs, uri, tokenizer))
