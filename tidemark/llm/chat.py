"""Chat formatting into budgeted windows.

A turn is formatted as ``<s>role`` line end ``text</s>`` line end. Inside roles and texts every backslash is doubled and every
control string gets a backslash after its first character, and so no control string of any template stands inside a
text; ``unescape`` takes both back. Prefix sums of the turns' tokens choose the windows: a window takes new turns while the
prefix sum since its start, with the system turn and the history it repeats, stays in the budget. The system turn opens
every window; of the turns before the window the latest that fit ``history`` tokens are repeated. The loss mask holds
the texts of new assistant turns; a repeated one is masked out. No turn is ever cut: one that is over the budget alone
has a window of its own, marked ``over_budget``.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_files import encoder

#: The control strings of common templates.
CONTROL = ("<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<|end|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.DOTALL)
_WINDOWS = "conv_id {id}, window long, text string, n_turns int, n_repeated int, n_tokens long, over_budget boolean, loss_start array<int>, loss_end array<int>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn and where its escaped text stands in it. A line end inside a role becomes backslash N."""
    head = "<s>" + escape(role).replace("\n", "\\N") + "\n"
    body = escape(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of a formatted window."""
    return [(unescape(re.sub(r"(?<!\\)((?:\\\\)*)\\N", "\\1\n", m[1])), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(window)]


class _Window:
    """Collects the windows of one conversation, turn by turn; holds one window and its history."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system = None
        self.past: deque = deque()  # turns that may be repeated, with the prefix sum before each
        self.new: list = []
        self.sum = 0  # prefix sum of the tokens of all turns but the system turn
        self.made = 0

    def add(self, role, formatted, start, end, tokens):
        turn = (formatted, start, end, tokens, role == "assistant", self.sum)
        if role == "system" and self.system is None and not self.new and not self.made:
            self.system = turn
            return
        fixed = self.system[3] if self.system else 0
        if self.new and fixed + self.sum + tokens - self._from() > self.budget:
            yield self._emit()
        if not self.new:  # history that leaves room for the first new turn
            room = min(self.history, self.budget - fixed - tokens)
            while self.past and self.sum - self.past[0][5] > room:
                self.past.popleft()
        self.new.append(turn)
        self.sum += tokens

    def _from(self) -> int:
        return (self.past[0] if self.past else self.new[0])[5]

    def close(self):
        if self.new or (self.system and not self.made):
            yield self._emit()

    def _emit(self):
        repeated = [*([self.system] if self.system and self.made else []), *self.past]
        first = [self.system] if self.system and not self.made else []
        turns = [*([self.system] if self.system else []), *self.past, *self.new]
        fresh = len(first) + len(self.new)
        starts, ends, at, text = [], [], 0, []
        for i, (formatted, start, end, _, target, _) in enumerate(turns):
            if target and i >= len(turns) - len(self.new):
                starts.append(at + start)
                ends.append(at + end)
            text.append(formatted)
            at += len(formatted)
        n_tokens = sum(t[3] for t in turns)
        row = (self.made, "".join(text), fresh + len(repeated), len(repeated), n_tokens, n_tokens > self.budget, starts, ends)
        self.past.extend(self.new)
        while self.past and self.sum - self.past[0][5] > self.history:
            self.past.popleft()
        self.new = []
        self.made += 1
        return row


def _rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024)


def format_windows(conversations: DataFrame, tokenizer: str, *, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row a window, from (conv_id, turn, role, text).

    Null texts and roles count as empty. Turns of one number stand in the order of role and text; a null turn comes first;
    rows of null conv_id are one conversation. Repeated rows are turns of their own. Other columns are ignored. A
    conversation passes through its task as a stream in turn order: one window and its history are in memory, never all its turns.
    """
    thin = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = thin.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = _WINDOWS.format(id=thin.schema["conv_id"].dataType.simpleString())
    arrow = pa.schema([(n, t) for n, t in (("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32())))])

    def windows(batches):
        enc = encoder(tokenizer)
        conv, now, out = None, None, []
        for part in _rows(batches):
            kind = part.schema.field(0).type
            turns = [format_turn(r, t) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            tokens = [len(x) // enc.dtype.itemsize for x in enc.encode([t[0].rstrip("\n") for t in turns])]
            for c, role, (text, start, end), n in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), turns, tokens, strict=True):
                if now is None or c != conv:
                    if now is not None:
                        out += [(conv, *w) for w in now.close()]
                    conv, now = c, _Window(budget, history)
                out += [(conv, *w) for w in now.add(role, text, start, end, n + 1)]
            if len(out) > 1000:
                yield _batch(out, arrow, kind)
                out = []
        if now is not None:
            out += [(conv, *w) for w in now.close()]
            yield _batch(out, arrow, kind)

    return ordered.mapInArrow(windows, schema)


def _batch(rows, schema, kind):
    schema = schema.set(0, pa.field("conv_id", kind))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def digests(windows: DataFrame) -> DataFrame:
    """What the windows say of each conversation: its turns without repeats, and the text under its loss mask."""
    ordered = windows.select("conv_id", "window", "text", "n_repeated", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = f"conv_id {windows.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digest(batches):
        def rows():
            for part in _rows(batches):
                yield from zip(*[c.to_pylist() for c in part.columns], strict=True)

        def out():
            for conv, own in groupby(rows(), key=lambda r: r[0]):
                n = loss_chars = chars = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
                for _, _, text, repeated, starts, ends in own:
                    for i, (role, said, _, _) in enumerate(parse(text)):
                        if i >= repeated:  # repeated turns stand first
                            turns.update(f"{role}\n{said}\n".encode())
                            n += 1
                    for start, end in zip(starts, ends, strict=True):
                        said = unescape(text[start:end])
                        loss.update(said.encode())
                        loss_chars += len(said)
                    chars += len(text)
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list = []
        for row in out():
            done.append(row)
            if len(done) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

    return ordered.mapInArrow(digest, schema)


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    conversations = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    windows = format_windows(conversations.unionByName(more), public_tokenizers.path("byte_bpe_50k.json"))
    return digests(common.written(windows, "chat-windows"))
