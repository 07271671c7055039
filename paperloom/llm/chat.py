"""Chat formatting by token-level assembly.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Role and text are encoded by
themselves; the two markers are reserved ids beyond the vocabulary and are
spliced in, so no text can produce them. Control strings inside texts are also
escaped: each ``<|`` with n backslashes between its two characters gets one more,
which reading back removes. Loss masks are spans of token positions, from prefix
sums of the segments' lengths along the conversation.

Conversations are stored a row per turn, so no task ever holds a whole one: rows
are dealt out and sorted by conversation and turn and stream through.

Defined results: null text or role counts as empty; turns with one number are
ordered by role, then text, nulls first, and repeated rows are turns of their
own; null conversation ids are one conversation; a turn is held whole, however
long, a conversation never; an empty table gives an empty result; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import shuffle_partitions
from paperloom.llm.tokens import as_bytes, encoder

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "conv_id bigint, turn_index bigint, role string, token_offset bigint, loss_start bigint, loss_end bigint, ids array<int>"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: DataFrame, vocabulary: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per turn: its ids, its first position in the conversation, and the span under the loss mask (empty where none)."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary, True) as coder:
            size = coder.tokenizer.get_vocab_size(with_added_tokens=True)
            start, end = (np.array([size + i], "<u4").tobytes() for i in (0, 1))
            newline = coder.encode(["\n"])[0].tobytes()
            conv, index, at = object(), 0, 0
            for batch in batches:
                roles = [r or "" for r in batch.column("role").to_pylist()]
                heads = as_bytes(*coder.encode([_role(r) + "\n" for r in roles]))
                bodies = as_bytes(*coder.encode([escape(t or "") for t in batch.column("text").to_pylist()]))
                rows = []
                for c, r, head, body in zip(batch.column("conv_id").to_pylist(), roles, heads, bodies):
                    if c != conv:
                        conv, index, at = c, 0, 0
                    segments = [start, head, body, end, newline]
                    places = at + np.cumsum([0] + [len(s) // 4 for s in segments])
                    learn = r in loss_roles
                    rows.append((c, index, r, at, int(places[2]), int(places[3] if learn else places[2]), np.frombuffer(b"".join(segments), "<i4")))
                    index, at = index + 1, int(places[-1])
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["conv_id", "turn_index", "role", "token_offset", "loss_start", "loss_end", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    rows = turns.select(turns[conv_id].cast("long").alias("conv_id"), turns[turn].cast("long").alias("turn"), turns[role].cast("string").alias("role"), turns[text].cast("string").alias("text"))
    dealt = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(assemble, TURNS)


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of each conversation, decoded from the ids and masks of :func:`format_turns`."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary, True) as found:
            coder = found.tokenizer
        size = coder.get_vocab_size(with_added_tokens=True)
        conv, state, done = object(), None, []

        def text_of(ids: np.ndarray) -> str:
            """Decoded text; the two reserved ids become their marks."""
            marks, out, at = np.flatnonzero(ids >= size), [], 0
            for m in [*marks, len(ids)]:
                out.append(coder.decode(ids[at:m].tolist(), skip_special_tokens=False) if m > at else "")
                if m < len(ids):
                    out.append(START if ids[m] == size else END)
                at = m + 1
            return "".join(out)

        def close() -> None:
            if state:
                done.append((conv, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            cols = list(zip(*done)) if done else [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds)], names=names)

        for batch in batches:
            lists = batch.column("ids")
            values, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "token_offset", "loss_start", "loss_end")]
            for c, at, a, b, lo, hi in zip(*columns, cuts[:-1], cuts[1:]):
                if state is None or c != conv:
                    close()
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                ids = values[lo:hi]
                whole = text_of(ids)
                role, _, body = whole.removeprefix(START).removesuffix("\n").removesuffix(END).partition("\n")
                state["turns"].update(f"{_role_back(role)}\n{unescape(body)}\n".encode())
                learnt = unescape(text_of(ids[a - at : b - at]))
                state["loss"].update(learnt.encode())
                state["n"] += 1
                state["chars"] += len(learnt)
                state["all"] += len(whole)
            yield flush()
        close()
        yield flush()

    n = shuffle_partitions(formatted.sparkSession)
    rows = formatted.select("conv_id", "turn_index", "token_offset", "loss_start", "loss_end", "ids")
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn_index").mapInArrow(digest, DIGESTS)
