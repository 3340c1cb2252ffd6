"""Chat formatting by token-level assembly.

A turn is written ``<s>[INST]role[/INST]text</s>``. Role and text are encoded apart from each other
by a byte-level vocabulary that loses nothing, and the ids reserved for the four control
strings are spliced in between, so no text can produce a control id. Where a control string
occurs inside a role or text, a backslash goes behind its first character (one more, if
backslashes stand there already), so the written form can be parsed as well and every text is
given back. The loss mask of a whole batch of turns is the prefix sum of +1 where a learned
text begins and -1 where it ends.

Turns need nothing of each other, so formatting shuffles nothing, and a conversation that holds a
third of all rows is spread like any other rows. A conversation is its turns by turn number.
:func:`read_turns` decodes in place as well; :func:`conversation_digests` sends decoded turns
to their conversation's task in order and keeps only running digests there, never a conversation.

Defined results: a null text or role is an empty one; turns without a number come first; turns
of one number are ordered by role, then by the MD5 of the text; repeated rows are turns of
their own; turns without a conversation form one (of null id); very long texts are encoded in
pieces of PIECE characters; an empty table gives an empty table. Only the named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.textblock import BLOCK_BYTES, blocks
from tallygrid.llm.tokens import vocabulary_path

#: Control strings in the order in which a turn has them; ids from the vocabulary's free ones.
CONTROL = ("<s>", "[INST]", "[/INST]", "</s>")
FIRST_RESERVED = 50_257
OPEN, ROLE, TEXT, CLOSE = range(FIRST_RESERVED, FIRST_RESERVED + 4)
#: Roles whose texts are learned.
LEARNED = ("assistant",)
#: Characters that the library gets at once; bounds what one unbroken string costs.
PIECE = 100_000
# A control string's first character, backslashes, and its rest.
_PLAIN = re.compile(r"<(\\*)(/?s>)|\[(\\*)(/?INST\])")
_ESCAPED = re.compile(r"<\\(\\*)(/?s>)|\[\\(\\*)(/?INST\])")


def escape(text: str) -> str:
    """``text`` without control strings; :func:`unescape` gives it back."""
    return _PLAIN.sub(lambda m: rf"<\{m[1]}{m[2]}" if m[2] else rf"[\{m[3]}{m[4]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}{m[2]}" if m[2] else f"[{m[3]}{m[4]}", text)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(encoding, text: str) -> list[int]:
    text = escape(text)
    if len(text) <= PIECE:
        return encoding.encode_ordinary(text)
    return [i for at in range(0, len(text), PIECE) for i in encoding.encode_ordinary(text[at : at + PIECE])]


def assemble(roles: list[list[int]], texts: list[list[int]], learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of turns one after the other, their loss mask, and n+1 offsets."""
    role = np.fromiter(map(len, roles), np.int64, len(roles))
    text = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(role + text + 4)))
    ids = np.empty(at[-1], np.uint32)
    begin = at[:-1] + role + 3  # of the text
    ids[at[:-1]], ids[at[:-1] + 1], ids[begin - 1], ids[at[1:] - 1] = OPEN, ROLE, TEXT, CLOSE
    step = np.zeros(at[-1] + 1, np.int8)
    step[begin[learned]] += 1
    step[(begin + text)[learned & (text > 0)]] -= 1
    step[begin[learned & (text == 0)]] -= 1
    for parts, places, sizes in ((roles, at[:-1] + 2, role), (texts, begin, text)):
        flat = np.fromiter((i for part in parts for i in part), np.uint32, int(sizes.sum()))
        ids[np.repeat(places - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    return ids, np.cumsum(step[:-1], dtype=np.int8).astype(np.uint8), at


def format_turns(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learned: tuple[str, ...] = LEARNED,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per turn: conv, turn, role_key and text_key (which order turns of one number), ids and mask.

    ``ids`` are little-endian unsigned 32-bit, ``mask`` has a byte 0 or 1 per id. ``vocabulary`` is
    the path of a file of byte-level ranks on every worker.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role_key"), F.md5(text).alias("text_key"), text.alias("text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for block, _, _ in blocks(batches, "text"):
            roles = block.column(2).to_pylist()
            coded = {role: _encode(encoding, role) for role in set(roles)}
            texts = [_encode(encoding, text) for text in block.column(4).to_pylist()]
            wanted = np.array([role in learned for role in roles], bool)
            ids, mask, at = assemble([coded[role] for role in roles], texts, wanted)
            raw, flags, at = ids.astype("<u4").tobytes(), mask.tobytes(), at.tolist()
            out = [
                pa.array([raw[4 * a : 4 * b] for a, b in zip(at, at[1:])], pa.binary()),
                pa.array([flags[a:b] for a, b in zip(at, at[1:])], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*block.columns[:4], *out], names=[*block.schema.names[:4], "ids", "mask"])

    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    return rows.mapInArrow(work, f"conv {conv}, turn {turn}, role_key string, text_key string, ids binary, mask binary")


def parse_turn(encoding, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
    """Role, text, text under the mask, and characters of the written form of one formatted turn."""
    marks = np.flatnonzero(ids >= FIRST_RESERVED)
    if ids[marks].tolist() != [OPEN, ROLE, TEXT, CLOSE]:
        raise ValueError("not one formatted turn")
    role, text = (encoding.decode(ids[marks[i] + 1 : marks[i + 1]].tolist()) for i in (1, 2))
    under = ids[mask.astype(bool)]
    loss = text if len(under) == marks[3] - marks[2] - 1 else encoding.decode(under.tolist())
    return unescape(role), unescape(text), unescape(loss), len(role) + len(text) + sum(map(len, CONTROL))


def read_turns(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What :func:`format_turns` wrote, from its ids and mask alone: role, text, loss_text, formatted_chars of each turn."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            rows, held, first = [], 0, 0
            for i, (ids, mask) in enumerate(zip(batch.column(4), batch.column(5))):
                ids, mask = np.frombuffer(ids.as_buffer(), "<u4"), np.frombuffer(mask.as_buffer(), np.uint8)
                rows.append(parse_turn(encoding, ids, mask))
                held += len(rows[-1][1])
                if held > BLOCK_BYTES or i == batch.num_rows - 1:
                    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
                    out = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                    keys = [batch.column(k).slice(first, len(rows)) for k in range(4)]
                    yield pa.RecordBatch.from_arrays([*keys, *out], names=[*batch.schema.names[:4], "role", "text", "loss_text", "formatted_chars"])
                    rows, held, first = [], 0, i + 1

    conv, turn = (formatted.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    keys = f"conv {conv}, turn {turn}, role_key string, text_key string"
    columns = formatted.select("conv", "turn", "role_key", "text_key", "ids", "mask")
    return columns.mapInArrow(work, f"{keys}, role string, text string, loss_text string, formatted_chars long")


def conversation_digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of :func:`read_turns`: counts and digests over its turns in order."""
    keys = ["conv", "turn", "role_key", "text_key"]
    ordered = turns.repartition("conv").sortWithinPartitions(*keys).select("conv", "role", "text", "loss_text", "formatted_chars")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The running conversation: its id, turns, characters, and two digests.
        state, done, kind = None, [], None

        def out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*((c, n, all_.hexdigest(), k, loss.hexdigest(), size) for c, n, k, size, all_, loss in done))]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            kind = batch.column(0).type
            for conv, role, text, loss, size in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state:
                        done.append(state)
                    state = [conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                state[1] += 1
                state[2] += len(loss)
                state[3] += size
                state[4].update(f"{role}\n{text}\n".encode())
                state[5].update(loss.encode())
            if len(done) > 5_000:
                yield out()
                done = []
        if state:
            done.append(state)
            yield out()

    conv = turns.schema["conv"].dataType.simpleString()
    got = ordered.mapInArrow(
        work, f"conv {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return got.withColumnRenamed("conv", conv_col)
