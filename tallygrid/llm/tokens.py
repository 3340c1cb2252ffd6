"""Token ids of whole texts, by the tokenizers library with every distinct piece encoded once.

The vocabulary's pre-tokenizer cuts a text into pieces (letter runs, single digits, runs of
other marks) that never cross white space and are encoded apart from each other. So a
worker encodes each distinct piece once with the library, keeps the ids of each distinct
white-space run under its 64-bit hash, and puts texts together in numpy.
Only characters whose normal form, case and class are beyond doubt (Latin letters, digits
and marks below U+0250) are cut here; a white-space run with anything else in it goes to
the library as it is. A test in ``tests/llm`` compares both ways.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

from tallygrid.llm.textblock import prefix_hash, runs, spaces, span_hash

#: Distinct white-space runs, and pieces, whose ids a worker keeps (about 100 MB); beyond it the
#: store is emptied and fills anew.
KEPT_RUNS, KEPT_PIECES = 400_000, 250_000
#: Appended to every document.
END_ID = 2


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin(kind: str) -> str:
    """A regular-expression class body: the characters below U+0250 whose category starts so."""
    found = [chr(i) for i in range(0x250) if unicodedata.category(chr(i))[0] in kind]
    return "".join(re.escape(c) for c in found)


_LETTER, _DIGIT, _MARK = _latin("L"), _latin("N"), _latin("PS")
#: Fixed by the vocabulary file: its pre-tokenizer's pattern; the last space ends a run.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[{_MARK}]+| ")
#: Bytes as the characters that byte-level vocabularies show for them: a printable byte as itself,
#: the others as the characters from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_ODD = re.compile(rf"[^ {_LETTER.replace('İ', '')}{_DIGIT}{_MARK}]|<\|")


class _Column:
    """A numpy array that grows by doubling."""

    def __init__(self, kind, first=()):
        self._room, self.size = np.array(first, kind), len(first)

    def extend(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self._room):
            room = np.empty(max(size, 2 * len(self._room)), self._room.dtype)
            room[: self.size] = self._room[: self.size]
            self._room = room
        self._room[self.size : size] = values
        self.size = size

    def values(self) -> np.ndarray:
        return self._room[: self.size]


class _Lists:
    """Numbered lists of ids, one after the other."""

    def __init__(self):
        self._ids, self._ends = _Column(np.uint32), _Column(np.int64, [0])

    def __len__(self) -> int:
        return self._ends.size - 1

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self._ids.extend(ids)
        self._ends.extend(self._ends.values()[-1] + np.cumsum(sizes))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists of these numbers, and how many each has."""
        ends = self._ends.values()
        begin = ends[numbers]
        sizes = ends[numbers + 1] - begin
        stops = np.cumsum(sizes)
        place = np.repeat(begin - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)
        return self._ids.values()[place], sizes


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, for one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self.size = max(self._library.get_vocab(with_added_tokens=True).values()) + 1
        self._forget()

    def _forget(self) -> None:
        self._run_number: dict[int, int] = {}  # hash of a white-space run -> its number below
        self._runs = _Lists()
        self._piece_number: dict[str, int] = {" ": 0}  # the end of a run, not a piece
        self._pieces = _Lists()
        self._pieces.extend(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _learn_pieces(self, new: list[str]) -> None:
        tokenize, ids, sizes = self._library.model.tokenize, [], []
        for piece in new:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SHOWN)
            found = [token.id for token in tokenize(shown)]
            ids += found
            sizes.append(len(found))
        first = len(self._pieces)
        self._piece_number.update(zip(new, range(first, first + len(new))))
        self._pieces.extend(np.array(ids, np.uint32), np.array(sizes, np.int64))

    def _learn(self, words: list[bytes], keys: list[int]) -> None:
        """Keep the ids of white-space runs that are new."""
        text = b" ".join(words).decode()
        odd = []
        at = [m.start() for m in _ODD.finditer(text)]
        if at:
            names = text.split(" ")
            begin = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)) + 1)
            places = np.unique(np.searchsorted(begin, at, "right")).tolist()
            odd = [(keys[i], names[i]) for i in places]
            gone = set(places)
            keys = [key for i, key in enumerate(keys) if i not in gone]
            text = " ".join([name for i, name in enumerate(names) if i not in gone])
        if keys:
            found = _PIECE.findall(text.lower() + " ")
            self._learn_pieces(list(set(found).difference(self._piece_number)))
            numbers = np.fromiter(map(self._piece_number.__getitem__, found), np.int64, len(found))
            ids, sizes = self._pieces.take(numbers)
            upto = np.cumsum(sizes)[numbers == 0]
            self._keep(keys, ids, np.diff(upto, prepend=0))
        if odd:
            found = [self._library.encode(name, add_special_tokens=False).ids for _, name in odd]
            ids = np.fromiter((i for some in found for i in some), np.uint32)
            self._keep([key for key, _ in odd], ids, np.fromiter(map(len, found), np.int64, len(found)))

    def _keep(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self._runs)
        self._run_number.update(zip(keys, range(first, first + len(keys))))
        self._runs.extend(ids, sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block one after the other, each followed by ``end``, and n+1 offsets."""
        n = len(offsets) - 1
        starts, ends, texts = runs(~spaces(data), offsets)
        hashes, first, inverse = np.unique(
            span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True
        )
        keys = hashes.tolist()
        if len(self._runs) + len(keys) > KEPT_RUNS or len(self._pieces) > KEPT_PIECES:
            self._forget()
        new = [i for i, key in enumerate(keys) if key not in self._run_number]
        if new:
            raw, at = data.tobytes(), first[new]
            words = [raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist())]
            self._learn(words, [keys[i] for i in new])
        numbers = np.fromiter(map(self._run_number.__getitem__, keys), np.int64, len(keys))[inverse]
        found, length = self._runs.take(numbers)
        per_text = np.bincount(texts, length, minlength=n).astype(np.int64)
        last = int(end is not None)
        out_at = np.concatenate(([0], np.cumsum(per_text + last)))
        if not last:
            return found, out_at
        out = np.empty(out_at[-1], np.uint32)
        inside = np.ones(len(out), bool)
        inside[out_at[1:] - 1] = False
        out[inside], out[~inside] = found, end
        return out, out_at


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)
