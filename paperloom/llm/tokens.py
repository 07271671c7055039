"""Token ids of whole texts by the tokenizers library, as unsigned 32-bit numbers.

A text is cut where no token can cross. For a byte-level vocabulary whose words
carry their leading space, a cut lies before each space that a non-space follows;
for one that drops white space, at every space. A chunk of letters with ASCII
punctuation after it is cut between the two, one of several lines at their ends. The distinct chunks of a group of
texts are found by Arrow, each is encoded once by the library, and the ids of the
texts are gathered by numpy from those of the chunks.

Chunks that the library has encoded are remembered within a task, in ``MEMO_BYTES``
at most, and forgotten all at once when they are more, or when the task ends.

Strings of special tokens that occur in a text are ordinary text. Texts for a
lower-casing vocabulary are normalised before they are cut, as the library does
it; the few whose normal form isn't stable go to the library whole.
"""

from __future__ import annotations

import contextlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"
_LINES = re.compile(r"\S+(?:\n\S+)+")
_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: What a worker remembers of chunks within a task, at most (and what one group of texts adds).
MEMO_BYTES = 48 << 20
#: About what an entry takes besides its characters.
_ENTRY_BYTES = 200
#: Longer texts are encoded in pieces of about this many characters.
PIECE = 1 << 20
_NONE = np.zeros(0, np.uint32)

_encoders: dict[tuple, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte over 127: itself if it is printed, else one from 256 on, as for the bytes up to 32 and 127."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
    rest = [b for b in range(256) if b not in printed]
    return {b: chr(256 + i) for i, b in enumerate(rest) if b > 127}


_LETTERS = _byte_letters()


def _in_bytes(word: str) -> str:
    return word.encode().decode("latin-1").translate(_LETTERS)


def _list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class _Ids:
    """Lists of ids, one after the other; the list with number 0 is empty."""

    def __init__(self):
        self.data, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> range:
        """Keep lists given as one array; return their numbers."""
        end, count = self.used + len(flat), self.count + len(sizes)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(end, self.used), np.uint32)])
        if count > len(self.starts):
            more = np.zeros(max(count, self.count), np.int64)
            self.starts, self.sizes = (np.concatenate([x[: self.count], more]) for x in (self.starts, self.sizes))
        self.data[self.used : end] = flat
        self.starts[self.count : count] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : count] = sizes
        numbers = range(self.count, count)
        self.used, self.count = end, count
        return numbers

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers as one array, and where each ends in it."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(total)], ends


class Encoder:
    """``spaced``: words carry their leading space; ``lower``: the vocabulary composes (NFC) and lower-cases letters."""

    def __init__(self, path: str, spaced: bool, lower: bool = False, memo_bytes: int = MEMO_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced, self.lower, self.memo_bytes = spaced, lower, memo_bytes
        self.forget()

    def forget(self) -> None:
        """Drop all that is remembered of chunks."""
        self.ids, self.held = _Ids(), 0
        self.inner: dict[str, int] = {}  # chunks that follow a space, without it
        self.first: dict[str, int] = {"": 0}  # chunks at the start of a text
        self.tails: dict[str, int] = {"": 0}  # punctuation after letters
        if not self.spaced:
            self.inner = self.first = {"": 0}

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks as one array, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _words(self, words: list[str], prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_library` for words of letters, which the library's model takes as they are, in its letters for bytes."""
        tokenize, mark = self.tokenizer.model.tokenize, "Ġ" if prefix else ""
        flat, sizes = [], []
        for w in words:
            found = tokenize(mark + (w if w.isascii() else _in_bytes(w)))
            flat += [t.id for t in found]
            sizes.append(len(found))
        return np.array(flat, np.uint32), np.array(sizes, np.int64)

    def _keep(self, memo: dict[str, int], chunks: list[str], found: tuple[np.ndarray, np.ndarray]) -> range:
        numbers = self.ids.add(*found)
        memo.update(zip(chunks, numbers))
        self.held += sum(map(len, chunks)) + _ENTRY_BYTES * len(chunks)
        return numbers

    def _stems(self, memo: dict[str, int], stems: pa.Array, prefix: str) -> np.ndarray:
        """The numbers of the ids of some distinct chunks, each of letters only or not to be cut."""
        names = _list(stems)
        out = np.fromiter(map(memo.get, names, repeat(-1)), np.int64, len(names))
        lines = [i for i in np.flatnonzero(out < 0).tolist() if _LINES.fullmatch(names[i])]
        if lines:
            some = [names[i] for i in lines]
            out[lines] = self._keep(memo, some, self._lines(memo, some, prefix))
        for letters in (True, False):
            new = [i for i in np.flatnonzero(out < 0).tolist() if names[i].isalpha() == letters]
            if new:
                some = [names[i] for i in new]
                out[new] = self._keep(memo, some, self._words(some, prefix) if letters else self._library([prefix + c for c in some]))
        return out

    def _lines(self, memo: dict[str, int], chunks: list[str], prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_library` for chunks of lines between single line ends, which are tokens of their own."""
        parts = [c.split("\n") for c in chunks]
        heads, rest = pa.array([p[0] for p in parts], pa.large_string()), pa.array([x for p in parts for x in p[1:]], pa.large_string())
        head, more = (coded.dictionary_encode() for coded in (heads, rest))
        numbers = []
        for coded, known, before in ((head, memo, prefix), (more, self.first, "")):
            at = coded.indices.to_numpy()
            body, tail = self._number(known, coded.dictionary, before)
            numbers.append(np.stack([body[at], tail[at]], 1))
        line_end = self.first.get("\n") or self._keep(self.first, ["\n"], self._library(["\n"]))[0]
        after = np.c_[np.full(len(rest), line_end), numbers[1]]
        sizes = np.array([len(p) - 1 for p in parts])
        lists, owner = np.r_[numbers[0].ravel(), after.ravel()], np.r_[np.repeat(np.arange(len(parts)), 2), np.repeat(np.arange(len(parts)), 3 * sizes)]
        lists = lists[np.argsort(owner, kind="stable")]
        flat, ends = self.ids.gather(lists)
        return flat, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(2 + 3 * sizes)]])

    def _number(self, memo: dict[str, int], chunks: pa.Array, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """For each of some distinct chunks, the numbers of its ids and of those of the punctuation after its letters."""
        stems = pc.ascii_rtrim(chunks, _PUNCTUATION)
        cut = pc.and_(pc.utf8_is_alpha(stems), pc.less(pc.binary_length(stems), pc.binary_length(chunks)))
        coded = pc.if_else(cut, stems, chunks).dictionary_encode()
        body = self._stems(memo, coded.dictionary, prefix)[coded.indices.to_numpy()]
        tail = np.zeros(len(chunks), np.int64)
        places = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        if len(places):
            ends = [c[len(s) :] for c, s in zip(_list(chunks.take(places)), _list(stems.take(places)))]
            new = [e for e in set(ends) if e not in self.tails]
            if new:
                self._keep(self.tails, new, self._library(new))
            tail[places] = list(map(self.tails.__getitem__, ends))
        return body, tail

    def _normal(self, text: str) -> str | None:
        """A text as the library's normaliser leaves it, line ends and tabs as spaces; None if doing so again would change it."""
        text = text.replace("\n", " ").replace("\t", " ")
        if text.isascii():
            return text.lower()
        out = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter, so without a final sigma
        return out if unicodedata.is_normalized("NFC", out) and out.lower() == out else None

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as one array and where each text ends in it; ``end`` is added to each text."""
        if self.held > self.memo_bytes:
            self.forget()
        whole: dict[int, np.ndarray] = {}
        if self.lower:
            normal = list(map(self._normal, texts))
            if None in normal:
                whole = {i: self._library([texts[i]])[0] for i, t in enumerate(normal) if t is None}
                normal = [t or "" for t in normal]
            texts = normal
        long = [i for i, t in enumerate(texts) if len(t) > PIECE]
        if long:
            texts = list(texts)
            for i in long:
                whole[i] = np.concatenate([self._short([p])[0] for p in self._pieces(texts[i])])
                texts[i] = ""
        ids, ends = self._short(texts, whole)
        if end is not None:
            ids = np.insert(ids, ends, end)
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            found = _SPACE.search(text, at + PIECE)
            to = found.start() if found else len(text)
            yield text[at:to]
            at = to
            if self.held > self.memo_bytes:
                self.forget()

    def _short(self, texts: list[str], whole: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`; the ids of some texts may be given."""
        whole = dict(whole or {})
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        chunks, of_chunk = coded.dictionary, coded.indices.to_numpy()
        cuts = lists.offsets.to_numpy()
        cuts = cuts - cuts[0]
        if not self.spaced:
            body, tail = self._number(self.inner, chunks, "")
            body, tail = body[of_chunk], tail[of_chunk]
        else:
            later = np.ones(len(of_chunk), bool)
            later[cuts[:-1]] = False
            odd = pc.or_(pc.equal(chunks, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(chunks, 0, 1))).to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(odd[of_chunk] & later)
            for i in np.unique(np.searchsorted(cuts, runs, "right") - 1).tolist():
                whole[i] = self._uneven(texts[i])
            body, tail = (np.zeros(len(of_chunk), np.int64) for _ in range(2))
            for picked, memo, prefix in ((later, self.inner, " "), (~later, self.first, "")):
                used = np.unique(of_chunk[picked])
                used = used[~odd[used]] if prefix else used
                numbers = np.zeros((2, len(chunks)), np.int64)
                numbers[:, used] = self._number(memo, chunks.take(used), prefix)
                body[picked], tail[picked] = numbers[:, of_chunk[picked]]
        for i in whole:
            body[cuts[i] : cuts[i + 1]] = tail[cuts[i] : cuts[i + 1]] = 0
        flat, ends = self.ids.gather(np.stack([body, tail], 1).ravel())
        ends = np.r_[0, ends][2 * cuts[1:]]
        if whole:
            parts, at = [], 0
            for i in sorted(whole):
                parts += [flat[at : ends[i]], whole[i]]
                at = ends[i]
            flat = np.concatenate([*parts, flat[at:]])
            more = np.zeros(len(ends), np.int64)
            more[list(whole)] = [len(x) for x in whole.values()]
            ends = ends + np.cumsum(more)
        return flat, ends

    def _uneven(self, text: str) -> np.ndarray:
        """A text with runs of white space, cut only before single spaces between non-spaces."""
        at = [0, *(m.start() for m in _SPACE.finditer(text)), len(text)]
        return self._library([text[a:b] for a, b in zip(at, at[1:]) if a < b])[0] if text else _NONE


def as_bytes(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids of each text that :meth:`Encoder.encode` gives, as little-endian unsigned 32-bit numbers."""
    raw = ids.astype("<u4", copy=False).tobytes()
    cuts = [0, *(4 * ends).tolist()]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


@contextlib.contextmanager
def encoder(path: str, spaced: bool, lower: bool = False) -> Iterator[Encoder]:
    """This worker's encoder for a vocabulary file, which remembers chunks while the context lasts."""
    if (path, spaced, lower) not in _encoders:
        _encoders[path, spaced, lower] = Encoder(path, spaced, lower)
    try:
        yield _encoders[path, spaced, lower]
    finally:
        _encoders[path, spaced, lower].forget()
