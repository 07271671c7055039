"""The letters by which byte-level vocabularies write bytes."""

from __future__ import annotations


def letters() -> dict[int, str]:
    """The letter of each byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(rest)}


_TO_LETTERS = letters()
_TO_BYTES = {letter: b for b, letter in _TO_LETTERS.items()}


def written(text: str) -> str:
    """A text as its vocabulary writes it, a letter per byte of its UTF-8 form."""
    return text.encode().decode("latin-1").translate(_TO_LETTERS)


def read(entry: str) -> bytes:
    """The bytes that an entry of a vocabulary stands for; entries with other letters are their own UTF-8 bytes."""
    found = [_TO_BYTES.get(letter) for letter in entry]
    return entry.encode() if None in found else bytes(found)
