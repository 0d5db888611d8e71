"""Normalisation through a compiled character map, with the source of every byte.

The map of a SentencePiece model is a double-array trie over UTF-8 strings, as 32-bit units after
their length in bytes, followed by the replacements, each ended by a zero byte.
"""

from __future__ import annotations

import numpy as np

BLANK = "▁"


class CharacterMap:
    """Replaces the longest known prefix at each place of a text; other characters stay."""

    def __init__(self, compiled: bytes):
        self.units: list[int] = []
        self.replacements = b""
        if compiled:
            size = int.from_bytes(compiled[:4], "little")
            self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
            self.replacements = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known string that starts at ``at``, and its replacement."""
        if not self.units:
            return None
        found, node = None, 0
        node ^= _offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                place = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[place : self.replacements.index(b"\0", place)]
        return found


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


def normalise(
    text: str, characters: CharacterMap, dummy_prefix: bool = True, remove_extra: bool = False, escape: bool = True
) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The normalised text in UTF-8, and for each of its bytes where its source begins and ends in the text's UTF-8.

    A blank put in front has an empty source at the start. With ``remove_extra``, blanks
    at both ends go and runs of blanks become one.
    """
    data = text.encode()
    out, begins, ends = bytearray(), [], []
    blank = BLANK.encode() if escape else b" "

    def put(piece: bytes, a: int, b: int):
        out.extend(piece)
        begins.extend([a] * len(piece))
        ends.extend([b] * len(piece))

    def chunks():
        at = 0
        while at < len(data):
            match = characters.longest(data, at)
            if match is None:
                lead = data[at]
                match = (length := 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)), data[at : at + length]
            yield at, at + match[0], match[1]
            at += match[0]

    pending = []
    for a, b, piece in chunks():
        if piece:
            pending.append((a, b, piece))
    if remove_extra:
        while pending and pending[0][2] == b" ":
            pending.pop(0)
        while pending and pending[-1][2] == b" ":
            pending.pop()
    if not pending:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    if dummy_prefix:
        put(blank, pending[0][0], pending[0][0])
    last_blank = False
    for a, b, piece in pending:
        if remove_extra and piece == b" " and last_blank:
            ends[-len(blank) :] = [b] * len(blank)
            continue
        last_blank = piece.endswith(b" ")
        put(piece.replace(b" ", blank), a, b)
    return bytes(out), np.array(begins, np.int64), np.array(ends, np.int64)
