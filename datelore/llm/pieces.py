"""SentencePiece encoding with byte spans of the source, and decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from datelore.llm.charmap import BLANK, CharacterMap, normalise
from datelore.llm.common import extend, for_worker, texts_of

SPANS = "ids array<int>, begins array<int>, ends array<int>"
NORMAL, BYTE = 1, 6
BPE = 2


def plain_alignment(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``normalise`` for many texts at once where the character map is empty, blanks are kept and one is put in front.

    For each byte of the normalised texts, one after another: where its source character begins and ends, and the source byte
    itself, in its own text; and the size of each normalised text. A blank is three bytes; the one in front has no source.
    """
    raw = [x.encode() for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(x) for x in raw], np.int64)
    base = np.cumsum(lengths) - lengths
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    shift = np.repeat(base, lengths)
    begin, end = lead[char] - shift, np.append(lead, len(data))[char + 1] - shift
    place, width = np.arange(len(data)) - shift, np.where(data == 0x20, 3, 1)
    some = base[lengths > 0]
    width = np.insert(width, some, 3)
    begin, end, place = (np.repeat(np.insert(x, some, 0), width) for x in (begin, end, place))
    sizes = np.add.reduceat(width, np.arange(len(some)) + some) if len(some) else np.zeros(0, np.int64)
    every = np.zeros(len(texts), np.int64)
    every[lengths > 0] = sizes
    return begin, end, place, every


class PieceEncoder:
    """Ids and source spans of texts by a SentencePiece model.

    Where the vocabulary has no piece in which a blank follows something else and none with a line end,
    no merge reaches across the start of a word or a line end, so texts with single blanks are
    encoded word by word, and words met before come from a dictionary of up to ``limit``
    words of at most 64 characters. Other texts and other models are encoded whole. The ids are
    the library's own in each case.
    """

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        rules = model.normalizer_spec
        self.characters = CharacterMap(rules.precompiled_charsmap)
        self.rules = {"dummy_prefix": rules.add_dummy_prefix, "remove_extra": rules.remove_extra_whitespaces, "escape": rules.escape_whitespaces}
        spelt = [(p.piece, p.type) for p in model.pieces]
        #: Bytes of the normalised text that a piece stands for, and whether it is a byte.
        self.spelt = np.array([1 if kind == BYTE else len(piece.encode()) for piece, kind in spelt], np.int64)
        self.bytes = np.array([kind == BYTE for _, kind in spelt], bool)
        self.plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        self.by_words = (
            self.plain
            and model.trainer_spec.model_type == BPE
            and model.trainer_spec.byte_fallback
            and not model.trainer_spec.treat_whitespace_as_suffix
            and all("\n" not in piece and BLANK not in piece.lstrip(BLANK) for piece, kind in spelt if kind == NORMAL)
            and all(kind in (NORMAL, BYTE, 2, 3) for _, kind in spelt)
            and self.library.encode("\n")[:1] == [self.library.piece_to_id(BLANK)]
        )
        self.limit, self.known = limit, {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit little-endian numbers."""
        if not self.by_words:
            return [_packed(x) for x in self.library.encode(texts, num_threads=1)]
        # A word after a line end keeps it in front, a word after a blank or at the start stands bare.
        cut = [None if BLANK in t else t.replace("\n", " \n").split(" ") for t in texts]
        found = [None if words is None else list(map(self.known.get, words)) for words in cut]
        new = {w for words, ids in zip(cut, found) if ids is not None and None in ids for w, i in zip(words, ids) if i is None}
        new.discard("")
        learnt = self.learn(sorted(new)) if new else {}
        out = []
        for text, words, ids in zip(texts, cut, found):
            if words is None or "" in words:
                out.append(_packed(self.library.encode(text)) if text else b"")
                continue
            if None in ids:
                ids = [learnt[w] if i is None else i for w, i in zip(words, ids)]
            out.append(b"".join(ids))
        return out

    def learn(self, words: list[str]) -> dict[str, bytes]:
        ids = self.library.encode(words, num_threads=1)
        # The library puts a blank in front; a word after a line end has none.
        found = {w: _packed(i[1:] if w[0] == "\n" else i) for w, i in zip(words, ids)}
        if len(self.known) < self.limit:
            self.known.update((w, i) for w, i in found.items() if len(w) <= 64)
        return found

    def spans_all(self, texts: list[str], flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece of each text begins and ends in the text's UTF-8 bytes, through the alignment of the normalised texts."""
        first = np.cumsum(counts) - counts
        if not self.plain:
            found = [self.aligned(text, flat[a : a + n].tolist()) for text, a, n in zip(texts, first.tolist(), counts.tolist())]
            none = np.zeros(0, np.int64)
            return np.concatenate([none, *(b for b, _ in found)]), np.concatenate([none, *(e for _, e in found)])
        begin, end, place, sizes = plain_alignment(texts)
        stop = np.cumsum(self.spelt[flat])
        start = stop - self.spelt[flat]
        # Pieces cover each normalised text from end to end.
        covered = np.append(0, stop)[np.append(first[1:], len(flat))] if len(first) else first
        if not np.array_equal(covered, np.cumsum(sizes)):
            raise ValueError("pieces do not cover the normalised text")
        begins, ends = begin[start], end[np.maximum(stop - 1, 0)]
        single = self.bytes[flat]
        begins[single], ends[single] = place[start[single]], place[start[single]] + 1
        return begins, ends

    def aligned(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Spans through the alignment of the normalised text, for any character map."""
        spelt, begin, end = normalise(text, self.characters, **self.rules)
        surfaces = self.library.encode(text, out_type=str)
        sizes = [1 if self.library.is_byte(i) else len(s.encode()) for i, s in zip(ids, surfaces)]
        stop = np.cumsum(sizes)
        start = stop - sizes
        if len(surfaces) != len(ids) or (len(stop) and stop[-1] != len(spelt)):
            raise ValueError("pieces do not cover the normalised text")
        # A byte of a character that is kept as it is has a source byte of its own.
        begins, ends = [], []
        for a, b in zip(start.tolist(), stop.tolist()):
            s, e = int(begin[a]), int(end[b - 1])
            if b - a == 1 and e - s > 1:
                k = a - int(np.searchsorted(begin, s))
                s, e = (s + k, s + k + 1) if spelt[a - k : a - k + e - s] == text.encode()[s:e] else (s, e)
            begins.append(s)
            ends.append(e)
        return np.array(begins, np.int64), np.array(ends, np.int64)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a model file."""
    return for_worker(f"pieces {path}", lambda: PieceEncoder(path))


def _encoded(batch: pa.RecordBatch, model: str, text: str) -> list[pa.ListArray]:
    encoder = piece_encoder(model)
    texts = texts_of(batch, text)
    packed = encoder.encode_all(texts)
    flat = np.frombuffer(b"".join(packed), "<i4")
    counts = np.array([len(x) // 4 for x in packed], np.int64)
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (flat, *encoder.spans_all(texts, flat, counts))]


def _decoded(ids: pa.ListArray, model: str) -> pa.Array:
    lists = [x.tolist() if x is not None else [] for x in ids.to_numpy(zero_copy_only=False)]
    return pa.array(piece_encoder(model).library.decode(lists, num_threads=1), pa.string())


def encode_pieces(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``, ``begins`` and ``ends``: piece ids of each whole text and their spans in its UTF-8 bytes.

    No begin or end ids, no sampling. Null and empty texts have empty lists. A character
    spelt by byte pieces gives each of them its own byte. Columns of ``df`` with
    these names are replaced; every row is encoded for itself, so repeated rows get equal lists and an empty
    table gives an empty table.
    """
    return extend(df, text, SPANS, lambda batch: _encoded(batch, model, text))


def decode_pieces(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the text the library decodes from each list of ids; null ids decode to the empty text."""
    return extend(df, ids, "decoded string", lambda batch: [_decoded(batch.column(ids), model)])


def encode_and_decode(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``encode_pieces`` and ``decode_pieces`` in one pass over the rows."""

    def compute(batch):
        encoded = _encoded(batch, model, text)
        return [*encoded, _decoded(encoded[0], model)]

    return extend(df, text, f"{SPANS}, decoded string", compute)
