"""Byte-level BPE token ids of whole texts by the tokenizers library, with a memory of words."""

from __future__ import annotations

import json
import os

import numpy as np

from datelore.llm.common import for_worker


class WordEncoder:
    """Ids of texts as little-endian unsigned integers.

    Byte-level pre-tokenisation always cuts before a single blank or line end between two
    characters that are not white space, so such texts are encoded word by word: words met before come
    from a dictionary, new ones go to the library in one string. Texts with other white space or
    added tokens, and vocabularies of another kind, are encoded whole. The ids are the
    library's own in each case. The dictionary holds ``limit`` words of at most 64 characters;
    words beyond that are encoded each time.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.tokenizer.to_str())
        cut = spec.get("pre_tokenizer") or {}
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.added = added
        self.by_words = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and spec.get("normalizer") is None
        # Byte-level vocabularies write blank and line end as these two letters.
        first = {i: token[:1] for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.opens = np.array([first.get(i, "") in ("Ġ", "Ċ") for i in range(max(first, default=-1) + 1)], bool)
        self.limit, self.known = limit, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_words or any(a in text for a in self.added):
            return self.whole(text)
        # A word after a line end keeps it in front, a word after a blank stands bare; the text starts like a line.
        words = f"\n{text}".replace("\n", " \n").split(" ")
        del words[0]
        ids = list(map(self.known.get, words))
        if None in ids:
            new = {w for w, i in zip(words, ids) if i is None}
            if not all(map(_separable, new)):
                return self.whole(text)
            learnt = self.learn(new)
            ids = [learnt[w] if i is None else i for w, i in zip(words, ids)]
        return b"".join(ids)[self.dtype.itemsize :]  # less the line end put in front

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words. A full stop or comma after a letter is a token of its own."""
        stems = {w: w[:-1] for w in words if w[-1] in ".," and len(w) > 1 and w[-2].isalpha()}
        get = self.known.get
        plain = sorted({s for w in words if get(s := stems.get(w, w)) is None})
        found = dict(zip(plain, self.split(plain)))
        marks = {m: self.whole(m) for m in {w[-1] for w in stems}}
        for word, stem in stems.items():
            found[word] = (found.get(stem) or get(stem)) + marks[word[-1]]
        if len(self.known) < self.limit:
            self.known.update((w, i) for w, i in found.items() if len(w) <= 64)
        return found

    def split(self, words: list[str]) -> list[bytes]:
        spelt = [w if w[0] == "\n" else f" {w}" for w in words]
        ids = np.frombuffer(self.whole("".join(spelt)), self.dtype)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words):
            return [self.whole(w) for w in spelt]
        ends = [*starts[1:].tolist(), len(ids)]
        return [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends)]


def _separable(word: str) -> bool:
    bare = word[1:] if word[:1] == "\n" else word
    return bool(bare) and not bare[0].isspace() and not bare[-1].isspace()


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    return for_worker(f"words {path}", lambda: WordEncoder(path))
