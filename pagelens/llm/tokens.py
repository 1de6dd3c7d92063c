"""Token ids of whole texts by a public tokenizer, each distinct word encoded once a worker while the cache holds it."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .common import WORD_BYTES

#: Marks that may follow a letter; the apostrophe begins contractions and is not among them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

#: What an encoder may remember of words, in bytes (a process takes about twice that); beyond it keeps the most used only.
MAX_ENCODER_BYTES = 64 << 20
#: New words that are encoded at once: the library's results take about a kilobyte each.
NEW_WORDS = 8192


class _Words(dict):
    """Word to its place in the tables; new words are listed."""

    def __init__(self):
        self.new: list[bytes] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        self.size += len(word) + WORD_BYTES
        return at


class Encoder:
    """Ids as tokenizers gives for each text with add_special_tokens=False.

    Where the tokenizer drops white space, words are independent of each other, and so are a letter and the mark after
    it (both are tried out on the tokenizer): words are looked up in a cache of bounded size, and only new ones are
    encoded. Texts that hold one of the tokenizer's added tokens, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = all(one(f"{a}{gap}{b}") == one(a) + one(b) for gap in (" ", "\n", "\t \x0b") for a, b in (("ab", "cd"), ("a.", "'s"), ("1", "2"), (".", "!"), ("It", "IS"))) and one("ABC") == one("abc")
        apart = self.by_word and all(one(f"ab{m}{rest}") == one("ab") + one(f"{m}{rest}") for m in MARKS for rest in ("", "!", "c", "'s", "́", "1"))
        self.split = re.compile(b"(?<=[a-z])(?=[" + re.escape(MARKS).encode() + b"])").sub if apart else None
        self._forget()

    def _forget(self) -> None:
        self.known = _Words()
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int64)

    def _forget_rare(self) -> None:
        """Forgets the words met once, and as many of the least used as leave half of what may be remembered."""
        known, uses = self.known, self.uses
        order = np.argsort(-uses, kind="stable")[: np.count_nonzero(uses > 1)]
        words, taken, keep = list(known), 0, []
        for at in order.tolist():
            taken += len(words[at]) + WORD_BYTES
            if taken > MAX_ENCODER_BYTES // 2:
                break
            keep.append(at)
        at = np.array(keep, np.int64)
        starts, lengths, flat = self.starts[at], self.lengths[at], self.flat
        self._forget()
        for place in keep:
            self.known[words[place]]
        self.known.new = []
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = flat[np.arange(lengths.sum()) + np.repeat(starts - self.starts, lengths)]
        self.uses = uses[at] >> 1

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, as uint32, and each text's number of ids."""
        if self.known.size > MAX_ENCODER_BYTES:
            self._forget_rare()
        whole: dict[int, np.ndarray] = {}
        places: list[np.ndarray] = []
        of = self.known.__getitem__
        for i, text in enumerate(texts):
            low = text.lower() if text else b""
            if not self.by_word or any(a in low for a in self.added):
                whole[i] = np.array(self._raw([text.decode() if text else ""])[0], np.uint32)
                low = b""
            words = (self.split(b" ", low) if self.split else low).split()
            places.append(np.fromiter(map(of, words), np.int64, len(words)))
        if self.known.new:
            new, self.known.new = self.known.new, []
            sizes, parts = [self.lengths], [self.flat]
            for i in range(0, len(new), NEW_WORDS):
                ids = self._raw([w.decode() for w in new[i : i + NEW_WORDS]])
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                parts.append(np.fromiter((x for i in ids for x in i), np.uint32, int(sizes[-1].sum())))
            self.lengths, self.flat = np.concatenate(sizes), np.concatenate(parts)
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        words = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.uses += np.bincount(words, minlength=len(self.uses))
        lengths = self.lengths[words]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[words] - (ends - lengths), lengths)
        flat = self.flat[at]
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, places)])]
        sizes = np.diff(cuts)
        if whole:
            parts = [whole.get(i, flat[cuts[i] : cuts[i + 1]]) for i in range(len(texts))]
            flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return flat, sizes


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder, whose memory of words, bounded by bytes, serves all tasks that the worker runs."""
    return Encoder(path)
