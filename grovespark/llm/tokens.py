"""Token ids of whole texts, by the tokenizers library, with a memo of words.

Both vocabularies split a text into pieces before merging, so a text's ids are those of
its pieces in a row. The memo keeps the ids of pieces already seen, as packed bytes.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

_loaded: dict[tuple, PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts as the library does with add_special_tokens=False.

    splitter "space": the tokenizer drops white space, so texts are cut at ASCII white space.
    splitter "lead": for byte-level vocabularies whose pieces carry one leading space; texts are cut
    before a single space or line end between two characters that aren't white space, and a
    text where white space stands otherwise is encoded whole.
    """

    #: Pieces in the memo; when as many are there, those of the generation before go.
    KEPT = 900_000

    def __init__(self, path: str, splitter: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.splitter = splitter
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        #: Of a byte-level token, its bytes.
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.memo: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}
        #: Texts' first pieces, which no space leads.
        self.heads: dict[str, bytes] = {}
        #: Ids of a comma or full stop after a letter: a piece of its own in both vocabularies.
        self.tails = {c: self._pack(self.tokenizer.encode(c, add_special_tokens=False).ids) for c in ",."}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Put pieces into the memo. What differs from a word by a comma or full stop alone (or by ASCII
        capitals, where the tokenizer drops them) is put together from that word."""
        memo, before, tails = self.memo, self.before, self.tails
        new, made = [], []
        for p in pieces:
            if p in before:
                memo[p] = before[p]
                continue
            tail = p[-1]
            core = p[:-1] if tail in tails else p
            if not core.isalpha():
                new.append(p)
                continue
            if self.splitter == "space" and core.isascii():
                core = core.lower()
            if core != p:
                made.append((p, core, tails.get(tail, b"")))
            if core not in memo:
                if core in before:
                    memo[core] = before[core]
                else:
                    memo[core] = b""
                    new.append(core)
        self._encode_new(new)
        for p, core, tail in made:
            memo[p] = memo[core] + tail

    def _encode_new(self, new: list[str]) -> None:
        """Encode pieces in rows of many, and share out the ids by their places in the row."""
        k = self.dtype.itemsize
        for i in range(0, len(new), 512):
            part = new[i : i + 512]
            if self.splitter == "space":
                e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
                ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
                cuts = np.searchsorted(np.fromiter((o[0] for o in e.offsets), np.int64, len(e)), ends, "left")
                ids = np.array(e.ids, self.dtype)
            else:
                row = [p if p[0] == "\n" else " " + p for p in part]
                ids = np.array(self.tokenizer.encode("".join(row), add_special_tokens=False).ids, self.dtype)
                ends = np.cumsum(np.fromiter((len(p.encode()) for p in row), np.int64, len(row)))
                cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, "left") + 1
            packed, low = ids.tobytes(), 0
            for piece, high in zip(part, cuts.tolist(), strict=True):
                self.memo[piece] = packed[low * k : high * k]
                low = high

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; only a bounded number of pieces is kept."""
        memo = self.memo
        if len(memo) > self.KEPT:
            self.before = memo
            self.memo = memo = {}
        if self.splitter == "space":
            split = [_space_split(t) for t in texts]
            self._learn([p for p in set().union(*split) if p not in memo])
            return [b"".join([memo[p] for p in pieces]) for pieces in split]
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        new = [p for p in set().union(*[pieces[1:] for pieces in split]) if p not in memo]
        plain = [p for p in new if (body := p[1:] if p[:1] == "\n" else p) and not body[0].isspace() and not body[-1].isspace()]
        if len(plain) < len(new):
            memo.update(dict.fromkeys(set(new).difference(plain)))
        self._learn(plain)
        return [self._lead(t, pieces) for t, pieces in zip(texts, split, strict=True)]

    def _lead(self, text: str, pieces: list[str]) -> bytes:
        first, memo = pieces[0], self.memo
        if first and not first[-1].isspace() and "<|" not in text:
            head = self.heads.get(first)
            if head is None:
                if len(self.heads) > self.KEPT // 10:
                    self.heads.clear()
                head = self.heads[first] = self._pack(self.tokenizer.encode(first, add_special_tokens=False).ids)
            try:
                return head + b"".join([memo[p] for p in pieces[1:]])
            except TypeError:  # a piece that can't be cut off
                pass
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _space_split(text: str) -> list[str]:
    """Cut at ASCII white space alone: str.split() knows more than that."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [p.decode() for p in text.encode().split()]


def encoder(path: str, splitter: str) -> PieceEncoder:
    """One encoder for each process and file."""
    if (path, splitter) not in _loaded:
        _loaded[path, splitter] = PieceEncoder(path, splitter)
    return _loaded[path, splitter]
