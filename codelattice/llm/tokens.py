"""Fast exact ids for two public vocabulary files.

The ids are those of the tokenizers library for the same file. Two faster ways to them are used
where they are provably the same, and the library itself everywhere else:

* byte-level BPE (white space has ids): the file's vocabulary, read as ranks, is run by tiktoken.
* BPE with word ends (lower case, white space dropped): texts of Latin-1 characters without an
  apostrophe are cut into pieces by numpy from a table of character classes. Each piece gets a
  terminator, which plays the part of the word-end mark: merging a byte with it has the lowest
  ranks, so it comes first, and then the file's merges follow in their order.

A text that holds one of the file's added tokens (`<|endoftext|>`) goes to the library as it is, which
by default gives that token's own id.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

TERMINATOR = "\x00"
GPT_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, spaces: bool) -> "Encoder":
    """This process's encoder for a vocabulary file. spaces: the vocabulary has ids for white space."""
    if (path, spaces) not in _LOADED:
        _LOADED[path, spaces] = Encoder(path, spaces)
    return _LOADED[path, spaces]


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Encoder:
    """Ids of texts as numpy arrays of unsigned 16-bit integers; null and empty texts have none."""

    def __init__(self, path: str, spaces: bool):
        import tiktoken

        self.path, self._tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"].lower() for t in json.load(f).get("added_tokens") or []]
        # the first characters of added tokens, in either case; most texts have none of them
        self.first = re.compile("[" + re.escape("".join(sorted({c for t in self.added for c in (t[:1], t[:1].upper())}))) + "]" if self.added else r"(?!)")
        model = self.model()
        if len(model["vocab"]) > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self.spaces, symbol = spaces, byte_of_symbol()
        mark = model.get("end_of_word_suffix") or ""

        def raw(token: str) -> bytes:
            ended = bool(mark) and token.endswith(mark)
            return bytes(symbol[c] for c in (token[: -len(mark)] if ended else token)) + TERMINATOR.encode() * ended

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = ["".join(m) for m in merges]
        single = [c for c in symbol if c in model["vocab"]]
        first = [c + mark for c in single] + single if mark else single
        tokens = list(dict.fromkeys(first + order))
        ranks = {raw(t): i for i, t in enumerate(tokens)}
        if mark:  # the terminator alone must have a rank, but is always merged
            ranks.setdefault(TERMINATOR.encode(), len(tokens))
        self.ids = np.array([model["vocab"][t] for t in tokens] + [0], np.uint16)
        self.fast = tiktoken.Encoding("from_file", pat_str=GPT_SPLIT if spaces else rf"[^{TERMINATOR}]+{TERMINATOR}", mergeable_ranks=ranks, special_tokens={})
        kinds = [unicodedata.category(c)[0] for c in map(chr, range(256))]
        self.kind = np.array([0 if chr(i).isspace() and i not in (28, 29, 30, 31) else 1 if k == "L" else 2 if k == "N" else 3 for i, k in enumerate(kinds)], np.uint8)

    def model(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)["model"]

    @property
    def tokenizer(self):
        """The library's own, loaded when a text needs it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def slow(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint16)
        if self.first.search(text) and any(t in text.lower() for t in self.added):
            return self.slow(text)
        if self.spaces:
            return self.ids[self.fast.encode_to_numpy(text, disallowed_special=())]
        if "'" in text or TERMINATOR in text:
            return self.slow(text)
        try:
            raw = np.frombuffer(text.lower().encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return self.slow(text)
        kind = self.kind[raw]
        ends = np.empty(len(raw), bool)
        ends[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=ends[:-1])
        ends |= kind == 2
        kept = kind != 0
        ends &= kept
        at = np.cumsum(kept.view(np.uint8) + ends.view(np.uint8), dtype=np.int32)
        if not at[-1]:
            return np.empty(0, np.uint16)
        out = np.zeros(at[-1], np.uint8)
        solid = np.flatnonzero(kept)
        out[(at - ends).take(solid) - 1] = raw.take(solid)
        return self.ids[self.fast.encode_to_numpy(out.tobytes().decode("latin-1"), disallowed_special=())]
