"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding. It is
the vocabulary token that (1) ends the prefix and (2) may stand after the last token of
the prefix it leaves, which a test of the two tokens alone decides. An automaton lists
the tokens of (1), the longest first; the test of (2) replays the merges that touch the
border between both tokens. Last tokens are stored for every prefix, so token counts and
ids of all prefixes follow without encoding any of them again.

The vocabulary must give each token by one merge, which :class:`Vocabulary` checks.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from bisect import bisect_right
from functools import cached_property
from itertools import accumulate

import ahocorasick
import regex

NEVER = 1 << 40

# Fixed value: the pattern by which this family of vocabularies splits text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries that each half of a cache may hold, and the longest text that is kept in one.
CACHE_ENTRIES, CACHE_CHARS = 120_000, 40
PAIR_ENTRIES = 450_000

_ODD_SPACE = re.compile(r"[^\S \n]")
_INNER_SPACE = re.compile(r"(?<!\s) (?!\s)")


def byte_letters() -> dict[str, int]:
    """Letter -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent(dict):
    """Values by key; of more than ``entries`` keys the least recent half goes."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Pairs(dict):
    """Whether the bytes of two tokens together are encoded as these two tokens."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIR_ENTRIES:
            self.clear()
        fits = self[key] = self.vocabulary.crossing(key >> 20, key & 0xFFFFF) is None
        return fits


class Vocabulary:
    """Tokens, merges and the test whether two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer is asked for")
        letters = byte_letters()
        ids = model["vocab"]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take neighbouring text are not supported")
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for at, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = ids[left], ids[right], ids[left + right]
            if made in self.parts:
                raise ValueError(f"two merges make token {made}")
            self.rank[a << 20 | b] = at
            self.parts[made] = (a, b, at)
        self._ends: tuple[dict, dict] = ({}, {})
        self.pairs = Pairs(self)
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self._whole: dict[int, bool] = {}
        self.text = dict(self.bytes) | {i: t.encode() for t, i in self.special.items()}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Lists the tokens that end at each byte of a piece; decoding does without it."""
        found = ahocorasick.Automaton()
        for i, b in self.bytes.items():
            if b and self.whole(i):
                found.add_word(b.decode("latin-1"), (i, len(b)))
        found.make_automaton()
        self._whole.clear()
        return found

    def ends(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one end of ``token`` while it is built, each with the merge that takes it in."""
        found = self._ends[side].get(token)
        if found is None:
            chain, taken = [], NEVER
            at = token
            while True:
                chain.append((at, taken))
                if at not in self.parts:
                    break
                taken = self.parts[at][2]
                at = self.parts[at][side]
            found = self._ends[side][token] = chain[::-1]
        return found

    def crossing(self, a: int, b: int) -> tuple[int, bool] | None:
        """The first merge over the border of ``a`` and ``b``, and whether both were complete by then."""
        left, right = self.ends(a, 1), self.ends(b, 0)
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = left[i], right[j]
            at = self.rank.get(x << 20 | y)
            # of equal merges the one further left comes first
            if at is not None and at < x_taken and at <= y_taken:
                return at, x_taken == y_taken == NEVER
            if x_taken == y_taken == NEVER:
                return None
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether the bytes of ``token`` are encoded as this one token."""
        found = self._whole.get(token)
        if found is None:
            if token not in self.parts:
                found = len(self.bytes[token]) == 1
            else:
                a, b, at = self.parts[token]
                found = self.whole(a) and self.whole(b) and self.crossing(a, b) == (at, True)
            self._whole[token] = found
        return found

    def last_tokens(self, piece: bytes) -> list[int]:
        """For every prefix of ``piece`` the last token of its encoding (-1 for the empty one)."""
        last = [-1] * (len(piece) + 1)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0 and (size == end or pairs[last[end - size] << 20 | token]):
                last[end] = token
        return last

    def prefix_tokens(self, piece: bytes) -> list[int]:
        """For every prefix of ``piece`` the number of its tokens."""
        count, size = [0], self.size
        for end, token in enumerate(self.last_tokens(piece)[1:], 1):
            count.append(count[end - size[token]] + 1)
        return count

    def piece_ids(self, piece: bytes) -> list[int]:
        last, size, ids, end = self.last_tokens(piece), self.size, [], len(piece)
        while end:
            token = last[end]
            ids.append(token)
            end -= size[token]
        ids.reverse()
        return ids


class Encoder:
    """Whole texts over a vocabulary, with caches of a fixed size."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.piece = regex.compile(PIECES)
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.counts = Recent(lambda p: self.vocabulary.prefix_tokens(p.encode()))
        self.ids = Recent(lambda p: array("I", self.vocabulary.piece_ids(p.encode())).tobytes())
        self.chunk_count = Recent(lambda c: self.plain_count(" " + c))
        self.chunk_ids = Recent(lambda c: self.plain_ids(" " + c))

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """Pieces in order, each with whether it is a special token."""
        if self.split_special is None or not self.split_special.search(text):
            return [(p, False) for p in self.piece.findall(text)]
        found = []
        for k, part in enumerate(self.split_special.split(text)):
            found += [(part, True)] if k % 2 else [(p, False) for p in self.piece.findall(part)]
        return found

    def chunks(self, text: str) -> list[str]:
        """``text`` cut before single spaces with no space beside them, where pieces begin in any case.

        All but the first chunk have lost the space before them.
        """
        plain = not (_ODD_SPACE.search(text) or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ")
        return text.split(" ") if plain else _INNER_SPACE.split(text)

    def plain_count(self, text: str) -> int:
        if self.split_special is None or not self.split_special.search(text):
            counts = self.counts
            return sum([counts[p][-1] for p in self.piece.findall(text)])
        return sum(1 if special else self.counts[p][-1] for p, special in self.pieces(text))

    def plain_ids(self, text: str) -> bytes:
        if self.split_special is None or not self.split_special.search(text):
            return b"".join(map(self.ids.__getitem__, self.piece.findall(text)))
        special = self.vocabulary.special
        return b"".join([array("I", [special[p]]).tobytes() if s else self.ids[p] for p, s in self.pieces(text)])

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian 32-bit integers."""
        first, *rest = self.chunks(text)
        return self.plain_ids(first) + b"".join(map(self.chunk_ids.__getitem__, rest))

    def decode(self, ids) -> str:
        return b"".join(map(self.vocabulary.text.__getitem__, ids)).decode("utf-8", "replace")

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of every prefix, by number of characters, from 0 to the whole text."""
        out, base, earlier, before = [0], 0, 0, ""
        for piece, special in self.pieces(text):
            # a cut inside a piece may join its first characters to the piece before
            again = lambda part: earlier + self.plain_count(before + part)  # noqa: B023, E731
            if special:
                out += [again(piece[:j]) for j in range(1, len(piece))] + [base + 1]
                after = base + 1
            else:
                counts, at, start = self.counts[piece], 0, len(out)
                for c in piece:
                    at += 1 if c < "\x80" else len(c.encode())
                    out.append(base + counts[at])
                after = out[-1]
                if piece[0] == "'" and len(piece) > 2:
                    out[start + 1] = base + self.plain_count(piece[:2])
                if before.isspace() and piece[0].isspace():
                    out[start] = again(piece[0])
            earlier, base, before = (after, after, "") if special else (base, after, piece)
        return out

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the whole text, and the characters of its longest prefix of at most ``budget`` tokens."""
        first, *rest = self.chunks(text)
        sums = list(accumulate([self.plain_count(first), *map(self.chunk_count.__getitem__, rest)]))
        if sums[-1] <= budget:
            return sums[-1], len(text)
        k = bisect_right(sums, budget)
        base = sums[k - 1] if k else 0
        start = len(first) + sum(map(len, rest[: k - 1])) + k - 1 if k else 0
        inside = self.prefix_counts(" " + rest[k - 1] if k else first)
        return sums[-1], start + max(j for j, n in enumerate(inside) if base + n <= budget)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; one per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop the encoders of this worker."""
    _ENCODERS.clear()
    gc.collect()  # encoders hold functions that refer to them


def vocabulary_path(path: str) -> str:
    """``path`` itself, or the place of a file of the installed public vocabularies."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)
