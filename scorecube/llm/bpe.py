"""Byte-level BPE by a rank file, as a lazily determinised finite-state transducer, and a streaming decoder.

Of every prefix of a word, byte pair encoding has one result, and a sequence of tokens is the result for its bytes exactly
if each neighbouring pair is (Berglund and van der Merwe, "Formalizing BPE Tokenization"). So an automaton can read bytes from
the left: a branch is a token sequence that ends before the current byte's token, and a node in the trie of token
bytes. A byte moves each branch down the trie, and where a node is a token that may follow the branch's last one, the
branch of the whole prefix begins. The tokens that all branches share are emitted; a branch lives no longer than the
longest token, so the lookahead is bounded. The set of branches, with what they have not emitted, is the state of the
deterministic transducer; states and moves are made when they are first met and kept in tables of bounded size."""

from __future__ import annotations

import base64
from array import array

import numpy as np

from . import memo
from .common import held

MOST_STATES = 100_000
MOST_WORDS = 250_000
MOST_PAIRS = 400_000
MATCHES = 200_000
NEVER = (-1, -1)


class Vocabulary:
    """Ranks of a tiktoken rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.pairs: dict[int, bool] = {}
        self.usable: list[bool | None] = [None] * size
        self.split: dict[int, tuple[int, int] | None] = {}
        length = np.array([len(t) for t in self.tokens], np.int64)
        self.ends = np.cumsum(length)
        self.starts = self.ends - length
        self.joined = np.frombuffer(b"".join(self.tokens), np.uint8)
        # nodes: a dictionary of moves and the token that ends there; only tokens that merging their own bytes gives
        self.moves: list[dict[int, int]] = [{}]
        self.ending: list[int] = [-1]
        for t, r in self.ranks.items():
            at = 0
            for c in t:
                if c not in self.moves[at]:
                    self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.ending.append(-1)
                at = self.moves[at][c]
            self.ending[at] = r

    def merge(self, raw: bytes, until: int = 1) -> list:
        """Byte pair encoding by its definition: the neighbours of least rank merge, the leftmost first. With ``until``, the
        parts' bytes when so many are left."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > until:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts] if until == 1 else parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge last into this one; None for a byte. A token that merging its own bytes doesn't give has
        no halves that join, and is never reached: NEVER."""
        got = self.split.get(token, self)
        if got is self:
            raw = self.tokens[token]
            parts = self.merge(raw, 2)
            got = None if len(raw) < 2 else NEVER
            if len(parts) == 2 and self.merge(raw) == [token]:
                got = (self.ranks[parts[0]], self.ranks[parts[1]])
            self.split[token] = got
        return got

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two: undoing merges on both sides of the border, the
        latest first, no merge across the border may have come before the one that is undone."""
        got = self.pairs.get(a << 32 | b)
        if got is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            got = self.pairs[a << 32 | b] = self._apart(a, b)
        return got

    def _apart(self, a: int, b: int) -> bool:
        tokens, ranks, before = self.tokens, self.ranks, 1 << 60
        left, right = a, b
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            # of merges of equal rank the one further left is made first, and undone last
            if across is not None and across < before:
                return False
            x, y = self.halves(left), self.halves(right)
            if x is None and y is None:
                return True
            if y is None or x is not None and left > right:
                before, left = left, x[1]
            else:
                before, right = right + 1, y[0]


class Transducer:
    """State 0 has read nothing. A state is a tuple of branches (tokens not emitted yet, last token, trie node). A move is one entry
    of a table by state and byte: the next state, or, where tokens are emitted, a pair of both.

    When MOST_STATES are held, the older half stays: states that many words share are met early, those of rare words late."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        begin = (((), -1, 0),)
        self.states = [begin]
        self.numbers = {begin: 0}
        self.moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def shrink(self) -> None:
        keep = MOST_STATES // 2
        for state in self.states[keep:]:
            del self.numbers[state]
        del self.states[keep:]
        self.moves = {k: m for k, m in self.moves.items() if k >> 8 < keep and (m if m.__class__ is int else m[0]) < keep}
        self.ends = {k: v for k, v in self.ends.items() if k < keep}

    def move(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """The move, determinised now."""
        v = self.vocabulary
        down, ending, usable, pairs = v.moves, v.ending, v.usable, v.pairs
        branches = []
        for pending, last, node in self.states[state]:
            child = down[node].get(byte)
            if child is None:
                continue
            if down[child]:
                branches.append((pending, last, child))
            token = ending[child]
            if token >= 0:
                good = usable[token]
                if good is None:
                    good = usable[token] = v.halves(token) != NEVER
                if good and last >= 0:
                    good = pairs.get(last << 32 | token)
                    if good is None:
                        good = v.follows(last, token)
                if good:
                    branches.append(((*pending, token), token, 0))
        emitted: tuple[int, ...]
        if len(branches) == 1:
            emitted, last, node = branches[0]
            target = (((), last, node),)
        else:
            emitted = min([b[0] for b in branches], key=len)
            for pending, _, _ in branches:
                if pending[:len(emitted)] != emitted:
                    k = 0
                    while pending[k] == emitted[k]:
                        k += 1
                    emitted = emitted[:k]
            if emitted:
                k = len(emitted)
                branches = [(p[k:], last, node) for p, last, node in branches]
            branches.sort()
            target = tuple(branches)
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states)
            self.states.append(target)
        got = self.moves[state << 8 | byte] = (number, emitted) if emitted else number
        return got

    def encode(self, raw: bytes) -> list[int]:
        """Tokens of one match of the split pattern."""
        whole = self.vocabulary.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(self.states) > MOST_STATES:
            self.shrink()
        out: list[int] = []
        state, find = 0, self.moves.get
        for byte in raw:
            got = find(state << 8 | byte)
            if got is None:
                got = self.move(state, byte)
            if got.__class__ is int:
                state = got
            else:
                state = got[0]
                out += got[1]
        rest = self.ends.get(state)
        if rest is None:
            rest = self.ends[state] = next((p for p, _, node in self.states[state] if node == 0), ())
        out += rest
        return out


class Encoder(dict):
    """Whole texts to token numbers. As a dictionary: matches of the split pattern to their tokens' bytes (<u4), so that
    a match that recurs is looked up. Two generations of MOST_WORDS at most are held: a match that is met again moves to
    the new one, the others go with the old one."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import regex
        self.vocabulary = Vocabulary(path)
        self.transducer = Transducer(self.vocabulary)
        self.pattern = regex.compile(pattern)
        #: the same pattern by the plain module, for texts of the first 256 code points
        self.narrow = memo.ByteBpe.SPLIT if pattern == memo.BYTE_PATTERN else None
        self.old: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        got = self.old.get(match)
        if got is None:
            got = array("I", self.transducer.encode(match.encode())).tobytes()
        if len(match) <= 64:
            if len(self) >= MOST_WORDS:
                self.old = dict(self)
                self.clear()
            self[match] = got
        return got

    def encode(self, text: str) -> bytes:
        """Token numbers as little-endian unsigned 32-bit integers."""
        if len(text) <= MATCHES:
            return b"".join(map(self.__getitem__, self._split(text)))
        out, part = bytearray(), []
        for m in self.pattern.finditer(text):  # a very long text: its matches are never held together
            part.append(m.group())
            if len(part) == MATCHES:
                out += b"".join(map(self.__getitem__, part))
                part.clear()
        return bytes(out) + b"".join(map(self.__getitem__, part))

    def _split(self, text: str) -> list[str]:
        if self.narrow:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return self.narrow.findall(text)
        return self.pattern.findall(text)

    def raw(self, ids: np.ndarray) -> bytes:
        v = self.vocabulary
        start, length = v.starts[ids], v.ends[ids] - v.starts[ids]
        ends = np.cumsum(length)
        if not len(ends):
            return b""
        return v.joined[np.arange(int(ends[-1])) + np.repeat(start - (ends - length), length)].tobytes()

    def decode(self, ids: np.ndarray, step: int = 1 << 16):
        """Pieces of text as the numbers stream in; a character whose bytes are split between tokens waits for its rest."""
        machine = Utf8Machine()
        for i in range(0, len(ids), step):
            yield machine.feed(self.raw(ids[i:i + step]))
        yield machine.end()


class Utf8Machine:
    """Incremental UTF-8 decoding. The state is what a character still needs: (bytes to come, least and greatest next
    byte); the machine runs over the last bytes of a piece only, as the rest of it is whole characters."""

    #: lead byte range: (bytes to come, least and greatest second byte)
    LEADS = [(0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
             (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF),
             (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]

    def __init__(self):
        self.held = b""

    @classmethod
    def unfinished(cls, raw: bytes) -> int:
        """How many of the last bytes begin a character that the next bytes may finish."""
        for back in range(1, min(3, len(raw)) + 1):
            byte = raw[-back]
            if 0x80 <= byte <= 0xBF:
                continue
            need = next(((n, lo, hi) for a, b, n, lo, hi in cls.LEADS if a <= byte <= b), (0, 0, 0))
            state, low, high = need
            for follow in raw[len(raw) - back + 1:]:
                if not state or not low <= follow <= high:
                    return 0
                state, low, high = state - 1, 0x80, 0xBF
            return back if state else 0
        return 0

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        keep = len(raw) - self.unfinished(raw)
        self.held = raw[keep:]
        return raw[:keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for a worker process, whatever the number of its tasks."""
    return held((path, pattern), lambda: Encoder(path, pattern))

