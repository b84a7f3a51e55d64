"""Library tokenizers behind bounded caches: a text is cut where no token can cross, and the ids of its parts are looked up.

The tokenizers' own code gives the ids of every part that isn't held. A cut is made only where the tokenizer's own pipeline
(read from its file) makes one too, so the ids are those of the whole text; a tokenizer with another pipeline gets whole texts."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

#: White space (Unicode's property), and the letters and numbers of the first 256 code points.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PATTERN = _SUFFIX + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_1 = "\u0100"  # words that lie below hold code points that every Unicode version classifies alike


class Memo(dict):
    """What ``make`` gives for a string. Two generations of ``most`` at most are held: what is met again moves to the new one,
    the rest goes with the old one. Strings over 64 code points aren't held."""

    def __init__(self, make: Callable[[str], bytes], most: int = 300_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part)
        if got is None:
            got = self.make(part)
        if len(part) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = got
        return got


def _byte_names() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(other)) for b in range(256)]


BYTE_NAMES = _byte_names()


class _Parts:
    """Ids of single matches of a tokenizer's split pattern, by its merging model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            self.pipeline = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.size = self.library.get_vocab_size()
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.parts = Memo(self._part)

    def ids(self, numbers) -> bytes:
        return array(self.code, numbers).tobytes()

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isalpha()):
            part = "".join([BYTE_NAMES[b] for b in part.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(part)]).tobytes()

    def whole(self, text: str) -> bytes:
        return self.ids(self.library.encode(text, add_special_tokens=False).ids)

    def _steps(self, name: str) -> list:
        step = self.pipeline.get(name) or {}
        return [{k: v for k, v in s.items() if k not in ("trim_offsets", "type")} | {"type": s["type"]}
                for s in step.get("normalizers") or step.get("pretokenizers") or ([step] if step else [])]


class WordBpe(_Parts):
    """A tokenizer that composes characters, drops white space, lowers case and ends words. White space is no part of any token
    and composes with nothing, so a text is cut at it."""

    SPLIT = re.compile(f"{_SUFFIX}|[{_LETTER}]+|[{_NUMBER}]|[^{SPACE}{_LETTER}{_NUMBER}]+")
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLITS = [{"type": "Split", "pattern": {"Regex": _SUFFIX + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed",
               "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]

    def __init__(self, path: str):
        super().__init__(path)
        self.words = Memo(self._word)
        self.cuts = self._steps("normalizer") == self.NORMAL and self._steps("pre_tokenizer") == self.SPLITS
        self.special = [t["content"] for t in self.pipeline["added_tokens"]]
        self.mark = self.special[0][:2] if self.special else "\0"
        self.cuts &= all(t.startswith(self.mark) and len(self.mark) == 2 and not re.search(r"\s", t) for t in self.special)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._part(word)
        if not word or max(word) < LATIN_1:
            return b"".join(map(self.parts.__getitem__, self.SPLIT.findall(word.lower())))
        return self.whole(word)

    def encode(self, raw: bytes) -> bytes:
        """Ids of a UTF-8 text. Only A-Z are lowered before the lookup; a text in which a special token may lie is given to the
        library as it is."""
        text = raw.decode("utf-8", "replace")
        if not self.cuts or self.special and self.mark in text:
            return self.whole(text)
        text = raw.lower().decode("utf-8", "replace")
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        return b"".join(map(self.words.__getitem__, text.split(" ")))


class ByteBpe(_Parts):
    """A byte-level tokenizer, special tokens being ordinary text. No match of its split pattern goes on from other characters to
    white space, so a text is cut before each run of white space."""

    CUT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
    SPLIT = re.compile(f"{_SUFFIX}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{SPACE}{_LETTER}{_NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.chunks = Memo(self._chunk)
        self.cuts = self._steps("normalizer") == [] and self._steps("pre_tokenizer") == [
            {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}]
        byte = {c: b for b, c in enumerate(BYTE_NAMES)}
        names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        added = {t["id"]: t["content"].encode() for t in self.pipeline["added_tokens"]}
        self.bytes = [added.get(i) or bytes(byte[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]

    def _chunk(self, chunk: str) -> bytes:
        if max(chunk) < LATIN_1:
            return b"".join(map(self.parts.__getitem__, self.SPLIT.findall(chunk)))
        return self.whole(chunk)

    def encode(self, text: str) -> bytes:
        if not self.cuts:
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, self.CUT.findall(text)))


class PieceBpe:
    """A sentencepiece tokenizer that writes a space as U+2581 and puts one before the text. If none of its pieces has one after
    another character, no token goes on from a word to a space, and a text is cut before each run of spaces."""

    CUT = re.compile(" +[^ ]*")
    MARK = "\u2581"

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self.code = "H" if self.size <= 1 << 16 else "I"
        pieces = [self.library.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(self.MARK, " ").encode()
                      for i, p in enumerate(pieces)]
        probe = "  ﬁ①Å  x\n\t\xa0. "
        self.cuts = (all(self.MARK not in p.lstrip(self.MARK) for p in pieces) and self.MARK in pieces
                     and self.library.normalize(probe) == self.MARK + probe.replace(" ", self.MARK))
        self.space = self.library.piece_to_id(self.MARK)
        self.chunks = Memo(self._chunk)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, num_threads=1)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk == " ":  # no text is left after the space that the tokenizer adds
            return array(self.code, [self.space]).tobytes()
        return self.whole(chunk[1:])

    def encode(self, text: str) -> bytes:
        """Ids of a text that isn't empty."""
        if not self.cuts:
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, self.CUT.findall(" " + text)))
