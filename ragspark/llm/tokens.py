"""Token ids of whole texts, with the tokenizers library."""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

#: Word pieces a worker remembers in each of its two generations.
REMEMBERED = 400_000
#: The byte-level splitting rule, and the first character not taken through the short path.
RULE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
MARKS, LATIN_END = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "\u0250"
_encoders: dict[tuple[int, bool], Encoder] = {}


def default_tokenizer() -> str:
    """The file of the byte-level BPE tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def share_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's content for all executors; a vocabulary file, whose size does not grow with the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(shared: Broadcast, plain: bool = False) -> Encoder:
    """This worker's encoder of the shared tokenizer, kept from task to task."""
    key = hash(shared.value), plain
    if key not in _encoders:
        _encoders[key] = Encoder(shared.value, plain)
    return _encoders[key]


class _Whole(Exception):
    """This text can't be put together from pieces."""


class _Pieces(dict):
    """Ids as bytes of ` piece`, by piece without its blank; of a piece with its line feed; or of an inner part, by the
    part after a zero character."""

    def __init__(self, own: Encoder):
        super().__init__()
        self.own, self.old = own, {}
        self.code, self.blank, self.tokenize = own.code, own.blank, own.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            if piece.isalpha() and piece.isascii():  # most new pieces, without further calls
                ids = array(self.code, [t.id for t in self.tokenize(self.blank + piece)]).tobytes()
            else:
                ids = self.own.learn(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, equal to the library's own.

    A byte-level BPE with this splitting rule never merges over the start of a blank or line feed that no other
    white space precedes or follows. So a text falls into pieces there, and the library's BPE model encodes each new
    piece once, part by part of the splitting rule; pieces met before are remembered, in two bounded generations.
    Pieces with letters beyond Latin are encoded by the library's full path, and so are whole texts that hold a
    special token, a zero character, other white space or white space in a row, and all texts if the tokenizer is of another kind.
    plain: special tokens' strings in a text are ordinary text.
    """

    def __init__(self, content: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = plain
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(content)
        rule, model = parts.get("pre_tokenizer") or {}, parts["model"]
        self.splits = (
            rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space") and rule.get("use_regex", True) and not parts.get("normalizer")
            and model["type"] == "BPE" and not model.get("dropout")
        )
        self.model = Tokenizer.from_str(content).model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # pieces come here once
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(others)}  # the byte-level alphabet: printable bytes are themselves
        self.blank = self.letters[32]
        self.pieces = _Pieces(self)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        if part.isascii() and part[1:].isalnum():
            mapped = part.replace(" ", self.blank)
        else:
            mapped = part.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(mapped)])

    def learn(self, piece: str) -> bytes:
        first = piece[:1]
        if first == "\0":
            return self._part(piece[1:])
        if first == "\n":
            body, head, get = piece[1:], "", lambda x: self.pieces["\0" + x]
            if not body:
                return self._part(piece)
        else:
            body, head, get = piece, " ", self.pieces.__getitem__
        if body.isalpha():
            if body.isascii():
                return self._part(" " + body) if body is piece else self.pieces["\0\n"] + get(body)
        elif len(body.split()) != 1 or body[0].isspace() or body[-1].isspace() or "\0" in body:
            raise _Whole
        if max(body) >= LATIN_END:
            return self._whole(piece if body is not piece else " " + piece)
        feed = b"" if body is piece else self.pieces["\0\n"]
        stem = body.rstrip(MARKS)
        if stem.isalpha():
            if len(stem) == len(body):
                return self._part(" " + body) if body is piece else feed + get(body)
            return feed + get(stem) + self.pieces["\0" + body[len(stem):]]
        return feed + b"".join([self.pieces["\0" + x] for x in RULE.findall(head + body)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens added."""
        if len(self.pieces) > REMEMBERED:
            old, self.pieces = self.pieces, _Pieces(self)
            old.old, self.pieces.old = {}, dict(old)
        out, get = [], self.pieces.__getitem__
        for text in texts:
            try:
                if not self.splits or "\0" in text or "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n") or any(x in text for x in self.special):
                    raise _Whole
                head, *words = text.replace("\n", " \n").split(" ")
                raw = self._whole(head) + b"".join(map(get, words))
            except _Whole:
                raw = self._whole(text)
            out.append(np.frombuffer(raw, self.dtype))
        return out
