"""Texts to token ids with the tokenizers library, remembering what was encoded before.

Byte-level BPE works piece by piece, and a piece never holds white space after
other characters. So a text may be cut before any space that follows a
character which isn't white space, and what lies between two cuts always gets
the same ids. Each worker encodes a run of characters once and looks it up
after that. What is remembered is bounded: two generations of runs, of which
the older is dropped when the younger is full.
"""

from __future__ import annotations

import os
import re

import numpy as np
import regex

GENERATION, LONGEST_RUN = 350_000, 48
_SPACED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
#: Anything but a line end and the printable characters that every version of Unicode classes alike.
_UNSURE = re.compile("[^\n\x21-\x7e\xa1-\u024f]")
#: How byte-level BPE cuts a text into pieces (the published pattern; a fixed value).
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_MARKS = frozenset(".,;:!?")
_ENCODERS: dict[str, Encoder] = {}


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the tokenizer's file lies on the machine that asks; every executor has the library."""
    import public_tokenizers
    return public_tokenizers.path(name)


def encoder(path: str | None = None, remembered: int | None = None) -> Encoder:
    """The encoder of a file, one for each Python worker; ``remembered`` runs make a generation, where there is room for more."""
    path = path or vocabulary_file()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].generation = remembered or GENERATION
    return _ENCODERS[path]


def _alphabet() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return [chr(b if b in prints else 256 + rest.index(b)) for b in range(256)]


class Encoder:
    """``encode`` gives the ids of texts as little-endian unsigned 32-bit integers in bytes.

    These are the library's for the file as it is; a text that holds one of the
    file's added tokens goes to the library whole. Only for vocabularies of
    byte-level BPE with the usual cut into pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model = self.tokenizer.model
        self.letters = _alphabet()
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.mark = {m: self._plainly([m])[0] for m in _MARKS}
        self.generation = GENERATION
        self.runs = Runs(self)
        self.pieces: dict[str, bytes] = {}

    def _plainly(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _word(self, letters: str) -> bytes:
        """Ids of a piece whose bytes are written as letters."""
        as_bytes = self.as_bytes
        return b"".join([as_bytes[x.id] for x in self.model.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._word("".join(map(self.letters.__getitem__, piece.encode())))
            if len(piece) <= 4:
                self.pieces[piece] = ids
        return ids

    def run(self, run: str) -> bytes:
        """The ids of a run that follows a space."""
        if not run or len(run) > LONGEST_RUN or not run.isascii() and _UNSURE.search(run):
            return self._plainly([" " + run])[0]
        if run.isalpha():  # one piece
            return self._word("\u0120" + (run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))))
        if _UNSURE.search(run):
            return self._plainly([" " + run])[0]
        if run[-1] in _MARKS and run[:-1].isalpha():  # a mark after a word is a piece of its own
            return self.runs[run[:-1]] + self.mark[run[-1]]
        return b"".join(map(self._piece, PIECES.findall(" " + run)))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if self.added.search(t)] if self.added else []
        if not whole:
            return self._by_runs(texts)
        found = dict(zip(whole, self._plainly([texts[k] for k in whole]), strict=True))
        rest = iter(self._by_runs([t for k, t in enumerate(texts) if k not in found]))
        return [found[k] if k in found else next(rest) for k in range(len(texts))]

    def _by_runs(self, texts: list[str]) -> list[bytes]:
        cut = [(_CUT.split(t) if _SPACED.search(t) else t.split(" ")) for t in texts]
        heads = self._plainly([runs[0] for runs in cut])
        out = []
        for head, runs in zip(heads, cut, strict=True):
            out.append(head + b"".join(map(self.runs.__getitem__, runs[1:])))
            if len(self.runs) > self.generation:
                self.runs = Runs(self, self.runs)
                self.pieces.clear()
        return out


class Runs(dict):
    """Ids of runs that follow a space; what is missing comes from the generation before, or from the encoder."""

    def __init__(self, encoder: Encoder, before: Runs | None = None):
        super().__init__()
        self.encoder, self.before = encoder, dict(before or ())  # and forgets what stood before that

    def __missing__(self, run: str) -> bytes:
        ids = self.before.get(run)
        if ids is None:
            ids = self.encoder.run(run)
        if len(run) <= LONGEST_RUN:
            self[run] = ids
        return ids
