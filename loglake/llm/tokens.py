"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import itertools
import os
import re

import numpy as np

#: Text pieces whose ids a worker remembers: the first to come, which frequent ones are among.
REMEMBERED = 400_000

# A single space between two other characters always begins a token, so texts can be cut before it.
_CUT = re.compile(r" (?<=\S )(?=\S)")
# White space other than the space and the line feed, or two in a row: such texts are cut by the pattern above.
_UNEVEN = re.compile(
    "  | \n|\n |[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)

_SPACE = re.compile(r"\s")

_LOADED: dict[str, PieceIds] = {}


#: Pieces that are tokenised as one text.
JOINED = 512


class PieceIds(dict):
    """Ids, as little-endian unsigned 32-bit numbers, of pieces that follow a space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        #: Added tokens that a cut before a space may split or change: texts with one are not cut.
        self.spaced = [t.content for t in added if re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    def encode(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def learn(self, pieces: list[str]) -> None:
        """Ids of pieces, many of which are tokenised as one text.

        In a piece without white space, only the first token begins with the space before it; so the ids of such
        pieces in a row are cut there. A row in which that is not so, as with added tokens, is tokenised piece by piece.
        """
        plain = [p for p in pieces if p and not _SPACE.search(p) and not any(t in p for t in self.added)]
        rows = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        encoded = self.tokenizer.encode_batch_fast(["".join(f" {p}" for p in row) for row in rows], add_special_tokens=False)
        for row, e in zip(rows, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) == len(row) and cuts[0] == 0:
                self.update(zip(row, (x.tobytes() for x in np.split(ids, cuts[1:])), strict=True))
        left = [p for p in pieces if p not in self]
        self.update(zip(left, self.encode([f" {p}" for p in left]), strict=True))


def loaded(path: str) -> PieceIds:
    """The tokenizer of ``path``, read once a worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceIds(path)
    return _LOADED[path]


def token_ids(texts: list[str], known: PieceIds) -> list[np.ndarray]:
    """Ids of whole texts, as the tokenizer gives them for each in one call.

    Byte-level BPE splits a text into words before merging, and a word takes the one space before it along; so ids of
    the pieces between such spaces, most of which are known already, make the ids of the text. Added tokens in a text
    are found as the tokenizer finds them. New pieces are tokenised together; those beyond ``REMEMBERED`` are forgotten
    again.
    """
    whole = [any(s in t for s in known.spaced) for t in texts]
    cut = [[t] if w else _CUT.split(t) if _UNEVEN.search(t) else t.split(" ") for t, w in zip(texts, whole, strict=True)]
    new = list(dict.fromkeys(p for pieces in cut for p in pieces[1:] if p not in known))
    known.learn(new)
    firsts = known.encode([pieces[0] for pieces in cut])
    out = [
        np.frombuffer(b"".join(itertools.chain((first,), map(known.__getitem__, pieces[1:]))), "<u4")
        for first, pieces in zip(firsts, cut, strict=True)
    ]
    for p in new if len(known) > REMEMBERED else ():
        del known[p]
    return out
