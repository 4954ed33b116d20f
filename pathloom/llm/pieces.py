"""Byte-pair ids of whole texts from a bounded memory of short pieces.

A text falls apart before every space that follows a visible character: pre-tokens never run
across that place, so the ids of a text are those of its pieces in a row.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np

PLAIN_BREAK = re.compile(r"(?<=\S)(?= )")
SPACE_RUN = re.compile(r"\s ")
PLAIN = re.compile(r" [^\s](?:[^ ]*[^\s ])?")
# plain, of characters whose classes are the same in every Unicode version the libraries know
SETTLED = re.compile(r" [!-~\u00a1-\u052f](?:[\n!-~\u00a1-\u052f]*[!-~\u00a1-\u052f])?")
# fixed value: the pre-tokens of byte-level vocabularies
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY = 250_000  # pieces a Python worker remembers, some 45 MB
TOGETHER = 200    # new pieces encoded as one string
AT_ONCE = 50_000  # new pieces whose ids are taken apart together


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pieces(text: str) -> list[str]:
    """Pieces of ``text``, which they make up in order."""
    if "\x00" in text or SPACE_RUN.search(text):
        return PLAIN_BREAK.split(text)
    return text.replace(" ", "\x00 ").split("\x00")


def rank_encoder(tokenizer):
    """The vocabulary of ``tokenizer`` as ranks for the ``tiktoken`` library, or None if ids
    don't follow the order of the merges, each making a token of its own.

    Then merging the pair with the least id of the result is merging by the first rule, in a
    fraction of the time.
    """
    import tiktoken

    rules = json.loads(tokenizer.to_str())
    model, before = rules["model"], rules["pre_tokenizer"]
    ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    single = [i for t, i in model["vocab"].items() if len(t) == 1]
    plain = not (rules["normalizer"] or model.get("dropout") or model.get("ignore_merges")
                 or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if not (plain and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
            and len(single) == 256 and max(single) < ids[0] and len(ids) + 256 == len(model["vocab"])
            and all(a < b for a, b in zip(ids, ids[1:]))):
        return None
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items()}
    return tiktoken.Encoding("pieces", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


class PieceEncoder:
    """Ids of texts by a byte-level vocabulary of the ``tokenizers`` library, four bytes each,
    little-endian."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()  # a character of a byte-level token is a byte
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.ranks = rank_encoder(self.tokenizer)
        self.memory = memory
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; special tokens in a text are ordinary characters."""
        split = [split_pieces(t) for t in texts]
        here = set().union(*split)
        fresh = list(here.difference(self.known))
        if len(self.known) + len(fresh) > self.memory:  # what these texts use stays
            self.known = {p: self.known[p] for p in here.intersection(self.known)}
        self._learn(fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def _learn(self, fresh: list[str]) -> None:
        """Pieces of one space in front and a visible end may stand in a row and still be
        encoded as each by itself; the lengths of the tokens tell them apart."""
        settled = list(filter(SETTLED.fullmatch, fresh)) if self.ranks else []
        rest = set(fresh).difference(settled) if len(settled) < len(fresh) else set()
        plain = list(filter(PLAIN.fullmatch, rest))
        odd = list(rest.difference(plain))
        for piece, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.known[piece] = array("I", e.ids).tobytes()
        for at in range(0, len(settled), AT_ONCE):
            part = settled[at:at + AT_ONCE]
            self._remember(part, np.array(self.ranks.encode_ordinary("".join(part)), np.uint32))
        for at in range(0, len(plain), AT_ONCE):
            part = plain[at:at + AT_ONCE]
            rows = ["".join(part[i:i + TOGETHER]) for i in range(0, len(part), TOGETHER)]
            self._remember(part, np.array(list(chain.from_iterable(
                e.ids for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False))), np.uint32))

    def _remember(self, part: list[str], ids: np.ndarray) -> None:
        """Take the ids of all pieces of ``part``, encoded in a row, apart."""
        ends = np.cumsum(self.n_bytes[ids])
        whole = "".join(part).encode()
        wanted = np.append(np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)[1:], len(whole))
        last = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[last], wanted):
            raise ValueError("a token runs across two pieces; the vocabulary isn't byte-level")
        stops = 4 * (last + 1)
        self.known.update(zip(part, map(ids.tobytes().__getitem__, map(
            slice, np.append(0, stops[:-1]).tolist(), stops.tolist()))))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a task and vocabulary: functions travel by value, so a later task of the same
    worker has a memory of its own."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget() -> None:
    """The encoders of this task go, before its worker takes the next one."""
    _encoders.clear()


def slices(items: list[str], most_chars: int = 4_000_000):
    """Consecutive slices of at most ``most_chars`` characters, one text at least."""
    out, chars = [], 0
    for t in items:
        if out and chars + len(t) > most_chars:
            yield out
            out, chars = [], 0
        out.append(t)
        chars += len(t)
    if out:
        yield out
