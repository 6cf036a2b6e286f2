"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

The byte-level pre-tokenizer always ends a piece before a single space that stands between two
non-space characters, makes a lone line break a piece of its own, and ends a run of letters before
a run of punctuation. So a text may be cut there, its parts encoded apart and the ids joined: the
result equals encoding the text at once. Texts with other white space are cut only at single spaces
between non-space characters.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

END = b"\0\0\0\0"
#: White space other than lone spaces and lone line breaks between non-space characters.
_ODD = re.compile(r"[^\S \n]")
LONGEST = 200
REMEMBERED = 400_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Letters, then punctuation: two pieces, whatever stands before.
_TAIL = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")


def _is_odd(word: str) -> bool:
    return not word or _ODD.search(word) is not None


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes. One per worker process.

    Words of up to ``LONGEST`` characters are remembered in two generations of at most ``capacity``
    each, a batch aside: when the young one is full it becomes the old one, and what is used again
    moves back, so memory is bounded (by about 250 bytes a word).
    """

    def __init__(self, path: str, capacity: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity = capacity
        self.newline = self.plain("\n")
        self.joinable = len(self.newline) == 4
        #: By place: 0 at the start of a line, 1 after a space.
        self.young: list[dict[str, bytes]] = [{}, {}]
        self.old: list[dict[str, bytes]] = [{}, {}]
        self.passing: list[tuple[int, str]] = []  # longer words, for one batch

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[str], space: str) -> list[bytes]:
        """Ids of words without white space, each after ``space``: many to a line break-joined text,
        and many such texts to a call, as both cost less than words alone."""
        if not self.joinable:
            return [self.plain(space + w) for w in words]
        stop, out = int.from_bytes(self.newline, "little"), []
        parts = [words[at : at + 512] for at in range(0, len(words), 512)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["\n".join([space + w for w in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == stop)
            if len(cuts) != len(part) - 1:
                out += [self.plain(space + w) for w in part]
                continue
            raw, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
            out += [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]
        return out

    def _learn(self, words: set[str], place: int) -> None:
        if len(self.young[place]) > self.capacity:
            self.old[place], self.young[place] = self.young[place], {}
        young, old, space = self.young[place], self.old[place], " " if place else ""
        wanted, tails = [], []
        for w in words:
            if w in young:
                continue
            got = old.get(w)
            if got is not None:
                young[w] = got
            elif (m := _TAIL.fullmatch(w)) is not None:
                tails.append((w, m[1], m[2]))
            else:
                wanted.append(w)
        heads = {h for _, h, _ in tails if h not in young}
        for h in list(heads):
            if (got := old.get(h)) is not None:
                young[h] = got
                heads.discard(h)
        wanted = list({*wanted, *heads})
        for at in range(0, len(wanted), 1 << 14):
            part = wanted[at : at + (1 << 14)]
            young.update(zip(part, self._encode(part, space), strict=True))
        ends = {t for _, _, t in tails if t not in self.young[0]}
        for t in ends:
            self.young[0][t] = self.plain(t)
        for w, h, t in tails:
            young[w] = young[h] + self.young[0][t]
        self.passing += [(place, w) for w in wanted if len(w) > LONGEST]
        self.passing += [x for w, _, t in tails if len(w) > LONGEST for x in ((place, w), (0, t))]

    def many(self, texts: list[str]) -> list[bytes]:
        cut: list[list[list[str]]] = []
        firsts: set[str] = set()
        rest: set[str] = set()
        for t in texts:
            lines = [line.split(" ") for line in t.split("\n")] if t else []
            for line in lines:
                firsts.add(line[0])
                rest.update(line)
            cut.append(lines)
        # white space that isn't lone leaves an empty word, other white space stands in a word
        if "" in rest or _ODD.search("\n".join(rest)):
            cut = [[] if any(map(_is_odd, chain.from_iterable(lines))) else lines for lines in cut]
            firsts = {line[0] for lines in cut for line in lines}
            rest = set(chain.from_iterable(chain.from_iterable(cut)))
        # the first words of lines are learned after a space too: simpler, and most recur there
        self._learn(rest, 1)
        self._learn(firsts, 0)
        first, after, newline = self.young[0].__getitem__, self.young[1].__getitem__, self.newline
        out = [newline.join([first(line[0]) + b"".join(map(after, line[1:])) for line in lines]) if lines else self._odd(t) for t, lines in zip(texts, cut, strict=True)]
        for place, w in self.passing:
            self.young[place].pop(w, None)
        self.passing.clear()
        return out

    def _odd(self, text: str) -> bytes:
        """A text with other white space: pieces between safe spaces, encoded in groups of 64."""
        if not text:
            return b""
        parts = _SAFE.split(text)
        return b"".join(self.plain((" " if at else "") + " ".join(parts[at : at + 64])) for at in range(0, len(parts), 64))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, capacity: int = REMEMBERED) -> WordEncoder:
    """The worker process's encoder of this vocabulary file, bounded as asked last."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].capacity = capacity
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
