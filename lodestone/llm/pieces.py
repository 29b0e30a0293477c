"""Cutting text where a byte-level tokenizer always cuts it.

The pre-token pattern takes a space into the word after it, so a space that is
followed by a non-space starts a pre-token whatever stands around it. Texts can
be cut there, and each distinct piece has to be encoded only once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_CUT = re.compile(r" (?=\S)")


class Encoder:
    """Ids of whole texts as little-endian bytes, by way of a bounded store of known pieces.

    ``each`` encodes strings one by one. ``run`` encodes pieces without spaces, each
    with a space put before it, and may take them as one text. Once the store
    holds ``limit`` pieces, new ones are forgotten after use: that costs time, never rows.
    """

    def __init__(self, each: Callable[[list[str]], list[bytes]], run: Callable[[list[str]], list[bytes]], limit: int = 500_000):
        self.each, self.run, self.limit = each, run, limit
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """One byte string of little-endian unsigned 32-bit ids for each text."""
        cut = [t.split(" ") for t in texts]
        wanted = set().union(*(c[1:] for c in cut))
        new = wanted.difference(self.known)
        odd = {p for p in new if not p or p[0].isspace()}
        if odd:  # a run of white space: cut only before non-spaces, so that the run stays whole
            cut = [c if odd.isdisjoint(c[1:]) else _CUT.split(t) for c, t in zip(cut, texts)]
            wanted = set().union(*(c[1:] for c in cut))
            new = wanted.difference(self.known)
        plain = [p for p in new if " " not in p]
        spaced = [p for p in new if " " in p]
        firsts = list({c[0] for c in cut if c[0]})
        full = len(self.known) + len(new) > self.limit
        self.known.update(zip(plain, self.run(plain)))
        each = self.each([" " + p for p in spaced] + firsts)
        self.known.update(zip(spaced, each))
        first = dict(zip(firsts, each[len(spaced) :])) | {"": b""}
        get = self.known.__getitem__
        out = [first[c[0]] + b"".join(map(get, c[1:])) for c in cut]
        if full:  # the early, and so the frequent, pieces stay
            for p in new:
                del self.known[p]
        return out
