"""Exact cuts of texts for tokenizers, and a bounded memory of the pieces' tokens.

Public byte-level and sentence-piece vocabularies have no token that goes on after a blank, so a single blank between two
other characters starts a token in both. Texts are cut there; each distinct piece is encoded once a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain

_CUT = re.compile(r"(?<=\S)(?= \S)")


def cut_pieces(text: str) -> list[str]:
    """``text`` in pieces, all but the first beginning with the blank they were cut before. An empty text is one empty piece."""
    return _CUT.split(text)


def gather(starts, counts, pick):
    """Indexes of the runs ``pick`` of a flat array whose run i has ``counts[i]`` entries from ``starts[i]``, one run after the other; and their lengths."""
    import numpy as np

    n = counts[pick]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[pick] - (ends - n), n), n


class Memory:
    """Token ids of pieces. ``encode`` takes new pieces and returns one (counts, flat ids) for each kind of token.

    Once more than ``most`` pieces are held, all but those of the latest texts are forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[tuple]], most: int = 300_000):
        self.encode, self.most = encode, most
        self.at: dict[str, int] = {}
        self.kinds: list | None = None

    def look_up(self, texts: Sequence[list[str]]):
        """For each kind of token (ids of all texts in order, tokens of each text)."""
        import numpy as np

        flat = list(chain.from_iterable(texts))
        distinct = set(flat)
        if len(self.at) > self.most:
            self._keep(distinct)
        new = [p for p in distinct if p not in self.at]
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        if new or self.kinds is None:
            self._add(new)
        pick = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum([len(pieces) for pieces in texts], dtype=np.int64)
        out = []
        for starts, counts, ids in self.kinds:
            index, n = gather(starts, counts, pick)
            before = np.concatenate(([0], np.cumsum(n)))
            out.append((ids[index], np.diff(before[np.concatenate(([0], ends))])))
        return out

    def _keep(self, pieces: set[str]) -> None:
        import numpy as np

        kept = [p for p in pieces if p in self.at]
        pick = np.fromiter(map(self.at.__getitem__, kept), np.int64, len(kept))
        held = []
        for starts, counts, ids in self.kinds or []:
            index, n = gather(starts, counts, pick)
            held.append((np.cumsum(n) - n, n, ids[index]))
        self.at, self.kinds = {p: i for i, p in enumerate(kept)}, held

    def _add(self, new: list[str]) -> None:
        import numpy as np

        made = self.encode(new)
        if self.kinds is None:
            self.kinds = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(made)
        held = []
        for (starts, counts, ids), (n, more) in zip(self.kinds, made, strict=True):
            n = np.asarray(n, dtype=np.int64)
            held.append((np.concatenate((starts, len(ids) + np.cumsum(n) - n)), np.concatenate((counts, n)), np.concatenate((ids, np.asarray(more, dtype=np.int32)))))
        self.kinds = held
