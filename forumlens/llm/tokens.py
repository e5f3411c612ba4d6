"""Token ids of whole texts by a public tokenizer file, with each distinct unit encoded once per worker."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from forumlens.llm.batches import BYTE_KEYS, BYTE_POWERS, FOLD, SPACES, U64, mix, ragged, utf8

CACHED_UNITS = 200_000  # of one worker; beyond it the cache starts anew, results stay the same
SPACE, LETTER, OTHER, DIGIT = 0, 1, 2, 3
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[SPACES] = SPACE
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASSES[48:58] = DIGIT
APOSTROPHE = 39
# First letters of the endings that the tokenizer splits off together with their apostrophe.
ENDINGS = np.zeros(256, bool)
ENDINGS[[ord(c) for c in "stmdrlv"]] = True
_made: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts under a tokenizer that drops white space and never joins words.

    There a text's ids are those of its white-space words in a row, and a word's
    ids are those of its runs of letters, single digits and runs of other
    characters. Texts are cut into such units with numpy; each distinct unit is
    encoded once. Words in which that cut might differ from the tokenizer's own
    (an apostrophe before certain letters, characters outside ASCII that are not
    plainly letters) are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _add(self, keys: list[int], words: list[str], units: bool) -> None:
        # The tokenizer changes printable ASCII units in no way before its merges, so these go straight to them.
        plain = [w.isascii() and w.isprintable() for w in words] if units else [False] * len(words)
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
        merge = self.tokenizer.model.tokenize
        got = [[t.id for t in merge(w)] if p else next(rest).ids for w, p in zip(words, plain)]
        n, add = len(self.slots), np.fromiter(map(len, got), np.int64, len(got))
        values = np.fromiter((i for x in got for i in x), np.uint32, add.sum())
        while len(self.starts) < n + len(got):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while len(self.ids) < self.used + len(values):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[n : n + len(got)] = self.used + np.cumsum(add) - add
        self.lengths[n : n + len(got)] = add
        self.ids[self.used : self.used + len(values)] = values
        self.used += len(values)
        self.slots.update(zip(keys, range(n, n + len(got))))

    def _slots(self, data, starts, ends, keys, whole: bool) -> np.ndarray:
        """Slot of each unit; -1 for a unit that may not stand alone. New units are encoded."""
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        slot = list(map(self.slots.get, keys.tolist()))
        new = [i for i, s in enumerate(slot) if s is None]
        if new:
            raw = data.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
            fit = [whole or w.isascii() or (max(w) < "Ԁ" and w.isalpha() and w.lower().isalpha()) for w in words]
            found = keys[new].tolist()
            self._add([k for k, ok in zip(found, fit) if ok], [w for w, ok in zip(words, fit) if ok], not whole)
            for i, k in zip(new, found):
                slot[i] = self.slots.get(k, -1)
        return np.asarray(slot, np.int64)[back] if len(keys) else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids start (one more entry than texts)."""
        if len(self.slots) > CACHED_UNITS:
            self.clear()
        data, offsets = utf8(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        data = FOLD[data]
        kind = CLASSES[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge[0] = edge[-1] = True
        cut = edge.copy()
        cut[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        some = kind[starts] != SPACE
        starts, ends = starts[some], ends[some]
        up, down = BYTE_POWERS.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts])
        slots = self._slots(data, starts, ends, keys, False)
        # words that have to be encoded whole
        odd = np.flatnonzero(slots < 0)
        quote = np.flatnonzero((data[:-1] == APOSTROPHE) & ENDINGS[data[1:]])
        odd = np.concatenate([starts[odd], quote])
        if len(odd):
            space = (kind == SPACE).astype(bool)
            border = np.flatnonzero(np.concatenate([[True], space[:-1] != space[1:], [True]]) | edge)
            place = np.unique(np.searchsorted(border, odd, side="right") - 1)
            from_, to = border[place], border[place + 1]
            own = mix((sums[to] - sums[from_]) * down[from_]) ^ U64(0x5555555555555555)
            more = self._slots(data, from_, to, own, True)
            inside = np.searchsorted(from_, starts, side="right") - 1
            keep = (inside < 0) | (starts >= to[np.maximum(inside, 0)])
            starts, slots = np.concatenate([starts[keep], from_]), np.concatenate([slots[keep], more])
            order = np.argsort(starts, kind="stable")
            starts, slots = starts[order], slots[order]
        lengths = self.lengths[slots]
        ids = self.ids[ragged(self.starts[slots], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; kept between tasks."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
