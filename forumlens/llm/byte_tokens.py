"""Token ids of whole texts under a byte-level tokenizer, each distinct unit encoded once per worker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from forumlens.llm.batches import BYTE_KEYS, BYTE_POWERS, SPACES, U64, mix, ragged, utf8
from forumlens.llm.tokens import Encoder

SPACE, LETTER, DIGIT, MARK, WIDE = 0, 1, 2, 3, 4
KIND = np.full(256, MARK, np.uint8)
KIND[128:] = WIDE
KIND[SPACES] = SPACE
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
BLANK, QUOTE = 0x20, 0x27
# First two bytes, or first and last, of the UTF-8 white space outside ASCII.
WIDE_SPACES = ((0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
CACHED_UNITS = 300_000  # of one worker; beyond it the half that was met least is forgotten, results stay the same
LETTERS_END = "\u0500"  # below it str.isalpha and the tokenizer agree on letters
# The tokenizer's names of bytes: printable ones are themselves, the others follow from 256 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_NAMES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
_made: dict[str, ByteEncoder] = {}


def unit_borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted positions at which the tokenizer's own first split has a border for certain.

    The tokenizer splits text into runs of letters, of digits, of other marks
    (each with one leading blank) and of white space before it merges bytes.
    Borders are taken between ASCII characters of different kinds, after a
    single line break or tab, and where white space begins; not behind an apostrophe (it
    may join letters), nor next to characters outside ASCII, but that a blank
    after such a character starts a unit unless that may be white space itself.
    What lies between two borders is encoded as a whole, so a missing border
    costs time only.
    """
    kind = KIND[data]
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, bool)
    solid = (before != WIDE) & (after != WIDE)
    cut[1:-1] = solid & (before != after) & (before != SPACE) & ~((data[:-1] == QUOTE) & (after == LETTER))
    alone = (before == SPACE) & (data[:-1] != BLANK) & (after != SPACE) & solid
    alone[1:] &= (before[:-1] != SPACE) & (before[:-1] != WIDE)
    cut[1:-1] |= alone
    begins = np.flatnonzero((before == WIDE) & (after == SPACE)) + 1
    two, three = data[np.maximum(begins - 2, 0)], data[np.maximum(begins - 3, 0)]
    doubtful = two == 0xC2
    for first, second in WIDE_SPACES:
        doubtful |= (three == first) & (two == second)
    cut[begins[~doubtful]] = True
    cut[offsets] = True
    cut[0] = cut[-1] = True
    return np.flatnonzero(cut)


class ByteEncoder(Encoder):
    """Ids of texts under a byte-level tokenizer; special strings are ordinary text."""

    def clear(self) -> None:
        super().clear()
        self.met = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the half of the units that was met most often."""
        n = len(self.slots)
        keep = np.sort(np.argpartition(-self.met[:n], n // 2)[: n // 2])
        keys = np.fromiter(self.slots, U64, n)[keep]
        lengths = self.lengths[keep]
        ids = self.ids[ragged(self.starts[keep], lengths)]
        self.clear()
        self.slots = dict(zip(keys.tolist(), range(len(keep))))
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.ids, self.used = ids, len(ids)

    def _ids(self, units: list[bytes]) -> list[list[int]]:
        """Words of one run of letters go straight to the merges, the rest through the whole tokenizer."""
        texts = [u.decode("utf-8", "replace") for u in units]
        word = [t.lstrip(" ").isalpha() and max(t) < LETTERS_END for t in texts]
        merge = self.tokenizer.model.tokenize
        rest = iter(self.tokenizer.encode_batch_fast([t for t, w in zip(texts, word) if not w], add_special_tokens=False))
        joined = b"\n".join(u for u, w in zip(units, word) if w).decode("latin-1").translate(BYTE_NAMES)
        named = iter(joined.split(chr(BYTE_NAMES[10])))
        return [[t.id for t in merge(next(named))] if w else next(rest).ids for w in word]

    def _slots(self, data, starts, ends, keys) -> np.ndarray:
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        slot = list(map(self.slots.get, keys.tolist()))
        new = [i for i, s in enumerate(slot) if s is None]
        if new:
            raw, n = data.tobytes(), len(self.slots)
            got = self._ids([raw[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            add = np.fromiter(map(len, got), np.int64, len(got))
            values = np.fromiter((i for x in got for i in x), np.uint32, add.sum())
            while len(self.starts) < n + len(got):
                self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
            while len(self.ids) < self.used + len(values):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(values)), np.uint32)])
            self.starts[n : n + len(got)] = self.used + np.cumsum(add) - add
            self.lengths[n : n + len(got)] = add
            self.ids[self.used : self.used + len(values)] = values
            self.used += len(values)
            self.slots.update(zip(keys[new].tolist(), range(n, n + len(got))))
            slot = [n + new_at if s is None else s for s, new_at in zip(slot, np.cumsum([s is None for s in slot]) - 1)]
        slots = np.asarray(slot, np.int64)[back]
        self.met = np.concatenate([self.met, np.zeros(len(self.starts) - len(self.met), np.int64)])
        self.met += np.bincount(slots, minlength=len(self.met))
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids start (one more entry than texts)."""
        if len(self.slots) > CACHED_UNITS:
            self._forget()
        data, offsets = utf8(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        at = unit_borders(data, offsets)
        starts, ends = at[:-1], at[1:]
        up, down = BYTE_POWERS.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts])
        slots = self._slots(data, starts, ends, keys)
        lengths = self.lengths[slots]
        ids = self.ids[ragged(self.starts[slots], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(starts, offsets)]


def byte_encoder(path: str) -> ByteEncoder:
    """The worker's encoder for a file; kept between tasks."""
    if path not in _made:
        _made[path] = ByteEncoder(path)
    return _made[path]
