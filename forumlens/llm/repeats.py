"""Removal of word sequences that occur more than once in a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from forumlens.llm.batches import U64, Words, ragged, refuse_clash, split_words
from forumlens.llm.exchange import ASKED, among, answers, asked, number_of_parts, opened, to_blocks, with_answers

WINDOW = 35
PHRASE = 6


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` keys."""
    have, out = 1, keys
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - have :]) if width > have else out


def phrases(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the key of each window's phrase, and the keys of all phrases by word.

    A window's phrase is the one with the least key among the `phrase`-word runs
    inside it: equal windows have equal phrases at equal places.
    """
    n = len(words.keys)
    starts, keys = words.grams(phrase)
    every = np.full(n, np.iinfo(np.uint64).max, U64)
    every[starts] = keys
    ends = np.repeat(words.first[1:], words.counts())
    at = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(at):
        return at, np.zeros(0, U64), every
    return at, _least(every, window - phrase + 1)[at], every


def _phrases_of(block: int, words: Words, parts: int, window: int, phrase: int) -> pa.RecordBatch:
    _, chosen, every = phrases(words, window, phrase)
    chosen = np.unique(chosen)
    every = np.sort(every)
    times = np.searchsorted(every, chosen, side="right") - np.searchsorted(every, chosen)
    return asked(block, chosen, times > 1, parts)


def _line(words: Words) -> tuple[str, np.ndarray]:
    """All words, each with a space before and the last with one after it, as one Latin-1 string; where each word starts."""
    lengths = words.ends - words.starts + 1
    line = words.data[ragged(words.starts - 1, lengths)] if len(lengths) else np.zeros(0, np.uint8)
    starts = np.cumsum(lengths) - lengths + 1
    line[starts - 1] = 32
    return line.tobytes().decode("latin-1") + " ", starts


def located(words: Words, every: np.ndarray, compiled: np.ndarray, phrase: int) -> np.ndarray:
    """First words of all occurrences of some phrases in a block, by an automaton of their words.

    `compiled` are positions at which the phrases stand in the block.
    """
    if not len(compiled):
        return compiled
    line, starts = _line(words)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for i in compiled:
        end = starts[i + phrase] if i + phrase < len(starts) else len(line)
        automaton.add_word(line[starts[i] - 1 : end])
    automaton.make_automaton()
    ends = np.fromiter((end for end, _ in automaton.iter(line)), np.int64)
    first = np.searchsorted(starts, ends, side="left") - phrase  # the hit ends with the space after its last word
    inside = first + phrase <= np.repeat(words.first[1:], words.counts())[first]
    return first[inside]


def spans(words: Words, confirmed: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Starts of the repeated windows of a block, from where an automaton locates their phrases.

    A confirmed passage, a window's words, is compiled by its phrase and the
    phrase's place in the window; so each place where the phrase is located
    gives the spans that may be the passage, and the window's key confirms them.
    """
    at, chosen, every = phrases(words, window, phrase)
    if not len(at):
        return at
    _, keys = words.grams(window)  # in the order of `at`
    _, some = np.unique(keys, return_index=True)
    some = some[among(keys[some], confirmed)]
    width = window - phrase + 1
    offset = np.zeros(len(some), np.int64)
    for k in range(0, len(some), 4096):  # where each distinct passage has its phrase
        part = some[k : k + 4096]
        offset[k : k + 4096] = (every[at[part][:, None] + np.arange(width)] == chosen[part][:, None]).argmax(axis=1)
    _, first = np.unique(chosen[some], return_index=True)
    hits = located(words, every, (at[some] + offset)[first], phrase)
    pairs = np.unique(np.stack([chosen[some], offset.astype(U64)], axis=1), axis=0)
    low, high = (np.searchsorted(pairs[:, 0], every[hits], side) for side in ("left", "right"))
    begins = np.repeat(hits, high - low) - pairs[ragged(low, high - low), 1].astype(np.int64)
    place = np.minimum(np.searchsorted(at, begins), len(at) - 1)
    real = (at[place] == begins) & among(keys[place], confirmed)
    return np.unique(begins[real])


def _windows_of(block: int, words: Words, recurring: np.ndarray, parts: int, window: int, phrase: int):
    """Ask for every window whose phrase recurs."""
    at, chosen, _ = phrases(words, window, phrase)
    some = among(chosen, recurring)
    if some.any():
        _, keys = words.grams(window)  # in the order of `at`
        keys, times = np.unique(keys[some], return_counts=True)
        yield asked(block, keys, times > 1, parts)


def _kept(words: Words, covered: np.ndarray) -> pa.Array:
    """Words that are not covered, joined by one space, text by text."""
    keep = np.flatnonzero(~covered)
    at = np.searchsorted(keep, words.first)
    lengths = (words.ends - words.starts)[keep] + 1
    lengths[at[1:][np.diff(at) > 0] - 1] -= 1  # no space after a text's last word
    data = words.data[np.minimum(ragged(words.starts[keep], lengths), len(words.data) - 1)] if len(keep) else words.data[:0]
    ends = np.cumsum(lengths)
    full = lengths > (words.ends - words.starts)[keep]
    data[ends[full] - 1] = 32
    offsets = np.concatenate([[0], ends])[at].astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def remove_repeats(
    docs: DataFrame, text_col: str, window: int = WINDOW, phrase: int = PHRASE, prefix: str = "rep_"
) -> DataFrame:
    """Add `<prefix>kept`: the text without any word of a window that occurs more than once.

    A window is a run of `window` words (split at ASCII white space) of one
    document. Every occurrence of a repeated window is cut, the first too, and
    repetition is judged on the input. Three steps over blocks of documents:

    1. Each window names one phrase inside it, chosen by content. Phrases that
       recur in the corpus are found by exchanging their keys.
    2. Windows with such a phrase are confirmed as recurring passages in the
       same way, by their own keys.
    3. Each block compiles the confirmed passages that it can meet (its shard)
       into an Aho-Corasick automaton of their phrases and streams its
       documents through it. The spans located there are cut (`spans`).

    Keys have 64 bits, so a window is taken for another with a chance of about
    2**-64 for each pair of candidate windows. All shuffles carry packed keys and
    compressed blocks; a window that is in a third of all documents is sent once
    by each block.

    Adds `<prefix>n_words` and `<prefix>n_removed` as well. All columns stay, a
    null text has no words and an empty result, repeated rows are repeats of each
    other, and an empty table stays empty. Texts have any length: a block is one
    whole document at least. A column named like a result is refused.
    """
    refuse_clash(docs, [f"{prefix}{x}" for x in ("n_words", "n_removed", "kept")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    blocks = to_blocks(docs, text_col)
    parts = number_of_parts(blocks)

    def ask_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                words = split_words(opened(payload.as_py()).column(text_col))
                yield _phrases_of(block, words, parts, window, phrase)

    def ask_windows(block: int, rows: pa.RecordBatch, keys: np.ndarray):
        got = list(_windows_of(block, split_words(rows.column(text_col)), keys, parts, window, phrase))
        return got or [asked(block, np.zeros(0, U64), np.zeros(0, bool), parts)]

    def cut(block: int, rows: pa.RecordBatch, keys: np.ndarray):
        words = split_words(rows.column(text_col))
        at = spans(words, keys, window, phrase)
        change = np.zeros(len(words.keys) + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        covered = np.cumsum(change[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(covered)])
        more = [
            pa.array(words.counts(), pa.int64()),
            pa.array(np.diff(sums[words.first]), pa.int64()),
            _kept(words, covered),
        ]
        names = [f"{prefix}{x}" for x in ("n_words", "n_removed", "kept")]
        yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, *names])

    recurring = answers(blocks.mapInArrow(ask_phrases, ASKED))
    repeated = answers(with_answers(blocks, recurring, ask_windows, ASKED))
    return with_answers(
        blocks, repeated, cut,
        f"{schema}, `{prefix}n_words` long, `{prefix}n_removed` long, `{prefix}kept` string",
    )
