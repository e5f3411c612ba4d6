"""Language identification with a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forumlens.llm.batches import FOLD, ragged, slices, utf8

UNKNOWN = "und"
WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
TRAIN_DOCUMENTS = 400  # of each language, at most
TRAIN_WINDOWS = 6  # of each of these documents
EPOCHS = 12
BATCH = 64
SLICE_BYTES = 1 << 17  # of text convolved at a time; bounds the feature maps
PAD = 0


class ByteNetwork:
    """Embedded bytes, filters of several widths, maximum over the window, softmax.

    A filter's value at a place is a sum over its bytes, so for use the embedding
    and the filters are multiplied out into tables from byte pairs (and single
    bytes) to filter values: the same network without matrix products by byte.
    """

    def __init__(self, labels: list[str], seed: int = 1):
        draw = np.random.default_rng(seed)
        self.labels = labels
        self.embed = draw.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        self.filters = {w: draw.normal(0, (w * EMBEDDED) ** -0.5, (w, EMBEDDED, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.out_bias, *self.filters.values(), *self.bias.values()]

    def fit(self, windows: np.ndarray, classes: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> ByteNetwork:
        """Adam on the mean cross-entropy, every class weighted alike."""
        draw = np.random.default_rng(seed)
        weights = (len(classes) / np.maximum(np.bincount(classes, minlength=len(self.labels)), 1) / len(self.labels))[classes]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self._parameters()]
        step = 0
        for epoch in range(epochs):
            order = draw.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                step += 1
                rate = 0.01 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, (m, v) in zip(self._parameters(), self._gradients(windows[rows], classes[rows], weights[rows]), state):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        n, rows = len(x), np.arange(len(x))[:, None]
        e = self.embed[x]
        peaks, pooled = {}, []
        for w in WIDTHS:
            span = np.concatenate([e[:, j : e.shape[1] - w + 1 + j] for j in range(w)], axis=2)
            value = span @ self.filters[w].reshape(w * EMBEDDED, FILTERS) + self.bias[w]
            peaks[w] = value.argmax(axis=1)
            pooled.append(np.take_along_axis(value, peaks[w][:, None], 1)[:, 0])
        z = np.concatenate(pooled, axis=1)
        hidden = np.maximum(z, 0)
        delta = softmax(hidden @ self.out + self.out_bias)
        delta[np.arange(n), y] -= 1
        delta *= (weights / n)[:, None].astype(np.float32)
        g_out, g_out_bias = hidden.T @ delta, delta.sum(0)
        back = (delta @ self.out.T) * (z > 0)
        g_embed = np.zeros_like(self.embed)
        g_filters, g_bias = [], []
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            g = np.empty_like(self.filters[w])
            for j in range(w):
                place = peaks[w] + j
                g[j] = np.einsum("nfe,nf->ef", e[rows, place], d)
                np.add.at(g_embed, x[rows, place], d[:, :, None] * self.filters[w][j].T[None])
            g_filters.append(g)
            g_bias.append(d.sum(0))
        return [g_embed, g_out, g_out_bias, *g_filters, *g_bias]

    def tables(self) -> dict:
        """The network for use: filter values by byte pair for the first two and next two bytes, or by byte."""
        made = {}
        for w in WIDTHS:
            single = [self.embed @ self.filters[w][j] for j in range(w)]
            parts = []
            for j in range(0, w - 1, 2):
                parts.append((j, True, (single[j][None, :, :] + single[j + 1][:, None, :]).reshape(65536, FILTERS)))
            if w % 2:
                parts.append((w - 1, False, single[-1]))
            made[w] = parts
        return {"labels": self.labels, "parts": made, "bias": self.bias, "out": self.out, "out_bias": self.out_bias}


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def window_logits(net: dict, data: np.ndarray) -> np.ndarray:
    """Outputs for windows in a matrix of bytes, one window a row."""
    pairs = data[:, :-1].astype(np.uint16) | (data[:, 1:].astype(np.uint16) << 8)
    pooled = []
    for w, parts in net["parts"].items():
        last = data.shape[1] - w + 1
        value = None
        for j, paired, made in parts:
            got = np.take(made, (pairs if paired else data)[:, j : j + last], axis=0)
            value = got if value is None else np.add(value, got, out=value)
        pooled.append(value.max(axis=1) + net["bias"][w])
    return np.maximum(np.concatenate(pooled, axis=1), 0) @ net["out"] + net["out_bias"]


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of the texts in windows of `WINDOW` bytes: their text, start and length; the last one of a text may be shorter."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + number * WINDOW
    return text, start, np.minimum(WINDOW, offsets[text + 1] - start)


def _matrix(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Windows as rows, filled up with `PAD`."""
    out = np.full((len(start), WINDOW), PAD, np.uint8)
    out[np.repeat(np.arange(len(start)), length), ragged(np.zeros(len(start), np.int64), length)] = data[ragged(start, length)]
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(net: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text: the mean of its windows' log-probabilities, by length."""
    data, offsets = utf8(texts)
    data = FOLD[data]
    text, start, length = cut_windows(data, offsets)
    total = np.zeros((len(texts), len(net["labels"])))
    step = max(1, SLICE_BYTES // WINDOW)
    for at in range(0, len(text), step):
        part = slice(at, at + step)
        logits = window_logits(net, _matrix(data, start[part], length[part]))
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        np.add.at(total, text[part], logits * length[part, None])
    mean = softmax(total / np.maximum(np.diff(offsets), 1)[:, None])
    known = np.array([_has_letter(t) for t in texts.to_pylist()], bool)
    best = mean.argmax(axis=1)
    labels = [net["labels"][b] if k else UNKNOWN for b, k in zip(best, known)]
    return labels, np.where(known, mean[np.arange(len(best)), best], 0.0)


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, documents: int, windows: int) -> DataFrame:
    """(lang, parts): for each language at most `documents` texts drawn by hash, `windows` stretches of each."""
    size = F.length(text_col)
    order = F.xxhash64(F.col(id_col), F.lit(9))
    places = [
        (F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(size - WINDOW, F.lit(1))) + 1).cast("int") for k in range(windows)
    ]
    parts = F.array(*(F.substring(F.col(text_col), p, F.lit(2 * WINDOW)) for p in places))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), order.alias("order"), parts.alias("parts")
    )
    # salted: the best of each (language, salt) first, then of these the best of each language
    salt = F.pmod(F.col("order"), F.lit(64))
    for by in ([F.col("lang"), salt], [F.col("lang")]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("order"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= documents).drop("rank")
    return rows.select("lang", "parts")


def train(
    labelled: DataFrame, id_col: str, text_col: str, lang_col: str,
    documents: int = TRAIN_DOCUMENTS, windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS,
) -> dict:
    """Fit the network to at most `documents` texts of each language that the labelled rows name.

    The number of languages times `documents` times `windows` windows of
    `WINDOW` bytes is what comes to the driver, whatever the size of the table.
    Rows with a null language or without a letter teach nothing; without any
    other row there is no language, and all texts are `und`.
    """
    rows = training_texts(labelled, id_col, text_col, lang_col, documents, windows).collect()
    rows.sort(key=lambda r: (r.lang, r.parts))
    labels = sorted({r.lang for r in rows})
    pieces = [(labels.index(r.lang), FOLD[np.frombuffer(p.encode()[:WINDOW], np.uint8)]) for r in rows for p in r.parts if p]
    net = ByteNetwork(labels)
    if pieces:
        data = np.full((len(pieces), WINDOW), PAD, np.uint8)
        for i, (_, p) in enumerate(pieces):
            data[i, : len(p)] = p
        net.fit(data, np.array([c for c, _ in pieces]), epochs)
    return net.tables()


def identify(docs: DataFrame, text_col: str, net: dict, prefix: str = "lang_") -> DataFrame:
    """Add `<prefix>pred` and `<prefix>score` (0 to 1) for every whole text.

    A null text or one without a letter is `und` with score 0, as is every text
    if the network has no language. All columns and rows stay.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = [f"{prefix}pred", f"{prefix}score"]
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col)
                labels, scores = predict(sent.value, texts) if sent.value["labels"] else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, *names]
                )

    return docs.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")
