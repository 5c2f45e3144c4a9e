"""Language identification with a byte convolutional network.

A small network reads fixed-length windows of UTF-8 bytes: byte embeddings, filters of several widths,
max pooling over the window and a softmax over the labels met in training.  It is trained in numpy on
the driver from a bounded sample of labelled texts and applied to every window of every whole text.

At inference the embedding and the filters collapse into lookup tables indexed by byte pairs, so a window costs
a few table reads and additions per byte and no matrix product.

Defined results
---------------
* null text, empty text or text without a letter: ``und`` with score 0;
* very long texts: all windows count, none is skipped;
* no labelled text to learn from: every text is ``und`` with score 0;
* very many labels: all are learned, each from fewer windows, at least one text of each; more than ``MOST_LABELS`` raise ``ValueError``;
* repeated rows and ties: each row is judged alone; equal probabilities go to the smaller label;
* extra columns pass through; an input column named like a result is replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common

UNDETERMINED = "und"

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
STRIDE = WINDOW - max(WIDTHS) + 1

#: Bounds of the training sample: texts of each label, windows of each text, and windows in all (256 bytes each), and the
#: labels that one network on the driver can have: every one of them is learned, more raise.
TEXTS_PER_LABEL = 1000
WINDOWS_PER_TEXT = 4
LEAST_STEPS = 300
MOST_LABELS = 20_000
MOST_WINDOWS = 200_000

_HAS_LETTER = r"\p{L}"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)


@dataclass
class ByteConvNet:
    """Weights of a trained network; ``labels`` are sorted."""

    labels: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fit(cls, windows: np.ndarray, targets: np.ndarray, labels: list[str], epochs: int = 3, batch: int = 128, rate: float = 4e-3, seed: int = 17, order: np.ndarray | None = None) -> ByteConvNet:
        """Adam on cross entropy; ``windows`` is (n, WINDOW) uint8, ``targets`` the label index of each.

        An epoch goes through the windows in ``order`` (places, repeated where a window counts more than once), shuffled.  Few
        windows are gone through more often, so that there are ``LEAST_STEPS`` steps.
        """
        order = np.arange(len(windows)) if order is None else order
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(len(order), 1)))
        rng = np.random.default_rng(seed)
        f32 = np.float32
        params = {"E": rng.normal(0, 0.5, (256, EMBEDDING)).astype(f32), "O": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(f32), "c": np.zeros(len(labels), f32)}
        for w in WIDTHS:
            params[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)).astype(f32)
            params[f"b{w}"] = np.zeros(FILTERS, f32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
        bytes_in = _LOWER[windows]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(order[rng.permutation(len(order))], max(1, len(order) // batch)):
                x, y = bytes_in[rows], targets[rows]
                emb = params["E"][x]
                lane = np.arange(len(rows))[:, None]
                pooled, places, columns = [], [], []
                for w in WIDTHS:
                    span = WINDOW - w + 1
                    cols = np.concatenate([emb[:, k : k + span] for k in range(w)], axis=2)
                    raw = cols @ params[f"W{w}"] + params[f"b{w}"]
                    place = raw.argmax(axis=1)
                    pooled.append(np.take_along_axis(raw, place[:, None, :], 1)[:, 0])
                    places.append(place)
                    columns.append(cols)
                top = np.concatenate(pooled, axis=1)
                act = np.maximum(top, 0)
                logits = act @ params["O"] + params["c"]
                prob = _softmax(logits)
                prob[np.arange(len(rows)), y] -= 1
                prob /= len(rows)
                grads = {k: np.zeros_like(v) for k, v in params.items()}
                grads["O"], grads["c"] = act.T @ prob, prob.sum(0)
                back = (prob @ params["O"].T) * (top > 0)
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    at = columns[i][lane, places[i]]
                    grads[f"W{w}"] = np.einsum("bf,bfk->kf", g, at)
                    grads[f"b{w}"] = g.sum(0)
                    to_emb = g[:, :, None] * params[f"W{w}"].T[None]
                    for k in range(w):
                        np.add.at(grads["E"], x[lane, places[i] + k], to_emb[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(labels, params["E"], [params[f"W{w}"] for w in WIDTHS], [params[f"b{w}"] for w in WIDTHS], params["O"], params["c"])

    def digest(self) -> bytes:
        return hashlib.blake2b(repr(self.labels).encode() + b"".join(x.tobytes() for x in (self.embedding, *self.filters, *self.filter_bias, self.out, self.out_bias))).digest()

    def tables(self) -> list[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]]:
        """Per width: (width, table of the first byte pair, table of what follows, bias)."""
        by_byte = self.embedding[_LOWER]
        out = []
        for w, weights, bias in zip(WIDTHS, self.filters, self.filter_bias, strict=True):
            single = [by_byte @ weights[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)]
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS).astype(np.float32)
            rest = None if w == 2 else single[2].astype(np.float32) if w == 3 else pair(single[2], single[3])
            out.append((w, pair(single[0], single[1]), rest, bias))
        return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, fill, owner) of the windows that together cover each text; an empty text has none."""
    lengths = np.diff(offsets)
    counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + nth * STRIDE
    return starts, np.minimum(WINDOW, offsets[owner + 1] - starts), owner


def window_bytes(data: np.ndarray, starts: np.ndarray, fill: np.ndarray) -> np.ndarray:
    lanes = np.arange(WINDOW)
    at = starts[:, None] + lanes
    np.minimum(at, max(len(data) - 1, 0), out=at)
    out = data[at]
    out[lanes >= fill[:, None]] = 0
    return out


class Predictor:
    """Applies a network to many texts at once; window probabilities are averaged, weighted by their bytes."""

    LANES = 256

    def __init__(self, net: ByteConvNet):
        self.net, self.tables = net, net.tables()

    def window_probabilities(self, block: np.ndarray) -> np.ndarray:
        pairs = (block[:, :-1].astype(np.intp) << 8) | block[:, 1:]
        pooled = []
        for width, head, tail, bias in self.tables:
            span = WINDOW - width + 1
            conv = np.take(head, pairs[:, :span], axis=0, mode="clip")
            if width == 3:
                conv += np.take(tail, block[:, 2:], axis=0, mode="clip")
            elif width == 4:
                conv += np.take(tail, pairs[:, 2 : 2 + span], axis=0, mode="clip")
            pooled.append(conv.max(axis=1) + bias)
        return _softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.net.out + self.net.out_bias)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label index, probability) of each text."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.net.labels)))
        for lo, hi in common.pieces(offsets):
            starts, fill, owner = windows_of(data, offsets[lo : hi + 1])
            for a in range(0, len(starts), self.LANES):
                s, f, o = starts[a : a + self.LANES], fill[a : a + self.LANES], owner[a : a + self.LANES]
                prob = self.window_probabilities(window_bytes(data, s, f)) * f[:, None]
                firsts = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
                total[lo + o[firsts]] += np.add.reduceat(prob, firsts, axis=0)
        mass = total.sum(axis=1)
        best = total.argmax(axis=1)
        return best, np.where(mass > 0, total[np.arange(n), best] / np.where(mass > 0, mass, 1), 0.0)


_PREDICTORS: dict[bytes, Predictor] = {}


def predictor_of(net: ByteConvNet) -> Predictor:
    """The predictor of a network; a worker process keeps the last one it used."""
    key = net.digest()
    if key not in _PREDICTORS:
        _PREDICTORS.clear()
        _PREDICTORS[key] = Predictor(net)
    return _PREDICTORS[key]


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", key_col: str = "doc_id", texts_per_label: int = TEXTS_PER_LABEL, windows_per_text: int = WINDOWS_PER_TEXT, most_windows: int = MOST_WINDOWS) -> ByteConvNet | None:
    """Fit a network on at most about ``1.3 * texts_per_label`` texts of each label, fewer if there would be more than about ``most_windows``.

    The sample is drawn by a hash of the key, and of each text ``windows_per_text`` windows are taken, evenly
    spaced over its whole length.  That bounds what reaches the driver whatever the size of the corpus.  The text drawn first of each label is always in.
    None if there is no labelled text with a letter.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(_HAS_LETTER))
    whole = 1 << 30
    # A row without a key is drawn by its text.
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.col(text_col)), F.lit("language sample")), F.lit(whole))
    first = F.min(F.when(F.col(text_col).rlike(_HAS_LETTER), draw)).alias("first")
    counts = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"), first).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels cannot be learned by one network")
    if not counts:
        return None
    texts_per_label = max(1, min(texts_per_label, int(most_windows / (1.3 * windows_per_text * len(counts)))))
    windows_per_text = max(1, min(windows_per_text, most_windows // len(counts)))
    # Below this a draw is in the sample: about the wanted number of texts, and the least draw of the label in any case.
    shares = [(r["label"], max(min(whole, int(1.2 * texts_per_label * whole / r["n"]) + 1), (r["first"] or 0) + 1)) for r in counts]
    names = [f"_{n}" for n in ("label", "below", "draw", "text")]
    below = F.broadcast(labelled.sparkSession.createDataFrame(shares, T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])))
    sample = rows.select(F.col(label_col).cast("string").alias(names[0]), draw.alias(names[2]), F.col(text_col).alias(names[3])).join(below, names[0]).where(F.col(names[2]) < F.col(names[1]))
    # Rows that repeat a key stand in the sample once, however many there are.
    sample = sample.groupBy(F.col(names[0]).alias("label"), F.col(names[2]).alias("draw")).agg(F.min(names[3]).alias("text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = common.text_buffers(batch.column(2))
        starts, fill, owner = windows_of(data, offsets)
        counts = np.bincount(owner, minlength=batch.num_rows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        take = (nth * windows_per_text) // counts[owner] != ((nth - 1) * windows_per_text) // counts[owner]
        starts, fill, owner = starts[take], fill[take], owner[take]
        block = window_bytes(data, starts, fill) if len(starts) else np.zeros((0, WINDOW), np.uint8)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(nth[take]), common.binary_array([x.tobytes() for x in block])], names=["label", "draw", "nth", "bytes"])

    drawn = common.map_arrow(sample, cut, T.StructType([T.StructField("label", T.StringType()), T.StructField("draw", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("bytes", T.BinaryType())])).toArrow()
    if not drawn.num_rows:
        return None
    drawn = drawn.sort_by([(n, "ascending") for n in ("label", "draw", "nth", "bytes")])
    labels = sorted(drawn["label"].unique().to_pylist())
    windows = common.text_buffers(drawn["bytes"])[0].reshape(-1, WINDOW)
    targets = pc.index_in(drawn["label"], pa.array(labels, drawn["label"].type)).to_numpy().astype(np.int64)
    # Labels met more often must not crowd out the others.
    most = max(np.bincount(targets))
    rows_of = [np.flatnonzero(targets == i) for i in range(len(labels))]
    balanced = np.concatenate([np.resize(r, most) for r in rows_of])
    return ByteConvNet.fit(windows, targets, labels, order=balanced)


def identify(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) for every row, from the text alone."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if net is None:
        return docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    flag = "_letter"
    while flag in docs.columns:
        flag += "_"
    flagged = docs.withColumn(flag, F.coalesce(F.col(text_col).rlike(_HAS_LETTER), F.lit(False)))
    schema = common.with_outputs(docs, fields)
    labels = net.labels

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        predictor = predictor_of(net)
        data, offsets = common.text_buffers(batch.column(batch.schema.get_field_index(text_col)))
        letters = batch.column(batch.schema.get_field_index(flag)).to_numpy(zero_copy_only=False).astype(bool)
        best, prob = predictor.predict(data, offsets)
        names = [labels[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
        out = common.append_columns(batch, ["lang_pred", "score"], [pa.array(names, pa.string()), pa.array(np.where(letters, prob, 0.0))])
        return out.drop_columns([flag])

    return common.map_arrow(flagged, kernel, schema)


def held_out(column: str = "doc_id") -> Column:
    """Documents that no prediction may be learned from."""
    return common.crc_bucket(column, 3) == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")
