"""Language identification by a small byte convolutional network, trained in numpy.

Filters of several widths slide over the bytes of a fixed-length window; each filter's
largest response in the window goes through a softmax layer. A filter of width w is
a table of w x 256 responses, so convolving is adding table rows, and two neighbouring
bytes share one row of a paired table at prediction. A text is cut into windows that
cover it whole; its prediction is the mean over the windows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, map_batches, measured, slices, store, struct, texts_of

#: Bytes of a window; widths of the filters and filters of each width.
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: The training sample: at most so many texts of each language, so many windows of each text.
LABEL_TEXTS, TEXT_WINDOWS = 1_500, 4
#: Texts of the training sample in all: with very many labels, each has fewer.
MOST_TEXTS = 60_000
UNKNOWN = "und"
_BATCH = 256


@dataclass(frozen=True)
class ByteNet:
    """Trained weights: per width a (width, 256, FILTERS) table and FILTERS biases; the dense layer."""

    labels: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    dense: np.ndarray
    dense_bias: np.ndarray

    @cached_property
    def key(self) -> str:
        return hashlib.sha1(b"".join(np.ascontiguousarray(x).tobytes() for x in (*self.tables, *self.biases, self.dense, self.dense_bias))).hexdigest()

    @cached_property
    def _pairs(self) -> list[list[np.ndarray]]:
        """Per width the tables of two neighbouring bytes, then that of a last single byte."""
        out = []
        for t in self.tables:
            steps = [(t[o][:, None, :] + t[o + 1][None, :, :]).reshape(65536, -1) for o in range(0, len(t) - 1, 2)]
            out.append(steps + ([t[-1]] if len(t) % 2 else []))
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, labels) for a uint8 array of windows."""
        single = windows.astype(np.intp)
        pair = single[:, :-1] * 256 + single[:, 1:]
        features = []
        for t, steps, bias in zip(self.tables, self._pairs, self.biases):
            n, total = windows.shape[1] - len(t) + 1, None
            for s, step in enumerate(steps):
                at = (pair if len(step) == 65536 else single)[:, 2 * s : 2 * s + n]
                got = np.take(step, at, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            features.append(np.maximum(total.max(axis=1) + bias, 0))
        # summed in one order, so that a window's result does not depend on its batch
        joined = np.concatenate(features, axis=1)
        return _softmax((joined[:, :, None] * self.dense[None]).sum(axis=1) + self.dense_bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """Windows that cover ``data``; the last is filled up with spaces."""
    count = max(1, -(-len(data) // size))
    return np.frombuffer(data.ljust(count * size, b" "), np.uint8).reshape(count, size)


def fit(windows: np.ndarray, marks: np.ndarray, labels: list[str], epochs: int = 12, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """Train on (n, WINDOW) windows and their label places by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    shapes = [(w, 256, FILTERS) for w in WIDTHS] + [(FILTERS,)] * len(WIDTHS) + [(FILTERS * len(WIDTHS), len(labels)), (len(labels),)]
    params = [(rng.normal(size=s) * (0.1 if len(s) > 1 else 0.0)).astype(np.float32) for s in shapes]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    k = len(WIDTHS)
    step, steps = 0, max(1, epochs * -(-len(windows) // _BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), _BATCH):
            some = order[lo : lo + _BATCH]
            x, y = windows[some].astype(np.intp), marks[some]
            rows = np.arange(len(some))
            pooled, places = [], []
            for i, w in enumerate(WIDTHS):
                n = x.shape[1] - w + 1
                total = sum(np.take(params[i][o], x[:, o : o + n], axis=0) for o in range(w))
                at = total.argmax(axis=1)
                places.append(at)
                pooled.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0] + params[k + i])
            raw = np.concatenate(pooled, axis=1)
            active = np.maximum(raw, 0)
            p = _softmax(active @ params[2 * k] + params[2 * k + 1])
            p[rows, y] -= 1
            p /= len(some)
            grads: list[np.ndarray] = [np.zeros_like(q) for q in params]
            grads[2 * k], grads[2 * k + 1] = active.T @ p, p.sum(0)
            back = (p @ params[2 * k].T) * (raw > 0)
            for i, w in enumerate(WIDTHS):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[k + i] = part.sum(0)
                for o in range(w):
                    byte = x[rows[:, None], places[i] + o]
                    np.add.at(grads[i][o], (byte, np.arange(FILTERS)[None, :]), part)
            step += 1
            pace = rate * (1 - step / (steps + 1))
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ByteNet(tuple(labels), tuple(params[:k]), tuple(params[k : 2 * k]), params[2 * k], params[2 * k + 1])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", per_label: int = LABEL_TEXTS, per_text: int = TEXT_WINDOWS, most: int = MOST_TEXTS) -> ByteNet | None:
    """A network trained on a bounded sample of the labelled rows; None where there are none.

    Of each label the ``per_label`` texts that come first by a hash of the text, or all if
    there are fewer, so reruns agree, copies count once and no label is lost; ``per_text``
    evenly spaced windows of each. There are at most ``most`` texts in all: where labels
    are so many, each has an equal share of them, and more labels than that are an error. So
    what is collected is at most most x per_text windows. Rows whose label is null or whose text is null or has no letter are not used.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("mark", F.xxhash64(F.lit(17), "text"))
    turn = F.row_number().over(Window.partitionBy("label").orderBy("mark"))  # cut to per_label before its shuffle, too
    picked = store(rows.select("label", "mark").distinct().withColumn("turn", turn).where(F.col("turn") <= per_label), "language-sample")
    if picked.count() > most:
        labels = picked.where("turn = 1").count()
        if labels > most:
            raise ValueError(f"{labels} labels are more than the {most} texts that a network is trained on")
        picked = picked.where(F.col("turn") <= most // labels)
    wanted = measured(picked.drop("turn"))
    schema = struct(label="string", mark="long", windows="array<binary>")

    def cut(batches):
        for whole in batches:
            for batch in slices(whole):
                out: dict[str, list] = {"label": batch.column("label").to_pylist(), "mark": batch.column("mark").to_pylist(), "windows": []}
                for text in texts_of(batch, "text"):
                    found = windows_of(text.encode())
                    out["windows"].append([found[i].tobytes() for i in sorted({int(x) for x in np.linspace(0, len(found) - 1, per_text)})])
                yield arrow_batch(schema, out)

    # copies of a picked text count once; they are combined before the shuffle
    once = rows.join(wanted, ["label", "mark"]).select("label", "mark", "text").mapInArrow(cut, schema).groupBy("label", "mark").agg(F.min("windows").alias("windows"))
    drawn = once.select("label", F.explode("windows").alias("window"))
    sample = sorted((r["label"], bytes(r["window"])) for r in drawn.collect())
    if not sample:
        return None
    labels = sorted({label for label, _ in sample})
    place = {label: i for i, label in enumerate(labels)}
    return fit(np.frombuffer(b"".join(w for _, w in sample), np.uint8).reshape(-1, WINDOW), np.array([place[label] for label, _ in sample]), labels)


_nets: dict[str, ByteNet] = {}


def predict(docs: DataFrame, net: ByteNet | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row of ``docs``.

    The prediction uses nothing but the whole text: the label of the highest mean
    probability over all its windows, and that mean. A text that is null or has no
    letter is ``und`` with score 0, as is every text where nothing could be learned.
    Ties go to the first label; repeated rows get the same; a column of ``keep`` named
    like an output is replaced by it; other columns aren't read; an empty table gives
    no rows. Narrow: no shuffle; windows of many texts are predicted together.
    """
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(c) for c in kept], F.col(text_col).alias("__text"))
    schema = struct(**{c: rows.schema[c].dataType for c in kept}, lang_pred="string", score="double")

    def run(batch):
        texts = texts_of(batch, "__text")
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if net is not None:
            model = _nets.setdefault(net.key, net)
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            cut = [windows_of(texts[i].encode()) for i in known]
            if cut:
                owner = np.repeat(np.arange(len(known)), [len(c) for c in cut])
                flat = np.concatenate(cut)
                total = np.zeros((len(known), len(model.labels)))
                for lo in range(0, len(flat), _BATCH):
                    np.add.at(total, owner[lo : lo + _BATCH], model.probabilities(flat[lo : lo + _BATCH]))
                mean = total / np.bincount(owner)[:, None]
                for i, row in zip(known, mean):
                    best = int(row.argmax())
                    labels[i], scores[i] = model.labels[best], min(1.0, float(row[best]))
        yield arrow_batch(schema, {c: batch.column(c) for c in kept} | {"lang_pred": labels, "score": scores})

    return map_batches(rows, run, schema)
