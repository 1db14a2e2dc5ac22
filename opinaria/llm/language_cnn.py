"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of fixed length, each filter's largest response in the window goes into a
softmax over the languages. The network is trained in numpy on windows of a bounded sample of labelled texts; it is applied to all windows of
every text, batch by batch, and a text's language is the one with the largest mean probability over its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opinaria.llm.common import HOT_SHARE, as_bytes
from opinaria.session import cut_lineage

UNKNOWN = "und"
DRAWS = 1 << 40
LETTER = re.compile(r"[^\W\d_]").search
WIDTHS = (2, 3, 4, 5)


def windows_of(text: bytes, length: int) -> np.ndarray:
    """All windows of a text, the last one padded with zero bytes."""
    data = np.frombuffer(text.lower(), np.uint8)
    count = -(-len(data) // length)
    out = np.zeros(count * length, np.uint8)
    out[: len(data)] = data
    return out.reshape(count, length)


class ByteCnn:
    """Embedding, filters of the given widths with ReLU, max pooling, softmax."""

    def __init__(self, languages: list[str], length: int = 128, dim: int = 8, filters: int = 12, seed: int = 5):
        self.languages, self.length, self.dim = languages, length, dim
        draw = np.random.default_rng(seed)
        widest, many = max(WIDTHS), filters * len(WIDTHS)
        self.embed = draw.normal(0, 0.5, (256, dim)).astype(np.float32)
        self.mask = np.repeat([np.arange(widest) < w for w in WIDTHS], filters, axis=0).T.astype(np.float32)  # (place, filter)
        self.mask = np.repeat(self.mask, dim, axis=0)
        self.conv = (draw.normal(0, 0.3, (widest * dim, many)) * self.mask).astype(np.float32)
        self.conv_bias = np.zeros(many, np.float32)
        self.out = draw.normal(0, 0.1, (many, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """(window, position, place * dim); zero bytes follow the window's end."""
        widest = max(WIDTHS)
        padded = np.concatenate([windows, np.zeros((len(windows), widest - 1), np.uint8)], axis=1)
        embedded = self.embed[padded]
        views = np.lib.stride_tricks.sliding_window_view(embedded, widest, axis=1)
        return np.ascontiguousarray(views.transpose(0, 1, 3, 2)).reshape(len(windows), self.length, -1)

    def _pooled(self, patches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        response = (patches.reshape(-1, patches.shape[2]) @ self.conv).reshape(len(patches), self.length, -1)
        best = response.argmax(axis=1)
        top = np.take_along_axis(response, best[:, None], 1)[:, 0] + self.conv_bias
        return np.maximum(top, 0), best

    def probabilities(self, windows: np.ndarray, batch: int = 256) -> np.ndarray:
        found = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), batch):
            patches = self._patches(windows[at : at + batch])
            response = (patches.reshape(-1, patches.shape[2]) @ self.conv).reshape(len(patches), self.length, -1).max(axis=1)
            z = np.maximum(response + self.conv_bias, 0) @ self.out + self.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            found[at : at + batch] = e / e.sum(axis=1, keepdims=True)
        return found

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; that of max pooling reaches only the winning position of each filter."""
        n = len(x)
        patches = self._patches(x)
        top, best = self._pooled(patches)
        z = top @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (top > 0)  # (window, filter)
        won = patches[np.arange(n)[:, None], best]  # (window, filter, place * dim)
        grads = {"out": top.T @ p, "out_bias": p.sum(axis=0), "conv_bias": back.sum(axis=0),
                 "conv": np.einsum("bf,bfk->kf", back, won) * self.mask}
        spread = back[:, :, None] * self.conv.T[None]
        embed = np.zeros_like(self.embed)
        padded = np.concatenate([x, np.zeros((n, max(WIDTHS) - 1), np.uint8)], axis=1)
        for place in range(max(WIDTHS)):
            np.add.at(embed, padded[np.arange(n)[:, None], best + place], spread[:, :, place * self.dim : (place + 1) * self.dim])
        grads["embed"] = embed
        return grads

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 6) -> None:
        """Adam on the cross-entropy."""
        names = ["embed", "conv", "conv_bias", "out", "out_bias"]
        first, second, t = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2)), None, 0
        first, second = first
        draw = np.random.default_rng(seed)
        for _ in range(epochs):
            order = draw.permutation(len(windows))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x, y = windows[some], labels[some]
                grads = self.gradients(x, y)
                t += 1
                for name in names:
                    g = grads[name]
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    step = rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - step).astype(np.float32))


def train(docs: DataFrame, learn: Column, per_language: int = 600, max_windows: int = 20_000, length: int = 128,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCnn | None:
    """Train on rows that satisfy ``learn`` and have a text with a letter and a language: of each language the ``per_language`` texts with
    the smallest hashes of their id, and of their windows at most ``max_windows``, the same share of each text. None without any."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), as_bytes(text_col).alias("text"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(DRAWS))
    # Of a language with over 1/1000 of the rows (fewer than a thousand are) hashes above a bound have no chance, so it does not send its rows to one task.
    counts = cut_lineage(rows.groupBy("lang").count())
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    bounds = counts.where(F.col("count") * HOT_SHARE > total).select("lang", ((1.2 * per_language + 200) / F.col("count") * DRAWS).alias("bound"))
    likely = rows.select("id", "lang").join(F.broadcast(bounds), "lang", "left").where(F.col("bound").isNull() | (drawn < F.col("bound")))
    order = Window.partitionBy("lang").orderBy(drawn, "id")
    ids = likely.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("id").distinct()
    sample = rows.join(F.broadcast(ids), "id", "left_semi").toArrow().sort_by([("lang", "ascending"), ("id", "ascending")])
    sample = [(lang, text) for lang, text in zip(sample["lang"].to_pylist(), sample["text"].to_pylist()) if LETTER(text.decode())]
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    parts = [windows_of(text, length) for _, text in sample]
    labels = np.repeat([languages.index(lang) for lang, _ in sample], [len(p) for p in parts])
    windows = np.concatenate(parts)
    if len(windows) > max_windows:
        kept = np.sort(np.random.default_rng(1).permutation(len(windows))[:max_windows])
        windows, labels = windows[kept], labels[kept]
    model = ByteCnn(languages, length)
    model.train(windows, labels)
    return model


def predict(docs: DataFrame, model: ByteCnn | None, text_col: str = "text", most_windows: int = 4096) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability of that language over the text's windows, weighted by their bytes.

    A null text, one without a letter, and every text when there is no model is ``und`` with score 0. All rows and columns stay; columns of
    ``docs`` with one of the new names are replaced. At most ``most_windows`` windows are held at a time, or one text.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source, at = docs.select(*kept), kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * batch.num_rows
            group, held = [], 0

            def judge() -> None:
                chances = net.probabilities(np.concatenate([w for _, w, _ in group]))
                first = 0
                for k, w, size in group:
                    weight = np.full(len(w), net.length, float)
                    weight[-1] = size - net.length * (len(w) - 1)
                    mean = weight @ chances[first : first + len(w)] / size
                    first += len(w)
                    best = int(mean.argmax())
                    found[k] = (net.languages[best], float(min(1.0, mean[best])))
                group.clear()

            for k, text in enumerate(batch.column(at).to_pylist()):
                if net is None or not text or not LETTER(text):
                    continue
                data = text.encode()
                windows = windows_of(data, net.length)
                group.append((k, windows, len(data)))
                held += len(windows)
                if held >= most_windows:
                    judge()
                    held = 0
            if group:
                judge()
            cells = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], names=[*kept, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), "lang_pred string, score double"])
    return source.mapInArrow(run, schema)
