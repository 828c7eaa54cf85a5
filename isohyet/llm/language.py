"""Language identification (5): a byte convolutional network, trained and applied in numpy.

A text is cut into windows of ``width`` bytes that cover it whole (the last one is padded).  Bytes have
embeddings; filters over 2, 3 and 4 neighbouring bytes slide over a window, the maximum of each
filter over the window goes through a softmax layer.  A filter is linear in the embeddings, so it is
applied as a sum of looked-up rows, one for each pair of bytes or byte it covers.  The
probabilities of a text are the mean over its windows, weighted by their bytes.

Training takes about ``sample`` labelled documents a language, by a hash of id and text, and all windows
of each.  The bound is a parameter of the fit alone: every whole text is predicted.  Languages are the values that are learnable at all (not held out, not null).

Null texts and texts without a letter are ``und`` with score 0, and so is every text when there is
nothing to learn from.  Rows that repeat are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.text import raw_texts, session_of

WIDTHS, EMBEDDED = (2, 3, 4), 8
OUT = "struct<lang_pred:string,score:double>"


@dataclass
class Network:
    """``embed`` 256 x EMBEDDED, a kernel (width, EMBEDDED, filters) for each of WIDTHS, and the softmax layer."""

    languages: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width its lookup tables: of pairs of bytes, and of the odd last byte."""
        out = []
        for kernel in self.kernels:
            single = [self.embed @ k for k in kernel]
            parts = [(a[:, None] + b[None]).reshape(65536, -1) for a, b in zip(single[::2], single[1::2], strict=False)]
            out.append([*parts, single[-1]] if len(single) % 2 else parts)
        return [[np.ascontiguousarray(t, np.float32) for t in parts] for parts in out]

    def pooled(self, windows: np.ndarray, tables) -> np.ndarray:
        """Maxima of all filters over windows (rows of bytes)."""
        places = np.ascontiguousarray(windows.T).astype(np.int64)  # a row a place: sums and maxima run along memory
        codes = places[:-1] << 8 | places[1:]
        out = []
        for kernel, parts in zip(self.kernels, tables, strict=True):
            n = len(places) - len(kernel) + 1
            total = np.take(parts[0], codes[:n], axis=0)
            for i, part in enumerate(parts[1:], 1):
                total += np.take(part, (codes if len(part) == 65536 else places)[2 * i: 2 * i + n], axis=0)
            out.append(total.max(0))
        return np.concatenate(out, 1)

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        return softmax(self.pooled(windows, tables) @ self.dense + self.bias)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def windows_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text of each and its bytes without padding."""
    counts = [max(1, -(-len(t) // width)) for t in texts]
    padded = b"".join(t.ljust(c * width, b"\0") for t, c in zip(texts, counts, strict=True))
    owner = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(owner), width)
    sizes[np.cumsum(counts) - 1] = [len(t) - (c - 1) * width for t, c in zip(texts, counts, strict=True)]
    return np.frombuffer(padded, np.uint8).reshape(-1, width), owner, np.maximum(sizes, 1)


def train(texts: list[bytes], langs: list[str], width: int, filters: int, epochs: int = 12, rate: float = 0.01) -> Network:
    """Adam on the cross entropy of windows; through the maximum only the position of each filter's maximum learns."""
    random = np.random.default_rng(11)
    names = sorted(set(langs))
    kernels = [random.normal(0, 0.4, (w, EMBEDDED, filters)) for w in WIDTHS]
    net = Network(names, random.normal(0, 0.4, (256, EMBEDDED)), kernels,
                  random.normal(0, 0.1, (filters * len(WIDTHS), len(names))), np.zeros(len(names)))
    windows, owner, _ = windows_of(texts, width)
    target = np.array([names.index(lang) for lang in langs])[owner]
    weight = 1 / np.bincount(target, minlength=len(names))[target]
    weight /= weight.mean()
    params = [net.embed, *net.kernels, net.dense, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for at in range(0, len(order), 128):
            rows = order[at:at + 128]
            x, y = windows[rows], target[rows]
            embedded = net.embed[x]
            pooled, where = [], []
            for kernel in net.kernels:
                n = width - len(kernel) + 1
                total = sum(embedded[:, j:j + n] @ k for j, k in enumerate(kernel))
                best = total.argmax(1)
                pooled.append(np.take_along_axis(total, best[:, None], 1)[:, 0])
                where.append(best)
            hidden = np.concatenate(pooled, 1)
            error = softmax(hidden @ net.dense + net.bias)
            error[np.arange(len(y)), y] -= 1
            error *= weight[rows][:, None] / len(y)
            back = np.split(error @ net.dense.T, len(WIDTHS), 1)
            grad_embed, grads = np.zeros_like(net.embed), []
            for kernel, best, g in zip(net.kernels, where, back, strict=True):
                grad = np.zeros_like(kernel)
                for j in range(len(kernel)):
                    used = np.take_along_axis(x, best + j, 1)  # the byte under each maximum
                    grad[j] = np.einsum("bfe,bf->ef", net.embed[used], g)
                    np.add.at(grad_embed, used, g[:, :, None] * kernel[j].T[None])
                grads.append(grad)
            step += 1
            for i, (p, g) in enumerate(zip(params, [grad_embed, *grads, hidden.T @ error, error.sum(0)], strict=True)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p -= rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(documents: DataFrame, sample: int = 400, width: int = 128, filters: int = 8) -> Network | None:
    """Learn ``lang`` from the texts of documents that are not held out; None where no row can be learnt from."""
    session_of(documents)
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
                         F.xxhash64("doc_id", "text").alias("order"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"]))])
    drawn = known.filter(F.pmod("order", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    rows = drawn.select("lang", "order", "text").orderBy("order", "lang", "text")
    table = rows.limit(2 * sample * len(counts)).toArrow()  # whole texts, about `sample` a language
    found = [(t, lang) for t, lang in zip(raw_texts(table.column("text")), table.column("lang").to_pylist(), strict=True)]
    return train([t for t, _ in found], [lang for _, lang in found], width, filters) if found else None


def predictor(documents: DataFrame, net: Network, width: int = 128):
    """A function of a text column to the most probable language and its probability."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    held = session_of(documents).sparkContext.broadcast(net)

    @F.arrow_udf(OUT)
    def predict(text: pa.Array) -> pa.Array:
        network = held.value
        tables = network.__dict__.get("_tables")
        if tables is None:
            tables = network.__dict__["_tables"] = network.tables()
        texts = [t or b"" for t in raw_texts(text)]
        out, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < 1 << 18):
                size += len(texts[stop])
                stop += 1
            out.append(_means(network, tables, texts[at:stop], width))
            at = stop
        mean = np.concatenate(out) if out else np.zeros((0, 1))
        best = mean.argmax(1)
        return pa.StructArray.from_arrays([pa.array([network.languages[i] for i in best], pa.string()),
                                           pa.array(mean[np.arange(len(best)), best], pa.float64())], fields=list(kind))

    return predict


def _means(network: Network, tables, texts: list[bytes], width: int, rows: int = 512) -> np.ndarray:
    windows, owner, sizes = windows_of(texts, width)
    probabilities = np.concatenate([network.probabilities(windows[i:i + rows], tables) for i in range(0, len(windows), rows)])
    total = np.zeros((len(texts), probabilities.shape[1]))
    np.add.at(total, owner, probabilities * sizes[:, None])
    return total / total.sum(1, keepdims=True)


def languages(documents: DataFrame, **fitting) -> DataFrame:
    """A row per document: ``doc_id, held_out, lang_pred, score``."""
    net = fit(documents, **fitting)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"), letters.alias("letters"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found = rows.withColumn("p", predictor(documents, net, fitting.get("width", 128))("text"))
    return found.select("doc_id", "held_out", F.when(F.col("letters"), F.col("p.lang_pred")).otherwise("und").alias("lang_pred"),
                        F.when(F.col("letters"), F.col("p.score")).otherwise(0.0).alias("score"))
