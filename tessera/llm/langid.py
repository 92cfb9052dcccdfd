"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads fixed windows of UTF-8 bytes in both directions, gives a probability of each
language at every byte, and a document's probabilities are the mean over all its bytes. It is
trained in numpy by backpropagation through time on a bounded sample of labelled rows
(``DOCS_PER_LANG`` documents a language at most on average, ``WINDOWS_PER_DOC`` windows of each);
prediction covers every byte of every text and looks at nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the
language first in sorted order; without any labelled row every text is ``und``; repeated rows get
equal results; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import portions, table

#: Bounds of the training sample, and the shape of the network.
DOCS_PER_LANG, WINDOWS_PER_DOC = 400, 8
WINDOW, HIDDEN, STEPS, BATCH, SEED = 48, 8, 220, 384, 7
#: Windows that prediction runs side by side; bounds a worker's memory.
SIDE_BY_SIDE = 2048
UNKNOWN = "und"


def _squash(x: np.ndarray) -> np.ndarray:
    """The softsign x / (1 + |x|): shaped like tanh at a fraction of its cost; its slope is (1 - |y|)^2."""
    return x / (1 + np.abs(x))


class ByteBiGru:
    """Parameters, training and position-wise prediction of the network."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, window: int = WINDOW, seed: int = SEED):
        self.langs, self.hidden, self.window = langs, hidden, window
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {"bias": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.4, (256, 3 * hidden)).astype(np.float32)
            self.p["U" + d] = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(hidden, np.float32)
            self.p["W" + d] = rng.normal(0, 0.3, (hidden, len(langs))).astype(np.float32)

    # -- training --------------------------------------------------------------------------------

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States after every byte of windows x (time, batch), read forwards (f) or backwards (b)."""
        k = self.hidden
        emb, rec, c = self.p["E" + d][x], self.p["U" + d], self.p["c" + d]
        h, out, kept = np.zeros((x.shape[1], k), np.float32), np.empty((*x.shape, k), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = h @ rec
            zr = 0.5 * _squash(emb[t, :, : 2 * k] + g[:, : 2 * k]) + 0.5
            z, r, gn = zr[:, :k], zr[:, k:], g[:, 2 * k :] + c
            n = _squash(emb[t, :, 2 * k :] + r * gn)
            kept.append((t, h, z, r, gn, n))
            out[t] = h = n + z * (h - n)
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, d_out: np.ndarray, grads: dict) -> None:
        """Backpropagation through time of one direction; adds to grads."""
        k, rec = self.hidden, self.p["U" + d]
        d_emb = np.empty((*x.shape, 3 * k), np.float32)
        d_rec, d_c, dh = np.zeros_like(rec), np.zeros(k, np.float32), np.zeros_like(kept[0][1])
        for t, h, z, r, gn, n in reversed(kept):
            dh = dh + d_out[t]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            de = d_emb[t]
            de[:, :k] = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            de[:, k : 2 * k] = dn * gn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            de[:, 2 * k :] = dn
            dg = de.copy()
            dg[:, 2 * k :] *= r
            d_rec += h.T @ dg
            d_c += dg[:, 2 * k :].sum(0)
            dh = dh * z + dg @ rec.T
        flat, idx = d_emb.reshape(-1, 3 * k), x.ravel()
        grads["E" + d] = np.stack([np.bincount(idx, weights=flat[:, j], minlength=256) for j in range(3 * k)], 1).astype(np.float32)
        grads["U" + d], grads["c" + d] = d_rec, d_c

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> ByteBiGru:
        """Adam on the cross-entropy of every byte; windows (n, window) uint8 with 0 as padding; classes weigh alike."""
        rng = np.random.default_rng(seed)
        weigh = (len(labels) / np.maximum(1, np.bincount(labels, minlength=len(self.langs))) / len(self.langs)).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            x, y = np.ascontiguousarray(windows[pick].T), labels[pick]
            (hf, kf), (hb, kb) = self._run(x, "f"), self._run(x, "b")
            p = self._softmax(hf @ self.p["Wf"] + hb @ self.p["Wb"] + self.p["bias"])
            p[:, np.arange(batch), y] -= 1
            p *= ((x > 0) * weigh[y] / x.size)[:, :, None].astype(np.float32)
            flat, grads = p.reshape(-1, p.shape[2]), {"bias": p.sum((0, 1))}
            for d, h, kept in (("f", hf, kf), ("b", hb, kb)):
                grads["W" + d] = h.reshape(-1, self.hidden).T @ flat
                self._back(x, d, kept, p @ self.p["W" + d].T, grads)
            rate = 0.02 * min(1.0, 2.0 * (1 - (step - 1) / steps))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(-1, keepdims=True))
        x /= x.sum(-1, keepdims=True)
        return x

    # -- prediction ------------------------------------------------------------------------------

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, batch, language) at every byte of windows x (time, batch).

        Gates are kept in separate contiguous arrays, so each step is a handful of passes over small
        arrays that stay in the cache.
        """
        k, b = self.hidden, x.shape[1]
        score = np.empty((*x.shape, len(self.langs)), np.float32)
        score[:] = self.p["bias"]
        g, z, r, n, h = (np.empty((b, k), np.float32) for _ in range(5))
        for d in "fb":
            emb, rec, c = self.p["E" + d], self.p["U" + d], self.p["c" + d]
            ez, er, en = (np.ascontiguousarray(emb[:, i * k : (i + 1) * k]) for i in range(3))
            uz, ur, un = (np.ascontiguousarray(rec[:, i * k : (i + 1) * k]) for i in range(3))
            w = self.p["W" + d]
            un, c = un * 0.5, c * 0.5  # the reset gate below is left doubled
            h[:] = 0
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                row = x[t]
                for e, u, gate, scale in ((ez, uz, z, True), (er, ur, r, False)):
                    np.take(e, row, axis=0, out=gate, mode="clip")
                    np.matmul(h, u, out=g)
                    gate += g
                    np.abs(gate, out=g)
                    g += 1
                    gate /= g
                    gate += 1
                    if scale:
                        gate *= 0.5
                np.take(en, row, axis=0, out=n, mode="clip")
                np.matmul(h, un, out=g)
                g += c
                g *= r
                n += g
                np.abs(n, out=g)
                g += 1
                n /= g
                h -= n
                h *= z
                h += n
                score[t] += h @ w
        score -= score.max(2, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(2, keepdims=True)
        return score

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text (zeros for an empty one)."""
        total = np.zeros((len(texts), len(self.langs)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pads = -sizes % self.window
        owner = np.repeat(np.arange(len(texts)), (sizes + pads) // self.window)
        joined = np.frombuffer(b"".join(t + b"\0" * p for t, p in zip(texts, pads.tolist(), strict=True)), np.uint8).reshape(-1, self.window)
        for i in range(0, len(joined), SIDE_BY_SIDE):
            part = joined[i : i + SIDE_BY_SIDE]
            x = np.ascontiguousarray(part.T)
            p = self.positions(x)
            if not part.all():
                p *= (x > 0)[:, :, None]
            p = p.sum(0)
            np.add.at(total, owner[i : i + SIDE_BY_SIDE], p)
        kept = np.array([len(t) - t.count(0) for t in texts])
        return total / np.maximum(1, kept)[:, None]


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC, **fit) -> ByteBiGru | None:
    """Fit on a bounded sample of labelled rows that are not held out; None if there are none.

    A row is drawn by a hash of its id, at a rate that gives each language about ``docs_per_lang``
    rows; of each drawn text, windows at hashed places of the whole text are read.
    """
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~F.coalesce(held_out("i"), F.lit(False)))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    rate = F.lit(0.0)
    for lang in langs:
        rate = F.when(F.col("l") == lang, F.lit(min(1.0, docs_per_lang / counts[lang]))).otherwise(rate)
    dice = F.pmod(F.xxhash64("i", F.lit(17)), F.lit(1 << 62))
    drawn = rows.where((dice.cast("double") < rate * float(1 << 62)) & F.col("t").rlike(r"\p{L}")).withColumn("dice", F.xxhash64("i"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("dice", "i"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= 2 * docs_per_lang)  # each language's own bound
    spare = F.greatest(F.lit(1), F.length("t") - WINDOW + 1)
    cut = F.array(*[F.substring(F.col("t"), (F.pmod(F.xxhash64("i", F.lit(k)), spare) + 1).cast("int"), F.lit(WINDOW)) for k in range(windows_per_doc)])
    windows, labels = [], []
    for r in drawn.select("dice", "i", "l", F.array_distinct(cut).alias("w")).orderBy("dice", "i").collect():
        for w in r.w:
            windows.append(w.encode("utf-8")[:WINDOW].ljust(WINDOW, b"\0"))
            labels.append(langs.index(r.l))
    if not windows:
        return None
    return ByteBiGru(langs).fit(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array(labels), **fit)


def predict(df: DataFrame, model: ByteBiGru | None, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """(id, lang_pred, score): the language with the highest pooled probability, and that probability.

    ``keep_rows``: all columns of ``df`` come first (whole rows pass through, no join is needed), but
    columns of ``df`` that are named lang_pred or score give way to the new ones.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in df.columns if c not in ("lang_pred", "score")] if keep_rows else [id_col]
    k = len(carried)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    # a text that is carried is not sent twice
    text_at = carried.index(text_col) if text_col in carried else k + 1
    own = df.select(*(F.col(f"`{c}`") for c in carried), letters, *([F.col(text_col).alias("_text")] if text_at > k else []))
    out = T.StructType([*own.schema[:k], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in portions(batch, text_at):
                n = part.num_rows
                langs, scores = [UNKNOWN] * n, [0.0] * n
                todo = [i for i, x in enumerate(part.column(k).to_pylist()) if x] if net is not None else []
                if todo:
                    texts = part.column(text_at)
                    p = net.pooled([texts[i].as_buffer().to_pybytes() for i in todo])
                    for i, best, s in zip(todo, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                        langs[i], scores[i] = net.langs[best], min(1.0, max(0.0, s))
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=out.names)

    return own.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
