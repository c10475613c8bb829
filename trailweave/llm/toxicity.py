"""A convolutional text classifier for toxicity, trained in numpy.

Words are embedded by hashing (the word and its first four and five letters, so
unseen inflections find their stem), filters of widths 1, 2 and 3 slide over the
embeddings, and the maximum of each filter over the whole text feeds a logistic
layer. Thresholds are calibrated by language on rows that training did not see;
the language comes from the words themselves, and the score is shifted so that
0.5 is the threshold of the text's language.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import constants, fold, lean, mix

BUCKETS, DIM, WIDTHS, FILTERS, CHUNK = 1 << 16, 8, (1, 2, 3), 8, 1 << 18
_BASE = constants(1, 23)[0]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * CHUNK + 8
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.cache
def _word_chars() -> np.ndarray:
    kinds = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), "S1")
    return np.isin(kinds, [b"L", b"M", b"N"])


def words_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In pieces: bucket triples of words (whole, first four, first five characters) and the text each belongs to.

    Words are runs of letters, marks and digits, in lower case. A piece holds
    about CHUNK characters; a longer text is cut before a word, so no word is
    split unless it alone is longer than that.
    """
    inside, (up, down) = _word_chars(), _powers()
    held: list[tuple[int, np.ndarray]] = []
    n = 0

    def pieces() -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat([i for i, _ in held], [len(x) for _, x in held])
        cp = np.concatenate([x for _, x in held])
        w = inside[cp]
        edge = np.diff(w.astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)])))
        code = lambda to: mix((total[to] - total[first]) * down[first])
        salt = constants(2, 29)
        out = np.stack([code(end), code(np.minimum(end, first + 4)) ^ salt[0], code(np.minimum(end, first + 5)) ^ salt[1]], 1)
        return (mix(out) % np.uint64(BUCKETS)).astype(np.int64), owner[first]

    space = np.array([32], np.uint32)
    for i, text in enumerate(texts):
        text = text.lower()
        lo = 0
        while lo < len(text):
            hi = min(len(text), lo + CHUNK)
            if hi < len(text):
                cut = max(text.rfind(" ", lo + 1, hi), text.rfind("\n", lo + 1, hi))
                hi = cut if cut > lo else hi
            held.append((i, np.concatenate((np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), "<u4"), space))))
            n, lo = n + hi - lo + 1, hi
            if n >= CHUNK:
                yield pieces()
                held, n = [], 0
    if held:
        yield pieces()


class TextCNN:
    """The network and its calibration."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embedding = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [r.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.out_bias = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.float32(0)
        self.languages: list[str] = []
        self.language_of = np.zeros((BUCKETS, 1), np.float32)
        self.shift = np.zeros(1)

    def _features(self, ids: np.ndarray, owner: np.ndarray, texts: int, where: bool = False, ahead: int = 0) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Maxima of all filters by text; with `where`, also the word at which each was reached, and the embeddings. At the last `ahead` words no filter starts."""
        e = self.embedding[ids].sum(1)
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        at = np.full(out.shape, -1, np.int64) if where else None
        for k, (w, f, b) in enumerate(zip(WIDTHS, self.filters, self.bias, strict=True)):
            a = e @ f[0] + b
            for j in range(1, w):
                within = (owner[j:] == owner[:-j])[:, None]
                a[:-j] += (e[j:] @ f[j]) * within
            a[len(a) - ahead :] = -np.inf
            here = slice(k * FILTERS, (k + 1) * FILTERS)
            out[owner[cuts], here] = np.maximum(np.maximum.reduceat(a, cuts, axis=0), 0)
            if where:
                for t, lo, hi in zip(owner[cuts], cuts, [*cuts[1:], len(owner)], strict=True):
                    best = a[lo:hi].argmax(0)
                    at[t, here] = np.where(a[lo + best, np.arange(FILTERS)] > 0, lo + best, -1)
        return out, at, e

    def _languages(self, ids: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        votes = np.zeros((texts, self.language_of.shape[1]))
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        votes[owner[cuts]] = np.add.reduceat(self.language_of[ids[:, 0]], cuts, axis=0)
        return votes

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits without the shift, and the index of each text's language.

        The last words of a piece wait for the next, so filters see phrases that a cut straddles.
        """
        top = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        votes = np.zeros((len(texts), self.language_of.shape[1]))
        wait, (ids, owner) = max(WIDTHS) - 1, (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        for new, whose in words_of(texts):
            if len(whose):
                votes += self._languages(new, whose, len(texts))
                ids, owner = np.concatenate((ids, new)), np.concatenate((owner, whose))
                if len(owner) > wait:
                    top = np.maximum(top, self._features(ids, owner, len(texts), ahead=wait)[0])
                    ids, owner = ids[-wait:], owner[-wait:]
        if len(owner):
            top = np.maximum(top, self._features(ids, owner, len(texts))[0])
        return top @ self.out + self.out_bias, votes.argmax(1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        logit, lang = self.raw([t or "" for t in texts])
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64) - self.shift[lang], -30, 30)))

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.05, seed: int = 7) -> None:
        docs: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
        for ids, owner in words_of(texts):
            for i in np.unique(owner):
                docs[i] = np.concatenate((docs[i], ids[owner == i])) if len(docs[i]) else ids[owner == i]
        seen = np.full((2, BUCKETS), 0.5)
        for d, label in zip(docs, y, strict=True):
            seen[int(label), np.unique(d)] += 1
        odds = np.log(seen[1] / max(1, (y == 1).sum())) - np.log(seen[0] / max(1, (y == 0).sum()))
        self.embedding[:, 0] = np.clip(odds, -2, 4) / 4
        params = [self.out, *self.filters, *self.bias]
        history = [np.full_like(p, 1e-3) for p in params]
        rows = np.full((BUCKETS, 1), 1e-2, np.float32)
        bias_history, r = 1e-3, np.random.default_rng(seed)
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for lo in range(0, len(order), batch):
                pick = [i for i in order[lo : lo + batch] if len(docs[i])]
                if not pick:
                    continue
                ids = np.concatenate([docs[i] for i in pick])
                owner = np.repeat(np.arange(len(pick)), [len(docs[i]) for i in pick])
                top, at, e = self._features(ids, owner, len(pick), where=True)
                logit = np.clip(top @ self.out + self.out_bias, -30, 30)
                slope = ((1 / (1 + np.exp(-logit)) - y[pick]) / len(pick)).astype(np.float32)
                back = slope[:, None] * self.out
                grads = [top.T @ slope]
                by_word = np.zeros_like(e)
                by_filter, by_bias = [], []
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    here = slice(k * FILTERS, (k + 1) * FILTERS)
                    t, c = np.nonzero(at[:, here] >= 0)
                    p, g = at[:, here][t, c], back[:, here][t, c]
                    gf, gb = np.zeros_like(f), np.zeros(FILTERS, np.float32)
                    np.add.at(gb, c, g)
                    for j in range(w):
                        ok = (p + j < len(owner)) & (owner[np.minimum(p + j, len(owner) - 1)] == t)
                        np.add.at(gf[j].T, c[ok], g[ok, None] * e[p[ok] + j])
                        np.add.at(by_word, p[ok] + j, g[ok, None] * f[j].T[c[ok]])
                    by_filter.append(gf)
                    by_bias.append(gb)
                for p, h, g in zip(params, history, [*grads, *by_filter, *by_bias], strict=True):
                    h += g * g
                    p -= rate * g / np.sqrt(h)
                bias_history += float(slope.sum()) ** 2
                self.out_bias -= np.float32(rate * slope.sum() / np.sqrt(bias_history))
                touched = np.flatnonzero(np.abs(by_word).sum(1))
                for j in range(3):
                    b, g = ids[touched, j], by_word[touched]
                    np.add.at(rows[:, 0], b, (g * g).mean(1))
                    np.subtract.at(self.embedding, b, rate * g / np.sqrt(rows[b]))

    def learn_languages(self, texts: list[str], langs: list[str]) -> None:
        """Naive Bayes over hashed words, to know a text's language without being told."""
        self.languages = sorted(set(langs))
        n = np.full((BUCKETS, len(self.languages)), 0.1)
        for ids, owner in words_of(texts):
            np.add.at(n, (ids[:, 0], np.array([self.languages.index(x) for x in langs])[owner]), 1)
        self.language_of = np.log(n / n.sum(0)).astype(np.float32)
        self.shift = np.zeros(len(self.languages))

    def calibrate(self, texts: list[str], y: np.ndarray, least: int = 20) -> None:
        """Shifts each language's logits so that 0 is its best threshold (by F1, the middle of the best gap); few rows use all rows'."""
        logit, lang = self.raw(texts)

        def best(v: np.ndarray, t: np.ndarray) -> float:
            order = np.argsort(-v, kind="stable")
            v, hits = v[order].astype(float), np.cumsum(t[order])
            f1 = 2 * hits / (np.arange(1, len(v) + 1) + t.sum())
            k = int(f1.argmax())
            return float((v[k] + v[k + 1]) / 2) if k + 1 < len(v) else float(v[k]) - 1

        if 0 < y.sum() < len(y):
            general = best(logit, y)
            self.shift[:] = general
            for k in range(len(self.shift)):
                own = lang == k
                if least <= y[own].sum() <= own.sum() - least:
                    self.shift[k] = best(logit[own], y[own])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_class: int = 2000, longest: int = 50_000) -> TextCNN:
    """A network from a bounded sample of labelled documents.

    Of each class about `per_class` labelled documents are taken by the hash of
    their id (texts of at most `longest` characters); every fourth is held back
    for calibration. Languages are learned from the same rows. Without rows of
    both classes every text gets a score under 0.5.
    """
    model = TextCNN()
    given = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    counts = {r.y: r["count"] for r in given.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        model.out[:], model.out_bias = 0, np.float32(-3)
        return model
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    picked = given.where(place < share)  # about 2 * per_class ids, so a broadcast has a bound
    joined = docs.where(F.length(text_col) <= longest).select(id_col, text_col, F.col(lang_col).alias("lang")).join(F.broadcast(picked), id_col)
    rows = sorted((r.place, r.y, r[text_col] or "", r.lang) for r in joined.select(place.alias("place"), "y", text_col, "lang").collect())
    texts, y = [r[2] for r in rows], np.array([r[1] for r in rows])
    if len(rows) == 0:
        model.out_bias = np.float32(-3)
        return model
    model.learn_languages(texts, [r[3] or "" for r in rows])
    back = np.arange(len(rows)) % 4 == 3
    model.fit([t for t, b in zip(texts, back, strict=True) if not b], y[~back])
    model.calibrate([t for t, b in zip(texts, back, strict=True) if b], y[back])
    return model


def score(docs: DataFrame, model: TextCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score, predicted.

    Only the text is looked at, whole whatever its length. A null text counts
    as empty, and an empty one gets the score of no evidence. Repeated rows and
    null ids are scored as they come; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                s = sent.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "id long, score double, predicted int")


def train_and_score(docs: DataFrame, labels: DataFrame, held_out: Callable = lambda: fold("doc_id", 5) == 0) -> DataFrame:
    """Trains on the labels that are not held out and scores all documents; adds held_out (false for a null id)."""
    out = F.coalesce(held_out(), F.lit(False))
    return score(docs, train(docs, labels.where(~out))).withColumnRenamed("id", "doc_id").withColumn("held_out", out)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that a network trained on labels rejects, every column kept; no shuffle."""
    sent, columns = docs.sparkSession.sparkContext.broadcast(train(docs, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                yield part.filter(pa.array(sent.value.score(part.column(columns).to_pylist()) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
