"""Language identification with interpolated Kneser-Ney character models.

One model of order 4 per language. The n-grams that any language has seen are
kept once per order as a sorted array of 64-bit hashes, each with the log
probabilities (interpolation included) of the languages that have seen it;
contexts likewise with their back-off weights. Each distinct n-gram of a piece
of text is looked up once, from the shortest order on. The
language of the lowest cross-entropy per character wins; a cross-entropy
beyond what held-back training texts of that language show is rejected.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import constants, fold, lean, mix

ORDER, SPACE, CHUNK = 4, 32, 1 << 20
_C = constants(ORDER, 11)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its symbol (letters and marks stand for themselves, all else for a space), and whether it is a letter."""
    kinds = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), "S1")
    letter = kinds == b"L"
    return np.where(letter | (kinds == b"M"), np.arange(0x110000), SPACE).astype(np.uint32), letter


def _symbols(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In pieces of about CHUNK characters: symbols, the text each belongs to (-1 for what is only context), and the texts with letters.

    White space is collapsed; each text begins after ORDER - 1 spaces, each further piece of a long text after the symbols before it.
    """
    symbol, letter = _letters()
    pad = np.full(ORDER - 1, SPACE, np.uint32)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    lettered = np.zeros(len(texts), bool)
    n = 0
    for i, text in enumerate(texts):
        before = pad
        for lo in range(0, len(text), CHUNK):
            cp = np.frombuffer(text[lo : lo + CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
            lettered[i] |= letter[cp].any()
            s = np.concatenate((before, symbol[cp]))
            keep = (s != SPACE) | np.concatenate(([True], s[:-1] != SPACE))
            keep[: len(before)] = True
            s = s[keep]
            owner = np.full(len(s), i, np.int64)
            owner[: len(before)] = -1
            held.append((s, owner))
            before = s[-(ORDER - 1) :]
            n += len(s)
            if n >= CHUNK:
                yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), lettered
                held, n = [], 0
    yield (np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), lettered) if held else (np.zeros(0, np.uint32), np.zeros(0, np.int64), lettered)


def _hashes(s: np.ndarray) -> list[np.ndarray]:
    """hashes[n][i]: of the n symbols that end at i; n up to ORDER."""
    out, total, wide = [np.zeros(len(s), np.uint64)], np.zeros(len(s), np.uint64), s.astype(np.uint64) + np.uint64(1)
    for n in range(ORDER):
        total[n:] += wide[: len(s) - n] * _C[n]
        out.append(mix(total + np.uint64(n)))
    return out


class SortedHashes:
    """A sorted array of hashes with a directory of their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(len(keys) + 1)))))
        self.first = np.searchsorted(keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int64)
        self.first = np.append(self.first, len(keys))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is absent."""
        top = (h >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.keys[at[live]] == h[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


class Sparse:
    """For each hash of a sorted array, values of the languages that have one."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        flat = np.concatenate([np.zeros(0, np.uint64), *keys])
        lang = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.lexsort((lang, flat))
        distinct, first = np.unique(flat[order], return_index=True)
        self.hashes = SortedHashes(distinct)
        self.ends = np.append(first, len(flat))
        self.lang = lang[order].astype(np.int32)
        self.value = np.concatenate([np.zeros(0), *values])[order].astype(np.float32)

    def entries(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row in h, language and value of every entry."""
        k = self.hashes.find(h)
        rows = np.flatnonzero(k >= 0)
        lo = self.ends[k[rows]]
        n = self.ends[k[rows] + 1] - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(rows, n), self.lang[at], self.value[at]


class CharModels:
    """Interpolated Kneser-Ney models of all languages over common arrays.

    Each n-gram and context has values for the languages that have seen it and
    no others, so the size is that of the texts, however many languages.
    """

    def __init__(self, texts: dict[str, list[str]], discount: float = 0.75, alphabet: int = 1 << 16):
        self.languages = sorted(texts)
        own = [self._one(texts[lang], discount, alphabet) for lang in self.languages]
        self.grams = [Sparse([m[n][0] for m in own], [m[n][1] for m in own]) for n in range(ORDER)]
        self.contexts = [Sparse([m[n][2] for m in own], [m[n][3] for m in own]) for n in range(ORDER)]
        self.base = np.full(len(own), -np.log(alphabet), np.float32)
        self.limits, self.sharpness = np.full(len(own), np.inf), 10.0

    @staticmethod
    def _one(texts: list[str], discount: float, alphabet: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By order: a language's n-grams with their log probabilities, and its contexts with the logs of their back-off weights."""
        pieces = list(_symbols(texts))
        s = np.concatenate([x for x, _, _ in pieces])
        own = np.flatnonzero(np.concatenate([o for _, o, _ in pieces]) >= 0)
        h = _hashes(s)
        counted = []
        for n in range(ORDER, 0, -1):
            _, at, count = np.unique(h[n][own], return_index=True, return_counts=True)
            at = own = own[at]  # each distinct n-gram counts once for the n-gram within it
            counted.append((h[n][at], h[n - 1][at], h[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64), count))
        out, keys, lower = [], np.zeros(1, np.uint64), np.full(1, 1 / alphabet)
        for n, (gram, inner, context, count) in enumerate(reversed(counted)):
            contexts, c = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(c, count, len(contexts)), np.bincount(c, minlength=len(contexts))
            back = discount * kinds / total
            lower = np.maximum(count - discount, 0) / total[c] + back[c] * lower[np.searchsorted(keys, inner) if n else np.zeros(len(gram), np.int64)]
            keys = gram
            out.append((gram, np.log(lower), contexts, np.log(back)))
        return out

    def _logp(self, h: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log probabilities of the symbols at `at` by language: from the shortest n-gram on, each order backs off or replaces."""
        out = np.tile(self.base, (len(at), 1))
        for n in range(ORDER):
            row, lang, back = self.contexts[n].entries(h[n][at - 1] if n else np.zeros(len(at), np.uint64))
            out[row, lang] += back
            row, lang, p = self.grams[n].entries(h[n + 1][at])
            out[row, lang] = p
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character by text and language, and whether each text has a letter."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        lettered = np.zeros(len(texts), bool)
        wide = max(1, (1 << 22) // max(len(self.languages), 1))  # rows at a time, so that there are about as many values at most
        for s, owner, has in _symbols(texts):
            lettered |= has
            at = np.flatnonzero(owner >= 0)
            if not len(at):
                continue
            h, who = _hashes(s), owner[at]
            # Each distinct n-gram is looked up once, and counts for a text as often as it occurs there.
            distinct, first, place = np.unique(h[ORDER][at], return_index=True, return_inverse=True)
            count += np.bincount(who, minlength=len(texts))
            for lo in range(0, len(distinct), wide):
                p = self._logp(h, at[first[lo : lo + wide]])
                here = np.flatnonzero((place >= lo) & (place < lo + wide)) if len(distinct) > wide else np.arange(len(at))
                for low in range(0, len(here), wide):
                    some = here[low : low + wide]
                    cuts = np.flatnonzero(np.diff(who[some], prepend=-1))
                    np.add.at(total, who[some][cuts], np.add.reduceat(p[place[some] - lo], cuts, axis=0, dtype=np.float64))
        return -total / np.maximum(count, 1)[:, None], lettered

    def calibrate(self, texts: list[str], langs: list[str], quantile: float = 0.999) -> None:
        """Sets the rejection limits and the sharpness of the scores from texts that were not counted."""
        if not texts:
            return
        e, _ = self.entropies(texts)
        truth = np.array([self.languages.index(x) for x in langs])
        for k in range(len(self.languages)):
            if (truth == k).any():
                self.limits[k] = 1.05 * np.quantile(e[truth == k, k], quantile)
        loss = {t: np.mean(np.log(np.exp(-t * (e - e.min(1, keepdims=True))).sum(1)) + t * (e[np.arange(len(e)), truth] - e.min(1))) for t in (2.0, 5.0, 10.0, 20.0, 50.0)}
        self.sharpness = min(loss, key=loss.__getitem__)

    def predict(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        if not self.languages:
            n = len(texts)
            return {"lang": np.full(n, "und", object), "score": np.zeros(n), "entropy": np.zeros(n), "rejected": np.ones(n, bool)}
        e, lettered = self.entropies([t or "" for t in texts])
        best = e.argmin(1)
        least = e[np.arange(len(e)), best]
        score = 1 / np.exp(-self.sharpness * (e - least[:, None])).sum(1)
        return {"lang": np.where(lettered, np.array(self.languages, object)[best], "und"), "score": np.where(lettered, score, 0.0), "entropy": np.where(lettered, least, 0.0), "rejected": ~lettered | (least > self.limits[best])}


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, chars: int = 1_000_000, total: int = 6_000_000, longest: int = 100_000) -> CharModels:
    """Models from a bounded sample of labelled rows.

    Of every label about `per_language` texts are taken by the hash of their
    id (at least about 20, or all there are), of each its first `longest`
    characters or a tenth of `chars`, up to `chars` characters in all or, with
    very many labels, an equal share of `total`; no more than about that, twice
    for rare labels, is collected, besides a row for each label. Every fifth
    text is held back for calibration.
    """
    piece = F.substring(text_col, 1, longest)
    rows = labelled.where(F.col(lang_col).isNotNull() & piece.rlike(r"\p{L}"))
    sizes = rows.groupBy(lang_col).agg(F.count("*").alias("n"), F.sum(F.length(piece)).alias("size")).collect()
    if not sizes:
        return CharModels({})
    chars = min(chars, max(total // len(sizes), 1000))
    piece = F.substring(text_col, 1, min(longest, chars // 10))
    shares = [(r[lang_col], min(1.0, max(20.0, min(float(per_language), 1.25 * chars * r["n"] / r["size"])) / r["n"])) for r in sizes]
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / (1 << 30)
    share = labelled.sparkSession.createDataFrame(shares, "label string, share double")
    drawn = rows.select(place.alias("place"), F.col(lang_col).alias("lang"), piece.alias("text")).join(F.broadcast(share), F.col("lang") == F.col("label")).where("place < share")
    sample = sorted((r.place, r.lang, r.text) for r in drawn.select("place", "lang", "text").collect())
    counted: dict[str, list[str]] = {}
    back: list[tuple[str, str]] = []
    used = dict.fromkeys((x for x, _ in shares), 0)
    for i, (_, lang, text) in enumerate(sample):
        if used[lang] < chars:
            used[lang] += len(text)
            if i % 5 == 4 and lang in counted:
                back.append((text, lang))
            else:
                counted.setdefault(lang, []).append(text)
    models = CharModels(counted)
    models.calibrate([t for t, _ in back], [x for _, x in back])
    return models


def identify(docs: DataFrame, models: CharModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score, cross_entropy, rejected.

    lang_pred is `und`, with score 0 and rejected, for a null text or one
    without a letter; any other text gets the nearest language, and rejected
    says that even that one is implausible. Only the text is looked at; texts
    of any length are scored whole. Ties go to the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part: Any = b.slice(lo, 1000)
                got = sent.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got["lang"], pa.string()), pa.array(got["score"]), pa.array(got["entropy"]), pa.array(got["rejected"])], names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def learn_and_identify(docs: DataFrame, held_out: Callable = lambda: fold("doc_id", 3) == 1) -> DataFrame:
    """Learns from the rows that are not held out and predicts all; adds held_out (false for a null id)."""
    out = F.coalesce(held_out(), F.lit(False))
    models = learn(docs.where(~out & F.col("doc_id").isNotNull()))
    return identify(docs, models).withColumnRenamed("id", "doc_id").withColumn("held_out", out)
