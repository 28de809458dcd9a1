"""Operator 5: language identification by hierarchical discrimination.

Features are hashed frequencies of byte n-grams (1 to 4) of the lower-cased text with every
ASCII character that is no letter taken as a blank. A first linear machine (one against the
rest) predicts the language family; within a family of several languages linear
support vector machines, one for each pair, vote by their margins.

Training takes texts and labels only, from about ``sample`` labelled training rows at most,
chosen by a hash of the id and shared evenly among the languages, so that a rare one is learned
from all its rows; all statistics of a machine come from that documented sample. Features are
counted where the rows are: the driver gets a vector of fixed size for each of them.
Prediction reads whole texts, a bounded stretch at a time, adds up each n-gram's weights and needs no shuffle; the model
has a fixed size whatever the corpus.

Nulls: a null text, or one without letters, is ``und`` with score 0. Rows without a label
train nothing and are predicted. Where no labelled row is left, all are ``und``. A null id
counts as the empty string in the fold. Repeated rows are predicted alike, and train once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import drawn
from grainmill.llm.pieces import frugal

#: Families of languages; fixed values. A language that is not listed is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}

UNKNOWN = "und"
BITS = 12
#: Languages that a model can tell apart, at most; more labels than that are no languages, and an error.
MAX_LANGUAGES = 500
#: Bytes that are looked at in one step.
STRETCH = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_SEEDS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def _keys(data: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams that end at each byte, for n from 1 to 4."""
    keys, h = [], np.zeros(len(data), np.uint32)
    for n, seed in enumerate(_SEEDS):
        shifted = np.zeros(len(data), np.uint32)
        shifted[n:] = data[: len(data) - n]
        h = (h ^ (shifted + np.uint32(17 * n + 1))) * seed
        keys.append((h >> np.uint32(32 - BITS)).astype(np.int64))
    return keys


def _folded(text: str) -> bytes:
    return PAD + text.lower().encode("utf-8", "replace") + b" "


#: Blanks before a text: as many as an n-gram reaches back, so that no text sees the one before it.
PAD = b" " * len(_SEEDS)


def _stretches(data: np.ndarray):
    """(start, stop, keys) of stretches of the bytes; keys of n-grams that end there."""
    for at in range(0, len(data), STRETCH):
        back = min(at, len(PAD))
        yield at, min(len(data), at + STRETCH), [k[back:] for k in _keys(_FOLD[data[at - back : at + STRETCH]])]


def features(texts: list[str]) -> np.ndarray:
    """Mean n-gram counts, a row for each text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(_folded(text), np.uint8)
        total = np.zeros(1 << BITS, np.int64)
        for at, _, keys in _stretches(data):
            for k in keys:
                total += np.bincount(k[max(0, len(PAD) - at) :], minlength=1 << BITS)
        out[i] = total / (len(data) - len(PAD))
    return out


def linear_machine(x: np.ndarray, y: np.ndarray, steps: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by accelerated gradient steps; y is -1 or 1, classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, for the step size
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1 / (2 * top + penalty)
    w = last = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        z = w + (k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ z))
        last, w = w, z - rate * (-2 * (x.T @ (weight * y * slack)) + penalty * z)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Weights of all machines side by side: first one for each family, then one for each pair."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        raw = [_folded(t) for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(size) - size
        starts, stops = first + len(PAD), first + size
        out = np.zeros((len(texts), self.weights.shape[1]))
        for at, stop, keys in _stretches(data):
            total = np.zeros((stop - at, self.weights.shape[1]), np.float32)
            for k in keys:
                total += self.weights[k]
            here = np.arange(np.searchsorted(stops, at, "right"), np.searchsorted(starts, stop))
            if len(here):
                # the PAD between two texts falls to neither: sums run from a text's start to its stop
                edges = np.stack([np.maximum(starts[here], at), np.minimum(stops[here], stop)], 1).ravel() - at
                sums = np.add.reduceat(np.vstack([total, np.zeros((1, total.shape[1]), np.float32)]), edges, axis=0, dtype=np.float64)[::2]
                out[here] += sums
        return out / (size - len(PAD))[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        s = self.scores(texts)
        sure = 1 / (1 + np.exp(-2 * np.clip(s, -15, 15)))
        n = len(self.families)
        family = s[:, :n].argmax(1)
        score = sure[np.arange(len(s)), family] if n > 1 else np.ones(len(s))
        lang = np.array([f[0] for f in self.families], object)[family]
        for f, members in enumerate(self.families):
            at = np.flatnonzero(family == f)
            if len(members) < 2 or not len(at):
                continue
            votes = np.zeros((len(at), len(members)))
            for p, (a, b) in enumerate(self.pairs):
                if a in members and b in members:
                    votes[:, members.index(a)] += sure[at, n + p]
                    votes[:, members.index(b)] += 1 - sure[at, n + p]
            votes /= len(members) - 1
            best = votes.argmax(1)
            lang[at] = np.array(members, object)[best]
            score[at] *= votes[np.arange(len(at)), best]
        return lang.tolist(), score


def train(texts: list[str], langs: list[str]) -> Model | None:
    """Fits all machines; languages in alphabetical order."""
    return fitted_model(features(texts), np.array(langs, object)) if texts else None


def fitted_model(x: np.ndarray, y: np.ndarray) -> Model:
    langs = y.tolist()
    kinds: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        kinds.setdefault(FAMILIES.get(lang, lang), []).append(lang)
    families = [kinds[k] for k in sorted(kinds)]
    pairs = [p for f in families for p in combinations(f, 2)]
    scale = 1 / (x.std(0) + 1e-4)
    mean = x.mean(0)
    z = (x - mean) * scale / np.sqrt(x.shape[1])
    fitted = [linear_machine(z, np.where(np.isin(y, f), 1, -1).astype(np.float32)) for f in families] if len(families) > 1 else [(np.zeros(x.shape[1], np.float32), 0.0)]
    for a, b in pairs:
        rows = (y == a) | (y == b)
        fitted.append(linear_machine(z[rows], np.where(y[rows] == a, 1, -1).astype(np.float32)))
    weights = np.stack([w * scale / np.sqrt(x.shape[1]) for w, _ in fitted], 1).astype(np.float32)
    bias = np.array([b for _, b in fitted]) - mean @ weights
    return Model(families, pairs, weights, bias)


def fold(doc_id: Column) -> Column:
    """The fold of a document, 0 to 2; fold 1 is held out."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 3


def training_rows(docs: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` labelled rows outside the held-out fold at most: of each language an even share, or all it has."""
    rows = docs.where(F.col("lang").isNotNull() & F.rlike("text", F.lit("\\p{L}")) & (fold(F.col("doc_id")) != 1))
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(many) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    share = sample / max(1, len(many))
    chosen = F.lit(False)
    for lang, n in many.items():
        chosen = chosen | ((F.col("lang") == lang) & drawn([F.col("doc_id")], "train", share / n))
    found = rows.where(chosen).select("doc_id", "lang", "text")
    # ids that repeat are drawn alike, so a row counts once however often it repeats
    key = F.struct(F.xxhash64("doc_id", "text"), "text")
    return found.groupBy("lang", "doc_id").agg(F.min_by("text", key).alias("text")).select("text", "lang")


def fit(docs: DataFrame, sample: int = 2000) -> Model | None:
    """The model of a training sample; None where no row can train."""

    def run(batches):
        for batch in batches:
            x = features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([np.flatnonzero(v).astype("<u2").tobytes() for v in x]), pa.array([v[v != 0].tobytes() for v in x]), batch.column(1)], names=["at", "value", "lang"])

    rows = training_rows(docs, sample).mapInArrow(frugal(run), "at binary, value binary, lang string").collect()  # bounded by ``sample``
    if not rows:
        if not docs.where(F.col("lang").isNotNull() & F.rlike("text", F.lit("\\p{L}")) & (fold(F.col("doc_id")) != 1)).isEmpty():
            raise RuntimeError("no row was drawn for training")
        return None
    rows.sort(key=lambda r: (r["lang"], r["at"], r["value"]))
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], np.float32)
    return fitted_model(x, np.array([r["lang"] for r in rows], object))


def _predictions(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, a bounded number of characters at a time."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
    at = 0
    while at < len(known):
        stop, size = at, 0
        while stop < len(known) and (stop == at or size + len(texts[known[stop]]) < 250_000):
            size += len(texts[known[stop]])
            stop += 1
        part = known[at:stop]
        got, s = model.predict([texts[i] for i in part])
        for i, g in zip(part, got):
            lang[i] = g
        score[part] = s
        at = stop
    return lang, score


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score)."""

    def run(batches):
        for batch in batches:
            lang, score = _predictions(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model | None, languages: Sequence[str] | None = None, least: float = 0.0) -> DataFrame:
    """The documents, as they are, whose predicted language is one of ``languages`` (None: any) with a score of ``least`` or more.

    A null lang becomes the predicted one. ``und`` always goes.
    """

    def run(batches):
        for batch in batches:
            lang, score = _predictions(batch.column(batch.schema.get_field_index("text")).to_pylist(), model)
            at = batch.schema.get_field_index("lang")
            told = pc.fill_null(batch.column(at), pa.array(lang, pa.string()).cast(batch.schema.field(at).type))
            fine = [x != UNKNOWN and (languages is None or x in languages) and s >= least for x, s in zip(lang, score)]
            yield batch.set_column(at, batch.schema.field(at), told).filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def identified(docs: DataFrame, sample: int = 2000) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score)."""
    rows = identify(docs, fit(docs, sample))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
