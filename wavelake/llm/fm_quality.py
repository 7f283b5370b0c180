"""Document quality by a factorisation machine (Rendle, 2010).

Inputs are hashed words, structure statistics of the text and what its length says; the model has a weight and
a short vector for each, and pairs of inputs interact by the product of their vectors. A text is scored in time
linear in its distinct words with the sum-of-squares identity: the sum over pairs of <v_i, v_j> x_i x_j is half
of |sum v_i x_i|^2 - sum |v_i x_i|^2.

The model is fitted on a bounded sample of labelled rows (`sample`, a documented parameter): those with the
smallest seeded hash of doc_id, hence the same on every run. Its size is fixed by BUCKETS and RANK.

Defined results. A null text counts as empty; an empty text is scored from its structure alone and gets a score
like any other. Scores are between 0 and 1 and depend on nothing but the text. Texts are read whole. Repeated
rows are scored each. An empty table gives an empty result. Without labelled rows, or with rows of one label
only, every score is 0.5. Labels that are null or neither 0 nor 1, and label rows whose doc_id repeats with
different labels, count as they come; null doc_ids are never learned from. Other columns are ignored by
`scores` and returned by `keep_good`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import map_texts

BUCKETS, RANK = 1 << 14, 8
#: Labelled rows that are learned from at most.
SAMPLE = 3000
#: Documents that score less are rejected.
LEAST_SCORE = 0.3
FOLDS = 5
_WORDS: dict[str, int] = {}
_MARK = re.compile(r"[^\w\s]")
_NAMES = ["bias", "log_words", "log_chars", "word_length", "upper", "digit", "symbol", "odd_symbol", "end_marks", "bars", "distinct", "line_length", "repeated_lines", "short_text"]
STATS = len(_NAMES)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from learning: crc32 of doc_id as text, modulo FOLDS, is 0."""
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def inputs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's inputs: STATS statistics first, then hashed words."""
    words = text.split()
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    known = _WORDS
    ids = [known[w] if w in known else known.setdefault(w, STATS + xxhash.xxh32_intdigest(w.lower()) % BUCKETS) for w in words]
    at, n = np.unique(np.array(ids, np.int64), return_counts=True)
    chars, lines = max(1, len(text)), [x for x in text.split("\n") if x.strip()]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.bincount(np.minimum(codes, 128), minlength=129)
    upper, digit = count[65:91].sum(), count[48:58].sum()
    symbol = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    plain = count[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    stats = [
        1.0,
        np.log1p(len(words)) / 8,
        np.log1p(len(text)) / 10,
        min(len(text) / max(1, len(words)), 40) / 10,
        upper / chars * 4,
        digit / chars * 4,
        symbol / chars * 4,
        (symbol - plain) / chars * 10,
        count[33] / max(1, len(words)) * 2,
        count[124] / max(1, len(words)) * 2,
        len(at) / max(1, len(words)),
        min(len(text) / max(1, len(lines)), 1000) / 500,
        1 - len(set(lines)) / max(1, len(lines)),
        1.0 if len(words) < 5 else 0.0,
    ]
    values = np.log1p(n)
    norm = np.sqrt((values * values).sum()) or 1.0
    return np.concatenate([np.arange(STATS), at]), np.concatenate([np.array(stats, np.float64), values / norm])


@dataclass
class Machine:
    """A fitted model: linear weights w and one vector of RANK for each input."""

    w: np.ndarray
    v: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(0)
        return float(self.w[at] @ x + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.raw(*inputs(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.08, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Logistic loss by AdaGrad, one row at a time in a seeded order; classes weigh the same."""
    random = np.random.default_rng(seed)
    size = STATS + BUCKETS
    w, v = np.zeros(size), random.normal(0, 0.05, (size, RANK))
    v[:1] = 0
    machine = Machine(w, v)
    good = sum(y for _, _, y in rows)
    if not 0 < good < len(rows):
        return Machine(np.zeros(size), np.zeros((size, RANK)))
    weight = {1: len(rows) / (2 * good), 0: len(rows) / (2 * (len(rows) - good))}
    gw, gv = np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            at, x, y = rows[k]
            vx = v[at] * x[:, None]
            total = vx.sum(0)
            raw = w[at] @ x + 0.5 * (total @ total - (vx * vx).sum())
            slope = weight[y] * (1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - y)
            dw = slope * x + decay * w[at]
            dv = slope * x[:, None] * (total - vx) + decay * v[at]
            gw[at] += dw * dw
            gv[at] += dv * dv
            w[at] -= rate * dw / np.sqrt(gw[at])
            v[at] -= rate * dv / np.sqrt(gv[at])
    return machine


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Machine:
    """A model of labels.quality, from at most `sample` labelled texts outside the held-out fold.

    A doc_id that several rows of docs or of labels have gives a text for each pair of them. The order of all texts
    is fixed by doc_id, label and digest of the text, and so is which of them are taken; no more reach the driver.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole.alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [inputs(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "digest": b["digest"], "at": [a.astype(np.int32) for a, _ in rows], "x": [x.astype(np.float32) for _, x in rows]})

    made = texts.select("doc_id", "y", F.sha2("text", 256).alias("digest"), "text").mapInPandas(run, "doc_id bigint, y int, digest string, at array<int>, x array<float>")
    found = made.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "digest").limit(sample).toPandas().sort_values(["doc_id", "y", "digest"], kind="stable")
    return fit([(np.asarray(a, np.int64), np.asarray(x, np.float64), int(y)) for a, x, y in zip(found["at"], found["x"], found["y"], strict=True)])


def scores(docs: DataFrame, machine: Machine, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w.astype(np.float32), machine.v.astype(np.float32)))

    def run(keys: list, texts: list[str]) -> dict[str, list]:
        own = Machine(*shared.value)
        return {"doc_id": keys, "score": [own.score(t) for t in texts]}

    out = map_texts(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), "doc_id bigint, score double", run)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The documents that aren't rejected, with the columns of docs; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w.astype(np.float32), machine.v.astype(np.float32)))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = Machine(*shared.value)
        return pd.Series([own.score(t or "") for t in texts], dtype="float64")

    return docs.where(score(F.col(text)) >= LEAST_SCORE)
