"""Language identification by error-correcting output codes (operator 2).

Each language has a codeword of bits. One binary logistic classifier per bit sees
hashed byte n-grams of a text's letters; decoding picks the codeword with the
least loss over the classifiers' margins, each weighted by how well its classifier
did in training, and flags texts where the runner-up is nearly as close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstride.llm.common import fresh, spread

UNKNOWN = "und"
FEATURES = 1 << 12
GRAMS = (1, 2, 3)
#: Training rows per language, and in all, at most: they bound what the driver fits on. All languages are learnt.
PER_LANGUAGE, ROWS = 400, 20_000
#: So many languages' counts are broadcast.
SMALL = 10_000
#: A text is ambiguous if the runner-up's probability is this share of the winner's.
NEAR = 0.9
LETTER = regex.compile(r"\p{L}").search
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
STEP = 1 << 20


def features(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of the lower-cased letters, damped and of unit length."""
    data = np.frombuffer(text.lower().encode().translate(TO_SPACE), np.uint8)
    counts = np.zeros(FEATURES, np.int64)
    for lo in range(0, len(data), STEP):  # very long texts in steps, overlapping by a gram
        part = data[lo : lo + STEP + max(GRAMS) - 1].astype(np.uint32)
        for n in GRAMS:
            size = min(STEP, len(part) - n + 1)
            if size < 1:
                continue
            h = np.full(size, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))
            for k in range(n):
                h = (h ^ part[k : k + size]) * np.uint32(0x01000193)
            counts += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=FEATURES)
    x = np.sqrt(counts)
    return (x / max(1.0, float(np.sqrt((x * x).sum())))).astype(np.float32)


def codewords(languages: int, bits: int = 15, seed: int = 7) -> np.ndarray:
    """+1/-1 codewords, a row per language, with the largest least distance of many random draws."""
    random, best, far = np.random.default_rng(seed), None, -1
    bits = max(bits, 4 * int(np.ceil(np.log2(max(2, languages)))) + 5)
    for _ in range(max(3, min(300, 100_000_000 // (languages * languages * bits)))):
        code = random.choice([-1, 1], (languages, bits))
        one_sided = np.abs(code.sum(0)) == languages
        code[0, one_sided] *= -1 if languages > 1 else 1
        distance = ((bits - code @ code.T) // 2 + bits * np.eye(languages, dtype=int)).min()
        if distance > far:
            best, far = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The probability of each language, a row per text."""
        margins = x @ self.weights + self.bias
        # the logistic loss of a bit that is -1 is that of one that is +1, and the margin
        loss = (np.logaddexp(0.0, -margins) @ self.trust)[:, None] + (margins * self.trust) @ ((1 - self.code) / 2).T
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def fit(x: np.ndarray, names: list[str], steps: int = 300) -> Model:
    """Train all bits' classifiers together by Adam on the logistic loss."""
    languages = sorted(set(names))
    number = {n: i for i, n in enumerate(languages)}
    label = np.array([number[n] for n in names], int)
    code = codewords(max(1, len(languages)))
    weights, bias = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    target = code[label].astype(np.float32)
    m, v, random = np.zeros_like(weights), np.zeros_like(weights), np.random.default_rng(1)
    for step in range(1, steps + 1 if len(names) else 1):
        at = random.integers(0, len(names), 256)
        margin = (x[at] @ weights + bias) * target[at]
        pull = -target[at] / (1 + np.exp(margin)) / len(at)
        grad = x[at].T @ pull + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        weights -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= 0.1 * pull.sum(0)
    right = ((x @ weights + bias) * target > 0).mean(0) if len(names) else np.ones(code.shape[1])
    return Model(languages, code, weights, bias, np.clip(2 * right - 1, 0.05, 1.0))


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "").astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["lang", "x"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, x binary")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` rows of each language, fewer if there are so many that this would exceed ``ROWS``.

    Rows with null language or without a letter are left out. With no rows, the
    model knows no language. The same table gives the same model however it is
    partitioned.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count()
    known = counts.count()
    if not known:
        return fit(np.zeros((0, FEATURES), np.float32), [])
    each = max(1, min(per_language, ROWS // known))
    counts = F.broadcast(counts) if known <= SMALL else counts  # of a checked size: texts are not shuffled for it
    sample = rows.join(counts, "lang").where(spread("language", "id", "text") < each / F.col("count")).limit(2 * each * known)
    found = sorted((r["lang"], bytes(r["x"])) for r in _featured(sample).collect())  # bounded by the two parameters, each row of fixed size
    return fit(np.array([np.frombuffer(x, np.float16) for _, x in found], np.float32).reshape(-1, FEATURES), [lang for lang, _ in found])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score`` and ``ambiguous``, for every row.

    Texts that are null or have no letter are ``und`` with score 0 and not
    ambiguous, as are all if the model knows no language. Existing columns of
    these three names are replaced. Repeated rows give repeated results.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        model = shared.value
        names, scores, near = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        todo = [i for i, t in enumerate(texts) if t is not None and LETTER(t)] if model.languages else []
        for lo in range(0, len(todo), 500):
            at = todo[lo : lo + 500]
            p = model.decode(np.array([features(texts.iloc[i]) for i in at]))
            order = np.argsort(-p, axis=1, kind="stable")
            for row, i in enumerate(at):
                names[i], scores[i] = model.languages[order[row, 0]], p[row, order[row, 0]]
                near[i] = p.shape[1] > 1 and p[row, order[row, 1]] >= NEAR * p[row, order[row, 0]]
        return pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": near})

    out = fresh(docs, "_language")
    return docs.withColumn(out, predict(F.col(text_col))).select(*docs.columns, *[F.col(out)[c].alias(c) for c in ("lang_pred", "score", "ambiguous")])
