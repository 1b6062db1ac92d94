"""Language identification by hierarchical discrimination.

The family of languages is predicted first, then the language within it. Both steps are
one-versus-one linear support vector machines over hashed byte trigrams of the whole text:
every pair of families, and every pair of languages of one family, has a machine; the
class that wins most duels (then the larger sum of margins) is the prediction.

Machines are fitted on the driver, from the trigram vectors of a sample of labelled rows
that is bounded by ``SAMPLE_ROWS`` (shared evenly by the languages, chosen by a hash of
id and text). Vectors have at most ``DIMENSIONS`` entries, however long the texts. Prediction is
one pass over the corpus without a shuffle.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and every
text if there is nothing to learn from. Rows without a label or without an id are not
learned from. A single language is always predicted, with the score of its duels (1 if
there are none). Repeated rows and ties are predicted alike: the prediction depends on the
text only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.llm.common import utf8

UNDETERMINED = "und"
DIMENSIONS = 1 << 14
SAMPLE_ROWS = 4_000
EPOCHS = 12
#: Weight of errors against the width of the margin.
COST = 10.0

# Languages by family. Others are a family each.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "es fr it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi ur bn mr gu pa ne",
    "semitic": "ar he mt am",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Lower-cases A-Z and blanks every other ASCII character that is no letter.
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
PREDICTION = "struct<lang: string, score: double>"
_PREDICTION = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def trigram_vector(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams of the text: a vector of length 1."""
    c = np.frombuffer(b" " + text.translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    code = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
    counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(18), minlength=DIMENSIONS)
    return np.sqrt(counts / max(1, len(code))).astype(np.float32)


Row = tuple[np.ndarray, np.ndarray]  # places that are not zero, and their values


def fit_machine(x: list[Row], y: list[float], epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights of a linear SVM (hinge loss, the last weight is the bias) by dual coordinate
    descent. Rows stay sparse, so the driver holds what the texts hold, not rows times dimensions."""
    squares = [float(value @ value) + 1 for _, value in x]
    alpha, w, bias = [0.0] * len(x), np.zeros(DIMENSIONS, np.float32), 0.0
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(x)).tolist():
            at, value = x[i]
            margin = float(w[at] @ value) + bias
            new = min(cost, max(0.0, alpha[i] - (y[i] * margin - 1) / squares[i]))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += np.float32(step) * value
                bias += step
                alpha[i] = new
    return np.append(w, np.float32(bias))


@dataclass
class Duels:
    """One-versus-one machines between classes."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @staticmethod
    def fit(x: list[Row], labels: np.ndarray) -> Duels:
        classes = sorted(set(labels.tolist()))
        pairs = list(combinations(range(len(classes)), 2))
        weights = []
        for a, b in pairs:
            rows = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
            signs = np.where(labels[rows] == classes[a], 1.0, -1.0).tolist()
            weights.append(fit_machine([x[i] for i in rows], signs))
        return Duels(classes, pairs, np.array(weights, np.float32).reshape(len(pairs), DIMENSIONS + 1))

    def best(self, x: np.ndarray) -> tuple[str, float]:
        """The class that wins, and how surely it won its closest duel."""
        wins, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        for (a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            wins[a if m > 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        top = max(range(len(self.classes)), key=lambda i: (wins[i], sums[i], -i))
        own = [m if a == top else -m for (a, b), m in zip(self.pairs, margins.tolist(), strict=True) if top in (a, b)]
        return self.classes[top], 1 / (1 + float(np.exp(-4 * min(own, default=25.0))))


@dataclass
class LanguageModel:
    families: Duels | None
    languages: dict[str, Duels]

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if self.families is None or not text or not has_letter(text):
            return UNDETERMINED, 0.0
        x = trigram_vector(text)
        family, sure = self.families.best(x)
        lang, surely = self.languages[family].best(x)
        return lang, sure * surely


def _sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [trigram_vector(t) for t in utf8(batch.column(1))]
        at = [np.flatnonzero(v) for v in vectors]
        columns = [
            batch.column(0),
            pa.array([i.astype(np.uint16).tobytes() for i in at], pa.binary()),
            pa.array([v[i].tobytes() for v, i in zip(vectors, at, strict=True)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "at", "value"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from labelled rows; about ``sample_rows`` of them are used."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel(None, {})
    each = max(1, sample_rows // len(counts))
    # Rows whose hash falls below their language's share; repeated texts are one row's luck.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    place = F.pmod(F.xxhash64("text", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    chosen = rows.filter(place < share[F.col("lang")]).dropDuplicates(["lang", "text"])
    vectors = chosen.limit(2 * sample_rows).mapInArrow(_sparse, "lang string, at binary, value binary").collect()
    vectors.sort()
    if not vectors:
        return LanguageModel(None, {})
    x = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["value"], np.float32)) for r in vectors]
    lang = np.array([r.lang for r in vectors], object)
    family = np.array([FAMILY_OF.get(name, name) for name in lang], object)
    members = {f: np.flatnonzero(family == f) for f in sorted(set(family.tolist()))}
    own = {f: Duels.fit([x[i] for i in rows], lang[rows]) for f, rows in members.items()}
    return LanguageModel(Duels.fit(x, family), own)


def predict(text: Column, model: LanguageModel) -> Column:
    """``lang`` and ``score`` of a text."""

    @F.arrow_udf(PREDICTION)
    def run(column: pa.Array) -> pa.Array:
        found = [model.predict(t) for t in utf8(column)]
        return pa.array([{"lang": lang, "score": score} for lang, score in found], _PREDICTION)

    return run(text)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text; rows without id are kept too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def drop_undetermined(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` whose language is found; a low score (short or mixed texts) drops nothing."""
    marked = docs.withColumn("__lang", predict(F.col(text_col), model))
    return marked.filter(F.col("__lang.lang") != UNDETERMINED).drop("__lang")
