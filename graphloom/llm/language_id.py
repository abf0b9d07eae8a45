"""Language identification by hierarchical discrimination.

A text's family is predicted first, then its language within the family.  Both
steps let linear support vector machines vote, one for each pair (of families,
or of languages of one family), over hashed character n-grams.  The machines
are fitted on a bounded sample of labelled texts; every whole text is predicted
where it lies, with the weights (of fixed size per pair) broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, id_text, small_batches, utf8
from .shingles import mix

UNKNOWN = "und"
DIMS = 4096
#: Labelled texts that are learned from: at most so many of a language, and of all.
PER_LANGUAGE, IN_ALL = 600, 9000
CHUNK = 1 << 20

#: Language codes (ISO 639-1) by family.  Other codes are families of their own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "cjk": ("ja", "ko", "zh"),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector of hashed 1-, 2- and 3-grams of lower-case letters for each text, and whether it
    has a letter at all.  The same text has the same vector wherever it is."""
    # Spaces between texts, so that no n-gram reads the next one.
    low = [t.lower() for t in texts]
    points = _letters()[np.frombuffer("   ".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) + 3 for t in low])
    row = np.repeat(np.arange(len(low)), np.diff(np.append(0, ends)))[: len(points)]
    out = np.zeros((len(low), DIMS), np.float32)
    h = np.zeros(len(points), np.uint64)
    for n in range(3):
        shifted = np.full(len(points), 32, np.uint64)
        shifted[: len(points) - n] = points[n:]
        h = h * np.uint64(0x110000) + shifted
        at = (mix(h + np.uint64(n << 62)) % np.uint64(DIMS)).astype(np.int64)
        some = points != 32
        out += np.bincount(row[some] * DIMS + at[some], minlength=out.size).reshape(out.shape)
    has = np.zeros(len(low), bool)
    has[row[points != 32]] = True
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out, has


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights (the last for a constant) of a linear support vector machine for labels 1 and -1, by
    dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(axis=1)
    # Classes of different sizes have equal weight.
    top = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    shuffle = np.random.default_rng(5)
    for _ in range(rounds):
        for i in shuffle.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


@dataclass
class Votes:
    """Machines for all pairs of classes."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fitted(cls, x: np.ndarray, labels: np.ndarray) -> Votes:
        classes = sorted(set(labels.tolist()))
        pairs = [(a, b) for a in range(len(classes)) for b in range(a + 1, len(classes))]
        out = np.zeros((len(pairs), DIMS + 1), np.float32)
        for k, (a, b) in enumerate(pairs):
            some = (labels == classes[a]) | (labels == classes[b])
            out[k] = machine(x[some], np.where(labels[some] == classes[a], 1.0, -1.0))
        return cls(classes, pairs, out)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class with most votes (ties: the larger sum of margins) and how sure its weakest vote is."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            for c, m in ((a, margin[:, k]), (b, -margin[:, k])):
                votes[:, c] += m > 0
                sums[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        best = np.argmax(votes + 0.5 * np.tanh(sums) / n, axis=1)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(len(x)), best]))


@dataclass
class Model:
    families: Votes | None
    within: dict[str, Votes]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and scores (0 to 1); UNKNOWN with 0 for texts without a letter."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.families is None or not texts:
            return langs, scores
        x, has = features(texts)
        fam, sure = self.families.predict(x)
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero((fam == k) & has)
            if len(rows):
                votes = self.within[name]
                best, inner = votes.predict(x[rows])
                scores[rows] = sure[rows] * inner
                for r, c in zip(rows.tolist(), best.tolist()):
                    langs[r] = votes.classes[c]
        return langs, scores


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, off = utf8(b.column("text"))
        for i, j in chunks(off, CHUNK):
            part = b.slice(i, j - i)
            x, has = features(part.column("text").to_pylist())
            keep = np.flatnonzero(has)
            yield pa.record_batch({"lang": part.column("lang").take(pa.array(keep)), "x": pa.array([x[k].tobytes() for k in keep], pa.binary())})


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """Learn from the rows of ``df`` that have a text with a letter and a language.

    At most ``per_language`` rows of a language and ``in_all`` rows together are used (those with the
    least hash of their id), so what comes to the driver is bounded.  Without any such row the model
    knows no language.
    """
    small_batches(df)
    rows = df.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull())
    rows = rows.select(F.xxhash64(F.col(f"`{id_col}`"), F.lit(3)).alias("rank"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model(None, {})
    each = max(2, min(per_language, in_all // len(counts)))
    # The share of the hash range that holds about 1.5 times as many rows; the least of them are taken.
    share = F.lit(None).cast("double")
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * each / n + 30 / n))).otherwise(share)
    few = rows.where(F.col("rank") / 2.0**64 + 0.5 <= share)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))).where(F.col("place") <= each)
    got = few.select("text", "lang").mapInArrow(_featured, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not got:
        return Model(None, {})
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, DIMS)
    labels = np.array([r["lang"] for r in got], object)
    groups = np.array([family(v) for v in labels], object)
    return Model(Votes.fitted(x, groups), {g: Votes.fitted(x[groups == g], labels[groups == g]) for g in sorted(set(groups.tolist()))})


def predicted(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, lang (UNKNOWN for null text or text without a letter) and score (0 to 1).

    Only the text is looked at, all of it.  Repeated rows repeat; an empty table gives no rows; other
    columns of ``df`` are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, off = utf8(b.column("text"))
            for i, j in chunks(off, CHUNK):
                part = b.slice(i, j - i)
                langs, scores = sent.value.predict(part.column("text").to_pylist())
                yield pa.record_batch({"id": part.column("id"), "lang": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return id_text(df, id_col, text_col).mapInArrow(run, "id long, lang string, score double")
