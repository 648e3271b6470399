"""Quality classification: document statistics, random Fourier features, ridge regression by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import isotonic
from .common import portions, stored

FOLDS, BINS, LOW, HIGH = 3, 512, -0.5, 1.5
N_STATS = 26
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b" \t\r\x0b\x0c":
    _CLASS[_c] = 4
_CLASS[10] = 5
for _c in b".,;:'\"-()":
    _CLASS[_c] = 6
for _c in b"!?":
    _CLASS[_c] = 7
for _c in b"|":
    _CLASS[_c] = 8
for _c in b"#$%&*@^~_+=\\":
    _CLASS[_c] = 9
for _c in b"<>{}[]/`":
    _CLASS[_c] = 10
_CLASS[128:] = 11


def statistics(text: bytes) -> np.ndarray:
    """Statistics of a whole text: length, shares of character classes, word lengths, repetition of words, pairs and lines, entropy. All zero for an empty text."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=hist, minlength=12) / len(text)
    p = hist[hist > 0] / len(text)
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    out[0] = np.log1p(len(text))
    out[1:13] = kinds
    out[13] = -(p * np.log2(p)).sum()
    out[14] = np.log1p(n)
    if n:
        size = np.fromiter(map(len, words), np.int64, n)
        out[15:18] = size.mean(), size.std(), np.log1p(size.max())
        different, pairs = len(set(words)), len(set(zip(words, words[1:], strict=False)))
        out[18] = different / n
        out[19] = np.log(different + 1) / np.log(n + 2)
        out[20] = pairs / max(1, n - 1)
        out[21] = np.log(pairs + 1) / np.log(n + 2)
        first = np.bincount(_CLASS[np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)], minlength=12) / n
        last = np.bincount(_CLASS[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)], minlength=12) / n
        out[22], out[23] = first[2], last[7] + last[8] + last[9] + last[10]
    out[24] = len(set(lines)) / len(lines)
    out[25] = np.log1p(n / len(lines))
    return out


def document_statistics(text: Column) -> Column:
    """statistics() of each whole text as an array of doubles; null counts as empty."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([statistics(t or b"") for part in portions(batch) for t in part]).reshape(-1, N_STATS)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATS), pa.array(x.ravel()))

    return of(text.cast("binary"))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of standardised statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.freq + self.phase), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def fit_quality(train: DataFrame, *, features: int = 192, width: float = 1.0, ridge: float = 1e-3, seed: int = 11, rows_a_sum: int = 50_000) -> QualityModel:
    """Fit on all rows of train (stats, label 0 or 1, fold 0..FOLDS-1).

    The kernel is Gaussian with a width of width times the root of the number of statistics. Each partition sums its normal equations by fold; the
    sums meet in groups of 16, level by level until 16 are left, and then on the driver, so neither a task nor the driver gets more with more rows. A fold's rows are scored by the model
    of the other folds, and these scores, counted in BINS bins, give the isotonic curve. Without rows all scores are one half.
    """
    sums = train.agg(F.count("*"), *[F.sum(F.col("stats")[i]) for i in range(N_STATS)], *[F.sum(F.col("stats")[i] * F.col("stats")[i]) for i in range(N_STATS)]).head()
    n = sums[0]
    rng = np.random.default_rng(seed)
    freq = rng.normal(size=(N_STATS, features)) / (width * np.sqrt(N_STATS))
    phase = rng.uniform(0, 2 * np.pi, features)
    zero = QualityModel(np.zeros(N_STATS), np.ones(N_STATS), freq, phase, np.zeros(features + 1), (np.array([0.0]), np.array([0.5])))
    if not n:
        return zero
    zero.mean = np.array(sums[1 : 1 + N_STATS]) / n
    zero.scale = np.sqrt(np.maximum(np.array(sums[1 + N_STATS :]) / n - zero.mean**2, 1e-12))
    d = features + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a = np.zeros((FOLDS, d, d + 1))
        for b in batches:
            phi = zero.features(_matrix(b.column("stats")))
            y = b.column("label").to_numpy(zero_copy_only=False).astype(float)
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                f = phi[fold == k]
                a[k, :, :d] += f.T @ f
                a[k, :, d] += f.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([a.tobytes()], pa.binary())], names=["g", "a"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FOLDS * d * (d + 1))
        for b in batches:
            for x in b.column("a"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "a"])

    n_parts = max(1, -(-n // rows_a_sum))
    parts = train.select("stats", "label", "fold").repartition(n_parts).mapInArrow(partial, "g int, a binary")
    while n_parts > 16:
        n_parts = -(-n_parts // 16)
        parts = parts.select(F.floor(F.col("g") / 16).cast("int").alias("g"), "a").groupBy("g").applyInArrow(merge, "g int, a binary")
    parts = [r.a for r in parts.collect()]
    by_fold = sum(np.frombuffer(x).reshape(FOLDS, d, d + 1) for x in parts)
    penalty = ridge * n * np.eye(d) / d
    penalty[-1, -1] = 1e-9

    def solve(a: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(a[:, :d] + penalty, a[:, d], rcond=None)[0]

    whole = by_fold.sum(axis=0)
    others = np.array([solve(whole - by_fold[k]) for k in range(FOLDS)])
    zero.beta = solve(whole)

    @F.arrow_udf("int")
    def held_out_bin(stats: pa.Array, fold: pa.Array) -> pa.Array:
        s = (zero.features(_matrix(stats)) * others[fold.to_numpy(zero_copy_only=False)]).sum(axis=1)
        return pa.array(np.clip((s - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32))

    counts = train.select(held_out_bin("stats", "fold").alias("bin"), "label").groupBy("bin").agg(F.count("*"), F.sum("label")).collect()
    x = np.array([LOW + (r[0] + 0.5) * (HIGH - LOW) / BINS for r in counts])
    zero.knots = isotonic(x, np.array([float(r[2]) for r in counts]), np.array([float(r[1]) for r in counts]))
    return zero


def quality_scores(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", learn: Column | None = None, keep: list[str] | tuple[str, ...] = (), store_rows: bool = True, **fit: float) -> DataFrame:
    """keep, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5) for each row of df.

    Statistics of whole texts are stored, with keep beside them, and labels meet them by id. Without store_rows only ids and statistics are, for fitting, and statistics are
    computed again where rows are scored: the better way where keep holds the texts. learn, over doc_id, says which ids' labels may be learned from
    (all if not given). Labels that are null, and ids without a text, are not learned from; an id with several labels or texts gives each pair.
    Null and empty texts, and those of any length, have a score like any other; with no labels at all scores are 0.5. Rows come out as they are, repeated ones too. keep may hold any columns but score and predicted (ValueError).
    """
    keep = list(keep)
    if clash := {"score", "predicted"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    out = _scored(df, labels, doc_id, text, label_id, label, learn, keep, store_rows, fit)
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", **fit: float) -> DataFrame:
    """The rows of df that quality_scores() predicts as 1, learned from all labels; all columns stay, whatever their names."""
    out = _scored(df, labels, doc_id, text, label_id, label, None, df.columns, False, fit).filter("score >= 0.5")
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(df.columns)])


def _scored(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, label: str, learn: Column | None, keep: list[str], store_rows: bool, fit: dict) -> DataFrame:
    """_keep_0, ... for the columns of keep, and score."""
    kept = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    names = [f"_keep_{i}" for i in range(len(keep))]
    known = labels.select(F.col(label_id).alias("_id"), F.col(label).cast("double").alias("label")).filter("label is not null")
    fold = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold")
    rows = stored(df.select(*(kept if store_rows else []), F.col(doc_id).alias("doc_id"), document_statistics(F.col(text)).alias("stats")), "statistics")
    fitted = rows.select("doc_id", "stats").filter(F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)))
    model = fit_quality(stored(fitted.join(known, F.col("doc_id") == F.col("_id")).select("stats", "label", fold), "train"), **fit)

    @F.arrow_udf("double")
    def score(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(stats)))

    @F.arrow_udf("double")
    def score_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([statistics(t or b"") for part in portions(batch) for t in part]).reshape(-1, N_STATS)
            yield pa.array(model.score(x))

    if store_rows:
        return rows.select(*names, score("stats").alias("score"))
    # one function, not two: each would have a Python process of its own in every task
    return df.select(*kept, score_text(F.col(text).cast("binary")).alias("score"))
