"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text, compared window by window."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .calibration import isotonic
from .common import discard, portions, stored

_GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
N_FEATURES = 7


def _words(text: bytes) -> list[bytes]:
    return [w for w in _GAP.split(text.lower()) if w]


def _segments(words: list[bytes]) -> set[bytes]:
    """The words of a text and their beginnings of 4 bytes and more, each after a space; whole words end in one too."""
    out = set()
    for w in set(words):
        out.add(b" " + w + b" ")
        out.update(b" " + w[:k] for k in range(4, min(len(w), 12)))
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    reach = max(13, (len(content) - 1).bit_length())
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, hash_log=reach, chain_log=reach, window_log=reach + 2, search_log=6, target_length=0, write_content_size=False, write_dict_id=False, write_checksum=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=d)


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    window: int
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def scorer(self):  # noqa: ANN201
        """A function from a list of texts to features: how much shorter the windows of each text get by the toxic dictionary than by the ordinary one."""
        a, b = _compressor(self.toxic), _compressor(self.ordinary)

        def features(texts: list[bytes]) -> np.ndarray:
            out = np.zeros((len(texts), N_FEATURES))
            for i, t in enumerate(texts):
                words = _words(t)
                if not words:
                    continue
                windows = [b" " + b" ".join(words[j : j + self.window]) + b" " for j in range(0, len(words), self.window)]
                d = np.array([len(b.compress(w)) - len(a.compress(w)) for w in windows])
                top = np.sort(d)[::-1][:3]
                out[i] = min(d.mean(), 4), min(top[0], 12), min(top.mean(), 12), min((d >= 3).mean(), 0.5), min((d >= 5).mean(), 0.5), np.log1p((d >= 4).sum()) - 0.5 * np.log1p(len(d)), np.log1p(len(d))
            return out

        return features

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([z, np.ones(len(z))]) @ self.weights, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge-penalised weighted logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(texts: list[bytes], labels: list[int], *, weights: tuple[float, float] = (1.0, 1.0), window: int = 12, dictionary: int = 6_000, toxic_share: int = 64_000, contrast: float = 5.0, seed: int = 5) -> ToxicityModel:
    """Learn the dictionaries from every other text and calibrate on the rest.

    zstandard's own trainer fills a dictionary with what is frequent, which in toxic texts is mostly ordinary; what it makes of toxic windows tells held-out texts apart much worse, so both dictionaries are raw content chosen by contrast.

    Both dictionaries hold the same ordinary background of dictionary bytes, free of the segments below where possible, so that ordinary text gains equally by both. The toxic
    one also holds the segments of toxic texts that set them apart: words and beginnings of words whose document frequency among toxic texts lies contrast
    standard errors over what it is among all, up to toxic_share bytes; the ordinary one holds as many more bytes of ordinary text instead.
    weights says how many labelled texts of class 0 and 1 a text of the sample stands for. Whole-text features of the window differences then get logistic weights, and isotonic calibration by scores of 5 held-out parts. With
    one class only, all scores are that class's share; without texts 0.
    """
    rng = np.random.default_rng(seed)
    n = len(texts)
    share = float(np.mean(labels)) if n else 0.0
    flat = ToxicityModel(b" a ", b" a ", window, np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES), np.ones(N_FEATURES), (np.array([0.0]), np.array([share])))
    y = np.array(labels, float)
    if n < 4 or share in (0.0, 1.0):
        return flat
    half = np.zeros(n, bool)
    for c in (0, 1):
        half[np.flatnonzero(y == c)[::2]] = True
    seen, size, background = {0: Counter(), 1: Counter()}, [0, 0], []
    for i in np.flatnonzero(half):
        words = _words(texts[i])
        seen[int(y[i])].update(_segments(words))
        size[int(y[i])] += 1
        if not y[i] and len(words) > 12:
            background.append(words)
    marked = []
    for w, k in seen[1].items():
        p = (k + seen[0][w]) / (size[0] + size[1])
        expected = size[1] * p
        z = (k - expected) / np.sqrt(expected * (1 - p) + 0.5)
        if k >= 3 and z >= contrast:
            marked.append((z, w))
    segments = b""
    for _, w in sorted(marked, key=lambda m: (-m[0], -len(m[1]), m[1])):
        if len(segments) + len(w) <= toxic_share and w not in segments:
            segments = w + segments

    def ordinary(size: int) -> bytes:
        out, tries = b"", 10_000
        while background and len(out) < size:
            words = background[rng.integers(len(background))]
            at = rng.integers(len(words) - 12)
            part = b" " + b" ".join(words[at : at + 12]) + b" "
            if tries and any(m in part for _, m in marked):
                tries -= 1
            else:
                out += part
        return out

    common = ordinary(dictionary)[:dictionary] or b" a "
    flat.toxic, flat.ordinary = segments + b" " + common, ordinary(len(segments)) + b" " + common
    rest = np.flatnonzero(~half)
    x, t = flat.scorer()([texts[i] for i in rest]), y[~half]
    if len(rest) < 10 or t.mean() in (0.0, 1.0):
        return flat
    flat.mean, flat.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - flat.mean) / flat.scale, -6, 6)
    part, out, heavy = np.zeros(len(t), int), np.zeros(len(t)), np.array(weights)[t.astype(int)]
    for c in (0, 1):
        k = np.flatnonzero(t == c)
        part[k] = np.arange(len(k)) % 5
    for k in range(5):
        w = _logistic(z[part != k], t[part != k], heavy[part != k])
        out[part == k] = 1 / (1 + np.exp(-np.clip(np.column_stack([z[part == k], np.ones((part == k).sum())]) @ w, -30, 30)))
    flat.weights = _logistic(z, t, heavy)
    bins = np.minimum((out * 40).astype(int), 39)
    weight, total, mid = np.bincount(bins, heavy, minlength=40), np.bincount(bins, t * heavy, minlength=40), np.bincount(bins, out * heavy, minlength=40)
    flat.knots = isotonic(mid / np.maximum(weight, 1e-9), total, weight)
    return flat


def toxicity_scores(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic", learn: Column | None = None, keep: list[str] | tuple[str, ...] = (), sample: int = 3000, sample_bytes: int = 128 << 20, **fit: int) -> DataFrame:
    """keep, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5) for each row of df.

    The dictionaries and the calibration are learned from a bounded sample: at most sample labelled ids of each class, the first by a hash of the id, with
    their whole texts, and of these, in the same order, as many as have sample_bytes together; learn, over doc_id, says which ids may be among them. Every whole text of df, however long, is scored, window by window. Null labels and ids are not learned from; an id with
    both labels counts as label 1, one with several texts gives the smallest. Null and empty texts have no windows and get the score of such; rows come out as they are, repeated ones too. keep may hold any columns but score and predicted (ValueError).
    """
    keep = list(keep)
    if clash := {"score", "predicted"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    spark = df.sparkSession
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(9), F.col("doc_id").cast("string"))
    totals = {int(r[0]): int(r[1]) for r in known.groupBy("y").count().collect()}
    chosen = [(r.doc_id, r.y, 2 * i + c) for c in (0, 1) for i, r in enumerate(known.filter(F.col("y") == c).orderBy(order, "doc_id").limit(sample).collect())]
    if chosen:
        small = spark.createDataFrame(chosen, StructType([*known.schema.fields, StructField("place", IntegerType())]))
        got = df.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text")).join(F.broadcast(small), F.col("_id") == F.col("doc_id"))
        got = stored(got.groupBy("place", "y").agg(F.coalesce(F.min("_text"), F.lit(b"")).alias("t")), "sample")
        within, held = [], 0
        for r in sorted(got.select("place", F.octet_length("t").alias("n")).collect()):
            held += r.n
            if held > sample_bytes:
                break
            within.append((r.place,))
        rows = got.join(F.broadcast(spark.createDataFrame(within, "place int")), "place").orderBy("place").toArrow() if within else got.limit(0).toArrow()
        discard(got)
        y = rows.column("y").to_pylist()
        stands = tuple(totals.get(c, 0) / max(1, y.count(c)) for c in (0, 1))
        model = fit_toxicity(rows.column("t").to_pylist(), y, **{"weights": stands} | fit)
    else:
        model = fit_toxicity([], [], **fit)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = model.scorer()
        for batch in batches:
            parts = [model.score(features([t or b"" for t in part])) for part in portions(batch)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    out = df.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], score(F.col(text).cast("binary")).alias("score"))
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
