"""Mixing sources to target weights by balanced (cube-method) sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, stored


def share_targets(sizes: Sequence[int], weights: Sequence[float], total: float, ceiling: float) -> list[float]:
    """Split total by weight; what a source would get above ceiling times its size is shared again by weight among the others."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / whole > ceiling * sizes[i]} if whole else set()
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / whole if whole else 0.0
            return out
        for i in over:
            out[i] = ceiling * float(sizes[i])
        rest -= sum(out[i] for i in over)
        open_ -= over
    return out


def flight(p: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The cube method's flight phase: move p through the null space of balance (units x constraints) until no more than constraints units are neither 0 nor 1. Totals of p * balance stay."""
    p = p.astype(float).copy()
    eps = 1e-9
    todo = np.flatnonzero((p > eps) & (p < 1 - eps)).tolist()[::-1]
    k = balance.shape[1]
    held: list[int] = []
    while True:
        while len(held) <= k and todo:
            held.append(todo.pop())
        if len(held) <= 1:
            break
        a = balance[held].T
        u = np.linalg.svd(a, full_matrices=True)[2][-1] if len(held) > np.linalg.matrix_rank(a) else None
        if u is None:
            break
        x = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 1e-12, (1 - x) / u, np.where(u < -1e-12, -x / u, np.inf)).min()
            down = np.where(u > 1e-12, x / u, np.where(u < -1e-12, (x - 1) / u, np.inf)).min()
        x = x + u * (up if rng.random() * (up + down) < down else -down)
        p[held] = np.where(x < eps, 0.0, np.where(x > 1 - eps, 1.0, x))
        held = [i for i in held if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the few units that the last flight left: of all ways to do so, the one nearest to the totals of size and count; ties by chance."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        d = ways - p[left]
        off = np.abs(d @ size[left]) + np.abs(d.sum(axis=1)) * 1e-6
        best = np.flatnonzero(off <= off.min() + 1e-9)
        p = p.copy()
        p[left] = ways[best[rng.integers(len(best))]]
    return p


def cube_sample(df: DataFrame, *, source: str, size: str, key: str, prob: str, seed: int = 7, block: int = 4096) -> DataFrame:
    """df with a column drawn (0 or 1): each row is drawn with probability prob, and in every source the drawn rows' sizes and number come out at their expected totals but for a few rows' worth.

    The rows of a source are dealt by a hash of key into blocks of about block rows, whatever their number, and each
    block flies on its own with the constraints size and count. It leaves 2 undecided rows at most; those fly again in
    blocks of block undecided rows, level by level, until a source has one block, whose rest is landed. So no task holds more than a
    block, a hot source is split like any other, and each level has about block/2 times fewer rows.

    Reruns agree: blocks, order and random numbers depend on key and seed alone. Rows equal in all columns are told
    apart only by their order, which changes nothing. Columns named drawn or _cube_... are a ValueError. Null sources are a source; null prob counts as 0 and null size as 0.
    """
    spark = df.sparkSession
    own = df.columns
    if clash := [c for c in own if c.startswith("_cube_") or c == "drawn"]:
        raise ValueError(f"columns {clash} would be overwritten")
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(source), F.col(size))
    rows = df.select(*own).withColumns({"_cube_h": h, "_cube_p": F.coalesce(F.col(prob), F.lit(0.0)).cast("double"), "_cube_w": F.coalesce(F.col(size), F.lit(0)).cast("double")})
    rows = stored(rows, "cube")
    schema = rows.schema
    names = schema.names

    def blocks_of(level: DataFrame) -> tuple[DataFrame, int]:
        n = level.groupBy(source).agg(F.ceil(F.count("*") / block).cast("int").alias("_cube_n"))
        most = n.agg(F.max("_cube_n")).head()[0] or 0
        return n, most

    def fly(last: bool):  # noqa: ANN202
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_cube_h", "_cube_w", "_cube_p"], kind="stable")
            rng = np.random.default_rng(int(pdf["_cube_h"].iloc[0]) & 0x7FFFFFFFFFFFFFFF)
            w = pdf["_cube_w"].to_numpy()
            p = flight(pdf["_cube_p"].to_numpy(), np.column_stack([w / max(1.0, w.mean()), np.ones(len(w))]), rng)
            return pdf.assign(_cube_p=land(p, w, rng) if last else p)[names]

        return one

    done: list[DataFrame] = []
    level = rows
    while True:
        n, most = blocks_of(level)
        last = most <= 1
        cut = level.join(n.select(F.col(source).alias("_cube_s"), "_cube_n"), F.col(source).eqNullSafe(F.col("_cube_s")))
        b = F.pmod(F.xxhash64("_cube_h"), F.col("_cube_n")).alias("_cube_b")
        flown = stored(cut.select(*schema.names, b).groupBy(source, "_cube_b").applyInPandas(fly(last), schema), "cube")
        p = F.col("_cube_p")
        done.append(flown.filter((p == 0) | (p == 1)))
        if last:
            break
        level = flown.filter((p > 0) & (p < 1))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*own, F.col("_cube_p").cast("int").alias("drawn"))


def mix_sources(
    df: DataFrame,
    *,
    source: str,
    size: str,
    key: str,
    keep: Sequence[str] = (),
    weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 7,
    block: int = 4096,
) -> DataFrame:
    """How often each row goes into a mix in which the sources have target totals of size.

    Sources in order of code points (null last) get the weights in turn, repeating, and share total times all sizes; a
    source gets no more than ceiling times its own size, and the excess goes to the others by weight. A row is taken floor(target / size of
    source) times, and once more if cube_sample draws it with the remaining fraction as its probability.

    Returns keep, then size, source_size, target (of the row's source), times, taken (size * times). The number of
    sources must fit the driver: one row a source is collected. Null sizes count as 0; an empty table gives an empty mix; repeated rows are
    rows of their own; a source whose size is 0 has target 0 and is taken 0 times. Columns outside keep play no part.
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(source).cast("string").alias("_source"), F.col(key).cast("string").alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    rows = stored(rows, "mix")
    totals = [(r[0], int(r[1])) for r in rows.groupBy("_source").agg(F.sum("_size")).collect()]
    totals.sort(key=lambda x: (x[0] is None, (x[0] or "").encode()))
    targets = share_targets([t for _, t in totals], [weights[i % len(weights)] for i in range(len(totals))], total * sum(t for _, t in totals), ceiling)
    per = spark.createDataFrame([(s, t, float(g), int(g / t) if t else 0, g / t - int(g / t) if t else 0.0) for (s, t), g in zip(totals, targets, strict=True)], "_s string, source_size long, target double, _times int, _p double")
    rows = rows.join(F.broadcast(per) if len(totals) <= 10_000 else per, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    out = cube_sample(rows, source="_source", size="_size", key="_key", prob="_p", seed=seed, block=block)
    times = (F.col("_times") + F.col("drawn")).alias("times")
    return out.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], F.col("_size").alias("size"), "source_size", "target", times, (F.col("_size") * (F.col("_times") + F.col("drawn"))).alias("taken"))


def mix_documents(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """The rows of docs that the mix of mix_sources takes, with a column times; the size of a document is its number of words.

    Rows equal in id, source and text come out as one, with their times added up. Documents without words have no size; they are taken like others of their source. A column of docs
    named times would clash and is a ValueError.
    """
    if "times" in docs.columns:
        raise ValueError("docs has a column named times")
    sig = F.xxhash64(F.lit(0), text)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), sig.alias("sig"), n_words(F.col(text)).alias("words"))
    mixed = mix_sources(sized, source="source", size="words", key="doc_id", keep=["doc_id", "source", "sig"], **how)
    # keys without nulls, so that rows are dealt the same way for both steps
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    taken = mixed.groupBy(name(F.col("doc_id")).alias("_id"), name(F.col("source")).alias("_source"), F.col("sig").alias("_sig")).agg(F.sum("times").alias("_times")).filter("_times > 0")
    rows = docs.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(docs.columns)], name(F.col(doc_id)).alias("_d"), name(F.col(source)).alias("_s"), sig.alias("_g")).dropDuplicates(["_d", "_s", "_g"])
    same = (F.col("_d") == F.col("_id")) & (F.col("_s") == F.col("_source")) & (F.col("_g") == F.col("_sig"))
    return rows.join(taken, same).select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("_times").cast("int").alias("times"))
