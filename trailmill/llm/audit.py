"""Audit of filters that interact: what each one removes in every order of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, stored

#: The filters, by the bit of a failure mask.
FILTERS = "ABCDE"
_CAPITALS = bytes(range(65, 91))
_SYMBOL = re.compile(rb"[#$%&*|]")
_DUPLICATE = 1 << FILTERS.index("E")
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def content_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    points = len(text) - int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * points) << 2 | bool(_SYMBOL.search(text)) << 3


def failure_masks(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """keep, doc_id and mask (int, a bit for each of FILTERS that the row fails) of each row of df.

    Rows are range-sorted by fingerprint, full text and id; the ranges go by fingerprint and id, so that a text of very many copies spreads over many tasks and
    no text is sampled for them. Each row is compared with the one before it. A task can't see the tasks before it: the texts that have its first or last fingerprint
    meet those of other tasks by an equal join, which gives the smallest id of a text's copies that began earlier.

    Null texts count as empty ones. A row fails E if another row with the same text has a smaller id; rows that share id and text don't
    make each other fail. Null ids are larger than all others and equal to each other. Repeated rows come out repeated, an empty table gives no rows, texts may be of any
    length, and columns outside keep are ignored; keep may not hold mask (ValueError).
    """
    if "mask" in keep:
        raise ValueError("column mask would be overwritten")
    names = [f"_keep_{i}" for i in range(len(keep))]
    plain = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(doc_id).alias("id"), plain.alias("text")).withColumn("fp", F.xxhash64("text"))
    order = [F.col("fp"), F.col("text"), F.col("id").asc_nulls_last()]
    rows = rows.repartitionByRange(order[0], order[2]).sortWithinPartitions(*order)
    types = {f.name: f.dataType for f in rows.schema}
    carried = ", ".join(f"{n} {types[n].simpleString()}" for n in [*names, "id"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # run: which text of the task a row has; ends: the text, in rows of their own for runs of the task's first and last fingerprint
        task = TaskContext.get().partitionId()
        first_fp = run_fp = run_text = run_id = schema = None
        run, content, last = -1, 0, []

        def ends(runs: list[tuple[int, bytes, pa.Array]]) -> pa.RecordBatch:
            k = len(runs)
            kept = [pa.nulls(k, schema.field(n).type) for n in names]
            return pa.RecordBatch.from_arrays([*kept, pa.concat_arrays([r[2] for r in runs]), pa.nulls(k, pa.int32()), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.binary()), pa.array([task] * k, pa.int32())], schema=schema)

        for b in batches:
            fps, ids = b.column("fp").to_pylist(), b.column("id")
            schema = schema or pa.schema([*[b.schema.field(n) for n in [*names, "id"]], ("mask", pa.int32()), ("run", pa.int64()), ("end", pa.binary()), ("task", pa.int32())])
            masks, runs, i = [], [], 0
            for part in portions(b.column("text")):
                for t in part:
                    if run < 0 or fps[i] != run_fp or t != run_text:
                        if last and fps[i] != run_fp:
                            if run_fp == first_fp:
                                yield ends(last)
                            last = []
                        first_fp = fps[i] if run < 0 else first_fp
                        run_fp, run_text, run_id, run = fps[i], t, ids.slice(i, 1), run + 1
                        last.append((run, t, run_id))
                        mask = content = content_mask(t)
                    else:
                        mask = content | _DUPLICATE * (not ids.slice(i, 1).equals(run_id))
                    masks.append(mask)
                    runs.append(run)
                    i += 1
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], ids, pa.array(masks, pa.int32()), pa.array(runs, pa.int64()), pa.nulls(b.num_rows, pa.binary()), pa.array(np.full(b.num_rows, task, np.int32))], schema=schema)
        if last:
            yield ends(last)

    out = stored(rows.mapInArrow(judge, f"{carried}, mask int, run bigint, end binary, task int"), "masks")
    # the smallest id of every text that ends or begins a task: about two rows a task, whatever the table
    edges = out.filter("end IS NOT NULL").select("end", "id", "task", "run")
    least = edges.groupBy(F.col("end").alias("_end")).agg(F.min("id").alias("least"))
    heads = edges.join(least, F.col("end") == F.col("_end")).select(F.col("task").alias("_task"), F.col("run").alias("_run"), "least")
    again = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    # heads has a row for each text that shares the first or last fingerprint of a task
    judged = out.filter("end IS NULL").join(F.broadcast(heads), (F.col("task") == F.col("_task")) & (F.col("run") == F.col("_run")), "left")
    mask = F.col("mask").bitwiseOR(F.when(again, F.lit(_DUPLICATE)).otherwise(F.lit(0)))
    return judged.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *([] if doc_id in keep else [F.col("id").alias(doc_id)]), mask.alias("mask"))


def part_counters(masks: DataFrame, labels: DataFrame, *, part: Column, doc_id: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): how many rows of masks (doc_id, mask) a part has of each sort; good and toxic say whether a row of labels with the row's id has quality or toxic 1.

    Counters of disjoint tables add up. Rows without an id or a label are neither good nor toxic; of several labels of an id one suffices.
    """
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    own = masks.select(part.alias("part"), F.col(doc_id).alias("_own"), "mask")
    joined = own.join(marks, F.col("_own") == F.col("_id"), "left")
    return joined.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.count("*").alias("n"))


def order_table(counters: DataFrame) -> DataFrame:
    """One row for each part of counters, order of the filters (filter_order) and step from 1 on, with the rows of the part that are kept after the step, removed by it, redundant (failing its filter but removed before), unique_fails (failing its filter alone), good_lost and
    toxic_lost (removed here and marked so), and shapley (what its filter removes, summed over all orders). A part has 128 counters at most, so each is a small group. Parts without rows don't come out."""
    names = ["".join(x) for x in permutations(FILTERS)]
    steps = len(FILTERS)
    filters = np.array([[FILTERS.index(x) for x in n] for n in names])
    before = np.zeros((len(names), steps), np.int64)
    for k in range(1, steps):
        before[:, k] = before[:, k - 1] | 1 << filters[:, k - 1]
    bit = 1 << filters

    def solve(table: pa.Table) -> pa.Table:
        mask, n = (table.column(c).to_numpy().astype(np.int64) for c in ("mask", "n"))
        good, toxic = (table.column(c).to_numpy().astype(np.int64) for c in ("good", "toxic"))

        def total(chosen: np.ndarray, what: np.ndarray = np.int64(1)) -> np.ndarray:
            return (chosen * (n * what)).sum(axis=-1)

        fails, out = mask & bit[..., None] > 0, mask & before[..., None] > 0
        removed = total(fails & ~out)
        each = np.array([removed[filters == f].sum() for f in range(steps)])
        cols = [total(~fails & ~out), removed, total(fails & out), total(np.broadcast_to(mask == bit[..., None], fails.shape)), total(fails & ~out, good), total(fails & ~out, toxic), each[filters]]
        keys = [pa.array([table.column("part")[0].as_py()] * filters.size, pa.string()), pa.array(np.repeat(names, steps).tolist()), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names)))]
        return pa.Table.from_arrays([*keys, *[pa.array(c.ravel(), pa.int64()) for c in cols]], names=["part", "filter_order", "step", *_COUNTS])

    return counters.groupBy("part").applyInArrow(solve, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def filter_audit(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """order_table() of the rows of df by part (null: the empty string), with labels (doc_id, quality, toxic). failure_masks() says what becomes of nulls, ties and repeated rows; an empty table gives no rows."""
    masks = failure_masks(df, doc_id=doc_id, text=text, keep=[part] if part != doc_id else [])
    counters = stored(part_counters(masks, labels, part=F.coalesce(F.col(part).cast("string"), F.lit("")), doc_id=doc_id), "counters")
    return order_table(counters)
