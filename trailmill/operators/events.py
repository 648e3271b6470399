"""Event logs that compare tracker hypotheses with true objects, frame by frame, and their metrics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lap
from .storage import stored

EVENTS = "seq string, frame long, event int, type string, oid long, hid long, d double"
FRAMES = "seq string, frame long, oids array<long>, hids array<long>, pairs array<struct<o:long,h:long,d:double>>"
#: Event types that the base metrics don't see.
ASIDE = ("RAW", "ASCEND", "TRANSFER", "MIGRATE")
#: Frames whose events are held at once.
_FRAMES = 20_000


class EventLog:
    """What one sequence remembers from frame to frame; frames must come in order."""

    def __init__(self, max_switch_time: float = float("inf")) -> None:
        self.max_switch_time = max_switch_time
        self.partner: dict[int, int] = {}
        self.claimed: dict[int, int] = {}
        self.seen_at: dict[int, int] = {}
        self.known_objects: set[int] = set()
        self.known_hyps: set[int] = set()

    def frame(self, frame: int, oids: list[int], hids: list[int], d: np.ndarray) -> list[tuple]:
        """pairs_frame() for a matrix d of objects x hypotheses, NaN where a pair is impossible."""
        d = d.reshape(len(oids), len(hids))
        return self.pairs_frame(frame, oids, hids, {(i, j): float(d[i, j]) for i, j in zip(*(x.tolist() for x in np.nonzero(np.isfinite(d))), strict=True)})

    def pairs_frame(self, frame: int, oids: list[int], hids: list[int], d: dict[tuple[int, int], float]) -> list[tuple]:
        """Events (type, oid, hid, d) of a frame; d has the possible pairs by places in oids and hids, in their order.

        Every frame opens with an empty RAW and one for each possible pair and each side without any. Then pairs that held before are
        carried on, the rest is assigned at least cost, and what is left is missed or a false positive. Where no object or hypothesis has two partners to choose from, there is nothing to weigh.
        """
        out: list[tuple] = [("RAW", None, None, None)]
        out += [("RAW", oids[i], hids[j], x) for (i, j), x in d.items()]
        with_o, with_h = {i for i, _ in d}, {j for _, j in d}
        out += [("RAW", o, None, None) for i, o in enumerate(oids) if i not in with_o]
        out += [("RAW", None, h, None) for j, h in enumerate(hids) if j not in with_h]
        free_o, free_h = dict.fromkeys(range(len(oids))), dict.fromkeys(range(len(hids)))
        if d:
            where = {h: j for j, h in enumerate(hids)}
            for i, o in enumerate(oids):
                j = where.get(self.partner.get(o))
                if j is not None and j in free_h and (i, j) in d:
                    out.append(("MATCH", o, hids[j], d[i, j]))
                    self.known_objects.add(o)
                    self.known_hyps.add(hids[j])
                    del free_o[i], free_h[j]
            left = [(i, j) for i, j in d if i in free_o and j in free_h]
            if len({i for i, _ in left}) < len(left) or len({j for _, j in left}) < len(left):
                rows, cols = sorted({i for i, _ in left}), sorted({j for _, j in left})
                m = np.full((len(rows), len(cols)), np.nan)
                at_o, at_h = {i: a for a, i in enumerate(rows)}, {j: b for b, j in enumerate(cols)}
                for i, j in left:
                    m[at_o[i], at_h[j]] = d[i, j]
                left = [(rows[a], cols[b]) for a, b in zip(*lap.solve(m), strict=True)]
            for i, j in left:
                out += self._pair(frame, oids[i], hids[j], d[i, j])
                del free_o[i], free_h[j]
        out += [("MISS", oids[i], None, None) for i in free_o]
        out += [("FP", None, hids[j], None) for j in free_h]
        for o in oids:
            self.seen_at[o] = frame
        return out

    def _pair(self, frame: int, o: int, h: int, d: float) -> Iterable[tuple]:
        """A new pair: a switch if the object had another partner not too long ago, a transfer if the hypothesis had another object."""
        switch = self.partner.get(o, h) != h and abs(frame - self.seen_at[o]) <= self.max_switch_time
        transfer = self.claimed.get(h, o) != o
        if switch and h not in self.known_hyps:
            yield "ASCEND", o, h, d
        if transfer:
            if o not in self.known_objects:
                yield "MIGRATE", o, h, d
            yield "TRANSFER", o, h, d
        yield "SWITCH" if switch else "MATCH", o, h, d
        self.partner[o], self.claimed[h] = h, o
        self.known_objects.add(o)
        self.known_hyps.add(h)


def frames_of(gt: DataFrame, hyp: DataFrame, pairs: DataFrame, *, strict: bool = True, seq: Column | None = None) -> DataFrame:
    """One row a frame (FRAMES) from objects and hypotheses (seq, frame, id) and pairs (seq, frame, a, b, distance).

    With strict, frames that only one side has count with the ids they have; without, they count as empty frames. seq is the sequence as an expression over frame, where no two sequences share a frame's number: the tables then need no seq, and keep their exchange by frame.
    """
    keys = ["seq", "frame"] if seq is None else ["frame"]
    o = gt.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("oids"))
    h = hyp.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("hids"))
    p = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("a").alias("o"), F.col("b").alias("h"), F.col("distance").alias("d")))).alias("pairs"))
    both = o.join(p, keys, "left").join(h, keys, "full")
    empty = F.array().cast("array<bigint>")
    one_sided = F.lit(False) if strict else F.col("oids").isNull() | F.col("hids").isNull()
    ids = [F.when(one_sided, empty).otherwise(F.coalesce(c, empty)).cast("array<bigint>").alias(c) for c in ("oids", "hids")]
    return both.select((F.col("seq") if seq is None else seq).cast("string").alias("seq"), F.col("frame").cast("long"), *ids, F.coalesce("pairs", F.array()).cast("array<struct<o:bigint,h:bigint,d:double>>").alias("pairs"))


def _logged(t: pa.Table, max_switch_time: float) -> Iterator[pa.Table]:
    """The events of one sequence, of _FRAMES frames at a time; what is remembered from frame to frame is small beside them."""
    t = t.sort_by("frame").combine_chunks()
    log = EventLog(max_switch_time)
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    for part in (t.slice(a, _FRAMES) for a in range(0, t.num_rows, _FRAMES)):
        cols: list[list] = [[] for _ in kinds]
        pairs = pa.concat_arrays(part.column("pairs").chunks)
        o, h, x = (pairs.flatten().field(k).to_pylist() for k in "ohd")
        end = 0
        for frame, oids, hids, n in zip(*(part.column(c).to_pylist() for c in ("frame", "oids", "hids")), pa.compute.list_value_length(pairs).to_pylist(), strict=True):
            start, end = end, end + n
            oi, hi = {k: i for i, k in enumerate(oids)}, {k: j for j, k in enumerate(hids)}
            d = {(oi[o[k]], hi[h[k]]): x[k] for k in range(start, end) if o[k] in oi and h[k] in hi and x[k] is not None and math.isfinite(x[k])}
            made = log.pairs_frame(frame, oids, hids, dict(sorted(d.items())))
            cols[0] += [frame] * len(made)
            cols[1] += range(len(made))
            for c, v in zip(cols[2:], zip(*made, strict=True), strict=True):
                c += v
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        yield pa.table([pa.repeat(t.column("seq")[0], len(arrays[0])), *arrays], names=["seq", "frame", "event", "type", "oid", "hid", "d"])


def event_log(frames: DataFrame, *, max_switch_time: float = float("inf")) -> DataFrame:
    """EVENTS of the frames of each sequence; a sequence is one task, for its events depend on all frames before."""
    return frames.groupBy("seq").applyInArrow(lambda t: pa.concat_tables(_logged(t, max_switch_time)), EVENTS)


def base_events(events: DataFrame) -> DataFrame:
    """Without RAW and the types that only add detail."""
    return events.filter(~F.col("type").isin(*ASIDE))


def share(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _count(kind: str) -> Column:
    return F.count_if(F.col("type") == kind)


def event_counts(events: DataFrame, *, overall: bool = False) -> DataFrame:
    """Additive metrics by sequence, in one aggregation; with overall also their sum over all sequences, named OVERALL (null group)."""
    base = ~F.col("type").isin(*ASIDE)
    aggs = {
        "num_frames": F.count_distinct("frame"),
        "num_matches": _count("MATCH"),
        "num_switches": _count("SWITCH"),
        "num_transfer": _count("TRANSFER"),
        "num_ascend": _count("ASCEND"),
        "num_migrate": _count("MIGRATE"),
        "num_false_positives": _count("FP"),
        "num_misses": _count("MISS"),
        "num_detections": F.count_if(F.col("type").isin("MATCH", "SWITCH")),
        "num_objects": F.count(F.when(base, F.col("oid"))),
        "num_predictions": F.count(F.when(base, F.col("hid"))),
        "num_unique_objects": F.count_distinct(F.when(base, F.col("oid"))),
        "sum_d": F.coalesce(F.sum(F.when(base, F.col("d"))), F.lit(0.0)),
    }
    per = events.groupBy("seq").agg(*[c.alias(n) for n, c in aggs.items()])
    if overall:
        total = per.agg(*[F.sum(n).alias(n) for n in aggs]).select(F.lit("OVERALL").alias("seq"), *aggs)
        per = per.unionByName(total)
    return per


def track_ratios(events: DataFrame) -> DataFrame:
    """seq, oid and the share of an object's frames in which it is tracked."""
    e = base_events(events).filter("oid is not null")
    return e.groupBy("seq", "oid").agg(share(F.count_if(F.col("type") != "MISS"), F.count("*")).alias("ratio"))


def track_quality(events: DataFrame) -> DataFrame:
    """Mostly tracked (0.8 and more), partially tracked and mostly lost (under 0.2) objects by sequence."""
    r = F.col("ratio")
    return track_ratios(events).groupBy("seq").agg(F.count_if(r >= 0.8).alias("mostly_tracked"), F.count_if((r >= 0.2) & (r < 0.8)).alias("partially_tracked"), F.count_if(r < 0.2).alias("mostly_lost"))


def fragmentations(events: DataFrame) -> DataFrame:
    """How often tracking of an object stops between its first and last tracked frame, by sequence."""
    from pyspark.sql import Window

    e = base_events(events).filter("oid is not null").withColumn("hit", F.col("type") != "MISS")
    w = Window.partitionBy("seq", "oid").orderBy("frame", "event")
    # a gap is counted at the hit that ends it, so that no row looks ahead: Spark walks a frame to the end of its group anew for every row
    seen = F.max("hit").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumns({"before": F.lag("hit").over(w), "seen": seen})
    return e.groupBy("seq").agg(F.count_if(F.col("hit") & ~F.col("before") & F.col("seen")).alias("num_fragmentations"))


def id_pair_counts(events: DataFrame) -> DataFrame:
    """seq, oid, hid, n: how often an object and a hypothesis were possible partners."""
    return events.filter("type = 'RAW' and oid is not null and hid is not null").groupBy("seq", "oid", "hid").agg(F.count("d").alias("n"))


def _shared_frames(links: list[tuple[int, int, float]]) -> float:
    """The most frames that a one-to-one assignment of objects to hypotheses shares, from the frames of each pair (object, hypothesis, n)."""
    # a match saves the frames that both share, on both sides; objects and hypotheses that no pairs tie together are decided apart
    root: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, _ in links:
        root[find(("o", a))] = find(("h", b))
    parts: dict[tuple, list] = {}
    for link in links:
        parts.setdefault(find(("o", link[0])), []).append(link)
    hit = 0.0
    for part in parts.values():
        if len(part) == 1:
            hit += part[0][2]
            continue
        rows, cols, m = lap.dense(*(np.array([x[k] for x in part]) for k in range(3)))
        both = np.where(np.isnan(m), 0.0, m)
        hit += both[lap.solve(-both)].sum()
    return hit


def id_totals(events: DataFrame) -> DataFrame:
    """Whole-sequence identity totals: idfp and idfn of the cheapest one-to-one assignment of objects to hypotheses, by sequence.

    Counting frames per object, per hypothesis and per pair is an aggregation each; the assignment of a sequence is one task.
    """
    raw = events.filter("type = 'RAW'")
    oc = raw.filter("oid is not null").groupBy("seq", "oid").agg(F.count_distinct("frame").alias("n")).select("seq", F.lit("o").alias("k"), F.col("oid").alias("a"), F.lit(None).cast("long").alias("b"), "n")
    hc = raw.filter("hid is not null").groupBy("seq", "hid").agg(F.count_distinct("frame").alias("n")).select("seq", F.lit("h").alias("k"), F.lit(None).cast("long").alias("a"), F.col("hid").alias("b"), "n")
    tp = id_pair_counts(events).select("seq", F.lit("p").alias("k"), F.col("oid").alias("a"), F.col("hid").alias("b"), "n")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        o, h, p = (pdf[pdf["k"] == k] for k in "ohp")
        hit = _shared_frames(list(zip(p["a"].astype("int64").tolist(), p["b"].astype("int64").tolist(), p["n"].astype(float).tolist(), strict=True)))
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "idfp": [int(h["n"].sum() - hit)], "idfn": [int(o["n"].sum() - hit)]})

    return oc.unionByName(hc).unionByName(tp).groupBy("seq").applyInPandas(one, "seq string, idfp long, idfn long")


def ratios(counts: DataFrame) -> DataFrame:
    """counts with the ratio metrics; they follow from the sums, so that they hold for OVERALL too."""
    c = {n: F.col(n) for n in counts.columns}
    out = {
        "mota": 1 - share(c["num_misses"] + c["num_switches"] + c["num_false_positives"], c["num_objects"]),
        "motp": share(c["sum_d"], c["num_detections"]),
        "precision": share(c["num_detections"], c["num_detections"] + c["num_false_positives"]),
        "recall": share(c["num_detections"], c["num_objects"]),
    }
    if "idfn" in c:
        idtp = c["num_objects"] - c["idfn"]
        out |= {"idtp": idtp, "idp": share(idtp, idtp + c["idfp"]), "idr": share(idtp, idtp + c["idfn"]), "idf1": share(2 * idtp, c["num_objects"] + c["num_predictions"])}
    return counts.withColumns(out)


def mot_summary(events: DataFrame, *, overall: bool = True) -> DataFrame:
    """All metrics by sequence, and of all sequences together as OVERALL. events is read several times; pass a stored or cached table."""
    per = event_counts(events)
    for more in (track_quality(events), fragmentations(events), id_totals(events)):
        per = per.join(more, "seq", "left")
    return _summed(per, overall)


def _summed(per: DataFrame, overall: bool) -> DataFrame:
    names = [n for n in per.columns if n != "seq"]
    per = per.na.fill(0, names)
    if overall:
        per = per.unionByName(per.agg(*[F.sum(n).alias(n) for n in names]).select(F.lit("OVERALL").alias("seq"), *names))
    return ratios(per)


_KINDS = {"num_matches": "MATCH", "num_switches": "SWITCH", "num_transfer": "TRANSFER", "num_ascend": "ASCEND", "num_migrate": "MIGRATE", "num_false_positives": "FP", "num_misses": "MISS"}
SUMMARY = "seq string, num_frames long, " + ", ".join(f"{n} long" for n in _KINDS) + ", num_detections long, num_objects long, num_predictions long, num_unique_objects long, sum_d double, mostly_tracked long, partially_tracked long, mostly_lost long, num_fragmentations long, idfp long, idfn long"


def _totals(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums (key, n) of counts by key, keys being numbers or rows of them."""
    keys, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    every, at = np.unique(keys, axis=0, return_inverse=True)
    return every, np.bincount(at.ravel(), n, len(every)).astype(np.int64)


def summary_of(frames: DataFrame, *, max_switch_time: float = float("inf"), overall: bool = True) -> DataFrame:
    """mot_summary() of the event log of frames (FRAMES): a sequence's events are counted in the task that makes them, _FRAMES frames at a time, and none are kept."""

    def one(t: pa.Table) -> pa.Table:
        n, seq = dict.fromkeys(SUMMARY.replace(" long", "").replace(" double", "").split(", ")[1:], 0), t.column("seq")[0]
        n["num_frames"], n["sum_d"] = len(pa.compute.unique(t.column("frame"))), 0.0
        ids, hits, seen, met = [], [], {"oid": [], "hid": []}, []
        for e in _logged(t, max_switch_time):
            kind = e.column("type").combine_chunks().dictionary_encode()
            kind = np.array(kind.dictionary.to_pylist(), object)[kind.indices.to_numpy()]
            frame, has = e.column("frame").to_numpy(), {c: e.column(c).is_valid().to_numpy() for c in ("oid", "hid", "d")}
            own = {c: pa.compute.fill_null(e.column(c), 0).to_numpy() for c in ("oid", "hid")}
            base, raw = ~np.isin(kind, ASIDE), kind == "RAW"
            for name, k in _KINDS.items():
                n[name] += int((kind == k).sum())
            n["num_objects"] += int((base & has["oid"]).sum())
            n["num_predictions"] += int((base & has["hid"]).sum())
            n["sum_d"] += float(e.column("d").to_numpy()[base & has["d"]].sum())
            ids.append(own["oid"][base & has["oid"]])
            hits.append(kind[base & has["oid"]] != "MISS")
            for c, parts in seen.items():  # a frame is in one part
                at = np.unique(np.column_stack([frame, own[c]])[raw & has[c]], axis=0)[:, 1]
                parts.append(np.unique(at, return_counts=True))
            pair = raw & has["oid"] & has["hid"]
            met.append(_totals([(np.column_stack([own["oid"], own["hid"]])[pair], has["d"][pair].astype(np.int64))]))
        oid, hit = np.concatenate(ids), np.concatenate(hits)
        order = np.argsort(oid, kind="stable")
        oid, hit = oid[order], hit[order]
        objects, start, size = np.unique(oid, return_index=True, return_counts=True)
        n["num_detections"], n["num_unique_objects"] = n["num_matches"] + n["num_switches"], len(objects)
        if len(objects):
            ratio = np.add.reduceat(hit.astype(np.int64), start) / size
            n["mostly_tracked"], n["mostly_lost"] = int((ratio >= 0.8).sum()), int((ratio < 0.2).sum())
            n["partially_tracked"] = len(objects) - n["mostly_tracked"] - n["mostly_lost"]
            begins = hit & np.r_[True, (oid[1:] != oid[:-1]) | ~hit[:-1]]
            n["num_fragmentations"] = int(np.maximum(np.add.reduceat(begins.astype(np.int64), start) - 1, 0).sum())
        pair, many = _totals(met)
        shared = _shared_frames([(int(a), int(b), float(k)) for (a, b), k in zip(pair, many, strict=True)])
        n["idfp"], n["idfn"] = (int(_totals(seen[c])[1].sum() - shared) for c in ("hid", "oid"))
        return pa.table([pa.array([seq], pa.string()), *[pa.array([v], pa.float64() if c == "sum_d" else pa.int64()) for c, v in n.items()]], names=["seq", *n])

    # read twice, for OVERALL
    return _summed(stored(frames.groupBy("seq").applyInArrow(one, SUMMARY), "summary"), overall)
