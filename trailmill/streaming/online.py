"""Online tracking of a stream of frames."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import events
from ..operators.online import TRACKS, Track, Tracker, feature_rows

FRAMES = "seq string, frame long, boxes array<struct<id:long,x:double,y:double,w:double,h:double,feature:array<float>>>"


def track_stream(frames: DataFrame, *, delay: int = 0, **how: float) -> DataFrame:
    """TRACKS of a stream of frames (FRAMES, one row a frame). The state of a sequence is its tracker and the frames that wait.

    Frames of a sequence may come out of order by up to delay frames: a frame is taken once one delay or more ahead of it has come. Later ones than that are dropped. Frames that never
    come count as without boxes.
    """
    state_schema = "data binary"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, waiting, upcoming, newest = Tracker(**how), {}, None, -1
        if state.exists:
            plain, waiting, upcoming, newest = pickle.loads(state.get[0])  # noqa: S301
            vars(tracker).update(plain | {"tracks": [Track(**t) for t in plain["tracks"]]})
        for b in batches:
            for r in b.itertuples(index=False):
                if upcoming is None or r.frame >= upcoming:
                    waiting[r.frame] = [dict(x) for x in r.boxes]
                    newest = max(newest, r.frame)
        rows = []
        while waiting and min(waiting) + delay <= newest:
            at = min(waiting) if upcoming is None else upcoming
            boxes = waiting.pop(at, [])
            m = np.array([[x["x"], x["y"], x["w"], x["h"]] for x in boxes], float).reshape(len(boxes), 4)
            feats = feature_rows(pd.Series([x["feature"] for x in boxes], dtype=object)) if len(boxes) else np.zeros((0, 0))
            rows += [(key[0], at, n, *box) for n, box in tracker.step(m, feats)]
            upcoming = at + 1
        plain = vars(tracker) | {"tracks": [vars(t) for t in tracker.tracks]}
        state.update((pickle.dumps((plain, waiting, upcoming, newest)),))
        yield pd.DataFrame(rows, columns=["seq", "frame", "track_id", "x", "y", "w", "h"])

    return frames.groupBy("seq").applyInPandasWithState(step, TRACKS, state_schema, "append", GroupStateTimeout.NoTimeout)


def event_stream(frames: DataFrame, *, max_switch_time: float = float("inf")) -> DataFrame:
    """The event log of a stream of frames (seq, frame, oids, hids, pairs), which must come in order within a sequence."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = events.EventLog(max_switch_time)
        if state.exists:
            vars(log).update(pickle.loads(state.get[0]))  # noqa: S301
        rows = []
        for r in pd.concat(list(batches)).sort_values("frame").itertuples(index=False):
            oids, hids = [int(x) for x in r.oids], [int(x) for x in r.hids]
            d = np.full((len(oids), len(hids)), np.nan)
            for p in r.pairs:
                d[oids.index(p["o"]), hids.index(p["h"])] = p["d"]
            rows += [(key[0], r.frame, k, *e) for k, e in enumerate(log.frame(r.frame, oids, hids, d))]
        state.update((pickle.dumps(vars(log)),))
        yield pd.DataFrame(rows, columns=["seq", "frame", "event", "type", "oid", "hid", "d"]).astype({"oid": "Int64", "hid": "Int64", "event": "int32", "d": "float64"})

    return frames.groupBy("seq").applyInPandasWithState(step, events.EVENTS, "data binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, *, time: str = "ts", key: str = "event_type", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n and mean value in windows of time; rows later than the watermark are dropped."""
    w = F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")
