"""The registered queries of the library's own operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import agglomerate, classification, events, lap, links, neighbors, nms, online, pairs, tracks
from ..operators.storage import stored
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _counted(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END): the same, but a BIGINT."""
    out, at = "", 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 1, i + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[at:i] + f"count(CASE WHEN {sql[i + 9 : j - 1]} THEN 1 END)"
        at = j
    return out + sql[at:]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _counted(sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


C = F.col
BOX = ("x", "y", "w", "h")
IOU = """CASE WHEN greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) = 0 THEN 0.0
  ELSE greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)
  / (a.w * a.h + b.w * b.h - greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)) END"""
BASE = f"WITH gt AS ({t.GT_SQL}), hyp AS ({t.HYP_SQL}), track AS ({t.TRACK_SQL}), clf AS ({t.CLF_SQL}), reg AS ({t.REG_SQL}), vec AS ({t.VEC_SQL})"
PAIRS = f"{BASE}, pair AS (SELECT a.frame, a.id AS a, b.id AS b, 1 - {IOU} AS distance FROM gt a JOIN hyp b ON a.frame = b.frame)"
MATCH = f"""{PAIRS}, near AS (SELECT *, row_number() OVER (PARTITION BY frame, a ORDER BY distance, b) AS ra, row_number() OVER (PARTITION BY frame, b ORDER BY distance, a) AS rb FROM pair WHERE distance < 0.5),
match AS (SELECT frame, a, b, distance FROM near WHERE ra = 1 AND rb = 1)"""
#: An event log by mutual nearest neighbours: MATCH, MISS and FP rows, with the frame's remainder by 4 as the sequence.
LOG = f"""{MATCH}, log AS (
  SELECT CAST(frame % 4 AS VARCHAR) AS seq, frame, 'MATCH' AS type, a AS oid, b AS hid, distance AS d FROM match
  UNION ALL SELECT CAST(frame % 4 AS VARCHAR), frame, 'MISS', id, NULL, NULL FROM gt WHERE NOT EXISTS (SELECT 1 FROM match m WHERE m.frame = gt.frame AND m.a = gt.id)
  UNION ALL SELECT CAST(frame % 4 AS VARCHAR), frame, 'FP', NULL, id, NULL FROM hyp WHERE NOT EXISTS (SELECT 1 FROM match m WHERE m.frame = hyp.frame AND m.b = hyp.id))"""


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.mutual_nearest(pairs.iou_pairs(t.gt(spark, sf), t.hyp(spark, sf)), max_distance=0.5)


def same(a: str, b: str) -> Column:
    """a = b, as a condition beside the frame's equality: as a key of the join it would ask for another exchange of all boxes."""
    return C(a).bitwiseXOR(C(b)) == 0


def log(spark: SparkSession, sf: str) -> DataFrame:
    m, g, h = matched(spark, sf), t.gt(spark, sf).select("frame", "id"), t.hyp(spark, sf).select("frame", "id")
    # each object with its match, then each hypothesis beside its own: nothing is met twice
    g = g.select(C("frame").alias("_f"), C("id").alias("oid")).join(m, (C("_f") == C("frame")) & same("oid", "a"), "left").select("_f", "oid", "b", C("distance").alias("d"))
    rows = g.join(h.select("frame", C("id").alias("hid")), (C("_f") == C("frame")) & same("b", "hid"), "full")
    kind = F.when(C("oid").isNull(), "FP").when(C("hid").isNull(), "MISS").otherwise("MATCH")
    frame = F.coalesce("_f", "frame")
    return rows.select((frame % 4).cast("string").alias("seq"), frame.alias("frame"), kind.alias("type"), "oid", "hid", "d", F.coalesce("oid", "hid").alias("event"))


# ---- boxes


@query(f"{BASE} SELECT frame, id, round(w * h, 6) AS area FROM gt")
def box_area(spark: SparkSession, sf: str) -> DataFrame:
    g = t.gt(spark, sf)
    return rounded(g.select("frame", "id", boxes.corner_area(*boxes.to_corners(*[C(c) for c in BOX])).alias("area")), "area")


@query(f"{PAIRS} SELECT frame, a, b, round(distance, 6) AS distance FROM pair WHERE distance <= 0.9")
def box_iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.iou_pairs(t.gt(spark, sf), t.hyp(spark, sf), max_distance=0.9), "distance")


@query(f"{BASE} SELECT frame, id, round(x + w / 2, 6) AS cx, round(y + h / 2, 6) AS cy, round(w / NULLIF(h, 0), 6) AS aspect, h FROM gt")
def box_to_xyah(spark: SparkSession, sf: str) -> DataFrame:
    cx, cy, a, h = boxes.to_aspect(*[C(c) for c in BOX])
    return rounded(t.gt(spark, sf).select("frame", "id", cx.alias("cx"), cy.alias("cy"), a.alias("aspect"), h.alias("h")), "cx", "cy", "aspect")


@query(f"{BASE} SELECT frame, id, round((x + w / 2) / 640, 4) AS cx, round((y + h / 2) / 500, 4) AS cy, round(w / 640, 4) AS rw, round(h / 500, 4) AS rh FROM gt")
def box_to_yolo(spark: SparkSession, sf: str) -> DataFrame:
    cols = boxes.to_relative(*[C(c) for c in BOX], F.lit(640.0), F.lit(500.0))
    return rounded(t.gt(spark, sf).select("frame", "id", *[c.alias(n) for c, n in zip(cols, ("cx", "cy", "rw", "rh"), strict=True)]), "cx", "cy", "rw", "rh", digits=4)


def _clip_sql(a: str, b: str, last: int, n: str) -> str:
    """Ends of a span within 0 to last; one without length is widened by 5, inwards at the far end."""
    lo, hi = f"greatest(least({a}, {b}, {last}), 0)", f"greatest(least(greatest({a}, {b}), {last}), 0)"
    return f"CAST(round_even(CASE WHEN {lo} = {hi} AND {lo} + 5 > {last} THEN greatest({lo} - 5, 0) ELSE {lo} END, 0) AS INT) AS {n}1, CAST(round_even(CASE WHEN {lo} = {hi} AND {lo} + 5 <= {last} THEN {hi} + 5 ELSE {hi} END, 0) AS INT) AS {n}2"


@query(f"{BASE} SELECT frame, id, x >= 0 AND x < x + w AND x + w < 100 AND y >= 0 AND y < y + h AND y + h < 80 AS valid, {_clip_sql('x', 'x + w', 99, 'x')}, {_clip_sql('y', 'y + h', 79, 'y')} FROM gt")
def box_clip_validate(spark: SparkSession, sf: str) -> DataFrame:
    corners = boxes.to_corners(*[C(c) for c in BOX])
    x1, y1, x2, y2 = boxes.clip(*corners, F.lit(100.0), F.lit(80.0))
    return t.gt(spark, sf).select("frame", "id", boxes.is_valid(*corners, F.lit(100.0), F.lit(80.0)).alias("valid"), x1.alias("x1"), x2.alias("x2"), y1.alias("y1"), y2.alias("y2"))


# ---- joins of frames


@query(f"{BASE}, a AS (SELECT frame, count(*) AS n FROM gt GROUP BY frame), b AS (SELECT frame, count(*) AS n FROM hyp GROUP BY frame) SELECT frame, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b USING (frame)")
def frame_full_align(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.align_frames(t.gt(spark, sf), t.hyp(spark, sf))


@query(f"{MATCH} SELECT frame, a, b, round(distance, 6) AS distance FROM match")
def iou_match_mutual_nn(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matched(spark, sf), "distance")


@query(f"{BASE} SELECT a.frame, a.id AS a, b.id AS b, round(pow(a.x - b.x, 2) + pow(a.y - b.y, 2), 6) AS distance FROM gt a JOIN hyp b ON a.frame = b.frame WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 400")
def l2_pairs_gated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.squared_pairs(t.gt(spark, sf), t.hyp(spark, sf), ["x", "y"], max_squared=400.0), "distance")


@query(f"{BASE} SELECT query_id, id, rank, round(distance, 6) AS distance FROM (SELECT a.id AS query_id, b.id AS id, 1 - list_cosine_similarity(a.v, b.v) AS distance, CAST(row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_cosine_similarity(a.v, b.v), 9), b.id) AS INT) AS rank FROM vec a JOIN vec b ON a.id % 20 = 0 AND a.id <> b.id) WHERE rank <= 5")
def cosine_pairs_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = t.vectors(spark, sf).select("id", "v")
    return rounded(neighbors.nearest(v.filter("id % 20 = 0"), v, k=5, metric="cosine"), "distance")


@query(f"""{BASE}, c AS (SELECT a.seq, b.frame, a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.x + a.w - b.x - b.w, 2) + pow(a.y + a.h - b.y - b.h, 2)) AS distance FROM track a JOIN track b ON a.seq = b.seq AND b.frame = a.frame + 1)
SELECT seq, a, b, round(distance, 6) AS distance, 1 AS gap FROM c WHERE distance < 60""")
def gap_band_links(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pairs.gap_links(t.tracks(spark, sf).select("seq", "frame", "id", *BOX), max_gap=1, max_distance=60.0), "distance")


@query(f"{MATCH} SELECT hyp.frame, hyp.id FROM hyp LEFT JOIN (SELECT m.frame, m.b FROM match m JOIN gt ON gt.frame = m.frame AND gt.id = m.a WHERE gt.class_id IN (2, 7)) x ON x.frame = hyp.frame AND x.b = hyp.id WHERE x.b IS NULL")
def distractor_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    bad = t.gt(spark, sf).filter("class_id in (2, 7)").select("frame", C("id").alias("a"))
    drop = matched(spark, sf).join(bad, ["frame", "a"], "left_semi").select("frame", C("b").alias("id"))
    return t.hyp(spark, sf).join(drop, ["frame", "id"], "left_anti").select("frame", "id")


# ---- detection metrics


@query(f"{LOG} SELECT count_if(type = 'MATCH') AS tp, count_if(type = 'FP') AS fp, count_if(type = 'MISS') AS fn, round(count_if(type = 'MATCH') / NULLIF(count_if(type <> 'MISS'), 0), 6) AS precision, round(count_if(type = 'MATCH') / NULLIF(count_if(type <> 'FP'), 0), 6) AS recall, round(2 * count_if(type = 'MATCH') / NULLIF(2 * count_if(type = 'MATCH') + count_if(type = 'FP') + count_if(type = 'MISS'), 0), 6) AS f1 FROM log")
def det_precision_recall_f1(spark: SparkSession, sf: str) -> DataFrame:
    n = log(spark, sf).agg(F.count_if(C("type") == "MATCH").alias("tp"), F.count_if(C("type") == "FP").alias("fp"), F.count_if(C("type") == "MISS").alias("fn"))
    tp, fp, fn = C("tp"), C("fp"), C("fn")
    return rounded(n.select(tp, fp, fn, events.share(tp, tp + fp).alias("precision"), events.share(tp, tp + fn).alias("recall"), events.share(2 * tp, 2 * tp + fp + fn).alias("f1")), "precision", "recall", "f1")


DET = f"{MATCH}, det AS (SELECT hyp.score, CASE WHEN m.b IS NULL THEN 0 ELSE 1 END AS hit FROM hyp LEFT JOIN match m ON m.frame = hyp.frame AND m.b = hyp.id), cum AS (SELECT score, sum(sum(hit)) OVER (ORDER BY score DESC) AS tps, sum(sum(1 - hit)) OVER (ORDER BY score DESC) AS fps FROM det GROUP BY score)"


def detections(spark: SparkSession, sf: str) -> DataFrame:
    m = matched(spark, sf).select(C("frame").alias("_f"), "b")
    return t.hyp(spark, sf).join(m, (C("frame") == C("_f")) & same("id", "b"), "left").select("score", C("b").isNotNull().cast("int").alias("hit"))


@query(f"{DET} SELECT score, round(tps / (tps + fps), 6) AS precision, round(tps / (SELECT count(*) FROM gt), 6) AS recall FROM cum")
def det_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    n = t.gt(spark, sf).agg(F.count("*").alias("n"))
    c = classification.thresholds(detections(spark, sf), "hit", "score").crossJoin(F.broadcast(n))
    return rounded(c.select("score", (C("tps") / (C("tps") + C("fps"))).alias("precision"), (C("tps") / C("n")).alias("recall")), "precision", "recall")


@query(f"{DET}, pr AS (SELECT tps / (tps + fps) AS precision, tps / (SELECT count(*) FROM gt) AS recall FROM cum) SELECT round(avg(p), 6) AS ap FROM (SELECT coalesce((SELECT max(precision) FROM pr WHERE recall >= r.range / 10.0), 0) AS p FROM range(1, 11) r)")
def det_ap_recall_grid(spark: SparkSession, sf: str) -> DataFrame:
    pr = det_pr_curve_exact(spark, sf)
    grid = [F.coalesce(F.max(F.when(C("recall") >= k / 10.0, C("precision"))), F.lit(0.0)) for k in range(1, 11)]
    return rounded(pr.agg((sum(grid[1:], grid[0]) / 10).alias("ap")), "ap")


def det_pr_curve_exact(spark: SparkSession, sf: str) -> DataFrame:
    n = t.gt(spark, sf).agg(F.count("*").alias("n"))
    c = classification.thresholds(detections(spark, sf), "hit", "score").crossJoin(F.broadcast(n))
    return c.select((C("tps") / (C("tps") + C("fps"))).alias("precision"), (C("tps") / C("n")).alias("recall"))


# ---- event metrics

COUNTS = "count(DISTINCT frame) AS num_frames, count_if(type = 'MATCH') AS num_matches, count_if(type = 'FP') AS num_false_positives, count_if(type = 'MISS') AS num_misses, count(oid) AS num_objects, count(hid) AS num_predictions, count(DISTINCT oid) AS num_unique_objects"
COUNTED = ["num_frames", "num_matches", "num_false_positives", "num_misses", "num_objects", "num_predictions", "num_unique_objects"]


@query(f"{LOG} SELECT seq, {COUNTS} FROM log GROUP BY seq")
def mot_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_counts(log(spark, sf)).select("seq", *COUNTED)


@query(f"{LOG}, s AS (SELECT seq, {COUNTS} FROM log GROUP BY seq) SELECT seq, {', '.join(COUNTED)} FROM s UNION ALL SELECT 'OVERALL', {', '.join(f'CAST(sum({c}) AS BIGINT)' for c in COUNTED)} FROM s")
def mot_overall_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_counts(log(spark, sf), overall=True).select("seq", *COUNTED)


@query(f"{LOG} SELECT seq, oid, round(count_if(type <> 'MISS') / count(*), 6) AS ratio FROM log WHERE oid IS NOT NULL GROUP BY seq, oid")
def mot_track_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events.track_ratios(log(spark, sf)), "ratio")


@query(f"{LOG}, r AS (SELECT seq, oid, count_if(type <> 'MISS') / count(*) AS ratio FROM log WHERE oid IS NOT NULL GROUP BY seq, oid) SELECT seq, count_if(ratio >= 0.8) AS mostly_tracked, count_if(ratio >= 0.2 AND ratio < 0.8) AS partially_tracked, count_if(ratio < 0.2) AS mostly_lost FROM r GROUP BY seq")
def mot_mt_pt_ml(spark: SparkSession, sf: str) -> DataFrame:
    return events.track_quality(log(spark, sf))


@query(f"{LOG}, w AS (SELECT seq, type <> 'MISS' AS hit, lag(type <> 'MISS') OVER o AS before, max(CASE WHEN type <> 'MISS' THEN 1 ELSE 0 END) OVER (PARTITION BY seq, oid ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM log WHERE oid IS NOT NULL WINDOW o AS (PARTITION BY seq, oid ORDER BY frame)) SELECT seq, count_if(NOT hit AND before AND later = 1) AS num_fragmentations FROM w GROUP BY seq")
def mot_fragmentations(spark: SparkSession, sf: str) -> DataFrame:
    return events.fragmentations(log(spark, sf))


@query(f"{LOG} SELECT seq, round(1 - count_if(type IN ('MISS', 'FP')) / NULLIF(count(oid), 0), 6) AS mota, round(sum(d) / NULLIF(count_if(type = 'MATCH'), 0), 6) AS motp FROM log GROUP BY seq")
def mot_mota_motp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events.ratios(events.event_counts(log(spark, sf))).select("seq", "mota", "motp"), "mota", "motp")


@query(f"{PAIRS} SELECT CAST(frame % 4 AS VARCHAR) AS seq, a AS oid, b AS hid, count(*) AS n FROM pair WHERE distance <= 0.5 GROUP BY ALL")
def id_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs.iou_pairs(t.gt(spark, sf), t.hyp(spark, sf), max_distance=0.5)
    return events.id_pair_counts(p.select((C("frame") % 4).cast("string").alias("seq"), F.lit("RAW").alias("type"), C("a").alias("oid"), C("b").alias("hid"), C("distance").alias("d")))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    g, h = t.gt(spark, sf), t.hyp(spark, sf)
    return events.frames_of(g.select("frame", "id"), h.select("frame", "id"), pairs.iou_pairs(g, h, max_distance=0.5), seq=C("frame") % 64)


@query()
def mot_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_log(_frames(spark, sf))


@query()
def mot_summary(spark: SparkSession, sf: str) -> DataFrame:
    return events.summary_of(_frames(spark, sf))


@query()
def id_global_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return events.id_totals(events.event_log(_frames(spark, sf)).cache())


@query()
def lap_assign(spark: SparkSession, sf: str) -> DataFrame:
    return lap.assign(pairs.iou_pairs(t.gt(spark, sf), t.hyp(spark, sf), max_distance=0.5))


def _nms_sql(columns: str, overlap: float) -> str:
    """Greedy suppression as a recursion down each frame's order, with the list of the boxes kept so far."""
    box = "{'id': o.id, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}"
    cover = "greatest(least(k.x + k.w, o.x + o.w) - greatest(k.x, o.x) + 1, 0) * greatest(least(k.y + k.h, o.y + o.h) - greatest(k.y, o.y) + 1, 0) / ((o.w + 1) * (o.h + 1))"
    return f"""WITH RECURSIVE {BASE[5:]}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) AS r FROM gt),
s(frame, r, kept) AS (SELECT frame, r, [{box}] FROM o WHERE r = 1 UNION ALL SELECT o.frame, o.r, CASE WHEN len(list_filter(s.kept, lambda k: {cover} > {overlap})) = 0 THEN list_append(s.kept, {box}) ELSE s.kept END FROM s JOIN o ON o.frame = s.frame AND o.r = s.r + 1),
f AS (SELECT frame, arg_max(kept, r) AS kept FROM s GROUP BY frame), u AS (SELECT frame, unnest(kept).id AS id, unnest(range(len(kept))) AS pick FROM f) SELECT {columns} FROM gt LEFT JOIN u ON u.frame = gt.frame AND u.id = gt.id"""


@query(_nms_sql("gt.*, CAST(pick AS BIGINT) AS pick", 0.5))
def nms_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return nms.suppress(t.gt(spark, sf), max_overlap=0.5)


COVER = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) + 1, 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) + 1, 0) / ((b.w + 1) * (b.h + 1))"


@query(f"{BASE} SELECT DISTINCT b.frame, b.id FROM gt a JOIN gt b ON a.frame = b.frame AND (a.score > b.score OR a.score = b.score AND a.id < b.id) WHERE {COVER} > 0.5")
def nms_one_round(spark: SparkSession, sf: str) -> DataFrame:
    return nms.suppressed_once(t.gt(spark, sf), max_overlap=0.5)


@query(_nms_sql("gt.frame, gt.id, CASE WHEN pick IS NULL THEN 'nms' WHEN score < 0.1 THEN 'score' END AS fp_flag", 0.4))
def flag_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    return nms.flag_ambiguous(t.gt(spark, sf), max_overlap=0.4, min_score=0.1).select("frame", "id", "fp_flag")


def _agglomerate(spark: SparkSession, sf: str, linkage: str) -> DataFrame:
    d = stored(t.tracks(spark, sf).select("seq", "frame", "id", *BOX), "tracks")
    return agglomerate.agglomerate(d.select("seq", "frame", "id"), pairs.gap_pairs(d, max_gap=3), threshold=60.0, linkage=linkage)


@query()
def agglomerate_complete(spark: SparkSession, sf: str) -> DataFrame:
    return _agglomerate(spark, sf, "complete")


@query()
def agglomerate_average(spark: SparkSession, sf: str) -> DataFrame:
    return _agglomerate(spark, sf, "average")


@query()
def agglomerate_single(spark: SparkSession, sf: str) -> DataFrame:
    return _agglomerate(spark, sf, "single")


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Short sequences of frames with several boxes each."""
    return t.gt(spark, sf).select(F.floor(C("frame") / 40).cast("string").alias("seq"), "frame", "id", *BOX)


@query()
def online_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return online.track_online(_sequences(spark, sf))


@query()
def offline_tracks(spark: SparkSession, sf: str) -> DataFrame:
    team = [agglomerate.Expert(30.0, "complete", frames_a_window=10), agglomerate.Expert(45.0, "single", frames_a_window=20, max_kalman=9.5)]
    return agglomerate.track_offline(_sequences(spark, sf), team)


# ---- links


@query("""WITH e AS (SELECT DISTINCT user_id AS a, user_id // 10 * 10 AS b FROM events), n AS (SELECT a AS node FROM e UNION SELECT b FROM e) SELECT node, CAST(node // 10 * 10 AS BIGINT) AS root FROM n""")
def single_linkage_components(spark: SparkSession, sf: str) -> DataFrame:
    e = t.read(spark, sf, "events").select(C("user_id").alias("a"), F.floor(C("user_id") / 10).cast("long").alias("d")).select("a", (C("d") * 10).alias("b")).distinct()
    return links.components(e)


@query("""WITH e AS (SELECT event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM events), f AS (SELECT user_id, event_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS head, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT node, head, CAST(place AS INT) AS place FROM f WHERE n > 1""")
def link_chains(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.read(spark, sf, "events").select(C("event_id").alias("a"), F.lead("event_id").over(w).alias("b")).filter("b is not null")
    return links.chains(e).select("node", "head", "place")


LINKS = "WITH l1 AS (SELECT event_id AS a, user_id AS b FROM events WHERE event_id % 3 <> 0), l2 AS (SELECT event_id AS a, CASE WHEN event_id % 10 = 1 THEN user_id + 1 ELSE user_id END AS b FROM events WHERE event_id % 4 <> 0)"


@query(f"{LINKS} SELECT count_if(l1.b IS NOT NULL AND l2.b IS NULL) AS only_first, count_if(l1.b IS NULL AND l2.b IS NOT NULL) AS only_second, count_if(l1.b = l2.b) AS same, count_if(l1.b <> l2.b) AS different FROM l1 FULL JOIN l2 ON l1.a = l2.a")
def link_compare(spark: SparkSession, sf: str) -> DataFrame:
    e = t.read(spark, sf, "events")
    l1 = e.filter("event_id % 3 <> 0").select(C("event_id").alias("a"), C("user_id").alias("b"))
    l2 = e.filter("event_id % 4 <> 0").selectExpr("event_id AS a", "CASE WHEN event_id % 10 = 1 THEN user_id + 1 ELSE user_id END AS b")
    return links.compare(l1, l2)


@query("SELECT event_id AS a, CASE WHEN value >= 30 AND event_id % 10 <= 5 THEN user_id ELSE -1 END AS b, round(value, 6) AS confidence, CAST(event_id % 10 AS DOUBLE) AS ambiguity FROM events")
def link_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = t.read(spark, sf, "events").selectExpr("event_id AS a", "user_id AS b", "value AS confidence", "CAST(event_id % 10 AS DOUBLE) AS ambiguity")
    return rounded(links.drop_doubtful(e, min_confidence=30.0, max_ambiguity=5.0).na.fill(-1, ["b"]), "confidence")


# ---- track tables


@query(f"{BASE} SELECT seq, track_id, frame, id FROM (SELECT *, count(*) OVER (PARTITION BY seq, track_id) AS n FROM track) WHERE n >= 5")
def track_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.longer_than(t.tracks(spark, sf), 5).select("seq", "track_id", "frame", "id")


@query(f"{BASE} SELECT seq, track_id, frame, id FROM (SELECT *, round(avg(score) OVER (PARTITION BY seq, track_id), 9) AS s FROM track) WHERE s >= 50")
def track_score_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.scored_over(t.tracks(spark, sf), 50.0).select("seq", "track_id", "frame", "id")


MAJOR = "major AS (SELECT seq, track_id, class_id FROM (SELECT seq, track_id, class_id, row_number() OVER (PARTITION BY seq, track_id ORDER BY count(*) DESC, min(frame), class_id) AS r FROM track GROUP BY seq, track_id, class_id) WHERE r = 1)"


@query(f"{BASE}, {MAJOR} SELECT seq, track_id, class_id FROM major")
def track_majority_class(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.majority_class(t.tracks(spark, sf))


@query(f"{BASE}, {MAJOR} SELECT seq, track_id, id, track.class_id, major.class_id AS new_class FROM track JOIN major USING (seq, track_id) WHERE track.class_id <> major.class_id")
def track_class_corrections(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.class_corrections(t.tracks(spark, sf)).select("seq", "track_id", "id", "class_id", "new_class")


@query(f"{BASE} SELECT seq, track_id, count(*) AS n, min(frame) AS first, max(frame) AS last, max(frame) - min(frame) + 1 - count(DISTINCT frame) AS holes FROM track GROUP BY seq, track_id")
def track_holes(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.lengths(t.tracks(spark, sf))


@query(f"{BASE} SELECT seq, track_id, n, first, holes, CAST(row_number() OVER (PARTITION BY seq ORDER BY n DESC, first, track_id) AS INT) AS rank FROM (SELECT seq, track_id, count(*) AS n, min(frame) AS first, max(frame) - min(frame) + 1 - count(DISTINCT frame) AS holes FROM track GROUP BY seq, track_id)")
def track_order(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.by_length(t.tracks(spark, sf)).select("seq", "track_id", "n", "first", "holes", "rank")


@query(f"""{BASE}, w AS (SELECT seq, track_id, frame, x, y, w, h, lead(frame) OVER o AS f2, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(w) OVER o AS w2, lead(h) OVER o AS h2 FROM track WINDOW o AS (PARTITION BY seq, track_id ORDER BY frame)),
g AS (SELECT *, unnest(range(frame + 1, f2)) AS f1 FROM w WHERE f2 - frame > 1 AND f2 - frame < 50)
SELECT seq, track_id, frame, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, false AS filled FROM track
UNION ALL SELECT seq, track_id, f1, round(x + (x2 - x) * (f1 - frame) / (f2 - frame), 6), round(y + (y2 - y) * (f1 - frame) / (f2 - frame), 6), round(w + (w2 - w) * (f1 - frame) / (f2 - frame), 6), round(h + (h2 - h) * (f1 - frame) / (f2 - frame), 6), true FROM g""")
def track_gap_fill_linear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tracks.fill_linear(t.tracks(spark, sf), max_share=None, max_gap=50), *BOX)
