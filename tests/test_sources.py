"""Readers and writers on small files written here."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_mot(spark, tmp_path):
    p = put(tmp_path / "s1/gt.txt", "1,1,399,182,121,229,1,-1,-1,-1\n1, 3,113.84,274.5,57.307,130.05,-1,-1,-1,-1\n\n2\t4 10 20 30 40 0.5 2 0.9 0\n")
    rows = readers.read_mot(spark, p).orderBy("frame", "id").collect()
    assert [(r.frame, r.id, r.x, r.y, r.confidence) for r in rows] == [(1, 1, 398.0, 181.0, 1.0), (1, 3, 112.84, 273.5, -1.0), (2, 4, 9.0, 19.0, 0.5)]
    assert readers.read_tracks(spark, p, "mot16", min_confidence=0.6).count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        readers.read_tracks(spark, p, "nope")


def test_vatic(spark, tmp_path):
    p = put(tmp_path / "v.txt", '0 412 10 842 124 1 0 0 1 "pc" "attr1" "attr3"\n0 412 10 842 124 2 1 0 0 "pc"\n')
    got = readers.attribute_columns(readers.read_vatic(spark, p)).orderBy("frame").collect()
    assert (got[0].w, got[0].h, got[0].label, got[0].attr1, got[0].attr3, got[1].attr1, got[1].lost) == (430.0, 114.0, "pc", True, True, False, True)


def test_detrac(spark, tmp_path):
    t = '<target id="{i}"><box left="1.5" top="2" width="3" height="4"/></target>'
    p = put(tmp_path / "d.xml", f'<sequence><frame num="1"><target_list>{t.format(i=1)}{t.format(i=2)}</target_list></frame><frame num="2"><target_list>{t.format(i=1)}</target_list></frame></sequence>')
    assert {(r.frame, r.id, r.x, r.h) for r in readers.read_detrac_xml(spark, p).collect()} == {(1, 1, 1.5, 4.0), (1, 2, 1.5, 4.0), (2, 1, 1.5, 4.0)}


def test_text_and_json(spark, tmp_path):
    p = put(tmp_path / "a.txt", "0 0.5 1 2 3.5 4.5\n1 0.4 1 2 3 4\n")
    assert [(r.x2, r.y2, r.score) for r in readers.read_scored_boxes(spark, p, min_score=0.4, strict=True).collect()] == [(4, 4, 0.5)]
    assert readers.read_scored_boxes(spark, p, min_score=0.4).count() == 2
    with pytest.raises(Exception, match="out of range"):
        readers.read_scored_boxes(spark, put(tmp_path / "b.txt", "0 1.5 1 2 3 4\n")).collect()
    j = put(tmp_path / "d.json", json.dumps([{"image_path": "/r/a/b/1.jpg", "category_id": 2, "bbox": [1, 2, 3, 4], "score": 0.9}, {"image_path": "/r/a/b/1.jpg", "category_id": 2, "bbox": [1, 2, 3, 4], "score": 0.1}]))
    assert [(r.image, r.w) for r in readers.read_json_detections(spark, j, min_score=0.5).collect()] == [("b/1.jpg", 3.0)]
    y = put(tmp_path / "y.json", json.dumps([{"frame_id": 1, "filename": "x.jpg", "objects": [{"class_id": 0, "name": "p", "relative_coordinates": {"center_x": 0.5, "center_y": 0.5, "width": 0.2, "height": 0.4}, "confidence": 0.8}]}]))
    r = readers.read_darknet_json(spark, y, width=100, height=50).head()
    assert (r.x1, r.y1, r.x2, r.y2) == (40, 15, 60, 35)


def test_small_formats(spark, tmp_path):
    ini = readers.read_ini(spark, put(tmp_path / "seqinfo.ini", "[Sequence]\nname=A\nframeRate=30\n"))
    assert {(r.key, r.value) for r in ini.collect()} == {("name", "A"), ("frameRate", "30")}
    assert [r.seq for r in readers.read_sequence_map(spark, put(tmp_path / "map", "name\n#x\n\nA\nB\n")).orderBy("seq").collect()] == ["A", "B"]
    assert readers.read_lanes(spark, put(tmp_path / "l.txt", "1 2 3 4\n")).head().y2 == 4
    m = np.arange(24, dtype=np.float32).reshape(2, 12)
    np.save(tmp_path / "m.npy", m)
    got = readers.read_npy_detections(spark, str(tmp_path / "m.npy")).orderBy("frame").collect()
    assert got[1].frame == 12 and got[1].feature == [22.0, 23.0]


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.txt",)], "p string")
    assert tuple(df.select(readers.path_tail(F.col("p")), readers.file_stem(F.col("p")), readers.replace_extension(F.col("p"), "xml")).head()) == ("b/c.txt", "c", "/a/b/c.xml")


def test_skip_frames(spark):
    df = spark.range(1, 8).withColumnRenamed("id", "frame")
    assert [r.frame for r in readers.skip_frames(df, 1).orderBy("frame").collect()] == [1, 2, 3, 4]
    assert readers.skip_frames(df, 0).count() == 7


def test_mot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", 0, 0, 1.0, 2.0, 3.0, 4.0, 1), ("s2", 5, 1, 1.25, 2.0, 3.0, 4.0, 1)], "seq string, frame long, track_id long, x double, y double, w double, h double, class_id int")
    writers.write_mot(df, str(tmp_path / "out"))
    back = readers.read_mot(spark, [str(p) for p in tmp_path.glob("out/*/*.txt")], one_based=False)
    assert {(r.frame, r.id, r.x) for r in back.collect()} == {(1, 1, 1.0), (6, 2, 1.25)}
    writers.write_tracks(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t")).count() == 2


def test_boxes_and_labels(spark, tmp_path):
    cols = "image string, class_id int, x1 int, y1 int, x2 int, y2 int"
    old = spark.createDataFrame([("a", 0, 0, 0, 10, 10)], cols)
    new = spark.createDataFrame([("a", 0, 0, 0, 10, 9, 1), ("a", 0, 50, 50, 60, 60, 2)], cols + ", place int")
    keep = lambda r: {(x.x1, x.y2) for x in writers.add_boxes(old, new, threshold=0.5, replace=r).collect()}
    assert keep(True) == {(0, 9), (50, 60)} and keep(False) == {(0, 10), (50, 60)}
    assert writers.append_new(old, old.unionByName(new.drop("place")), ["class_id", "x1", "y1", "x2", "y2"]).count() == 3
    writers.write_boxes(old, str(tmp_path / "b"))
    assert readers.read_boxes(spark, [str(p) for p in tmp_path.glob("b/*/*.txt")]).head().x2 == 10
    writers.write_yolo(old, str(tmp_path / "y"), width=F.lit(100.0), height=F.lit(50.0))
    r = readers.read_yolo(spark, [str(p) for p in tmp_path.glob("y/*/*.txt")]).head()
    assert (r.cx, r.cy, r.w, r.h) == (0.05, 0.1, 0.1, 0.2)
    writers.write_voc(old.withColumn("label", F.lit("cat")), str(tmp_path / "v"))
    assert "<name>cat</name>" in "".join(p.read_text() for p in tmp_path.glob("v/part*"))


def test_render(spark):
    df = spark.createDataFrame([("OVERALL", 0.5, 0.25, 3), ("a", 0.5, None, 3)], "seq string, mota double, motp double, num_misses long")
    out = writers.render(df).splitlines()
    assert out[0].split() == ["seq", "MOTA", "MOTP", "FN"] and out[1].split() == ["a", "50.0%", "nan", "3"]


def test_svmlight(spark, tmp_path):
    p = put(tmp_path / "s.txt", "# head\n1 qid:3 2:0.5 10:-5.2 # note\n-1.5 5:1\n")
    got = sorted((r.label, r.qid, r.idx, r.val) for r in readers.read_svmlight(spark, p).collect())
    assert got == [(-1.5, None, [5], [1.0]), (1.0, 3, [2, 10], [0.5, -5.2])]


def test_synthetic(spark):
    from trailmill.sources import synthetic

    b = synthetic.blobs(spark, 300, centres=3).collect()
    assert len({r.label for r in b}) == 3 and b == synthetic.blobs(spark, 300, centres=3).repartition(5).orderBy("id").collect()
    z = spark.range(4000).select(synthetic.normal(1, F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).head()
    assert abs(z[0]) < 0.06 and abs(z[1] - 1) < 0.06
    assert synthetic.moons(spark, 10).count() == synthetic.circles(spark, 10).count() == synthetic.classification(spark, 10).count() == 10
