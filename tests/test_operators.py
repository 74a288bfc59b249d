import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probtopk.functions import distribution as D
from probtopk.operators import detections, difference, metrics, ordinals, sampling, scoring, windows
from probtopk.sources import frames as sources


def test_split_sizes():
    assert sampling.split_sizes(1000, 0.005, 30) == (5, 30)
    assert sampling.split_sizes(999, 0.01, 1) == (9, 999)


def test_split_is_exact_and_disjoint(spark):
    f = spark.range(50).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_id"))
    counts = {r["split"]: r["count"] for r in sampling.split_frames(f, 5, 7).groupBy("split").count().collect()}
    assert counts == {"train": 5, "valid": 7, "test": 38}


def test_ordinal_over_gaps_and_spans(spark):
    ids = [0, 3, 4, 100, 101, 5000, 70000, 70001]
    df = spark.createDataFrame([(v, i) for v in "ab" for i in ids], "video_id string, frame_id long")
    got = ordinals.with_ordinal(df, "video_id", "frame_id", span=64).where("video_id = 'b'").orderBy("frame_id").collect()
    assert [r["pos"] for r in got] == list(range(len(ids)))


def test_segments_of_seven_frames(spark):
    rows = [("v", i, [float(i == 1)]) for i in range(7)]
    test = spark.createDataFrame(rows, "video_id string, frame_id long, features array<float>")
    got = {r["frame_id"]: r for r in difference.difference_detect(test, 0.5, 3).collect()}
    assert [got[i]["ref_id"] for i in range(7)] == [1, 1, 1, 4, 4, 4, 6]
    assert [i for i in range(7) if got[i]["discarded"]] == [3, 5]
    lists = {r["frame_id"]: r["mirrors"] for r in difference.mirror_lists(difference.difference_detect(test, 0.5, 3)).collect()}
    assert lists == {0: [], 1: [], 2: [], 4: [3, 5], 6: []}


def test_box_blobs(spark):
    boxes = np.arange(14, dtype=np.float32).reshape(2, 7)
    df = spark.createDataFrame([(1, boxes.tobytes()), (2, b""), (3, None)], "frame_id long, blob binary")
    got = sources.decode_box_blobs(df).orderBy("det_id").toPandas()
    assert got["frame_id"].tolist() == [1, 1] and got["det_id"].tolist() == [0, 1] and got["cls"].tolist() == [6, 13]
    assert got["x1"].tolist() == [0.0, 7.0]


def test_frame_dir_is_in_natural_order(spark, tmp_path):
    for n in (10, 2, 1):
        (tmp_path / f"{n}.jpg").write_bytes(b"x%d" % n)
    (tmp_path / "a.txt").write_text("no")
    got = sources.read_frame_dir(spark, f"file://{tmp_path}").orderBy("frame_id").collect()
    assert [(r["frame_id"], r["name"]) for r in got] == [(0, "1.jpg"), (1, "2.jpg"), (2, "10.jpg")]


def test_stage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 0.5])], "frame_id long, pi array<double>")
    for _ in range(2):
        sources.save_stage(df, str(tmp_path), "mix")
    assert sources.load_stage(spark, str(tmp_path), "mix").collect() == df.collect()


@pytest.mark.parametrize("path,want", [("a/b.c/video.mp4", "video"), ("x.tar.gz", "x.tar"), (".hidden", ".hidden"), ("plain", "plain")])
def test_video_prefix(spark, path, want):
    assert spark.range(1).select(sources.video_prefix(F.lit(path))).first()[0] == want


def test_cdf_column_and_numpy_agree(spark):
    rows = [(0, [0.7, 0.3], [3.0, 5.0], [0.5, 1.0]), (1, [1.0], [0.0], [0.1])]
    df = spark.createDataFrame(rows, "frame_id long, pi array<double>, mu array<double>, sigma array<double>")
    got = D.mixture_cdf(df, 10).withColumn("twin", D.mixture_cdf_columns(10)).collect()
    for r in got:
        assert np.allclose(r["cdf"], r["twin"], atol=1e-12) and (np.diff(r["cdf"]) >= 0).all()
        assert max(r["cdf"]) == 1.0


def test_hypotheses_to_mixture(spark):
    h, z = [1.0, 2.0, 4.0], [[0.0, 1.0, 0.5], [1.0, 0.0, 0.5]]
    got = D.hypotheses_to_mixture(spark.createDataFrame([(h, z)], "h array<double>, z array<array<double>>")).first()
    g = np.exp(np.array(z)) / np.exp(np.array(z)).sum(0)
    w = g.sum(1) + 1e-4
    mu = (g * h).sum(1) / w
    assert np.allclose(got["pi"], g.mean(1)) and np.allclose(got["mu"], mu)
    assert np.allclose(np.square(got["sigma"]), (g * (np.array(h) - mu[:, None]) ** 2).sum(1) / w + 1e-4)


def test_proxy_surface(spark):
    class Model:
        def predict(self, batch: pd.DataFrame):
            n = len(batch)
            return np.ones((n, 1)), batch[["x"]].to_numpy(), np.full((n, 1), 0.5)

    df = spark.createDataFrame([("v", 1, 2.0), ("v", 2, 3.0)], "video_id string, frame_id long, x double")
    got = scoring.apply_proxy(df, Model()).orderBy("frame_id").collect()
    assert [r["mu"] for r in got] == [[2.0], [3.0]] and got[0]["sigma"] == [0.5]


def slow_nms(boxes, thres):
    """Plain suppression over (det_id, cls, corners, obj, rank)."""
    out = []
    for cls in {b[1] for b in boxes}:
        rest = sorted((b for b in boxes if b[1] == cls), key=lambda b: (-b[4], b[0]))
        while rest:
            a = rest[0]

            def over(b, a=a):
                w = max(min(a[2][2], b[2][2]) - max(a[2][0], b[2][0]) + 1, 0)
                h = max(min(a[2][3], b[2][3]) - max(a[2][1], b[2][1]) + 1, 0)
                area = lambda c: (c[2] - c[0] + 1) * (c[3] - c[1] + 1)
                return w * h / (area(a[2]) + area(b[2]) - w * h) > thres

            hit = [b for b in rest if b is a or over(b)]
            w = sum(b[3] for b in hit)
            out.append((a[0], tuple(round(sum(b[3] * b[2][i] for b in hit) / w, 6) for i in range(4))))
            rest = [b for b in rest if b not in hit]
    return sorted(out)


def test_suppression_equals_the_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for f in range(30):
        boxes = []
        for d in range(int(rng.integers(1, 12))):
            x, y, s = *map(float, rng.integers(0, 40, 2)), float(rng.integers(10, 40))
            boxes.append((d, int(rng.integers(0, 2)), (x, y, x + s, y + s), float(rng.uniform(0.2, 1)), float(rng.integers(1, 4))))
        want[f] = slow_nms(boxes, 0.45)
        rows += [(f, b[0], b[1], *b[2], b[3], 1.0, b[4]) for b in boxes]
    df = spark.createDataFrame(rows, "frame_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double, obj_conf double, cls_conf double, rank_score double")
    got: dict = {}
    for r in detections.non_max_suppression(df, 0.1, 0.45).collect():
        got.setdefault(r["frame_id"], []).append((r["det_id"], tuple(round(r[c], 6) for c in detections.CORNERS)))
    assert {f: sorted(x) for f, x in got.items()} == want


def test_groups_survive_batch_borders():
    df = pd.DataFrame({"k": [1, 1, 2, 2, 2, 3], "v": range(6)})
    parts = [df.iloc[i : i + 1].reset_index(drop=True) for i in range(6)]
    got = [len(x) for pdf, edges in detections.whole_groups(iter(parts), ["k"]) for x in np.split(pdf, edges[1:-1])]
    assert got == [2, 3, 1]


def test_matching_is_one_to_one_and_needs_the_class(spark):
    box = lambda x: (float(x), 0.0, float(x) + 10, 10.0)
    pred = [(1, 1, 0, 0.9, *box(0)), (1, 2, 0, 0.8, *box(1)), (1, 3, 5, 0.7, *box(30)), (1, 4, 1, 0.6, *box(30)), (2, 1, 0, 0.5, *box(0))]
    truth = [(1, 0, *box(0)), (1, 1, *box(30))]
    p = spark.createDataFrame(pred, "frame_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame(truth, "frame_id long, cls int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["frame_id"], r["det_id"]): r["tp"] for r in detections.match_detections(p, t).collect()}
    assert got == {(1, 1): 1, (1, 2): 0, (1, 3): 0, (1, 4): 1, (2, 1): 0}


def test_class_without_predictions_has_zero(spark):
    matches = spark.createDataFrame([(1, 1, 0, 0.9, 1)], "frame_id long, det_id long, cls int, conf double, tp int")
    truth = spark.createDataFrame([(1, 0), (1, 7)], "frame_id long, cls int")
    got = {r["cls"]: (r["ap"], r["recall"]) for r in metrics.average_precision(metrics.pr_curve(matches, truth), truth).collect()}
    assert got == {0: (1.0, 1.0), 7: (0.0, 0.0)}


def test_sample_of_each_window_has_at_least_one(spark):
    f = spark.range(10).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_id"))
    got = sampling.sample_per_window(f, 4, 0).groupBy("window_id").count().orderBy("window_id").collect()
    assert [(r["window_id"], r["count"]) for r in got] == [(0, 1), (1, 1), (2, 1)]


def test_every_frame_has_one_mixture(spark):
    lab = spark.createDataFrame([("v", 0, 3)], "video_id string, frame_id long, score int")
    mix = spark.createDataFrame([("v", 1, [1.0], [2.0], [0.6])], "video_id string, frame_id long, pi array<double>, mu array<double>, sigma array<double>")
    mir = spark.createDataFrame([("v", 2, 1)], "video_id string, frame_id long, ref_id long")
    got = {r["frame_id"]: (r["mu"], r["sigma"]) for r in windows.complete_mixtures(lab, mix, mir).collect()}
    assert got == {0: ([3.0], [0.1]), 1: ([2.0], [0.6]), 2: ([2.0], [0.6])}
