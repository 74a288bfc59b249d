"""Whole queries: scorers on demand, mirrors beside labels, coverage, stages, skew."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probtopk.jobs import query, search
from probtopk.operators import detections, metrics, ordinals, scoring, topk, windows
from probtopk.sources import frames as sources
from probtopk.sources.shared import scratch

IDS = ["video_id", "frame_id"]


def counting(seen):
    """A scorer that counts the frames that it scores; the class is local, so that it is sent to the workers as a whole."""

    class Counting(scoring.ScoringUDF):
        def score(self, batch):
            seen.add(len(batch))
            return batch["truth"].tolist()

    return Counting()


def table(spark, scores, noise=0.0, seed=0):
    """Frames with their truth, a feature near it, and features in which neighbours of one score are alike."""
    r = random.Random(seed)
    rows = [("v", i, int(s), float(s) + r.uniform(-noise, noise), [float(s), 0.0]) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "video_id string, frame_id long, truth int, feature double, features array<double>")


def skewed(n, seed=1):
    return np.minimum(np.random.default_rng(seed).exponential(3, n).astype(int), 49)


OPTIONS = query.Options(low=0.0, high=50.0, bins=(25, 50), max_score=50, num_train=0.1, num_valid=0.05)


def best(scores, k):
    return sorted((int(s) for s in scores), reverse=True)[:k]


def scores_of(answer):
    return sorted((r["score"] for r in answer.topk.collect()), reverse=True)


def test_a_scorer_runs_on_few_frames_and_never_twice(spark):
    scores = skewed(2000)
    seen = spark.sparkContext.accumulator(0)
    frames = table(spark, scores, 0.4)
    a = query.query_frames(frames, counting(seen), OPTIONS, k=20, conf_thres=0.99)
    assert scores_of(a) == best(scores, 20) and a.reached and a.log_confidence >= math.log(0.99)
    assert seen.value == 300 + a.scored < 1000
    row = query.report(a, frames.select(*IDS, F.col("truth").alias("score")), 20).first()
    assert (row["precision"], row["rank_distance"], row["score_error"], row["scored"]) == (1.0, 0.0, 0.0, a.scored)


def test_a_second_search_starts_from_the_stages(spark):
    scores = skewed(600)
    seen = spark.sparkContext.accumulator(0)
    frames, folder = table(spark, scores, 0.4), scratch(spark, "stages")
    first = query.query_frames(frames, counting(seen), OPTIONS, k=5, folder=folder)
    labelled = seen.value - first.scored
    second = query.query_frames(frames, counting(seen), OPTIONS, k=10, folder=folder)
    assert seen.value == labelled + first.scored + second.scored and scores_of(second) == best(scores, 10)
    assert all(sources.has_stage(spark, folder, s) for s in ("labelled", "mirrors", "proxy", "binned")) and not sources.has_stage(spark, folder, "other")


@pytest.mark.parametrize("seed", range(4))
def test_labelled_frames_beside_mirrors(spark, seed):
    """Frames of one score are alike: whatever is labelled, all with the best score are found, each once."""
    scores = [1, 1, 9, 9, 2, 2, 3, 3, 9, 9, 1, 2]
    frames = table(spark, scores)
    options = query.Options(low=0.0, high=10.0, bins=(10,), sigmas=(0.1,), max_score=10, num_train=0.25, num_valid=0.1, diff_thres=1e-6, ref_dist=4, seed=seed)
    a = query.query_frames(frames, frames.select(*IDS, F.col("truth").alias("score")), options, k=4, conf_thres=0.999)
    rows = [(r["frame_id"], r["score"]) for r in a.topk.collect()]
    assert len({i for i, _ in rows}) == 4 and {s for _, s in rows} == {9}
    mix = frames.select(*IDS, *[F.array(c).alias(n) for c, n in ((F.lit(1.0), "pi"), (F.col("truth").cast("double"), "mu"), (F.lit(0.1), "sigma"))])
    b = search.detect_and_search(frames, frames.select(*IDS, F.col("truth").alias("score")), mix, 1e-6, 4, num_train=0.25, num_valid=0.1, seed=seed, k=4)
    assert sorted(rows) == sorted((r["frame_id"], r["score"]) for r in b.topk.collect())


def test_windows_with_labels_and_mirrors(spark):
    scores = [int(x) for x in skewed(400, 2)]
    frames = table(spark, scores)
    options = query.Options(low=0.0, high=50.0, bins=(50,), sigmas=(0.1,), num_train=0.1, num_valid=0.1, diff_thres=1e-9, ref_dist=5)
    a = query.query_windows(frames, frames.select(*IDS, F.col("truth").alias("score")), options, 7, 1.0, k=5)
    clips = {w: round(np.mean(scores[7 * w : 7 * w + 7])) for w in range(58)}
    assert scores_of(a) == best(clips.values(), 5)
    half = query.query_windows(frames, frames.select(*IDS, F.col("truth").alias("score")), options, 7, 0.5, k=5)
    assert len(half.topk.collect()) == 5


def test_a_frame_without_mixture_is_an_error(spark):
    frames = table(spark, [1, 2, 3])
    mix = windows.known_mixture(frames.select(*IDS, F.col("truth").alias("score")))
    assert windows.checked_coverage(mix, frames) is mix
    for wrong in (mix.where("frame_id > 0"), mix.unionByName(mix.where("frame_id = 1")), mix.withColumn("frame_id", F.col("frame_id") + 1)):
        with pytest.raises(ValueError):
            windows.checked_coverage(wrong, frames)


def test_mirrors_of_labelled_references_are_covered(spark):
    mix = windows.known_mixture(spark.createDataFrame([("v", 2, 7)], "video_id string, frame_id long, score int"))
    labelled = spark.createDataFrame([("v", 0, 4)], "video_id string, frame_id long, score int")
    mirrors = spark.createDataFrame([("v", 1, 0), ("v", 3, 2)], "video_id string, frame_id long, ref_id long")
    got = {r["frame_id"]: r["mu"][0] for r in windows.complete_mixtures(labelled, mix, mirrors).collect()}
    assert got == {0: 4.0, 1: 4.0, 2: 7.0, 3: 7.0}


@pytest.mark.parametrize("rule", ["cutoff", "expected"])
def test_rounds_may_be_limited_and_chosen_by_either_rule(spark, rule):
    scores = skewed(300, 4)
    frames = table(spark, scores, 0.3)
    oracle = frames.select(*IDS, F.col("truth").alias("score"))
    mix = frames.select(*IDS, *[F.array(c).alias(n) for c, n in ((F.lit(1.0), "pi"), (F.col("feature"), "mu"), (F.lit(0.5), "sigma"))])
    a = search.topk_frames(oracle, mix, k=5, num_train=0.1, num_valid=0.0, cap=8, rule=rule)
    assert scores_of(a) == best(scores, 5) and a.reached
    cut = search.topk_frames(oracle, mix, k=5, num_train=0.1, num_valid=0.0, cap=1, rule=rule, max_rounds=1)
    assert cut.rounds <= 1 and (cut.reached or cut.log_confidence < math.log(0.9))


# Skew.
def plain_average_precision(tp, n_truth):
    tpc = np.cumsum(tp)
    recall, precision = tpc / n_truth, tpc / np.arange(1, len(tp) + 1)
    env = np.maximum.accumulate(precision[::-1])[::-1]
    return float(np.sum(np.diff(np.r_[0, recall]) * env))


@pytest.mark.parametrize("span", [3, 65_536])
def test_average_precision_of_one_class(spark, span):
    tp = (np.random.default_rng(0).random(20_000) < np.linspace(0.9, 0.1, 20_000)).astype(int)
    rows = spark.createDataFrame([(i, 0, 0, 1 - i / 20_000, int(x)) for i, x in enumerate(tp)], "frame_id long, det_id long, cls int, conf double, tp int")
    truth = spark.range(15_000).select(F.lit(0).alias("cls"))
    got = metrics.average_precision(metrics.pr_curve(rows, truth), truth, span).first()
    assert got["ap"] == pytest.approx(plain_average_precision(tp, 15_000))


@pytest.mark.parametrize("values", [[0.0] * 5000, [0.8] * 5000, [0.0] * 1000 + [0.5] * 1000 + [0.9999] * 3000])
def test_cutoff_of_equal_probabilities(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "frame_id long, f double")
    logs = np.log(np.maximum(np.array(sorted(values)), 1e-300))
    tail = np.cumsum(logs[::-1])[::-1]
    got = sorted(r["frame_id"] for r in topk.cutoff_candidates(df, 0.9).collect())
    assert got == list(range(int((tail < math.log(0.9)).sum())))


def test_smoothing_over_the_borders_of_spans(spark):
    scores = [int(x) for x in skewed(200, 3)]
    labels = spark.createDataFrame([("v", i, s) for i, s in enumerate(scores)], "video_id string, frame_id long, score int")
    for kernel in (1, 4, 25):
        got = {r["frame_id"]: r["smoothed"] for r in scoring.smooth_labels(labels, kernel, span=8).collect()}
        half = kernel // 2
        assert got == {i: pytest.approx(np.mean(scores[max(0, i - half) : i + half + 1])) for i in range(200)}


def test_names_are_numbered_in_bins(spark):
    names = [f"{x}.jpg" for x in random.Random(0).sample(range(2_000_000), 3000)]
    got = {r["name"]: r["frame_id"] for r in sources.frame_numbers(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: (len(n), n)))}


def test_ranks_of_real_scores(spark):
    scores = np.random.default_rng(2).random(3000)
    df = spark.createDataFrame([("v", i, float(s)) for i, s in enumerate(scores)], "video_id string, frame_id long, score double")
    approx = df.where("frame_id % 10 != 0").orderBy(F.desc("score")).limit(50)
    given = sorted((r["score"] for r in approx.collect()), reverse=True)
    want = np.mean([abs(int((scores > s).sum()) - i) for i, s in enumerate(given)])
    assert metrics.rank_distance(approx, df).first()[0] == pytest.approx(want)


def test_with_ordinal_of_one_key(spark):
    df = spark.range(1000).select(F.lit("a").alias("key"), (F.col("id") * 3).alias("at"))
    got = {r["at"]: r["pos"] for r in ordinals.with_ordinal(df, "key", "at", span=64).collect()}
    assert got == {3 * i: i for i in range(1000)}


# Ranges.
def test_many_random_names_are_dealt_evenly(spark):
    names = spark.range(1_000_000).select(F.concat(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 12), F.lit(".jpg")).alias("name"))
    sizes = [r["count"] for r in ordinals.range_dealt(names, "name").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * np.median(sizes)
    numbered = sources.frame_numbers(names).orderBy("frame_id").limit(3).collect()
    first = names.orderBy("name").limit(3).collect()
    assert [(r["name"], r["frame_id"]) for r in numbered] == [(r["name"], i) for i, r in enumerate(first)]


def test_curve_of_equal_confidences_is_spread_and_exact(spark):
    """One class, one confidence: the running counts are those in order of frame and detection, and no range has more than its share."""
    n = 200_000
    rows = spark.range(n).select(F.floor(F.col("id") / 4).alias("frame_id"), (F.col("id") % 4).alias("det_id"), F.lit(1).alias("cls"), F.lit(0.5).alias("conf"), (F.col("id") % 3 == 0).cast("int").alias("tp"))
    truth = spark.range(n).select(F.lit(1).alias("cls"))
    curve = metrics.pr_curve(rows, truth).withColumn("at", F.col("frame_id") * 4 + F.col("det_id"))
    assert curve.where("rank != at + 1 OR tpc != at div 3 + 1").count() == 0 and curve.count() == n
    sizes = [r["count"] for r in ordinals.range_dealt(rows, "cls", F.desc("conf"), "frame_id", "det_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * np.median(sizes)


def test_one_pass_suppresses_and_matches(spark):
    rng = np.random.default_rng(8)
    schema = "frame_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double, obj_conf double, cls_conf double, rank_score double"

    def some(n_frames, most):
        for f in range(n_frames):
            for d in range(int(rng.integers(0, most))):
                x, y, s = *map(float, rng.integers(0, 60, 2)), float(rng.integers(10, 40))
                yield f, d, int(rng.integers(0, 3)), x, y, x + s, y + s, float(rng.uniform(0.05, 1)), 0.9, float(rng.integers(1, 4))

    boxes = spark.createDataFrame(list(some(80, 14)), schema)
    truth = spark.createDataFrame(list(some(80, 8)), schema).select("frame_id", "cls", *detections.CORNERS)
    two = detections.match_detections(detections.non_max_suppression(boxes, 0.1, 0.3).withColumnRenamed("obj_conf", "conf"), truth, 0.3)
    one = detections.suppress_and_match(boxes, truth, 0.1, 0.3, 0.3)
    assert str(one._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one) == rows(two) and any(r[-1] for r in rows(one))
    assert detections.suppress_and_match(boxes.limit(0), truth).count() == 0 and detections.suppress_and_match(boxes, truth.limit(0)).where("tp > 0").count() == 0


@pytest.mark.parametrize("pairs", [1, 50, 1 << 20])
def test_matches_of_many_pairs_at_once(monkeypatch, pairs):
    """Against a plain loop, whatever number of pairs is measured together."""
    monkeypatch.setattr(detections, "PAIRS", pairs)
    rng = np.random.default_rng(2)
    rows = sorted((int(rng.integers(0, 25)), int(rng.integers(0, 2)), i) for i in range(400))
    frame, is_pred, cls = np.array([r[0] for r in rows]), np.array([r[1] == 1 for r in rows]), rng.integers(0, 3, 400)
    corner = rng.integers(0, 12, (400, 2)).astype(float)
    corners = np.hstack([corner, corner + rng.integers(4, 9, (400, 2))])
    want = np.zeros(400, int)
    for f in set(frame.tolist()):
        truth, free = np.flatnonzero((frame == f) & ~is_pred), set()
        free = set(truth.tolist())
        for i in np.flatnonzero((frame == f) & is_pred):
            if len(truth) and cls[i] in cls[truth]:
                overlap = detections._overlaps(corners[i], corners[truth])
                at = int(overlap.argmax())
                if overlap[at] >= 0.3 and int(truth[at]) in free:
                    want[i] = 1
                    free.discard(int(truth[at]))
    assert detections._match(frame, is_pred, cls, corners, 0.3).tolist() == want.tolist() and want.sum() > 10
