"""Operators whose point is what they do not move or repeat: the detector, the scorer, clips by moments, stages."""

import os
import re
import sys
import tempfile
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probtopk.functions.distribution import mixture_moments
from probtopk.jobs import query
from probtopk.operators import difference, scoring, windows
from probtopk.sources.shared import scratch

IDS = ["video_id", "frame_id"]


def exchanges(df, column):
    """How many exchanges of the plan as it is before it runs move a column."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = re.findall(r"^\(\d+\) (?:Exchange|BroadcastExchange).*\n(?:Input|Output) \[\d+\]: \[(.*)\]", plan, re.M)
    return sum(bool(re.search(rf"\b{column}#", columns)) for columns in parts)


def gapped(spark, n=300, seed=4):
    """Two videos whose frame ids have gaps, small and large."""
    rng = np.random.default_rng(seed)
    rows = []
    for video, most in (("a", 3), ("b", 500)):
        ids = np.cumsum(rng.integers(1, most, n))
        rows += [(video, int(i), [float(x) for x in rng.integers(0, 3, 4)]) for i in ids]
    return spark.createDataFrame(rows, "video_id string, frame_id long, features array<float>")


def plain_detect(frames, thres, ref_dist):
    out = []
    for video, rows in pd.DataFrame([tuple(r) for r in frames.collect()], columns=[*IDS, "features"]).sort_values(IDS).groupby("video_id"):
        for at in range(0, len(rows), ref_dist):
            seg = rows.iloc[at : at + ref_dist]
            ref = seg.iloc[len(seg) // 2]
            for r in seg.itertuples():
                diff = float(np.mean((np.array(r.features) - np.array(ref.features)) ** 2))
                out.append((video, r.frame_id, ref.frame_id, round(diff, 9), diff < thres and r.frame_id != ref.frame_id))
    return sorted(out)


def rows_of(detected):
    return sorted((r["video_id"], r["frame_id"], r["ref_id"], round(r["diff"], 9), r["discarded"]) for r in detected.collect())


@pytest.mark.parametrize("block,span", [(2, 16), (1, 7), (64, 65_536)])
def test_features_are_dealt_once_and_ranks_are_right(spark, block, span):
    frames = gapped(spark)
    found = difference.difference_detect(frames, 0.6, 7, block, span)
    assert exchanges(found, "features") == 1
    assert rows_of(found) == plain_detect(frames, 0.6, 7)


@pytest.mark.parametrize("pictures", [False, True])
def test_stored_segments_are_compared_without_exchange(spark, pictures):
    frames = gapped(spark)
    stored = frames
    if pictures:
        to_bytes = F.pandas_udf(lambda xs: xs.map(lambda x: np.asarray(x, np.float32).tobytes()), "binary")
        stored = frames.withColumn("features", to_bytes("features"))
    segments = difference.store_segments(stored, 7, scratch(spark, "segments"), block=2, span=16)
    found = difference.detect_stored(segments, 0.6, (lambda b: np.frombuffer(b, np.float32)) if pictures else None)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found) == plain_detect(frames, 0.6, 7)
    assert difference.detect_stored(segments.limit(0), 0.6).count() == 0


def noting(folder):
    """A scorer that notes its calls as files named by worker; local, so that it is sent to the workers as a whole."""

    class Noting(scoring.ScoringUDF):
        def initialize(self):
            self.model = 5
            with tempfile.NamedTemporaryFile("w", dir=folder, prefix=f"init-{os.getpid()}-", delete=False):
                pass

        def score(self, batch):
            with tempfile.NamedTemporaryFile("w", dir=folder, prefix=f"score-{os.getpid()}-{len(batch)}-", delete=False):
                pass
            return [self.model] * len(batch)

    return Noting()


def test_a_scorer_is_loaded_once_a_worker_and_gets_its_batches(spark, tmp_path):
    udf = noting(str(tmp_path))
    frames = spark.range(64 * 25).repartition(64)
    sizes = [r["count"] for r in frames.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 64
    for _ in range(2):  # a second job finds the scorer loaded
        assert scoring.apply_oracle(frames, udf, batch=8).where("score = 5").count() == 64 * 25
    names = os.listdir(tmp_path)
    loads, workers = [n for n in names if n.startswith("init")], {n.split("-")[1] for n in names}
    assert len(loads) == len({n.split("-")[1] for n in loads}) <= len(workers) < 64
    given = [int(n.split("-")[2]) for n in names if n.startswith("score")]
    assert max(given) == 8 and sum(given) == 2 * 64 * 25 and given.count(8) == 2 * sum(n // 8 for n in sizes)


@pytest.mark.parametrize("sizes,n", [([3, 1, 7], 4), ([10], 3), ([], 2), ([2, 2], None), ([0, 5], 5)])
def test_batches_are_cut_anew(sizes, n):
    parts = [pd.DataFrame({"v": range(x)}) for x in sizes]
    got = [len(x) for x in scoring.sliced(iter(parts), n)]
    assert sum(got) == sum(sizes) and (got == sizes if n is None else all(x == n for x in got[:-1]))


def mixed(spark):
    lab = spark.createDataFrame([("v", i, i % 5) for i in range(0, 40, 4)], "video_id string, frame_id long, score int")
    mix = spark.createDataFrame([("v", i, [0.5, 0.5], [i / 3, i / 2], [0.6, 1.0]) for i in range(40) if i % 4 in (1, 2)], "video_id string, frame_id long, pi array<double>, mu array<double>, sigma array<double>")
    mir = spark.createDataFrame([("v", i, i - 1 - i % 2 * (i % 3)) for i in range(3, 40, 4)], "video_id string, frame_id long, ref_id long")
    return lab, mix, mir.withColumn("ref_id", F.when(F.col("ref_id") % 4 == 3, F.col("ref_id") - 1).otherwise(F.col("ref_id")))


def test_clips_by_moments_are_those_of_mixtures(spark):
    lab, mix, mir = mixed(spark)
    want = windows.window_distribution(windows.complete_mixtures(lab, mix, mir), 7)
    clips = windows.moment_windows(windows.complete_moments(lab, mixture_moments(mix), mir), 7)
    rows = lambda df: {r["window_id"]: (pytest.approx(r["mu"][0]), pytest.approx(r["sigma"][0])) for r in df.collect()}
    assert rows(clips) == rows(want) and len(rows(clips)) == 6
    assert exchanges(clips, "(?:pi|mu|sigma)") == 0
    frames = spark.range(40).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_id"))
    assert windows.checked_windows(clips, windows.signature(frames)).columns == want.columns
    for wrong in (frames.where("frame_id > 0"), frames.unionByName(frames.where("frame_id = 1"))):
        with pytest.raises(ValueError, match="mixtures for"):
            windows.checked_windows(clips, windows.signature(wrong))


def small(spark, n=400, noise=0.0):
    rng = np.random.default_rng(0)
    scores = np.minimum(rng.exponential(3, n).astype(int), 49)
    rows = [("v", i, int(x), float(rng.uniform(0, 50)), float(x) * 2 + 1 + noise * float(rng.normal())) for i, x in enumerate(scores)]
    return spark.createDataFrame(rows, "video_id string, frame_id long, truth int, feature double, hint double")


OPTIONS = query.Options(low=0.0, high=50.0, bins=(10,), sigmas=(0.6,), num_train=0.3, num_valid=0.2)


def models():
    """Two proxies; local classes, so that they are sent to the workers as a whole."""

    class Line(scoring.ProxyModel):
        def fit(self, train):
            row = train.agg(F.regr_slope("score", "hint").alias("a"), F.regr_intercept("score", "hint").alias("b")).first()
            self.a, self.b = row["a"], row["b"]
            return self

        def predict(self, batch):
            mu = batch["hint"].to_numpy()[:, None] * self.a + self.b
            return np.ones_like(mu).tolist(), mu.tolist(), np.full_like(mu, 0.2).tolist()

    class Constant(scoring.ProxyModel):
        def predict(self, batch):
            return [[1.0]] * len(batch), [[40.0]] * len(batch), [[0.3]] * len(batch)

    return Line(), Constant()


def test_the_proxy_with_the_least_loss_is_taken(spark):
    frames = small(spark)
    oracle = frames.select(*IDS, F.col("truth").alias("score"))
    best = sorted((r["truth"] for r in frames.collect()), reverse=True)
    line, constant = models()
    options = replace(OPTIONS, models=(constant, line), columns=("hint",))
    folder = scratch(spark, "models")
    found = query.scan(frames, oracle, options, folder)
    assert found.proxy is None and found.binned.columns == [*IDS, "pi", "mu", "sigma"]
    near = found.binned.join(oracle, IDS).where("abs(mu[0] - score) > 0.5").count()
    assert near == 0
    a = query.query_frames(frames, oracle, options, k=10, conf_thres=0.99, folder=folder)
    assert sorted((r["score"] for r in a.topk.collect()), reverse=True) == best[:10] and a.scored < 100
    b = query.query(frames, oracle, options, 4, 1.0, k=5, conf_thres=0.99)
    clips = sorted((round(np.mean(x)) for x in np.array([r["truth"] for r in frames.orderBy("frame_id").collect()]).reshape(-1, 4)), reverse=True)
    assert sorted((r["score"] for r in b.topk.collect()), reverse=True) == clips[:5]
    assert query.scan(frames, oracle, replace(OPTIONS, models=(constant,)), scratch(spark, "models")).proxy is not None


def test_a_stage_of_other_options_or_frames_is_refused(spark):
    frames, folder = small(spark, 100), scratch(spark, "stages")
    oracle = frames.select(*IDS, F.col("truth").alias("score"))
    first = query.scan(frames, oracle, OPTIONS, folder)
    assert query.scan(frames, oracle, OPTIONS, folder).binned.count() == first.binned.count()
    other = replace(OPTIONS, num_train=0.1)
    for wrong in ((frames, other), (frames.where("frame_id < 50"), OPTIONS), (frames.withColumn("frame_id", F.col("frame_id") + 1), OPTIONS)):
        with pytest.raises(ValueError, match="was made from"):
            query.scan(wrong[0], oracle, wrong[1], folder)


def test_core_queries_stand_without_the_other_part(monkeypatch):
    import __spark_entry__ as entry
    from probtopk.jobs import queries

    for name in [m for m in sys.modules if m.startswith("probtopk.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "probtopk.llm", None)  # an import of it fails
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
