import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probtopk.functions import distribution as D
from probtopk.jobs import search
from probtopk.jobs.uncertain import BinnedFrames, MixtureFrames
from probtopk.operators import ordinals, topk

NEG = float("-inf")


def tables(spark, cdfs):
    rows = [("v", i, [float(x) for x in c]) for i, c in enumerate(cdfs)]
    return D.log_tables(spark.createDataFrame(rows, "video_id string, frame_id long, cdf array<double>"))


def sums(u, n):
    return [(r["finite"], r["n_inf"]) for r in sorted(topk.column_log_sums(u, n).collect())]


def brute_expected(cdfs, lam, mu, f):
    """Expected confidence after scoring frame f, by enumerating its score."""
    cdfs = np.asarray(cdfs)
    pdf = np.diff(cdfs[f], prepend=0)
    others = [c for i, c in enumerate(cdfs) if i != f]
    total = 0.0
    for s, p in enumerate(pdf):
        if s <= lam:
            level = lam
        else:
            level = min(s, mu)
        total += p * np.prod([c[level] for c in others])
    return total


@pytest.mark.parametrize("lam,mu", [(1, 2), (0, 2), (2, 2), (1, 1)])
def test_expected_confidence_equals_enumeration_and_bound_is_above(spark, lam, mu):
    cdfs = [[0.2, 0.5, 0.8, 1.0], [0.1, 0.3, 0.9, 1.0], [0.4, 0.6, 0.7, 1.0], [0.25, 0.5, 0.75, 1.0]]
    u = tables(spark, cdfs)
    h = sums(u, 4)
    out = topk.upper_bound(topk.expected_confidence(u, h, lam, mu), h, lam, mu).orderBy("frame_id").collect()
    for f, row in enumerate(out):
        assert math.exp(row["expected"]) == pytest.approx(brute_expected(cdfs, lam, mu, f), abs=1e-9)
        assert row["bound"] >= row["expected"] - 1e-12


def test_confidence_equals_all_worlds(spark):
    cdfs = [[0.2, 0.5, 0.8, 1.0], [0.1, 0.3, 0.9, 1.0], [0.4, 0.6, 0.7, 1.0]]
    pdfs = [np.diff(c, prepend=0) for c in cdfs]
    lam = 1
    worlds = sum(np.prod([p[s] for p, s in zip(pdfs, w)]) for w in itertools.product(range(4), repeat=3) if max(w) <= lam)
    got = topk.topk_confidence(tables(spark, cdfs), lam).first()[0]
    assert math.exp(got) == pytest.approx(worlds)


def test_frame_with_cdf_zero_gives_no_nan(spark):
    u = tables(spark, [[0.0, 0.0, 0.5, 1.0], [0.2, 0.5, 0.8, 1.0]])
    assert topk.topk_confidence(u, 1).first()[0] == NEG
    h = sums(u, 4)
    assert h[1] == (pytest.approx(math.log(0.5)), 1)
    rows = topk.expected_confidence(u, h, 1, 2).orderBy("frame_id").collect()
    assert all(r["expected"] is not None and not math.isnan(r["expected"]) for r in rows)
    assert math.exp(rows[0]["expected"]) == pytest.approx(0.5 * 0.8 + 0.5 * 0.8)
    assert rows[1]["expected"] < rows[0]["expected"]


def test_cutoff_is_the_smallest_set(spark):
    f = [0.1, 0.5, 0.9, 0.95, 0.99, 0.99]
    df = spark.createDataFrame(list(enumerate(f)), "frame_id long, f double")
    got = sorted(r["frame_id"] for r in topk.cutoff_candidates(df, 0.9).collect())
    best = next(k for k in range(len(f) + 1) if np.prod(sorted(f)[k:]) >= 0.9)
    assert got == list(range(best))
    assert topk.cutoff_candidates(df, 0.9, cap=1).collect()[0]["frame_id"] == 0


def test_ties_go_to_the_larger_frame(spark):
    df = spark.createDataFrame([("v", i, 3) for i in range(6)], "video_id string, frame_id long, score int")
    assert [r["frame_id"] for r in topk.exact_topk(df, 2).collect()] == [5, 4]
    t = topk.thresholds(topk.exact_topk(df, 1)).first()
    assert (t["lam"], t["mu"]) == (3, 3)


def proxy(spark, scores, sigma=0.1):
    rows = [("v", i, [1.0], [float(s)], [sigma]) for i, s in enumerate(scores)]
    mix = spark.createDataFrame(rows, "video_id string, frame_id long, pi array<double>, mu array<double>, sigma array<double>")
    oracle = spark.createDataFrame([("v", i, int(s)) for i, s in enumerate(scores)], "video_id string, frame_id long, score int")
    return oracle, mix


@pytest.mark.parametrize("k,scores", [(1, [0, 1, 2, 3]), (3, [5, 5, 5, 5]), (9, [1, 2, 3]), (4, list(range(40)))])
def test_search_finds_the_exact_scores(spark, k, scores):
    oracle, mix = proxy(spark, scores)
    a = search.topk_frames(oracle, mix, k=k, conf_thres=0.9, num_train=1.0 if len(scores) < 4 else 0.25, num_valid=0.0)
    got = sorted((r["score"] for r in a.topk.collect()), reverse=True)
    assert got == sorted(scores, reverse=True)[:k]
    assert a.log_confidence >= math.log(0.9) or len(scores) <= k


def test_search_scores_few_frames_and_rounds_are_few(spark):
    rng = np.random.default_rng(1)
    scores = np.minimum(rng.exponential(3, 2000).astype(int), 49)
    oracle, mix = proxy(spark, scores, 0.5)
    a = search.topk_frames(oracle, mix, k=20, num_train=0.05, num_valid=0.0, cap=64)
    assert sorted((r["score"] for r in a.topk.collect()), reverse=True) == sorted(scores.tolist(), reverse=True)[:20]
    assert a.scored < 1000 and a.rounds < 20


def test_search_goes_on_until_the_confidence_is_reached(spark):
    oracle, _ = proxy(spark, [5] * 119 + [6])
    _, mix = proxy(spark, [5] * 120, 0.6)  # F(5) is near 0.8: no frame may stay open
    a = search.topk_frames(oracle, mix, k=1, num_train=0.0, num_valid=0.0, cap=1)
    assert [(r["frame_id"], r["score"]) for r in a.topk.collect()] == [(119, 6)]
    assert a.log_confidence >= math.log(0.9) and a.scored > 100 and a.rounds < 20


def test_mirrors_enter_with_the_reference_score(spark):
    oracle, mix = proxy(spark, [0, 7, 1, 0, 2])
    mirrors = spark.createDataFrame([("v", 3, 1)], "video_id string, frame_id long, ref_id long")
    a = search.topk_frames(oracle, mix, k=2, num_train=0.0, num_valid=0.0, mirrors=mirrors, cap=2)
    assert {(r["frame_id"], r["score"]) for r in a.topk.collect()} == {(1, 7), (3, 7)}


def test_clip_of_a_last_short_window(spark):
    oracle, mix = proxy(spark, [1, 1, 1, 1, 2, 2, 2, 2, 9, 9])
    a = search.topk_windows(oracle, mix, 4, 1.0, k=2)
    assert {(r["frame_id"], r["score"]) for r in a.topk.collect()} == {(2, 9), (1, 2)}


def test_empty_candidates(spark):
    oracle, mix = proxy(spark, [1, 2])
    none = mix.where(F.lit(False))
    a = search.topk_frames(oracle, none, k=2, num_train=0.0, num_valid=0.0)
    assert a.topk.count() == 0 and a.scored == 0


def random_mixtures(spark, n, seed=0, sigma=(1.0, 3.0)):
    rng = np.random.default_rng(seed)
    mus = np.minimum(rng.exponential(4, n), 48)
    rows = [("v", i, [0.7, 0.3], [float(m), float(m + 1)], [float(rng.uniform(*sigma)), 2.0]) for i, m in enumerate(mus)]
    return spark.createDataFrame(rows, "video_id string, frame_id long, pi array<double>, mu array<double>, sigma array<double>")


def test_bounds_spare_most_evaluations(spark):
    lam, mu, b = 22, 25, 10
    u = D.log_tables(random_mixtures(spark, 4000, 0, (4.0, 9.0)).withColumn("cdf", D.mixture_cdf_columns(50))).where(F.get("log_cdf", F.lit(lam)) < 0).drop("cdf").persist()
    h = sums(u, 50)
    brute = topk.expected_confidence(u, h, lam, mu).orderBy(F.desc("expected"), "frame_id").limit(b).collect()
    found, n = topk.best_by_bound(topk.upper_bound(u, h, lam, mu), lambda rows: topk.expected_confidence(rows, h, lam, mu), b)
    assert [(r["frame_id"], r["expected"]) for r in found.collect()] == [(r["frame_id"], r["expected"]) for r in brute]
    assert n < u.count() / 10
    ticks = D.log_tables(u.select("video_id", "frame_id", "pi", "mu", "sigma").withColumn("cdf", D.mixture_cdf_columns(mu + 1, first=lam)))
    few = topk.select_candidates(ticks, h, lam, mu, b, first=lam).collect()
    assert [r["frame_id"] for r in few] == [r["frame_id"] for r in brute]


def test_equal_bounds_and_hopeless_frames_go_by_frame_id(spark):
    u = tables(spark, [[0.2, 0.5, 0.8, 1.0]] * 30)
    h = sums(u, 4)
    assert [r["frame_id"] for r in topk.select_candidates(u, h, 1, 2, 3).collect()] == [0, 1, 2]
    none = tables(spark, [[0.0, 0.0, 0.0, 1.0]] * 30)
    assert [r["frame_id"] for r in topk.select_candidates(none, sums(none, 4), 1, 2, 3).collect()] == [0, 1, 2]


def test_log_tables_of_a_range_of_ticks(spark):
    mix = random_mixtures(spark, 20)
    whole = {r["frame_id"]: r for r in D.log_tables(D.mixture_cdf(mix, 30)).collect()}
    for part in (D.log_tables(D.mixture_cdf(mix, 30, first=7)), D.log_tables(mix.withColumn("cdf", D.mixture_cdf_columns(30, first=7)))):
        for r in part.collect():
            assert np.allclose(r["log_cdf"], whole[r["frame_id"]]["log_cdf"][7:]) and np.allclose(r["log_pdf"][1:], whole[r["frame_id"]]["log_pdf"][8:])


@pytest.mark.parametrize("rule", ["cutoff", "expected"])
def test_sums_are_kept_up(spark, rule):
    frames = MixtureFrames(random_mixtures(spark, 400, 3, (0.1, 2.0)), 50)
    lam = 12
    for turn in range(3):
        conf, n_open = frames.at(lam + turn, 20, rule)
        fresh = topk.LogSums.of(frames.left(), frames.sums.first, frames.sums.last)
        assert frames.sums.n_inf == fresh.n_inf and frames.sums.n_open == fresh.n_open and np.allclose(frames.sums.finite, fresh.finite, atol=1e-9)
        assert n_open == frames.left().where(D.cdf_at(lam + turn) < 1.0).count()
        chosen = frames.cutoff(lam + turn, 0.9, 7) if rule == "cutoff" else frames.expected(lam + turn, lam + turn + 2, 7)
        rows = chosen.select(*frames.columns).collect()
        assert len(rows) == 7 and (conf == NEG or conf < math.log(0.9))
        frames.scored(spark.createDataFrame(rows, frames.frames.select(*frames.columns).schema), [(r["video_id"], r["frame_id"]) for r in rows])
    frames.close()


@pytest.mark.parametrize("rule", ["cutoff", "expected"])
def test_bins_choose_what_their_mixtures_would(spark, rule):
    proxy_rows = [(b, [1.0], [float(b)], [1.5]) for b in range(30)]
    bins = spark.createDataFrame(proxy_rows, "bin int, pi array<double>, mu array<double>, sigma array<double>")
    ids = spark.range(900).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_id"), F.pmod(F.col("id") * 7, F.lit(29)).cast("int").alias("bin"))
    binned, mixed = BinnedFrames(ids, bins, 50), MixtureFrames(ids.join(bins, "bin").drop("bin"), 50)
    for lam, most in ((27, 11), (28, 40), (29, 5)):
        got = [x.at(lam, 33, rule) for x in (binned, mixed)]
        assert got[0][1] == got[1][1] and got[0][0] == pytest.approx(got[1][0])
        rows = [x.cutoff(lam, 0.9, most) if rule == "cutoff" else x.expected(lam, 31, most) for x in (binned, mixed)]
        rows = [sorted((r["video_id"], r["frame_id"]) for r in df.collect()) for df in rows]
        assert rows[0] == rows[1] and len(rows[0]) == most
        for x in (binned, mixed):
            at = x.left().where(F.col("frame_id").isin([i for _, i in rows[0]])).select(*x.columns)
            x.scored(spark.createDataFrame(at.collect(), at.schema), rows[0])


def test_lowest_rows_of_many(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "ORDERED", 10)
    df = spark.range(500).select(F.col("id").alias("frame_id"), (F.pmod(F.col("id") * 37, F.lit(5)) / 10).alias("f"))
    want = sorted((r["f"], r["frame_id"]) for r in df.collect())[:333]
    assert sorted((r["f"], r["frame_id"]) for r in ordinals.lowest(df, F.floor(F.col("f") * 4), ["f", "frame_id"], 333).collect()) == want


def test_missing_rows_are_scored_first(spark):
    oracle, mix = proxy(spark, [1, 5, 9, 3])
    a = search.topk_frames(oracle, mix, k=2, num_train=0.0, num_valid=0.0, max_rounds=1)
    assert a.scored == 2 and {r["score"] for r in a.topk.collect()} == {9, 5}
