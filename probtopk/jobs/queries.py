"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import distribution as D
from ..operators import detections, difference, metrics, sampling, scoring, topk, windows
from ..operators.scoring import ScoringUDF
from ..sources import frames as sources
from ..sources.shared import scratch, written
from . import fixtures as X
from . import query, search

MAX = X.MAX_SCORE
K = 100
LAM, MU = 30, 33
REF_DIST, DIFF = 30, 0.030


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded to 6 digits, without a negative zero; more digits where short decimals would end in a 5."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, digits) + 0.0).alias(name or c)


def listed(column: str, *, name: str = "v", index: str = "i") -> list[Column]:
    return [F.posexplode(column).alias(index, name)]


def _labelled(s: SparkSession, d: str) -> DataFrame:
    f = X.frames(s, d)
    return sampling.split_frames(f, 500, 300, 0)


# Sources.
def read_frames(s, d):
    """Frames stored as Parquet, read back from an offset on."""
    path = scratch(s, "frames")
    X.frames(s, d).write.parquet(path)
    return sources.read_frames(s, path, 100, 5000).select("frame_id", "score", "k")


def read_oracle(s, d):
    path = scratch(s, "oracle")
    X.frames(s, d).write.parquet(path)
    return sources.read_oracle(s, path, 250)


def read_frame_dir(s, d):
    """The numbers that files named by event would get."""
    return sources.frame_numbers(X.table(s, d, "events").select(F.concat(F.lit("f"), F.col("event_id") * 7, F.lit(".jpg")).alias("name")))


def decode_box_blobs(s, d):
    boxes = X.boxes(s, d).select("frame_id", F.col("det_id"), *detections.CORNERS, "obj_conf", "cls_conf", "cls")
    return sources.decode_box_blobs(sources.encode_box_blobs(boxes))


def saved_stage(s, d):
    folder = scratch(s, "stages")
    sources.save_stage(X.frames(s, d), folder, "frames")
    return sources.load_stage(s, folder, "frames").select("frame_id", "score", "k")


def video_prefix(s, d):
    return X.table(s, d, "pages").select("page_id", sources.video_prefix(F.col("url")).alias("prefix"))


# Sampling.
def split_sizes(s, d):
    n = X.frames(s, d).count()
    rows = [(*given, *sampling.split_sizes(n, *given)) for given in ((0.005, 3000.0), (0.0333, 0.25), (1.0, 0.0), (250.0, 1.0))]
    return s.createDataFrame(rows, "num_train double, num_valid double, n_train long, n_valid long")


def split_frames(s, d):
    return _labelled(s, d)


def sample_per_window(s, d):
    return sampling.sample_per_window(X.videos(s, d), 64, 6, 0).select("video_id", "window_id", "frame_id", "score")


def complement(s, d):
    f = X.frames(s, d)
    return sampling.complement(f.select("video_id", "frame_id"), _labelled(s, d).where("split != 'test'"))


def union_certain(s, d):
    f = X.frames(s, d)
    labelled, cleaned, mirrors = f.where("k < 50"), f.where("k >= 50 AND k < 80"), f.where("k >= 80")
    return sampling.union_certain(labelled, cleaned, mirrors)


def multiset_overlap(s, d):
    f = X.frames(s, d)
    return sampling.multiset_overlap(f.where("k < 50"), f.where("k >= 50"), "score")


# Difference detector.
def segment(s, d):
    return difference.segment(X.embedded(s, d), REF_DIST).drop("features")


def pick_reference(s, d):
    refs = difference.pick_reference(difference.segment(X.embedded(s, d), REF_DIST))
    return refs.select("video_id", "seg", "ref_id", F.size("ref_features").alias("n_features"))


def mse_diff(s, d):
    e = X.embedded(s, d)
    nxt = e.select((F.col("frame_id") - 1).alias("frame_id"), F.col("features").alias("other"))
    return e.join(nxt, "frame_id").select("frame_id", r6(difference.mse_diff(F.col("features"), F.col("other")), "diff"))


def difference_detect(s, d):
    return difference.difference_detect(X.embedded(s, d), DIFF, REF_DIST).withColumn("diff", r6("diff"))


def difference_detect_stored(s, d):
    """The same from frames stored by segment, which are compared where they are read."""
    stored = difference.store_segments(X.embedded(s, d), REF_DIST, scratch(s, "segments"))
    return difference.detect_stored(stored, DIFF).withColumn("diff", r6("diff"))


def mirror_lists(s, d):
    found = difference.mirror_lists(difference.difference_detect(X.embedded(s, d), DIFF, REF_DIST))
    return found.select("video_id", "frame_id", F.array_join(F.col("mirrors").cast("array<string>"), ",").alias("mirrors"))


# Oracle and proxy.
class TheCount(ScoringUDF):
    """Counts of `The` and `the` in a text, at most 49."""

    def score(self, batch: pd.DataFrame) -> list[int]:
        return batch["text"].fillna("").str.count("[Tt]he").tolist()


def apply_oracle(s, d):
    docs = X.table(s, d, "documents").select("doc_id", "text")
    return scoring.apply_oracle(docs, TheCount(), MAX).select("doc_id", "score")


def lookup_scores(s, d):
    return scoring.lookup_scores(_labelled(s, d).where("split = 'valid'"), X.frames(s, d))


def object_count(s, d):
    orders = X.table(s, d, "orders").select(F.col("o_orderkey").alias("frame_id"))
    return scoring.object_count(X.boxes(s, d), orders, 2, 0.3, 0.92)


def smooth_labels(s, d):
    return scoring.smooth_labels(X.videos(s, d), 5).withColumn("smoothed", r6("smoothed"))


def smooth_labels_filters(s, d):
    """The median and the greatest score around every frame."""
    keys = ["video_id", "frame_id"]
    middle = scoring.smooth_labels(X.videos(s, d), 6, of_list=scoring.median_of).select(*keys, F.col("smoothed").alias("median"))
    return middle.join(scoring.smooth_labels(X.videos(s, d), 6, F.max).select(*keys, F.col("smoothed").alias("greatest")), keys)


def _binned(s, d):
    f = X.frames(s, d)
    return f.withColumn("bin", scoring.feature_bin(F.col("value") + F.col("k") / 10.0, 0.0, 500.0, 40))


def fit_binned_proxy(s, d):
    fitted = scoring.fit_binned_proxy(_binned(s, d), 40, 0.6, MAX)
    return fitted.select("bin", *listed("pi", name="pi", index="score")).withColumn("pi", r6("pi"))


class Linear:
    """A proxy of two components around a linear function of one column."""

    def predict(self, batch: pd.DataFrame):
        mu = batch["value"].to_numpy(float)[:, None] / 10 + [0.0, 1.0]
        return [[0.75, 0.25]] * len(mu), mu.tolist(), [[0.5, 1.0]] * len(mu)


def apply_proxy(s, d):
    mix = scoring.apply_proxy(X.frames(s, d), Linear())
    return mix.select("frame_id", *[r6(F.get(c, F.lit(i)), f"{c}_{i}") for c in ("pi", "mu", "sigma") for i in (0, 1)])


def model_grid(s, d):
    bins = X.frames(s, d).agg((F.max("score") + 1).alias("n"))
    grid = scoring.model_grid(s, {"m": [5, 8, 10, 15], "h": [20, 30, 40]})
    return grid.crossJoin(bins)


def _model_nll(s, d):
    f = X.mixtures(s, d, "noisy")
    grid = s.createDataFrame([(i, x) for i, x in enumerate((0.3, 0.6, 1.2))], "model_id int, width double")
    each = f.join(F.broadcast(grid)).withColumn("sigma", F.array("width"))
    return each.select("model_id", D.mixture_nll(F.col("score")).alias("nll"))


def select_model(s, d):
    return scoring.select_model(_model_nll(s, d)).withColumn("nll", r6("nll"))


# Distributions.
def normal_cdf(s, d):
    f = X.frames(s, d)
    return f.select("frame_id", r6(D.normal_cdf(F.lit(20.5), F.col("score") + (F.col("k") - F.lit(49.5)) / 50.0, F.lit(2.0)), "p"))


def mixture_cdf(s, d):
    c = D.mixture_cdf(X.mixtures(s, d, "two"), MAX)
    return c.select("frame_id", *listed("cdf", name="cdf", index="s")).withColumn("cdf", r6("cdf"))


def log_tables(s, d):
    c = D.log_tables(D.mixture_cdf(X.mixtures(s, d, "two"), MAX))
    each = c.select("frame_id", F.posexplode(F.arrays_zip("log_cdf", "log_pdf")).alias("s", "l"))
    # Probabilities: logarithms of values near 0 differ by more than a digit.
    return each.select("frame_id", "s", r6(F.exp("l.log_cdf"), "cdf"), r6(F.exp("l.log_pdf"), "pdf"), (F.col("l.log_pdf") == D.NEG_INF).alias("never"))


def mixture_moments(s, d):
    return D.mixture_moments(X.mixtures(s, d, "two")).select("frame_id", r6("mean"), r6("var"))


def mixture_nll(s, d):
    return X.mixtures(s, d, "two").select("frame_id", r6(D.mixture_nll(F.col("score")), "nll"))


def logsumexp(s, d):
    f = X.mixtures(s, d, "two")
    return f.select("frame_id", r6(D.logsumexp(F.concat("mu", "pi")), "v"))


def hypotheses_to_mixture(s, d):
    at = lambda c: F.col(c).cast("double")
    h = F.array(at("score"), at("score") + 1.0, at("score") - at("k") / 50.0)
    z = F.array(F.array(at("k") / 100.0, F.lit(0.5), F.lit(-1.0)), F.array(F.lit(0.25), at("score") / 10.0, at("k") / 40.0))
    mix = D.hypotheses_to_mixture(X.frames(s, d).select("frame_id", h.alias("h"), z.alias("z")))
    return mix.select("frame_id", *[r6(F.get(c, F.lit(i)), f"{c}_{i}") for c in ("pi", "mu", "sigma") for i in (0, 1)])


def round_half_even(s, d):
    return X.frames(s, d).select("frame_id", D.round_half_even(F.col("k") / 2.0).alias("v"))


# Aggregations and clips.
def score_weights(s, d):
    return scoring.score_weights(X.frames(s, d), MAX).withColumn("weight", r6("weight"))


def _uncertain(s, d, kind="two"):
    return D.log_tables(D.mixture_cdf(X.mixtures(s, d, kind).select("video_id", "frame_id", "pi", "mu", "sigma"), MAX))


def column_log_sums(s, d):
    sums = topk.column_log_sums(_uncertain(s, d), MAX)
    return sums.select("s", F.round("finite", 3).alias("finite"), "n_inf")


def calibration_profile(s, d):
    m = D.mixture_moments(X.mixtures(s, d, "noisy"))
    profile = scoring.calibration_profile(m.select("score", "mean", "var"))
    return profile.select(F.coalesce("score", F.lit(-1)).alias("score"), "n", r6("mean"), r6("var"), r6("mse"))  # -1: all scores


def window_distribution(s, d):
    w = windows.window_distribution(X.mixtures(s, d, "two"), 64)
    return w.select("video_id", "window_id", r6(F.get("mu", F.lit(0)), "mu", 11), r6(F.get("sigma", F.lit(0)), "sigma"))


def window_truth(s, d):
    return windows.window_truth(X.videos(s, d), 30)


def sampled_window_scores(s, d):
    v = X.videos(s, d)
    clips = v.select("video_id", windows.window_id(64).alias("window_id")).distinct()
    return windows.sampled_window_scores(clips, v, 64, 6)


def result_summary(s, d):
    return topk.result_summary(topk.exact_topk(X.frames(s, d), K))


# Joins.
def complete_mixtures(s, d):
    f = X.mixtures(s, d, "noisy")
    labelled = f.where("k < 5")
    mirrors = f.where("k >= 5 AND frame_id % 10 != 0").select("video_id", "frame_id", (F.floor(F.col("frame_id") / 10) * 10).alias("ref_id"))
    whole = windows.complete_mixtures(labelled, f.where("k >= 5 AND frame_id % 10 = 0"), mirrors)
    return whole.select("video_id", "frame_id", r6(F.get("mu", F.lit(0)), "mu"), r6(F.get("sigma", F.lit(0)), "sigma"))


def propagate_mirrors(s, d):
    f = X.frames(s, d)
    mirrors = f.where("frame_id % 10 != 0").select("video_id", "frame_id", (F.floor(F.col("frame_id") / 10) * 10).alias("ref_id"))
    return windows.propagate_mirrors(f.where("frame_id % 10 = 0 AND score > 5"), mirrors)


def box_iou_join(s, d):
    pairs = detections.box_iou_join(X.boxes(s, d), X.truth_boxes(s, d), 0.3)
    return pairs.select("frame_id", "det_id", "cls", "t_cls", r6("t_x1"), r6("t_y1"), r6("iou"))


# Top-k.
def exact_topk(s, d):
    return topk.exact_topk(X.frames(s, d).select("video_id", "frame_id", "score"), K)


def merge_topk(s, d):
    f = X.frames(s, d).select("video_id", "frame_id", "score", "k")
    cols = ["video_id", "frame_id", "score"]
    return topk.merge_topk(topk.exact_topk(f.where("k < 50").select(cols), K), topk.exact_topk(f.where("k >= 50").select(cols), K), K)


def thresholds(s, d):
    return topk.thresholds(topk.exact_topk(X.frames(s, d), K))


def topk_confidence(s, d):
    return topk.topk_confidence(_uncertain(s, d), 48).select(F.round("log_confidence", 4).alias("log_confidence"))


def bootstrap_candidates(s, d):
    u = _uncertain(s, d).withColumn("first", F.get("log_cdf", F.lit(0)))
    return topk.bootstrap_candidates(u, K).select("video_id", "frame_id")


def _open(s, d):
    """Frames of a wide proxy whose CDF is below 1 at the threshold, and the log sums over them (one row of numbers per score)."""
    u = _uncertain(s, d, "wide").where(F.get("log_cdf", F.lit(LAM)) < 0)
    rows = {r["s"]: (r["finite"], r["n_inf"]) for r in topk.column_log_sums(u, MAX).collect()}
    return u, [rows[i] for i in range(MAX)]


def expected_confidence(s, d):
    u, h = _open(s, d)
    return topk.expected_confidence(u, h, LAM, MU).select("frame_id", F.round("expected", 4).alias("expected"))


def upper_bound(s, d):
    u, h = _open(s, d)
    both = topk.upper_bound(topk.expected_confidence(u, h, LAM, MU), h, LAM, MU)
    return both.select("frame_id", F.round("bound", 4).alias("bound"), (F.col("bound") >= F.col("expected") - 1e-9).alias("holds"))


def select_candidates(s, d):
    u, h = _open(s, d)
    return topk.select_candidates(u, h, LAM, MU, 20).select(F.round("expected", 4).alias("expected"))


def cutoff_candidates(s, d):
    m = X.mixtures(s, d, "noisy").withColumn("f", D.cdf_at(LAM)).where("f < 1.0")
    return topk.cutoff_candidates(m, 0.9).select("frame_id", r6("f"))


def _answer(s, d, kind):
    m = X.mixtures(s, d, kind)
    scores = m.select("video_id", "frame_id", "score")
    return search.topk_frames(scores, m.select("video_id", "frame_id", "pi", "mu", "sigma"), k=K, num_train=0.04, num_valid=0.01)


def topk_frames(s, d):
    return metrics.by_rank(_answer(s, d, "noisy").topk)


def topk_frames_exact_proxy(s, d):
    return metrics.by_rank(_answer(s, d, "exact").topk)


def topk_frames_deduplicated(s, d):
    """Search over embeddings after the difference detector; a discarded frame takes its reference's score."""
    e = X.embedded(s, d)
    m = e.select("video_id", "frame_id", *[F.array(F.lit(x) if isinstance(x, float) else F.col(x).cast("double")).alias(n) for n, x in (("pi", 1.0), ("mu", "score"), ("sigma", 0.1))])
    found = search.detect_and_search(e, e.select("video_id", "frame_id", "score"), m, DIFF, REF_DIST, k=20, num_train=0.0, num_valid=0.0)
    return metrics.by_rank(found.topk)


def _featured(s, d):
    """Frames with a cheap feature and no score, and their scores."""
    f = X.frames(s, d)
    return f.select("video_id", "frame_id", (F.col("value") + F.col("k") / 10.0).alias("feature")), f.select("video_id", "frame_id", "score")


FRAME_OPTIONS = query.Options(low=0.0, high=500.0, bins=(25, 50), max_score=MAX, num_train=0.1, num_valid=0.05)


def query_frames(s, d):
    """The whole query: split, labels, proxy, scan, search."""
    frames, scores = _featured(s, d)
    return metrics.by_rank(query.query_frames(frames, scores, FRAME_OPTIONS, k=K, conf_thres=0.99, cap=1024).topk)


class Fitted(scoring.ProxyModel):
    """Two components around a line through the labelled frames."""

    def fit(self, train: DataFrame) -> Fitted:
        row = train.agg(F.regr_slope("score", "feature").alias("slope"), F.regr_intercept("score", "feature").alias("start")).first()
        self.slope, self.start = row["slope"], row["start"]
        return self

    def predict(self, batch: pd.DataFrame):
        mu = batch["feature"].to_numpy(float)[:, None] * self.slope + self.start + [-0.4, 0.4]
        return [[0.5, 0.5]] * len(mu), mu.tolist(), [[0.4, 0.4]] * len(mu)


def query_frames_model(s, d):
    """The whole query with a proxy of the user's own, which has the least validation loss."""
    frames, scores = _featured(s, d)
    options = replace(FRAME_OPTIONS, models=(Fitted(),))
    return metrics.by_rank(query.query_frames(frames, scores, options, k=K, conf_thres=0.999, cap=1024).topk)


def query_frames_expected(s, d):
    """The whole query by the rule of the largest expected confidence."""
    frames, scores = _featured(s, d)
    return metrics.by_rank(query.query_frames(frames, scores, FRAME_OPTIONS, k=K, conf_thres=0.99, cap=256, rule="expected").topk)


def query_windows_whole(s, d):
    """The whole query for clips, scored by all of their frames."""
    frames, scores = _featured(s, d)
    return metrics.by_rank(query.query(frames, scores, FRAME_OPTIONS, 30, 1.0, k=20, conf_thres=0.999).topk)


def query_frames_deduplicated(s, d):
    """The whole query over embeddings with labelled frames: near-duplicate test frames take their reference's score."""
    e = X.embedded(s, d)
    frames = e.select("video_id", "frame_id", "features", (F.col("score") + 0.5).alias("feature"))
    options = query.Options(low=0.0, high=10.0, bins=(10,), sigmas=(0.1, 0.3), max_score=10, num_train=0.2, num_valid=0.1, diff_thres=DIFF, ref_dist=REF_DIST)
    return metrics.by_rank(query.query_frames(frames, e.select("video_id", "frame_id", "score"), options, k=20, conf_thres=0.99).topk)


def query_documents(s, d):
    """The whole query with a scorer that runs on the chosen documents only; the feature is a count of letters."""
    docs = X.table(s, d, "documents").select(F.lit("v0").alias("video_id"), F.col("doc_id").alias("frame_id"), "text", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("he")).cast("double").alias("feature"))
    options = query.Options(low=0.0, high=100.0, bins=(50, 100), max_score=MAX, num_train=0.1, num_valid=0.05)
    return metrics.by_rank(query.query_frames(docs, TheCount(), options, k=20, conf_thres=0.99).topk)


def query_windows(s, d):
    """The whole query for clips, scored by half of their frames."""
    frames, scores = _featured(s, d)
    answer = query.query_windows(frames, scores, FRAME_OPTIONS, 30, 0.5, k=20, conf_thres=0.9)
    return answer.topk.select(F.col("frame_id").alias("window_id"), "score")


def topk_windows(s, d):
    m = X.mixtures(s, d, "exact")
    a = search.topk_windows(m.select("video_id", "frame_id", "score"), m.select("video_id", "frame_id", "pi", "mu", "sigma"), 30, 1.0, k=50)
    return metrics.by_rank(a.topk)


# Quality of answers.
def _approx(s, d):
    """An answer that misses some frames."""
    return topk.exact_topk(X.frames(s, d).where("k < 80").select("video_id", "frame_id", "score"), K)


def precision_at_k(s, d):
    return metrics.precision_at_k(_approx(s, d), topk.exact_topk(X.frames(s, d), K))


def rank_distance(s, d):
    return metrics.rank_distance(_approx(s, d), X.frames(s, d)).withColumn("rank_distance", r6("rank_distance"))


def score_error(s, d):
    return metrics.score_error(_approx(s, d), topk.exact_topk(X.frames(s, d), K)).withColumn("score_error", r6("score_error"))


def evaluate_topk(s, d):
    e = metrics.evaluate_topk(_approx(s, d), X.frames(s, d), K)
    return e.select(r6("precision"), r6("rank_distance"), r6("score_error"))


def _matches(s, d):
    """Predictions that are right where their flag is R, as a stand-in for matching."""
    return X.boxes(s, d).select("frame_id", "det_id", "cls", F.col("obj_conf").alias("conf"), (F.col("flag") == "R").cast("int").alias("tp"))


def pr_curve(s, d):
    c = metrics.pr_curve(_matches(s, d), X.truth_boxes(s, d))
    return c.select("frame_id", "det_id", "cls", "rank", "tpc", "fpc", r6("recall"), r6("precision"))


def average_precision(s, d):
    t = X.truth_boxes(s, d)
    ap = metrics.average_precision(metrics.pr_curve(_matches(s, d), t), t)
    return ap.select("cls", r6("ap"), r6("precision"), r6("recall"), r6("f1"))


def detector_quality(s, d):
    """From raw detections to average precision: class scores, suppression, matching, curve."""
    raw = X.boxes(s, d).withColumn("cls_prob", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.col("cls"), F.col("cls_conf")).otherwise(0.0)))
    boxes = detections.corner_boxes(raw.withColumnRenamed("obj_conf", "obj").drop("x1", "y1", "x2", "y2", "cls", "cls_conf"))
    truth = X.truth_boxes(s, d)
    matches = detections.suppress_and_match(boxes, truth, 0.1, 0.45, 0.5)
    matches = written(matches, scratch(s, "matches"))  # the curve samples its rows before it deals them
    ap = metrics.average_precision(metrics.pr_curve(matches, truth), truth)
    return ap.select("cls", r6("ap"), r6("precision"), r6("recall"), r6("f1"))


# Boxes.
def xywh_to_xyxy(s, d):
    b = X.boxes(s, d).select("frame_id", "det_id", "cx", "cy", "w", "h")
    corners = B.xywh_to_xyxy(*map(F.col, ("cx", "cy", "w", "h")))
    return b.select("frame_id", "det_id", *[c.alias(n) for c, n in zip(corners, detections.CORNERS, strict=True)])


def _neighbours(s, d):
    """Each box beside the next one of its frame."""
    b = X.boxes(s, d)
    nxt = Window.partitionBy("frame_id").orderBy("det_id")
    cols = ["x1", "y1", "x2", "y2", "cx", "cy", "w", "h"]
    return b.select("*", *[F.lead(c).over(nxt).alias(f"n_{c}") for c in cols]).where("n_x1 IS NOT NULL")


def iou(s, d):
    b = _neighbours(s, d)
    size = ("cx", "cy", "w", "h")
    return b.select("frame_id", "det_id", r6(B.iou(B.columns(), B.columns("n_")), "iou"), r6(B.iou(B.columns("", size), B.columns("n_", size), False), "iou_xywh"))


def iou_variant(s, d):
    b = _neighbours(s, d)
    kinds = ("iou", "giou", "diou", "ciou")
    return b.select("frame_id", "det_id", *[r6(B.iou_variant(B.columns(), B.columns("n_"), k), k) for k in kinds])


def wh_iou(s, d):
    return _neighbours(s, d).select("frame_id", "det_id", r6(B.wh_iou(F.col("w"), F.col("h"), F.col("n_w"), F.col("n_h")), "v"))


def rescale_boxes(s, d):
    b = X.boxes(s, d)
    height, width = F.lit(480) + F.col("cls") * 60, F.lit(640)
    out = B.rescale(B.columns(), 416, height, width)
    return b.select("frame_id", "det_id", *[r6(c, n) for c, n in zip(out, detections.CORNERS, strict=True)])


def relative_boxes(s, d):
    b = X.boxes(s, d)
    height, width = F.lit(480.0), F.lit(640.0)
    rel = B.to_relative([F.col(c) for c in ("cx", "cy", "w", "h")], height, width)
    back = B.to_absolute(rel, height, width)
    cols = [*zip(rel, ("cx", "cy", "w", "h"), strict=True), (B.flip_horizontal(rel[0]), "flipped"), (back[3], "h_back")]
    return b.select("frame_id", "det_id", *[r6(c, n, 10) for c, n in cols])


def detection_scores(s, d):
    b = X.boxes(s, d).withColumn("cls_prob", F.array(*[F.when(F.col("cls") == i, F.col("cls_conf")).otherwise(F.lit(0.01 * i)) for i in range(5)]))
    scored = b.select("frame_id", "det_id", "obj_conf", *[c.alias(n) for n, c in B.detection_scores(F.col("obj_conf"), F.col("cls_prob")).items()])
    return scored.where("obj_conf >= 0.3").select("frame_id", "det_id", "cls", r6("cls_conf"), r6("rank_score", digits=11))


def non_max_suppression(s, d):
    b = X.boxes(s, d).withColumn("rank_score", F.col("obj_conf") * F.col("cls_conf"))
    kept = detections.non_max_suppression(b, 0.1, 0.45)
    return kept.select("frame_id", "det_id", "cls", *[r6(c) for c in detections.CORNERS])


def match_detections(s, d):
    pred = X.boxes(s, d).withColumnRenamed("obj_conf", "conf")
    return detections.match_detections(pred, X.truth_boxes(s, d), 0.5)


_NAMES = """read_frame_dir read_frames read_oracle decode_box_blobs saved_stage video_prefix split_sizes split_frames sample_per_window complement union_certain multiset_overlap
segment pick_reference mse_diff difference_detect difference_detect_stored mirror_lists apply_oracle apply_proxy lookup_scores object_count smooth_labels smooth_labels_filters
fit_binned_proxy model_grid select_model normal_cdf mixture_cdf log_tables mixture_moments mixture_nll logsumexp
hypotheses_to_mixture round_half_even score_weights column_log_sums calibration_profile window_distribution window_truth
sampled_window_scores result_summary complete_mixtures propagate_mirrors box_iou_join exact_topk merge_topk thresholds
topk_confidence bootstrap_candidates expected_confidence upper_bound select_candidates cutoff_candidates topk_frames
topk_frames_exact_proxy topk_frames_deduplicated topk_windows query_frames query_frames_model query_frames_expected query_windows_whole query_frames_deduplicated query_documents query_windows precision_at_k rank_distance score_error evaluate_topk
pr_curve average_precision detector_quality xywh_to_xyxy iou iou_variant wh_iou rescale_boxes relative_boxes detection_scores
non_max_suppression match_detections"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: globals()[n] for n in _NAMES.split()}
