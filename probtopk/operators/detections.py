"""Boxes of frames: suppression, overlap joins and matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B

CORNERS = ["x1", "y1", "x2", "y2"]
KEPT = "frame_id long, det_id long, x1 double, y1 double, x2 double, y2 double, obj_conf double, cls_conf double, cls int"


def corner_boxes(detections: DataFrame) -> DataFrame:
    """Raw detections (frame_id, det_id, cx, cy, w, h, obj, cls_prob) as corner boxes with class and rank score."""
    corners = dict(zip(CORNERS, B.xywh_to_xyxy(*map(F.col, ("cx", "cy", "w", "h"))), strict=True))
    scored = detections.withColumns({**corners, **B.detection_scores(F.col("obj"), F.col("cls_prob"))})
    return scored.select("frame_id", "det_id", *CORNERS, F.col("obj").alias("obj_conf"), "cls_conf", "cls", "rank_score")


def _overlaps(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Overlap of one box with others, or of pairs of boxes; sides counted as pixels."""
    low, high = np.maximum(box[..., :2], others[..., :2]), np.minimum(box[..., 2:], others[..., 2:])
    shared = np.clip(high - low + 1, 0, None).prod(-1)
    area = lambda b: (b[..., 2:] - b[..., :2] + 1).prod(-1)
    return shared / (area(box) + area(others) - shared + B.TINY)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups, and the rows where groups begin (and the end), from batches sorted by keys.

    The last group of a batch waits for the next batch, so many small groups cost no more than their rows.
    """
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        starts = _starts(pdf, keys)
        last = starts[-1]
        held = pdf.iloc[last:]
        if last:
            yield pdf.iloc[:last].copy(), starts
    if held is not None and len(held):
        yield held.copy(), np.array([0, len(held)])


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Rows at which another group begins."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for key in keys:
        at = pdf[key].to_numpy()
        new[1:] |= at[1:] != at[:-1]
    return np.flatnonzero(new)


def _suppress(corners: np.ndarray, weight: np.ndarray, edges: np.ndarray, nms_thres: float) -> np.ndarray:
    """Which boxes stay; groups lie between edges, best box first. `corners` of boxes that absorb others are changed."""
    kept = np.ones(len(corners), bool)
    for at in np.flatnonzero(np.diff(edges) > 1):  # a box alone stays as it is
        rest = np.arange(edges[at], edges[at + 1])
        while len(rest) > 1:
            hit = _overlaps(corners[rest[0]], corners[rest]) > nms_thres
            hit[0] = True
            if hit.sum() > 1:
                corners[rest[0]] = np.average(corners[rest[hit]], axis=0, weights=weight[rest[hit]])
                kept[rest[hit][1:]] = False
            rest = rest[~hit]
    return kept


#: Pairs of boxes that are measured together.
PAIRS = 1 << 20


def _match(frame: np.ndarray, is_pred: np.ndarray, cls: np.ndarray, corners: np.ndarray, iou_thres: float) -> np.ndarray:
    """tp of every row. Rows are sorted by frame, in a frame the truth comes first, then predictions in the order in which they are matched.

    A prediction's best box does not depend on other predictions, so a box goes to the first that asks for it. Overlaps are measured
    for many pairs at once.
    """
    tp = np.zeros(len(frame), np.int32)
    truth = np.flatnonzero(~is_pred)
    if not len(truth):
        return tp
    key = frame.astype(np.int64)
    first = truth[np.searchsorted(key[truth], key, "left").clip(max=len(truth) - 1)]
    n_truth = np.searchsorted(key[truth], key, "right") - np.searchsorted(key[truth], key, "left")
    known = pd.MultiIndex.from_arrays([key, cls]).isin(pd.MultiIndex.from_arrays([key[truth], cls[truth]]))
    asks = np.flatnonzero(is_pred & (n_truth > 0) & known)
    ends = np.cumsum(n_truth[asks])
    best, low = np.full(len(frame), -1), 0
    while low < len(asks):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        rows, sizes = asks[low:high], n_truth[asks[low:high]]
        begin = np.cumsum(sizes) - sizes
        pred = np.repeat(rows, sizes)
        other = np.repeat(first[rows] - begin, sizes) + np.arange(len(pred))
        overlap = _overlaps(corners[pred], corners[other])
        top = np.maximum.reduceat(overlap, begin)
        at_top = np.flatnonzero(overlap == np.repeat(top, sizes))
        of_pred, place = np.unique(pred[at_top], return_index=True)  # the first of equal boxes
        enough = top[np.searchsorted(rows, of_pred)] >= iou_thres
        best[of_pred[enough]] = other[at_top[place[enough]]]
        low = high
    chosen = np.flatnonzero(best >= 0)
    _, turn = np.unique(best[chosen], return_index=True)
    tp[chosen[turn]] = 1
    return tp


def non_max_suppression(boxes: DataFrame, conf_thres: float = 0.1, nms_thres: float = 0.45) -> DataFrame:
    """Boxes (as of corner_boxes) after suppression.

    Within a frame and class, by descending rank score: the first box absorbs
    all that overlap it by more than the threshold; it stays with the mean of
    their corners, weighted by objectness. Equal rank scores go by det_id.
    """

    cols = ["frame_id", "cls", "det_id", *CORNERS, "obj_conf", "cls_conf"]
    order = ["frame_id", "cls", F.desc("rank_score"), "det_id"]
    dealt = boxes.where(F.col("obj_conf") >= conf_thres).repartition("frame_id").sortWithinPartitions(*order).select(*cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, edges in whole_groups(batches, ["frame_id", "cls"]):
            corners = pdf[CORNERS].to_numpy(float, copy=True)
            kept = _suppress(corners, pdf["obj_conf"].to_numpy(float), edges, nms_thres)
            pdf[CORNERS] = corners
            yield pdf.loc[kept, [c.split()[0] for c in KEPT.split(", ")]]

    return dealt.mapInPandas(run, KEPT)


def box_iou_join(pred: DataFrame, truth: DataFrame, min_iou: float) -> DataFrame:
    """Pairs of boxes of one frame that overlap by at least min_iou."""
    t = truth.select("frame_id", F.col("cls").alias("t_cls"), *[F.col(c).alias(f"t_{c}") for c in CORNERS])
    overlap = B.iou(B.columns(), B.columns("t_"))
    return pred.join(t, "frame_id").withColumn("iou", overlap).where(F.col("iou") >= min_iou)


MATCHES = "frame_id long, det_id long, cls int, conf double, tp int"


def _with_truth(pred: DataFrame, truth: DataFrame, *also: str) -> DataFrame:
    """Predictions and truth as one table that frames can be cut out of; is_pred tells them apart."""
    cols = ["det_id", "conf", *also]
    none = [F.lit(None).cast(pred.schema[c].dataType).alias(c) for c in cols]
    t = truth.select("frame_id", F.lit(0).alias("is_pred"), "cls", *CORNERS, *none)
    return t.unionByName(pred.select("frame_id", F.lit(1).alias("is_pred"), "cls", *CORNERS, *cols))


def match_detections(pred: DataFrame, truth: DataFrame, iou_thres: float = 0.5) -> DataFrame:
    """(frame_id, det_id, cls, conf, tp): one-to-one matches in order of det_id.

    A prediction is right if its class occurs in the frame's truth and its best
    box (of any class, the first of equals) overlaps enough and is still free.
    """
    dealt = _with_truth(pred, truth).repartition("frame_id").sortWithinPartitions("frame_id", "is_pred", "det_id", "cls", *CORNERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _ in whole_groups(batches, ["frame_id"]):
            is_pred = pdf["is_pred"].to_numpy() == 1
            tp = _match(pdf["frame_id"].to_numpy(), is_pred, pdf["cls"].to_numpy(), pdf[CORNERS].to_numpy(float), iou_thres)
            yield pdf.assign(tp=tp).loc[is_pred, ["frame_id", "det_id", "cls", "conf", "tp"]].astype({"det_id": "int64"})

    return dealt.mapInPandas(run, MATCHES)


def suppress_and_match(boxes: DataFrame, truth: DataFrame, conf_thres: float = 0.1, nms_thres: float = 0.45, iou_thres: float = 0.5) -> DataFrame:
    """What match_detections gives for the boxes that non_max_suppression leaves, with their objectness as conf: one exchange, one pass.

    `boxes` are as of corner_boxes. Boxes and truth of a frame come to one task together, which suppresses and then matches.
    """
    pred = boxes.where(F.col("obj_conf") >= conf_thres).withColumnRenamed("obj_conf", "conf")
    rank = F.when(F.col("is_pred") == 1, -F.col("rank_score"))
    dealt = _with_truth(pred, truth, "rank_score").repartition("frame_id")
    dealt = dealt.sortWithinPartitions("frame_id", "is_pred", "cls", rank, "det_id", *CORNERS).drop("rank_score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _ in whole_groups(batches, ["frame_id"]):
            is_pred, corners = pdf["is_pred"].to_numpy() == 1, pdf[CORNERS].to_numpy(float, copy=True)
            kept = ~is_pred
            pred = pdf.loc[is_pred]
            if len(pred):
                mine = corners[is_pred]
                edges = np.append(_starts(pred, ["frame_id", "cls"]), len(pred))
                kept[is_pred] = _suppress(mine, pred["conf"].to_numpy(float), edges, nms_thres)
                corners[is_pred] = mine
            pdf[CORNERS] = corners
            left = pdf.loc[kept].sort_values(["frame_id", "is_pred", "det_id"], kind="stable")
            is_pred = left["is_pred"].to_numpy() == 1
            tp = _match(left["frame_id"].to_numpy(), is_pred, left["cls"].to_numpy(), left[CORNERS].to_numpy(float), iou_thres)
            yield left.assign(tp=tp).loc[is_pred, ["frame_id", "det_id", "cls", "conf", "tp"]].astype({"det_id": "int64"})

    return dealt.mapInPandas(run, MATCHES)
