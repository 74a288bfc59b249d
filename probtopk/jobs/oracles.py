"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions.distribution import ERF_A, ERF_P, FLOOR, LOG_SQRT_2PI, SNAP, SQRT2
from ..functions.boxes import EPS, TINY
from .fixtures import BOXES, EMBEDDED, FRAMES, VIDEOS, mixtures_sql
from .queries import DIFF, K, LAM, MAX, MU, REF_DIST

INF = "'-Infinity'::DOUBLE"


def phi(x: str, mu: str, sigma: str) -> str:
    """Normal CDF by the same polynomial."""
    z = f"((({x}) - ({mu})) / (({sigma}) * {SQRT2}::DOUBLE))"
    t = f"(1.0::DOUBLE / (abs({z}) * {ERF_P}::DOUBLE + 1.0::DOUBLE))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly}) + ({a})::DOUBLE) * {t}"
    return f"((sign({z}) * (({poly}) * -1.0::DOUBLE * exp({z} * {z} * -1.0::DOUBLE) + 1.0::DOUBLE) + 1.0::DOUBLE) * 0.5::DOUBLE)"


def snap(x: str) -> str:
    return f"CASE WHEN {x} >= {SNAP} THEN 1.0::DOUBLE WHEN {x} < {FLOOR} THEN 0.0::DOUBLE ELSE {x} END"


def cdf_at(tick: str) -> str:
    total = f"list_sum(list_transform(range(1, len(pi) + 1), lambda m: pi[m] * {phi(tick, 'mu[m]', 'sigma[m]')}))"
    return f"list_transform([{total}], lambda c: {snap('c')})[1]"


def cdfs(kind: str) -> str:
    """The mixtures with cdf."""
    return f"(SELECT *, list_transform(range(0, {MAX}), lambda i: {cdf_at('i + 0.5::DOUBLE')}) AS cdf FROM {mixtures_sql(kind)})"


def ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) ELSE {INF} END"


def logs(kind: str) -> str:
    step = f"CASE WHEN i = 1 THEN cdf[1] ELSE cdf[i] - cdf[i - 1] END"
    return f"""(SELECT *, list_transform(cdf, lambda c: {ln('c')}) AS log_cdf,
      list_transform(list_transform(range(1, {MAX} + 1), lambda i: {step}), lambda p: CASE WHEN p >= {FLOOR} THEN ln(p) ELSE {INF} END) AS log_pdf
      FROM {cdfs(kind)})"""


MEAN = "list_sum(list_transform(range(1, len(pi) + 1), lambda i: pi[i] * mu[i]))"
VAR = "list_sum(list_transform(range(1, len(pi) + 1), lambda i: pi[i] * (sigma[i] * sigma[i] + mu[i] * mu[i] - mean * mean)))"


def moments(kind: str) -> str:
    return f"(SELECT *, {VAR} AS var FROM (SELECT *, {MEAN} AS mean FROM {mixtures_sql(kind)}))"


SPLIT = f"""(SELECT video_id, frame_id, CASE WHEN r <= 500 THEN 'train' WHEN r <= 800 THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('0:' || video_id || ':' || frame_id), video_id, frame_id) AS r FROM {FRAMES}))"""


def topk(source: str, k: int = K, where: str = "true") -> str:
    return f"(SELECT video_id, frame_id, score FROM {source} WHERE {where} ORDER BY score DESC, frame_id DESC LIMIT {k})"


def by_rank(source: str) -> str:
    return f"(SELECT row_number() OVER (ORDER BY score DESC, frame_id DESC)::INT AS r, score FROM {source})"


def clips(source: str, window: int) -> str:
    return f"(SELECT video_id, frame_id // {window} AS window_id, CAST(round_even(avg(score), 0) AS INT) AS score FROM {source} GROUP BY ALL)"


def sampled(source: str, window: int, n: int) -> str:
    return f"""(SELECT video_id, window_id, frame_id, score FROM (
      SELECT video_id, frame_id // {window} AS window_id, frame_id, score,
        row_number() OVER (PARTITION BY video_id, frame_id // {window} ORDER BY md5('0:' || video_id || ':' || frame_id), frame_id) AS turn
      FROM {source}) WHERE turn <= {n})"""


SEGMENTS = f"""(SELECT *, count(*) OVER (PARTITION BY video_id, seg)::INT AS seg_len FROM (
  SELECT *, pos // {REF_DIST} AS seg, (pos % {REF_DIST})::INT AS pos_in_seg FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS pos FROM {EMBEDDED})))"""
REFS = f"(SELECT video_id, seg, frame_id AS ref_id, features AS ref_features FROM {SEGMENTS} WHERE pos_in_seg = seg_len // 2)"


def mse(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE))) / len({a})"


DETECTED = f"""(SELECT *, diff < {DIFF} AND frame_id <> ref_id AS discarded FROM (
  SELECT s.video_id, s.frame_id, r.ref_id, {mse('s.features', 'r.ref_features')} AS diff FROM {SEGMENTS} s JOIN {REFS} r ON s.video_id = r.video_id AND s.seg = r.seg))"""

#: The embeddings of the whole query: a fifth is labelled train, a tenth valid, the others are cut into segments by their rank.
LABELLED_FIRST = f"""(SELECT *, row_number() OVER (ORDER BY md5('0:' || video_id || ':' || frame_id), video_id, frame_id)
  > floor(count(*) OVER () * 0.2::DOUBLE) + floor(count(*) OVER () * 0.1::DOUBLE) AS is_test FROM {EMBEDDED})"""
TEST_SEGMENTS = f"""(SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY frame_id) - 1 AS at, count(*) OVER (PARTITION BY video_id, seg) AS n FROM (
  SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1) // {REF_DIST} AS seg FROM {LABELLED_FIRST} WHERE is_test))"""
DEDUPLICATED = f"""(SELECT s.video_id, s.frame_id, CASE WHEN {mse('s.features', 'r.features')} < {DIFF} THEN r.score ELSE s.score END AS score
  FROM {TEST_SEGMENTS} s JOIN {TEST_SEGMENTS} r ON r.video_id = s.video_id AND r.seg = s.seg AND r.at = r.n // 2
  UNION ALL SELECT video_id, frame_id, score FROM {LABELLED_FIRST} WHERE NOT is_test)"""

NEIGHBOURS = "(SELECT * FROM (SELECT *, " + ", ".join(f"lead({c}) OVER (PARTITION BY frame_id ORDER BY det_id) AS n_{c}" for c in "x1 y1 x2 y2 cx cy w h".split()) + f" FROM {BOXES}) WHERE n_x1 IS NOT NULL)"
TRUTH = f"(SELECT * FROM {BOXES} WHERE flag = 'R')"


def box_iou(a: list[str], b: list[str]) -> str:
    inter = f"greatest(least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]}) + 1.0, 0.0) * greatest(least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}) + 1.0, 0.0)"
    area = lambda c: f"({c[2]} - {c[0]} + 1.0) * ({c[3]} - {c[1]} + 1.0)"
    return f"({inter}) / ({area(a)} + {area(b)} - {inter} + {TINY}::DOUBLE)"


CORNERS = ["x1", "y1", "x2", "y2"]
OTHERS = [f"n_{c}" for c in CORNERS]
VARIANTS = f"""(SELECT *, inter / uni AS iou FROM (SELECT *, wa * ha + wb * hb - inter + {EPS} AS uni FROM (
  SELECT *, greatest(least(x2, n_x2) - greatest(x1, n_x1), 0.0) * greatest(least(y2, n_y2) - greatest(y1, n_y1), 0.0) AS inter,
    x2 - x1 AS wa, y2 - y1 + {EPS} AS ha, n_x2 - n_x1 AS wb, n_y2 - n_y1 + {EPS} AS hb,
    greatest(x2, n_x2) - least(x1, n_x1) AS cw, greatest(y2, n_y2) - least(y1, n_y1) AS ch,
    ((n_x1 + n_x2 - x1 - x2) ** 2 + (n_y1 + n_y2 - y1 - y2) ** 2) / 4 AS rho FROM {NEIGHBOURS})))"""
NMS = f"""(WITH RECURSIVE g AS (
    SELECT frame_id, cls, list({{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'obj_conf': obj_conf, 'cls_conf': cls_conf}}
      ORDER BY obj_conf * cls_conf DESC, det_id) AS rest FROM {BOXES} WHERE obj_conf >= 0.1 GROUP BY frame_id, cls),
  r AS (SELECT frame_id, cls, rest FROM g UNION ALL
    SELECT frame_id, cls, list_filter(rest[2:], lambda b: {box_iou([f'rest[1].{c}' for c in CORNERS], [f'b.{c}' for c in CORNERS])} <= 0.45) FROM r WHERE len(rest) > 1),
  h AS (SELECT frame_id, cls, rest[1] AS first,
    [rest[1]] || list_filter(rest[2:], lambda b: {box_iou([f'rest[1].{c}' for c in CORNERS], [f'b.{c}' for c in CORNERS])} > 0.45) AS hits FROM r WHERE len(rest) > 0)
  SELECT frame_id, first.det_id AS det_id, cls, first.obj_conf AS obj_conf,
    {', '.join(f'list_sum(list_transform(hits, lambda b: b.{c} * b.obj_conf)) / list_sum(list_transform(hits, lambda b: b.obj_conf)) AS {c}' for c in CORNERS)} FROM h)"""


def matched(pred: str) -> str:
    """One-to-one matches of boxes (frame_id, det_id, cls, obj_conf, corners) with the truth, prediction by prediction."""
    over = box_iou([f"preds[i + 1].{c}" for c in CORNERS], [f"t.{c}" for c in CORNERS])
    return f"""(WITH RECURSIVE p AS (SELECT frame_id, list({{'det_id': det_id, 'cls': cls, 'conf': obj_conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY det_id) AS preds FROM {pred} GROUP BY frame_id),
      t AS (SELECT frame_id, list({{'cls': cls, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY cls, x1, y1, x2, y2) AS truth FROM {TRUTH} GROUP BY frame_id),
      s AS (SELECT frame_id, preds, coalesce(truth, []) AS truth, list_transform(coalesce(truth, []), lambda t: true) AS free, 0 AS i, 0 AS tp FROM p LEFT JOIN t USING (frame_id)
        UNION ALL SELECT frame_id, preds, truth, list_transform(free, lambda x, j: x AND NOT (hit AND j = best)), i + 1, CASE WHEN hit THEN 1 ELSE 0 END FROM (
          SELECT *, coalesce(free[best], false) AND ious[best] >= 0.5 AND list_contains(list_transform(truth, lambda t: t.cls), preds[i + 1].cls) AS hit FROM (
            SELECT *, coalesce(list_position(ious, list_max(ious)), 0) AS best FROM (
              SELECT *, list_transform(truth, lambda t: {over}) AS ious FROM s WHERE i < len(preds)))))
      SELECT frame_id, preds[i].det_id AS det_id, preds[i].cls AS cls, preds[i].conf AS conf, tp FROM s WHERE i > 0)"""


def curve(matches: str) -> str:
    return f"""(SELECT *, tpc / t.n_truth AS recall, tpc / rank AS precision FROM (
      SELECT *, row_number() OVER w AS rank, sum(tp) OVER w AS tpc FROM {matches}
      WINDOW w AS (PARTITION BY cls ORDER BY -floor(conf * 1000), conf DESC, frame_id, det_id ROWS UNBOUNDED PRECEDING)) m
      JOIN (SELECT cls, count(*) AS n_truth FROM {TRUTH} GROUP BY cls) t USING (cls))"""


MATCHES = f"(SELECT frame_id, det_id, cls, obj_conf AS conf, CAST(flag = 'R' AS INT) AS tp FROM {BOXES})"
CURVE = curve(MATCHES)


def average_precision(of: str) -> str:
    return f"""SELECT t.cls, {', '.join(f'round(coalesce({c}, 0), 6) + 0.0 AS {c}' for c in ('ap', 'precision', 'recall'))},
        round(coalesce(2 * precision * recall / (precision + recall + 1e-16), 0), 6) + 0.0 AS f1 FROM (SELECT DISTINCT cls FROM {TRUTH}) t
        LEFT JOIN (SELECT cls, sum((recall - prev) * env) AS ap FROM (
          SELECT cls, recall, coalesce(lag(recall) OVER (PARTITION BY cls ORDER BY rank), 0) AS prev, max(precision) OVER (PARTITION BY cls ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env
          FROM {of}) GROUP BY cls) a ON a.cls = t.cls
        LEFT JOIN (SELECT cls, arg_max(precision, rank) AS precision, arg_max(recall, rank) AS recall FROM {of} GROUP BY cls) l ON l.cls = t.cls"""


def opened(lam: int) -> str:
    return f"(SELECT frame_id, log_cdf, log_pdf FROM {logs('wide')} WHERE log_cdf[{lam + 1}] < 0)"


def expected(lam: int, mu: int) -> str:
    """Frames with expected and bound, from the log sums over the open frames."""
    sums = ", ".join(
        f"coalesce(sum(log_cdf[{s + 1}]) FILTER (log_cdf[{s + 1}] <> {INF}), 0.0) AS f{s}, count(*) FILTER (log_cdf[{s + 1}] = {INF}) AS i{s}" for s in range(lam, mu + 1)
    )
    total = lambda s: f"CASE WHEN i{s} > 0 THEN {INF} ELSE f{s} END"
    is_inf = lambda s: f"(log_cdf[{s + 1}] = {INF})"
    without = lambda s: f"CASE WHEN i{s} - {is_inf(s)}::INT > 0 THEN {INF} ELSE f{s} - CASE WHEN {is_inf(s)} THEN 0.0 ELSE log_cdf[{s + 1}] END END"
    above = lambda s: ln(f"(1.0 - exp(log_cdf[{s + 1}]))")
    terms = [total(lam), *(f"({without(s)}) + log_pdf[{s + 1}]" for s in range(lam + 1, mu + 1)), f"({without(mu)}) + ({above(mu)})"]
    lse = lambda v: f"CASE WHEN list_max({v}) = {INF} THEN {INF} ELSE list_max({v}) + ln(list_sum(list_transform({v}, lambda x: exp(x - list_max({v}))))) END"
    return f"""(SELECT *, {lse('e')} AS expected, {lse('b')} AS bound FROM (
      SELECT frame_id, [{', '.join(terms)}] AS e, [{total(lam)}, ({above(lam)}) + ({without(mu)})] AS b
      FROM {opened(lam)}, (SELECT {sums} FROM {opened(lam)})))"""


def _r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


APPROX = topk(FRAMES, K, "k < 80")
EXACT = topk(FRAMES)
PRECISION = f"(SELECT count(*) / {K}.0::DOUBLE AS precision FROM (SELECT score FROM {APPROX} INTERSECT ALL SELECT score FROM {EXACT}))"
RANKS = f"""(SELECT avg(abs(above - given))::DOUBLE AS rank_distance FROM (
  SELECT rank() OVER (ORDER BY score DESC) - 1 AS given, (SELECT count(*) FROM {FRAMES} f WHERE f.score > a.score) AS above FROM {APPROX} a))"""
ERROR = f"(SELECT avg(abs(a.score - b.score))::DOUBLE AS score_error FROM {by_rank(APPROX)} a JOIN {by_rank(EXACT)} b USING (r))"

ORACLES: dict[str, str] = {
    "read_frames": f"SELECT frame_id - 100 AS frame_id, score, k FROM {FRAMES} WHERE frame_id >= 100 AND frame_id < 5100",
    "read_oracle": f"SELECT video_id, frame_id - 250 AS frame_id, score FROM {FRAMES} WHERE frame_id >= 250",
    "video_prefix": r"SELECT page_id, regexp_replace(string_split(url, '/')[-1], '^(\.*[^.].*)\.[^.]*$', '\1') AS prefix FROM pages",
    "split_frames": f"SELECT * FROM {SPLIT}",
    "sample_per_window": f"SELECT video_id, window_id, frame_id, score FROM {sampled(VIDEOS, 64, 6)}",
    "complement": f"SELECT video_id, frame_id FROM {SPLIT} WHERE split = 'test'",
    "union_certain": f"SELECT video_id, frame_id, score, CASE WHEN k < 50 THEN 'label' WHEN k < 80 THEN 'cleaned' ELSE 'mirror' END AS source FROM {FRAMES}",
    "multiset_overlap": f"SELECT count(*) AS overlap FROM (SELECT score FROM {FRAMES} WHERE k < 50 INTERSECT ALL SELECT score FROM {FRAMES} WHERE k >= 50)",
    "segment": f"SELECT video_id, frame_id, score, pos, seg, pos_in_seg, seg_len FROM {SEGMENTS}",
    "pick_reference": f"SELECT video_id, seg, ref_id, len(ref_features)::INT AS n_features FROM {REFS}",
    "mse_diff": f"SELECT a.frame_id, round({mse('a.features', 'b.features')}, 6) AS diff FROM {EMBEDDED} a JOIN {EMBEDDED} b ON b.frame_id = a.frame_id + 1",
    "difference_detect": f"SELECT video_id, frame_id, ref_id, round(diff, 6) + 0.0 AS diff, discarded FROM {DETECTED}",
    "difference_detect_stored": f"SELECT video_id, frame_id, ref_id, round(diff, 6) + 0.0 AS diff, discarded FROM {DETECTED}",
    "mirror_lists": f"""SELECT k.video_id, k.frame_id, coalesce(string_agg(g.frame_id::VARCHAR, ',' ORDER BY g.frame_id), '') AS mirrors
        FROM {DETECTED} k LEFT JOIN {DETECTED} g ON g.discarded AND g.ref_id = k.frame_id WHERE NOT k.discarded GROUP BY ALL""",
    "apply_oracle": "SELECT doc_id, least(len(regexp_extract_all(coalesce(text, ''), '[Tt]he')), 49)::INT AS score FROM documents",
    "lookup_scores": f"SELECT f.video_id, f.frame_id, f.score FROM {FRAMES} f JOIN {SPLIT} s USING (frame_id) WHERE s.split = 'valid'",
    "object_count": f"""SELECT o_orderkey AS frame_id, coalesce(n, 0)::INT AS score FROM orders LEFT JOIN (
        SELECT frame_id, count(*) AS n FROM {BOXES} WHERE cls = 2 AND obj_conf >= 0.3 AND cls_conf >= 0.92 GROUP BY frame_id) ON frame_id = o_orderkey""",
    "smooth_labels": f"SELECT video_id, frame_id, score, round(avg(score) OVER (PARTITION BY video_id ORDER BY frame_id RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM {VIDEOS}",
    "smooth_labels_filters": f"""SELECT video_id, frame_id, median(score) OVER w AS median, max(score) OVER w AS greatest FROM {VIDEOS}
        WINDOW w AS (PARTITION BY video_id ORDER BY frame_id RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "fit_binned_proxy": f"""SELECT bin, score, round(n / sum(n) OVER (PARTITION BY bin), 6) AS pi FROM (
        SELECT b.i::INT AS bin, s.i::INT AS score, coalesce(n, 0) + 0.1::DOUBLE AS n FROM range(40) b(i) CROSS JOIN range({MAX}) s(i) LEFT JOIN (
          SELECT least(greatest(floor((value + k / 10.0) / (500.0 / 40)), 0), 39)::INT AS bin, score, count(*) AS n FROM {FRAMES} GROUP BY ALL) c
        ON c.bin = b.i AND c.score = s.i)""",
    "model_grid": f"""SELECT (a.i * 3 + b.i)::INT AS model_id, [5, 8, 10, 15][a.i + 1]::BIGINT AS m, [20, 30, 40][b.i + 1]::BIGINT AS h, (SELECT max(score) + 1 FROM {FRAMES}) AS n FROM range(4) a(i), range(3) b(i)""",
    "select_model": f"""SELECT model_id, round(nll, 6) AS nll FROM (SELECT model_id, avg((((score - mu[1]) / w) ** 2) * 0.5 + ln(w) + {LOG_SQRT_2PI}) AS nll
        FROM {mixtures_sql('noisy')}, (VALUES (0, 0.3::DOUBLE), (1, 0.6::DOUBLE), (2, 1.2::DOUBLE)) g(model_id, w) GROUP BY model_id) ORDER BY nll, model_id LIMIT 1""",
    "normal_cdf": f"SELECT frame_id, round({phi('20.5::DOUBLE', 'score + (k - 49.5::DOUBLE) / 50.0::DOUBLE', '2.0::DOUBLE')}, 6) + 0.0 AS p FROM {FRAMES}",
    "mixture_cdf": f"SELECT frame_id, i::INT AS s, round(cdf[i + 1], 6) AS cdf FROM {cdfs('two')}, range({MAX}) r(i)",
    "log_tables": f"""SELECT frame_id, i::INT AS s, round(exp(log_cdf[i + 1]), 6) AS cdf, round(exp(log_pdf[i + 1]), 6) AS pdf, log_pdf[i + 1] = {INF} AS never
        FROM {logs('two')}, range({MAX}) r(i)""",
    "mixture_moments": f"SELECT frame_id, {_r6('mean', 'var')} FROM {moments('two')}",
    "mixture_nll": f"""SELECT frame_id, round(-(list_max(t) + ln(list_sum(list_transform(t, lambda x: exp(x - list_max(t)))))), 6) + 0.0 AS nll FROM (
        SELECT frame_id, list_transform(range(1, 3), lambda m: ln(pi[m]) - 0.5 * ((score - mu[m]) / sigma[m]) ** 2 - ln(sigma[m]) - {LOG_SQRT_2PI}) AS t FROM {mixtures_sql('two')})""",
    "logsumexp": f"SELECT frame_id, round(list_max(t) + ln(list_sum(list_transform(t, lambda x: exp(x - list_max(t))))), 6) + 0.0 AS v FROM (SELECT frame_id, list_concat(mu, pi) AS t FROM {mixtures_sql('two')})",
    "round_half_even": f"SELECT frame_id, round_even(k / 2.0::DOUBLE, 0)::INT AS v FROM {FRAMES}",
    "score_weights": f"""SELECT score, n, round(max(n) OVER () / n, 6) AS weight FROM (
        SELECT r.i::INT AS score, coalesce(c.n, 0) + 10 AS n FROM range({MAX}) r(i) LEFT JOIN (SELECT score, count(*) AS n FROM {FRAMES} GROUP BY score) c ON c.score = r.i)""",
    "column_log_sums": f"""SELECT i::INT AS s, round(coalesce(sum(log_cdf[i + 1]) FILTER (log_cdf[i + 1] <> {INF}), 0.0), 3) AS finite, count(*) FILTER (log_cdf[i + 1] = {INF}) AS n_inf
        FROM {logs('two')}, range({MAX}) r(i) GROUP BY i""",
    "calibration_profile": f"""SELECT coalesce(score, -1) AS score, count(*) AS n, round(avg(mean), 6) AS mean, round(avg(var), 6) AS var, round(avg((mean - score) ** 2), 6) AS mse
        FROM {moments('noisy')} GROUP BY ROLLUP (score)""",
    "window_distribution": f"SELECT video_id, frame_id // 64 AS window_id, round(avg(mean), 11) AS mu, round(sqrt(avg(var)), 6) AS sigma FROM {moments('two')} GROUP BY ALL",
    "window_truth": f"SELECT * FROM {clips(VIDEOS, 30)}",
    "sampled_window_scores": f"SELECT * FROM {clips(sampled(VIDEOS, 64, 6), 64)}",
    "result_summary": f"SELECT min(score) AS low, max(score) AS high, avg(score) AS mean FROM {topk(FRAMES)}",
    "complete_mixtures": f"""SELECT m.video_id, m.frame_id, round(CASE WHEN r.k < 5 THEN r.score ELSE r.mu[1] END, 6) + 0.0 AS mu, CASE WHEN r.k < 5 THEN 0.1 ELSE r.sigma[1] END::DOUBLE AS sigma
        FROM {mixtures_sql('noisy')} m JOIN {mixtures_sql('noisy')} r ON r.frame_id = CASE WHEN m.k < 5 THEN m.frame_id ELSE m.frame_id // 10 * 10 END""",
    "propagate_mirrors": f"SELECT m.video_id, m.frame_id, r.score FROM {FRAMES} m JOIN {FRAMES} r ON r.frame_id = m.frame_id // 10 * 10 WHERE m.frame_id % 10 <> 0 AND r.score > 5",
    "box_iou_join": f"""SELECT * REPLACE (round(iou, 6) AS iou) FROM (SELECT p.frame_id, p.det_id, p.cls, t.cls AS t_cls, t.x1 AS t_x1, t.y1 AS t_y1,
        {box_iou([f'p.{c}' for c in CORNERS], [f't.{c}' for c in CORNERS])} AS iou FROM {BOXES} p JOIN {TRUTH} t USING (frame_id)) WHERE iou >= 0.3""",
    "exact_topk": f"SELECT * FROM {topk(FRAMES)}",
    "merge_topk": f"SELECT * FROM {topk(FRAMES)}",
    "thresholds": f"SELECT max(score) FILTER (r = {K}) AS lam, max(score) FILTER (r = {K - 1}) AS mu FROM {by_rank(topk(FRAMES))}",
    "topk_confidence": f"SELECT round(CASE WHEN count(*) FILTER (log_cdf[49] = {INF}) > 0 THEN {INF} ELSE sum(log_cdf[49]) END, 4) AS log_confidence FROM {logs('two')}",
    "bootstrap_candidates": f"SELECT video_id, frame_id FROM {logs('two')} ORDER BY log_cdf[1], frame_id LIMIT {K}",
    "expected_confidence": f"SELECT frame_id, round(expected, 4) AS expected FROM {expected(LAM, MU)}",
    "upper_bound": f"SELECT frame_id, round(bound, 4) AS bound, bound >= expected - 1e-9 AS holds FROM {expected(LAM, MU)}",
    "select_candidates": f"SELECT round(expected, 4) AS expected FROM {expected(LAM, MU)} ORDER BY expected DESC, frame_id LIMIT 20",
    "cutoff_candidates": f"""SELECT frame_id, round(f, 6) + 0.0 AS f FROM (
        SELECT *, sum(CASE WHEN f > 0 THEN ln(f) ELSE -1e9 END) OVER (ORDER BY f DESC, frame_id DESC ROWS UNBOUNDED PRECEDING) AS tail
        FROM (SELECT *, {cdf_at(f'{LAM + 0.5}::DOUBLE')} AS f FROM {mixtures_sql('noisy')}) WHERE f < 1.0) WHERE tail < ln(0.9::DOUBLE)""",
    "topk_frames": f"SELECT * FROM {by_rank(topk(FRAMES))}",
    "topk_frames_exact_proxy": f"SELECT * FROM {by_rank(topk(FRAMES))}",
    "topk_frames_deduplicated": f"""SELECT * FROM {by_rank(f'''(SELECT frame_id, score FROM (
        SELECT d.frame_id, CASE WHEN d.discarded THEN r.score ELSE e.score END AS score FROM {DETECTED} d
        JOIN {EMBEDDED} e ON e.frame_id = d.frame_id JOIN {EMBEDDED} r ON r.frame_id = d.ref_id) ORDER BY score DESC, frame_id DESC LIMIT 20)''')}""",
    "topk_windows": f"SELECT * FROM {by_rank(f'(SELECT window_id AS frame_id, score FROM {clips(FRAMES, 30)} ORDER BY score DESC, window_id DESC LIMIT 50)')}",
    "precision_at_k": f"SELECT * FROM {PRECISION}",
    "rank_distance": f"SELECT round(rank_distance, 6) + 0.0 AS rank_distance FROM {RANKS}",
    "score_error": f"SELECT round(score_error, 6) + 0.0 AS score_error FROM {ERROR}",
    "evaluate_topk": f"SELECT {_r6('precision', 'rank_distance', 'score_error')} FROM {PRECISION}, {RANKS}, {ERROR}",
    "pr_curve": f"SELECT frame_id, det_id, cls, rank, tpc::BIGINT AS tpc, (rank - tpc)::BIGINT AS fpc, {_r6('recall', 'precision')} FROM {CURVE}",
    "average_precision": average_precision(CURVE),
    "detector_quality": average_precision(curve(matched(NMS))),
    "xywh_to_xyxy": f"SELECT frame_id, det_id, x1, y1, x2, y2 FROM {BOXES}",
    "iou": f"SELECT frame_id, det_id, round(v, 6) + 0.0 AS iou, round(v, 6) + 0.0 AS iou_xywh FROM (SELECT *, {box_iou(CORNERS, OTHERS)} AS v FROM {NEIGHBOURS})",
    "iou_variant": f"""SELECT frame_id, det_id, {_r6('iou', 'giou', 'diou', 'ciou')} FROM (
        SELECT *, iou - (cw * ch + {EPS} - uni) / (cw * ch + {EPS}) AS giou, iou - rho / (cw ** 2 + ch ** 2 + {EPS}) AS diou,
          iou - (rho / (cw ** 2 + ch ** 2 + {EPS}) + v * v / (1.0 + {EPS} - iou + v)) AS ciou FROM (
          SELECT *, 4 / pi() ** 2 * (atan(wb / hb) - atan(wa / ha)) ** 2 AS v FROM {VARIANTS}))""",
    "wh_iou": f"SELECT frame_id, det_id, round(least(w, n_w) * least(h, n_h) / (w * h + {TINY}::DOUBLE + n_w * n_h - least(w, n_w) * least(h, n_h)), 6) AS v FROM {NEIGHBOURS}",
    "rescale_boxes": f"""SELECT frame_id, det_id, round((x1 - floor(px / 2)) / (416.0 - px) * 640, 6) + 0.0 AS x1, round((y1 - floor(py / 2)) / (416.0 - py) * hh, 6) + 0.0 AS y1,
        round((x2 - floor(px / 2)) / (416.0 - px) * 640, 6) + 0.0 AS x2, round((y2 - floor(py / 2)) / (416.0 - py) * hh, 6) + 0.0 AS y2 FROM (
        SELECT *, greatest(hh - 640, 0) * (416.0::DOUBLE / greatest(hh, 640)) AS px, greatest(640 - hh, 0) * (416.0::DOUBLE / greatest(hh, 640)) AS py
        FROM (SELECT *, 480 + cls * 60 AS hh FROM {BOXES}))""",
    "relative_boxes": f"""SELECT frame_id, det_id, round(cx / 640.0::DOUBLE, 10) AS cx, round(cy / 480.0::DOUBLE, 10) AS cy, round(w / 640.0::DOUBLE, 10) AS w, round(h / 480.0::DOUBLE, 10) AS h,
        round(1.0::DOUBLE - cx / 640.0::DOUBLE, 10) + 0.0 AS flipped, round(h, 10) AS h_back FROM {BOXES}""",
    "detection_scores": f"SELECT frame_id, det_id, cls, round(cls_conf, 6) AS cls_conf, round(obj_conf * cls_conf, 11) AS rank_score FROM {BOXES} WHERE obj_conf >= 0.3",
    "non_max_suppression": f"SELECT frame_id, det_id, cls, {_r6(*CORNERS)} FROM {NMS}",
    "match_detections": f"SELECT * FROM {matched(BOXES)}",
    "read_frame_dir": "SELECT name, row_number() OVER (ORDER BY length(name), name) - 1 AS frame_id FROM (SELECT 'f' || (event_id * 7) || '.jpg' AS name FROM events)",
    "decode_box_blobs": f"""SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY det_id) - 1 AS det_id, cls,
        {', '.join(f'CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}' for c in (*CORNERS, 'obj_conf', 'cls_conf'))} FROM {BOXES}""",
    "saved_stage": f"SELECT frame_id, score, k FROM {FRAMES}",
    "split_sizes": """SELECT a AS num_train, b AS num_valid, CASE WHEN a <= 1 THEN trunc(n * a) ELSE trunc(a) END::BIGINT AS n_train, CASE WHEN b <= 1 THEN trunc(n * b) ELSE trunc(b) END::BIGINT AS n_valid
        FROM (VALUES (0.005::DOUBLE, 3000.0::DOUBLE), (0.0333, 0.25), (1.0, 0.0), (250.0, 1.0)) g(a, b), (SELECT count(*) AS n FROM events)""",
    "apply_proxy": f"""SELECT frame_id, 0.75::DOUBLE AS pi_0, 0.25::DOUBLE AS pi_1, round(value / 10, 6) + 0.0 AS mu_0, round(value / 10 + 1.0, 6) + 0.0 AS mu_1, 0.5::DOUBLE AS sigma_0, 1.0::DOUBLE AS sigma_1 FROM {FRAMES}""",
    "hypotheses_to_mixture": f"""SELECT frame_id, {_r6('pi_0', 'pi_1', 'mu_0', 'mu_1', 'sigma_0', 'sigma_1')} FROM (SELECT frame_id, {', '.join(
        f"list_avg(g{m}) AS pi_{m}, mu{m} AS mu_{m}, sqrt(list_sum(list_transform([1, 2, 3], lambda i: g{m}[i] * (h[i] - mu{m}) * (h[i] - mu{m}))) / (list_sum(g{m}) + 0.0001) + 0.0001) AS sigma_{m}" for m in (0, 1))}
        FROM (SELECT *, {', '.join(f'list_sum(list_transform([1, 2, 3], lambda i: g{m}[i] * h[i])) / (list_sum(g{m}) + 0.0001) AS mu{m}' for m in (0, 1))}
        FROM (SELECT *, {', '.join(f'list_transform([1, 2, 3], lambda i: exp(z{m}[i]) / (exp(z0[i]) + exp(z1[i]))) AS g{m}' for m in (0, 1))}
        FROM (SELECT frame_id, [score::DOUBLE, score + 1.0::DOUBLE, score - k / 50.0::DOUBLE] AS h, [k / 100.0::DOUBLE, 0.5::DOUBLE, -1.0::DOUBLE] AS z0, [0.25::DOUBLE, score / 10.0::DOUBLE, k / 40.0::DOUBLE] AS z1 FROM {FRAMES}))))""",
    "query_frames": f"SELECT * FROM {by_rank(topk(FRAMES))}",
    "query_frames_deduplicated": f"SELECT * FROM {by_rank(topk(DEDUPLICATED, 20))}",
    "query_frames_model": f"SELECT * FROM {by_rank(topk(FRAMES))}",
    "query_frames_expected": f"SELECT * FROM {by_rank(topk(FRAMES))}",
    "query_windows_whole": f"SELECT * FROM {by_rank(f'(SELECT window_id AS frame_id, score FROM {clips(FRAMES, 30)} ORDER BY score DESC, window_id DESC LIMIT 20)')}",
    "query_documents": f"SELECT row_number() OVER (ORDER BY score DESC, doc_id DESC)::INT AS r, score FROM (SELECT doc_id, least(len(regexp_extract_all(coalesce(text, ''), '[Tt]he')), 49)::INT AS score FROM documents) ORDER BY r LIMIT 20",
}
