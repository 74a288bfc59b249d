"""The frames that a search has not scored: which to score next, and the sums that say how sure the answer is.

Both kinds have video_id and frame_id. MixtureFrames have a mixture each; sums are kept up from round to round,
and what is asked of a frame are the ticks from lam to mu at most. BinnedFrames name a bin of a proxy: everything is computed once a
bin, frames are counted once, and a round takes whole bins and orders the frames of one bin only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distribution import NEG_INF, cdf_at, log_tables, mixture_cdf_columns, safe_ln
from ..operators import topk
from ..operators.ordinals import lowest

IDS = ["video_id", "frame_id"]


class Uncertain:
    """What both kinds share: the frames that are left."""

    def __init__(self, frames: DataFrame, max_score: int):
        self.frames, self.max_score, self.pruned = frames, max_score, None
        self.few: list[tuple[str, int]] = []
        self.many: list[DataFrame] = []

    def left(self) -> DataFrame:
        """Frames that were not scored: the few of the first rounds are sent out, tables of more are joined."""
        rows = self.frames
        if self.few:
            rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(self.few, "video_id string, frame_id long")), IDS, "left_anti")
        if self.many:
            rows = rows.join(reduce(DataFrame.unionByName, [t.select(*IDS) for t in self.many]), IDS, "left_anti")
        return rows

    def keep(self, open_: DataFrame) -> None:
        """lam never falls, so frames with F(lam) = 1 stay out, and few are left to keep."""
        self.frames = self.pruned = open_.persist()
        self.few, self.many = [], []

    def scored(self, chosen: DataFrame, ids: list[tuple] | None) -> None:
        """Frames that were chosen, as a list where they are few, are not uncertain any more."""
        if ids is None:
            self.many.append(chosen)
        else:
            self.few += ids

    def close(self) -> None:
        if self.pruned is not None:
            self.pruned.unpersist()


class MixtureFrames(Uncertain):
    """Frames with pi, mu, sigma."""

    columns = [*IDS, "pi", "mu", "sigma"]
    sums: topk.LogSums | None = None
    evaluated = 0

    def first_candidates(self, n: int) -> DataFrame:
        """The n frames least likely to score 0."""
        return lowest(self.left().withColumn("f", cdf_at(0)), F.floor(F.col("f") * topk.N_BINS), ["f", *IDS[::-1]], n)

    def at(self, lam: int, top: int, rule: str) -> tuple[float, int]:
        """The log confidence at lam and how many frames may still beat it; top is the best score known.

        The only pass over open frames is the first one, or one after lam or mu has left the ticks that are summed.
        """
        last = max(lam, top if rule == "cutoff" else max(top, self.max_score - 1))
        if self.pruned is None:
            self.keep(self.left().withColumn("f", cdf_at(lam)).where(F.col("f") < 1.0).drop("f"))
        if self.sums is None or max(lam, top if rule != "cutoff" else lam) > self.sums.last:
            self.sums = topk.LogSums.of(self.left(), lam, last)
        return self.sums.log_confidence(lam), self.sums.n_open[lam - self.sums.first]

    def cutoff(self, lam: int, conf: float, most: int) -> DataFrame:
        return topk.cutoff_candidates(self._open(lam), conf, most)

    def lowest_one(self, lam: int) -> DataFrame:
        return self._open(lam).orderBy("f", *IDS[::-1]).limit(1)

    def _open(self, lam: int) -> DataFrame:
        return self.left().withColumn("f", cdf_at(lam)).where(F.col("f") < 1.0)

    def expected(self, lam: int, mu: int, most: int) -> DataFrame:
        """The frames with the largest expected confidence: bounds from two ticks, the ticks from lam to mu only where a bound asks for them."""
        ends = F.array(*[safe_ln(cdf_at(s)) for s in (lam, mu)])
        two = topk.LogSums(0, *[[x[lam - self.sums.first], x[mu - self.sums.first]] for x in (self.sums.finite, self.sums.n_inf, self.sums.n_open)])
        bounded = topk.upper_bound(self._open(lam).withColumn("log_cdf", ends), two, 0, 1).drop("log_cdf")

        def evaluate(rows: DataFrame) -> DataFrame:
            tables = log_tables(rows.withColumn("cdf", mixture_cdf_columns(mu + 1, first=lam)))
            return topk.expected_confidence(tables, self.sums, lam, mu, first=lam).select(*bounded.columns, "expected")

        found, n = topk.best_by_bound(bounded, evaluate, most)
        self.evaluated += n
        return found

    def scored(self, chosen: DataFrame, ids: list[tuple] | None) -> None:
        super().scored(chosen, ids)
        if self.sums is not None:
            self.sums = self.sums.minus(chosen)


class BinnedFrames(Uncertain):
    """Frames with the bin of a proxy (bin, pi, mu, sigma), a table of at most a few hundred rows."""

    columns = [*IDS, "bin"]

    def __init__(self, frames: DataFrame, proxy: DataFrame, max_score: int):
        super().__init__(frames, max_score)
        self.proxy = proxy
        self.counts: dict[int, int] | None = None
        self.logs: dict[int, dict[int, float]] = {}

    def _log_f(self, s: int) -> dict[int, float]:
        """ln F(s) of every bin, computed once a tick."""
        if s not in self.logs:
            self.logs[s] = {r["bin"]: r["v"] for r in self.proxy.select("bin", safe_ln(cdf_at(s)).alias("v")).collect()}
        return self.logs[s]

    def _counts(self) -> dict[int, int]:
        """Open frames of every bin; counted once, then kept up."""
        if self.counts is None:
            self.counts = {r["bin"]: r["count"] for r in self.left().groupBy("bin").count().collect()}
        return self.counts

    def _groups(self, value: dict[int, float]) -> list[tuple[float, list[int], int]]:
        """(value, bins, frames) by rising value; bins of equal value are one group."""
        groups: dict[float, list[int]] = {}
        for at, n in self._counts().items():
            if n and at in value:
                groups.setdefault(value[at], []).append(at)
        return [(v, bins, sum(self._counts()[x] for x in bins)) for v, bins in sorted(groups.items())]

    def _take(self, groups: list[tuple[float, list[int], int]], n: int) -> DataFrame:
        """The first n frames by group, then frame id: whole groups, and the part of one that has to be ordered."""
        whole: list[int] = []
        for _, bins, count in groups:
            if count > n:
                part = lowest(self.left().where(F.col("bin").isin(bins)), F.floor(F.col("frame_id") / 65_536), IDS[::-1], n)
                return self.left().where(F.col("bin").isin(whole)).unionByName(part) if whole else part
            whole, n = whole + bins, n - count
        return self.left().where(F.col("bin").isin(whole))

    def first_candidates(self, n: int) -> DataFrame:
        return self._take(self._groups(self._log_f(0)), n)

    def _open_groups(self, lam: int) -> list[tuple[float, list[int], int]]:
        return [g for g in self._groups(self._log_f(lam)) if g[0] < 0]

    def at(self, lam: int, top: int, rule: str) -> tuple[float, int]:
        groups = self._open_groups(lam)
        if self.pruned is None:
            counts = self._counts()
            self.keep(self.left().where(F.col("bin").isin([b for g in groups for b in g[1]])))
            self.counts = {b: counts[b] for g in groups for b in g[1]}
        return math.fsum(v * n for v, _, n in groups), sum(n for *_, n in groups)

    def cutoff(self, lam: int, conf: float, most: int) -> DataFrame:
        """The smallest set by ascending F(lam): the highest frames stay as long as the sum of their logs is enough."""
        groups, allowed, stay = self._open_groups(lam), math.log(conf), 0
        for v, _, n in reversed(groups):
            fits = n if v * n >= allowed else 0 if v == NEG_INF else int(allowed / v)
            stay, allowed = stay + fits, allowed - (v * fits if fits else 0.0)
            if fits < n:
                break
        chosen = sum(n for *_, n in groups) - stay
        return self._take(groups, min(max(chosen, 1), most))

    def lowest_one(self, lam: int) -> DataFrame:
        return self._take(self._open_groups(lam), 1)

    def expected(self, lam: int, mu: int, most: int) -> DataFrame:
        """By the expected confidence of a frame of each bin; no frame is looked at but those that are taken."""
        rows = {s: self._groups(self._log_f(s)) for s in range(lam, mu + 1)}
        inf = {s: sum(n for v, _, n in g if v == NEG_INF) for s, g in rows.items()}
        finite = {s: math.fsum(v * n for v, _, n in g if v != NEG_INF) for s, g in rows.items()}
        sums = topk.LogSums(lam, [finite[s] for s in rows], [inf[s] for s in rows], [0] * len(rows))
        tables = log_tables(self.proxy.withColumn("cdf", mixture_cdf_columns(mu + 1, first=lam)))
        gain = {r["bin"]: -r["expected"] for r in topk.expected_confidence(tables, sums, lam, mu, first=lam).select("bin", "expected").collect()}
        open_ = {b for g in self._open_groups(lam) for b in g[1]}
        return self._take(self._groups({b: v for b, v in gain.items() if b in open_}), most)

    def scored(self, chosen: DataFrame, ids: list[tuple] | None) -> None:
        super().scored(chosen, ids)
        for r in chosen.groupBy("bin").count().collect():  # a row per bin
            self._counts()[r["bin"]] -= r["count"]
