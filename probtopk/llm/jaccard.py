"""Self-join of documents by the Jaccard similarity of their 5-word shingles.

Exact, in steps that skip work by what is known of related sets:

1. Texts with equal shingle sets are one node, however many copies there are.
2. A node's shingles are ordered, frequent ones last and the most frequent at the
   end (an estimate from a sample; any fixed order gives the same links). Two
   linked sets share a shingle in their prefixes, and at the first that they share each
   must have as many shingles left as the link needs. Prefix entries carry the
   position and the size of the set.
3. Entries of a shingle form its index list. Short lists are joined in place.
   Entries of long lists, and of frequent shingles, are kept apart.
4. On long lists, answers of one set come first. A round takes the leader of each
   list, the set in which the shingle comes earliest (the least changed of a group of
   copies), and measures it against the sets that it may link with: linear in
   the list. Sets that link with it have their component from it, so pairs
   among them are never looked at; a list with one component is done, the leader itself leaves its list.
   Every open list gets a first round; rounds go on while the open lists hold many pairs of different components.
5. The rest of the lists is cut into blocks by size, position and whether a set is in the list's main
   component. Blocks are paired first, by their ranges; only pairs of blocks that may link are opened.
   What two sets share with one leader bounds what they share with each
   other: at most min(o_x, o_y) + min(n_x - o_x, n_y - o_y). (At least
   o_x + o_y - n_L, but that reaches the threshold only where both link with the leader.)
6. Candidates of different components are verified: by their prefixes, whose common part and
   what is behind them bound the intersection, then with whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE = 5
#: The threshold as a percentage, 100 * intersection >= PERCENT * union.
PERCENT = 75
#: One row in SAMPLE_EVERY counts for the order; a shingle in SAMPLE_DF of these, at most MAX_FREQUENT shingles, is put last.
SAMPLE_EVERY, SAMPLE_DF, MAX_FREQUENT = 16, 3, 200_000
#: Lists of more entries are long.
LONG_LIST = 16
BUCKET_ENTRIES = 100_000
#: Entries of a block, and bands of a factor of 2 in size and of a whole set in position.
BLOCK, SIZE_BANDS, POSITION_BANDS = 64, 8, 32
#: After the first round, leaders are taken while the open pairs are more than OPEN_PAIRS a list entry and a round leaves at most SHRINK of them.
OPEN_PAIRS, SHRINK = 32, 0.75
#: Rows of an Arrow batch; rows carry the hashes of a text's words.
BATCH_ROWS = 1000

_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, from its word hashes."""
    w = np.asarray(words, np.int64).view(np.uint64)
    if not len(w):
        return w
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = mix(h * _P + w[i : len(w) - size + 1 + i])
    return np.unique(h)


def node_of(s: np.ndarray) -> int:
    """A 64-bit id of a set: equal sets have equal ids."""
    with np.errstate(over="ignore"):
        total = mix(s + _P).sum(dtype=np.uint64) + np.bitwise_xor.reduce(mix(s ^ _P)) * np.uint64(31) + np.uint64(len(s))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    hashed = F.transform(common.words(common.lower_ascii(common.text_or_empty(text_col))), lambda w: F.xxhash64(w))
    return docs.select(F.col(id_col).cast("long").alias("id"), hashed.alias("words"))


SET = "node long, set array<long>"


def ordered(s: np.ndarray, often: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the order of prefixes, and how many of its shingles are not frequent."""
    at = _at(s, often)
    behind = at[at >= 0]
    return np.concatenate([s[at < 0], often[behind[np.argsort(places[behind])]]]), len(s) - len(behind)


def _sets(held):
    """Nodes and their sets, in the order of prefixes if that is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [s for s in map(shingle_set, pdf["words"]) if len(s)]
            nodes = pd.Series([node_of(s) for s in sets], dtype="int64")
            yield pd.DataFrame({"node": nodes, "set": pd.Series([(s if held is None else ordered(s, *held.value)[0]).view(np.int64) for s in sets], dtype="object")})

    return run


def sample_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, set) of the distinct nodes of one row in SAMPLE_EVERY."""
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(SAMPLE_EVERY)) == 0)
    return word_hashes(drawn, id_col, text_col).mapInPandas(_sets(None), SET).dropDuplicates(["node"])


def frequent(sampled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most MAX_FREQUENT shingles that several sampled nodes hold, and the place of each by rising count."""
    counted = sampled.select(F.explode("set").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLE_DF)
    top = counted.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(top)
    return top[by_hash], len(top) - by_hash


def prefix_length(n):
    """Entries of a set of n shingles of which two linked sets share at least one."""
    return n - (PERCENT * n + 99) // 100 + 1


def needed(a, b):
    """The least intersection of sets of a and b shingles that link."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def _at(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each of h is in the sorted array known, or -1."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


ENTRY = "bucket long, h long, node long, n long, pos long"


def _entries(held, n_buckets: int):
    """Buckets below n_buckets hold prefix entries by shingle; the next n_buckets those of
    frequent shingles by node, as their lists may be very long; the last n_buckets a row per document, in turn: its id in h, or 1 in pos if it has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (often, places), seen, turn = held.value, set(), TaskContext.get().partitionId()
        for pdf in batches:
            hs, late, meta, rows = [], [], [], []
            for i, words in zip(pdf["id"], pdf["words"], strict=True):
                s = shingle_set(words)
                node = node_of(s) if len(s) else 0
                known = not pd.isna(i)
                turn += 1
                rows.append((2 * n_buckets + turn % n_buckets, int(i) if known else 0, node, len(s), int(not known)))
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                k = prefix_length(len(s))
                s, n_early = ordered(s, often, places)
                hs.append(s[:k])
                late.append(np.arange(k) >= n_early)
                meta.append((node, len(s), k))
            yield pd.DataFrame(rows, columns=["bucket", "h", "node", "n", "pos"], dtype="int64")
            if not hs:
                continue
            h = np.concatenate(hs)
            lengths = [m[2] for m in meta]
            node = np.repeat(np.array([m[0] for m in meta], np.int64), lengths)
            by = np.where(np.concatenate(late), node.view(np.uint64) % np.uint64(n_buckets) + np.uint64(n_buckets), h % np.uint64(n_buckets))
            yield pd.DataFrame(
                {"bucket": by.astype(np.int64), "h": h.view(np.int64), "node": node, "n": np.repeat([m[1] for m in meta], lengths), "pos": np.concatenate([np.arange(k) for k in lengths])}
            )

    return run


LISTED = "kind int, h long, a long, b long, n_a long, n_b long, pos long"


def _empty() -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in LISTED.split(", ")})


def possible(n_a, pos_a, n_b, pos_b):
    """Whether sets that share a shingle at these positions may link: by size, and by what is before and after."""
    fits = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    return fits & (np.minimum(pos_a, pos_b) + np.minimum(n_a - pos_a, n_b - pos_b) >= needed(n_a, n_b))


def first_possible(n_a, pos_a, n_b, pos_b):
    """Whether sets may link of which the first shared shingle is at these positions: it and what is after must do."""
    fits = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    return fits & (np.minimum(n_a - pos_a, n_b - pos_b) >= needed(n_a, n_b))


def _lists(n_buckets: int):
    """Rows of kind 0: a pair of a short list, in pos the number of shared shingles, in h whether one of them may be
    the first; kind 1: an entry of a long list; kind 2: a document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] >= 2 * n_buckets:
            return pd.DataFrame({"kind": 2, "h": pdf["h"], "a": pdf["node"], "b": 0, "n_a": pdf["n"], "n_b": 0, "pos": pdf["pos"]})
        if pdf["bucket"].iloc[0] >= n_buckets:
            e = pdf.drop_duplicates(["h", "node"])
            return pd.DataFrame({"kind": 1, "h": e["h"], "a": e["node"], "b": 0, "n_a": e["n"], "n_b": 0, "pos": e["pos"]})
        h, node, n, pos = (pdf[c].to_numpy(np.int64) for c in ("h", "node", "n", "pos"))
        order = np.lexsort((node, n, h))
        h, node, n, pos = h[order], node[order], n[order], pos[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])  # copies of a set come from several tasks
        h, node, n, pos = h[fresh], node[fresh], n[fresh], pos[fresh]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        out = []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= LONG_LIST)]):
            at = starts[sizes == size][:, None] + np.arange(size)
            i, j = np.triu_indices(size, 1)
            a, b = at[:, i].ravel(), at[:, j].ravel()
            ok = possible(n[a], pos[a], n[b], pos[b])
            out.append(np.stack([a[ok], b[ok]]))
        parts = []
        if out:
            a, b = np.concatenate(out, 1)
            first = first_possible(n[a], pos[a], n[b], pos[b]).astype(np.int64)
            swap = node[a] > node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            pairs = pd.DataFrame({"a": node[a], "b": node[b], "n_a": n[a], "n_b": n[b], "h": first}).groupby(["a", "b", "n_a", "n_b"], sort=False)["h"].agg(["size", "max"])
            parts.append(pairs.reset_index().rename(columns={"size": "pos", "max": "h"}).assign(kind=0))
        long = np.repeat(sizes > LONG_LIST, sizes)
        if long.any():
            parts.append(pd.DataFrame({"kind": 1, "h": h[long], "a": node[long], "b": 0, "n_a": n[long], "n_b": 0, "pos": pos[long]}))
        return pd.concat(parts)[[c.split()[0] for c in LISTED.split(", ")]] if parts else _empty()

    return run


class _Corpus:
    """The texts, the nodes with the least id of each, and what orders their sets."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, held):
        self.docs, self.id_col, self.text_col, self.nodes, self.held = docs, id_col, text_col, nodes, held

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(node, set) of the nodes in pairs; only texts of these nodes are read into sets."""
        wanted = common.materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
        ids = common.lookup(self.nodes.where("id IS NOT NULL"), wanted, "node", "left_semi").select(F.col("id").alias(self.id_col)).distinct()
        named = common.lookup(self.docs, common.materialize(ids, "wanted-ids"), self.id_col, "left_semi")
        read = word_hashes(named.unionByName(self.docs.where(F.col(self.id_col).isNull())), self.id_col, self.text_col)
        # An id may stand at several texts: only the wanted nodes stay.
        sets = common.lookup(read.mapInPandas(_sets(self.held), SET), wanted, "node", "left_semi").dropDuplicates(["node"])
        return common.materialize(sets, "sets")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, n_a, n_b) of nodes that may link with o, the size of their intersection.

        Prefixes are compared first, as they are short: what is shared beyond them is bounded by what is behind them.
        """
        pairs = common.materialize(pairs, "pairs")
        if pairs.isEmpty():
            return pairs.withColumn("o", F.lit(0))
        sets = self.sets(pairs)
        head = sets.select("node", F.slice("set", F.lit(1), (F.size("set") - F.ceil(F.size("set") * PERCENT / 100) + 1).cast("int")).alias("set"))
        most = F.col("o") + F.greatest(*[F.ceil(F.col(n) * PERCENT / 100) - 1 for n in ("n_a", "n_b")])
        may = common.materialize(_overlaps(pairs, head).where(_reaches(most, "n_a", "n_b")).drop("o"), "may-link")
        return common.materialize(_overlaps(may, sets), "overlaps")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = (sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")) for side in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).alias("o"))


def links(overlaps: DataFrame) -> DataFrame:
    return overlaps.where(100 * F.col("o") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b")


def _reaches(overlap: Column, n_a: str, n_b: str) -> Column:
    """Whether an intersection of so many links sets of these sizes."""
    return overlap * (100 + PERCENT) >= PERCENT * (F.col(n_a) + F.col(n_b))


def _fits(n_a: str, n_b: str) -> Column:
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def _placed(long: DataFrame, known: DataFrame | None) -> DataFrame:
    """Entries of long lists with the component of their node, itself where none is known."""
    if known is None:
        return long.withColumn("component", F.col("node"))
    return common.lookup(long, known, "node", "left").select(*long.columns, F.coalesce("component", "node").alias("component"))


def _open_pairs(placed: DataFrame) -> tuple[int, int]:
    """Entries of lists with several components, and how many pairs have a set outside the list's main component."""
    parts = placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.sum("n").alias("m"), F.max("n").alias("main"))
    row = parts.where("main < m").agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.expr("(m - main) * double(m)")), F.lit(0.0))).first()
    return int(row[0]), int(row[1])


def _lead(long: DataFrame, known: DataFrame | None, corpus: _Corpus) -> tuple[DataFrame, DataFrame]:
    """One round: what is left of the lists with several components, without their leaders; and the leaders' answers."""
    placed = common.materialize(_placed(long, known), "placed")
    first = F.min(F.struct("pos", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("of_b"))).alias("lead")
    lists = placed.groupBy("h").agg(first, F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    leaders = common.materialize(lists.select("h", F.col("lead.pos").alias("pos_b"), "lead.b", "lead.n_b", "lead.of_b"), "leaders")
    led = common.materialize(common.lookup(placed, leaders, "h").where("node != b"), "led")
    may = _fits("n", "n_b") & _reaches(F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")), "n", "n_b")
    pairs = led.where(may & (F.col("component") != F.col("of_b"))).select(F.col("node").alias("a"), "b", F.col("n").alias("n_a"), "n_b").distinct()
    return led.select("h", "node", "n", "pos"), corpus.measured(pairs)


BLOCKED = "a long, b long, n_a long, n_b long"


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of nodes that may link of each pair of blocks."""
    for pdf in batches:
        parts = []
        for same, *cols in zip(pdf["same"], *[pdf[f"{s}_{c}"] for s in "xy" for c in ("node", "n", "pos", "component", "lead", "o")], strict=True):
            x, y = ([np.asarray(c, np.int64) for c in half] for half in (cols[:6], cols[6:]))
            (node, n, pos, comp, lead, o), (node_y, n_y, pos_y, comp_y, lead_y, o_y) = [c[:, None] for c in x], y
            ok = first_possible(n, pos, n_y, pos_y) & (comp != comp_y)
            most = np.minimum(o, o_y) + np.minimum(n - o, n_y - o_y)
            ok &= (lead != lead_y) | (most >= needed(n, n_y))
            if same:
                ok &= node < node_y
            i, j = np.nonzero(ok)
            a, b, n_a, n_b = x[0][i], node_y[j], x[1][i], n_y[j]
            swap = a > b
            parts.append(np.stack([np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n_b, n_a), np.where(swap, n_a, n_b)], 1))
        found = np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, 4), np.int64)
        yield pd.DataFrame(found, columns=["a", "b", "n_a", "n_b"])


def _rest(long: DataFrame, known: DataFrame | None, answers: DataFrame | None) -> DataFrame:
    """(a, b, n_a, n_b): the pairs of different components in what is left of the lists, by blocks."""
    placed = _placed(long, known)
    if answers is None:
        placed = placed.withColumns({"lead": F.col("node"), "o": F.col("n")})
    else:
        best = common.materialize(answers.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("o", "b")).alias("best")).select("node", F.col("best.b").alias("lead"), F.col("best.o").cast("long").alias("best")), "led-by")
        placed = common.lookup(placed, best, "node", "left").withColumns({"lead": F.coalesce("lead", "node"), "o": F.coalesce("best", "n")})
    placed = common.materialize(placed.select("h", "node", "n", "pos", "component", "lead", "o"), "open-entries")
    sizes = placed.groupBy("h", "component").agg(F.count(F.lit(1)).alias("m"))
    mains = sizes.groupBy("h").agg(F.max(F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mains = common.materialize(mains.select("h", F.col("main.component").alias("main")), "main-components")
    banded = common.lookup(placed, mains, "h").withColumn(
        "band", F.struct(F.col("component") != F.col("main"), F.floor(F.log2("n") * SIZE_BANDS), F.floor(F.col("pos") * POSITION_BANDS / F.col("n")))
    )
    counts = common.materialize(banded.groupBy("h", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks")), "bands")
    cut = common.lookup(banded, counts, ["h", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    held = ["node", "n", "pos", "component", "lead", "o"]
    blocks = cut.groupBy("h", "band", "block").agg(
        F.collect_list(F.struct(*held)).alias("held"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("left"),
        F.min("component").alias("of_low"), F.max("component").alias("of_high"),
    )
    blocks = common.materialize(blocks.select("h", F.struct("band", "block").alias("at"), *[F.col(f"held.{c}").alias(c) for c in held], "low", "high", "left", "of_low", "of_high"), "blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    near = (100 * F.col("x.high") >= PERCENT * F.col("y.low")) & (100 * F.col("y.high") >= PERCENT * F.col("x.low")) & _reaches(F.least("x.left", "y.left"), "x.low", "y.low")
    one = (F.col("x.of_low") == F.col("x.of_high")) & (F.col("y.of_low") == F.col("y.of_high")) & (F.col("x.of_low") == F.col("y.of_low"))
    paired = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.at") <= F.col("y.at")) & near & ~one)
    paired = paired.select((F.col("x.at") == F.col("y.at")).alias("same"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in held])
    return paired.mapInPandas(_opened, BLOCKED).distinct()


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    component_id is the least id reachable by links. Null and empty texts have no
    shingles and link with nothing; a text with fewer words than a shingle has one; very long texts are
    read whole. Rows that repeat an id each get a row, of the component of their own text. Rows without an id take
    part as others do; a component of such rows only is known by a hash of its sets, and a row without id and words keeps null.
    An empty table gives no rows. Columns other than id and text are ignored.
    """
    spark = docs.sparkSession
    common.bound_batches(spark, BATCH_ROWS)
    path = common.scratch(spark, "similarity-classes")
    with common.temporary(spark):
        return common.written(_classes(docs.select(id_col, text_col), id_col, text_col), path)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    sampled = common.materialize(sample_sets(docs, id_col, text_col), "sampled-sets")
    held = spark.sparkContext.broadcast(frequent(sampled))  # at most 2 * MAX_FREQUENT numbers
    total = sampled.agg(F.coalesce(F.sum(F.size("set")), F.lit(0))).first()[0] * SAMPLE_EVERY / 4
    n_buckets = max(common.n_partitions(spark), int(total // BUCKET_ENTRIES) + 1)
    entries = word_hashes(docs, id_col, text_col).mapInPandas(_entries(held, n_buckets), ENTRY)
    listed = common.materialize(entries.groupBy("bucket").applyInPandas(_lists(n_buckets), LISTED), "lists")
    rows = listed.where("kind = 2").select(F.when(F.col("pos") == 0, F.col("h")).alias("id"), F.col("n_a").alias("n"), F.when(F.col("n_a") > 0, F.col("a")).alias("node"))
    nodes = common.materialize(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("id")), "nodes")
    corpus = _Corpus(docs, id_col, text_col, nodes, held)

    # Answers of leaders, and with them the components.
    long = listed.where("kind = 1").select("h", F.col("a").alias("node"), F.col("n_a").alias("n"), "pos")
    in_long = common.materialize(long.groupBy("node").agg(F.collect_list("h").alias("long")), "in-long-lists")  # at most a prefix each
    known = answers = None
    entries_open, pairs_open = _open_pairs(_placed(long, known))
    while pairs_open and (answers is None or pairs_open > OPEN_PAIRS * entries_open):
        long, new = _lead(long, known, corpus)
        answers = new if answers is None else answers.unionByName(new)
        found = links(new)
        known = common.materialize(connected_components(found if known is None else found.unionByName(known.where("node != component").toDF("a", "b"))), "components")
        before = pairs_open
        entries_open, pairs_open = _open_pairs(_placed(long, known))
        if pairs_open > SHRINK * before:
            break

    # Every other pair of different components.
    short = listed.where("kind = 0").groupBy("a", "b", "n_a", "n_b").agg(F.sum("pos").alias("c"), F.max("h").alias("first")).where("first = 1")
    after = lambda n: (PERCENT * F.col(n) + 99 - (PERCENT * F.col(n) + 99) % 100) / 100 - 1  # noqa: E731  entries behind the prefix
    # A short pair may share long lists as well.
    for side in ("a", "b"):
        short = short.join(in_long.toDF(side, f"long_{side}"), side, "left")
    shared = F.coalesce(F.size(F.array_intersect("long_a", "long_b")), F.lit(0))
    most = F.col("c") + shared + F.greatest(after("n_a"), after("n_b"))
    pairs = short.where(_reaches(most, "n_a", "n_b")).select("a", "b", "n_a", "n_b")
    if pairs_open:
        pairs = _rest(long, known, answers).unionByName(pairs).distinct()
    if known is not None:
        for side in ("a", "b"):
            pairs = common.lookup(pairs, known.toDF(side, f"of_{side}"), side, "left")
        pairs = pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "n_a", "n_b")
    second = links(corpus.measured(pairs))
    components = connected_components(second if known is None else second.unionByName(known.where("node != component").toDF("a", "b")))
    placed = nodes.join(components, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    placed = common.materialize(placed, "placed-nodes")
    named = placed.groupBy("component").agg(F.coalesce(F.min("id"), F.min("node")).alias("component_id"))
    placed = common.materialize(common.lookup(placed, common.materialize(named, "component-ids"), "component").select("node", "component_id"), "node-components")
    out = rows.join(placed, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one document per component: the one with the least id.

    Rows without words, and rows without an id, all stay. Of rows that repeat an id, all go if one of them is
    in the component of a smaller id, else all stay. Null and empty texts stay, very long texts are read whole, an empty
    table gives no rows, and columns other than id and text are handed on, whatever their names.
    """
    hidden = common.hide(docs, id_col, text_col)
    classes = similarity_classes(hidden, id_col, text_col)
    gone = classes.where((F.col("n_shingles") > 0) & (F.col(id_col) != F.col("component_id"))).select(F.col(id_col).alias("__gone")).distinct()
    return common.show(hidden.join(gone, F.col(id_col) == F.col("__gone"), "left_anti"), docs, id_col, text_col)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """similarity_classes of all documents; a null text has no shingles and a null id its own row."""
    return similarity_classes(common.documents(spark, sf_dir).select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, len(sh)::BIGINT AS n, md5(array_to_string(list_sort(sh), chr(10))) AS sig, sh FROM s),
rep AS (SELECT sig, min(doc_id) AS rep, any_value(n) AS n FROM n WHERE n > 0 GROUP BY sig),
e AS (SELECT rep.rep, rep.n, unnest(n.sh) AS h FROM rep JOIN n ON n.doc_id = rep.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.h = b.h AND a.rep < b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS x, rep AS y FROM rep UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component, n.doc_id) AS component_id
FROM n LEFT JOIN rep ON rep.sig = n.sig AND n.n > 0 LEFT JOIN c ON c.x = rep.rep
"""
