"""Spelling variants: words one edit apart, grouped under the form that is much commoner.

1. Occurrences are counted per word; Spark sums them partly before the shuffle.
2. Words are dealt by ranges and cut into trie shards of bounded size. A shard is a trie, and one of the reversed words, in
   a few flat arrays: nodes in breadth-first order, so the children of a node lie
   side by side, with a label each, and a count where a word ends.
3. Shards are sent to all workers, ROUND_BYTES at a time. Each word's distance-one Levenshtein automaton is intersected
   with every shard depth-first: down the word's own path as long as no edit is spent, from
   every node of it with one inserted, deleted or replaced letter, after which only one path is left. Edits
   in the first half of a word are made on its way down the trie of reversed words.
4. A word and a round give one row: how many accepting neighbours, and the best. Rows are
   reduced per word; neighbours are never listed.
5. Roots follow forms by doubling. A form is at least MIN_RATIO times as common, so chains are short.

Of equal edits only one is made (a letter is not inserted before an equal one, and of a run of equal letters the last
one goes), so that every neighbour is met once and long runs of one letter cost no more than other words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Letters of words, as a regular-expression class body.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, MIN_RATIO, EVERY = 7, 2, 10, 31
#: Words that one task walks through the tries.
WORDS_A_TASK = 20_000
#: Letters of a trie shard (a longer word has a shard of its own), and bytes of the shards that are sent out at once.
SHARD_CHARS, ROUND_BYTES = 1 << 20, 64 << 20
ARRAYS = ["first", "labels", "counts", "back_first", "back_labels", "back_counts"]
FOUND_SCHEMA = "word string, n_near long, best_n long, best string"


def variant(run: Column, id_col: str = "doc_id") -> Column:
    """A lower-cased run of letters; where 31 divides the checksum of id and run, without the letter that the checksum points at."""
    h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words long and frequent enough; shorter runs are not even cut out of the text."""
    lowered = common.lower_ascii(common.text_or_empty(text_col))
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    each = docs.select(F.col(id_col), F.explode(runs).alias("__run"))
    words = each.select(variant(F.col("__run"), id_col).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def build_trie(words: list[str], counts: list[int]) -> dict:
    """The flat trie of distinct words in code-point order; labels are Latin-1 letters, one byte each.

    Node i has the children first[i] to first[i + 1]. counts[i] is that of the word that ends at node i, or 0.
    """
    codes = [w.encode("latin-1") for w in words]
    level = [(0, len(codes), 0)]
    labels, first, ends = bytearray(b"\0"), [], []
    while level:  # (from, to, depth): words that share a path of that depth
        below = []
        for low, high, depth in level:
            first.append(len(labels))
            ends.append(counts[low] if depth and len(codes[low]) == depth else 0)
            at = low + (depth > 0 and len(codes[low]) == depth)
            while at < high:
                letter, end = codes[at][depth], at + 1
                while end < high and codes[end][depth] == letter:
                    end += 1
                labels.append(letter)
                below.append((at, end, depth + 1))
                at = end
        level = below
    first.append(len(labels))
    return {"first": np.array(first, np.uint32), "labels": bytes(labels), "counts": np.array(ends, np.int64)}


class Trie:
    """One direction of a shard on a worker, which reads the arrays as they were sent."""

    def __init__(self, first: bytes, labels: bytes, counts: bytes):
        self.first, self.counts, self.labels = memoryview(first).cast("I"), memoryview(counts).cast("q"), labels

    def follow(self, node: int, word: bytes, at: int) -> int:
        """The count of the word that ends where word[at:] leads from a node, or 0."""
        find, first = self.labels.find, self.first
        while at < len(word):
            node = find(word[at], first[node], first[node + 1])
            if node < 0:
                return 0
            at += 1
        return self.counts[node]

    def edits(self, word: bytes, start: int) -> Iterator[tuple[int, int, int, str]]:
        """(count, place, letter, kind) of every word of the trie that is one edit away and shares at least `start` letters, each once.

        The automaton and the trie go in step, depth-first; the place is where the two words first differ.
        """
        node, n, labels, first, counts, find = 0, len(word), self.labels, self.first, self.counts, self.labels.find
        for at in range(n + 1):
            own, after = word[at] if at < n else -1, word[at + 1] if at + 1 < n else -1
            if at >= start:
                for child in range(first[node], first[node + 1]):
                    letter = labels[child]
                    if letter == own:
                        continue
                    if at == n:
                        if counts[child]:
                            yield counts[child], at, letter, "insert"
                        continue
                    low, high = first[child], first[child + 1]  # most ways end at the next letter
                    down = find(own, low, high)
                    if down >= 0 and (found := self.follow(down, word, at + 1)):
                        yield found, at, letter, "insert"
                    if after < 0:
                        if counts[child]:
                            yield counts[child], at, letter, "replace"
                    elif (down := find(after, low, high)) >= 0 and (found := self.follow(down, word, at + 2)):
                        yield found, at, letter, "replace"
                if at < n and after != own and (found := self.follow(node, word, at + 1)):
                    yield found, at, 0, "delete"
            if at == n:
                break
            node = find(own, first[node], first[node + 1])
            if node < 0:
                break


def neighbours(forward: Trie, backward: Trie, word: bytes) -> Iterator[tuple[int, bytes]]:
    """(count, neighbour) of every word of a shard one edit away, each once.

    Words that first differ in the second half are found in the trie, the others in that of reversed words, so no walk
    leaves the word's own path near the root, where a trie is broad.
    """
    n = len(word)
    half = n // 2
    for found, *edit in forward.edits(word, half):
        yield found, edited(word, *edit)
    turned = word[::-1]
    for found, *edit in backward.edits(turned, n - half):
        other = edited(turned, *edit)[::-1]
        if not word.startswith(other[:half]) or len(other) < half:  # the two differ before `half`; else they were found above
            yield found, other


def edited(word: bytes, at: int, letter: int, kind: str) -> bytes:
    middle = b"" if kind == "delete" else bytes([letter])
    return word[:at] + middle + word[at + (kind != "insert") :]


def build_shards(words: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(id, arrays of both tries, n_bytes) per shard, to be written before it is used. Ranges of words are cut as they stream by, so a task holds one shard of at most shard_chars letters, or one longer word."""
    chars = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    dealt = words.repartitionByRange(max(1, -(-chars // shard_chars)), "word").sortWithinPartitions("word")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shard() -> pd.DataFrame:
            turned = sorted((w[::-1], n) for w, n in zip(held, counts, strict=True))
            row = {}
            for way, trie in (("", build_trie(held, counts)), ("back_", build_trie([w for w, _ in turned], [n for _, n in turned]))):
                row |= {f"{way}first": trie["first"].tobytes(), f"{way}labels": trie["labels"], f"{way}counts": trie["counts"].tobytes()}
            return pd.DataFrame([row | {"n_bytes": sum(map(len, row.values()))}])

        held, counts, size = [], [], 0
        for pdf in batches:
            for word, n in zip(pdf["word"], pdf["n"].tolist(), strict=True):
                if held and size + len(word) > shard_chars:
                    yield shard()
                    held, counts, size = [], [], 0
                held.append(word)
                counts.append(n)
                size += len(word)
        if held:
            yield shard()

    return dealt.mapInPandas(run, ", ".join(f"{c} binary" for c in ARRAYS) + ", n_bytes long").withColumn("id", F.monotonically_increasing_id())


def near_words(words: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n_near, form, form_n) of words with neighbours: how many, and the most frequent (the smallest of equals).

    `words` and `shards` are written tables. A round sends out shards of at most round_bytes together, or one larger shard, and runs over all words.
    """
    spark = words.sparkSession
    upto = F.sum("n_bytes").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    sizes = shards.select("id", "n_bytes").withColumn("round", F.floor((upto - F.col("n_bytes")) / round_bytes))  # a row of numbers per MB of words
    rounds = sizes.groupBy("round").agg(F.collect_list("id").alias("ids")).orderBy("round")
    parts, dealt = [], words.select("word").repartition(max(1, -(-words.count() // WORDS_A_TASK)), "word")
    for ids in [r["ids"] for r in rounds.toLocalIterator()]:
        rows = shards.where(F.col("id").isin(ids)).select(*ARRAYS).collect()  # round_bytes
        sent = spark.sparkContext.broadcast([tuple(map(bytes, r)) for r in rows])

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            tries = [(Trie(*r[:3]), Trie(*r[3:])) for r in sent.value]
            for pdf in batches:
                out = []
                for word in pdf["word"]:
                    code, n_near, best_n, best = word.encode("latin-1"), 0, 0, b""
                    for pair in tries:
                        for found, other in neighbours(*pair, code):
                            n_near += 1
                            if found > best_n or (found == best_n and other < best):
                                best_n, best = found, other
                    if n_near:
                        out.append((word, n_near, best_n, best.decode("latin-1")))
                yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])

        parts.append(common.materialize(dealt.mapInPandas(run, FOUND_SCHEMA), "near-words"))
        sent.destroy()
    if not parts:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.col("word").alias("form"), F.col("n").alias("form_n")).limit(0)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")))
    reduced = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return reduced.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by doubling; chains must not meet themselves."""
    reach = common.materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = common.lookup(reach, onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        step = common.materialize(step, "roots")
        reach = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return reach


def spelling_variants(words: DataFrame, min_ratio: int = MIN_RATIO, shard_chars: int = SHARD_CHARS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every distinct word of (word, n), whose letters are Latin-1.

    A word's form is its commonest neighbour, if that is min_ratio times as common; ties go to the smallest in code-point order.
    Very long words take part whole; an empty table gives no rows.
    """
    words = common.materialize(words.select("word", "n"), "words")
    shards = common.materialize(build_shards(words, shard_chars), "trie-shards")
    near = near_words(words, shards, round_bytes)
    common_enough = F.col("form_n") >= F.col("n") * min_ratio
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common_enough, F.col("form")).alias("form"), F.when(common_enough, F.col("form_n")).alias("form_n")
    )
    joined = common.materialize(joined, "forms")
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents.

    Null and empty texts have no words, a null id stands as nothing before the colon of the checksum; repeated rows count each; an empty table gives no rows.
    """
    words = count_words(common.documents(spark, sf_dir).select("doc_id", "text"))
    return spelling_variants(words).select("word", "n", "n_near", "form", "form_n", "root")
