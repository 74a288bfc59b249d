import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from probtopk.llm import common, jaccard, linededup, mixing, quality, secrets, sharding, syncmers
from probtopk.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, key string"
WS = re.compile(r"[\x20\x09-\x0D]+")


def table(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, -1, "x", "y") for i, t, s in rows], SCHEMA)


def words(n, seed, vocab=500):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


EDGES = [
    (None, "no id here at all", "a"), (1, None, None), (2, "", "a"), (3, " \t\n\x0b ", "a"), (4, "one", "b"), (5, words(20_000, 1), "b"),
    (6, words(60, 2), "a"), (7, words(60, 2), None), (7, words(60, 2), None), (8, "é漢😀 x" * 9, "c"), (9, "same\nline\n\nline", "c"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES)


# Fingerprints.
def edited(texts, i):
    q = len(texts[i]) // 4
    return texts[i][: len(texts[i]) - q] + texts[(i + 1) % len(texts)][:q]


def test_fingerprints_of_edited_texts(spark):
    rows = [(i * 7, words(random.Random(i).randrange(0, 90), i) if i % 9 else "", "a") for i in range(60)]
    got = {r["doc_id"]: r for r in syncmers.fingerprints(table(spark, rows)).collect()}
    texts = [t for _, t, _ in rows]
    for i, (doc_id, t, _) in enumerate(rows):
        r = got[doc_id]
        assert r["n_chars"] == len(t) and 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert r["edited_sha256"] == hashlib.sha256(edited(texts, i).encode()).hexdigest()
    long = [r for r in got.values() if r["n_chars"] > 100]
    assert np.mean([r["near_edited"] for r in long]) > 0.4 > 0.2 > np.mean([r["near_next"] for r in long])


def test_fingerprints_of_edge_cases(spark, edges):
    got = syncmers.fingerprints(edges).collect()
    assert len(got) == len(EDGES)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["fingerprint"])
    assert by[6][0] == by[7][0] == by[7][1] and by[1] == by[2]
    assert syncmers.fingerprints(edges.limit(0)).count() == 0
    one = syncmers.fingerprints(table(spark, [(1, "alone in the table", "a")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"alone in the t" + b"alon").hexdigest()


@pytest.mark.parametrize("shorter,longer", [(390, 410), (399, 400), (410, 430)])
def test_near_copies_of_any_length_are_alike(spark, shorter, longer):
    texts = [(words(200, i)[:shorter], words(200, i)[:longer]) for i in range(20)]
    rows = [(2 * i + j, t, "a") for i, pair in enumerate(texts) for j, t in enumerate(pair)]
    got = {r["doc_id"]: r for r in syncmers.fingerprints(table(spark, rows)).collect()}
    assert np.mean([got[2 * i]["near_next"] for i in range(20)]) > 0.8


def test_edits_that_shorten_a_text_keep_it_alike(spark):
    rows = [(i, words(200, i)[:420] if i % 2 == 0 else "x", "a") for i in range(20)]
    got = [r for r in syncmers.fingerprints(table(spark, rows)).collect() if r["n_chars"] == 420]
    assert len(got) == 10 and np.mean([r["near_edited"] for r in got]) > 0.5


def test_no_length_reads_otherwise(spark):
    """A text with repeats and a longer one by a character: likeness to the edited text hardly differs."""
    base = " ".join(words(9, i % 4, 30) for i in range(40))
    texts = [base[: 399 + j] for j in range(2)]
    rows = [(10 * j + i, t, "a") for j, text in enumerate(texts) for i, t in enumerate([text, words(100, 77)])]
    got = {r["doc_id"]: r["near_edited"] for r in syncmers.fingerprints(table(spark, rows)).collect()}
    assert abs(got[0] - got[10]) <= 0.05


def test_anchors_move_with_a_passage(spark):
    passage = words(80, 5)
    df = table(spark, [(1, passage, "a"), (2, words(30, 6) + " " + passage, "a")])
    a, b = ({(x["pos"], x["hash"]) for x in r["anchors"]} for r in syncmers.positional_anchors(df).orderBy("doc_id").collect())
    assert len({(p + 30, h) for p, h in a} - b) == 0


def xx(*parts, seed=42):
    """Spark's xxhash64 of strings and longs."""
    for x in parts:
        data = x.encode() if isinstance(x, str) else (x & 2**64 - 1).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_anchors(tokens):
    """Closed syncmers by their definition: windows of four tokens whose least run of two lies at an edge."""
    h = [xx(t) for t in tokens]
    out = []
    for i in range(len(h) - 3):
        runs = [xx(*h[i + j : i + j + 2], seed=42) for j in range(3)]
        if min(runs) in (runs[0], runs[2]):
            out.append(xx(runs[0], runs[2]))
        else:
            out.append(None)
    return out


def plain_sketch(t):
    """The 64 smallest anchor hashes of the pieces (words in runs of four characters), each with its first place."""
    pieces = [w[i : i + 4] for w in WS.split(t) for i in range(0, len(w), 4)]
    first = {}
    for i, h in enumerate(plain_anchors(pieces)):
        first.setdefault(h, i)
    first.pop(None, None)
    if not first:
        seed = 42
        for x in pieces:
            seed = xx(xx(x), seed=seed) & 2**64 - 1
        first = {seed - 2**64 if seed >= 2**63 else seed: 0}
    return dict(sorted(first.items())[:64])


def plain_likeness(a, b):
    union = sorted(a.keys() | b.keys())[:64]
    moved = [a[h] - b[h] for h in union if h in a and h in b]
    return max(sum(moved.count(d) > 1 for d in moved), min(len(moved), 1)) / len(union)


def test_fingerprints_equal_plain_syncmers(spark):
    texts = [words(random.Random(i).randrange(0, 130), i // 3, 80) for i in range(60)] + ["", "a", "a b c", "é漢😀 x y z", "a b c d e f g"]
    texts += ["abcdefghijklmnop", "é漢😀é漢😀é漢😀é漢😀é漢😀x", "long-words-are-cut " * 9, "q r s t", "q r s u"]
    got = {r["doc_id"]: r for r in syncmers.fingerprints(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    hexes = lambda s: ",".join(f"{h & 2**64 - 1:016x}@{i}" for h, i in s.items())
    for i, t in enumerate(texts):
        own, other, nxt = plain_sketch(t), plain_sketch(edited(texts, i)), plain_sketch(texts[(i + 1) % len(texts)])
        assert got[i]["fingerprint"] == hexes(own) and got[i]["edited_fingerprint"] == hexes(other)
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(own, other)) and got[i]["near_next"] == pytest.approx(plain_likeness(own, nxt))


# Lines.
def plain_dedup(rows, min_docs):
    key = lambda x: x.strip(common.WS_CHARS).translate(str.maketrans(common.UPPER, common.LOWER))
    counts = {}
    for _, t, _ in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            counts[k] = counts.get(k, 0) + 1
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or counts[key(x)] < min_docs) for _, t, _ in rows]


@pytest.mark.parametrize("least_probes", [2_000, 3])
def test_line_dedup_equals_plain_counting(spark, monkeypatch, least_probes):
    monkeypatch.setattr(linededup, "LEAST_PROBES", least_probes)
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice([f"l{r.randrange(40)}", f" L{r.randrange(40)}\t", "", words(3, r.random())]) for _ in range(r.randrange(12))), "a") for i in range(150)]
    rows += EDGES
    got = linededup.with_kept_lines(table(spark, rows)).collect()
    want = sorted(zip([i if i is not None else -1 for i, _, _ in rows], plain_dedup(rows, 10), strict=True))
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, "\n".join(x["__kept"])) for x in got) == want


def test_line_dedup_keeps_columns_and_nulls(spark, edges):
    out = linededup.dedup_lines(edges, min_docs=2)
    assert out.columns == edges.columns and out.count() == len(EDGES)
    assert out.where("doc_id = 1").first()["text"] is None
    assert linededup.dedup_lines(edges.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_counts_are_found():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        h = np.unique(rng.integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
        sizes, bits = linededup.build_mph(h)
        at = linededup.lookup_mph(sizes, bits, np.cumsum(bits) - 1, h)
        assert sorted(at) == list(range(len(h)))
    with pytest.raises(ValueError):
        linededup.build_mph(np.array([5, 5], np.uint64))


# N-gram Jaccard.
def shingles(t):
    w = [x for x in WS.split((t or "").translate(str.maketrans(common.UPPER, common.LOWER))) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed):
    """Groups of edited copies of several sizes, with short texts among them."""
    r, rows = random.Random(seed), []
    for g in range(12):
        base = words(r.randrange(3, 60), g).split()
        for _ in range(r.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
            rows.append((len(rows) * 3, " ".join(w), "a"))
    return rows


def found_classes(spark, rows):
    return {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.similarity_classes(table(spark, rows)).collect()}


@pytest.mark.parametrize("long_list,sample_df,open_pairs", [(16, 3, 8), (2, 1, 0), (2, 1, 1e9)])
def test_jaccard_equals_all_pairs(spark, monkeypatch, long_list, sample_df, open_pairs):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "SAMPLE_DF", sample_df)
    monkeypatch.setattr(jaccard, "SAMPLE_EVERY", 2)
    monkeypatch.setattr(jaccard, "OPEN_PAIRS", open_pairs)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = near_copies(1)
    rows += [(1001, None, "a"), (1002, "", "a"), (1003, " \n", "a"), (1004, "A b", "a"), (1005, "a B", "a")]
    got = found_classes(spark, rows)
    assert got == plain_components(rows)
    if open_pairs == 8:
        kept = {x["doc_id"] for x in jaccard.keep_one(table(spark, rows)).collect()}
        assert kept == {i for i, (_, c) in got.items() if i == c}


@pytest.mark.parametrize("open_pairs", [8, 1e9])
def test_jaccard_of_sets_that_share_much_but_do_not_link(spark, monkeypatch, open_pairs):
    """A passage that all texts start with, so that the lists stay open after their leaders."""
    monkeypatch.setattr(jaccard, "OPEN_PAIRS", open_pairs)
    monkeypatch.setattr(jaccard, "SAMPLE_EVERY", 1)
    passage = words(120, 77)
    rows = [(i, f"{passage} {words(20 + i % 5, 1000 + i // 2)}", "a") for i in range(120)]
    assert found_classes(spark, rows) == plain_components(rows)


def test_jaccard_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(common.lookup, "__defaults__", ("inner", 0))
    rows = [(i, words(50, i // 3) + (" end" if i % 3 else ""), "a") for i in range(30)] + [(100 + i, t, s) for i, t, s in near_copies(2)]
    assert found_classes(spark, rows) == plain_components(rows)


def test_texts_that_share_an_id_are_told_apart(spark):
    a, b = words(60, 1), words(60, 2)
    got = jaccard.similarity_classes(table(spark, [(7, a, "x"), (7, b, "x"), (8, f"{b} tail", "x"), (9, f"{a} tail", "x"), (10, words(60, 3), "x")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(7, 7), (7, 7), (8, 7), (9, 7), (10, 10)]


def test_rows_without_id_link_as_others(spark):
    a = words(60, 1)
    got = jaccard.similarity_classes(table(spark, [(None, a, "x"), (5, f"{a} tail", "x"), (None, None, "x")])).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(5, 57, 5), (None, 56, 5), (None, 0, None)}


def test_jaccard_of_edge_cases(spark, edges):
    got = jaccard.similarity_classes(edges).collect()
    assert len(got) == len(EDGES)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] in (6, 7)} == {(6, 6), (7, 6)}
    assert jaccard.similarity_classes(edges.limit(0)).count() == 0
    assert jaccard.keep_one(edges).columns == edges.columns


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Quality.
def plain_base(t):
    w = [x for x in WS.split(t or "") if x]
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for x in lines:
        if x.strip(common.WS_CHARS):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_base_statistics_equal_plain_ones():
    r = random.Random(4)
    for t in [None, "", "\n \n", "a\x85b c\x1cd", *[x[1] for x in EDGES if x[1] and len(x[1]) < 5000]]:
        assert quality.measure(t)[:5] == plain_base(t)
    for _ in range(60):
        t = " ".join(r.choice("abc#|") for _ in range(r.randrange(40))) + "\n" + "\n".join(r.choice(["x y", "z", ""]) for _ in range(5))
        assert quality.measure(t)[:5] == plain_base(t)


def junk(i):
    """Texts spoilt in several ways."""
    w = words(80, i).split()
    return " ".join([[f"{x}%%%" for x in w], [f"{x.upper()}!!" for x in w], [f"{x} |" for x in w], [x + "7" * 12 for x in w]][i // 50 % 4])


def test_forest_finds_junk_and_labels_set_the_limit(spark):
    rows = [(i, words(80, i) if i % 50 else junk(i), "a") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 50 != 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(table(spark, rows), labels).collect()}
    assert sum(not got[i]["kept"] for i in got if i % 50 == 0) >= 6
    assert sum(not got[i]["kept"] for i in got if i % 50) <= 4
    nothing = quality.judge(table(spark, rows), labels.limit(0))
    assert nothing.where("kept").count() == 400


def test_path_lengths_equal_a_plain_walk():
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(300, 4)), 1)
    forest = quality.fit_forest(rows, n_trees=7, tree_rows=32)

    def walk(tree, row):
        feature, cut, left, right, _ = tree
        at, depth = 0, 0
        while feature[at] >= 0:
            at, depth = (left[at] if row[feature[at]] < cut[at] else right[at]), depth + 1
        return at, depth

    harmonic = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    got = quality.anomaly(forest, rows)
    for i, row in enumerate(rows):
        paths = [t[4][walk(t, row)[0]] for t in forest["trees"]]
        assert all(p >= walk(t, row)[1] for p, t in zip(paths, forest["trees"], strict=True))
        assert got[i] == pytest.approx(2 ** (-np.mean(paths) / harmonic(32)))
    # A tree over all rows: the path at a leaf is its depth and what its rows would add.
    tree = quality._tree(rows[:16], np.random.default_rng(0))
    leaves = {}
    for row in rows[:16]:
        leaves.setdefault(walk(tree, row), []).append(row)
    assert all(tree[4][at] == pytest.approx(depth + harmonic(len(held))) for (at, depth), held in leaves.items())


def test_the_limit_parts_the_labels_best(spark):
    rng = np.random.default_rng(5)
    good, bad = rng.uniform(0.3, 0.6, 400).round(4), rng.uniform(0.45, 0.9, 100).round(4)
    scored = spark.createDataFrame([(i, float(x)) for i, x in enumerate([*good, *bad])], "id long, score double")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(500)], "doc_id long, quality int")
    limits = np.arange(1001) / 1000
    lost, caught = [np.array([(np.floor(x * 1000) >= limit * 1000).mean() for limit in limits]) for x in (good, bad)]
    gain = np.where(lost <= quality.MAX_GOOD_LOST, caught - lost, -1)
    got = quality.calibrate(scored, labels)
    assert (np.floor(bad * 1000) >= got * 1000).mean() - (np.floor(good * 1000) >= got * 1000).mean() == pytest.approx(gain.max())


def test_quality_of_repeated_rows(spark):
    rows = [(1, words(80, 1), "a")] * 200 + [(i, words(80, i), "a") for i in range(2, 40)]
    df = spark.createDataFrame([(i % 3,) for i in range(500)], "k long")
    assert common.smallest_hashes(df, 120, "k").count() == 120 and common.smallest_hashes(df, 900, "k").count() == 500
    got = quality.judge(table(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_quality_of_edge_cases(spark, edges):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(edges, labels).count() == len(EDGES)
    assert quality.judge(edges.limit(0), labels).count() == 0


# Secrets.
KINDS = [("assign", re.compile(secrets.BASE_KINDS[0][1], re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def plain_spans(t):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, n) in enumerate(KINDS) for m in p.finditer(t or "") if len(m[g]) >= n]
    return [s for *_, s in sorted(found)]


def test_secret_spans_equal_plain_search(spark):
    r = random.Random(9)
    parts = ["password=", "Token: ", '"api_key" : "', "secret='", "AKIA", "abcdef0123456789" * 2, "é", "😀", " ", "\n", "hunter2hunter2", "short", "ABCDEFGHIJKLMNOP", "=", "passwd"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(25))), f"s{i % 3}") for i in range(200)] + EDGES
    got = secrets.find_secrets(table(spark, rows)).collect()
    base = sorted((x["doc_id"] if x["doc_id"] is not None else -1, [f"{s['kind']}:{s['start']}:{s['end']}" for s in x["base"]]) for x in got)
    assert base == sorted((i if i is not None else -1, plain_spans(t)) for i, t, _ in rows)
    for x in got:
        assert {(s["kind"], s["start"]) for s in x["base"]} <= {(s["kind"], s["start"]) for s in x["spans"]}


def test_widely_copied_values_are_examples(spark):
    shared, own, token = "password=changeme12345", "password=zk3Jq9vXw2", "Zx9Yw8Vu7Ts6Rq5Po4Nm3"
    rows = [(i, f"use {shared} here", f"s{i % 4}") for i in range(8)] + [(50, f"{own} and {token}", "s1"), (51, f"my {token}", "s1")]
    rows += [(60 + i, "copied Aa1Bb2Cc3Dd4Ee5Ff6Gg7", f"s{i}") for i in range(3)]
    got = {x["doc_id"]: x["spans"] for x in secrets.find_secrets(table(spark, rows)).collect()}
    assert all(got[i][0]["example"] for i in range(8))
    assert [(s["kind"], s["example"]) for s in got[50]] == [("assign", False), ("token", False)]
    assert [s["kind"] for s in got[51]] == ["token"] and got[60] == []
    assert secrets.find_secrets(table(spark, rows).limit(0)).count() == 0


def test_copies_of_a_page_do_not_hide_its_token(spark):
    rows = [(i, "key Zx9Yw8Vu7Ts6Rq5Po4Nm3", "s1") for i in range(8)] + [(20 + i, "copied Aa1Bb2Cc3Dd4Ee5Ff6Gg7", f"s{i}") for i in range(3)]
    got = {x["doc_id"]: x for x in secrets.find_secrets(table(spark, rows)).collect()}
    assert all([(s["kind"], s["example"]) for s in got[i]["spans"]] == [("token", False)] and not got[i]["copied"] for i in range(8))
    assert all(not got[20 + i]["spans"] and [(s["kind"], s["start"], s["example"]) for s in got[20 + i]["copied"]] == [("token", 7, True)] for i in range(3))


# Mixing.
def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, words(random.Random(i).randrange(1, 60), i), ["a", "b", "c", None][min(i % 7, 3)]) for i in range(300)] + [(300, None, "e"), (301, "", "a")]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    got = mixing.mix(mixing.with_weights(docs, labels)).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    by = got.fillna({"source": "~"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 1).all() and (by["target"] <= 2 * by["size"]).all()
    assert by["target"].sum() == pytest.approx(1.5 * got["size"].sum())
    again = mixing.mix(mixing.with_weights(docs.repartition(3), labels)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mixed_copies_have_the_words_taken(spark, edges):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.mixed_copies(edges, labels)
    plan = mixing.mix(mixing.with_weights(edges, labels)).agg({"taken": "sum"}).first()[0]
    assert out.columns == edges.columns
    assert sum(len([w for w in WS.split(r["text"] or "") if w]) for r in out.collect()) == plan
    assert out.where("doc_id IN (1, 2, 3)").count() == 3
    assert mixing.mixed_copies(edges.limit(0), labels).count() == 0


def test_better_labels_are_taken_first(spark):
    rows = [(i, words(10, i), "abc"[i % 3]) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(900)], "doc_id long, quality int, toxic int")
    got = mixing.mix(mixing.with_weights(table(spark, rows), labels)).where("source = 'c'").toPandas()
    good = got["doc_id"] % 2 == 0
    assert got["taken"][good].sum() > 1.3 * got["taken"][~good].sum() > 0


# Sharding.
def test_shards_have_equal_bytes_and_gapless_places(spark):
    rows = [(i, words(random.Random(i).randrange(1, 90), i), "a") for i in range(3000)]
    got = sharding.shard(table(spark, rows), 24).toPandas()
    by = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "count"), top=("slot", "max"), u=("slot", "nunique"))
    assert len(by) == 24 and by["b"].max() - by["b"].min() < 0.03 * by["b"].mean()
    assert (by["top"] + 1 == by["n"]).all() and (by["u"] == by["n"]).all()
    import zlib

    texts = {i: t for i, t, _ in rows}
    assert all(zlib.crc32(texts[r.doc_id].encode()) == r.text_crc32 and len(texts[r.doc_id].encode()) + 8 == r.size for r in got.itertuples())


def test_shards_equal_plain_dealing(spark):
    """Slots by hash, heaviest slot first to the emptiest shard, places in order of slot and id."""
    rows = [(i * 3, words(random.Random(i).randrange(1, 90), i), "a") for i in range(700)]
    slots = {}
    for i, t, _ in rows:
        slots.setdefault(xx(i) % sharding.N_SLOTS, []).append((i, len(t.encode()) + 8))
    loads, shard_of = [0] * 24, {}
    for n, s in sorted((-sum(b for _, b in slots.get(s, [])), s) for s in range(sharding.N_SLOTS)):
        shard_of[s] = loads.index(min(loads))
        loads[shard_of[s]] += 1 - n
    places, want = [0] * 24, {}
    for s in sorted(slots):
        for i, _ in sorted(slots[s]):
            want[i] = (shard_of[s], places[shard_of[s]])
            places[shard_of[s]] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(table(spark, rows), 24).collect()} == want


def test_map_versions_and_growth(spark):
    slotted = sharding.with_slot(table(spark, [(i, words(20, i), "a") for i in range(2000)]), "doc_id", "text")
    path = common.scratch(spark, "map")
    first = sharding.store_map(sharding.initial_map(sharding.slot_bytes(slotted), 5), path, 1)
    second = sharding.store_map(sharding.grow_map(first, 5), path, 2).toPandas().set_index("virtual_slot")
    first = sharding.load_map(spark, path, 1).toPandas().set_index("virtual_slot")
    moved = first["shard"] != second["shard"]
    assert set(second["shard"][moved]) == {5} and len(second) == sharding.N_SLOTS and set(second["version"]) == {2}
    loads = second.groupby("shard")["bytes"].sum()
    assert loads.max() < 1.1 * loads.mean() and loads.min() > 0.8 * loads.mean()


def test_sharding_edge_cases(spark, edges):
    assert sharding.shard(edges, 3).count() == len(EDGES)
    assert sharding.shard(edges.limit(0), 3).count() == 0
