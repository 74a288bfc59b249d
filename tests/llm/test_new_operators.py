"""Filter audit, spelling variants and exact deduplication against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sqlcheck import DATA, duck, same

from probtopk.llm import exactdedup, filteraudit, spelling
from probtopk.llm.exactdedup import CuckooIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Filter audit.
def plain_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    least = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good, toxic = ({i for i, *flags in labels if flags[k] == 1 and i is not None} for k in (0, 1))
    parts = defaultdict(list)
    for doc_id, text, lang in docs:
        text = text or ""
        w = words(text)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (doc_id is not None and least[text] < doc_id)
        parts[lang or ""].append((set(fails), doc_id in good, doc_id in toxic))
    rows = []
    for part, found in parts.items():
        removed = Counter()
        mine = []
        for order in permutations("ABCDE"):
            for step, own in enumerate(order):
                before = set(order[:step])
                here = [d for d in found if own in d[0] and not d[0] & before]
                removed[own] += len(here)
                kept = sum(not d[0] & (before | {own}) for d in found)
                redundant = sum(own in d[0] and bool(d[0] & before) for d in found)
                unique = sum(d[0] == {own} for d in found)
                mine.append([part, "".join(order), step + 1, kept, len(here), redundant, unique, sum(d[1] for d in here), sum(d[2] for d in here), own])
        rows += [(*r[:-1], removed[r[-1]]) for r in mine]
    return sorted(rows)


AUDITED = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_audit_of_edge_rows_is_that_of_plain_counting(spark):
    long = " ".join(f"w{i}" for i in range(150))
    docs = [
        (1, None, None), (2, "", ""), (3, "", "en"), (4, long, "en"), (5, long, "de"), (5, long, "de"), (6, long, None), (None, long, "en"), (None, None, "en"), (7, "ABC def", "en"),
        (8, "a # b", "en"), (9, "same same same same same", "fr"), (9, "W " * 30_000, "fr"), (1, long.upper(), "fr"), (3, "a b c", "en"),
    ]
    labels = [(4, 1, 0), (5, 1, 1), (5, 0, 1), (7, None, 1), (None, 1, 1), (9, 1, None), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, lang string, part string, mask int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r[c] for c in AUDITED) for r in filteraudit.audit(frame, marks).collect())
    assert got == plain_audit(docs, labels)
    assert filteraudit.audit(frame.limit(0), marks).count() == 0
    assert filteraudit.audit(frame, marks.limit(0)).count() == len(got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=32, max_size=32))
def test_signed_sums_give_back_the_cells(counts):
    sums = [sum(n * (-1) ** (m & s).bit_count() for m, n in enumerate(counts)) for s in range(32)]
    assert [sum(x * (-1) ** (m & s).bit_count() for s, x in enumerate(sums)) >> 5 for m in range(32)] == counts


def test_cells_of_masks_are_exact(spark):
    rows = spark.createDataFrame([("a", m % 3 == 0, m % 5 == 0, m, 3 * m, m) for m in range(16)], "part string, good boolean, toxic boolean, mask int, firsts long, copies long")
    row = filteraudit.mask_cells(filteraudit.parity_sums(rows, 5), 5).first()
    assert row["docs"] == [3 * m for m in range(16)] + list(range(16))
    assert row["good"] == [3 * m if m % 3 == 0 else 0 for m in range(16)] + [m if m % 3 == 0 else 0 for m in range(16)]
    assert row["toxic"][5] == 15 and row["toxic"][6] == 0


def test_audit_of_one_text_in_one_group(spark):
    """A group of copies, of which none has an id that another one has, is counted without one task having all of them."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'the same text' AS text", "IF(id % 2 = 0, 'en', 'de') AS lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r["part"]: r for r in filteraudit.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").collect()}
    assert (rows["en"]["kept"], rows["en"]["removed"], rows["de"]["kept"], rows["de"]["removed"]) == (1, 9_999, 0, 10_000)


# Spelling variants.
def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 31 else run[:at] + run[at + 1 :]] += 1
    return plain_forms({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def plain_forms(words):
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    wild = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            wild[w[:i], w[i + 1 :]].add(w)
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(near[w]), form.get(w) or "", words.get(form.get(w), 0), root(w)) for w, n in words.items())


def variant_rows(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"] or "", r["form_n"] or 0, r["root"]) for r in df.collect())


def test_query_of_variants_is_that_of_plain_python(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = spelling.op12_spelling_variants(spark, DATA)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    rows = variant_rows(got)
    assert rows == plain_variants(zip(docs["doc_id"].tolist(), docs["text"], strict=True)) and any(r[3] for r in rows)


def test_variants_of_edge_rows(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abà") for _ in range(rng.choice([6, 7, 7, 8]))) for _ in range(400)) for _ in range(6)]
    texts += [None, "", "short", "a" * 5_000 + " " + "a" * 5_001, "a" * 5_000 + " " + "a" * 5_001, "ÀBCDEFGH÷ x", "ÀBCDEFGH÷, ÀBCDEFGH÷-àbcdefgh÷"]
    docs = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(6, texts[0])] * 3
    frame = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int")
    counted = spelling.count_words(frame)
    want = plain_variants(docs)
    assert variant_rows(spelling.spelling_variants(counted)) == want
    assert variant_rows(spelling.spelling_variants(counted, shard_chars=300, round_bytes=5_000)) == want  # many shards, many rounds
    assert spelling.spelling_variants(spelling.count_words(frame.limit(0))).count() == 0


def test_chains_of_forms_reach_their_roots(spark):
    words = {"aaaaaaaa": 10**5, "aaaaaaab": 10**4, "aaaaaabb": 10**3, "aaaaabbb": 100, "aaaabbbb": 10, "zzzzzzzz": 3, "zzzzzzzy": 30, "zzzzzzzx": 30}
    got = variant_rows(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_forms(words)
    assert {r[0]: r[5] for r in got}["aaaabbbb"] == "aaaaaaaa" and {r[0]: r[3] for r in got}["zzzzzzzz"] == "zzzzzzzx"


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), max_size=40), st.text("abé", min_size=1, max_size=6))
def test_trie_finds_each_neighbour_once(words, word):
    ordered = sorted(words)
    turned = sorted((w[::-1], i) for i, w in enumerate(ordered))
    ways = [spelling.build_trie(ordered, [i + 1 for i in range(len(ordered))]), spelling.build_trie([w for w, _ in turned], [i + 1 for _, i in turned])]
    tries = [spelling.Trie(t["first"].tobytes(), t["labels"], t["counts"].tobytes()) for t in ways]
    found = [(n, other.decode("latin-1")) for n, other in spelling.neighbours(*tries, word.encode("latin-1"))]

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert sorted(found) == sorted((i + 1, w) for i, w in enumerate(ordered) if near(w, word))


# Exact deduplication.
@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=600))
def test_cuckoo_index_is_a_counted_set(changes):
    index, want = CuckooIndex(4), Counter()
    for uid, (add, key) in enumerate(changes):
        digest = hashlib.sha256(str(key).encode()).digest()
        if add:
            index.insert(digest, 1, key % 7, uid)
            want[digest] += 1
        else:
            assert index.delete(digest) == (want[digest] > 0)
            want[digest] -= want[digest] > 0
    assert {e[0]: e[1] for e in index.entries()} == {d: n for d, n in want.items() if n} and index.size == len(+want)
    assert all((index.get(d) is not None) == (n > 0) for d, n in want.items())


def test_cuckoo_index_resizes_and_keeps_all():
    index = CuckooIndex(1)
    keys = [hashlib.sha256(bytes([i % 256, i >> 8])).digest() for i in range(5_000)]
    for i, key in enumerate(keys):
        index.insert(key, 1, i, i)
    assert index.size == 5_000 and index.n_buckets * 4 >= 5_000 and [index.get(k)[2] for k in keys] == list(range(5_000))
    same_print = [b"\x01\x00" + i.to_bytes(8, "little") + b"x" * 6 for i in range(64)]
    for i, key in enumerate(same_print):  # one fingerprint for all of them
        index.insert(key, 1, i, i)
    assert all(index.get(k)[2] == i for i, k in enumerate(same_print))


ROWS = [
    (2**60 + 1, "A"), (2**60 + 1, "a"), (None, "a"), (2**60, "a"), (None, None), (None, ""), (5, "x"), (None, "zz"), (7, "x"), (7, "x"), (8, "É"), (9, "é"), (10, "long " * 200_000), (11, "LONG " * 200_000),
]


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        staying = ids.index(keep)
        out += [(i, keep, len(ids), n == staying, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def group_rows(df):
    return sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in df.collect()), key=str)


def test_groups_of_edge_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "s") for r in ROWS], "doc_id long, text string, uid int, shard string")
    assert group_rows(exactdedup.exact_groups(docs)) == plain_groups(ROWS)
    kept = exactdedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({(t or "").translate(LOWER) for _, t in ROWS})
    assert exactdedup.exact_groups(docs.limit(0)).count() == 0 and exactdedup.keep_one(docs.limit(0)).count() == 0
    same_rows = docs.where("doc_id = 7").unionByName(docs.where("doc_id = 7")).drop("uid")
    assert exactdedup.keep_one(same_rows).count() == 1


def test_index_takes_rows_in_and_out(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows, n = exactdedup.digests(docs), 3
    first, second = rows.where("id < 8 OR id IS NULL"), rows.where("id >= 8")
    index = exactdedup.insert(exactdedup.insert(exactdedup.empty_index(rows), first, n), second, n)
    assert group_rows(exactdedup.probe(index, rows, n)) == plain_groups(ROWS)
    gone = rows.where(f"id IN (7, {2**60 + 1}, 8) OR id IS NULL")
    left = rows.join(gone.select("uid"), "uid", "left_anti")
    index = exactdedup.delete(index, gone, rows, n)
    assert group_rows(exactdedup.probe(index, left, n)) == plain_groups([(2**60, "a"), (5, "x"), (9, "é"), *ROWS[-2:]])
    assert exactdedup.probe(index, rows.where("id = 8"), n).count() == 0  # its digest has left the filter
    with pytest.raises(Exception, match="not in the index"):
        exactdedup.delete(index, rows.where("id = 8"), left, n)


def test_many_copies_are_probed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "PROBE_ROWS", 500)
    monkeypatch.setattr(exactdedup, "GATHERED", 50)
    docs = spark.range(6_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'Copy', 'text ' || id) AS text")
    found = exactdedup.exact_groups(docs)
    assert found.count() == 6_000 and found.where("kept").count() == 4_001
    assert {tuple(r) for r in found.where("id % 3 = 0").select("keep_id", "group_size").distinct().collect()} == {(5_997, 2_000)}


def test_query_of_groups_is_that_of_its_sql_with_ties(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    text = {c: "string" for c in ("doc_id", "keep_id")}  # pandas would round them
    found = exactdedup.op13_exact_dedup(spark, f"file://{tmp_path}")
    got = found.select(*[found[c].cast(text.get(c, kind)) for c, kind in found.dtypes]).toPandas()
    want = duck(exactdedup.ORACLE_SQL.replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')"))
    same(got, want.assign(**{c: want[c].astype("string") for c in text}))
