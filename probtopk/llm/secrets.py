"""Secret scans with corpus-wide ownership frequency.

A scan finds candidates: assignments to names such as `password`, access key
ids, and long hexadecimal runs (the base kinds), and long mixed tokens (kind
`token`). Every candidate value is hashed, and over the whole corpus the distinct
repositories and owners that hold the hash are counted. A value that many
owners share is a widely copied example; one that a single owner holds looks like a
live credential. A repository is a distinct text unless a column names it, so exact
copies of a page are one. Base spans are always reported with their verdict; a `token`
span is among the spans if its value belongs to one owner and is not copied over
many repositories, and among the copied tokens else.

Everything is DataFrame functions. Positions come from splitting a text at a
pattern: the pieces between the matches and the matches themselves add up to
the places of the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# What counts as a secret of each kind, (kind, pattern, group that holds the value, least length).
BASE_KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: A cheap pattern that every text with a valid match of the kind matches.
FILTERS = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
#: Mixed tokens: 20 or more characters with a digit, an upper-case and a lower-case letter.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
#: A value held by more owners, or more repositories, than these is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 1, 5

SPAN = "struct<kind_no:int,kind:string,start:int,end:int,value:string>"


def spans_of(text: Column, kind_no: int, kind: str, pattern: str, group: int, least: int, cheap: str) -> Column:
    """array<struct<kind_no, kind, start, end, value>> of leftmost non-overlapping matches whose value is long enough.

    start and end count code points, end is exclusive.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("piece"), matches.alias("hit"), values.alias("value"))
    none = F.array().cast(f"array<{SPAN}>")

    def put(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["piece"])
        end = start + F.length(s["hit"])
        span = F.struct(F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), s["value"].alias("value"))
        found = F.when(F.length(s["value"]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), put, lambda acc: acc["found"])
    return F.when(text.rlike(cheap), walked).otherwise(none)


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str | None, owner_col: str) -> DataFrame:
    """(id, th, repo, owner, base, tokens): spans of every whole text, ordered by start, then kind; null text has none."""
    text = common.text_or_empty(text_col)
    base = F.concat(*[spans_of(text, i, k, p, g, n, FILTERS[k]) for i, (k, p, g, n) in enumerate(BASE_KINDS)])
    ordered = F.array_sort(base, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind_no"] - b["kind_no"]))
    scanned = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
        (F.col(repo_col) if repo_col else F.xxhash64(text_col)).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"),
        ordered.alias("base"), spans_of(text, len(BASE_KINDS), "token", TOKEN, 0, 20, TOKEN).alias("tokens"),
    )
    # A token inside a base span is the same finding.
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return scanned.withColumn("tokens", apart)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, n_repositories, n_owners, example) over all candidates (value_hash, repo, owner).

    Pairs are made distinct before they are counted, so a value copied a million
    times is combined where it is read.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(""))  # noqa: E731  unknown repositories or owners are one
    pairs = candidates.groupBy("value_hash", some("repo").alias("repo"), some("owner").alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.groupBy("value_hash").agg(F.count_distinct("repo").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))
    return counts.withColumn("example", (F.col("n_owners") > MAX_OWNERS) | (F.col("n_repositories") > MAX_REPOSITORIES))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source") -> DataFrame:
    """One row per row: id, base (array of spans), spans (array of spans with verdict `live` or `example`) and copied (token spans that are examples).

    Null text is empty and has no spans. Rows that repeat id and text get the same
    spans; without `repo_col` each distinct text counts as one repository. Unknown owners are one owner. An empty table gives no
    rows. Columns other than the named ones are ignored.
    """
    scanned = common.materialize(scan(docs, id_col, text_col, repo_col, owner_col), "secret-scan")
    each = scanned.select("id", "th", "repo", "owner", F.explode(F.concat("base", "tokens")).alias("s"))
    each = each.select("id", "th", "repo", "owner", "s", F.sha2("s.value", 256).alias("value_hash"))
    verdicts = common.materialize(ownership(each).select("value_hash", "example"), "secret-verdicts")
    copied = lambda s: (s["kind"] == "token") & s["example"]
    judged = common.lookup(each, verdicts, "value_hash").groupBy("id", "th").agg(
        F.array_sort(F.collect_set(F.struct("s.start", "s.kind_no", "s.kind", "s.end", "example"))).alias("all")
    )
    found = judged.select(
        F.col("id").alias("f_id"), F.col("th").alias("f_th"), F.filter("all", lambda s: ~copied(s)).alias("spans"), F.filter("all", copied).alias("copied")
    )
    joined = scanned.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,example:boolean>>")
    return joined.select(F.col("id").alias(id_col), "base", *[F.coalesce(c, empty).alias(c) for c in ("spans", "copied")])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents. Null and empty texts have none, very long ones are scanned whole, repeated rows get a row each, an unknown source is one owner."""
    found = find_secrets(common.documents(spark, sf_dir))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k, *_ in BASE_KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), listed(F.col("copied")).alias("copied_tokens"),
        F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_example"),
    )
