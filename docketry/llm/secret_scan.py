"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by regular expressions in each text; the hashes of their values are counted over
distinct texts and owners of the whole corpus. A value that many owners have in many texts is an example
that was copied about; one that looks random is live with a single owner and shared with more, and both
kinds are masked.

What ownership tells adds spans of the kind ``bare``: a live or shared value that stands alone somewhere
else in the corpus, without the name that gave it away, is found by its hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.common import fresh, materialize, quoted, text_key


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api"))) + "_?" + _any_case("key")
#: kind: (pattern, group of the value, least length of the value); the order breaks ties of place.
KINDS = {
    "assign": (rf"({_NAMES})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
_PART = "A-Za-z0-9+/_.=-"
#: Whole runs of a value's signs, with a digit and a letter, without dots at the end: where a known value may stand alone.
BARE = (rf"(?<![{_PART}])(?=[A-Za-z+/_.=-]*+[0-9])(?=[0-9+/_.=-]*+[A-Za-z])[{_PART}]{{7,}}[A-Za-z0-9+/_=-]", 0, 8)
#: Values of so many owners, in so many distinct texts, are examples.
MIN_OWNERS = 3
MIN_REPOSITORIES = 3
#: Values that hold one of these words in any case are placeholders.
PLACEHOLDERS = "(?i)example|changeme|dummy|placeholder|xxxx|your_"


def _matches(kind: str) -> Column:
    """gap (length before the match), size, value of each match, the failing ones too; lengths in code points."""
    pattern, group, _ = (KINDS | {"bare": BARE})[kind]
    text = F.col("text")
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"), F.split(text, pattern, -1).alias("g"))
    rows = F.transform(zipped, lambda z: F.struct(F.lit(kind).alias("kind"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("size"), F.length(z["v"]).alias("value_size"), F.sha2(z["v"], 256).alias("hash"), F.sha2(F.rtrim(z["v"], F.lit(".")), 256).alias("core"), _looks_random(z["v"], kind).alias("random"), z["m"].isNotNull().alias("real")))
    return F.when(text.rlike(pattern), F.filter(rows, lambda r: r["real"])).otherwise(F.filter(rows, lambda r: F.lit(False)))


def _looks_random(value: Column, kind: str) -> Column:
    """Letters and digits mixed (a key known by its form needs no digit), at least six characters that differ, and no placeholder."""
    mixed = F.lit(True) if kind == "access" else value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= 6) & ~value.rlike(PLACEHOLDERS)


def candidates(docs: DataFrame, owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row id for each input row, and every span with its place, hash and owner.

    Null texts count as empty, null owners as one owner. Spans of a kind do not overlap; other kinds may.
    Spans of the kind bare are runs that look random; ``alone`` says which of them are secrets.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    found = texts.select("doc_id", text_key().alias("text_key"), "owner", F.monotonically_increasing_id().alias("row"), F.concat(*map(_matches, KINDS), _matches("bare")).alias("found"))
    rows = materialize(found)  # the row ids and the work of the patterns are kept here
    each = rows.select("doc_id", "text_key", "owner", "row", F.posexplode("found").alias("n", "f")).select("doc_id", "text_key", "owner", "row", "n", "f.*")
    before = W.partitionBy("row", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    least = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS[k][2]), KINDS, F.when((F.col("kind") == "bare") & F.col("random"), BARE[2]))
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    return rows.select("doc_id", "row"), placed.where(F.col("value_size") >= least).drop("gap", "size", "n")


def classified(spans: DataFrame, min_owners: int = MIN_OWNERS) -> DataFrame:
    """The spans that are not bare, with n_repositories (distinct texts), n_owners and class: example (does not look random, or widely copied), live or shared."""
    spans = spans.where("kind <> 'bare'")
    # first to distinct owners and texts, then to counts: a hash that everyone has meets partial sums only
    owners = spans.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    texts = spans.select("hash", "text_key").distinct().groupBy("hash").agg(F.count("*").alias("n_repositories"))
    known = spans.join(owners, "hash").join(texts, "hash")
    named = F.when((F.col("n_owners") >= min_owners) & (F.col("n_repositories") >= MIN_REPOSITORIES), "example").when(~F.col("random"), "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    return known.withColumn("class", named)


def alone(spans: DataFrame, known: DataFrame) -> DataFrame:
    """The bare spans whose value is live or shared in ``known``, dots at its end aside, with what is known of the value."""
    values = known.where("class <> 'example'").groupBy("core").agg(*(F.max(c).alias(c) for c in ("n_owners", "n_repositories", "class")))
    return spans.where("kind = 'bare'").join(values, "core")


def _without_met(spans: DataFrame) -> DataFrame:
    """Drops bare spans that meet another kind's span of their row: in order of start, one that has not ended or one that begins too early."""
    order = W.partitionBy("row").orderBy("start", F.col("kind") == "bare")
    base = F.col("kind") != "bare"
    open_until = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    begins_at = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, W.unboundedFollowing))
    met = (F.coalesce(open_until, F.lit(0)) > F.col("start")) | F.coalesce(begins_at < F.col("end"), F.lit(False))
    return spans.withColumn("met", met).where(base | ~F.col("met")).drop("met")


def scan(docs: DataFrame, owner: str = "source", min_owners: int = MIN_OWNERS) -> DataFrame:
    """A row for each input row: doc_id and its spans in order (start, kind, end, hash, n_repositories, n_owners, class).

    A bare span has its value's class and is left out where another kind's span covers a sign of it.
    Repeated and null doc_ids keep a row each; texts without a span have an empty list; columns other
    than doc_id, text and the owner are not read.
    """
    rows, spans = candidates(docs, owner)
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, list(KINDS).index(k)), KINDS, F.when(F.col("kind") == "bare", len(KINDS)))
    known = classified(spans, min_owners)
    held = _without_met(known.unionByName(alone(spans, known))).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "hash", "n_repositories", "n_owners", "class"))).alias("spans"))
    return rows.join(held, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(held.schema["spans"].dataType)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, and by class of the spans that are not bare; all spans as text, and the sha256 of those that are not bare."""
    base = F.filter("spans", lambda s: s["kind"] != "bare")
    count = lambda field, name, spans=base: F.size(F.filter(spans, lambda s: s[field] == name)).cast("bigint")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    classes = (count("class", c).alias(f"n_{c}") for c in ("live", "shared", "example"))
    return scanned.select("doc_id", *(count("kind", k).alias(f"n_{k}") for k in KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), *classes, count("kind", "bare", F.col("spans")).alias("n_bare"))


def redacted(docs: DataFrame, owner: str = "source", min_owners: int = MIN_OWNERS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the values of live and shared secrets replaced in text, those that stand alone too; all columns and rows stay.

    A row is matched to its secrets by doc_id and a hash of its text, so repeated doc_ids do no harm.
    """
    _, spans = candidates(docs, owner)
    key, doc, other, hashes = fresh(docs, "_key", "_doc", "_text", "_live")
    known = classified(spans, min_owners)
    found = known.where("class <> 'example'").unionByName(alone(spans, known))
    live = found.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(other)).agg(F.collect_set("hash").alias(hashes))
    keyed = docs.withColumn(key, text_key())
    met = keyed.join(live, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(other)), "left")
    text = F.col("text")
    for pattern, group, _ in (*KINDS.values(), BARE):
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
        put = F.transform(zipped, lambda z: F.concat(z["g"], F.when(z["m"].isNull(), "").when(F.array_contains(hashes, F.sha2(z["v"], 256)), F.concat(F.substring(z["m"], F.lit(1), F.length(z["m"]) - F.length(z["v"])), F.lit(mark))).otherwise(z["m"])))
        met = met.withColumn("text", F.when(F.col(hashes).isNotNull() & text.rlike(pattern), F.array_join(put, "")).otherwise(text))
    return met.select(*map(quoted, docs.columns))
