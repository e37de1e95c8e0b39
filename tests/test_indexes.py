"""Stems, the full-text index and the vector index against plain Python."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.functions import stems as S
from docketry.operators import fulltext as X
from docketry.operators import vector_index as I
from docketry.plans import registry

# Published pairs of words and stems.
ENGLISH = (
    "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consolation consol consolatory consolatori "
    "console consol consolidate consolid consolidating consolid consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knag knag "
    "knavish knavish kneeling kneel knees knee knightly knight knitted knit knives knive knocker knocker knots knot generate generat generic generic happy happi cries cri tied tie gas gas gaps gap kiwis kiwi hopping hop hoped hope sized size "
    "falling fall agreed agre by by say say enjoy enjoy relational relat conditional condit vileness vile electricity electr hopeful hope goodness good adoption adopt youth youth dying die succeed succeed inning inning communities communiti"
).split()
RUSSIAN = (
    "в в вавиловка вавиловк вагнера вагнер вагон вагон вагонов вагон вагоном вагон важная важн важнее важн важнейшие важн важничал важнича важно важн важного важн важности важност важность важност важных важн вами вам вашу ваш "
    "вдохновение вдохновен п п павел павел падаль падал падает пада падать пада падение паден падут падут падучая падуч падшая падш падшей падш пакостей пакост палец палец палкой палк пальто пальт"
).split()


@pytest.mark.parametrize(("rules", "pairs"), [(S.english, ENGLISH), (S.russian, RUSSIAN)])
def test_stems(spark, rules, pairs):
    rows = list(zip(pairs[::2], pairs[1::2]))
    got = spark.createDataFrame(rows, "word string, stem string").select("word", "stem", rules(F.col("word")).alias("got")).collect()
    assert [(r.word, r.got) for r in got if r.got != r.stem] == []


def test_stop_words_and_mixed_scripts(spark):
    rows = spark.createDataFrame([("the",), ("hands",), ("вагонов",), ("что",), ("2024",)], "w string")
    got = {r.w: (r.e, r.r, r.s) for r in rows.select("w", S.stem(F.col("w"), "english").alias("e"), S.stem(F.col("w"), "russian").alias("r"), S.stem(F.col("w"), "simple").alias("s")).collect()}
    assert got["the"] == (None, None, "the") and got["hands"] == ("hand", "hand", "hands") and got["вагонов"][1] == "вагон" and got["что"][1] is None and got["2024"] == ("2024",) * 3
    with pytest.raises(ValueError):
        S.stem(F.col("w"), "none")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    words = [a + b for a in ("term", "court", "claim", "pay", "law") for b in ("", "s", "ing", "ed")] + ["the", "of", "X1"]
    out = {i: " ".join(r.choices(words, weights=range(1, len(words) + 1), k=r.randint(0, 60))) for i in range(700)}
    return out | {900: "laws " * 400, 901: None, 902: "", 903: "Claims, of: the... COURT!", 904: "claiming the courts of claims of courts"}


@pytest.fixture(scope="module")
def index(spark, texts):
    rows = [*texts.items(), (None, "laws of courts")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # several parts for a small table
    try:
        return X.build(spark.createDataFrame(rows, "id bigint, body string"), "id", "body", "english")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(texts, *stems):
    own = {i: [re.sub("(s|ing|ed)$", "", w) for w in re.findall("[a-z0-9]+", (t or "").lower())] for i, t in texts.items()}
    return {i: sum(w.count(s) for s in stems) for i, w in own.items() if all(s in w for s in stems)}


def test_search(spark, index, texts):
    for query, stems in (("law", ["law"]), ("the claiming of COURTS", ["claim", "court"]), ("terms, pays; laws", ["term", "pay", "law"])):
        wanted = plain(texts, *stems)
        assert {r.doc: r.score for r in X.search(index, query).collect()} == wanted
        for k in (1, 7, 50, 5000):
            best = sorted(wanted.items(), key=lambda x: (-x[1], x[0]))[:k]
            assert [(r.doc, r.score) for r in X.search(index, query, k).collect()] == best, (query, k)
    for nothing in ("", "the", "nowhere", "law nowhere"):
        assert X.search(index, nothing).count() == 0 and X.search(index, nothing, 3).count() == 0
    frame = spark.createDataFrame(list(texts.items()), "id bigint, body string")
    assert {r.id for r in frame.where(X.matches(F.col("body"), ["claim", "court"], "english")).collect()} == set(plain(texts, "claim", "court"))


def test_phrase_and_plan(index, texts):
    got = {r.doc: r.n for r in X.phrase(index, "claim the courts").collect()}
    hits = lambda t: len(re.findall(r"(?=\bclaim(?:s|ing|ed)?\W+\w+\W+court(?:s|ing|ed)?\b)", (t or "").lower()))
    assert got == {i: hits(t) for i, t in texts.items() if hits(t)}
    blocks = index.blocks.agg(F.max("n"), F.sum("n")).first()
    assert blocks[0] <= X.BLOCK and blocks[1] == index.terms.agg(F.sum("docs")).first()[0]
    parts = index.terms.where("term = 'court'").first().parts
    plan = X._found(index, ["court"])[1]._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(parts) < index.blocks.select("part").distinct().count() and re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def test_rows_moved_by_an_index(spark, monkeypatch):
    """Words move once for a segment and not once for a text; keys with several texts, and segments of few bytes."""
    rows = [(i % 300, f"hands of thing{'s' * (i % 2)} handed things " * (1 + i % 3)) for i in range(600)] + [(7, "hand"), (None, "hand")]
    frame, moved = spark.createDataFrame(rows, "id bigint, body string").repartition(5), []
    real = type(frame).repartitionByRange
    monkeypatch.setattr(type(frame), "repartitionByRange", lambda self, *columns: moved.append(self) or real(self, *columns))
    whole = X.build(frame, "id", "body", "english")
    assert next(m for m in moved if "term" in m.columns).count() <= 4 * 4  # words of four parts
    monkeypatch.setattr(X, "SEGMENT", 100)
    for index in (whole, X.build(frame, "id", "body", "english")):
        held = {(r.term, r.doc): r.places for r in X._postings(index.blocks).collect()}
        wanted = {(t, i): sorted(n for j, text in rows if i == j for n, w in enumerate(text.split()) if w.startswith(t)) for i in range(300) for t in ("hand", "thing")}
        assert held == wanted and index.blocks.agg(F.sum("n")).first()[0] == len(held)


def test_words_that_no_rule_changes():
    """A word is spared the rules only if it has none of their endings."""
    assert all(any(e.endswith(c) for c in S.CHANGED) for e in (*S.STEP_2, *S.STEP_3, *S.STEP_4, "sses", "ied", "ies", "s", "eed", "eedly", "ing", "ingly", "ed", "edly", "y", "e", "ll"))


@pytest.mark.parametrize("name", ["flt9_word_forms", "flt9_best_matches", "flt9_phrase"])
def test_forms_that_a_query_lists(spark, tmp_path, name):
    """Words that the rules, but not the query's SQL, take for a form of its words count as words of their own."""
    registry.load()
    odd = ["handlyed thing", "handful of things", "hands thingful", "handed thingings things handlying", "hand thinglyed", "handing things handnesses", "public licenses", "publicly licensed publics licensing", "public licenser license", "the", ""]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, "thinglys " * i + "thing " * (30 - i)) for i in range(30)] + [(200, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(registry.ORACLES[name]).fetchall()
    assert wanted and sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(wanted)


def test_forms_and_stop_words(spark):
    rows = spark.createDataFrame([(w,) for w in ("the", "hands", "handful", "licens", "courts")], "w string")
    forms = {"hand": "hand(s|ed)?", "licens": "licens(e|es)", "the": "the"}
    assert [r.t for r in rows.select(S.stem(F.col("w"), "english", forms).alias("t")).collect()] == [None, "hand", "=handful", "licen", "court"]
    index = X.build(spark.createDataFrame([(1, "handful hands"), (2, "handfuls handed hand")], "id bigint, body string"), "id", "body", "english", forms=forms)
    assert [sorted((r.doc, r.score) for r in X.search(index, q).collect()) for q in ("hand", "handful", "handfuls")] == [[(1, 1), (2, 2)], [(1, 1)], [(2, 1)]]
    frame = spark.createDataFrame([(1, "handful"), (2, "hands")], "id bigint, body string")
    assert [r.id for r in frame.where(X.matches(F.col("body"), ["hand"], "english", forms)).collect()] == [2]


def test_empty_index(spark):
    empty = X.build(spark.createDataFrame([(None, "a"), (1, None)], "id bigint, body string"), "id", "body")
    assert X.search(empty, "a").count() == 0 and X.search(empty, "a", 2).count() == 0


def nearest(vectors, queries, k):
    out = {}
    for i, q in queries.items():
        sims = [(-round(float(np.dot(v, q) / n), 6) if (n := np.linalg.norm(v) * np.linalg.norm(q)) else 0.0, j) for j, v in vectors.items()]
        out[i] = [j for _, j in sorted(sims)[:k]]
    return out


def test_vector_index(spark, sf):
    """Exact mode is brute force; by codes, nine of ten are found; every valid vector is in the index, others are not."""
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    odd = [(9001, None), (9002, [1.0] * 63), (9003, [float("nan")] * 64), (9004, [None] * 64), (None, [1.0] * 64), (9005, [0.0] * 64)]
    frame = spark.createDataFrame(rows + odd + [(8000 + i, rows[0][1]) for i in range(30)], "vec_id bigint, embedding array<double>")
    index = I.build(frame, "vec_id", "embedding", lists=24)
    held = {r.key for r in index.vectors.select("key").collect()}
    assert held == {i for i, _ in rows} | {9005, *range(8000, 8030)} == {k for r in index.codes.select("keys").collect() for k in r["keys"]}
    vectors = {i: np.array(v) for i, v in rows} | {9005: np.zeros(64)} | {8000 + i: np.array(rows[0][1]) for i in range(30)}
    asked = frame.where("vec_id % 20 = 0")
    wanted = nearest(vectors, {i: v for i, v in vectors.items() if i % 20 == 0}, 10)
    exact = I.search(index, asked, 10, exact=True).collect()
    assert {i: [r.key for r in sorted((r for r in exact if r.qkey == i), key=lambda r: r.rank)] for i in wanted} == wanted
    found = {(r.qkey, r.key) for r in I.search(index, asked, 10, probes=16).collect()}
    pairs = {(i, j) for i, js in wanted.items() for j in js}
    assert len(found & pairs) >= 0.9 * len(pairs)
    empty = I.build(frame.limit(0), "vec_id", "embedding")
    assert I.search(empty, asked, 3).count() == 0


def test_registered_search_recall(spark, sf):
    from docketry.plans import index as plans

    exact = {(r.qkey, r.key) for r in plans.index_exact(spark, sf).collect()}
    assert len(exact & {(r.qkey, r.key) for r in plans.index_search(spark, sf).collect()}) >= 0.9 * len(exact)


def test_index_pipeline(spark, sf):
    """Every chunk of the searched sections, by a plain walk over the words, with a vector."""
    from docketry.plans import index as plans

    wanted = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang in ('en', 'de')").collect():
        chunks, now, size = [], [], 0
        for word in re.split(r"[ \t\n\x0b\f\r]+", r.text):
            if now and size + len(word) + 1 > 2048:
                chunks.append(" ".join(now))
                now = now[-50:]
                size = len(" ".join(now))
            now.append(word)
            size += len(word) + 1
        chunks.append(" ".join(now))
        wanted |= {(r.doc_id, "DECISION" if r.lang == "en" else "COURT_REASONING", n, hashlib.sha256(c.encode()).hexdigest(), 64) for n, c in enumerate(chunks)}
    rows = [tuple(r) for r in plans.index_pipeline(spark, sf).collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted


def test_effective_rate_of_a_hot_key(spark):
    """Rates that overlap, are open or begin on one day, entries of one key over years, and entries without key or date."""
    import datetime

    from docketry.operators import relational as R

    r, day = random.Random(8), datetime.date(2020, 1, 1)
    at = lambda n: day + datetime.timedelta(days=n)
    rates = [(r.choice("ab"), at(a := r.randint(0, 2000)), None if r.random() < 0.3 else at(a + r.randint(-5, 900)), r.randint(1, 99)) for _ in range(60)] + [("a", None, None, 5)]
    entries = [(i, r.choice("aaaaabc") if i % 50 else None, at(r.randint(-30, 3000)) if i % 41 else None, 7 if i % 3 else None) for i in range(900)]
    got = {x.i: x.rate for x in R.effective_rate(spark.createDataFrame(entries, "i int, k string, d date, own int"), spark.createDataFrame(rates, "k string, effective_from date, effective_to date, rate int"), "k", "d", "own").collect()}
    assert len(got) == len(entries)
    for i, k, d, own in entries:
        valid = [(a, v) for key, a, b, v in rates if key == k and a is not None and d is not None and a <= d and (b is None or d <= b)]
        assert got[i] == (max(valid)[1] if valid else own or 0), i
