"""Functions over legal texts, money and dates on hand-built rows."""

import re
import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import legal as L
from docketry.functions import money as M
from docketry.functions.sections import sections, sections_of
from docketry.operators import graphs as G
from docketry.operators import relational as R
from docketry.operators import vectors as V


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,wanted", [("ст. 625 ЦК", ("435-15", "625")), ("ст. 44 ПКУ", ("2755-17", "44")), ("1618-15 ст. 354", ("1618-15", "354")), ("hello world", None), ("ГПК ст. 123", ("1798-12", "123")), ("стаття 10 Цивільного кодексу", ("435-15", "10")), (None, None), ("", None)])
def test_law_reference(spark, text, wanted):
    got = one(spark, text, L.law_reference)
    assert (got and tuple(got)) == wanted


@pytest.mark.parametrize("text,wanted", [("Позов задовольнити частково", "partial"), ("задовольнити", "allowed"), ("у позові відмовити", "denied"), ("рішення скасувати, справу направити", "remand"), ("скасувати", "cancelled"), ("інше", None), (None, None)])
def test_outcome(spark, text, wanted):
    assert one(spark, text, L.outcome) == wanted


def test_instances(spark):
    rows = [("", "Велика Палата", ""), ("", "Касаційний цивільний суд", ""), ("", "касаційний кримінальний суд", ""), ("Верховний Суд", "", ""), ("Київський апеляційний суд", None, None), ("Окружний", "", ""), (None, None, "касаційна скарга"), (None, None, None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, h string, t string").orderBy("i").select(L.instance(F.col("c"), F.col("h"), F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["Велика Палата ВС", "Касація (КЦС ВС)", "Касація (ККС ВС)", "Касація", "Апеляція", "Перша інстанція", "Касація", "Невідомо"]


def test_case_numbers(spark):
    assert one(spark, "у справі № 757/12345/23-ц від", L.case_number) == "757/12345/23-ц"
    assert one(spark, "757/12345/23-ц", L.case_number_variations) == ["757/12345/23-ц", "757/12345/2023-ц", "757/12345/23", "757/12345/2023"]
    assert one(spark, "1/2/1998", L.case_number_variations) == ["1/2/1998", "1/2/98"]


def test_texts(spark):
    assert one(spark, "Ст. 5, ст.  6 і СТ. 5", L.law_articles) == ["Ст. 5", "ст. 6", "СТ. 5"]
    assert one(spark, "a" * 950, lambda t: F.transform(L.fixed_chunks(t), lambda c: F.length(c["chunk"]))) == [500, 500, 150]
    assert one(spark, "", L.fixed_chunks) == []
    assert one(spark, "x" * 400 + "Needle" + "y" * 400, lambda t: L.snippets(t, "needle")) == ["…" + "x" * 160 + "Needle" + "y" * 160 + "…"]
    assert one(spark, "a  b\n needle   c", lambda t: L.snippets(t, "NEEDLE")) == ["a b needle c"]
    assert one(spark, "a" * 450, lambda t: F.size(L.fixed_chunks(t))) == 1
    assert one(spark, "a.b a.b axb", lambda t: L.occurrences(t, "A.B")) == 2
    assert one(spark, "Released under the MIT License", lambda t: L.has_all_words(t, "license, mit")) is True
    assert one(spark, "суд відступає від висновку", L.citation_type) == "distinguishes" and one(spark, "рішення скасовано", L.citation_type) == "overrules"
    assert one(spark, "Сплата 100 грн", L.change_importance) == "critical" and one(spark, "право " * 12, L.change_importance) == "significant" and one(spark, "право", L.change_importance) == "minor"
    assert one(spark, "What is the  Строк за ЦК?!", L.normal_question) == "what is строк за цивільний кодекс"
    assert [tuple(x) for x in one(spark, "a12 b3", lambda t: L.places(t, "[0-9]+"))] == [("12", 1), ("3", 5)] and one(spark, "x" * 150 + "y" * 150, lambda t: L.around(t, F.lit(150))) == "x" * 100 + "y" * 100
    assert tuple(one(spark, "ст. 5 закону про мобілізацію", L.law_reference)) == ("3543-12", "5")
    assert one(spark, "Why?  Because ", L.question_key) == one(spark, "why? because", L.question_key)
    assert one(spark, "Сума 500 грн", L.change_importance) == "critical"


def test_sections(spark):
    text = "Суд встановив, що " + "обставини справи такі. " * 20 + "\n\nСуд вважає, що " + "позов обґрунтований. " * 20 + "\n\nСуд ухвалив: стягнути кошти " + "повністю " * 20
    found = sections_of(text)
    assert [s["type"] for s in found][:1] == ["FACTS"] and "DECISION" in {s["type"] for s in found}
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))
    assert sections_of(None) == [] and sections_of("") == []
    assert [r["start"] for r in one(spark, text, sections)] == [s["start"] for s in found]


def test_money(spark):
    row = spark.createDataFrame([(20, 100.0, 1000.0, 365, "business", 15001)], "m int, rate double, amount double, days int, tier string, n int").select(
        M.line_amount(F.col("m"), F.col("rate")).alias("line"), M.annual_claim(F.col("amount"), F.col("days")).alias("claim"), M.tier_price(F.col("amount"), F.col("tier")).alias("price"),
        M.step_price(F.col("n")).alias("step"), M.credits(F.lit(0.001)).alias("credits"), M.volume_discount(F.lit(500)).alias("off"),
        M.deadline(F.lit("2024-01-31").cast("date"), F.lit("cpc"), F.lit("appeal"), F.lit("decision")).alias("due"), M.deadline(F.lit("2024-01-31").cast("date"), F.lit("x"), F.lit("appeal"), F.lit("decision")).alias("none"),
    ).first()
    assert (row.line, row.claim, row.price, row.step, row.credits, row.off) == (decimal.Decimal("33.00"), 30, 1500, decimal.Decimal("0.00690"), 1, 10)
    assert row.due == datetime.date(2024, 3, 1) and row.none is None
    assert [one(spark, t, M.parse_date) for t in ("05.02.2024", "2024-02-05", "05022024", "nonsense", "31.02.2024")] == [datetime.date(2024, 2, 5)] * 3 + [None] * 2


def test_effective_rate(spark):
    rates = spark.createDataFrame([("a", 1, 5, 10.0), ("a", 6, None, 20.0), ("a", 3, 4, 15.0)], "k string, effective_from int, effective_to int, rate double")
    entries = spark.createDataFrame([(i, "a") for i in (0, 1, 3, 5, 6, 99)] + [(7, "b")], "at int, k string")
    assert {(r.at, r.k): r.rate for r in R.effective_rate(entries, rates, "k", "at").collect()} == {(0, "a"): 0, (1, "a"): 10, (3, "a"): 15, (5, "a"): 10, (6, "a"): 20, (99, "a"): 20, (7, "b"): 0}


def test_effective_rate_brute_force(spark):
    """Spans of every length, overlapping, reversed, open and tied; entries without key or date; one key with most rows."""
    rng = random.Random(5)
    base = datetime.date(1990, 1, 1)
    day = lambda n: base + datetime.timedelta(days=n)
    rates = []
    for i in range(300):
        start = rng.randrange(12000)
        end = None if i % 7 == 0 else day(start + rng.choice([-3, 0, 1, 31, 32, 33, 500, 1023, 1024, 5000]))
        rates.append((rng.choice("aaab"), day(start), end, float(i)))
    rates += [("a", None, None, 9999.0), (None, day(0), None, 9999.0), ("b", datetime.date(1, 1, 1), datetime.date(9999, 12, 31), 0.5), ("a", rates[0][1], rates[0][2], -1.0)]
    entries = [(i, rng.choice("aaab"), day(rng.randrange(-100, 13000)), 7.0) for i in range(500)] + [(500, None, day(5), 7.0), (501, "a", None, 7.0), (502, "c", day(5), None), (503, "c", day(5), 7.0), (503, "c", day(5), 7.0)]
    got = R.effective_rate(spark.createDataFrame(entries, "i int, k string, at date, own double"), spark.createDataFrame(rates, "k string, effective_from date, effective_to date, rate double"), "k", "at", "own")

    def wanted(k, at, own):
        held = [(f, r) for key, f, t, r in rates if k is not None and at is not None and key == k and f is not None and f <= at and (t is None or t >= at)]
        return max(held)[1] if held else own if own is not None else 0.0

    assert got.columns == ["i", "k", "at", "own", "rate"]
    assert sorted((r.i, r.rate) for r in got.collect()) == sorted((i, wanted(k, at, own)) for i, k, at, own in entries)


def test_imported(spark):
    """Children of entities that came are replaced, also by none; others and entities without a record stay."""
    frame = lambda rows: spark.createDataFrame(rows, "record string, name string")
    old = {"main": frame([("1", "a"), ("2", "b"), (None, "n")]), "founders": frame([("1", "x"), ("1", "y"), ("2", "z")]), "signers": frame([("1", "s"), ("2", "t")])}
    new = {"main": frame([("1", "A"), ("3", "C"), (None, "m")]), "founders": frame([("1", "q"), ("3", "r")])}
    after = {k: sorted(map(tuple, v.collect()), key=str) for k, v in R.imported(old, new, "record").items()}
    assert after == {"main": sorted([("1", "A"), ("2", "b"), ("3", "C"), (None, "n"), (None, "m")], key=str), "founders": [("1", "q"), ("2", "z"), ("3", "r")], "signers": [("2", "t")]}


def test_containing(spark):
    """Needles of several words, with punctuation, of parts of words and of one or two characters, against brute force."""
    texts = [(1, "O'Neil & Sons, Ltd."), (2, "Spring water"), (3, "ring road"), (3, "ring road"), (4, "\U0001f600\u00c9lan vital"), (5, None), (6, ""), (7, "a"), (8, "Sons of spring"), (9, "ring, road"), (10, "ringing ringing")]
    needles = ["Ring", "O'NEIL & sons", "ring road", "sons,", "pri", "a", "ng", "\U0001f600\u00e9", "\u00e9lan v", "zzz", "spring water works", " ", "ring", None, "", "100%", "_"]
    got = R.containing(spark.createDataFrame(texts, "id int, body string"), "body", spark.createDataFrame([(n,) for n in needles], "needle string"), "needle")
    wanted = [(i, t, n) for i, t in texts for n in needles if t is not None and n and n.lower() in t.lower()]
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and got.columns == ["id", "body", "needle"]
    assert R.containing(got.select("id", "body"), "body", got.select("needle").limit(0), "needle").count() == 0


def test_chain(spark):
    import hashlib

    rows, previous = [], "GENESIS"
    for i in range(20):
        current = hashlib.sha256(f"{previous}c{i}".encode()).hexdigest()
        rows.append((i, f"c{i}", previous, current))
        previous = current
    check = lambda r: R.check_chain(spark.createDataFrame(r, "i int, c string, p string, h string"), ["i"], F.col("c"), "p", "h").first()
    assert tuple(check(rows)) == (20, True, None)
    rows[7] = (7, "edited", *rows[7][2:])
    assert tuple(check(rows)) == (20, False, 8)


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "z")], "k int, v string, w string")
    assert sorted(map(tuple, R.upsert(old, new, ["k"], keep_if_null=("v",)).collect())) == [(1, "a", "x"), (2, "b", None), (3, "c", "z")]
    assert {r.k: r.state for r in R.changes(old, new, "k", ["v", "w"]).collect()} == {1: "gone", 2: "changed", 3: "new"}


def test_graphs_and_vectors(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "a int, b int")
    assert {r.node: r.distance for r in G.neighbourhood(edges, spark.createDataFrame([(1,)], "node int"), 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [2.0, 2.0])], "vec_id int, embedding array<float>")
    assert [(r.vec_id, r.similarity) for r in V.nearest(v, [1.0, 0.0], 3).collect()] == [(1, 1.0), (4, 0.707107), (2, 0.0)]


def test_word_chunks(spark):
    """Chunks of whole words against a plain loop."""
    import random

    def plain(text, most, overlap):
        out, now, size = [], [], 0
        for w in re.split(r"\s+", text):
            if size + len(w) + 1 > most and now:
                out.append(" ".join(now))
                now = now[-overlap:]
                size = len(" ".join(now))
            now.append(w)
            size += len(w) + 1
        return [*out, " ".join(now)]

    r = random.Random(1)
    for text in ("", "one", " ".join("x" * r.randint(1, 12) for _ in range(400)), "y" * 300 + " z " * 40):
        for most, overlap in ((100, 5), (60, 3), (2048, 50)):
            assert one(spark, text, lambda t: L.word_chunks(t, most, overlap)) == plain(text, most, overlap)


def test_sections_go_pattern_by_pattern():
    text = "відповідно до " + "а" * 120 + " суд вважає " + "б" * 120 + " встановив " + "в" * 30
    assert [(s["type"], s["start"]) for s in sections_of(text)] == [("LAW_REFERENCES", 0), ("COURT_REASONING", 135), ("FACTS", 267)]


def test_word_changes(spark):
    """The old text with its deletions taken out and the additions put in is the new one."""
    pairs = [("Сплата 100 грн до 01.02.2024", "Сплата 200 грн"), ("", "new words here"), ("same text", "same text"), ("a b c d", "d c b a"), ("x", None)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, old string, new string").select("i", "old", "new", L.word_changes(F.col("old"), F.col("new")).alias("c")).collect()
    for r in rows:
        mixed, at = [], 0
        old = r.old
        for c in r.c:
            gap = c["place"] - at
            mixed.append(old[:gap])
            old, at = old[gap:], at + gap
            if c["kind"] == "deletion":
                assert old.startswith(c["text"])
                old = old[len(c["text"]) :]
            else:
                mixed.append(c["text"])
            at += len(c["text"])
        assert "".join(mixed) + old == (r.new or "")


def test_tools(spark):
    from docketry.plans.fixtures import ARTICLES, DECISIONS, MEMBERS, NUMBERS, QUESTIONS, VOTES
    from docketry.tools import TOOLS

    assert len(TOOLS) >= 45
    status = {r.number: r.status for r in TOOLS["check_precedent_status"](NUMBERS.patterns(spark), DECISIONS.patterns(spark)).collect()}
    assert status["757/123/23-ц"] == "explicitly_overruled" and status["1/1/2001"] == "unknown"
    assert TOOLS["classify_intent"](QUESTIONS.patterns(spark)).where("intent.intent = 'tax_dispute'").count() == 1
    assert [r.article_number for r in TOOLS["search_legislation"](ARTICLES.patterns(spark), "Строк", 1).collect()] == ["10"]
    assert {r.member_id for r in TOOLS["get_deputy_info"](MEMBERS.patterns(spark), faction="ОПЗЖ").collect()} == {"8", "9"}
    assert TOOLS["analyze_voting_record"](VOTES.patterns(spark), "7").first().voted_for == 2
    found = TOOLS["get_legislation_article"](ARTICLES.patterns(spark), spark.createDataFrame([("ст. 354 ЦК",), ("none",)], "reference string")).collect()
    assert [(r.rada_id, r.article_number) for r in found] == [("435-15", "354")]
    firms = {"firm": spark.createDataFrame([(1, "Alpha"), (2, "Beta")], "record int, name string"), "person": spark.createDataFrame([(3, "alpha")], "record int, name string")}
    assert [(r.kind, r.record) for r in TOOLS["search_entities"](firms, ["name"], "ALPHA").collect()] == [("firm", 1), ("person", 3)]
    assert TOOLS["search_notaries"](firms["firm"], columns=["name"], text="bet").count() == 1


def test_numbered(spark):
    rows = [(g, i) for g, n in (("a", 700), ("b", 3), ("c", 40)) for i in range(n)]
    got = R.numbered(spark.createDataFrame(rows, "g string, i int").repartition(5), ["g"], ["i"]).collect()
    assert len(got) == len(rows) and all(r.position == r.i + 1 for r in got)


def broadcast_rows(df):
    """Rows of each table that the driver collected for a broadcast, by the plan as it ran."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = [node.metrics().apply("numOutputRows").value()] if name == "BroadcastExchangeExec" else []
        return own + [n for i in range(node.children().size()) for n in walk(node.children().apply(i))]

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_effective_rate_is_not_broadcast(spark):
    """Pieces of spans do not go through the driver, and those of keys with few entries are not multiplied."""
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    rates = spark.createDataFrame([(i, day(i % 9), None, float(i)) for i in range(500)], "k int, effective_from date, effective_to date, rate double")
    found = R.effective_rate(spark.createDataFrame([(i, day(400)) for i in range(500)], "k int, at date"), rates, "k", "at")
    assert sum(broadcast_rows(found)) == 0
    assert {(r.k, r.rate) for r in found.collect()} == {(i, i) for i in range(500)}


def test_effective_rate_of_hot_keys(spark, monkeypatch):
    """A key with more entries than one part takes, all of one day, and one with fewer."""
    monkeypatch.setattr(R, "HOT", 20)
    rates = spark.createDataFrame([("a", 0, 40, 1.0), ("a", 90, None, 2.0), ("b", 5, 5, 3.0)], "k string, effective_from int, effective_to int, rate double")
    entries = [(i, "a", d) for i, d in enumerate([7] * 90 + [50, 95])] + [(100, "b", 5), (101, "b", 6), (102, None, 5), (103, "a", None)]
    got = R.effective_rate(spark.createDataFrame(entries, "i int, k string, at int"), rates, "k", "at").collect()
    assert sorted((r.i, r.rate) for r in got) == [*((i, 1.0) for i in range(90)), (90, 0.0), (91, 2.0), (100, 3.0), (101, 0.0), (102, 0.0), (103, 0.0)]


def test_containing_does_not_broadcast_texts(spark):
    """Neither texts nor their parts go through the driver, with few needles and with many."""
    texts = spark.range(3000).selectExpr("id", "'the same text with number ' || (id % 7) AS body")
    for needles, n in ((spark.createDataFrame([("TEXT",), ("none such",)], "needle string"), 3000), (spark.range(2000).selectExpr("'number ' || id AS needle"), 3000)):
        found = R.containing(texts, "body", needles, "needle")
        assert found.count() == n
        assert max(broadcast_rows(found), default=0) < 200


def test_a_chain_is_made_once_for_its_status(spark):
    """The decisions are read and joined once; a number's target, effects and length come from that."""
    from docketry.operators import cases

    rows = [(1, "1/2/2023", "Рішення", "районний суд", None, None, "2023-01-01", "задовольнити", None), (2, "1/2/23", "Постанова", "апеляційний суд", None, None, "2023-05-01", "скасувати", None), (3, "1/2/23", "Постанова", "апеляційний суд", None, None, None, "залишити без змін", None)]
    decisions = spark.createDataFrame(rows, "doc_id bigint, case_number string, title string, court string, chamber string, form string, decided string, resolution string, snippet string")
    found = cases.precedent_status(spark.createDataFrame([("1/2/2023",), ("9/9/2023",), ("1/2/2023",)], "number string"), decisions)
    got = {r.number: (r.target_doc_id, r.status, [(a.doc_id, a.effect) for a in r.affecting], r.chain_length) for r in found.collect()}
    assert got == {"1/2/2023": (1, "explicitly_overruled", [(2, "overruled"), (3, "upheld")], 3), "9/9/2023": (None, "unknown", [], 0)}
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 3
