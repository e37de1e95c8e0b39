"""Registry files, laws and streams."""

import datetime
import json

from pyspark.sql import functions as F

from docketry.sources import parliament as P
from docketry.sources import registries as S
from docketry.streaming import events as E

NOTARIES = S.Registry("notaries", ("licence",), {"licence": "LICENCE", "name": "NAME"})


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes('<?xml version="1.0" encoding="windows-1251"?><DATA><RECORD><LICENCE>1</LICENCE><NAME>Їжак </NAME></RECORD><RECORD><LICENCE>2</LICENCE></RECORD></DATA>'.encode("cp1251"))
    assert sorted(map(tuple, S.read_xml(spark, str(tmp_path / "a.xml"), NOTARIES).collect())) == [("1", "Їжак"), ("2", None)]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('LICENCE;NAME;CITY;NOTE\n1;"He said ""yes""; twice";Kyiv;n\n2;x\n\n3;c;d;e\n', encoding="utf-8")
    registry = S.Registry("notaries", ("licence",), {"licence": "LICENCE", "name": "NAME", "gone": "GONE"}, encoding="UTF-8")
    assert sorted(map(tuple, S.read_delimited(spark, str(tmp_path / "a.csv"), registry).collect())) == [("1", 'He said "yes"; twice', None), ("2", "x", None), ("3", "c", None)]


def test_rows_like_a_header_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text('N;NAME\nN;x\nIVAN;y\n1;"two\nlines"\n', encoding="utf-8")
    got = S.read_delimited(spark, str(tmp_path / "a.csv"), S.Registry("r", ("n",), {"n": "N", "name": "NAME"}, encoding="UTF-8")).collect()
    assert sorted(map(tuple, got)) == [("1", "two\nlines"), ("IVAN", "y"), ("N", "x")]


def test_last_record(spark):
    df = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), (None, "c", 3), (None, "c", 4), (None, "d", 5)], "licence string, name string, seq int")
    got = S.last_record(df, NOTARIES, "seq").collect()
    assert sorted(r.name for r in got) == ["b", "c", "c", "d"] and len({r.licence for r in got}) == 4 and all(r.licence == "1" or r.licence.startswith("gen_") for r in got)


def test_subjects(spark, tmp_path):
    (tmp_path / "uo.xml").write_bytes('<?xml version="1.0" encoding="windows-1251"?><DATA><SUBJECT><RECORD>1</RECORD><NAME>Фірма</NAME><FOUNDERS><FOUNDER>A</FOUNDER><FOUNDER>B</FOUNDER></FOUNDERS></SUBJECT><SUBJECT><RECORD>2</RECORD></SUBJECT></DATA>'.encode("cp1251"))
    tables = S.read_subjects(spark, str(tmp_path / "uo.xml"))
    assert tables["main"].count() == 2 and sorted(map(tuple, tables["founders"].collect())) == [("1", 0, "A"), ("1", 1, "B")] and tables["signers"].count() == 0


def test_votes_and_laws(spark, tmp_path):
    (tmp_path / "05022024.json").write_text(json.dumps({"questions": [{"name": "q", "events": [{"id": "1", "results": [{"deputy": "x", "vote": "for"}, {"deputy": "y", "vote": "absent"}]}]}]}))
    rows = P.read_votes(spark, str(tmp_path / "05022024.json")).collect()
    assert {(str(r.session_date), r.deputy, r.vote) for r in rows} == {("2024-02-05", "x", "for"), ("2024-02-05", "y", "absent")}
    law = spark.createDataFrame([("<p>Стаття 1. Мета</p><p>Текст один</p><p>Стаття 2-1. Строки</p>Текст два",)], "h string").select(S.articles_of_law(F.col("h")).alias("a")).first().a
    assert [(a.number, a.title, a.text) for a in law] == [("1", "Мета", "Текст один"), ("2-1", "Строки", "Текст два")]


def test_printed_laws(spark):
    """The print form goes before the headings; short articles fall out; long first sentences give no title."""
    span = '<span class="rvts9">Стаття {}.</span>'
    page = span.format(1) + " <p>Мета закону. Він діє {редакція 5} всюди<em>зміни</em></p><script>var Стаття;</script>" + "<span class=rvts9>Стаття 2-1 </span>" + "Б" * 250 + ". Кінець" + span.format(3) + "мало"
    law = spark.createDataFrame([(page,), (None,), ("",)], "h string").coalesce(1).select(S.articles_of_law(F.col("h")).alias("a")).collect()
    assert [(a.number, a.title, a.text) for a in law[0].a] == [("1", "Мета закону", "Мета закону. Він діє  всюди"), ("2-1", None, "Б" * 250 + ". Кінець")]
    assert [r.a for r in law[1:]] in ([None, []], [[], []])


def test_law_metadata(spark):
    rows = [("435-15", '<h1>Цивільний <b>кодекс</b> (ЦК України)</h1><div class="info">прийнято 16.01.2003, набрання чинності 01.01.2004</div>'), ("1-2", "<div class='doc-title'>Про суд</div>"), ("x", "<h1>Кодекс КПК України</h1>"), ("z", None)]
    got = {r.rada_id: tuple(r)[1:] for r in S.law_metadata(spark.createDataFrame(rows, "rada_id string, html string")).collect()}
    assert got["435-15"] == ("law", "Цивільний кодекс (ЦК України)", "ЦК України", datetime.date(2003, 1, 16), datetime.date(2004, 1, 1), "active")
    assert got["1-2"] == ("law", "Про суд", None, None, None, "active") and got["x"][:3] == ("code", "Кодекс КПК України", "КПК України") and got["z"][0] == "regulation"


def test_subject_kinds(spark, tmp_path):
    exchange = "<EXCHANGE_DATA><EXCHANGE_ANSWER><TAX_PAYER_TYPE>t</TAX_PAYER_TYPE><START_NUM>5</START_NUM></EXCHANGE_ANSWER><EXCHANGE_ANSWER><END_NUM>6</END_NUM></EXCHANGE_ANSWER></EXCHANGE_DATA>"
    body = "<SUBJECT><RECORD>1</RECORD><NAME>A</NAME><FARMER>yes</FARMER><TYPE_BRANCH>b</TYPE_BRANCH><OPF>o</OPF><BRANCHES><BRANCH><CODE>7</CODE><NAME>N</NAME></BRANCH></BRANCHES><ASSIGNEES><ASSIGNEE><NAME>Z</NAME></ASSIGNEE></ASSIGNEES><EXECUTIVE_POWER><CODE>9</CODE></EXECUTIVE_POWER><TERMINATION_STARTED_INFO><OP_DATE>d</OP_DATE><REASON>r</REASON></TERMINATION_STARTED_INFO><BANKRUPTCY_READJUSTMENT_INFO><OP_DATE>e</OP_DATE><BANKRUPTCY_READJUSTMENT_HEAD_NAME>h</BANKRUPTCY_READJUSTMENT_HEAD_NAME></BANKRUPTCY_READJUSTMENT_INFO>" + exchange + "</SUBJECT>"
    bare = "<SUBJECT><NAME>B</NAME><TERMINATION_STARTED_INFO><REASON>no date</REASON></TERMINATION_STARTED_INFO></SUBJECT>"
    (tmp_path / "s.xml").write_text(f'<?xml version="1.0" encoding="UTF-8"?><DATA>{body}{bare}</DATA>', encoding="utf-8")
    read = lambda kind: {k: sorted(map(tuple, v.collect())) for k, v in S.read_subjects(spark, str(tmp_path / "s.xml"), kind, "UTF-8").items()}
    firm = read("UO")
    assert firm["branches"] == [("1", 0, "7", "N", None, None)] and firm["assignees"] == [("1", 0, "Z", None)] and firm["executive_power"] == [("1", None, "9")] and firm["founders"] == []
    assert firm["termination_started"] == [("1", "d", "r", None, None, None)] and firm["bankruptcy_info"] == [("1", "e", None, None, "h")] and firm["exchange_data"] == [("1", 0, "t", None, "5", None, None), ("1", 1, None, None, None, None, "6")]
    assert [r[0] for r in firm["main"]] == ["", "1"] and firm["main"][1][4] == "o"
    person, union = read("FOP"), read("FSU")
    assert set(person) == {"main", "exchange_data"} and person["main"][1] == ("1", "A", None, "yes", None, None, None, None)
    assert set(union) == {"main", "founders", "beneficiaries", "signers", "predecessors", "termination_started", "exchange_data"} and union["main"][1][5] == "b"


def test_parliament(spark, tmp_path):
    """Lists under any of their names or at the top of the file; groups of one file; dates and bounds."""
    members = {"mps": [{"id": 1, "rada_id": "10", "full_name": "A", "assistants": [{"full_name": "h", "type": "t"}]}, {"id": 2, "full_name": "B"}], "fr_associations": [{"id": 5, "name": "F", "is_fr": 1, "type": 1}, {"id": 6, "name": "C", "is_fr": 0, "type": 2}]}
    (tmp_path / "m.json").write_text(json.dumps(members))
    (tmp_path / "n.json").write_text(json.dumps([{"id": 3, "full_name": "C"}]))
    (tmp_path / "none.json").write_text("{}")
    got = P.read_members(spark, str(tmp_path / "m.json"))
    assert sorted((r.id, r.full_name) for r in got.collect()) == [("1", "A"), ("2", "B")] and [tuple(r) for r in P.assistants(got).collect()] == [("10", "h", "t")]
    assert [r.id for r in P.read_members(spark, str(tmp_path / "n.json")).collect()] == ["3"] and P.read_members(spark, str(tmp_path / "none.json")).count() == 0
    assert [[r.name for r in P.read_groups(spark, str(tmp_path / "m.json"), which).collect()] for which in (P.FACTION, P.COMMITTEE)] == [["F"], ["C"]]
    bills = [{"id": 1, "registrationNumber": "n1", "name": "x", "registrationDate": "2024-02-05T00:00:00", "currentPhase": {"title": "p", "date": "2024-03-01T10:00:00", "status": "s"}}, {"bill_id": "2", "number": "n2", "title": "y", "status": "w"}, {"id": 3, "registrationDate": "2023-01-01"}]
    (tmp_path / "b.json").write_text(json.dumps(bills))
    rows = {r.bill_id: r for r in P.read_bills(spark, str(tmp_path / "b.json"), "2024-01-01", "2024-02-05").collect()}
    assert set(rows) == {"1", "2"} and (rows["1"].number, rows["1"].status, str(rows["1"].phase_date)) == ("n1", "s", "2024-03-01") and (rows["2"].title, rows["2"].status) == ("y", "w")
    (tmp_path / "dates.txt").write_text("05.02.2024\n\nnonsense\n 06.02.2024 \n31.02.2024\n")
    assert sorted(str(r.day) for r in P.read_session_dates(spark, str(tmp_path / "dates.txt")).where("day is not null").collect()) == ["2024-02-05", "2024-02-06"]
    (tmp_path / "06022024.json").write_text(json.dumps([{"name": "q", "events": [{"id": "1", "results": []}]}]))
    assert [tuple(r)[1:] for r in P.read_votes(spark, str(tmp_path / "06022024.json")).collect()] == [("q", "1", None, None)]


def test_stuck_uploads(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 12, m)
    rows = [(1, "processing", at(0), 0), (2, "processing", at(25), 0), (3, "done", at(0), 0), (4, "assembling", at(0), 3), (5, None, None, None)]
    sessions = spark.createDataFrame(rows, "session_id int, status string, updated_at timestamp, retry_count int")
    found = lambda as_of: {r.session_id: r.action for r in E.stuck_uploads(sessions, as_of).collect()}
    assert found("2024-01-01 12:30:00") == {1: "recover", 4: "failed"} and found(None) == {1: "recover", 2: "recover", 4: "failed"}


def test_recoveries(spark, tmp_path):
    """A session that stands still is recovered three times and then fails; one that moves or ends is left alone."""
    start = datetime.datetime(2024, 1, 1)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("session_id string, status string, ts timestamp").json(f"{tmp_path}/in")
    query = E.recoveries(stream, late="0 seconds").writeStream.format("memory").queryName("recoveries").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for n, rows in enumerate([[("still", "processing", 0), ("moves", "assembling", 0), ("ends", "processing", 0)], [("moves", "processing", 9), ("ends", "done", 5)], [("moves", "done", 15), ("tick", "done", 15)], *([("tick", "done", m)] for m in (25, 40, 55, 70, 90))]):
            (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"session_id": s, "status": status, "ts": (start + datetime.timedelta(minutes=m)).isoformat()}) for s, status, m in rows))
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("recoveries").collect())) == [("still", 0, "recover"), ("still", 1, "recover"), ("still", 2, "recover"), ("still", 3, "failed")]


def test_bytes(spark):
    rows = [(bytearray(b"%PDF-1.7"),), (bytearray(b"PK\x03\x04zz"),), (bytearray(b"<!DOCTYPE html>"),), (bytearray("Привіт".encode("cp1251")),), (bytearray(b"\xff\xfe" + "Їж".encode("utf-16-le")),), (None,)]
    got = spark.createDataFrame(rows, "b binary").coalesce(1).select(S.sniffed(F.col("b")).alias("kind"), S.decoded_text(F.col("b")).alias("text")).collect()
    assert [r.kind for r in got][:3] == ["application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/html"] and [r.text for r in got][3:] == ["Привіт", "Їж", None]


def test_streams(spark, sf, tmp_path):
    """A stream that has read all there is gives the rows of the batch query; a second run adds none."""
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events")
    batch = E.daily_counts(spark.read.parquet(f"{tmp_path}/events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", 10)
    stream = E.daily_counts(E.read_events(spark, f"{tmp_path}/events"), "event_type", 10, late="60 days")
    stream.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))

    def merge(frame, number):
        frame.write.mode("append").parquet(f"{tmp_path}/out")

    for _ in range(2):
        E.upsert_stream(E.read_events(spark, f"{tmp_path}/events"), merge, f"{tmp_path}/checkpoint", late="60 days").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(f"{tmp_path}/events").count()
