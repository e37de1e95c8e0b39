"""Parliament data sets: members, their assistants, factions, committees, bills, session days and votes, as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names under which the data sets keep their lists, and the fields of each list.
MEMBER_LISTS = ("mps", "mps_list", "deputies")
MEMBER_FIELDS = "id string, rada_id string, full_name string, short_name string, gender string, birthday string, convocation string, assistants array<struct<full_name: string, type: string>>"
GROUP_FIELDS = "id string, name string, is_fr int, type int"
BILL_LISTS = ("bills", "zpr")
BILL_FIELDS = "id string, bill_id string, registrationNumber string, number string, name string, title string, registrationDate string, subject string, type string, rubric string, status string, url string, currentPhase struct<title: string, date: string, status: string>"
VOTE_LISTS = ("question", "questions")
VOTE_FIELDS = "name string, events array<struct<id: string, results: array<struct<deputy: string, vote: string>>>>"
FACTION, COMMITTEE = "is_fr = 1", "type = 2"


def read_list(spark: SparkSession, path: str, names: tuple[str, ...], fields: str, file: bool = False) -> DataFrame:
    """Rows of the first of the lists ``names`` that a file has, or of the file itself where it is a list; a file is read by one task.

    ``file``: adds file, the name of each row's file.
    """
    columns = T.StructType.fromDDL(fields).names
    raw = spark.read.option("multiLine", True).schema(", ".join([fields, *(f"{n} array<struct<{fields}>>" for n in names)])).json(path)
    # a file that is a list gives one row an element, with the fields at the top
    listed = F.coalesce(*names, F.array(F.struct(*columns)))
    from_file = raw.withColumn("_file", F.input_file_name()).select("_file", F.explode(listed).alias("_row"))
    out = from_file.select(F.col("_file").alias("file"), "_row.*") if file else from_file.select("_row.*")
    return out.where(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull())


def read_members(spark: SparkSession, path: str) -> DataFrame:
    return read_list(spark, path, MEMBER_LISTS, MEMBER_FIELDS)


def assistants(members: DataFrame) -> DataFrame:
    """rada_id (or id), full_name and type of each member's assistants."""
    return members.select(F.coalesce("rada_id", "id").alias("rada_id"), F.inline("assistants"))


def read_groups(spark: SparkSession, path: str, which: str) -> DataFrame:
    """The FACTION or COMMITTEE entries of the members' file."""
    return read_list(spark, path, ("fr_associations",), GROUP_FIELDS).where(which)


def read_bills(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Bills registered from ``first`` to ``last`` (dates, both in it); bills without a date always stay."""
    raw = read_list(spark, path, BILL_LISTS, BILL_FIELDS)
    day = F.to_date(F.split_part("registrationDate", F.lit("T"), F.lit(1)))
    bills = raw.select(
        F.coalesce("id", "bill_id").alias("bill_id"), F.coalesce("registrationNumber", "number").alias("number"), F.coalesce("name", "title").alias("title"), day.alias("registered"),
        "subject", "type", "rubric", F.col("currentPhase.title").alias("phase"), F.to_date(F.substring("currentPhase.date", 1, 10)).alias("phase_date"), F.coalesce("currentPhase.status", "status").alias("status"), "url",
    )
    for bound, test in ((first, F.col("registered") >= F.lit(first)), (last, F.col("registered") <= F.lit(last))):
        if bound:
            bills = bills.where(F.coalesce(test, F.lit(True)))
    return bills


def read_session_dates(spark: SparkSession, path: str) -> DataFrame:
    """day of each line DD.MM.YYYY; other lines are left out."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).where(line.rlike(r"^\d{2}\.\d{2}\.\d{4}$")).select(F.try_to_timestamp(line, F.lit("dd.MM.yyyy")).cast("date").alias("day"))


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each event and deputy: session_date, question, event, deputy, vote; from files named DDMMYYYY.json."""
    raw = read_list(spark, path, VOTE_LISTS, VOTE_FIELDS, file=True)
    day = F.try_to_timestamp(F.regexp_extract("file", r"(\d{8})\.json", 1), F.lit("ddMMyyyy")).cast("date")
    each = raw.select(day.alias("session_date"), F.col("name").alias("question"), F.explode_outer("events").alias("e"))
    return each.select("session_date", "question", F.col("e.id").alias("event"), F.explode_outer("e.results").alias("r")).select("session_date", "question", "event", F.col("r.deputy").alias("deputy"), F.col("r.vote").alias("vote"))


def read_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """A local data set of JSON lines or of one list a file, with a given schema; unreadable rows are left out."""
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(fields).json(path)
