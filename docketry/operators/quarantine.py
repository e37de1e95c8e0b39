"""Good and bad rows in one pass: each line is parsed once, and what is wrong with it goes with it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.sources.tables import shared_folder


@dataclass
class Split:
    """``good``: the parsed columns; ``bad``: line and reasons; counts: rows, bad, and rows by reason."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def parsed(lines: DataFrame, line: str, schema: str, kind: str = "csv", options: dict | None = None) -> DataFrame:
    """line, row (a struct of ``schema``, null where nothing could be read) and broken (whether the text does not fit the schema)."""
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_broken", T.StringType())])
    read = {"csv": F.from_csv, "json": F.from_json}[kind]
    told = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", **(options or {})}
    text = F.coalesce(F.col(line), F.lit(""))
    whole = read(text, full.simpleString() if kind == "csv" else full, told)
    return lines.select(F.col(line).alias("line"), whole.alias("_row")).select("line", F.struct(*(F.col(f"_row.{f.name}") for f in full.fields[:-1])).alias("row"), (F.col("_row._broken").isNotNull() | F.col("_row").isNull() | F.col("line").isNull()).alias("broken"))


def split(lines: DataFrame, line: str, schema: str, rules: dict[str, Column], kind: str = "csv", options: dict | None = None, path: str | None = None) -> Split:
    """Rows that can be read and keep every rule of ``rules`` (tests on the parsed columns), and all others with reasons.

    The source is read and parsed once: one job writes both kinds beside each other and counts as it goes. Reasons
    are ``broken`` alone for a line that cannot be read, else the names of the rules that do not hold; a rule that gives null does not hold.
    """
    path = path or f"{shared_folder(lines.sparkSession)}/split-{uuid.uuid4().hex}"
    rows = parsed(lines, line, schema, kind, options).select("line", "broken", "row.*", "row")
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))) if rules else F.array().cast("array<string>")
    judged = rows.select("line", "row", F.when(F.col("broken"), F.array(F.lit("broken"))).otherwise(failed).alias("reasons")).withColumn("ok", F.size("reasons") == 0)
    seen = Observation()
    counted = judged.observe(seen, F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("bad"), *(F.count_if(F.array_contains("reasons", n)).alias(f"r{i}") for i, n in enumerate(("broken", *rules))))
    # a good row needs no line, a bad one no columns
    counted.select(F.when(~F.col("ok"), F.col("line")).alias("line"), F.when(F.col("ok"), F.col("row")).alias("row"), "reasons", "ok").write.partitionBy("ok").parquet(path)
    got = seen.get
    stored = lines.sparkSession.read.schema(T.StructType([T.StructField("line", T.StringType()), judged.schema["row"], T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("ok", T.BooleanType())])).parquet(path)
    names = {"rows": got["rows"], "bad": got["bad"], **{n: got[f"r{i}"] for i, n in enumerate(("broken", *rules))}}
    return Split(stored.where("ok").select("row.*"), stored.where("not ok").select("line", "reasons"), names)
