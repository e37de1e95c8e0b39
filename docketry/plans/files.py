"""Documents in office formats: written from the texts of the tables, read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.plans.registry import query
from docketry.sources import documents as D
from docketry.sources.tables import table, written


@query("src17_docx_paragraphs", "SELECT doc_id, part, sha256(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS part FROM documents)")
def docx_paragraphs(spark, d):
    """Every text as a DOCX file with a paragraph a line, stored, and the paragraphs that a reader finds."""
    files = written(D.as_files(table(spark, d, "documents"), "doc_id", "text", F.lit("docx")))
    rows = D.parts(files).where("error is null")
    return rows.select(F.substring_index("path", ".", 1).cast("bigint").alias("doc_id"), "part", F.sha2("text", 256).alias("line"))


@query("src14_parsed_files", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS type, sha256(regexp_replace(regexp_replace(text, '\\n+', CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE chr(10) || chr(10) END, 'g'), '^\\n+|\\n+$', '', 'g')) AS text, CAST(NULL AS VARCHAR) AS error FROM documents")
def parsed_files(spark, d):
    """Even texts as PDF, odd ones as DOCX, each sniffed and read by its reader; empty lines do not count."""
    kind = F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("docx")
    found = D.texts(written(D.as_files(table(spark, d, "documents"), "doc_id", "text", kind)))
    line = F.when(F.col("type") == "application/pdf", "\n").otherwise("\n\n")
    plain = F.regexp_replace(F.regexp_replace("text", F.lit("\n+"), line), "^\n+|\n+$", "")
    return found.select(F.substring_index("path", ".", 1).cast("bigint").alias("doc_id"), "type", F.sha2(plain, 256).alias("text"), "error")
