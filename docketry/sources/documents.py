"""Documents of office formats as rows of text: PDF by page, DOCX and DOC by paragraph, rich text, pages and plain text whole.

``files`` has the columns of Spark's ``binaryFile`` source (path, content). Spark splits the files over the tasks;
within a task one file is read at a time, so a task holds a file and its text. What cannot be read becomes a row
with an error, beside what was read before it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import legal as L
from docketry.sources import pdf, registries, word97

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PARTS = "path string, type string, part int, text string, error string"


def read(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The files of a folder and all below it, with their types by first bytes; Spark leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.withColumn("type", registries.sniffed(F.col("content")))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SIGNS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "\u2011", f"{_W}softHyphen": "\u00AD"}
_RUN, _AGAIN = f"{_W}r", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
_CODE = re.compile("_x([0-9A-Fa-f]{4})_")


def docx_paragraphs(content: bytes) -> Iterator[str]:
    """Texts of the paragraphs of a DOCX file in their order, those in tables too; deleted text and field codes are left out.

    A paragraph in a text box inside another stands before it. Signs that XML has not are written by their code.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as part:
        open_: list[list[str]] = []
        runs = again = 0  # depth in runs, and in what stands for readers that lack a feature
        for event, node in ElementTree.iterparse(part, ("start", "end")):
            if node.tag in (_RUN, _AGAIN):
                runs += (node.tag == _RUN) * (1 if event == "start" else -1)
                again += (node.tag == _AGAIN) * (1 if event == "start" else -1)
            elif again:
                continue
            elif node.tag == f"{_W}p":
                if event == "start":
                    open_.append([])
                else:
                    yield "".join(open_.pop())
                    node.clear()
            elif event == "end" and open_ and runs:
                if node.tag == f"{_W}t":
                    open_[-1].append(_CODE.sub(lambda m: chr(int(m[1], 16)), node.text or ""))
                elif node.tag in _SIGNS:
                    open_[-1].append(_SIGNS[node.tag])


_XML_LACKS = re.compile("[\x00-\x08\x0b-\x1f\uFFFE\uFFFF]|_(?=x[0-9A-Fa-f]{4}_)")
_FRAME = (
    ("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{DOCX}.main+xml"/></Types>'),
    ("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
)


def docx_bytes(text: str) -> bytes:
    """A DOCX file with a paragraph for each line of ``text``; tabs become tab signs."""
    coded = lambda s: escape(_XML_LACKS.sub(lambda m: f"_x{ord(m[0]):04X}_", s))
    runs = lambda line: "<w:tab/>".join(f'<w:t xml:space="preserve">{coded(t)}</w:t>' for t in line.split("\t"))
    body = "".join(f"<w:p><w:r>{runs(line)}</w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in (*_FRAME, ("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')):
            archive.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


_READERS = {DOCX: docx_paragraphs, "application/pdf": pdf.pages, "application/msword": word97.paragraphs}


def parts(files: DataFrame) -> DataFrame:
    """path, type, part, text and error: a row for each page or paragraph of the files in formats of their own.

    A file that fails has a row with what is wrong, without text, after those that were read; null content is such a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0  # those of several small files are handed on together
            for path, kind, content in zip(batch.column("path").to_pylist(), batch.column("type").to_pylist(), batch.column("content")):
                n = 0
                try:
                    for text in _READERS[kind](content.as_py() or b""):
                        n += 1
                        rows.append((path, kind, n, text, None))
                        size += len(text) + 64
                        if size > 1 << 22:
                            yield _part_rows(rows)
                            rows, size = [], 0
                except Exception as wrong:  # any damage of a file is a row of its own
                    n += 1
                    rows.append((path, kind, n, None, f"{type(wrong).__name__}: {wrong}"[:200]))
                if not n:  # a file without pages or paragraphs has one without text
                    rows.append((path, kind, 1, "", None))
            if rows:
                yield _part_rows(rows)

    own = files.where(F.col("type").isin(*_READERS)).select("path", "type", "content")
    return own.mapInArrow(run, PARTS)


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], ["path", "type", "part", "text", "error"])


def texts(files: DataFrame) -> DataFrame:
    """path, type, text and error of each file: paragraphs are joined by blank lines, pages of a PDF by line ends.

    Rich text, pages and plain text are read by built-in functions. A file that could be read in part has both text and error.
    """
    rows = parts(files).groupBy("path", "type").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("_parts"), F.max("error").alias("error"))
    told = F.transform("_parts", lambda p: p["text"])
    joined = F.when(F.col("type") == "application/pdf", F.array_join(told, "\n")).otherwise(F.array_join(told, "\n\n"))
    read_ = rows.select("path", "type", joined.alias("text"), "error")
    plain = registries.decoded_text(F.col("content"))
    # of pages, tags go and white space is one blank
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " "), r"\s+", " "))
    own = F.when(F.col("type") == "application/rtf", L.rich_text(F.decode("content", "ISO-8859-1"))).when(F.col("type") == "text/html", bare).otherwise(plain)
    rest = files.where(~F.col("type").isin(*_READERS)).select("path", "type", own.alias("text"), F.lit(None).cast("string").alias("error"))
    return read_.unionByName(rest)


def as_files(docs: DataFrame, key: str, text: str, kind: Column) -> DataFrame:
    """``docs`` as files: path (the key and an ending) and content in the format that ``kind`` names, docx or pdf; null texts are empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents, size = [], [], 0
            for path, t, k in zip(batch.column("path"), batch.column("text"), batch.column("kind")):  # one text at a time is a Python object
                paths.append(path.as_py())
                contents.append((pdf.pdf_bytes if k.as_py() == "pdf" else docx_bytes)(t.as_py() or ""))
                size += len(contents[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    rows = docs.select(F.concat(F.col(key).cast("string"), F.lit("."), kind).alias("path"), F.col(text).alias("text"), kind.alias("kind"))
    return rows.mapInArrow(made, "path string, content binary").withColumn("type", registries.sniffed(F.col("content")))
