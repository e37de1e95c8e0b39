"""Public-registry files: XML and delimited text in legacy charsets, parliament JSON, and HTML pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Registry:
    """name, key columns, and where each column comes from in a record.

    A field of an XML record may be a path with dots; ``wrapper`` is such a path to the element below the record that
    holds all fields. ``computed``: further columns by functions of the row, such as ``lambda r: F.md5(r["name"])``.
    """

    name: str
    keys: tuple[str, ...]
    fields: dict[str, str]
    record: str = "RECORD"
    encoding: str = "windows-1251"
    delimiter: str = ";"
    wrapper: str = ""
    computed: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)


def read_xml(spark: SparkSession, path: str, registry: Registry) -> DataFrame:
    """One row for each record element; fields that a file lacks are null. The source splits large files by element."""
    paths = {c: [p for p in f"{registry.wrapper}.{f}".split(".") if p] for c, f in registry.fields.items()}
    tree: dict = {}
    for steps in paths.values():
        at = tree
        for step in steps[:-1]:
            at = at.setdefault(step, {})
            if not isinstance(at, dict):
                raise ValueError(f"{'.'.join(steps)} goes through a field")
        at.setdefault(steps[-1], "string")
    kind = lambda node: T.StringType() if node == "string" else T.StructType([T.StructField(n, kind(x)) for n, x in node.items()])
    raw = spark.read.format("xml").option("rowTag", registry.record).option("charset", registry.encoding).schema(kind(tree)).load(path)
    named = {c: F.col(".".join(f"`{p}`" for p in steps)) for c, steps in paths.items()}
    return _with_computed(raw.select(*(F.nullif(F.trim(F.translate(x, _CONTROL, " " * len(_CONTROL))), F.lit("")).alias(c) for c, x in named.items())), registry)


def _with_computed(rows: DataFrame, registry: Registry) -> DataFrame:
    return rows.select("*", *(f(rows).alias(c) for c, f in registry.computed.items()))


#: Control characters that some registries leave in texts.
_CONTROL = "".join(map(chr, (*range(1, 9), 11, 12, *range(14, 32))))


def named_item(items: Column, name: str) -> Column:
    """The text of the element whose name attribute is ``name``."""
    return F.try_element_at(F.filter(items, lambda i: i["_name"] == name), F.lit(1))["_VALUE"]


def read_delimited(spark: SparkSession, path: str, registry: Registry, multi_line: bool = True) -> DataFrame:
    """Rows with at least half of the header's columns; doubled quotes escape; short rows are filled with nulls.

    ``multi_line``: quoted fields may hold line breaks, and each file is one task; False splits large files.
    If the header has a single column under the registry's delimiter, the header alone is split by the other one.
    """
    reader = spark.read.option("encoding", registry.encoding).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("sep", registry.delimiter)
    first = reader.option("header", False).csv(path).limit(1).collect()
    header = [str(c).strip().lstrip("﻿") for c in first[0] if c is not None] if first else []
    if len(header) == 1:
        header = [c.strip().strip('"') for c in header[0].split("," if registry.delimiter == ";" else ";")]
    if not header:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in registry.fields))
    # the reader drops each file's first line; names come from it, never from a comparison with the rows
    rows = reader.option("header", True).option("enforceSchema", True).option("multiLine", multi_line).option("mode", "PERMISSIVE").schema(", ".join(f"`{i}` string" for i in range(len(header)))).csv(path)
    named = rows.select(*(F.col(f"`{i}`").alias(h) for i, h in enumerate(header)))
    present = sum((F.col(f"`{h}`").isNotNull().cast("int") for h in header), F.lit(0))
    kept = named.where(present * 2 >= len(header))
    return _with_computed(kept.select(*(F.nullif(F.col(f"`{h}`"), F.lit("")).alias(c) if h in header else F.lit(None).cast("string").alias(c) for c, h in registry.fields.items())), registry)


def last_record(df: DataFrame, registry: Registry, sequence: str) -> DataFrame:
    """The last row of each key; every row that lacks a part of its key stays, with ``gen_`` and a hash of all of it there."""
    own = F.concat(F.lit("gen_"), F.md5(F.to_json(F.struct(*df.columns))))
    keyed = df.withColumns({k: F.coalesce(F.col(k), own) for k in registry.keys})
    rest = [c for c in df.columns if c not in registry.keys]
    best = keyed.groupBy(*registry.keys).agg(F.max_by(F.struct(*rest), sequence).alias("_row"))
    return best.select(*registry.keys, "_row.*").select(*df.columns)


# Elements of a registry subject; of single texts, of nested groups (with fields, or of one text
# each where there are none) and of single parts, and which of them each kind of subject has.
COMPANY, ENTREPRENEUR, ASSOCIATION = "UO", "FOP", "FSU"
SUBJECT_TEXTS = {
    COMPANY: "EDRPOU NAME SHORT_NAME OPF STAN AUTHORIZED_CAPITAL FOUNDING_DOCUMENT_NUM PURPOSE SUPERIOR_MANAGEMENT STATUTE REGISTRATION MANAGING_PAPER TERMINATED_INFO TERMINATION_CANCEL_INFO",
    ENTREPRENEUR: "NAME STAN FARMER ESTATE_MANAGER REGISTRATION TERMINATED_INFO TERMINATION_CANCEL_INFO",
    ASSOCIATION: "EDRPOU NAME SHORT_NAME TYPE_SUBJECT TYPE_BRANCH STAN FOUNDING_DOCUMENT REGISTRATION TERMINATED_INFO TERMINATION_CANCEL_INFO",
}
SUBJECT_GROUPS = {
    "founders": ("FOUNDERS.FOUNDER", ""),
    "beneficiaries": ("BENEFICIARIES.BENEFICIARY", ""),
    "signers": ("SIGNERS.SIGNER", ""),
    "members": ("MEMBERS.MEMBER", ""),
    "branches": ("BRANCHES.BRANCH", "CODE NAME SIGNER CREATE_DATE"),
    "predecessors": ("PREDECESSORS.PREDECESSOR", "NAME CODE"),
    "assignees": ("ASSIGNEES.ASSIGNEE", "NAME CODE"),
    "exchange_data": ("EXCHANGE_DATA.EXCHANGE_ANSWER", "TAX_PAYER_TYPE START_DATE START_NUM END_DATE END_NUM"),
}
SUBJECT_PARTS = {
    "executive_power": ("EXECUTIVE_POWER", "NAME CODE", ("NAME", "CODE")),
    "termination_started": ("TERMINATION_STARTED_INFO", "OP_DATE REASON SBJ_STATE SIGNER_NAME CREDITOR_REQ_END_DATE", ("OP_DATE",)),
    "bankruptcy_info": ("BANKRUPTCY_READJUSTMENT_INFO", "OP_DATE REASON SBJ_STATE BANKRUPTCY_READJUSTMENT_HEAD_NAME", ("OP_DATE",)),
}
SUBJECT_TABLES = {
    COMPANY: (*SUBJECT_GROUPS, *SUBJECT_PARTS),
    ENTREPRENEUR: ("exchange_data",),
    ASSOCIATION: ("founders", "beneficiaries", "signers", "predecessors", "termination_started", "exchange_data"),
}


def read_subjects(spark: SparkSession, path: str, kind: str = COMPANY, encoding: str = "windows-1251") -> dict[str, DataFrame]:
    """main (record and the texts of the kind) and the tables of the kind's nested groups and parts, by name.

    A group is record, position and its fields (value where it has one text each), one row for each element; a
    part is record and its fields, where the subject has one. A subject without record has an empty one.
    """
    groups = {k: v for k, v in SUBJECT_GROUPS.items() if k in SUBJECT_TABLES[kind]}
    parts = {k: v for k, v in SUBJECT_PARTS.items() if k in SUBJECT_TABLES[kind]}
    fields = lambda names: "struct<" + ", ".join(f"{n}: string" for n in names.split()) + ">"
    columns = ["RECORD string", *(f"{t} string" for t in SUBJECT_TEXTS[kind].split())]
    for element, names in groups.values():
        outer, inner = element.split(".")
        columns.append(f"{outer} struct<{inner}: array<{fields(names) if names else 'string'}>>")
    columns += [f"{element} {fields(names)}" for element, names, _ in parts.values()]
    raw = spark.read.format("xml").option("rowTag", "SUBJECT").option("charset", encoding).schema(", ".join(columns)).load(path)
    record = F.coalesce("RECORD", F.lit("")).alias("record")
    tables = {"main": raw.select(record, *(F.col(c).alias(c.lower()) for c in SUBJECT_TEXTS[kind].split()))}
    for name, (element, names) in groups.items():
        each = raw.select(record, F.posexplode(element).alias("position", "value"))
        tables[name] = each.select("record", "position", *(F.col(f"value.{n}").alias(n.lower()) for n in names.split())) if names else each
    for name, (element, names, needed) in parts.items():
        there = F.coalesce(*(F.nullif(F.col(f"{element}.{n}"), F.lit("")) for n in needed)).isNotNull()
        tables[name] = raw.where(there).select(record, *(F.col(f"{element}.{n}").alias(n.lower().removeprefix("bankruptcy_readjustment_")) for n in names.split()))
    return tables


# Law pages: fixed values of the print form, its heading and the words of its blocks and kinds.
_PRINTED = r"(?s)<span\s+class=[\"']?rvts9[\"']?>Стаття\s+\d+(?:-\d+)?\.?\s*</span>.*?(?=<span\s+class=[\"']?rvts9|\z)"
_PRINTED_HEAD = r"(?s)^<span\s+class=[\"']?rvts9[\"']?>Стаття\s+(\d+(?:-\d+)?)\.?\s*</span>\s*"
_TITLED = r"(?is)<(h1\b|\w+(?=[^>]*\sclass=[\"'](?:title|doc-title)[\"']))[^>]*>(.*?)</\1>"
_INFO = r"(?is)<\w+[^>]*class=[\"'](?:info|doc-info|document-info)[\"'][^>]*>(.*?)</(?:div|table|section)>"
_ADOPTED, _IN_FORCE, _CODE, _LAW = "прийнято", "набрання чинності", "Кодекс", "Закон"
_SHORT = (r"\(([А-ЯІЇЄҐ]{2,}(?:\s+України)?)\)", r"([А-ЯІЇЄҐ]{2,}\s+України)")


def articles_of_law(html: Column) -> Column:
    """array of struct(number, title, text) of a law's articles.

    Of the print form, the articles with at least 10 characters, without scripts, emphasised remarks and remarks
    in braces, titled by their first sentence where it is under 200 characters; of any other page, what stands
    between the headings ``Стаття N.``, titled by the rest of the heading's line.
    """
    printed = F.transform(F.regexp_extract_all(html, F.lit(_PRINTED), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, _PRINTED_HEAD, 1).alias("number"), _clean(F.regexp_replace(p, _PRINTED_HEAD, "")).alias("text")))
    sentence = lambda t: F.element_at(F.split(t, "[.;]"), 1)
    printed = F.transform(F.filter(printed, lambda a: F.length(a["text"]) >= 10), lambda a: F.struct(a["number"].alias("number"), F.when(F.length(sentence(a["text"])).between(1, 199), F.trim(sentence(a["text"]))).alias("title"), a["text"].alias("text")))
    plain = F.regexp_replace(F.regexp_replace(html, r"<(br|/p|/div)[^>]*>", "\n"), "<[^>]*>", "")
    parts = F.filter(F.split(plain, r"(?=Стаття\s+\d+(?:-\d+)?[.\s])"), lambda p: p.rlike(r"^Стаття\s+\d+"))
    heading = r"^Стаття\s+(\d+(?:-\d+)?)\.?\s*([^\n]*)"
    other = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, heading, 1).alias("number"), F.trim(F.regexp_extract(p, heading, 2)).alias("title"), F.regexp_replace(F.regexp_replace(p, heading, ""), r"^\s+|\s+$", "").alias("text")))
    return F.when(F.size(printed) > 0, printed).otherwise(other)


def _clean(html: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|em)\b.*?</\1>", ""), "<[^>]*>", "")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"\{[^}]+\}", ""))


def law_metadata(laws: DataFrame) -> DataFrame:
    """rada_id, type, title, short_title, adoption_date, effective_date and status of law pages (rada_id, html).

    The title is the first heading; the dates follow their words in the page's information block, null without.
    """
    from docketry.functions.money import parse_date

    info = F.array_join(F.regexp_extract_all("html", F.lit(_INFO), F.lit(1)), " ")
    day = lambda word: parse_date(F.regexp_extract(_clean(F.col("_info")), word + r"\D*?(\d{2}\.\d{2}\.\d{4})", 1))
    titled = laws.select("rada_id", _clean(F.regexp_extract("html", _TITLED, 2)).alias("title"), info.alias("_info"))
    has = lambda word: F.col("title").contains(word)
    code, law = has(_CODE) | F.col("rada_id").contains(_CODE.lower()), has(_LAW) | F.col("rada_id").rlike(r"^\d+-\d+$")
    short = F.coalesce(*(F.nullif(F.regexp_extract("title", p, 1), F.lit("")) for p in _SHORT))
    return titled.select("rada_id", F.when(code, "code").when(law, "law").otherwise("regulation").alias("type"), "title", short.alias("short_title"), day(_ADOPTED).alias("adoption_date"), day(_IN_FORCE).alias("effective_date"), F.lit("active").alias("status"))


def page_metadata(pages: DataFrame) -> DataFrame:
    """title, description, canonical address and number of links of each page, by patterns that bear malformed HTML."""
    first = lambda pattern: F.nullif(F.trim(F.regexp_extract("html", pattern, 1)), F.lit(""))
    return pages.select(
        "page_id",
        first(r"(?is)<title[^>]*>(.*?)</title>").alias("title"),
        first(r"(?is)<meta\s+name=[\"']description[\"']\s+content=[\"']([^\"']*)").alias("description"),
        first(r"(?is)<link\s+rel=[\"']canonical[\"']\s+href=[\"']([^\"']*)").alias("canonical"),
        F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href="), F.lit(0))).cast("bigint").alias("n_links"),
    )


#: First bytes of file formats, as hexadecimal digits; any archive counts as a text document.
SIGNATURES = (("application/pdf", "25504446"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "504B0304"), ("application/msword", "D0CF11E0"), ("application/rtf", "7B5C7274"))


def sniffed(content: Column) -> Column:
    """The type of a file by its first bytes; HTML by its first tag, else plain text."""
    head, out = F.hex(F.substring(content, 1, 8)), F.when(F.lit(False), "")
    for kind, signature in SIGNATURES:
        out = out.when(head.startswith(signature), kind)
    return out.when(F.lower(F.substring(content, 1, 256).cast("string")).rlike(r"<(!doctype html|html|body)"), "text/html").otherwise("text/plain")


def decoded_text(content: Column) -> Column:
    """Bytes as text: by a mark of UTF-16, else UTF-8, else windows-1251 where over 5 % of the characters would be lost."""

    @F.pandas_udf("string")
    def decode(batch):
        import pandas as pd

        def one(raw):
            if raw is None:
                return None
            if raw[:2] == b"\xff\xfe":
                return raw[2:].decode("utf-16-le", "replace")
            text = raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
            return raw.decode("cp1251", "replace") if text.count("�") > 0.05 * max(1, len(text)) else text

        return pd.Series([one(r) for r in batch])

    return decode(content)
