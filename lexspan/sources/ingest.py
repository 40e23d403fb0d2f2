"""Sources and sinks: text files, TREC texts, JSON lines, separated values, vectors, judgments, runs.

Parsing works on DataFrames of lines, so the same operators read files, tables and streams.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATHS = "id long, path string, kind string, v double, said string"


# files

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines of text files; .gz files are read as they are."""
    return spark.read.text(path, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")


def file_features(files: DataFrame) -> DataFrame:
    """(path, feature, said): ``file:`` over all, ``filename:`` and ``content:`` of each file."""
    parts = F.create_map(F.lit("file:"), F.concat("path", F.lit("\n"), "value"), F.lit("filename:"), F.col("path"), F.lit("content:"), F.col("value"))
    return files.select("path", F.explode(parts).alias("feature", "said"))


def trec_documents(texts: DataFrame) -> DataFrame:
    """(docno, body) of texts that hold ``<DOC> ... <DOCNO> ... </DOC>`` records."""
    record = F.explode(F.regexp_extract_all("value", F.lit("(?s)<DOC>(.*?)</DOC>"), F.lit(1)))
    rows = texts.select(record.alias("record"))
    bare = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    docno = bare(F.regexp_extract("record", "(?s)<DOCNO>(.*?)</DOCNO>", 1))
    return rows.select(docno.alias("docno"), bare(F.regexp_replace("record", "(?s)<DOCNO>.*?</DOCNO>", "")).alias("body"))


# JSON

def json_rows(value, path: str = ":") -> Iterator[tuple[str, str, float, str]]:
    """(path, kind, v, said) of a value and all inside it. Objects give a second row for each key
    without the leading path; arrays have their length as value, null has NaN."""
    if value is None:
        yield path, "null", float("nan"), "null"
    elif isinstance(value, bool):
        yield path, "boolean", float(value), "true" if value else "false"
    elif isinstance(value, (int, float)):
        yield path, "number", float(value), f"{value:.6f}"
    elif isinstance(value, str):
        yield path, "string", 0.0, value
    elif isinstance(value, list):
        yield path, "array", float(len(value)), ""
        for i, x in enumerate(value):
            yield from json_rows(x, f"{path}[{i}]:")
    else:
        yield path, "object", 0.0, ""
        for key in sorted(value):
            yield from json_rows(value[key], f"{path}{key}:")
            yield f"{key}:", "key", 0.0, ""


def json_paths(lines: DataFrame, id_col: str, json_col: str, strict: bool = True) -> DataFrame:
    """(id, path, kind, v, said) of all values of JSON texts. A text that is no JSON fails the job, or
    without ``strict`` has no rows."""

    def run(batches):
        for rows in batches:
            out = []
            for i, text in zip(rows["id"], rows["line"], strict=True):
                try:
                    out += [(i, *r) for r in json_rows(json.loads(text))]
                except (TypeError, ValueError):
                    if strict:
                        raise
            yield pd.DataFrame(out, columns=["id", "path", "kind", "v", "said"])

    return lines.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).alias("line")).mapInPandas(run, PATHS)


def jsonl_documents(lines: DataFrame, id_field: str = "docid", text_field: str = "contents", strict: bool = False) -> DataFrame:
    """(docno, text) of JSON lines that have both fields and at least one word; ``strict`` fails on others."""
    get = lambda f: F.get_json_object("value", f"$.{f}")
    rows = lines.select(get(id_field).alias("docno"), get(text_field).alias("text"))
    good = F.col("docno").isNotNull() & F.coalesce(F.col("text").rlike("[A-Za-z0-9]"), F.lit(False))
    if strict:
        return rows.select(F.when(good, F.col("docno")).otherwise(F.raise_error(F.lit("bad line"))).alias("docno"), "text")
    return rows.where(good)


# separated values

def split_columns(line: Column, separator: str = "\t") -> Column:
    """The columns of a line; an empty separator splits at white space."""
    return F.split(F.trim(line), "\\s+") if separator == "" else F.split(line, f"\\Q{separator}\\E", -1)


def tsv_columns(lines: DataFrame, id_col: str, line_col: str, separator: str = "\t") -> DataFrame:
    """(id, feature, said): ``:0:``, ``:1:`` ... of each line."""
    rows = lines.select(F.col(id_col).alias("id"), F.posexplode(split_columns(F.col(line_col), separator)).alias("j", "said"))
    return rows.select("id", F.concat(F.lit(":"), F.col("j").cast("string"), F.lit(":")).alias("feature"), "said")


def query_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(topic, text): a tab, or else the first space, ends the topic."""
    line = F.col(line_col)
    parts = F.when(F.instr(line, "\t") > 0, F.split(line, "\t", 2)).otherwise(F.split(line, " ", 2))
    return lines.select(F.get(parts, F.lit(0)).alias("topic"), F.get(parts, F.lit(1)).alias("text"))


def qrels_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(topic, docno, grade) of lines with four fields; negative grades are 0."""
    f = F.split(F.trim(F.col(line_col)), "\\s+")
    return lines.where(F.size(f) == 4).select(f[0].alias("topic"), f[2].alias("docno"), F.greatest(f[3].cast("double"), F.lit(0.0)).alias("grade"))


# sources and identities

def not_yet(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files whose path, trimmed, isn't among the sources."""
    known = sources.select(F.trim("path").alias("lexspan_path")).distinct()
    return files.join(known, F.trim(files["path"]) == F.col("lexspan_path"), "left_anti")


def duplicate_docnos(docs: DataFrame, docno_col: str) -> DataFrame:
    return docs.groupBy(F.col(docno_col).alias("docno")).agg(F.count("*").alias("n")).where("n > 1")


def sparse_vectors(lines: DataFrame, prefix: str = "splade:") -> DataFrame:
    """(docid, feature, v) of JSON lines with ``docid`` and ``splade_vector``; only positive whole numbers count."""
    rows = lines.select(F.from_json("value", "docid string, splade_vector map<string,double>").alias("j")).select("j.docid", F.explode("j.splade_vector").alias("term", "v"))
    return rows.where("v > 0 and v = floor(v)").select("docid", F.concat(F.lit(prefix), "term").alias("feature"), F.col("v").cast("long").alias("v"))


def trec_lines(run: DataFrame, run_id: str) -> DataFrame:
    """Run lines ``topic Q0 docno rank score runid``."""
    return run.select(F.concat_ws(" ", F.col("topic").cast("string"), F.lit("Q0"), "docno", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(run_id)).alias("value"))


# collections: (docno, feature, said) of JSON lines and separated lines in published layouts

def collection_fields(lines: DataFrame, id_field: str, features: dict[str, str]) -> DataFrame:
    """One row for each field of each JSON line that has one; ``features`` maps a feature to its field's path."""
    get = lambda f: F.get_json_object("value", f"$.{f}")
    parts = F.array(*[F.struct(F.lit(name).alias("feature"), get(path).alias("said")) for name, path in features.items()])
    rows = lines.select(get(id_field).alias("docno"), F.explode(parts).alias("x")).select("docno", "x.feature", "x.said")
    return rows.where("docno is not null and said is not null")


#: Id field, and feature of each field, of the collections' records.
LAYOUTS = {
    "c4": ("url", {":text:": "text", ":url:": "url"}),
    "passages_v2": ("pid", {":pid:": "pid", ":passage:": "passage"}),
    "conversational": ("id", {":id:": "id", ":title:": "title", ":contents:": "contents"}),
    "news": ("id", {":id:": "id", ":title:": "title", ":author:": "author", ":article:": "contents[0].content", ":url:": "article_url"}),
}


def collection(lines: DataFrame, layout: str) -> DataFrame:
    return collection_fields(lines, *LAYOUTS[layout])


def passage_lines(lines: DataFrame) -> DataFrame:
    """(docno, text) of ``id<TAB>text`` lines."""
    parts = F.split("value", "\t", 2)
    return lines.where(F.size(parts) == 2).select(parts[0].alias("docno"), parts[1].alias("text"))


def json_text(said: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(said.alias("x"))), '^\\{"x":(.*)\\}$', 1)
