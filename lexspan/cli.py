"""Command line: ``python -m lexspan.cli MODE FILE ARGUMENT``; FILE holds JSON lines with docid and contents.

Modes: text, gcl, cover (documents for a text or an expression), get (a document by its id), count
(documents that an expression matches), describe, batch (the text queries of a file of lines, each an id, a
tab and a text; all in one job). Exit 1: usage; 2: a failure while running.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexspan.operators import ranking as rk
from lexspan.operators import search as se
from lexspan.plans.engine import Engine
from lexspan.plans.gcl import GclError, Node, parse
from lexspan.sources.ingest import jsonl_documents, query_lines, read_lines

MODES = ("text", "gcl", "cover", "get", "count", "describe", "batch")


def answer(spark: SparkSession, mode: str, path: str, argument: str, depth: int = 10) -> dict:
    """What a mode prints."""
    rows = jsonl_documents(read_lines(spark, path)).withColumn("doc_id", F.xxhash64("docno"))
    engine = Engine(rows)
    names = rows.select("doc_id", "docno")
    if mode == "describe":
        return {"documents": rows.count(), "tokens": engine.tokens.count()}
    if mode == "get":
        found = rows.where(F.col("docno") == argument).select("docno", "text").first()
        return found.asDict() if found else {}
    if mode == "count":
        return {"count": engine.gcl(Node(">>", (parse(":item"), parse(argument)))).count()}
    if mode == "batch":
        topics = query_lines(read_lines(spark, argument))
        ids = topics.withColumn("item_id", F.xxhash64("topic"))
        run = rk.ranked(rk.bm25(engine.statistics(query := rk.query_terms(ids)), query), depth)
        found = run.join(ids.select(F.col("item_id").alias("topic"), F.col("topic").alias("name")), "topic").join(names, "doc_id")
        results = [r.asDict() for r in found.select(F.col("name").alias("topic"), "rank", "docno", "score").orderBy("topic", "rank").collect()]
        return {"results": results, "truncated": False}
    if mode == "cover":
        hits = se.summaries(engine, argument, depth)
    else:
        hits = se.search_text(engine, argument, depth) if mode == "text" else se.search_gcl(engine, argument, depth)
    results = [r.asDict() for r in hits.join(names, "doc_id").drop("doc_id").orderBy(F.desc("score"), "docno").collect()]
    return {"results": results, "truncated": len(results) == depth}


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in MODES or (len(args) < 3 and args[0] != "describe"):
        print(__doc__, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lexspan").getOrCreate()
    try:
        print(json.dumps(answer(spark, args[0], args[1], args[2] if len(args) > 2 else "")))
    except (GclError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
