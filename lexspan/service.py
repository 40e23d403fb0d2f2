"""Search tools as functions from JSON requests to JSON responses, and an HTTP server over them.

Tools: search_text, search_gcl, cover_search, tiered_query_search, multitext_tiered_search, get_document,
count_matches. A request is an object with the tool's arguments; a response has ``results`` (docid, score and what else
the tool tells), or ``count``, or the document, and ``truncated`` if there are as many results as were asked for. Errors are
{"error": text} with a status: 400 for a bad request, 401 without the token, 404 for an unknown path or
document, 413 for a query over the posting budget.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators import search as se
from lexspan.plans.engine import Engine
from lexspan.plans.gcl import GclError, Node, compile_program, leaves, parse

#: Bytes that a posting counts for in the budget.
POSTING_BYTES = 24


class Refused(Exception):
    """A request that gets an error response."""

    def __init__(self, status: int, text: str) -> None:
        super().__init__(text)
        self.status = status


class Collection:
    """The tools over documents (docno, text); ``budget`` bounds the bytes of a query's postings."""

    def __init__(self, docs: DataFrame, budget: int | None = None) -> None:
        self.docs = docs.select("docno", "text").withColumn("doc_id", F.xxhash64("docno"))
        self.engine, self.budget = Engine(self.docs.select("doc_id", "text")), budget
        self.tools: dict[str, Callable[[dict], dict]] = {
            "search_text": lambda q: self._listed(se.search_text(self.engine, self._admitted(need(q, "query", str), words=True), top_k(q)), q),
            "search_gcl": lambda q: self._listed(se.search_gcl(self.engine, self._admitted(need(q, "query", str)), top_k(q)), q),
            "cover_search": self.cover_search,
            "tiered_query_search": lambda q: self._tiered(need(q, "tiers", list), q),
            "multitext_tiered_search": self.multitext,
            "get_document": self.get_document,
            "count_matches": lambda q: {"count": self.engine.gcl(Node(">>", (parse(":item"), parse(self._admitted(need(q, "query", str)))))).count()},
        }

    def call(self, tool: str, request: dict) -> dict:
        if tool not in self.tools:
            raise Refused(404, f"no such tool: {tool}")
        try:
            return self.tools[tool](request)
        except GclError as e:
            raise Refused(400, str(e)) from e

    def describe(self) -> dict:
        total = self.engine.totals()
        return {"documents": total["items"], "tokens": total["length"] or 0, "tools": sorted(self.tools)}

    def postings(self, expr: str, words: bool = False) -> list[tuple[str, int]]:
        """The bytes of the lists that a query reads, the largest first."""
        from lexspan.plans.gcl import words_of

        terms = words_of(expr) if words else leaves(parse(expr))
        counts = self.engine.tokens.where(F.col("term").isin(*set(terms))).groupBy("term").agg((F.count("*") * POSTING_BYTES).alias("n"))
        return [tuple(r) for r in counts.orderBy(F.desc("n"), "term").collect()]

    def _admitted(self, expr: str, words: bool = False) -> str:
        if self.budget is not None:
            lists = self.postings(expr, words)
            if sum(n for _, n in lists) > self.budget:
                raise Refused(413, f"over the posting budget of {self.budget} bytes: " + ", ".join(f"{t} {n}" for t, n in lists[:4]))
        return expr

    def _listed(self, hits: DataFrame, request: dict) -> dict:
        rows = hits.join(self.docs.select("doc_id", "docno"), "doc_id").drop("doc_id").orderBy(F.desc("score"), "docno").collect()
        results = [{"docid": r["docno"], **{k: v for k, v in r.asDict().items() if k != "docno"}} for r in rows]
        return {"results": results, "truncated": len(results) == top_k(request)}

    def cover_search(self, request: dict) -> dict:
        exclude = self.docs.where(F.col("docno").isin(*map(str, request.get("exclude", [])))).select("doc_id")
        expr = self._admitted(need(request, "query", str))
        found = se.cover_search(self.engine, expr, top_k(request), exclude).select("doc_id", "score")
        said = se.summaries(self.engine, expr, top_k(request) + len(request.get("exclude", []))).select("doc_id", "summary")
        return self._listed(found.join(said, "doc_id", "left"), request)

    def _tiered(self, tiers: list[str], request: dict) -> dict:
        return self._listed(se.tiered(self.engine, [self._admitted(t) for t in tiers], top_k(request)), request)

    def multitext(self, request: dict) -> dict:
        tiers, errors = compile_program(need(request, "program", str))
        if errors:
            raise Refused(400, "; ".join(map(str, errors)))
        return self._listed(se.tiered(self.engine, [expr for _, expr in tiers], top_k(request)), request)

    def get_document(self, request: dict) -> dict:
        found = self.docs.where(F.col("docno") == need(request, "docid", str)).select("docno", "text").first()
        if not found:
            raise Refused(404, "no such document")
        return {"docid": found["docno"], "contents": found["text"]}


class Shards:
    """Several collections as one: a search asks all of them and merges by score; the first error fails the call."""

    def __init__(self, collections: list[Collection]) -> None:
        self.collections = collections

    def call(self, tool: str, request: dict) -> dict:
        if tool == "get_document":
            for c in self.collections[:-1]:
                try:
                    return c.call(tool, request)
                except Refused as e:
                    if e.status != 404:
                        raise
            return self.collections[-1].call(tool, request)
        found = [c.call(tool, request) for c in self.collections]
        if tool == "count_matches":
            return {"count": sum(f["count"] for f in found)}
        hits = sorted((h for f in found for h in f["results"]), key=lambda h: (-h["score"], h["docid"]))[: top_k(request)]
        return {"results": hits, "truncated": len(hits) == top_k(request)}

    def describe(self) -> dict:
        told = [c.describe() for c in self.collections]
        return {"documents": sum(t["documents"] for t in told), "tokens": sum(t["tokens"] for t in told), "tools": told[0]["tools"], "shards": len(told)}


class Scripted:
    """Answers from a script, for tests of callers: (tool, response) in order."""

    def __init__(self, script: list[tuple[str, dict]]) -> None:
        self.script, self.calls = list(script), []

    def call(self, tool: str, request: dict) -> dict:
        self.calls.append((tool, request))
        if not self.script or self.script[0][0] != tool:
            raise Refused(400, f"the script has no answer to {tool}")
        return self.script.pop(0)[1]

    def describe(self) -> dict:
        return {"documents": 0, "tokens": 0, "tools": sorted({t for t, _ in self.script})}


def need(request: dict, name: str, kind: type) -> Any:
    if not isinstance(request.get(name), kind) or not request[name]:
        raise Refused(400, f"{name} is missing")
    return request[name]


def top_k(request: dict) -> int:
    k = request.get("top_k", 10)
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise Refused(400, "top_k is no positive number")
    return k


def respond(engine, method: str, path: str, body: bytes = b"", authorization: str = "", token: str | None = None) -> tuple[int, dict]:
    """Status and response of one request; /healthz needs no token."""
    if path == "/healthz":
        return 200, {"ok": True}
    if token and authorization != f"Bearer {token}":
        return 401, {"error": "unauthorized"}
    try:
        if method == "GET" and path == "/describe":
            return 200, engine.describe()
        if method == "POST" and path.startswith("/tools/"):
            request = json.loads(body or b"{}")
            if not isinstance(request, dict):
                raise Refused(400, "the request is no object")
            return 200, engine.call(path.removeprefix("/tools/"), request)
        return 404, {"error": "not found"}
    except json.JSONDecodeError as e:
        return 400, {"error": f"no JSON: {e}"}
    except Refused as e:
        return e.status, {"error": str(e)}


def serve(engine, host: str = "127.0.0.1", port: int = 8080, token: str | None = None) -> ThreadingHTTPServer:
    """A running server; ``shutdown`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, response = respond(engine, self.command, self.path, body, self.headers.get("Authorization", ""), token)
            raw = json.dumps(response).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = answer

        def log_message(self, *_: Any) -> None:
            return

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
