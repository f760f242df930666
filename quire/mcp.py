"""python -m quire.mcp [ROOT]: the operators as tools of a model-context server, JSON-RPC 2.0 by lines on standard input and output.

Files are opened into sessions: at most MOST at a time, gone after TTL seconds without use. Paths are kept
inside ROOT (else the working folder).
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import storage
from quire.operators import compare, convert, pdfsets, search
from quire.sources import pdfedit, reader

MOST, TTL, ROWS = 50, 3600.0, 1000
PROTOCOL = "2024-11-05"


class ToolError(ValueError):
    pass


@dataclass
class Session:
    docs: reader.Documents
    path: str
    used: float


class Sessions:
    """Open documents by id; the one least lately used makes room."""

    def __init__(self, most: int = MOST, ttl: float = TTL, clock: Callable[[], float] = time.monotonic):
        self.most, self.ttl, self.clock = most, ttl, clock
        self.held: OrderedDict[str, Session] = OrderedDict()

    def _expire(self) -> None:
        now = self.clock()
        for k in [k for k, s in self.held.items() if now - s.used > self.ttl]:
            del self.held[k]

    def add(self, docs: reader.Documents, path: str) -> str:
        self._expire()
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
        name = uuid.uuid4().hex[:12]
        self.held[name] = Session(docs, path, self.clock())
        return name

    def get(self, name: str) -> Session:
        self._expire()
        if name not in self.held:
            raise ToolError(f"there is no session {name}")
        self.held.move_to_end(name)
        self.held[name].used = self.clock()
        return self.held[name]


def inside(root: str, path: str) -> str:
    """The path, which must not lead out of root, links followed."""
    root = os.path.realpath(root)
    found = os.path.realpath(os.path.join(root, path))
    if found != root and not found.startswith(root + os.sep):
        raise ToolError(f"outside of {root}: {path}")
    return found


TABLES = {"text": "texts", "structure": "blocks", "tables": "cells", "images": "images", "bookmarks": "bookmarks", "annotations": "annotations", "metadata": "metadata", "pages": "pages", "info": "files"}
EDITS = {"rotate": (pdfedit.rotate, ("degrees",)), "select_pages": (pdfedit.select, ("numbers",)), "watermark": (pdfedit.watermark, ("text",)), "redact": (pdfedit.redact, ("pattern",)), "sanitize": (pdfedit.sanitize, ()), "optimize": (pdfedit.optimize, ()), "encrypt": (pdfedit.encrypt, ("user",)), "set_metadata": (pdfedit.set_metadata, ("updates",)), "fill_form": (pdfedit.fill_form, ("values",))}


class Server:
    def __init__(self, spark: SparkSession, root: str = "."):
        self.spark, self.root, self.sessions = spark, root, Sessions()

    def tools(self) -> dict[str, tuple[str, tuple[str, ...]]]:
        """name: what it does, and the arguments it needs."""
        out = {"open": ("opens a file or glob as a session", ("path",)), "close": ("forgets a session", ("session",)), "markdown": ("the documents as Markdown", ("session",)), "search": ("lines that hold a text", ("session", "query")), "convert": ("writes the documents in another format", ("session", "format", "output")), "diff": ("what changes from one session's documents to the other's", ("session", "other")), "merge": ("PDF files as one", ("paths", "output")), "validate": ("breaches of pdf_a or pdf_ua", ("path", "standard"))}
        out |= {n: (f"{n} of the documents", ("session",)) for n in TABLES}
        return out | {n: (f"{n} on a PDF file", ("path", "output", *needs)) for n, (_, needs) in EDITS.items()}

    def call(self, name: str, a: dict[str, Any]) -> Any:
        if name not in self.tools():
            raise ToolError(f"there is no tool {name}")
        if lacking := [k for k in self.tools()[name][1] if k not in a]:
            raise ToolError(f"{name} needs {lacking[0]}")
        if name == "open":
            path = inside(self.root, a["path"])
            docs = reader.open_files(self.spark, path, password=a.get("password")).stored()
            return {"session": self.sessions.add(docs, path), "files": self._rows(docs.files.select("doc_id", "format", "page_count", "error.message"))}
        if name == "close":
            return {"closed": self.sessions.held.pop(a["session"], None) is not None}
        if name in TABLES:
            return self._rows(getattr(self.sessions.get(a["session"]).docs, TABLES[name]))
        if name == "markdown":
            return self._rows(self.sessions.get(a["session"]).docs.markdown())
        if name == "search":
            found = search.hits(self._lines(a["session"]), a["query"], bool(a.get("regex")), not a.get("ignore_case"))
            return self._rows(found)
        if name == "diff":
            one = lambda s: self._lines(s).withColumn("doc_id", F.lit(0))
            return self._rows(compare.diff_lines(one(a["session"]), one(a["other"])))
        if name == "convert":
            out = [inside(self.root, a["output"])]
            rows = convert.convert(self.sessions.get(a["session"]).docs.parsed, a["format"]).limit(2).collect()
            if len(rows) != 1:
                raise ToolError("the session must have one document")
            if rows[0].error:
                raise ToolError(rows[0].error)
            storage.put(out[0], bytes(rows[0].content))
            return {"output": out[0]}
        if name == "merge":
            storage.put(inside(self.root, a["output"]), pdfedit.merge([storage.get(inside(self.root, p)) for p in a["paths"]]))
            return {"output": inside(self.root, a["output"])}
        if name == "validate":
            files = self.spark.read.format("binaryFile").load(inside(self.root, a["path"])).select(F.col("path").alias("doc_id"), "content")
            return self._rows(pdfsets.issues(files, a["standard"], a.get("level", "1b")))
        made = EDITS[name][0](storage.get(inside(self.root, a["path"])), **{k: v for k, v in a.items() if k not in ("path", "output")})
        storage.put(inside(self.root, a["output"]), made[0] if isinstance(made, tuple) else made)
        return {"output": inside(self.root, a["output"])} | ({"also": made[1]} if isinstance(made, tuple) else {})

    def _lines(self, session: str) -> DataFrame:
        return self.sessions.get(session).docs.texts.select("doc_id", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "text"))

    @staticmethod
    def _rows(df: DataFrame) -> dict:
        """The first ROWS rows, and whether there are more: an answer is read by a model."""
        found = df.limit(ROWS + 1).collect()
        size = lambda v: f"{len(v)} bytes" if isinstance(v, (bytes, bytearray)) else v
        return {"rows": [{k: size(v) for k, v in r.asDict(recursive=True).items()} for r in found[:ROWS]], "more": len(found) > ROWS}

    def answer(self, request: dict) -> dict | None:
        """The response to one request; None for a notification."""
        method, params, ident = request.get("method"), request.get("params") or {}, request.get("id")
        if ident is None:
            return None
        reply = {"jsonrpc": "2.0", "id": ident}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quire", "version": "1"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": what, "inputSchema": {"type": "object", "properties": {k: {} for k in needs}, "required": list(needs)}} for n, (what, needs) in self.tools().items()]}}
        if method == "tools/call":
            try:
                found, failed = self.call(params.get("name", ""), params.get("arguments") or {}), False
            except Exception as e:  # a failed tool is an answer
                found, failed = str(e), True
            return reply | {"result": {"content": [{"type": "text", "text": found if failed else json.dumps(found, ensure_ascii=False, default=str)}], "isError": failed}}
        return reply | {"error": {"code": -32601, "message": f"no such method: {method}"}}


def main() -> None:
    spark = SparkSession.builder.master(os.environ.get("QUIRE_MASTER", "local[*]")).config("spark.ui.enabled", "false").getOrCreate()
    server = Server(spark, sys.argv[1] if len(sys.argv) > 1 else ".")
    for line in sys.stdin:
        try:
            response = server.answer(json.loads(line))
        except ValueError:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if response is not None:
            print(json.dumps(response, ensure_ascii=False), flush=True)


if __name__ == "__main__":
    main()
