"""A tool server: JSON-RPC requests, one a line, from one stream, and answers to another; analyses stay warm between them.

Methods: initialize, ping, tools/list, tools/call (name, arguments) and shutdown. A request without an
id gets no answer. What a tool can't do is an answer with isError and one line of text; what isn't a
request, a method or a tool's arguments is an error of the protocol.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from heftgraph import tools
from heftgraph.analysis import Analysis
from heftgraph.cli import VERSION
from heftgraph.operators import storage, texts
from heftgraph.operators.budget import Budget
from heftgraph.operators.policy import Policy

#: The version of the protocol, and its codes of errors.
PROTOCOL = "2025-06-18"
NOT_JSON, NO_REQUEST, NO_METHOD, NO_ARGUMENTS = -32700, -32600, -32601, -32602
#: Analyses that stay warm, the last ones that were asked for.
WARM = 8

_TEXT, _LIST = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
_FILES = {"binary": _TEXT, "listing": _TEXT, "dump": _TEXT, "sources": _TEXT, "controlled": _LIST, "lock": _LIST, "unlock": _LIST}
_BUILD = {"type": "object", "properties": _FILES, "required": ["binary", "listing"]}
_LIMITS = {"max_binary_size": _TEXT, "max_go_version": _TEXT, "deny": _LIST, "max_module_size": {"type": "object"}, "action": _TEXT, "on_disk": {"type": "boolean"}}
#: tool: (what it tells, its further arguments, those it needs).
ABOUT = {
    "anatomy": ("sizes by content and owner", {}, []),
    "size_targets": ("what leaves when dependencies are cut, and a plan", {}, []),
    "go_floor": ("the lowest version that dependencies allow", {}, []),
    "locate_cuts": ("one module in full", {"module": _TEXT}, ["module"]),
    "measure": ("the sizes and the version to hold a change against", {}, []),
    "diff": ("the change from another build", {"before": _BUILD}, ["before"]),
    "check": ("a build held against a budget", _LIMITS, []),
    "matrix": ("a build over platforms", {"cells": {"type": "object", "additionalProperties": _BUILD}}, ["cells"]),
}


class Wrong(Exception):
    """An error of the protocol."""

    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


class Warm:
    """Analyses by their files; the same files under another policy share what no policy changes.

    Where the name, length or time of change of a file differs from what was seen, the contents are
    hashed, and an analysis whose contents differ is thrown away.
    """

    def __init__(self, spark: SparkSession, most: int = WARM):
        self.spark, self.most = spark, most
        self._held: dict[tuple, dict] = {}

    def contents(self, paths: list[str]) -> str:
        """A hash of the names and contents of all files under paths."""
        files = self.spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(paths)
        each = files.select(F.concat_ws(":", "path", F.sha2("content", 256)).alias("x"))
        return each.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("x"))), 256)).first()[0]

    def get(self, files: dict) -> Analysis:
        named = tuple(files.get(k) or "" for k in ("binary", "listing", "dump", "sources"))
        paths = [p for p in named if p]
        seen = storage.fingerprint(self.spark, *paths)
        held = self._held.pop(named, None)
        if held and held["seen"] != seen:
            now = self.contents(paths)
            held = held | {"seen": seen} if now == held["contents"] else None
        if held is None:
            held = {"seen": seen, "contents": self.contents(paths), "by": {}, "first": None}
        policy = Policy(*(tuple(files.get(k) or ()) for k in ("controlled", "lock", "unlock")))
        if policy not in held["by"]:
            first = held["first"]
            made = first.reclassified(policy) if first else Analysis.of(self.spark, named[0], named[1], policy, named[2] or None, named[3] or None)
            held["by"][policy] = made
            held["first"] = first or made
        self._held[named] = held
        while len(self._held) > self.most:
            self._held.pop(next(iter(self._held)))
        return held["by"][policy]


class Server:
    def __init__(self, spark: SparkSession):
        self.warm = Warm(spark)
        self.methods: dict[str, Callable[[dict], dict]] = {"initialize": self._initialize, "ping": lambda _: {}, "tools/list": self._list, "tools/call": self._call, "shutdown": lambda _: {}}

    def _initialize(self, params: dict) -> dict:
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "heftgraph", "version": VERSION}}

    def _list(self, params: dict) -> dict:
        out = []
        for name, (text, more, needs) in ABOUT.items():
            own = {} if name == "matrix" else _FILES
            required = ([] if name == "matrix" else ["binary", "listing"]) + needs
            out.append({"name": name, "description": text, "inputSchema": {"type": "object", "properties": own | more, "required": required}})
        return {"tools": out}

    def _call(self, params: dict) -> dict:
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in ABOUT:
            raise Wrong(NO_ARGUMENTS, f"no tool {name!r}")
        (schema,) = (t["inputSchema"] for t in self._list({})["tools"] if t["name"] == name)
        missing = [k for k in schema["required"] if not given.get(k)]
        unknown = [k for k in given if k not in schema["properties"]]
        if missing or unknown:
            raise Wrong(NO_ARGUMENTS, "; ".join([*(f"{k} is missing" for k in missing), *(f"{k} is unknown" for k in unknown)]))
        try:
            answer = self._answer(name, given)
        except Exception as e:  # what a tool can't do is its answer
            return {"content": [{"type": "text", "text": texts.first_line(str(e)) or type(e).__name__}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(answer)}], "structuredContent": answer, "isError": False}

    def _answer(self, name: str, given: dict) -> dict:
        if name == "matrix":
            return tools.platform_matrix({label: lambda files=files: self.warm.get(files) for label, files in given["cells"].items()})
        a = self.warm.get(given)
        if name == "locate_cuts":
            return tools.locate_cuts(a, given["module"])
        if name == "diff":
            return tools.diff(a, self.warm.get(given["before"]))
        if name == "check":
            sizes = {k: str(v) for k, v in (given.get("max_module_size") or {}).items()}
            limits = Budget(given.get("max_binary_size") or "", given.get("max_go_version") or "", tuple(given.get("deny") or ()), sizes, given.get("action") or "")
            return tools.check(a, limits, bool(given.get("on_disk")))
        return tools.TOOLS[name](a)

    def handle(self, line: str) -> tuple[dict | None, bool]:
        """The answer to a line, if it asks for one, and whether it ends the server."""
        asked, name = None, None
        try:
            try:
                request = json.loads(line)
            except ValueError as e:
                raise Wrong(NOT_JSON, "not JSON") from e
            if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
                asked = request.get("id") if isinstance(request, dict) else None
                raise Wrong(NO_REQUEST, "not a request")
            asked, name = request.get("id"), request["method"]
            if name not in self.methods:
                raise Wrong(NO_METHOD, f"no method {name!r}")
            params = request.get("params") or {}
            if not isinstance(params, dict):
                raise Wrong(NO_ARGUMENTS, "params must be an object")
            result = self.methods[name](params)
        except Wrong as e:
            if name is not None and asked is None:  # a notification
                return None, False
            return {"jsonrpc": "2.0", "id": asked, "error": {"code": e.code, "message": str(e)}}, False
        return (None if asked is None else {"jsonrpc": "2.0", "id": asked, "result": result}), name == "shutdown"

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        """Answer every line until the source or a shutdown ends it."""
        for line in source:
            if not line.strip():
                continue
            answer, over = self.handle(line)
            if answer is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()
            if over:
                return
