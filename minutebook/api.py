"""The parameters of each entry point: what they may be, what they are by default, and what an error says.

An entry is a table of fields; check() holds a request against it and gives typed values or raises ValueError. Nothing
here touches data.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping
from dataclasses import dataclass

from minutebook.functions.intent import FIRST_YEAR, LAST_YEAR

POSITIONS = ("aye", "no", "absent", "excused")


@dataclass(frozen=True)
class Field:
    name: str
    kind: type
    default: object = None
    least: int | None = None
    most: int | None = None
    among: tuple[str, ...] = ()
    required: bool = False

    def read(self, raw: str | None) -> object:
        if raw is None or raw == "":
            if self.required:
                raise ValueError(f"{self.name} is required")
            return self.default() if callable(self.default) else self.default
        if self.kind is bool:
            if raw not in ("true", "false", "1", "0"):
                raise ValueError(f"{self.name} is true or false")
            return raw in ("true", "1")
        if self.kind is int:
            if not re.fullmatch(r"\d{1,18}", raw):
                raise ValueError(f"{self.name} is a whole number")
            value, size = int(raw), int(raw)
        elif self.kind is datetime.datetime:
            return datetime.datetime.fromisoformat(raw)
        else:
            value = raw.strip()
            size = len(value)
        if self.among and value not in self.among:
            raise ValueError(f"{self.name} is one of {', '.join(self.among)}")
        if self.least is not None and size < self.least or self.most is not None and size > self.most:
            raise ValueError(f"{self.name} is {self.least} to {self.most}{'' if self.kind is int else ' characters'}")
        return value


def _text(name: str, least: int, most: int, required: bool = False) -> Field:
    return Field(name, str, None, least, most, required=required)


def _years(most: int = LAST_YEAR, default: object = LAST_YEAR) -> tuple[Field, ...]:
    return Field("from", int, FIRST_YEAR, FIRST_YEAR, most), Field("to", int, default, FIRST_YEAR, most)


_THIS_YEAR = lambda: datetime.date.today().year
_POSITION, _FINAL, _CURSOR = Field("position", str, among=POSITIONS), Field("final", bool, False), Field("cursor", int, 0, 0, None)
_FORMAT = Field("format", str, "json", among=("json", "md", "markdown"))
_VOTES = (_text("voter", 2, 100, True), _POSITION, *_years(2100, _THIS_YEAR), _FINAL, Field("limit", int, 100, 1, 1000))
_TEXT_SEARCH = (_text("q", 2, 300, True), *_years(), Field("limit", int, 20, 1, 50), _FORMAT)

ENTRIES: dict[str, tuple[Field, ...]] = {
    "query": (_text("q", 2, 500, True), _FORMAT),
    "search": (*_TEXT_SEARCH, Field("year", int, None, FIRST_YEAR, LAST_YEAR), Field("kind", str, among=("agenda", "minutes")), Field("type", str, "all", among=("all", "legislation", "votes", "comments", "pages")), _text("voter", 1, 80), _POSITION, _FINAL, Field("mode", str, "hybrid", among=("lexical", "hybrid"))),
    "items": (*_TEXT_SEARCH, _text("voter", 1, 80), _POSITION, _FINAL, Field("groupBy", str, "none", among=("none", "file", "matter"))),
    "comments": (*_TEXT_SEARCH, _text("speaker", 1, 80)),
    "aggregates/votes": (*_VOTES, Field("groupBy", str, "file", among=("file", "roll-call"))),
    "aggregates/housing": (*_VOTES, Field("groupBy", str, "file", among=("file",))),
    "snapshots": (Field("entity", str, required=True, among=("documents", "supervisors", "recorded-positions", "legislative-files")), _CURSOR, Field("limit", int, 1000, 1, 1000), Field("format", str, "json", among=("json", "ndjson"))),
    "changes": (_CURSOR, Field("since", datetime.datetime), Field("limit", int, 250, 1, 1000)),
    "quality": (),
    "documents": (Field("id", int, None, 1, None, required=True), _text("pages", 1, 20), _FORMAT),
    "documents/diff": (Field("id", int, None, 1, None, required=True), Field("from", int, None, 1, None, required=True), Field("to", int, None, 1, None, required=True)),
    "discover": (),
}

#: Tools of the JSON-RPC entry and the entry that each one is.
TOOLS = {"search_records": "search", "search_items": "items", "search_comments": "comments", "vote_aggregate": "aggregates/votes", "get_document": "documents", "get_changes": "changes"}


def check(entry: str, request: Mapping[str, str | None]) -> dict[str, object]:
    """The values of an entry's fields for a request, defaults filled in; fields that it doesn't know play no part. A
    year stands for both ends of the range; a position needs a voter, and a range has an order."""
    out = {f.name: f.read(request.get(f.name)) for f in ENTRIES[entry]}
    if out.get("year") is not None:
        out["from"] = out["to"] = out["year"]
    if entry == "documents/diff":
        if out["from"] == out["to"]:
            raise ValueError("from and to differ")
    elif "from" in out and out["from"] > out["to"]:
        raise ValueError("from is after to")
    if out.get("position") is not None and out.get("voter") is None:
        raise ValueError("a position needs a voter")
    return out


def call(message: Mapping, tools: Mapping) -> dict:
    """Answer a JSON-RPC message: initialize, ping, tools/list, or tools/call of one of `tools` (name to a function of
    the checked values that gives text). Errors are answers too."""
    reply = {"jsonrpc": "2.0", "id": message.get("id")}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2025-03-26"), "capabilities": {"tools": {}}, "serverInfo": {"name": "minutebook", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        kinds = {int: "integer", bool: "boolean"}
        schema = lambda e: {"type": "object", "properties": {f.name: {"type": kinds.get(f.kind, "string")} | ({"enum": list(f.among)} if f.among else {}) for f in ENTRIES[e]}, "required": [f.name for f in ENTRIES[e] if f.required]}
        return reply | {"result": {"tools": [{"name": n, "inputSchema": schema(e)} for n, e in TOOLS.items() if n in tools]}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": "unknown method"}}
    name = params.get("name")
    if name not in tools or name not in TOOLS:
        return reply | {"error": {"code": -32602, "message": "unknown tool"}}
    try:
        given = {k: None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for k, v in (params.get("arguments") or {}).items()}
        return reply | {"result": {"content": [{"type": "text", "text": tools[name](check(TOOLS[name], given))}]}}
    except ValueError as e:
        return reply | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
