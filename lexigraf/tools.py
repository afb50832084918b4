"""The services as tools: JSON-RPC requests, a line each, over standard input and output.

``tools/list`` describes them and ``tools/call`` runs one; arguments are checked against
their schemas, texts are cut to ``MOST_CHARS``, and errors come back as text.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import IO, Any

from . import service
from .config import REPO, STORE
from .sources.store import VersionedStore

#: Characters of a text that a tool shows, and the bounds of arguments.
MOST_CHARS = 4000
BOUNDS = {"limit": (1, 20), "max_depth": (1, 6), "max_chains": (1, 50), "max_changes": (1, 200)}
DIRECTIONS = ["in", "out", "both"]


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    run: Callable[..., Any]
    required: tuple[str, ...]
    optional: dict[str, Any]

    def schema(self) -> dict:
        kinds = {str: "string", int: "integer", bool: "boolean"}
        fields: dict[str, dict] = {r: {"type": "string"} for r in self.required}
        for name, value in self.optional.items():
            fields[name] = {"type": kinds[type(value)], "default": value}
            if name in BOUNDS:
                fields[name] |= dict(zip(("minimum", "maximum"), BOUNDS[name], strict=True))
            if name == "direction":
                fields[name] |= {"enum": DIRECTIONS}
        return {"name": self.name, "description": self.about, "inputSchema": {"type": "object", "properties": fields, "required": list(self.required)}}

    def call(self, store: VersionedStore, arguments: dict) -> Any:
        if missing := [r for r in self.required if r not in arguments]:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")
        if unknown := set(arguments) - {*self.required, *self.optional}:
            raise ValueError(f"{self.name} has no {', '.join(sorted(unknown))}")
        given = {**self.optional, **arguments}
        for name, value in given.items():
            if name in BOUNDS:
                service.bounded(name, value, *BOUNDS[name])
            if name == "direction" and value not in DIRECTIONS:
                raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
        return shortened(self.run(store, **given))


def shortened(value: Any) -> Any:
    """Texts cut to ``MOST_CHARS``, however deep."""
    if isinstance(value, str):
        return value[:MOST_CHARS]
    if isinstance(value, dict):
        return {k: shortened(v) for k, v in value.items()}
    return [shortened(v) for v in value] if isinstance(value, (list, tuple)) else value


TOOLS = [
    Tool("search_code", "Search the code of the current version.", lambda s, query, limit: service.search(s, query, "HEAD", limit), ("query",), {"limit": 10}),
    Tool("search_at_version", "Search the code of a version.", lambda s, query, version, limit: service.search(s, query, version, limit), ("query", "version"), {"limit": 10}),
    Tool("search_history", "Search all indexed versions; copies count once.", lambda s, query, limit: service.search(s, query, "HEAD", limit, history=True), ("query",), {"limit": 10}),
    Tool("find_symbol", "Find the definitions of a symbol.", lambda s, name, version: service.find_symbol(s, name, version), ("name",), {"version": "HEAD"}),
    Tool(
        "find_dependencies", "Follow a symbol's calls, imports and other references, or what refers to it.",
        lambda s, name, version, direction, max_depth, max_chains: service.find_dependencies(s, name, version, direction, None, max_depth, max_chains),
        ("name",), {"version": "HEAD", "direction": "out", "max_depth": 3, "max_chains": 50},
    ),
    Tool("compare_versions", "Compare two versions symbol by symbol.", lambda s, base, head, max_changes: service.compare_versions(s, base, head, max_changes), ("base", "head"), {"max_changes": 50}),
    Tool("index_repository", "Index a version.", lambda s, version: vars(s.index_commit(version)), (), {"version": "HEAD"}),
]


class Server:
    def __init__(self, store: Callable[[], VersionedStore]):
        self.make, self.store, self.tools = store, None, {t.name: t for t in TOOLS}

    def answer(self, request: dict) -> dict | None:
        """The reply to a request; none to a notification."""
        if "id" not in request:
            return None
        method, params = request.get("method"), request.get("params") or {}
        reply: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "lexigraf", "version": "1"}, "capabilities": {"tools": {}}}}
        if method == "tools/list":
            return reply | {"result": {"tools": [t.schema() for t in TOOLS]}}
        if method == "ping":
            return reply | {"result": {}}
        if method != "tools/call" or params.get("name") not in self.tools:
            return reply | {"error": {"code": -32601, "message": f"unknown: {method} {params.get('name', '')}".strip()}}
        try:
            self.store = self.store or self.make()
            out, failed = self.tools[params["name"]].call(self.store, params.get("arguments") or {}), False
        except Exception as error:  # a tool's failure is an answer, not the end of the server
            out, failed = f"{type(error).__name__}: {str(error)[:MOST_CHARS]}", True
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(out, default=str)}], "isError": failed}}

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
                reply = self.answer(request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not an object"}}
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()


def main() -> None:
    from .session import session

    repo = os.path.abspath(os.environ.get(REPO, "."))
    Server(lambda: VersionedStore(session("tools"), os.environ.get(STORE) or f"file://{repo}/.lexigraf", repo)).serve(sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
