"""The verbs as tools over JSON-RPC lines on standard streams."""

from __future__ import annotations

import json
from typing import IO, Any

TOOLS = {
    "rag.query": ("query", "Hybrid search with an answer draft and citations", {"query": "string", "filters": "object", "top_k": "integer"}),
    "rag.search": ("search", "Scored chunks of a hybrid search", {"query": "string", "filters": "object", "top_k": "integer"}),
    "rag.note_context": ("note_context", "A note's chunks and links", {"note_path": "string"}),
    "rag.sync": ("sync", "Bring the index up to date", {"mode": "string", "file_path": "string"}),
    "rag.status": ("status", "Size and state of the index", {}),
    "rag.health": ("health", "Whether the parts can be reached", {}),
}


def handle(index, message: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to one message; none to a notification."""
    method, params, ident = message.get("method"), message.get("params") or {}, message.get("id")
    if ident is None:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": ident}
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "marginalia", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in a.items()}}} for n, (_, d, a) in TOOLS.items()]}
        elif method == "tools/call":
            if params.get("name") not in TOOLS:
                raise KeyError(f"no such tool: {params.get('name')}")
            value = getattr(index, TOOLS[params["name"]][0])(**(params.get("arguments") or {}))
            result = {"content": [{"type": "text", "text": json.dumps(value, default=str)}]}
        else:
            return reply | {"error": {"code": -32601, "message": f"no such method: {method}"}}
        return reply | {"result": result}
    except Exception as e:  # a tool's failure is the caller's answer
        return reply | {"error": {"code": -32000, "message": str(e)}}


def serve(index, lines: IO[str], out: IO[str]) -> None:
    for line in lines:
        if line.strip():
            answer = handle(index, json.loads(line))
            if answer is not None:
                out.write(json.dumps(answer) + "\n")
                out.flush()
