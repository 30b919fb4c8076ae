"""The engine's tools for agents, over the public model context protocol: JSON-RPC 2.0 messages, one a line."""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable
from typing import TextIO

VERSION = "2025-03-26"
#: What each tool is for, as agents read it.
PURPOSES = {
    "semantic_code_search": "Search a project's code by meaning and by words. mode: auto, semantic, lexical or hybrid.",
    "get_symbol": "Find where a function, class or method of this name is defined.",
    "index": "Index a project, or bring its index up to date.",
    "status": "What of a project is indexed.",
}


def described(name: str, tool: Callable) -> dict:
    """A tool with the schema of its arguments, read from its signature."""
    kinds = {bool: "boolean", int: "integer"}
    arguments = inspect.signature(tool).parameters
    properties = {a: {"type": kinds.get(type(p.default), "string")} for a, p in arguments.items()}
    needed = [a for a, p in arguments.items() if p.default is inspect.Parameter.empty]
    return {"name": name, "description": PURPOSES.get(name, name), "inputSchema": {"type": "object", "properties": properties, "required": needed}}


class AgentServer:
    """``answer`` takes one message and gives the answer to it, or None for a notification."""

    def __init__(self, tools: dict[str, Callable]):
        self.tools = tools

    def answer(self, message: object) -> dict | None:
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        if "id" not in message:
            return None
        head = {"jsonrpc": "2.0", "id": message["id"]}
        method, given = message["method"], message.get("params") or {}
        if method == "initialize":
            return head | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "lakelens", "version": "1"}}}
        if method == "ping":
            return head | {"result": {}}
        if method == "tools/list":
            return head | {"result": {"tools": [described(n, f) for n, f in self.tools.items()]}}
        if method != "tools/call":
            return head | {"error": {"code": -32601, "message": f"unknown method {method}"}}
        name = given.get("name") if isinstance(given, dict) else None
        if name not in self.tools:
            return head | {"error": {"code": -32602, "message": f"unknown tool {name}"}}
        try:
            value, failed = self.tools[name](**(given.get("arguments") or {})), False
        except Exception as problem:  # the agent reads what went wrong
            value, failed = str(problem), True
        text = value if isinstance(value, str) else json.dumps(value, default=str)
        return head | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}

    def serve(self, lines: TextIO | None = None, out: TextIO | None = None) -> None:
        for line in lines or sys.stdin:
            if not line.strip():
                continue
            try:
                answer = self.answer(json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if answer is not None:
                print(json.dumps(answer), file=out or sys.stdout, flush=True)
