"""The tools for other programs: JSON-RPC 2.0 by the Model Context Protocol, over standard input and output (a message a line) or over HTTP (POST, an answer each), and the command
line that starts it. Tools and their arguments are those of the methods of ``Tools``."""

from __future__ import annotations

import argparse
import inspect
import json
import sys
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO

from .api import Tools
from .config import load_config

VERSION = "2025-03-26"
#: The seventeen tools.
NAMES = (
    "index_project", "reindex_file", "delete_project", "clear_index", "search_code", "get_function_details", "find_type_definition", "find_implementations", "get_code_context", "project_map", "file_tree", "list_package_exports",
    "dependency_graph", "project_stats", "watch_directory", "diagnose", "get_model_status",
)
#: JSON types of the annotations that occur.
TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list[str]": "array"}
PARSE, REQUEST, METHOD, PARAMS = -32700, -32600, -32601, -32602


def described(name: str, f: Callable) -> dict:
    """A tool as the protocol lists it."""
    fields, needed = {}, []
    for p in list(inspect.signature(f).parameters.values()):
        if p.kind is not p.POSITIONAL_OR_KEYWORD:
            continue
        kind = TYPES.get(str(p.annotation).removesuffix(" | None"), "string")
        fields[p.name] = {"type": kind} | ({"items": {"type": "string"}} if kind == "array" else {})
        if p.default is p.empty:
            needed.append(p.name)
        elif p.default is not None:
            fields[p.name]["default"] = p.default
    if name == "search_code":
        fields |= {"tag_filter": {"type": "array", "items": {"type": "string"}}, "tags_mode": {"type": "string", "enum": ["any", "all"], "default": "any"}}
    return {"name": name, "description": inspect.getdoc(f) or name.replace("_", " "), "inputSchema": {"type": "object", "properties": fields, "required": needed, "additionalProperties": False}}


class Server:
    def __init__(self, tools: Tools):
        self.tools, self._one = tools, threading.Lock()
        self.listed = {name: described(name, getattr(tools, name)) for name in NAMES}

    def call(self, name: str, arguments: dict[str, Any]) -> dict:
        """The answer of a tool as content; an error of the tool is an answer, too."""
        with self._one:  # one writer at a time
            try:
                value, failed = getattr(self.tools, name)(**arguments), False
            except Exception as e:
                value, failed = str(e), True
        return {"content": [{"type": "text", "text": value if isinstance(value, str) else json.dumps(value, default=str)}], "isError": failed}

    def answer(self, message: Any) -> Any:
        """The answer to a message, or to a batch of them; None to notifications."""
        if isinstance(message, list) and message:
            return [a for m in message if (a := self.answer(m)) is not None] or None
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": REQUEST, "message": "no JSON-RPC 2.0 request"}}
        method, told = message["method"], message.get("params") or {}
        if "id" not in message:
            return None
        out: dict = {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            return out | {"result": {"protocolVersion": told.get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "0"}}}
        if method == "ping":
            return out | {"result": {}}
        if method == "tools/list":
            return out | {"result": {"tools": list(self.listed.values())}}
        if method != "tools/call":
            return out | {"error": {"code": METHOD, "message": f"no method {method}"}}
        name, arguments = told.get("name"), told.get("arguments") or {}
        if name not in self.listed:
            return out | {"error": {"code": PARAMS, "message": f"no tool {name}"}}
        form = self.listed[name]["inputSchema"]
        wrong = sorted(set(arguments) - set(form["properties"])) + [n for n in form["required"] if n not in arguments]
        if wrong:
            return out | {"error": {"code": PARAMS, "message": f"unknown or missing arguments of {name}: {', '.join(wrong)}"}}
        return out | {"result": self.call(name, arguments)}

    def answered(self, text: str | bytes) -> str | None:
        try:
            message = json.loads(text)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "no JSON"}})
        out = self.answer(message)
        return None if out is None else json.dumps(out)

    def over_lines(self, source: TextIO, sink: TextIO) -> None:
        for line in source:
            if line.strip() and (out := self.answered(line)) is not None:
                sink.write(out + "\n")
                sink.flush()

    def over_http(self, host: str, port: int) -> ThreadingHTTPServer:
        """A server that is ready to ``serve_forever``."""
        answered = self.answered

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                out = answered(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                data = (out or "").encode()
                self.send_response(200 if out else 202)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *said) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    """``python -m lodestone --config settings.yaml --transport stdio``"""
    parser = argparse.ArgumentParser(prog="lodestone", description="Code index tools over JSON-RPC.")
    parser.add_argument("--config", help="a YAML file of settings")
    parser.add_argument("--transport", default="stdio", choices=["stdio", "http"])
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=3005)
    told = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    # Messages own the standard output.
    sink, sys.stdout = sys.stdout, sys.stderr
    spark = SparkSession.builder.appName("lodestone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    from .operators import embed

    config = load_config(told.config)
    model = config.model
    server = Server(Tools(spark, config, embed.HttpEmbedder(model.base_url, model.embed_model, model.embed_timeout_s, model.max_retries) if told.config else None))
    try:
        if told.transport == "stdio":
            server.over_lines(sys.stdin, sink)
        else:
            server.over_http(told.host, told.port).serve_forever()
    finally:
        server.tools.watchers.shutdown()
        spark.stop()
