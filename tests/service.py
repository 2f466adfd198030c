"""An in-process service for the tests of the connector and the rounds."""

from __future__ import annotations

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


class Service:
    """Collections by name; how they are paged, what fails and whether keys are honoured is set by the test."""

    def __init__(self):
        self.data: dict[str, list] = {}
        self.style: dict[str, str] = {}
        self.size = 2
        self.honours = True
        self.answered: dict[str, dict] = {}
        self.broken: set[str] = set()
        self.busy: list[str] = []
        self.calls: list[tuple[str, str]] = []
        self.lock = threading.Lock()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def answer(self, value, status=200, **headers):
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k.replace("_", "-"), v)
                self.end_headers()
                self.wfile.write(json.dumps(value).encode())

            def do_GET(self):
                with service.lock:
                    service.calls.append(("GET", self.path))
                    if service.busy:
                        return self.answer({}, 429, Retry_After=service.busy.pop())
                    service.get(self)

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["content-length"])))
                with service.lock:
                    service.calls.append((self.command, self.path))
                    service.put(self, body)

            do_PUT = do_POST

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def get(self, handler) -> None:
        parts = urllib.parse.urlsplit(handler.path)
        asked = dict(urllib.parse.parse_qsl(parts.query))
        name, _, one = parts.path.strip("/").partition("/")
        rows = self.data.get(name)
        if rows is None:
            return handler.answer({}, 404)
        if one:
            if one in self.broken:
                return handler.answer({"error": 1}, 500)
            found = [r for r in rows if str(r["id"]) == urllib.parse.unquote(one)]
            return handler.answer(found[0] if found else {}, 200 if found else 404)
        style, n = self.style.get(name, "whole"), int(asked.get("per_page", self.size))
        page = int(asked.get("page", 1))
        at = int(asked.get("offset", 0)) if "offset" in asked else (page - 1) * n
        part, pages = rows[at : at + n], max(1, -(-len(rows) // n))
        link = lambda rel, k: f'<{self.url}/{name}?page={k}&per_page={n}>; rel="{rel}"'
        if style == "whole":
            handler.answer(rows)
        elif style in ("page", "offset"):
            handler.answer(part)
        elif style == "clamped":  # pages beyond the last show the last
            handler.answer(part or rows[(pages - 1) * n :])
        elif style == "last":
            handler.answer(part, Link=link("last", pages))
        elif style == "total":
            handler.answer({"data": part}, X_Total_Count=str(len(rows)))
        elif style == "next":
            handler.answer(part, **({"Link": link("next", page + 1)} if page < pages else {}))
        elif style == "cursor":
            at = int(asked.get("cursor", "/0")[1:])
            handler.answer({"items": rows[at : at + n], "meta": {"next_cursor": f"/{at + n}" if at + n < len(rows) else None}})
        elif style == "circle":
            handler.answer({"items": part, "next": f"{self.url}/{name}?page=1"})

    def put(self, handler, body) -> None:
        key = handler.headers["idempotency-key"]
        name, _, at = handler.path.strip("/").partition("/")
        if any(v in self.broken for v in body.values()):
            return handler.answer({"error": 1}, 500)
        if not (self.honours and key in self.answered):
            rows = self.data[name]
            if handler.command == "POST":
                body = {"id": f"{name[0]}{len(rows) + 1}"} | body
                rows.append(body)
            else:
                rows[:] = [body if str(r["id"]) == urllib.parse.unquote(at) else r for r in rows]
            self.answered[key] = body
        handler.answer(self.answered[key])


def description(kind: str, query: tuple[str, ...] = (), keys: bool = False, one: bool = False) -> str:
    """A description of a collection with create and update, its paging parameters and its header of keys."""
    at = [{"name": "id", "in": "path", "required": True}]
    item = {"put": {"parameters": at, "responses": {}}} | ({"get": {"parameters": at, "responses": {}}} if one else {})
    header = [{"name": "Idempotency-Key", "in": "header"}] if keys else []
    paths = {f"/{kind}": {"get": {"parameters": [{"name": q, "in": "query"} for q in query], "responses": {}}, "post": {"parameters": header, "responses": {}}}, f"/{kind}/{{id}}": item}
    return json.dumps({"openapi": "3.0.0", "info": {"title": kind}, "paths": paths})
