"""A small HTTP front end: / and /search give pages, /api/search gives JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from lyrebird.operators.index import Index
from lyrebird.operators.search import Response, page_count, search
from lyrebird.sources.reports import result_page, start_page


def _number(text: str | None, default: int) -> int:
    """A whole number, or the default if there is none."""
    try:
        return int(text) if text else default
    except ValueError:
        return default


def answer(index: Index, target: str) -> tuple[int, str, str]:
    """Status, content type and body for a request's target."""
    url = urlsplit(target)
    args = {k: v[0] for k, v in parse_qs(url.query).items()}
    query, limit, page = args.get("q", ""), max(0, _number(args.get("limit"), 50)), _number(args.get("page"), 1)
    if url.path == "/":
        return 200, "text/html; charset=utf-8", start_page()
    if url.path not in ("/search", "/api/search"):
        return 404, "text/plain", "not found"
    if url.path == "/search":
        limit = 50
    found = search(index, query, limit, (page - 1) * limit) if page >= 1 else Response(query, search(index, query, 0).total_count, 0.0, [])
    if url.path == "/search":
        return 200, "text/html; charset=utf-8", result_page(query, found.total_count, found.results, page, page_count(found.total_count), found.query_time_ms)
    results = [{"title": r["title"], "url": r["url"]} for r in found.results]
    body = {"query": query, "total": found.total_count, "time_ms": round(found.query_time_ms, 3), "results": results}
    return 200, "application/json; charset=utf-8", json.dumps(body, ensure_ascii=False)


def serve(index: Index, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server for the index; ``serve_forever`` starts it. The documents are cached, postings are looked up by term."""
    index.docs.cache()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, kind, body = answer(index, self.path)
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
