"""A small HTTP server over a collected report.

Everything it can answer is fixed when it starts: a table of paths, each with a content type and a body.
"""

from __future__ import annotations

import json
import mimetypes
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

STATIC = Path(__file__).resolve().parent / "static"
JSON = "application/json"


def routes(report: dict, static: Path = STATIC) -> dict[str, tuple[str, bytes]]:
    """Content type and body by path: the page's files, the report, and a sign of life."""
    table = {f"/{f.relative_to(static).as_posix()}": (mimetypes.guess_type(f.name)[0] or "application/octet-stream", f.read_bytes()) for f in sorted(static.rglob("*")) if f.is_file()}
    if "/index.html" in table:
        table["/"] = table["/index.html"]
    table["/api/graph"] = JSON, json.dumps(report).encode()
    table["/api/health"] = JSON, json.dumps({"status": "ok"}, separators=(",", ":")).encode()
    return table


class _Answer(BaseHTTPRequestHandler):
    """Looks the path up in the server's table."""

    def _send(self, with_body: bool) -> None:
        found = self.server.table.get(self.path.partition("?")[0])
        kind, body = found or ("text/plain; charset=utf-8", b"not found\n")
        self.send_response(HTTPStatus.OK if found else HTTPStatus.NOT_FOUND)
        for name, value in (("Content-Type", kind), ("Content-Length", str(len(body))), ("Cache-Control", "no-store")):
            self.send_header(name, value)
        self.end_headers()
        if with_body:
            self.wfile.write(body)

    def do_GET(self) -> None:  # noqa: N802
        self._send(True)

    def do_HEAD(self) -> None:  # noqa: N802
        self._send(False)

    def log_request(self, code="-", size="-") -> None:
        """Requests aren't logged; errors are."""


class Server(ThreadingHTTPServer):
    def __init__(self, report: dict, port: int = 3000, host: str = "127.0.0.1", static: Path = STATIC):
        super().__init__((host, port), _Answer)
        self.table = routes(report, static)


def server(report: dict, port: int = 3000, host: str = "127.0.0.1", static: Path = STATIC) -> Server:
    """A server of this machine only, unless another host is asked for."""
    return Server(report, port, host, static)
