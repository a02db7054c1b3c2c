"""The service over HTTP, with the standard library's server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from tessera.plans.serve import Service


def server(service: Service, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server whose GET requests go to Service.handle; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            at = urlsplit(self.path)
            status, body = service.handle(at.path, dict(parse_qsl(at.query)))
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
