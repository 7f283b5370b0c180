"""A web server that gives ranges of the files of one folder, for fixtures."""

from __future__ import annotations

import http.server
import os
import threading

_running: dict[tuple[str, str], int] = {}


class _Ranges(http.server.BaseHTTPRequestHandler):
    folder = ""

    def _file(self) -> str | None:
        path = os.path.join(self.folder, os.path.basename(self.path))
        return path if os.path.isfile(path) else None

    def do_HEAD(self):
        path = self._file()
        self.send_response(200 if path else 404)
        self.send_header("Content-Length", str(os.path.getsize(path) if path else 0))
        self.end_headers()

    def do_GET(self):
        path, asked = self._file(), self.headers.get("Range", "")
        if not path or not asked.startswith("bytes="):
            self.send_error(404 if not path else 416)
            return
        size = os.path.getsize(path)
        first, last = (int(x) for x in asked.removeprefix("bytes=").split("-"))
        with open(path, "rb") as file:
            file.seek(first)
            data = file.read(last - first + 1)
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {first}-{first + len(data) - 1}/{size}")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


def serve(folder: str, host: str = "127.0.0.1") -> list[str]:
    """URLs of the folder's files, served from this process as long as it lives."""
    if (folder, host) not in _running:
        server = http.server.ThreadingHTTPServer((host, 0), type("Handler", (_Ranges,), {"folder": folder}))
        threading.Thread(target=server.serve_forever, daemon=True).start()
        _running[folder, host] = server.server_port
    return [f"http://{host}:{_running[folder, host]}/{name}" for name in sorted(os.listdir(folder))]
