"""Where bytes come from: exactly the asked-for bytes, or an error; never fewer.

`open_source` takes a path (read by seek), bytes, a file object, a URL (read by HTTP ranges) or anything with
byte_length and read(offset, length).
"""

from __future__ import annotations

import os
import stat
import threading
from collections import OrderedDict
from collections.abc import Callable

from ..errors import SourceError


def check_range(offset: int, length: int, byte_length: int) -> None:
    for name, value in (("offset", offset), ("length", length)):
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 2**53:
            raise ValueError(f"{name} must be a non-negative integer, not {value!r}")
    if offset + length > byte_length:
        raise SourceError(f"bytes {offset}..{offset + length} reach past the source's {byte_length}")


def check_exact(data: bytes, offset: int, length: int) -> bytes:
    if len(data) != length:
        raise SourceError(f"{len(data)} bytes came for the {length} at {offset}")
    return data


class BytesSource:
    def __init__(self, data):
        if not isinstance(data, bytes | bytearray | memoryview):
            raise TypeError(f"bytes are needed, not {type(data).__name__}")
        self._data = memoryview(data)
        self.byte_length = len(self._data)

    def read(self, offset: int, length: int) -> bytes:
        check_range(offset, length, self.byte_length)
        return bytes(self._data[offset : offset + length])

    def close(self) -> None:
        pass


class SliceSource:
    """The head of a source and one stretch of it, in a task that was sent no more."""

    def __init__(self, head: bytes, offset: int, data: bytes, byte_length: int):
        self._parts, self.byte_length = ((0, head), (offset, data)), byte_length

    def read(self, offset: int, length: int) -> bytes:
        check_range(offset, length, self.byte_length)
        for start, data in self._parts:
            if start <= offset and offset + length <= start + len(data):
                return data[offset - start : offset - start + length]
        raise SourceError(f"bytes {offset}..{offset + length} weren't sent")

    def close(self) -> None:
        pass


class HandleSource:
    """An open binary file, or anything that can seek and read; short reads are continued until the end."""

    def __init__(self, handle, byte_length: int | None = None):
        self._handle, self._lock = handle, threading.Lock()
        self.byte_length = handle.seek(0, os.SEEK_END) if byte_length is None else byte_length

    def read(self, offset: int, length: int) -> bytes:
        check_range(offset, length, self.byte_length)
        with self._lock:
            self._handle.seek(offset)
            parts, left = [], length
            while left and (part := self._handle.read(left)):
                parts.append(part)
                left -= len(part)
        return check_exact(b"".join(parts), offset, length)

    def close(self) -> None:
        self._handle.close()


class FileSource(HandleSource):
    def __init__(self, path: str):
        path = path.removeprefix("file://")
        try:
            found = os.stat(path)
            if not stat.S_ISREG(found.st_mode):
                raise SourceError(f"{path} isn't a regular file")
            super().__init__(open(path, "rb"), found.st_size)
        except OSError as e:
            raise SourceError(f"{path}: {e}") from e


class HttpSource:
    """Ranges of a URL. fetch(url, method, headers) gives (status, headers, body); by default urllib does."""

    def __init__(self, url: str, fetch: Callable | None = None, headers: dict | None = None, concurrency: int = 4, allow_full_download: bool = False):
        self.url, self._fetch, self._headers = str(getattr(url, "href", url)), fetch or _urllib_fetch, dict(headers or {})
        self._gate, self._full, self._whole = threading.Semaphore(concurrency), allow_full_download, None
        status, found, _ = self._call("HEAD", {})
        size = _header(found, "content-length") if 200 <= status < 300 else None
        if size is None or not size.isdigit():
            status, found, body = self._call("GET", {"Range": "bytes=0-0"})
            total = (_header(found, "content-range") or "").rpartition("/")[2] if status == 206 else ""
            if status == 200 and allow_full_download:
                self._whole, size = body, str(len(body))
            elif total.isdigit():
                size = total
            else:
                raise SourceError(f"{self.url}: the server tells no length (status {status})")
        self.byte_length = int(size)

    def _call(self, method: str, headers: dict) -> tuple:
        with self._gate:
            try:
                return self._fetch(self.url, method, {**self._headers, **headers})
            except OSError as e:
                raise SourceError(f"{self.url}: {e}") from e

    def read(self, offset: int, length: int) -> bytes:
        check_range(offset, length, self.byte_length)
        if not length:
            return b""
        if self._whole is None:
            status, found, body = self._call("GET", {"Range": f"bytes={offset}-{offset + length - 1}"})
            if status == 206:
                said = (_header(found, "content-range") or "").removeprefix("bytes ").partition("/")[0]
                if said and said != f"{offset}-{offset + length - 1}":
                    raise SourceError(f"{self.url}: asked for {offset}-{offset + length - 1}, got {said}")
                return check_exact(body, offset, length)
            if status != 200 or not self._full:
                raise SourceError(f"{self.url}: status {status} for a range; allow_full_download reads the whole instead")
            self._whole = check_exact(body, 0, self.byte_length)
        return self._whole[offset : offset + length]

    def close(self) -> None:
        self._whole = None


def _header(headers, name: str) -> str | None:
    return next((v for k, v in dict(headers).items() if k.lower() == name), None)


def _urllib_fetch(url: str, method: str, headers: dict) -> tuple:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers), timeout=60) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class CachedSource:
    """Least recently used blocks of another source. Reads larger than the cache go past it."""

    def __init__(self, source, block_bytes: int = 1 << 20, max_bytes: int = 64 << 20):
        if block_bytes <= 0 or max_bytes < 0:
            raise ValueError("block_bytes must be positive and max_bytes not negative")
        self.source, self.byte_length = source, source.byte_length
        self._size, self._most = block_bytes, max_bytes // block_bytes
        self._blocks: OrderedDict[int, bytes] = OrderedDict()
        self._lock = threading.Lock()

    def read(self, offset: int, length: int) -> bytes:
        check_range(offset, length, self.byte_length)
        first, last = offset // self._size, (offset + length - 1) // self._size
        if not length or last - first + 1 > self._most:
            return self.source.read(offset, length) if length else b""
        with self._lock:
            have = {}
            missing = [b for b in range(first, last + 1) if b not in self._blocks]
            while missing:  # neighbours are fetched by one read
                run = [missing.pop(0)]
                while missing and missing[0] == run[-1] + 1:
                    run.append(missing.pop(0))
                at = run[0] * self._size
                data = self.source.read(at, min((run[-1] + 1) * self._size, self.byte_length) - at)
                have |= {b: data[(b - run[0]) * self._size :][: self._size] for b in run}
            for b in range(first, last + 1):
                have.setdefault(b, self._blocks.get(b))
                self._blocks[b] = have[b]
                self._blocks.move_to_end(b)
            while len(self._blocks) > self._most:
                self._blocks.popitem(last=False)
        joined = b"".join(have[b] for b in range(first, last + 1))
        return joined[offset - first * self._size :][:length]

    def close(self) -> None:
        self._blocks.clear()
        self.source.close()


def open_source(what):
    if isinstance(what, str | os.PathLike):
        path = os.fspath(what)
        return HttpSource(path) if path.startswith(("http://", "https://")) else FileSource(path)
    if isinstance(what, bytes | bytearray | memoryview):
        return BytesSource(what)
    if hasattr(what, "byte_length") and hasattr(what, "read"):
        return what
    if hasattr(what, "seek") and hasattr(what, "read"):
        return HandleSource(what)
    raise TypeError(f"nothing to read bytes from: {type(what).__name__}")
