"""Files of web servers as a data source: one partition per address, read by byte ranges.

``spark.dataSource.register(HttpFiles)``, then ``spark.read.format("http_files").option("urls", "...").load()`` gives
(url, length, content). Only HTTPS addresses of public hosts are read, unless ``allowPrivate`` is true.
"""

from __future__ import annotations

import ipaddress
import json
import socket
import urllib.parse
import urllib.request
from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK, CACHED_BLOCKS, MOST = 64 << 10, 64, 1 << 30
_LOCAL = ("localhost", "metadata.google.internal")


def check_address(url: str, allow_private: bool = False) -> None:
    """Raise for addresses that aren't HTTPS or whose host is, or resolves to, a private, local or metadata address."""
    parts = urllib.parse.urlsplit(url)
    if allow_private:
        if parts.scheme not in ("http", "https"):
            raise ValueError(f"not an address of a web server: {parts.scheme}")
        return
    if parts.scheme != "https":
        raise ValueError("only https addresses are read")
    host = (parts.hostname or "").rstrip(".").lower()
    if not host or host in _LOCAL or host.endswith((".local", ".internal", ".localhost")):
        raise ValueError("the host is local")
    try:
        found = [ipaddress.ip_address(host)]
    except ValueError:
        found = [ipaddress.ip_address(x[4][0]) for x in socket.getaddrinfo(host, parts.port or 443, proto=socket.IPPROTO_TCP)]
    if any(not a.is_global or a.is_multicast for a in found):
        raise ValueError("the host's address is not public")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """Redirects are checked like first addresses."""

    def __init__(self, allow_private: bool) -> None:
        self.allow_private = allow_private

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        check_address(newurl, self.allow_private)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


class RangeReader:
    """Reads of (offset, length) from one address, in blocks that are kept; a run of missing blocks is one request."""

    def __init__(self, url: str, headers: dict[str, str] | None = None, allow_private: bool = False, timeout: float = 30) -> None:
        check_address(url, allow_private)
        self.url, self.headers, self.timeout = url, headers or {}, timeout
        self.opener = urllib.request.build_opener(_NoRedirect(allow_private))
        self.blocks: OrderedDict[int, bytes] = OrderedDict()
        self.requests = 0
        self.whole: bytes | None = None
        with self._open({"Range": "bytes=0-0"}) as r:
            if r.status == 206:
                self.length = int(r.headers["Content-Range"].rpartition("/")[2])
                r.read()
            else:  # no ranges here: the one answer holds all
                self.whole = r.read(MOST + 1)
                self.length = len(self.whole)
        if self.length > MOST:
            raise ValueError("the file is larger than the limit")

    def _open(self, more: dict[str, str]):
        self.requests += 1
        return self.opener.open(urllib.request.Request(self.url, headers={**self.headers, **more}), timeout=self.timeout)

    def read(self, offset: int, length: int) -> bytes:
        end = min(offset + length, self.length)
        if offset >= end:
            return b""
        if self.whole is not None:
            return self.whole[offset:end]
        first, last = offset // BLOCK, (end - 1) // BLOCK
        got: dict[int, bytes] = {}
        i = first
        while i <= last:
            if i in self.blocks:
                self.blocks.move_to_end(i)
                got[i] = self.blocks[i]
                i += 1
                continue
            j = i
            while j < last and j + 1 not in self.blocks:
                j += 1
            with self._open({"Range": f"bytes={i * BLOCK}-{min((j + 1) * BLOCK, self.length) - 1}"}) as r:
                data = r.read()
            for k in range(i, j + 1):
                got[k] = self.blocks[k] = data[(k - i) * BLOCK : (k - i + 1) * BLOCK]
            i = j + 1
        while len(self.blocks) > CACHED_BLOCKS:
            self.blocks.popitem(last=False)
        body = b"".join(got[k] for k in range(first, last + 1))
        return body[offset - first * BLOCK : end - first * BLOCK]


class Address(InputPartition):
    def __init__(self, url: str) -> None:
        super().__init__(url)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", options.get("path", "")).split() if u]
        self.headers = json.loads(options.get("headers", "{}"))
        self.allow_private = options.get("allowprivate", options.get("allowPrivate", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [Address(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Address):
            return
        r = RangeReader(partition.value, self.headers, self.allow_private)
        yield partition.value, r.length, r.read(0, r.length)


class HttpFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_files"

    def schema(self) -> str:
        return "url string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)
