"""File systems behind a path or URI."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

from pyarrow import fs as pafs


def is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def open_storage(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a local path or of any URI Arrow knows."""
    if is_uri(path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def is_local(storage: pafs.FileSystem) -> bool:
    return isinstance(storage, pafs.LocalFileSystem)


@dataclass(frozen=True)
class Root:
    """How plain paths of a storage become URIs again: with its scheme, host and options."""

    prefix: str = ""
    suffix: str = ""
    quoted: bool = False

    def uri(self, plain: str) -> str:
        return self.prefix + (quote(plain) if self.quoted else plain) + self.suffix


def host_of(netloc: str) -> str:
    return netloc.rsplit("@", 1)[-1]


def root_of(path: str, plain: str) -> Root:
    """``plain`` is what the storage of ``path`` calls it; buckets are its first part, other hosts are not."""
    if not is_uri(path):
        return Root()
    parts = urlsplit(path)
    host = host_of(parts.netloc)
    bucket = bool(host) and (plain + "/").startswith(host + "/")
    known = parts.netloc[: len(parts.netloc) - len(host)] if bucket else parts.netloc
    return Root(f"{parts.scheme}://{known}", f"?{parts.query}" if parts.query else "", True)


class Storages:
    """The storages of many URIs, each scheme, host and set of options opened once."""

    def __init__(self):
        self.known: dict[tuple[str, str, str], tuple[pafs.FileSystem, bool]] = {}
        self.local = pafs.LocalFileSystem()

    def find(self, uri: str) -> tuple[pafs.FileSystem, str]:
        if not is_uri(uri):
            return self.local, uri
        parts = urlsplit(uri)
        key, host = (parts.scheme, parts.netloc, parts.query), host_of(parts.netloc)
        if key not in self.known:
            storage, plain = open_storage(uri)
            self.known[key] = storage, bool(host) and plain.startswith(host + "/")
        storage, bucket = self.known[key]
        return storage, (host if bucket else "") + unquote(parts.path)
