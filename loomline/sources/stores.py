"""Where source trees are: a machine's own files, or any store that Arrow knows by its address.

A path with a scheme (``hdfs://``, ``s3://``, ``gs://``, ``file://``) is opened through Arrow's file
systems, by the driver and by tasks alike; any other path is the local file system's, with its symbolic
links and hidden names.
"""

from __future__ import annotations

import os
import posixpath
import re
import stat
from collections.abc import Iterator
from functools import lru_cache

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
FOLDER, FILE = "folder", "file"
#: bytes that are read at a time
PIECE = 1 << 20


class LocalStore:
    """Symbolic links are entries of their own; links to folders are not followed."""

    def kind(self, path: str) -> str | None:
        """``FOLDER``, ``FILE`` or None where nothing stands; a link is a file."""
        try:
            return FOLDER if stat.S_ISDIR(os.lstat(path).st_mode) else FILE
        except OSError:
            return None

    def entries(self, path: str) -> Iterator[tuple[str, str, int]]:
        """(name, kind, size) of what a folder holds; links have the size of what they lead to."""
        with os.scandir(path) as found:
            for e in found:
                folder = e.is_dir(follow_symlinks=False)
                yield e.name, FOLDER if folder else FILE, 0 if folder else self.size(e.path)

    def size(self, path: str) -> int:
        """Bytes of a file; 0 if there is none."""
        try:
            return os.stat(path).st_size
        except OSError:
            return 0

    def join(self, path: str, name: str) -> str:
        return posixpath.normpath(posixpath.join(path, name))

    def clean(self, path: str) -> str:
        return posixpath.normpath(path)

    def chunks(self, path: str, start: int = 0) -> Iterator[bytes]:
        """The bytes of a file from ``start`` on, a piece at a time."""
        with open(path, "rb") as f:
            if start:
                f.seek(start)
            while piece := f.read(PIECE):
                yield piece

    def write(self, path: str, data: bytes) -> None:
        os.makedirs(posixpath.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


class ArrowStore:
    def __init__(self, address: str):
        from pyarrow import fs

        self.files, path = fs.FileSystem.from_uri(address)
        #: what stands before a store's own path in an address
        self.head = address[: len(address) - len(path)] if address.endswith(path) else _SCHEME.match(address)[0]

    def _own(self, path: str) -> str:
        return path.removeprefix(self.head)

    def kind(self, path: str) -> str | None:
        from pyarrow.fs import FileType

        return {FileType.Directory: FOLDER, FileType.File: FILE}.get(self.files.get_file_info(self._own(path)).type)

    def entries(self, path: str) -> Iterator[tuple[str, str, int]]:
        from pyarrow.fs import FileSelector, FileType

        for x in self.files.get_file_info(FileSelector(self._own(path))):
            yield x.base_name, FOLDER if x.type == FileType.Directory else FILE, x.size or 0

    def size(self, path: str) -> int:
        return self.files.get_file_info(self._own(path)).size or 0

    def join(self, path: str, name: str) -> str:
        return f"{path.rstrip('/')}/{name}"

    def clean(self, path: str) -> str:
        return path.rstrip("/") if self._own(path).strip("/") else path

    def chunks(self, path: str, start: int = 0) -> Iterator[bytes]:
        with self.files.open_input_file(self._own(path)) as f:
            f.seek(start)
            while piece := f.read(PIECE):
                yield piece

    def write(self, path: str, data: bytes) -> None:
        self.files.create_dir(posixpath.dirname(self._own(path)), recursive=True)
        with self.files.open_output_stream(self._own(path)) as f:
            f.write(data)


@lru_cache(maxsize=64)
def _arrow(address: str) -> ArrowStore:
    return ArrowStore(address)


def store_of(path: str) -> LocalStore | ArrowStore:
    scheme = _SCHEME.match(path)
    if scheme is None:
        return LocalStore()
    host = path[scheme.end() :].split("/", 1)[0]
    return _arrow(f"{scheme[0]}{host}/")
