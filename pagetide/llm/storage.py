"""Files that tasks write and read in the shared folder, by URI."""

from __future__ import annotations

import os
from urllib.parse import urlparse


class Store:
    """Whole-file writes and byte-range reads below one URI: a mounted folder by the file system, other schemes by Arrow."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        scheme = urlparse(root).scheme
        self.local = scheme in ("", "file")
        if self.local:
            self.base = urlparse(root).path.rstrip("/") if scheme else self.root
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(self.root)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def create(self, name: str):
        """A file open for writing; names are never written twice, so a repeated task can't harm a finished file."""
        if self.local:
            os.makedirs(self.base, exist_ok=True)
            return open(self.path(name), "xb")
        self.fs.create_dir(self.base, recursive=True)
        return self.fs.open_output_stream(self.path(name))

    def open(self, name: str):
        """A file open for seeks and reads."""
        return open(self.path(name), "rb", buffering=1 << 16) if self.local else self.fs.open_input_file(self.path(name))

    def names(self) -> list[tuple[str, int]]:
        """Names and sizes of the files, in order."""
        if self.local:
            return sorted((e.name, e.stat().st_size) for e in os.scandir(self.base) if e.is_file()) if os.path.isdir(self.base) else []
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file)
