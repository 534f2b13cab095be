"""Files by byte ranges, on any file system that pyarrow knows, from the driver and from tasks."""

from __future__ import annotations

import os
import re


def opened(path: str) -> tuple:
    """The file system of a path or URI, and the path in it. Spark writes file:/x where others write file:///x."""
    from pyarrow import fs

    plain = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), os.path.abspath(plain))


def listed(path: str, ending: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files at any depth in order of name; names that begin with _ or . are left out."""
    from pyarrow import fs

    system, at = opened(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.Directory:
        inside = system.get_file_info(fs.FileSelector(at, recursive=True))
        files = [i for i in inside if i.type == fs.FileType.File and not re.search(r"(^|/)[_.]", i.path[len(at) :].lstrip("/")) and i.path.endswith(ending)]
    else:
        files = [found] if found.type == fs.FileType.File else []
    if not files and found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((i.path, i.size) for i in files)
