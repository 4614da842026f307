"""Files that tasks open themselves: local ones, and what pyarrow reaches by a URI."""

from __future__ import annotations

import re


def store_of(path: str):
    """File system and path within it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def files_under(path: str, suffix: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of all files under a folder whose names end so; hidden ones are left out."""
    from pyarrow import fs

    store, root = store_of(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    hidden = lambda p: re.search(r"/[._]", p[len(root) :])
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and (f is info or f.path.lower().endswith(suffix) and not hidden(f.path)))
