"""A folder of files, local or on shared storage by URI, as the driver and the executors see it."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

#: A file or folder: its name, whether it is a folder, size and modification time in ns.
Item = tuple[str, bool, int, int]


def normal(root: str) -> str:
    """The real path of a local folder; a URI of another scheme without its last slash."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return os.path.realpath(root) if "://" not in root else root.rstrip("/")


@lru_cache(maxsize=16)
def _remote(root: str):
    from pyarrow import fs

    scheme, rest = root.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def is_folder(root: str) -> bool:
    if "://" not in root:
        return os.path.isdir(root)
    from pyarrow import fs

    system, base = _remote(root)
    return system.get_file_info(base).type == fs.FileType.Directory


def items(root: str, folder: str) -> Iterator[Item]:
    """What a folder below the root (``""``: the root itself) holds. Symbolic links to folders, and what can't be read, are left out."""
    if "://" not in root:
        try:
            with os.scandir(os.path.join(root, folder)) as found:
                for e in found:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield e.name, True, 0, 0
                        elif e.is_file():
                            s = e.stat()
                            yield e.name, False, s.st_size, s.st_mtime_ns
                    except OSError:
                        continue
        except OSError:
            return
        return
    from pyarrow import fs

    system, base = _remote(root)
    for i in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)):
        yield i.base_name, i.type == fs.FileType.Directory, i.size or 0, i.mtime_ns or 0


def read(root: str, path: str) -> bytes:
    """A file's bytes; ``OSError`` if it can't be read."""
    if "://" not in root:
        with open(os.path.join(root, path), "rb") as f:
            return f.read()
    system, base = _remote(root)
    with system.open_input_stream(f"{base}/{path}") as f:
        return f.read()


def write(root: str, path: str, data: bytes) -> None:
    """Write a file on shared storage, its folder too."""
    system, base = _remote(root)
    full = f"{base}/{path}"
    system.create_dir(full.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(full) as f:
        f.write(data)


def modified(root: str, path: str) -> int | None:
    """A file's modification time in ns; None if there is no such file."""
    if "://" not in root:
        try:
            return os.stat(os.path.join(root, path)).st_mtime_ns
        except OSError:
            return None
    system, base = _remote(root)
    return system.get_file_info(f"{base}/{path}").mtime_ns
