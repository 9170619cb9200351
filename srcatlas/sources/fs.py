"""File access inside tasks: plain paths by the operating system, ``scheme://`` addresses by Arrow's file systems."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator


def local_path(address: str) -> str | None:
    """The path behind a plain path or ``file:`` address, None for other file systems."""
    if address.startswith("file:"):
        return "/" + address[len("file:"):].lstrip("/")
    return None if "://" in address else address


#: One client per scheme and authority in a task, and the path its root has there.
_clients: dict[str, tuple] = {}


def _client(root: str) -> tuple:
    from pyarrow.fs import FileSystem

    if root not in _clients:
        _clients[root] = FileSystem.from_uri(root)
    return _clients[root]


def _remote(address: str) -> tuple:
    scheme, _, rest = address.partition("://")
    authority, _, path = rest.partition("/")
    system, base = _client(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{path}"


def entries(folder: str) -> Iterator[tuple[str, bool, float, int]]:
    """``name, is_dir, mtime, size`` of a directory's entries.  A link counts as a file, never as a directory."""
    path = local_path(folder)
    if path is None:
        yield from remote_entries(folder)
        return
    with os.scandir(path) as it:
        for e in it:
            is_dir = e.is_dir(follow_symlinks=False)
            try:
                info = None if is_dir else e.stat()
            except OSError:
                info = None  # a broken link: reading it reports the error
            yield e.name, is_dir, info.st_mtime if info else 0.0, info.st_size if info else 0


def folders(folder: str) -> Iterator[str]:
    """Names of the directories in a directory; unlike ``entries`` it asks for no file's size or time."""
    path = local_path(folder)
    if path is None:
        yield from (name for name, is_dir, _, _ in remote_entries(folder) if is_dir)
        return
    with os.scandir(path) as it:
        yield from (e.name for e in it if e.is_dir(follow_symlinks=False))


def remote_entries(folder: str) -> Iterator[tuple[str, bool, float, int]]:
    from pyarrow.fs import FileSelector, FileType

    system, path = _remote(folder)
    for info in system.get_file_info(FileSelector(path, recursive=False)):
        mtime = info.mtime.timestamp() if info.mtime else 0.0
        yield info.base_name, info.type == FileType.Directory, mtime, info.size or 0


def read_bytes(location: str) -> bytes:
    path = local_path(location)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    system, path = _remote(location)
    with system.open_input_stream(path) as f:
        return f.read()


def read_blocks(location: str, size: int) -> Iterator[bytes]:
    """A file's bytes, ``size`` at a time."""
    path = local_path(location)
    if path is not None:
        with open(path, "rb") as f:
            while block := f.read(size):
                yield block
        return
    system, path = _remote(location)
    with system.open_input_stream(path) as f:
        while block := f.read(size):
            yield block


def _open_to_write(path: str) -> int:
    """A file as it is, or a new one."""
    return os.open(path, os.O_WRONLY | os.O_CREAT | os.O_CLOEXEC, 0o666)


def write_bytes(location: str, data: bytes) -> None:
    """Write a file, with the directories above it where they are missing.

    A file that is there is written over and cut to its new length: some file systems (ext4) free the place of a file that
    is emptied, and send what is written to it to disk when it is closed.
    """
    path = local_path(location)
    if path is not None:
        try:
            opened = _open_to_write(path)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            opened = _open_to_write(path)
        with open(opened, "wb") as f:
            f.write(data)
            f.flush()
            if os.fstat(opened).st_size > len(data) or not data:  # nothing written leaves the time of change as it is, a cut does not
                f.truncate()
        return
    system, path = _remote(location)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


def remove_file(location: str) -> None:
    """Remove a file; one that is not there is no error."""
    path = local_path(location)
    if path is not None:
        if os.path.exists(path):
            os.remove(path)
        return
    from pyarrow.fs import FileType

    system, path = _remote(location)
    if system.get_file_info(path).type == FileType.File:
        system.delete_file(path)


def read_range(location: str, start: int, size: int) -> bytes:
    """At most ``size`` bytes of a file from ``start`` on."""
    path = local_path(location)
    if path is not None:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(size)
    system, path = _remote(location)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def add_file(location: str, data: bytes) -> None:
    """Write a file that appears as a whole: under a hidden name first, then moved."""
    folder, _, name = location.rpartition("/")
    write_bytes(f"{folder}/.{name}", data)
    move_file(f"{folder}/.{name}", location)


def move_file(location: str, to: str) -> None:
    path = local_path(location)
    if path is not None:
        target = local_path(to)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.replace(path, target)
        return
    system, path = _remote(location)
    target = _remote(to)[1]
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    system.move(path, target)


def remove_tree(location: str) -> None:
    """Remove a folder with all files in it; one that is not there is no error."""
    path = local_path(location)
    if path is not None:
        shutil.rmtree(path, ignore_errors=True)
        return
    from pyarrow.fs import FileType

    system, path = _remote(location)
    if system.get_file_info(path).type == FileType.Directory:
        system.delete_dir(path)
