"""Binary files in the shared folder, by URI, from the executors."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """A name that no other attempt of a task uses; readers go by the manifest of the attempts that ended well."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def open_out(uri: str):
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # not by the name's ending


def open_in(uri: str):
    """A file that can be read from any place."""
    system, path = _at(uri)
    return system.open_input_file(path)
