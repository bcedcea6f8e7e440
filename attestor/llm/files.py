"""Binary files in the folder that driver and executors share, written and read by tasks through pyarrow's filesystems."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager


def opened(uri: str):
    """(filesystem, path) of a URI or local path."""
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def whole_file(uri: str):
    """A file to write that appears under its name only when it is whole, so a task may die or run twice."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(draft) as out:
            yield out
        system.move(draft, path)
    except BaseException:
        try:
            system.delete_file(draft)
        except OSError:
            pass
        raise
