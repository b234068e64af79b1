"""Raw files in the shared folder: range reads and streamed writes from inside tasks."""

import uuid

from pyarrow import fs  # noqa: F401

from marginwise.session import locate


def create(folder: str, suffix: str):
    """(uri, stream) of a new file. Its name is new in every attempt of a task: what a lost attempt has
    written is never listed, as only rows of committed attempts name files."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path)


class Reader:
    """Range reads of files, the last one kept open; neighbouring small reads share one request."""

    AHEAD = 4 << 20

    def __init__(self):
        self.uri, self.file, self.size = None, None, 0
        self.begin, self.held = 0, b""

    def open(self, uri: str) -> int:
        """Turns to a file; returns its size."""
        if uri != self.uri:
            self.close()
            system, path = locate(uri)
            self.file, self.uri = system.open_input_file(path), uri
            self.size, self.held = self.file.size(), b""
        return self.size

    def read(self, at: int, length: int) -> bytes:
        if not (self.begin <= at and at + length <= self.begin + len(self.held)):
            want = max(length, min(self.AHEAD, self.size - at))
            self.begin, self.held = at, self.file.read_at(want, at)
        return self.held[at - self.begin : at - self.begin + length]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri, self.file, self.held = None, None, b""
