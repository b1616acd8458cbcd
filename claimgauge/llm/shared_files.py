"""Files that tasks write into and read from the shared folder, in any store that Arrow knows."""

from __future__ import annotations

from contextlib import contextmanager

import zstandard


def _store_of(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def make_folder(uri: str) -> None:
    store, path = _store_of(uri)
    store.create_dir(path, recursive=True)


@contextmanager
def writing(uri: str):
    """A binary output. A task that is run again writes under another name, so no file is ever changed."""
    store, path = _store_of(uri)
    with store.open_output_stream(path, compression=None) as out:
        yield out


def read_whole(uri: str) -> bytes:
    store, path = _store_of(uri)
    with store.open_input_file(path) as source:
        return source.read()


def read_range(uri: str, start: int, length: int) -> bytes:
    store, path = _store_of(uri)
    with store.open_input_file(path) as source:
        return source.read_at(length, start)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of too few samples to train one, their last bytes."""
    samples = [s for s in samples if s]
    if len(samples) >= 10:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]
