"""Sources and fetches of a user's own in scans: a function that is sent to the tasks and called there.

A factory takes a path and gives an object with byte_length, read(offset, length) and, if it likes, close(). A fetch
takes (url, method, headers) and gives (status, headers, body). Both are sent by value, so they may close over what
they need, if that can be pickled.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

from pyspark import cloudpickle

from .bytesource import open_source

#: Options of the scan that hold functions.
FUNCTIONS = ("factory", "fetch")


def packed(function: Callable) -> str:
    """The value of the option for a function: spark.read.format("biosignal").option("factory", packed(f))."""
    return base64.b64encode(cloudpickle.dumps(function)).decode()


@lru_cache(16)
def unpacked(value: str) -> Callable:
    return cloudpickle.loads(base64.b64decode(value))


def options_of(options: dict) -> dict:
    """The options with functions in them packed."""
    return {k: packed(v) if k in FUNCTIONS and callable(v) else v for k, v in options.items()}


def made(path: str, options: dict):
    """The source that the options' factory gives for a path."""
    return open_source(unpacked(options["factory"])(path))


def fetch_of(options: dict) -> Callable | None:
    return unpacked(options["fetch"]) if "fetch" in options else None
