"""Coders by name. A coder is a pair of functions on integer arrays: encode to bytes, decode from bytes and a count."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import codecs

CODERS: dict[str, tuple[Callable, Callable]] = {}


def register(name: str, encode: Callable, decode: Callable) -> None:
    CODERS[name] = (encode, decode)


def _rice(z: np.ndarray) -> bytes:
    k = codecs.best_k(z)
    return bytes([k]) + codecs.rice_encode(z, k)


register("rice", _rice, lambda data, n: codecs.rice_decode(data[1:], data[0], n))
register("partitioned", codecs.partitioned_encode, codecs.partitioned_decode)
register("verbatim", lambda z: b"\x08" + np.asarray(z).astype(">i8").tobytes(), lambda data, n: np.frombuffer(data, ">i8", n, 1).astype(np.int64))
register("arithmetic", lambda z: codecs.arithmetic_encode(np.asarray(z).astype(">i4").tobytes()), lambda data, n: np.frombuffer(codecs.arithmetic_decode(data, 4 * n), ">i4").astype(np.int64))
