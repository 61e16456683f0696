"""64-bit FNV hashes over the UTF-8 bytes of a string.

Each byte's step needs the result of the one before, and a built-in ``aggregate`` over
the bytes is interpreted at about a megabyte a second. So the hashes are Arrow UDFs:
one step for the n-th byte of every text in a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published hash.
OFFSET_BASIS = 14695981039346656037
PRIME = 1099511628211

_MODULUS_MASK = (1 << 64) - 1

# With fewer texts left than this, going through each on its own is faster.
_FEW_TEXTS = 48


def _fnv(multiply_first: bool):
    """The hash as an Arrow UDF.

    The function is nested so that it travels by value: executors need numpy and
    pyarrow, but not this package.
    """

    def hashes(texts: pa.Array) -> pa.Array:
        binary = texts.cast(pa.large_binary())
        count = len(binary)
        _, offset_buffer, data_buffer = binary.buffers()
        if count == 0 or data_buffer is None:
            data = np.zeros(0, np.uint8)
        else:
            data = np.frombuffer(data_buffer, np.uint8)
        offsets = np.zeros(1, np.int64)
        if count:
            stored = np.frombuffer(offset_buffer, np.int64)
            offsets = stored[binary.offset : binary.offset + count + 1]
        lengths = np.diff(offsets)
        longest_first = np.argsort(-lengths, kind="stable")
        starts, lengths = offsets[:-1][longest_first], lengths[longest_first]
        states = np.full(count, OFFSET_BASIS, np.uint64)
        prime = np.uint64(PRIME)
        position = 0
        left = int(np.searchsorted(-lengths, 0))
        while left >= _FEW_TEXTS:
            # The same number of texts is left until the shortest of them ends.
            until = int(lengths[left - 1])
            some, at = states[:left], starts[:left]
            for step in range(position, until):
                byte = data[at + step]
                if multiply_first:
                    some *= prime
                    some ^= byte
                else:
                    some ^= byte
                    some *= prime
            position = until
            left = int(np.searchsorted(-lengths, -position))
        for row in range(left):
            value = int(states[row])
            start = int(starts[row])
            for byte in data[start + position : start + int(lengths[row])].tolist():
                if multiply_first:
                    value = ((value * PRIME) & _MODULUS_MASK) ^ byte
                else:
                    value = ((value ^ byte) * PRIME) & _MODULUS_MASK
            states[row] = value
        in_order = np.empty(count, np.int64)
        in_order[longest_first] = states.view(np.int64)
        return pa.array(in_order, pa.int64(), mask=np.asarray(binary.is_null()))

    return F.arrow_udf(hashes, T.LongType())


def fnv1a_64(text: Column) -> Column:
    """Exclusive or with the byte, then multiply; as a signed number."""
    return _fnv(multiply_first=False)(text)


def fnv_64(text: Column) -> Column:
    """Multiply, then exclusive or with the byte; as a signed number."""
    return _fnv(multiply_first=True)(text)


def murmur(*cols: Column) -> Column:
    """Spark's own 32-bit Murmur3; not bit-compatible with other variants."""
    return F.hash(*cols)
