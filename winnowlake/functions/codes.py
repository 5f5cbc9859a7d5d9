"""Unary, gamma and delta codes over a growing bit stream, low bits first.

Parquet's encodings do this work in the index; these are for exchanging sets as bit strings.
"""

from __future__ import annotations


class Bits:
    """A bit stream to write (append) and read (take)."""

    def __init__(self, value: int = 0, length: int = 0):
        self.value, self.length, self.at = value, length, 0

    def append(self, x: int, n: int) -> None:
        self.value |= (x & ((1 << n) - 1)) << self.length
        self.length += n

    def take(self, n: int) -> int:
        if self.at + n > self.length:
            raise EOFError("end of the bit stream")
        x = (self.value >> self.at) & ((1 << n) - 1)
        self.at += n
        return x


def put_unary(b: Bits, x: int) -> None:
    b.append(1 << x, x + 1)


def get_unary(b: Bits) -> int:
    x = 0
    while not b.take(1):
        x += 1
    return x


def put_gamma(b: Bits, x: int) -> None:
    n = (x + 1).bit_length() - 1
    put_unary(b, n)
    b.append(x + 1, n)


def get_gamma(b: Bits) -> int:
    n = get_unary(b)
    return (b.take(n) | 1 << n) - 1


def put_delta(b: Bits, x: int) -> None:
    n = (x + 1).bit_length() - 1
    put_gamma(b, n)
    b.append(x + 1, n)


def get_delta(b: Bits) -> int:
    n = get_gamma(b)
    return (b.take(n) | 1 << n) - 1


def put_set(ids: list[int], n: int) -> Bits:
    """An ascending set below n: delta(size), then gaps, bitmap or the complement's gaps."""
    b = Bits()
    put_delta(b, len(ids))
    rest = ids
    if int(0.25 * n) <= len(ids) < int(0.75 * n):
        b.append(sum(1 << i for i in ids), n)
        return b
    if len(ids) >= int(0.75 * n):
        own = set(ids)
        rest = [i for i in range(n) if i not in own]
    last = -1
    for i in rest:
        put_delta(b, i - last - 1)
        last = i
    return b


def get_set(b: Bits, n: int) -> list[int]:
    size = get_delta(b)
    if int(0.25 * n) <= size < int(0.75 * n):
        x = b.take(n)
        return [i for i in range(n) if x >> i & 1]
    dense = size >= int(0.75 * n)
    out, last = [], -1
    for _ in range(n - size if dense else size):
        last += 1 + get_delta(b)
        out.append(last)
    if not dense:
        return out
    gone = set(out)
    return [i for i in range(n) if i not in gone]
