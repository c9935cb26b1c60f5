"""Parity hashes as Column expressions. 64-bit values are signed bit patterns.

Arithmetic that wraps is spelt out in 32-bit halves, since ANSI mode raises on
overflow; everything stays in whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(_low(high), 32).bitwiseOR(_low(low))


def add64(a: Column, b: Column) -> Column:
    """a + b, wrapping."""
    low = _low(a) + _low(b)
    return _join(F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32), low)


def mul64(x: Column, c: int) -> Column:
    """x * c for a constant, wrapping: schoolbook over 16-bit digits of c."""
    xl, xh = _low(x), F.shiftrightunsigned(x, 32)
    d = [(c >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    low = xl * d[0] + F.shiftleft(_low(xl * d[1]).bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(xl * d[1], 16) + _low(xl * d[2]) + F.shiftleft((xl * d[3]).bitwiseAND(F.lit(0xFFFF)), 16) + _low(xh * d[0]) + F.shiftleft((xh * d[1]).bitwiseAND(F.lit(0xFFFF)), 16)
    return _join(high, low)


def _xorshift(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, n))


def mix_int(key: Column) -> Column:
    """The integer key hash; zero stays zero."""
    x = mul64(_xorshift(key.cast("long"), 30), 0xBF58476D1CE4E5B9)
    return _xorshift(mul64(_xorshift(x, 27), 0x94D049BB133111EB), 31)


def _times_prime(x: Column) -> Column:
    """x times 2**40 + 435."""
    low = _low(x) * 435
    high = F.shiftrightunsigned(x, 32) * 435 + F.shiftrightunsigned(low, 32) + _low(F.shiftleft(x, 8))
    return _join(high, low)


def fnv1a(key: Column) -> Column:
    """FNV-1a over the UTF-8 bytes; null stays null."""
    hexed = F.hex(F.encode(key, "UTF-8"))
    n = F.octet_length(key)
    at = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(at, F.lit(_signed(0xCBF29CE484222325)), lambda h, i: _times_prime(h.bitwiseXOR(byte(i))))


def combine(h1: Column, h2: Column) -> Column:
    """Two hashes in one."""
    h1, h2 = h1.cast("long"), h2.cast("long")
    more = add64(add64(h2, F.lit(_signed(0x9E3779B97F4A7C15))), add64(F.shiftleft(h1, 12), F.shiftrightunsigned(h1, 4)))
    return h1.bitwiseXOR(more)


def fast_fnv(key: Column) -> Column:
    """FNV-1a by eight little-endian bytes a step for 32 bytes and more, else by byte."""
    hexed, n = F.hex(F.encode(key, "UTF-8")), F.octet_length(key)
    whole = (n / 8).cast("int")
    byte = lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long")

    def word(i: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(8):
            out = out.bitwiseOR(F.shiftleft(byte(i * 8 + (k + 1)), 8 * k))
        return out

    def step(h: Column, i: Column) -> Column:
        x = _times_prime(h.bitwiseXOR(word(i)))
        return F.shiftleft(x, 31).bitwiseOR(F.shiftrightunsigned(x, 33))

    h = F.aggregate(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), F.lit(_signed(0xCBF29CE484222325)), step)
    rest = F.when(n % 8 > 0, F.sequence(whole * 8 + 1, F.greatest(n, whole * 8 + 1))).otherwise(F.array().cast("array<int>"))
    return F.when(n < 32, fnv1a(key)).otherwise(F.aggregate(rest, h, lambda x, i: _times_prime(x.bitwiseXOR(byte(i)))))


def md5_hash(seed: int, key: Column) -> Column:
    """32 bits of the MD5 of ``seed:key``, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def xx_hash(seed: int, key: Column) -> Column:
    """The sketches' own hash."""
    return F.xxhash64(F.lit(seed), key)


def shard_of(key_hash: Column, shards: int) -> Column:
    """The shard of a hash; the count is rounded up to a power of two."""
    return key_hash.bitwiseAND(F.lit((1 << max(0, shards - 1).bit_length()) - 1))
