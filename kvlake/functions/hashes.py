"""Hashes and codecs as column expressions: 32-bit arithmetic on BIGINT with masks, no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: The hash's multiplier and the two seeds of the bloom filter.
MULTIPLIER, SEEDS = 0x5BD1E995, (0xBC9F1D34, 0x9E3779B9)
#: Fixed value: the reflected Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def _masked(c: Column) -> Column:
    return c.bitwiseAND(MASK)


def _byte(hexed: Column, k: Column | int) -> Column:
    return F.conv(F.substring(hexed, F.lit(1) + 2 * (F.lit(k) if isinstance(k, int) else k), F.lit(2)), 16, 10).cast("long")


def murmur2(key: Column, seed: int) -> Column:
    """32-bit MurmurHash2 of a string's UTF-8 bytes, as an unsigned BIGINT."""
    hexed, size, m = F.hex(key.cast("binary")), F.octet_length(key).cast("long"), F.lit(MULTIPLIER).cast("long")
    words = F.when(size >= 4, F.transform(F.sequence(F.lit(0), (F.floor(size / 4) - 1).cast("int")), lambda w: sum((_byte(hexed, 4 * w + k) * (1 << 8 * k) for k in range(1, 4)), _byte(hexed, 4 * w)))).otherwise(F.array().cast("array<bigint>"))

    def step(h: Column, w: Column) -> Column:
        k = _masked(w * m)
        return _masked(h * m).bitwiseXOR(_masked(k.bitwiseXOR(F.shiftright(k, 24)) * m))

    h = F.aggregate(words, F.lit(seed).cast("long").bitwiseXOR(size), step)
    done, rest = 4 * F.floor(size / 4), size % 4
    tail = F.when(rest >= 1, _byte(hexed, done)).otherwise(F.lit(0)) + F.when(rest >= 2, _byte(hexed, done + 1) * 256).otherwise(F.lit(0)) + F.when(rest == 3, _byte(hexed, done + 2) * 65536).otherwise(F.lit(0))
    ends = lambda h: (lambda x: x.bitwiseXOR(F.shiftright(x, 15)))(_masked(h.bitwiseXOR(F.shiftright(h, 13)) * m))
    # one lambda argument keeps the long fold from being written out again at each use
    return F.transform(F.array(F.struct(h.alias("h"), rest.alias("r"), tail.alias("t"))), lambda s: ends(F.when(s["r"] > 0, _masked(s["h"].bitwiseXOR(s["t"]) * m)).otherwise(s["h"])))[0]


def crc32c(value: Column) -> Column:
    """CRC-32C of a string's UTF-8 bytes, as an unsigned BIGINT."""
    entries = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (CASTAGNOLI if b & 1 else 0)
        entries.append(F.lit(b).cast("long"))
    entries, hexed = F.array(*entries), F.hex(value.cast("binary"))
    numbers = F.when(F.octet_length(value) > 0, F.transform(F.sequence(F.lit(0), F.octet_length(value) - 1), lambda k: _byte(hexed, k))).otherwise(F.array().cast("array<bigint>"))
    crc = F.aggregate(numbers, F.lit(MASK).cast("long"), lambda c, b: F.shiftright(c, 8).bitwiseXOR(F.element_at(entries, (c.bitwiseXOR(b).bitwiseAND(255) + 1).cast("int"))))
    return crc.bitwiseXOR(MASK)


def varint_length(v: Column) -> Column:
    return F.when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3).when(v < 1 << 28, 4).otherwise(5)


def varint_hex(v: Column) -> Column:
    """Seven bits a byte, low first, the high bit set on all but the last."""
    parts = [F.lpad(F.hex(F.shiftright(v, 7 * k).bitwiseAND(127) + F.when(varint_length(v) > k + 1, 128).otherwise(0)), 2, "0") for k in range(5)]
    return F.array_join(F.slice(F.array(*parts), F.lit(1), varint_length(v)), "")


def fixed_hex(v: Column, size: int) -> Column:
    """Little-endian fixed width."""
    h = F.lpad(F.hex(v), 2 * size, "0")
    return F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))))


def internal_key_hex(key: Column, seq: Column, kind: Column) -> Column:
    """Key bytes, then the little-endian 64-bit (seq << 8 | type), its bytes written separately so that 56-bit numbers fit."""
    return F.concat(F.hex(key.cast("binary")), F.lpad(F.hex(kind), 2, "0"), fixed_hex(seq, 7))


def fixed_value(hexed: Column, size: int) -> Column:
    """The number that fixed_hex wrote; of eight bytes as DECIMAL(20,0), as it may not fit a BIGINT."""
    back = F.conv(F.concat(*(F.substring(hexed, 2 * k + 1, 2) for k in reversed(range(size)))), 16, 10)
    return back.cast("decimal(20,0)" if size > 7 else "bigint")


def varint_value(hexed: Column) -> Column:
    """The number that varint_hex wrote; null where bytes are missing or more than five."""
    value, so_far = None, F.lit(0).cast("bigint")
    for k in range(5):
        b = _byte(hexed, k)
        so_far = so_far + b.bitwiseAND(127) * (1 << 7 * k)
        value = F.when(b < 128, so_far) if value is None else value.when(b < 128, so_far)
    return value


def internal_key_parts(hexed: Column) -> list[Column]:
    """user_key, seq and type of what internal_key_hex wrote; empty, 0 and 0 of fewer than eight bytes."""
    n = F.length(hexed)
    whole = n >= 16
    part = lambda at, many: F.substring(hexed, at, F.lit(many) if isinstance(many, int) else many)
    key = F.decode(F.unhex(part(F.lit(1), n - 16)), "utf-8")
    return [F.when(whole, key).otherwise("").alias("user_key"), F.when(whole, fixed_value(part(n - 13, 14), 7)).otherwise(0).alias("seq"), F.when(whole, _byte(part(n - 15, 2), 0).cast("int")).otherwise(0).alias("type")]


#: Names of compression codes from 0, and how a status of each code from 0 begins.
COMPRESSIONS = ("none", "snappy", "zstd")
STATUSES = ("OK", "NotFound: ", "Corruption: ", "NotSupported: ", "InvalidArgument: ", "IOError: ")


def _named(code: Column, names: tuple[str, ...], other: str) -> Column:
    out = F.lit(other)
    for k, name in enumerate(names):
        out = F.when(code == k, name).otherwise(out)
    return out


def compression_name(code: Column) -> Column:
    return _named(code, COMPRESSIONS, "unknown")


def status_text(code: Column, message: Column) -> Column:
    """A status as text: its code's name, then the message if there is one."""
    return F.concat(_named(code, STATUSES, ""), F.coalesce(message, F.lit("")))


def bits_per_key(p: float) -> int:
    """A bloom filter's bits for each key, each intermediate value truncated."""
    from math import log

    return max(1, int(int(-log(p) / log(2) / log(2)) / log(2)))


def bloom_parameters(n: int, p: float) -> tuple[int, int]:
    """(number of hashes, bits) with each intermediate value truncated."""
    from math import log

    bits = int(-log(p) / log(2) / log(2))
    return min(30, max(1, int(bits * log(2)))), (n * bits_per_key(p) // 8 + 1) * 8


def bloom_positions(key: Column, bits: Column | int, p: float) -> Column:
    """The key's bit positions in a filter of so many bits: double hashing modulo 2**32 and then the filter's size."""
    k = bloom_parameters(1, p)[0]
    pair = F.array(F.struct(murmur2(key, SEEDS[0]).alias("a"), murmur2(key, SEEDS[1]).alias("b")))
    return F.flatten(F.transform(pair, lambda h: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: _masked(h["a"] + i * h["b"]) % bits)))


def bloom_probed(keys: DataFrame, members: DataFrame, p: float) -> DataFrame:
    """(key, maybe): whether a filter of members (key) sized from their number may hold each key. The filter is the relation of its set bits, so its size is no limit."""
    size = members.agg(((F.floor(F.greatest(F.count("*"), F.lit(1)) * bits_per_key(p) / 8) + 1) * 8).alias("bits"))
    spread = lambda df: df.select("key").distinct().crossJoin(F.broadcast(size)).select("key", F.explode(bloom_positions(F.col("key"), F.col("bits"), p)).alias("pos"))  # noqa: E731  one row
    bits = spread(members).select("pos", F.lit(True).alias("set")).distinct()
    return spread(keys).join(bits, "pos", "left").groupBy("key").agg(F.bool_and(F.col("set").isNotNull()).alias("maybe"))
