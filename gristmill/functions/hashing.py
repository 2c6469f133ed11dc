"""Hashes, radix partitions, partition groups and ownership as column expressions. All are JVM-side and code-generated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK32 = 1 << 32


def mix32(key: Column) -> Column:
    """32-bit integer mixer for 0 <= key < 2^31; every product stays below 2^63, so ANSI mode never overflows."""
    h = (key.cast("bigint") * F.lit(2654435761)) % F.lit(_MASK32)
    for shift in (16, 15):
        h = h.bitwiseXOR(F.shiftright(h, shift))
        h = (h * F.lit(1597334677)) % F.lit(_MASK32)
    return h.bitwiseXOR(F.shiftright(h, 16))


def radix_partition(hash_: Column, partitions: int, bits: int = 64) -> Column:
    """The top log2(partitions) of a hash's ``bits`` bits; partitions is a power of two."""
    k = log2_exact(partitions)
    if k == 0:
        return F.lit(0)
    return F.shiftrightunsigned(hash_, bits - k).cast("int")


def partition_group(part: Column, size: int = 4) -> Column:
    """Neighbouring partitions in groups of ``size``, a power of two: a group is owned and sketched together."""
    return F.shiftright(part, log2_exact(size))


def owner(group: Column, groups: int, nodes: int) -> Column:
    """Contiguous ranges of groups to nodes; exact for any number of nodes, since one map serves data and bookkeeping alike."""
    return F.shiftright(group * F.lit(nodes), log2_exact(groups)).cast("int")


def peer_index(node: Column, self_: Column) -> Column:
    """Index of a node among another's peers, which leave out itself."""
    return node - (node > self_).cast("int")


def tuple_hash(*columns: Column) -> Column:
    """Wrapping 64-bit fold over integer columns, from the last to the first, as signed bigint.

    Each step is acc XOR (x + 0x517cc1b727220a95 + (acc << 6) + (acc >> 2)) modulo 2^64. Sums are taken in halves of
    32 bits, which neither overflow under ANSI nor leave bigint.
    """
    low = F.lit(0xFFFFFFFF)
    acc = columns[-1].cast("bigint")
    for x in reversed(columns[:-1]):
        terms = (x.cast("bigint"), F.lit(0x517CC1B727220A95), F.shiftleft(acc, 6), F.shiftrightunsigned(acc, 2))
        lo, hi = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        for t in terms:
            lo, hi = lo + t.bitwiseAND(low), hi + F.shiftrightunsigned(t, 32)
        hi = (hi + F.shiftrightunsigned(lo, 32)).bitwiseAND(low)
        acc = acc.bitwiseXOR(F.shiftleft(hi, 32).bitwiseOR(lo.bitwiseAND(low)))
    return acc


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it: an expression tree would repeat it at each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _halves(c: Column) -> tuple[Column, Column]:
    return c.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(c, 32)


def _joined(lo: Column, hi: Column) -> Column:
    hi = (hi + F.shiftrightunsigned(lo, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(hi, 32).bitwiseOR(lo.bitwiseAND(F.lit(0xFFFFFFFF)))


def _times(c: Column, factor: int) -> Column:
    """Wrapping 64-bit product, by 32-bit halves of ``c`` and 16-bit digits of the factor, so that ANSI mode never overflows."""
    m = [F.lit((factor >> (16 * i)) & 0xFFFF).cast("bigint") for i in range(4)]
    low16, low32 = F.lit(0xFFFF), F.lit(0xFFFFFFFF)

    def product(v: Column) -> Column:
        a0, a1 = _halves(v)
        lo = (a0 * m[0]).bitwiseAND(low32) + F.shiftleft((a0 * m[1]).bitwiseAND(low16), 16)
        hi = F.shiftrightunsigned(a0 * m[0], 32) + F.shiftrightunsigned(a0 * m[1], 16) + a0 * m[2] + F.shiftleft((a0 * m[3]).bitwiseAND(low16), 16)
        return _joined(lo, hi + a1 * m[0] + F.shiftleft((a1 * m[1]).bitwiseAND(low16), 16))

    return _let(c, product)


def _plus(*terms: Column) -> Column:
    """Wrapping 64-bit sum."""
    lo, hi = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for t in terms:
        a, b = _halves(t)
        lo, hi = lo + a, hi + b
    return _joined(lo, hi)


def finalised(c: Column) -> Column:
    """64-bit multiply and xor-shift finaliser of an integer, as signed bigint. Shifts are of the unsigned value."""
    m, h = 0xC6A4A7935BD1E995, 0x8445D61A4E774912 ^ (8 * 0xC6A4A7935BD1E995 % (1 << 64))

    def folded(v: Column) -> Column:
        return _let(v, lambda k: k.bitwiseXOR(F.shiftrightunsigned(k, 47)))

    k = _times(folded(_times(c.cast("bigint"), m)), m)
    return folded(_times(folded(_times(k.bitwiseXOR(F.lit(h - (1 << 64) if h >> 63 else h)), m)), m))


def array_hash(*columns: Column) -> Column:
    """Left fold of ``finalised`` hashes: seed ^= h + 0x9e3779b9 + (seed << 6) + (seed >> 2), modulo 2^64."""
    seed = F.lit(0).cast("bigint")
    for c in columns:
        h = finalised(c)
        seed = _let(F.struct(seed.alias("s"), h.alias("h")), lambda x: x["s"].bitwiseXOR(_plus(x["h"], F.lit(0x9E3779B9), F.shiftleft(x["s"], 6), F.shiftrightunsigned(x["s"], 2))))
    return seed


def parity(c: Column) -> Column:
    return c.bitwiseAND(F.lit(1))


def next_power_of_two(x: Column) -> Column:
    """The least power of two >= x, for x >= 1."""
    v = x.cast("bigint") - F.lit(1)
    for s in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseOR(F.shiftrightunsigned(v, s))
    return v + F.lit(1)


def is_power_of_two(x: Column) -> Column:
    return F.bit_count(x) == 1


def larger_root(a: Column, b: Column, c: Column) -> Column:
    """Larger real root of a*x^2 + b*x + c, or -1 without one."""
    d = b * b - F.lit(4) * a * c
    return F.when((d < 0) | (a == 0), F.lit(-1.0)).otherwise(F.greatest((-b + F.sqrt(F.greatest(d, F.lit(0.0)))) / (2 * a), (-b - F.sqrt(F.greatest(d, F.lit(0.0)))) / (2 * a)))


def feeder(query_thread: Column, queries: int, feeders: int) -> tuple[Column, Column, Column]:
    """(feeder, size of its group, index in the group) of a query thread: balanced, the first queries % feeders get one more."""
    each, more = queries // feeders, queries % feeders
    cut = more * (each + 1)
    early = query_thread < cut
    at = F.when(early, F.floor(query_thread / (each + 1))).otherwise(F.floor((query_thread - cut) / max(each, 1)) + more).cast("int")
    first = F.when(early, at * (each + 1)).otherwise(cut + (at - more) * each)
    return at, F.when(early, each + 1).otherwise(each).cast("int"), (query_thread - first).cast("int")


def log2_exact(n: int) -> int:
    if n < 1 or n & (n - 1):
        raise ValueError(f"not a power of two: {n}")
    return n.bit_length() - 1
