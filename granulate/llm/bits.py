"""256-bit hashes written as 64 hex digits: words, distances, arranged suffixes and pivot distances.

A hash is cut into 20 blocks in seven groups. Two hashes at most 12 bits apart
leave at least eight blocks untouched, so two of these lie in one group
(pigeonhole): in one of the 19 arrangements that begin with two blocks of a group
both texts begin alike, with 25 or 26 equal bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = 20
EDGES = [256 * i // BLOCKS for i in range(BLOCKS + 1)]
GROUPS = [[b for b in range(BLOCKS) if b % 7 == g] for g in range(7)]  # far apart, as neighbouring rows of a picture are alike
ARRANGEMENTS = [pair for group in GROUPS for pair in combinations(group, 2)]
NEXT = 32  # bits after the shared beginning by which suffixes are ordered further


def words(h: Column) -> Column:
    """The hash as a struct of eight 32-bit words held in longs."""
    return F.struct(*[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(8)])


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two word structs."""
    total = F.lit(0)
    for i in range(8):
        total = total + F.bit_count(a[f"w{i}"].bitwiseXOR(b[f"w{i}"]))
    return total


def span(w: Column, start: int, n: int) -> Column:
    """Bits start .. start + n - 1 (n <= 32) as a long; the text goes on from its beginning."""
    start %= 256
    i, at = divmod(start, 32)
    if at + n <= 32:
        return F.shiftrightunsigned(w[f"w{i}"], 32 - at - n).bitwiseAND((1 << n) - 1)
    left = at + n - 32
    high = F.shiftleft(w[f"w{i}"].bitwiseAND((1 << (32 - at)) - 1), left)
    return high.bitwiseOR(F.shiftrightunsigned(w[f"w{(i + 1) % 8}"], 32 - left))


def block(w: Column, b: int) -> Column:
    return span(w, EDGES[b], EDGES[b + 1] - EDGES[b])


def arranged(w: Column) -> Column:
    """19 structs: key (arrangement and its two blocks in one long) and next (the bits that follow)."""
    out = []
    for n, (a, b) in enumerate(ARRANGEMENTS):
        width = EDGES[b + 1] - EDGES[b]
        key = F.lit(n << 32).bitwiseOR(F.shiftleft(block(w, a), width)).bitwiseOR(block(w, b))
        out.append(F.struct(key.alias("key"), span(w, EDGES[b + 1], NEXT).alias("next")))
    return F.array(*out)


def arrangement(key: Column) -> Column:
    return F.shiftrightunsigned(key, 32).cast("int")


def mask(key: Column) -> Column:
    """The two blocks of a key's arrangement as bits of an int."""
    masks = F.array(*[F.lit((1 << a) | (1 << b)) for a, b in ARRANGEMENTS])
    return F.get(masks, arrangement(key))


def finer(key: Column, w: Column, seen: Column) -> Column:
    """Further keys of rows that share a key: (block, content) of 13 more blocks, one of which is equal again.

    `seen` holds the blocks already shared, as a mask; at most 12 blocks differ,
    so any 13 of the rest contain an equal one.
    """
    every = F.array(*[F.struct(F.lit(b).alias("b"), block(w, b).alias("v")) for b in range(BLOCKS)])
    open_ = F.filter(every, lambda x: F.expr("1").cast("int").bitwiseAND(F.call_function("shiftright", seen, x["b"])) == 0)
    return F.transform(F.slice(open_, 1, 13), lambda x: F.struct(x["b"].alias("b"), F.xxhash64(key, x["b"], x["v"]).alias("key")))


def pivot_distances(w: Column) -> Column:
    """Distances to 16 fixed pivots in one long, four bits each.

    Pivot i lives in the sub-space of bits 16i .. 16i+15 and is its zero vector,
    so the distance is the number of bits set there (16 is written as 15).
    """
    packed = F.lit(0).cast("long")
    for i in range(8):
        for half, shift in ((F.shiftrightunsigned(w[f"w{i}"], 16), 8 * i), (w[f"w{i}"].bitwiseAND(65535), 8 * i + 4)):
            d = F.least(F.lit(15), F.bit_count(half)).cast("long")
            packed = packed.bitwiseOR(F.shiftleft(d, shift))
    return packed


def pivot_bound(a: Column, b: Column) -> Column:
    """Lower bound of the Hamming distance from two packed pivot rows.

    |d(a,p) - d(b,p)| <= d(a,b) holds in each sub-space (triangle inequality),
    and the sub-spaces are disjoint, so the differences add up.
    """
    total = F.lit(0).cast("long")
    for i in range(16):
        x = F.shiftrightunsigned(a, 4 * i).bitwiseAND(15)
        y = F.shiftrightunsigned(b, 4 * i).bitwiseAND(15)
        total = total + F.abs(x - y)
    return total
