"""Keyed permutations and combinations by number, so that samples need no enumeration.

A permutation of 0 .. n-1 is computed index by index: in every round x is paired with
(k - x) mod n, and one bit of a keyed mix of the larger of the two decides whether they
swap.  The pairing is its own inverse and both partners see the same bit, so each round,
and with it the whole, is a bijection of any n; nothing is sorted or stored.

A k-combination of m things has a number below C(m, k) in dictionary order, and can be
built from that number alone.
"""

from __future__ import annotations

import math
from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import labels as lb
from holdfast.functions import text as tx

# Fixed values that the permutation and its oracles share.
ROUNDS = 12
ROUNDS_PER_DIGEST = 4
HEX_DIGITS = 15  # of a round's key
MASK = (1 << 31) - 1
PRIMES = (2147483587, 2147483647, 2147483629)
FACTORS = (1103515245, 1812433253)
LARGEST = 1 << 60


def round_keys(*seed: Column | str) -> Column:
    """One number of 60 bits per round, cut from the sampling keys of (seed, digest number)."""
    digests = F.array(*[lb.sampling_key(*seed, F.lit(i)) for i in range(-(-ROUNDS // ROUNDS_PER_DIGEST))])

    def cut(made: Column) -> Column:
        places = [(r // ROUNDS_PER_DIGEST, HEX_DIGITS * (r % ROUNDS_PER_DIGEST) + 1) for r in range(ROUNDS)]
        return F.array(*[F.conv(F.substring(made[d], at, HEX_DIGITS), 16, 10).cast("long") for d, at in places])

    return tx.bind(digests, cut)


def permuted(index: Column, size: Column, keys: Column) -> Column:
    """The place of ``index`` (0 .. size-1) in the permutation of ``size`` things that ``keys`` fix.

    ``keys`` are ``round_keys``.  Null without a size; more than 2^60 things are an error.
    """
    start = F.when(size <= LARGEST, index.cast("long")).otherwise(
        F.when(size.isNotNull(), F.raise_error(F.lit("a permutation of more than 2^60 things")).cast("long"))
    )

    def swapped(x: Column, key: Column) -> Column:
        # Each part occurs once: lambdas have no common subexpressions.
        other = F.pmod(key - x, size)
        mixed = (F.greatest(x, other) % PRIMES[0]).bitwiseXOR(key).bitwiseAND(F.lit(MASK))
        for factor, prime in zip(FACTORS, PRIMES[1:], strict=True):
            mixed = mixed * factor % prime
        return F.when(mixed % 2 == 1, other).otherwise(x)

    return F.aggregate(keys, start, swapped)


def binomials(things: int, picked: int) -> Column:
    """C(a, b) for a <= things and b <= picked, a row after the other, as one literal array."""
    if math.comb(things, min(picked, things // 2)) > LARGEST:
        raise ValueError("more than 2^60 combinations")
    return F.lit([math.comb(a, b) for a in range(things + 1) for b in range(picked + 1)]).cast("array<long>")


def binomial_of(a: Column, b: Column, things: int, picked: int) -> Column:
    """C(a, b) out of ``binomials(things, picked)``."""
    return F.get(binomials(things, picked), a * (picked + 1) + b)


def combination(number: Column, things: int, picked: Column, most: int) -> Column:
    """The places (0 .. things-1, ascending) of the combination with this number in dictionary order.

    ``picked`` is at most ``most``.  Place after place is taken if the number is below the
    count of combinations that take it, and otherwise less that count.
    """
    def step(state: Column, place: Column) -> Column:
        with_it = F.when(
            state["need"] > 0, binomial_of(F.lit(things - 1) - place, state["need"] - 1, things, most)
        ).otherwise(F.lit(0).cast("long"))
        take = state["left"] < with_it
        return F.struct(
            F.when(take, state["left"]).otherwise(state["left"] - with_it).alias("left"),
            (state["need"] - take.cast("int")).alias("need"),
            F.when(take, F.concat(state["places"], F.array(place))).otherwise(state["places"]).alias("places"),
        )

    start = F.struct(
        number.cast("long").alias("left"), picked.cast("int").alias("need"), F.array().cast("array<int>").alias("places")
    )
    places = F.sequence(F.lit(0), F.lit(things - 1)) if things > 0 else F.array().cast("array<int>")
    return F.aggregate(places, start, step, lambda s: s["places"])
