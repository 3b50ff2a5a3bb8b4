"""Integer arithmetic modulo 2^64 that the hash columns are held against."""

from functools import reduce

TOP = 1 << 64
# fixed values: the hash definitions' constants
GOLDEN, STEPS = 0x9E3779B97F4A7C15, (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1)


def mix(i: int, seed: int) -> int:
    """Shift-xor and multiply by each step's constant, modulo 2^64."""
    return reduce(lambda h, c: (h ^ (h >> 33)) * c % TOP, STEPS, (i % TOP) ^ seed ^ GOLDEN)


def mix_order(ids, seed):
    """Ids by mixed hash, then id."""
    return sorted(ids, key=lambda i: (mix(i, seed), i))


def signed(h: int) -> int:
    return h - TOP if h >= TOP // 2 else h
