"""Texts for the tests."""

from __future__ import annotations

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """Words that differ from seed to seed."""
    state, out = seed * 7919 + 13, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[state >> 8 & 15] + WORDS[state >> 14 & 15][:3] + str(state >> 20 & 7) * (state >> 25 & 1))
    return " ".join(out)
