"""What the gates before the exact check may lose."""

from math import comb

from driftlode.llm import linededup, minhash


def lost(n, least, same=0.8):
    return sum(comb(n, i) * same**i * (1 - same) ** (n - i) for i in range(least))


def test_the_gates_lose_few_pairs():
    assert lost(minhash.MINIMA, minhash.LEAST) < 2e-6
    assert minhash.PREFIX + minhash.LEAST == minhash.MINIMA + 1  # so that every candidate shares a posted pair
    assert lost(linededup.KEPT, linededup.LEAST) < 3e-5 < (1 - 0.8**linededup.ROWS) ** linededup.BANDS < 1 / 1300
