"""Pairs of different words that sums of powers modulo 2**64 cannot tell apart, whatever the odd base."""

import numpy as np


def polynomial(times: tuple[int, ...]) -> np.ndarray:
    """The product of factors 1 - x**(2**i), each ``times[i]`` times. For odd x such a factor is divisible by 2**(i + 2), or by 2 for i = 0."""
    assert sum(t * (i + 2 if i else 1) for i, t in enumerate(times)) >= 64
    out = np.ones(1, object)
    for i, t in enumerate(times):
        for _ in range(t):
            out = np.append(out, [0] * (1 << i)) - np.append([0] * (1 << i), out)
    return out


def pair(first: str, times: tuple[int, ...]) -> tuple[str, str]:
    """Two words of characters from ``first`` on, whose differences are the coefficients."""
    c = polynomial(times)
    return tuple("".join(chr(ord(first) + max(sign * int(x), 0)) for x in c) for sign in (1, -1))


#: Of 71, 216 and 128 characters.
CHINESE, LETTERS, ASCII = pair("一", (0, 7, 6, 4)), pair("a", (1, 1, 1, 2, 4, 2, 1)), pair("!", (1, 1, 5, 3, 3, 1))
