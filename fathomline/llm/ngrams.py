"""Character n-gram models with windowed likelihood ratios."""

from __future__ import annotations

import re

_DIGIT = re.compile(r"\d")


def codes(text: str):
    """Code points of the lower-cased text, digits as 0; as long as the lower-cased text."""
    import numpy as np

    low = _DIGIT.sub("0", text.lower())
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), low


def hashed(c, n: int, bits: int):
    """Hash of the n-gram that begins at each position."""
    import numpy as np

    m = len(c) - n + 1
    if m < 1:
        return np.zeros(0, np.int64)
    h = c[:m].astype(np.uint64)
    for k in range(1, n):
        h = h * np.uint64(0x100000001B3) ^ c[k : k + m]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class RatioModel:
    """log P(n-gram | class) - log P(n-gram | the likeliest of the other sorts of text); n-grams seen in none are neutral."""

    def __init__(self, own: list[str], *others: list[str], n: int = 5, bits: int = 17, smooth: float = 0.05, lower: bool = True):
        import numpy as np

        self.n, self.bits = n, bits
        rates = []
        for texts in (own, *others):
            t = np.zeros(1 << bits)
            for x in texts:
                c = codes(x)[0] if lower else np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                np.add.at(t, hashed(c, n, bits), 1.0)
            rates.append(np.log((t / max(t.sum(), 1.0)) * 10_000 + smooth))
        self.table = np.clip(rates[0] - np.max(rates[1:], axis=0), -4, 4).astype(np.float32)

    def hashes(self, c):
        return hashed(c, self.n, self.bits)

    def covered(self, h, size: int, window: int, bar: float):
        """Boolean per character of a text of that size with n-gram hashes h: within a window whose mean ratio exceeds the bar; None when there is no such window."""
        import numpy as np

        if len(h) == 0:
            return None
        w = min(window, len(h))
        s = np.empty(len(h) + 1, np.float32)
        s[0] = 0
        np.cumsum(self.table[h], out=s[1:])
        at = np.nonzero(s[w:] - s[:-w] > w * bar)[0]
        if not len(at):
            return None
        edge = np.zeros(size + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + w + self.n - 1, size), -1)
        return np.cumsum(edge[:-1]) > 0


def longest_run(mask) -> int:
    import numpy as np

    if mask is None:
        return 0
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return int((np.nonzero(d < 0)[0] - np.nonzero(d > 0)[0]).max())
