"""Observes the lines of many texts at once.

Passes of numpy over the signs of a block of stretches give what ``LineStates.watch`` gives for each text; a rule that needs a pattern (cells,
markup, logs, codes, items) looks only at the stretches that hold its signs. Words are known by 64-bit numbers, distinct for distinct words but for
chances of 1e-16 a word.
"""

from __future__ import annotations

import re
from functools import cache

from fathomline.llm import line_states as L

#: Signs that are looked at together.
BLOCK = 1 << 17
#: At most as many are looked at, with the last stretch and the signs between.
_MOST = BLOCK + 1024
#: Counts of a stretch that share one number, 9 bits each (a stretch has at most 280 signs).
_COUNTED = ("alnum", "blank", "space", "beyond_ascii", "digit", "dense", "beyond")
_OTHER, _ALONE = 63, 62  # bits beside those of ASCII marks: further marks; signs whose lower case depends on others or is longer
_CLOSING = "\"'”’»)]」』"
_ENDING = ".!?…:;。！？؟"
_ITEM_SIGNS = "-*•·–—‣▪("


class Tables:
    """What is known of each code point."""

    def __init__(self):
        import numpy as np

        every = "".join(map(chr, range(0x110000)))

        def where(signs: str):
            got = np.zeros(0x110000, bool)
            for m in re.finditer(f"{signs}+", every):
                got[m.start() : m.end()] = True
            return got

        alnum, space, digit = where(r"[^\W_]"), where(r"\s"), where(r"\d")
        self.counts, self.marks = np.zeros(0x110000, np.uint64), np.zeros(0x110000, np.uint64)
        code = np.arange(0x110000)
        for i, on in enumerate((alnum, code == 32, space, code > 127, digit, where(L._DENSE.pattern), where(L._BEYOND.pattern.rstrip("+")))):
            self.counts |= on.astype(np.uint64) << np.uint64(9 * i)
        mark = ~alnum & ~space
        ascii_marks = np.flatnonzero(mark[:128])
        self.bit = {chr(c): 1 << i for i, c in enumerate(ascii_marks)}
        self.marks[ascii_marks] = np.uint64(1) << np.arange(len(ascii_marks), dtype=np.uint64)
        self.marks[128:][mark[128:]] = np.uint64(1 << _OTHER)
        self.marks[[ord("İ"), ord("Σ")]] = np.uint64(1 << _ALONE)
        self.counts[10] = self.marks[10] = 0  # lies between stretches
        self.alnum, self.space, self.digit = alnum, space, digit
        self.solid = where(L._CODED.pattern.split("{")[0])
        lower = np.frombuffer(every.replace("İ", "i").replace("Σ", "σ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chance = np.where(alnum, np.random.default_rng(5).integers(1, 1 << 63, 0x110000, np.uint64)[lower], np.uint64(0))
        latin = np.flatnonzero(where(L._LATIN.pattern.split("{")[0]))
        self.letters = {chr(c): i + 1 for i, c in enumerate(latin)}
        ids = np.zeros(0x110000, np.uint8)
        ids[latin] = np.arange(1, len(latin) + 1)
        self.letter = ids[lower]
        lead, trail = L._MOJIBAKE.pattern.split("|")[0][1:-1].split("][")
        self.lead, self.trail = where(f"[{lead}]"), where(f"[{trail}]")
        self.closing, self.ending, self.item = where(f"[{re.escape(_CLOSING)}]"), where(f"[{re.escape(_ENDING)}]"), where(f"[{re.escape(_ITEM_SIGNS)}]") | digit
        base = 0x9E3779B97F4A7C15
        self.power, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(_MOST, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))


tables = cache(Tables)


def _runs(on):
    """(starts, ends) of the runs in a mask whose first and last places are off."""
    import numpy as np

    edges = np.flatnonzero(on[1:] != on[:-1]) + 1
    return edges[::2], edges[1::2]


def _sums(values, at):
    """Sums of values between the places at."""
    import numpy as np

    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])


class LineBlocks:
    """Observes blocks of stretches with the words and letter pairs of a model."""

    def __init__(self, model):
        import numpy as np

        self.model, self.t = model, tables()
        size = len(self.t.letters) + 1
        self.pairs = np.zeros((size, size))
        names = list(self.t.letters)
        for i, a in enumerate(["^", *names]):
            for j, b in enumerate([*names, "$"]):
                self.pairs[i, (j + 1) % size] = model.odd.chance.get((a, b), model.odd.unseen.get(a, -6.0))
        self.pairs[0, 0] = 0.0
        self.pairs = self.pairs.ravel()
        flags: dict[int, int] = {}
        for flag, words in ((1, L.FUNCTION_WORDS), (2, model.common)):
            for w in words:
                if w and w == w.lower() and w.isalnum():
                    h = sum(int(self.t.chance[ord(c)]) * int(self.t.power[i]) for i, c in enumerate(w)) % (1 << 64)
                    flags[h] = flags.get(h, 0) | flag
        self.known = np.array(sorted(flags), np.uint64)
        self.flags = np.array([flags[h] for h in sorted(flags)] or [0], np.uint8)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known >> np.uint64(48)] = True

    def observe(self, xs: list[str]):
        """(codes, non-blank signs, words, letters, common words, solid signs, whether it ends as a sentence) of non-blank stretches, arrays."""
        import numpy as np

        t, m = self.t, self.model
        c = np.frombuffer(("\n" + "\n".join(xs) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, xs), np.int64, len(xs))
        ends = np.cumsum(n + 1)
        starts = ends - n
        bounds = np.append(starts, len(c))
        at = lambda places: np.searchsorted(starts, places, "right") - 1
        few = lambda on: np.flatnonzero(on).tolist()
        packed = np.add.reduceat(t.counts[c], starts)
        letters, blanks, spaces, far, digits, dense, beyond = ((packed >> np.uint64(9 * i) & np.uint64(511)).astype(np.int64) for i in range(len(_COUNTED)))
        marks = t.marks[c]
        held = np.bitwise_or.reduceat(marks, starts)
        has = lambda signs: np.all([held & np.uint64(t.bit[s]) != 0 for s in signs], axis=0)
        plain = far == 0

        # words
        alnum = t.alnum[c]
        w0, w1 = _runs(alnum)
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(t.chance[c] * t.power[: len(c)], out=sums[1:])
        h = (sums[w1] - sums[w0]) * t.inverse[w0]
        wi = np.searchsorted(w0, bounds)
        words = np.diff(wi)
        flags = np.zeros(len(h), np.uint8)
        maybe = np.flatnonzero(self.maybe[h >> np.uint64(48)])
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
            flags[maybe] = np.where(self.known[place] == h[maybe], self.flags[place], 0)
        functions, common = _sums(flags & 1, wi), _sums(flags >> 1, wi)
        repeats = (words >= 10).astype(np.int64)
        many = np.flatnonzero(words >= 10)
        if len(many):
            bits = np.append(np.uint64(1) << (h >> np.uint64(58)), np.uint64(0))
            least = np.bitwise_count(np.bitwise_or.reduceat(bits, np.stack([wi[many], wi[many + 1]], 1).ravel())[::2])
            for i in many[1 - least / words[many] >= 0.4].tolist():
                own = h[wi[i] : wi[i + 1]].tolist()
                repeats[i] = L.bisect_right((0.0, 0.4, 0.75), 1 - len(set(own)) / len(own))

        # letter pairs of Latin runs
        ids = t.letter[c]
        size = len(t.letters) + 1
        l0, l1 = _runs(ids != 0)
        chances = np.concatenate([[0.0], np.cumsum(self.pairs[ids[:-1].astype(np.int32) * size + ids[1:]])])
        long = l1 - l0 >= 3
        l0, l1 = l0[long], l1[long]
        mean = (chances[l1] - chances[l0 - 1]) / (l1 - l0 + 1)
        strange = mean < -3.6
        for i in few(np.abs(mean + 3.6) < 1e-6):  # sums of another order: decided as one word
            a, p = l0[i], at(l0[i])
            strange[i] = m.odd[xs[p][a - starts[p] : l1[i] - starts[p]].lower()]
        li = np.searchsorted(l0, bounds)
        runs = np.diff(li)
        alpha = beyond / n
        odd = np.where((runs >= 3) & (alpha <= 0.5), _sums(strange, li) / np.maximum(runs, 1), 0.0)

        k = words + np.where(plain, 0, dense // 2)
        symbols = 1.0 - (letters + blanks) / n
        fn = np.where(words > 0, functions / np.maximum(words, 1), 0.0)

        # cells: by commas only where each part that tells something has at most four words
        divided, numbers = np.zeros(len(xs), np.int64), np.zeros(len(xs))
        comma, space = c == 44, t.space[c]
        apart = comma | space
        tokens = np.zeros(len(c) + 1, np.int32)
        np.cumsum(apart[:-1] & ~apart[1:], out=tokens[2:])
        told = np.zeros(len(c) + 1, np.int32)
        np.cumsum(alnum, out=told[1:])
        cuts = np.sort(np.concatenate([starts, np.flatnonzero(comma) + 1]))
        part_ends = np.append(cuts[1:], len(c))
        wide = (tokens[part_ends] - tokens[cuts] > 4) & (told[part_ends] > told[cuts])
        prose = np.zeros(len(xs), bool)
        prose[at(cuts[wide])] = True
        cells = has(",") & ~prose | has("|") | has(";") | (spaces > blanks)
        gaps = np.flatnonzero(c == 32)
        cells[at(gaps[1:][np.diff(gaps) == 1])] = True
        for i in few(cells):
            divided[i], numbers[i] = L._cells(xs[i], k[i])

        # broken encodings, further marks
        broken, kinds = np.zeros(len(xs), np.int64), np.bitwise_count(held & np.uint64((1 << len(t.bit)) - 1)).astype(np.int64)
        if not plain.all():
            high = np.flatnonzero(c > 127)
            bad = high[(t.lead[c[high]] & t.trail[c[high + 1]]) | (c[high] == 0xFFFD)]
            broken = np.bincount(at(bad), minlength=len(xs))
            other = np.flatnonzero(marks >> np.uint64(_OTHER) != 0)
            pairs = np.unique(at(other) << 21 | c[other].astype(np.int64))
            kinds += np.bincount(pairs >> 21, minlength=len(xs))
        broken = np.where((broken * 12 > n) | (broken >= 4) & (broken * 25 > n), 2, broken > 1)

        # by pattern, where the signs are there
        marked, coded, logged, item, counted = (np.zeros(len(xs), np.int64) for _ in range(5))
        for i in few(has("<>") | has("&;") | has("{:}")):
            marked[i] = L.bisect_right((0.02, 0.5), sum(map(len, L._MARKUP.findall(xs[i]))) / int(n[i]))
        loose = np.flatnonzero(~t.solid[c])
        for i in np.unique(at(loose[:-1][np.diff(loose) > 32] + 1)).tolist():
            x = xs[i]
            coded[i] = 2 * ("://" not in x and 2 * sum(map(len, L._CODED.findall(x))) > len(x))
        figures, one = digits > 0, np.uint64((1 << len(t.bit)) - 1 - t.bit[":"])
        for i in few(figures & (held & one == 0) & (n >= 8) & (coded == 0) & (held >> np.uint64(_OTHER) == 0)):
            x = xs[i]
            coded[i] = L._hex(x) and not x.isdigit() and L._LATIN.search(x.lower()) is not None
        hexed = np.zeros(len(xs), bool)
        x_at = np.flatnonzero(c == 120)
        hexed[at(x_at[c[x_at - 1] == 48])] = True
        for i in few((fn < 0.2) & (has("[") | has("=") | hexed | figures & has("-:"))):
            logged[i] = L._LOG.search(xs[i]) is not None
        first, second, last = c[starts], c[starts + 1], c[ends - 1]
        for i in few(t.item[first] | (second == 46) | (second == 41)):
            x = xs[i]
            item[i] = (not x[0].isalpha() or x[1:2] in ".)") and L._ITEM.match(x) is not None
        for i in few((last == 41) & t.digit[c[ends - 2]]):
            counted[i] = L._COUNT.search(xs[i]) is not None
        tail = ends - 1
        while len(back := np.flatnonzero(t.closing[c[tail]])):
            tail[back] -= 1  # the sign between stretches stops it
        sentence = t.ending[c[tail]].astype(np.int64)

        right = lambda edges, v: np.searchsorted(edges, v, "right")
        seen = (
            np.where(alpha <= 0.5, right((0.01, 0.08, 0.14, 0.2), fn), 5), right((1, 3, 5, 9, 15), k), sentence, item,
            right((0.06, 0.1, 0.15, 0.25, 0.35), symbols), divided, right((0.01, 0.2, 0.6), numbers), right((0.3, 0.55, 0.75), letters / n), alpha > 0.5,
            broken, marked, logged, coded,
            right((0.01, 0.3, 0.5), odd), repeats, counted, right((4, 8), kinds),
        )
        codes = sum(s * p for s, p in zip(seen, L.PLACES))
        for i in few(held >> np.uint64(_ALONE) & np.uint64(1)):
            low = list(map(str.lower, L.text_words(xs[i])))
            codes[i], common[i] = L.code(m.observe(xs[i], low)), sum(map(m.common.__contains__, low))
        return codes.astype(np.int32), n - blanks, words, letters, common, n - spaces, sentence

    def watch(self, texts: list[str | None]):
        """(the five statistics of each text, NaN for none; codes, sizes, stretches of each text), arrays: what ``LineStates.watch`` gives text by text."""
        import numpy as np

        total = np.zeros((len(texts), 6))  # words, letters, common words, solid signs, lines, lines that end as a sentence
        counts, codes, sizes = np.zeros(len(texts), np.int64), [], []
        xs: list[str] = []
        owner: list[int] = []
        whole: list[bool] = []  # whether the words of the stretch are words of its text
        last: list[bool] = []  # whether the line's end is seen at that of the stretch
        signs = 0

        def flush():
            got = self.observe(xs)
            codes.append(got[0])
            sizes.append(got[1].astype(np.int32))
            own = np.array(owner)
            add = lambda v: np.bincount(own, weights=v, minlength=len(texts))
            for i, v in enumerate(got[2:5]):
                total[:, i] += add(v * np.array(whole))
            total[:, 3] += add(got[5])
            total[:, 5] += add(got[6] * np.array(last))
            counts[:] += np.bincount(own, minlength=len(texts))
            for out in (xs, owner, whole, last):
                out.clear()

        for i, text in enumerate(texts):
            for line in (text or "").split("\n"):
                x = line.strip()
                if not x:
                    continue
                total[i, 4] += 1
                parts, clean = ((x,), True) if len(x) <= 2 * L.STRETCH else L.LineStates.cut(x)
                if not clean:  # a cut within a word: the words are those of the line
                    found = L.text_words(x)
                    total[i, :3] += len(found), sum(map(len, found)), sum(map(self.model.common.__contains__, map(str.lower, found)))
                    total[i, 5] += L._END.search(x) is not None
                for j, p in enumerate(parts, 1):
                    if signs >= BLOCK:
                        flush()
                        signs = 0
                    xs.append(p)
                    owner.append(i)
                    whole.append(clean)
                    last.append(clean and j == len(parts))
                    signs += len(p) + 1
        if xs:
            flush()
        none = np.zeros(0, np.int32)
        words, letters, common, solid, lines, sentences = total.T
        with np.errstate(invalid="ignore", divide="ignore"):
            stats = words.astype(np.int64), letters / words, (solid - letters) / solid, sentences / lines, common / words
        return stats, np.concatenate([none, *codes]), np.concatenate([none, *sizes]), counts
