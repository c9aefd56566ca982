"""Problem 10: per-document text quality statistics.

Every line (long ones in stretches) gets a label prose, list, table or junk from
a hidden Markov model. A line is observed by its statistics, each in a few
classes (``observe``). Emissions begin with lines of known states: the sample
texts for prose, and lists, tables and junk drawn by rule from the sample's
words (``drawn_lines``); then emissions and transitions are fitted to all lines
of all documents by Baum-Welch: observations are made and written once, as one
number a line, and each round sums expected counts over them. The Viterbi path
gives the labels. Label
shares are aggregated per document beside word count, mean word length, symbol
ratio, share of lines that end in punctuation and share of common words.

Defined cases: null and blank texts have zero counts and null ratios and no
kind; ties of label shares go to list before table before junk.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from operator import mul

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.io import shared_folder
from fathomline.llm.common import table
from fathomline.llm.keyword_spam import FUNCTION_WORDS

#: Rounds of the fit.
FIT_ROUNDS = 8
#: Weight of the drawn lines beside the documents.
PRIOR = 0.8
STATES = ("prose", "list", "table", "junk")
MIN_CHARS = 100
STRETCH = 140

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…:;。！？؟][\"'”’»)\]」』]*$")
_ITEM = re.compile(r"^(?:[-*•·–—‣▪]\s+|\(?\d{1,3}[.)]\s+|\(?[a-z][.)]\s+)", re.I)
_COUNT = re.compile(r"\(\d+\)$")
_WIDE = re.compile(r"\S {2,}(?=\S)")
_NUMERIC = re.compile(r"^[-+]?[\d.,]+%?$")
_MOJIBAKE = re.compile("[ÂÃÐÑâåäæçèéï][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|�")
_MARKUP = re.compile(r"</?[a-z][^<>]*>|&[a-z]+;|&#\d+;|\{[^{}]*:[^{}]*\}")
_LOG = re.compile(r"^\W*\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[(?:INFO|WARN|ERR|ERROR|DEBUG|TRACE)\]|\b0x[0-9a-f]{4,}\b|\b\w+=\S+ \w+=\S+")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{2,}")
_CODED = re.compile(r"[A-Za-z0-9+/=_%-]{32,}")
_RULE = re.compile(r"^[-|:+=_ ]+$")
_LATIN = re.compile(r"[a-zà-öø-ÿ]{3,}")
_DIGIT = re.compile(r"\d")
_ALNUM = frozenset(c for c in map(chr, range(128)) if c.isalnum())
_GAPS = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_MARKS = {i: None for i in range(128) if chr(i).isalnum() or chr(i).isspace()}
_PLAIN = frozenset(c for c in map(chr, range(128)) if c.isalnum() or c.isspace())
#: Signs of scripts that set no blanks between words.
_DENSE = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]")
#: Letters beyond the Latin scripts; their function words aren't known (a class of its own).
_BEYOND = re.compile("[^\\W\\d_\u0000-\u0370]+")


def _hex(x: str) -> bool:
    """Whether a stretch is four or more groups of two or more hexadecimal digits, with blanks or colons between them or none; each sign is looked at once."""
    runs = x.replace(":", " ").split()
    return x[0] != ":" and all(map(_HEX_RUN.fullmatch, runs)) and sum([len(r) // 2 for r in runs]) >= 4


class Odd(dict):
    """word -> whether a Latin word is unlike the sample words, by its mean log-chance under their letter pairs; remembers."""

    def __init__(self, texts: list[str]):
        pairs, firsts = Counter(), Counter()
        for t in texts:
            for w in set(_LATIN.findall(t.lower())):
                x = f"^{w}$"
                pairs.update(zip(x, x[1:]))
                firsts.update(x[:-1])
        self.chance = {p: math.log((n + 0.05) / (firsts[p[0]] + 2.0)) for p, n in pairs.items()}
        self.unseen = {a: math.log(0.05 / (n + 2.0)) for a, n in firsts.items()}

    def __missing__(self, word: str) -> bool:
        x = f"^{word}$"
        s = sum([self.chance.get(p, self.unseen.get(p[0], -6.0)) for p in zip(x, x[1:])]) / (len(x) - 1)
        if len(self) > 200_000:
            self.clear()
        self[word] = got = s < -3.6
        return got


class Told(dict):
    """Lower-cased ASCII word -> what it adds to the counts of a stretch, one number: function words, runs of three letters or more, odd ones among these, letters, common words; remembers."""

    def __init__(self, odd: Odd, common: frozenset[str]):
        self.odd, self.common = odd, common

    def __missing__(self, word: str) -> int:
        runs = _LATIN.findall(word)
        if len(self) > 200_000:
            self.clear()
        self[word] = got = (word in FUNCTION_WORDS) | len(runs) << 16 | sum([self.odd[r] for r in runs]) << 32 | len(word) << 48 | (word in self.common) << 64
        return got

    def counts(self, words: list[str]) -> tuple[int, int, int, int, int]:
        """Of the words of a stretch, of which each count is below 65,536."""
        v = sum(map(self.__getitem__, words))
        return v & 65535, v >> 16 & 65535, v >> 32 & 65535, v >> 48 & 65535, v >> 64


#: Classes of each observed statistic.
SIZES = (6, 6, 2, 2, 6, 8, 4, 4, 2, 3, 3, 2, 3, 4, 4, 2, 3)


def _told(p: str) -> bool:
    """Whether a part holds a letter or digit."""
    return not _ALNUM.isdisjoint(p) or any(map(str.isalnum, p))


def _short(parts: list[str]) -> bool:
    return all(len(p.split()) <= 4 for p in parts)


def _cells(x: str, k: int) -> tuple[int, float]:
    """(how a line is divided, share of numbers among its parts): 1 tab, 2 bar, 3 semicolon, 4 wide gaps, 5 commas with a blank, 6 bare commas, 7 loose commas, 0 not."""
    for n, sep in ((1, "\t"), (2, "|"), (3, ";")):
        if sep in x:
            parts = [p.strip() for p in x.strip(" |").split(sep) if _told(p)]
            if len(parts) >= 2 and k <= 6 * len(parts) and (sep != ";" or _short(parts)):
                return n, _numbers(parts)
    if "  " in x and _WIDE.search(x):
        parts = [p for p in re.split(r" {2,}", x) if _told(p)] or [x]
        if _short(parts):
            return 4, _numbers(parts)
    if "," in x:
        parts = [p.strip() for p in x.split(",") if _told(p)]
        if len(parts) >= 2 and _short(parts):
            return (5 if len(parts) >= 3 else 7) if ", " in x else 6, _numbers(parts)
    return 0, 0.0


def text_words(x: str) -> list[str]:
    """Maximal runs of letters and digits."""
    return x.translate(_GAPS).split() if x.isascii() else _WORD.findall(x)


def _numbers(parts: list[str]) -> float:
    return sum([_NUMERIC.match(p) is not None for p in parts]) / len(parts)


class LineStates:
    """Observes, labels and measures; start, moves and emissions are log-chances (see ``fit_chain``)."""

    def __init__(self, samples: list[str], common, start=None, moves=None, emissions=None):
        self.odd, self.common = Odd(samples), frozenset(common)
        self.told = Told(self.odd, self.common)
        self.start, self.moves, self.emissions = start, moves, emissions

    def observe(self, x: str, ws: list[str] | None = None, counts: tuple | None = None) -> tuple[int, ...]:
        """Classes of the statistics of a non-blank stretch, in the order of SIZES; ws are its lower-cased words where they are known, and counts those of ASCII words."""
        n, plain, digits = len(x), x.isascii(), _DIGIT.search(x) is not None
        if ws is None:
            ws = text_words(x.lower())
        k = len(ws)
        alpha = odd = 0.0
        if plain:
            fn, runs, odds, letters, _ = counts or self.told.counts(ws)
            if runs >= 3:
                odd = odds / runs
        else:
            k += len(_DENSE.findall(x)) // 2  # scripts without blanks: two signs a word
            fn, letters = sum(map(FUNCTION_WORDS.__contains__, ws)), sum(map(len, ws))
            alpha = sum(map(len, _BEYOND.findall(x))) / n
            if alpha <= 0.5:
                latin = _LATIN.findall(x.lower())
                if len(latin) >= 3:
                    odd = sum(map(self.odd.__getitem__, latin)) / len(latin)
        symbols = 1.0 - (letters + x.count(" ")) / n
        fn = fn / len(ws) if ws else 0.0
        divided, numbers = _cells(x, k)
        broken = 0 if plain else len(_MOJIBAKE.findall(x))
        marked = sum(map(len, _MARKUP.findall(x))) / n if "<" in x or "&" in x or "{" in x else 0.0
        coded = 0
        if n >= 32 and "://" not in x and 2 * sum(map(len, _CODED.findall(x))) > n:
            coded = 2
        elif digits and _hex(x) and not x.isdigit() and _LATIN.search(x.lower()):
            coded = 1
        marks = set(x.translate(_MARKS)) if plain else [c for c in set(x) - _PLAIN if not (c.isalnum() or c.isspace())]
        return (
            bisect_right((0.01, 0.08, 0.14, 0.2), fn) if alpha <= 0.5 else 5, bisect_right((1, 3, 5, 9, 15), k), int(not x[-1].isalnum() and _END.search(x) is not None), int((not x[0].isalpha() or x[1:2] in ".)") and _ITEM.match(x) is not None),
            bisect_right((0.06, 0.1, 0.15, 0.25, 0.35), symbols), divided, bisect_right((0.01, 0.2, 0.6), numbers), bisect_right((0.3, 0.55, 0.75), letters / n), int(alpha > 0.5),
            2 if broken * 12 > n or broken >= 4 and broken * 25 > n else int(broken > 1), bisect_right((0.02, 0.5), marked), int(fn < 0.2 and (digits or "[" in x or "=" in x) and _LOG.search(x) is not None), coded,
            bisect_right((0.01, 0.3, 0.5), odd), 0 if len(ws) < 10 else bisect_right((0.0, 0.4, 0.75), 1 - len(set(ws)) / len(ws)), int(x[-1] == ")" and _COUNT.search(x) is not None), bisect_right((4, 8), len(marks)),
        )

    def scores(self, seen):
        """(stretches, states) log-chances of observed stretches."""
        import numpy as np

        return self.emissions[np.arange(len(SIZES))[None, :], np.array(seen)].sum(axis=1)

    @staticmethod
    def cut(line: str) -> tuple[list[str], bool]:
        """(stretches of a line, whether all cuts are at blanks)."""
        x = line.strip()
        if len(x) <= 2 * STRETCH:
            return [x] if x else [], True
        out, at, clean = [], 0, True
        while at < len(x):
            end = at + STRETCH
            if end < len(x):
                cut = x.find(" ", end, end + 60)
                clean &= cut > 0
                end = cut if cut > 0 else end
            piece = x[at:end].strip()
            if piece:
                out.append(piece)
            at = end
        return out, clean

    @classmethod
    def stretches(cls, line: str) -> list[str]:
        return cls.cut(line)[0]

    def path(self, seen) -> list[int]:
        """Viterbi path of observed stretches; ties go to the state first in STATES."""
        if not seen:
            return []
        rows = self.scores(seen).tolist()
        into = self.moves.T.tolist()  # into[s][r]: from r to s
        best, back = [a + b for a, b in zip(self.start.tolist(), rows[0])], []
        for e in rows[1:]:
            step, new = [], []
            for s in range(4):
                m = into[s]
                ways = [best[0] + m[0], best[1] + m[1], best[2] + m[2], best[3] + m[3]]
                top = max(ways)
                step.append(ways.index(top))
                new.append(top + e[s])
            back.append(step)
            best = new
        s = best.index(max(best))
        out = [s]
        for step in reversed(back):
            s = step[s]
            out.append(s)
        return out[::-1]

    def labels(self, text: str) -> list[tuple[str, int]]:
        """(stretch, state) in order."""
        xs = [p for line in text.split("\n") for p in self.stretches(line)]
        return list(zip(xs, self.path([self.observe(x) for x in xs])))

    def shares(self, text: str) -> list[float] | None:
        """Share of the non-blank characters in each state."""
        sums = [0, 0, 0, 0]
        for x, s in self.labels(text):
            sums[s] += len(x) - x.count(" ")
        total = sum(sums)
        return [v / total for v in sums] if total else None

    def watch(self, text: str) -> tuple[tuple, list[int], list[int]]:
        """((words, mean word length, symbol ratio, end punctuation share, common share), numbered observations, non-blank characters of each stretch): one pass over the lines."""
        words = letters = common = lines = ends = 0
        codes, sizes = [], []
        for line in text.split("\n"):
            x = line.strip()
            if not x:
                continue
            lines, ends = lines + 1, ends + (not x[-1].isalnum() and _END.search(x) is not None)
            parts, clean = self.cut(x)
            for p in parts if clean else (*parts, x):  # a cut within a word: the words are those of the line
                if p.isascii():
                    low = text_words(p.lower())
                    counts = self.told.counts(low) if p is not x or len(parts) == 1 else (0, 0, 0, sum(map(len, low)), sum(map(self.common.__contains__, low)))
                else:
                    found = text_words(p)
                    low = list(map(str.lower, found))
                    counts = 0, 0, 0, sum(map(len, found)), sum(map(self.common.__contains__, low))
                if clean or p is x:
                    words, letters, common = words + len(low), letters + counts[3], common + counts[4]
                if clean or p is not x:
                    codes.append(code(self.observe(p, low, counts)))
                    sizes.append(len(p) - p.count(" "))
        solid = len(text) - sum(map(text.count, _BLANKS))
        return (words, letters / words if words else None, (solid - letters) / solid if solid else None, ends / lines if lines else None, common / words if words else None), codes, sizes

    def kind(self, text: str | None, shares: list[float] | None) -> str | None:
        if text is None or len(text) < MIN_CHARS or shares is None or 1.0 - shares[0] <= 0.5:
            return None
        return STATES[max((1, 2, 3), key=lambda s: (shares[s], -s))]


def drawn_lines(samples: list[str], seed: int = 11, each: int = 60) -> list[tuple[str, int]]:
    """Lines of known states: prose from the samples, the rest drawn by rule from their words."""
    import base64
    import random

    g = random.Random(seed)
    words = sorted({w for t in samples for w in re.findall(r"[^\W\d_]{3,12}", t.lower())} - FUNCTION_WORDS) or ["word"]
    some = lambda n: " ".join(g.choice(words) for _ in range(n))
    number = lambda: g.choice([str(g.randint(1, 9999)), f"{g.uniform(0, 900):.2f}", f"{g.randint(1, 99)}%", f"2023-{g.randint(1, 12):02d}-{g.randint(1, 28):02d}"])
    out: list[tuple[str, int]] = []
    for t in samples:
        for line in t.split("\n"):
            for x in LineStates.stretches(line):
                out += [(x, 0), (re.sub(r"[^\w\s]", "", x), 0), (x.upper(), 0)]
                cut = x.split()
                out += [(" ".join(cut[i : i + 7]), 0) for i in range(0, len(cut) - 6, 7)]  # verse
    for _ in range(each):
        a, b = some(g.randint(1, 4)), some(g.randint(1, 2))
        out += [(x, 1) for x in (f"- {a}", f"* {a}", f"• {a}", f"{g.randint(1, 40)}. {a}", f"{g.choice('abcdef')}) {a}", a, a.capitalize(), a.title(), f"{a} ({g.randint(1, 90)})", ", ".join(some(g.randint(1, 2)) for _ in range(g.randint(4, 12))), f"{a}, {b}", f"{a} / {b}")]
        for sep in ("\t", " | ", "|", ";", ",", "   ", "; "):
            cells = [g.choice([some(1), some(2), number(), number()]) for _ in range(g.randint(3, 6))]
            out.append((sep.join(cells), 2))
            out.append((sep.join(some(1).capitalize() for _ in range(g.randint(3, 6))), 2))
        out += [("| " + " | ".join(number() for _ in range(4)) + " |", 2), ("|---|:--:|---|", 2), ("+-----+-----+", 2)]
        data = bytes(g.randrange(256) for _ in range(60))
        name = some(1)
        out += [(x, 3) for x in (
            base64.b64encode(data).decode()[:76], data.hex()[:64], " ".join(data[i : i + 2].hex() for i in range(0, 32, 2)), "".join(g.choice("#$%^&*~@!<>{}[]|/\\=+") for _ in range(40)),
            f"<div class=\"{name}\"><span>{some(1)}</span></div>", f"<a href='#'>{name}</a><br/>&nbsp;&amp;", f"2023-0{g.randint(1, 9)}-1{g.randint(0, 9)} 1{g.randint(0, 9)}:2{g.randint(0, 9)}:0{g.randint(0, 9)} [INFO] {name}={g.randint(1, 999)} id=0x{data[:4].hex()}",
            "".join(g.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) + " " + " ".join("".join(g.choice("bcdfghjkqvwxz") for _ in range(g.randint(4, 9))) for _ in range(8)), " ".join([name] * g.randint(10, 20)), " ".join([name, b.split()[0]] * 8), f"{{\"{name}\": {number()}, color: #fff; margin: 0}}",
        )]
    for t in samples[:200]:  # text decoded by the wrong code page
        if not t.isascii():
            out += [(x, 3) for x in LineStates.stretches(t.encode().decode("latin-1").replace("\n", " "))[:3]]
    return [(x.strip(), s) for x, s in out if x.strip()]


#: Places of the statistics in the number that stands for an observation, below 2**31.
PLACES = tuple(math.prod(SIZES[:i]) for i in range(len(SIZES)))


def code(seen: tuple[int, ...]) -> int:
    """The number of an observation."""
    return sum(map(mul, seen, PLACES))


def _digits(codes):
    """(observations, statistics) classes of numbered observations."""
    import numpy as np

    return codes[:, None] // np.array(PLACES) % np.array(SIZES)


#: Stretches that are held at once in the forward, backward and Viterbi passes, unless one text has more.
BLOCK = 200_000


def _blocks(lengths):
    """Places of texts that have stretches, the shortest first, in blocks."""
    import numpy as np

    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    total, at = np.concatenate([[0], np.cumsum(lengths[order])]), 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK, "right")) - 1)
        yield order[at:end]
        at = end


def _steps(offsets, lengths, which):
    """(live, begins, at): at each step the texts that have a stretch there, always the last of the block; the places of a step's stretches in (step, text) order and, in that order, their places in the column."""
    import numpy as np

    own = lengths[which]
    live = len(own) - np.searchsorted(own, np.arange(own[-1]), "right")
    begins = np.concatenate([[0], np.cumsum(live)])
    step = np.repeat(np.arange(own[-1]), live)
    at = offsets[which][np.arange(begins[-1]) - (begins[1:] - len(own))[step]] + step
    return live.tolist(), begins.tolist(), at


def _parts(column):
    """(values, offsets, lengths) of an Arrow column of lists without nulls."""
    import numpy as np

    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), offsets[:-1] - offsets[0], np.diff(offsets)


def expected_counts(codes, offsets, lengths, start, moves, emissions):
    """One vector: texts, first states, moves between states, and states by class of each statistic, expected by forward and backward passes."""
    import numpy as np

    k, f, most = len(STATES), len(SIZES), max(SIZES)
    known, which_code = np.unique(codes, return_inverse=True)
    digits = _digits(known.astype(np.int64))
    logs = emissions[np.arange(f), digits].sum(axis=1)
    chance = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-12
    n, first, pairs, of_code = 0, np.zeros(k), np.zeros((k, k)), np.zeros((len(known), k))
    for which in _blocks(lengths):
        live, begins, at = _steps(offsets, lengths, which)
        n += len(which)
        place = which_code[at]
        b = chance[place]
        alpha, scale = np.empty_like(b), np.empty((len(b), 1))
        a = start * b[: live[0]]
        for t, m in enumerate(live):
            now = slice(begins[t], begins[t + 1])
            if t:
                a = (a[-m:] @ moves) * b[now]
            scale[now] = a.sum(axis=1, keepdims=True)
            a = np.divide(a, scale[now], out=alpha[now])
        b /= scale
        beta = np.ones_like(b)
        for t in range(len(live) - 2, -1, -1):
            nxt, own = slice(begins[t + 1], begins[t + 2]), slice(begins[t + 1] - live[t + 1], begins[t + 1])
            step = b[nxt] * beta[nxt]
            np.matmul(step, moves.T, out=beta[own])
            pairs += alpha[own].T @ step
        gamma = np.multiply(alpha, beta, out=beta)
        gamma /= gamma.sum(axis=1, keepdims=True)
        first += gamma[: live[0]].sum(axis=0)
        for s in range(k):
            of_code[:, s] += np.bincount(place, weights=gamma[:, s], minlength=len(known))
    counts = np.zeros((f, most, k))
    for i in range(f):
        for s in range(k):
            counts[i, :, s] = np.bincount(digits[:, i], weights=of_code[:, s], minlength=most)
    return np.concatenate([[n], first, (pairs * moves).ravel(), counts.ravel()])


def best_states(codes, offsets, lengths, start, moves, emissions):
    """The state of every stretch on the Viterbi paths; ties go to the state first in STATES."""
    import numpy as np

    known, which_code = np.unique(codes, return_inverse=True)
    logs = emissions[np.arange(len(SIZES)), _digits(known.astype(np.int64))].sum(axis=1)
    out = np.zeros(len(codes), np.int8)
    for which in _blocks(lengths):
        live, begins, at = _steps(offsets, lengths, which)
        b = logs[which_code[at]]
        back = np.zeros(b.shape, np.int8)
        best = start + b[: live[0]]
        for t, m in enumerate(live[1:], 1):
            now = slice(begins[t], begins[t + 1])
            ways = best[-m:, :, None] + moves  # from, into
            step = back[now] = ways.argmax(axis=1)
            best[-m:] = np.take_along_axis(ways, step[:, None, :], 1)[:, 0] + b[now]
        s = best.argmax(axis=1)  # of texts that have ended, at their end
        for t in range(len(live) - 1, -1, -1):
            m, now = live[t], slice(begins[t], begins[t + 1])
            out[at[now]] = s[-m:]
            s[-m:] = back[now][np.arange(m), s[-m:]] if t else s[-m:]
    return out


def fit_chain(model: LineStates, drawn: list[tuple[str, int]], expect, rounds: int = FIT_ROUNDS):
    """(start, moves, emissions) in logs: counts of the drawn lines, then Baum-Welch with those as prior.

    expect gives the expected counts of all texts (``expected_counts``, summed) under a chain.
    """
    import numpy as np

    k, f, most = len(STATES), len(SIZES), max(SIZES)
    prior = np.zeros((f, most, k))
    for x, s in drawn:
        for i, v in enumerate(model.observe(x)):
            prior[i, v, s] += 1.0
    prior /= np.maximum(prior[0].sum(axis=0), 1.0)  # each state weighs the same
    valid = np.arange(most)[None, :] < np.array(SIZES)[:, None]
    floor = 1e-3 * valid[:, :, None]

    def normal(e):
        e = e + floor
        return np.log(np.where(valid[:, :, None], e / e.sum(axis=1, keepdims=True), 1.0))

    start, moves, emissions = np.full(k, 1 / k), np.full((k, k), 0.04) + np.eye(k) * 0.84, normal(prior)
    for _ in range(rounds):
        n, first, pairs, counts = np.split(expect(start, moves, emissions), (1, 1 + k, 1 + k + k * k))
        if not n[0]:
            break
        start = (first + 1.0) / (n[0] + k)
        moves = pairs.reshape(k, k) + 1.0
        moves /= moves.sum(axis=1, keepdims=True)
        counts = counts.reshape(f, most, k)
        emissions = normal((counts / np.maximum(counts[0].sum(axis=0), 1.0)) * (1 - PRIOR) + prior * PRIOR)
    return np.log(start), np.log(moves), emissions


STATS = "words bigint, mean_word_length double, symbol_ratio double, end_punctuation_share double, common_share double, prose double, list double, table double, junk double, kind string"
OBSERVED = "words bigint, mean_word_length double, symbol_ratio double, end_punctuation_share double, common_share double, chars bigint, codes array<int>, sizes array<int>"


def observed(documents: DataFrame, texts: list[str], words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, the statistics that need no state, chars, codes, sizes): the numbered observation of each stretch and its non-blank characters; one row per row."""
    shared = documents.sparkSession.sparkContext.broadcast(LineStates(texts, words))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from fathomline.llm.line_blocks import LineBlocks

        blocks = LineBlocks(shared.value)
        for b in batches:
            ts = b.column(1).to_pylist()
            stats, codes, sizes, counts = blocks.watch(ts)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (codes, sizes))
            chars = pa.array([None if t is None else len(t) for t in ts], pa.int64())
            columns = [b.column(0), pa.array(stats[0], pa.int64()), *(pa.array(v, pa.float64(), mask=np.isnan(v)) for v in stats[1:]), chars, *lists]
            yield pa.RecordBatch.from_arrays(columns, ["k", *(x.split()[0] for x in OBSERVED.split(", "))])

    d = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return d.mapInArrow(run, f"k {d.schema['k'].dataType.simpleString()}, {OBSERVED}")


def fit_observed(seen: DataFrame, texts: list[str], words: list[str]):
    """(start, moves, emissions) fitted on all stretches of all observed texts; what reaches the driver is one vector a task and round."""
    import numpy as np

    d = seen.where("chars is not null and k is not null").select("codes")
    width = 1 + len(STATES) * (1 + len(STATES) + len(SIZES) * max(SIZES))

    def expect(*chain):
        shared = seen.sparkSession.sparkContext.broadcast(chain)

        def run(batches):
            import pyarrow as pa

            total = np.zeros(width)
            for b in batches:
                total += expected_counts(*_parts(b.column(0)), *shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["counts"])

        return sum((np.array(r[0]) for r in d.mapInArrow(run, "counts array<double>").collect()), np.zeros(width))

    return fit_chain(LineStates(texts, words), drawn_lines(texts), expect)


def labelled(seen: DataFrame, chain: tuple, key: str = "doc_id") -> DataFrame:
    """The statistics of observed texts with the shares and the kind that follow from the Viterbi paths."""
    shared = seen.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        k = len(STATES)
        for b in batches:
            codes, offsets, lengths = _parts(b.column("codes"))
            sizes, _, _ = _parts(b.column("sizes"))
            own = np.repeat(np.arange(len(lengths)), lengths)
            states = best_states(codes, offsets, lengths, *shared.value)
            sums = np.bincount(own * k + states, weights=sizes, minlength=len(lengths) * k).reshape(-1, k)
            total = sums.sum(axis=1)
            none = total == 0
            shares = sums / np.maximum(total, 1)[:, None]
            chars = b.column("chars").fill_null(0).to_numpy(zero_copy_only=False)
            case = ~none & (chars >= MIN_CHARS) & (1.0 - shares[:, 0] > 0.5)
            kinds = [STATES[s] if c else None for s, c in zip(shares[:, 1:].argmax(axis=1) + 1, case)]
            columns = [b.column(i) for i in range(6)] + [pa.array(shares[:, s], pa.float64(), mask=none) for s in range(k)] + [pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["k", *(x.split()[0] for x in STATS.split(", "))])

    return seen.mapInArrow(run, f"k {seen.schema['k'].dataType.simpleString()}, {STATS}").withColumnRenamed("k", key)


def references(spark, sf_dir: str) -> tuple[list[str], list[str]]:
    """(sample texts, common words), all of them."""
    texts = [r[0] for r in table(spark, sf_dir, "lang_samples").where("text is not null").orderBy("sample_id").select("text").collect()]
    words = [r[0].lower() for r in table(spark, sf_dir, "common_words").where("word is not null").select("word").distinct().orderBy("word").collect()]
    return texts, words


def stored_observations(spark, sf_dir: str, texts: list[str], words: list[str]) -> DataFrame:
    """The observations of all documents, written once: lines are looked at in one pass, whatever the rounds of the fit."""
    folder = shared_folder(spark)
    seen = observed(table(spark, sf_dir, "documents"), texts, words)
    seen.write.parquet(folder)
    return spark.read.schema(seen.schema).parquet(folder)


def fitted(spark, sf_dir: str):
    """(sample texts, common words, start, moves, emissions): everything that LineStates takes, fitted on all documents."""
    texts, words = references(spark, sf_dir)
    return texts, words, *fit_observed(stored_observations(spark, sf_dir, texts, words), texts, words)


def text_statistics(documents: DataFrame, samples: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, words, mean_word_length, symbol_ratio, end_punctuation_share, common_share, prose, list, table, junk, kind): one row per row."""
    return labelled(observed(documents, *samples[:2], key, text), samples[2:], key)


def p10_statistics(spark, sf_dir: str) -> DataFrame:
    texts, words = references(spark, sf_dir)
    seen = stored_observations(spark, sf_dir, texts, words)
    return labelled(seen, fit_observed(seen, texts, words))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return p10_statistics(spark, sf_dir).where("kind is not null").select("doc_id", "kind")
