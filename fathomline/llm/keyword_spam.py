"""Problem 5: keyword-stuffed and link-list pages.

Per page the body (furniture lines apart) is judged by three measures: the share
of function words, the autocorrelation of its terms over a window of short
lags together with the regularity of the gaps at which terms recur, and the
share of words that stand in entries (tags, product lines, links, titles) rather
than sentences. Unnaturally regular repetition and lists of distinct nouns
without function words are flagged.

Defined cases: null and empty pages, and bodies of fewer than ``MIN_WORDS``
words, are not spam; filler text is not counted as keywords.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import table

MIN_WORDS = 15
#: Lags of the autocorrelation, in content words.
LAGS = 24
#: A line with at most this share of function words isn't a sentence.
POOR = 0.13
#: Share of the body's words outside sentences.
SPAM_SHARE = 0.45
#: Share of content words above which repetition is looked at.
CONTENT_SHARE = 0.72
#: Mean autocorrelation over the lags from which repetition is unnatural.
REGULAR = 0.055
#: Coefficient of variation of the gaps below which they are even.
EVEN = 1.2

# The commonest function words of six languages.
FUNCTION_WORDS = frozenset(
    """the a an of and to in that it was is for on with he she they you we after before under not at by from as but when which be are or so this there their because until if will had has have its all
    der die das und ein eine einen einem einer den dem des nicht war es auf mit aus im ist sie er wir dass auch aber dann weil von zu für hinter bei dort sagte denn seit
    le la les un une des et de du que dans sur pas ce l d qui il elle nous mais pour par avec est sous à au c parce derrière disait
    el los las una y en no se lo su al del con por para era pero porque muy también decía según creemos
    o os as um uma e não com na no nos da do das dos ao em para mas porque muito também isso que sem dizia achamos entre
    het een van dat niet op met zei wij maar toen ook want omdat naast voor uit onder zonder is was te er""".split()
)

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…:;][\"'”’»)\]]*\s*(?:\([^()]{1,60}\))?$")
_URL = re.compile(r"https?://\S+")
_LETTERS = re.compile(r"[^\W\d_]")


def autocorrelation(terms: list[str], lags: int = LAGS) -> float:
    """Mean over the lags 1 to ``lags`` of the share of positions whose term stands again that far on."""
    n = len(terms)
    if n < 8:
        return 0.0
    places = defaultdict(list)
    for i, t in enumerate(terms):
        places[t].append(i)
    pairs = 0
    for at in places.values():
        if len(at) > 1:
            for j, p in enumerate(at):
                for q in at[j + 1 :]:
                    if q - p > lags:
                        break
                    pairs += 1
    top = min(lags, n - 1)
    return pairs / sum(n - k for k in range(1, top + 1))


def gap_variation(terms: list[str]) -> float:
    """Coefficient of variation of the gaps between recurrences, pooled over terms; natural text comes in bursts (above 1)."""
    last, gaps = {}, []
    for i, t in enumerate(terms):
        if t in last:
            gaps.append(i - last[t])
        last[t] = i
    if len(gaps) < 8:
        return 1.0
    mean = sum(gaps) / len(gaps)
    return (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean


def entry_words(line: str) -> tuple[int, int, list[str]]:
    """(words, words outside sentences, content words) of a line."""
    bare = _URL.sub(" ", line) if "://" in line else line
    ws = _WORD.findall(bare.lower())
    if not ws:
        return (1, 1, []) if bare != line else (0, 0, [])
    terms = [w for w in ws if w not in FUNCTION_WORDS]
    n, fn = len(ws), len(ws) - len(terms)
    terms = [w for w in terms if not w.isdigit()]
    if fn <= POOR * n and n >= 2 or bare != line:
        return n, n, terms
    if n <= 18 and not _END.search(line):
        return n, n, terms  # a title, an entry
    return n, 0, terms


class SpamModel:
    """Judges the lines of a page; furniture(line) tells page furniture."""

    def measures(self, title: str, lines: list[str], furniture=None) -> dict[str, float] | None:
        kept = [x for x in lines if x and x != title and not (furniture and furniture(x))]
        words = entries = 0
        terms: list[str] = []
        for x in kept:
            n, out, t = entry_words(x)
            words, entries = words + n, entries + out
            terms += t
        if words < MIN_WORDS:
            return None
        m = {"words": words, "entries": entries / words, "content": len(terms) / words}
        if m["entries"] <= SPAM_SHARE and m["content"] <= CONTENT_SHARE:
            return m  # sentences with their function words: neither rule can hold
        return m | {"regular": autocorrelation(terms), "gaps": gap_variation(terms)}

    def is_spam(self, title: str | None, lines: list[str], furniture=None) -> bool:
        m = self.measures((title or "").strip(), lines, furniture)
        if m is None or "regular" not in m:
            return False
        return self.stuffed(m) or self.listed(m)

    @staticmethod
    def stuffed(m) -> bool:
        """Terms that recur within the lag window more often, and at more even gaps, than in natural text."""
        return m["content"] > CONTENT_SHARE and m["regular"] > REGULAR and m["gaps"] < EVEN

    @staticmethod
    def listed(m) -> bool:
        """Entries without function words whose nouns are distinct: hardly any recurs within the lag window."""
        return m["entries"] > SPAM_SHARE and m["regular"] <= REGULAR


def spam_pages(pages: DataFrame, models) -> DataFrame:
    """(id): the pages of keywords, tags, product tags, links or titles; each id once."""
    shared = pages.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa

        from fathomline.llm.page_lines import host_names
        from fathomline.llm.residue import PageJudge

        judge = PageJudge(shared.value)
        for b in batches:
            ids = [i for i, t, c, d, u in zip(*(b.column(k).to_pylist() for k in range(5))) if judge.is_spam(t, c, host_names(d, u))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string())], ["id"])

    p = pages.select("id", "title", "content", "domain", "url").where("id is not null and content is not null")
    return p.mapInArrow(run, "id string").groupBy("id").agg(F.lit(1).alias("one")).select("id")


def p5_found(spark, sf_dir: str) -> DataFrame:
    from fathomline.llm.page_models import page_models

    return spam_pages(table(spark, sf_dir, "docs"), page_models(spark, sf_dir))
