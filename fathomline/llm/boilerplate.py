"""Problem 1: page boilerplate mixed with main content.

Minimum-cut labelling. Every non-blank line of a page is a node; the line
classifier's log odds become the capacities to the two terminals, and edges tie
lines that stand next to each other, lines of one shape two apart (titles and
teasers alternate), and the entries of a list of other articles to its heading.
The minimum cut, found by max-flow, separates furniture from the main body.

Nodes that no cut of their edges could change are settled first, so that flow
runs only over the few lines in doubt.

Defined cases: null and empty pages give no rows; blank lines are never
furniture; a page of keywords, filler or an error keeps that text as its body;
repeated rows of an id count once.
"""

from __future__ import annotations

from collections import deque
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import table
from fathomline.llm.page_lines import host_names, is_item
from fathomline.llm.page_models import PageModels, is_sentence, page_models

ADJACENT = 1.3
ACROSS_BLANK = 0.9
SAME_SHAPE = 0.8
HEADING = 3.0
#: Bounds of a terminal capacity, what speaks for the body, odds that no judgement of the page overrides.
LIMIT, CLEAR, ITEM, SURE = 8.0, 6.0, 2.0, 5.0


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cost: True (furniture) at cost -unary, False at cost unary, and each edge's weight when its ends differ.

    Ties go to content.
    """
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(u[i]) * 2 > sum(near[i].values()) + 1e-9:
            label[i] = u[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                u[j] += w / 2 if label[i] else -w / 2
                todo.append(j)
            near[i] = {}
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        for i, x in zip(open_, _max_flow(open_, u, near)):
            label[i] = x
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], u: list[float], near: list[dict[int, float]]) -> list[bool]:
    """The source side of a minimum cut by shortest augmenting paths; the source is furniture."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    cap[s], cap[t] = {}, {}
    for i in nodes:
        if u[i] > 0:
            cap[s][i] = 2 * u[i]
            cap[i][s] = 0.0
        else:
            cap[i][t] = -2 * u[i]
            cap[t][i] = 0.0
    while True:
        back: dict[int, int] = {s: s}
        queue = deque([s])
        while queue and t not in back:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-9 and b not in back:
                    back[b] = a
                    queue.append(b)
        if t not in back:
            return [i in back for i in nodes]
        path, b = [], t
        while b != s:
            path.append((back[b], b))
            b = back[b]
        push = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= push
            cap[b][a] = cap[b].get(a, 0.0) + push


class Labeller:
    """Labels the lines of a page by a minimum cut; simple: without the judgement of pages of notices, filler and keywords."""

    def __init__(self, models, simple: bool = False):
        from fathomline.llm.page_lines import LineModel

        self.lines = LineModel(models.weights, models.bias, models.recurring)
        self.pages = None
        if not simple:
            from fathomline.llm.residue import PageJudge

            self.pages = PageJudge(models, self.lines)

    def furniture(self, title: str | None, content: str | None, *hosts: str | None) -> list[int]:
        """Line numbers of the furniture of a page; hosts are its domain and URL."""
        raw = (content or "").split("\n")
        at = [i for i, x in enumerate(raw) if x.strip()]
        if not at:
            return []
        names = host_names(*hosts)
        texts = [raw[i].strip() for i in at]
        prose = islice(filter(is_sentence, texts), 3)
        bare = len(list(prose)) < 3 and self.pages is not None and self.pages.bare(title, content, names)
        return [at[i] for i in self.lines_of((title or "").strip(), texts, at, names, bare)]

    def costs(self, title: str, texts: list[str], names: frozenset[str], bare: bool) -> tuple[list[float], list[str]]:
        """Terminal capacities (log odds of furniture) and shapes of the lines."""
        unary, shapes = [], []
        n = len(texts)
        for i, x in enumerate(texts):
            score, shape, _ = self.lines.score(x, names)
            u = score + max(-1.0, min(1.0, self.lines.place(i, n)))
            if title and len(x) > 3 and shape != "menu" and (x == title or title.startswith(x) and len(x) > 0.6 * len(title) or x.startswith(title) and len(x) < len(title) + 40):
                u, shape = min(u, 0.0) - CLEAR, "own"
            elif shape != "menu" and is_item(x):
                u, shape = u - ITEM, "item"
            if bare and u < SURE:
                u = min(u, 0.0) - CLEAR  # a page of keywords, filler or a notice: that is its body
            unary.append(max(-LIMIT, min(LIMIT, u)))
            shapes.append(shape)
        return unary, shapes

    def lines_of(self, title: str, texts: list[str], at, names: frozenset[str], bare: bool) -> list[int]:
        """Indexes of the furniture among the non-blank lines, of which at gives the line numbers."""
        unary, shapes = self.costs(title or "", texts, names, bare)
        n = len(texts)
        edges = [(i, i + 1, ADJACENT if at[i + 1] == at[i] + 1 else ACROSS_BLANK) for i in range(n - 1)]
        for i in range(n - 2):
            if shapes[i] == shapes[i + 2] and shapes[i] in ("title", "teaser", "menu"):
                edges.append((i, i + 2, SAME_SHAPE))
        if not bare:
            for i in range(n):
                if unary[i] > 1.0 and len(texts[i]) < 60 and shapes[i] in ("title", "text"):
                    for j in range(i + 1, n):
                        if shapes[j] not in ("title", "teaser"):
                            break
                        edges.append((i, j, HEADING))
        return [i for i, x in enumerate(min_cut(unary, edges)) if x]


def furniture_lines(pages: DataFrame, models: PageModels) -> DataFrame:
    """(id, gone array<int>): the line numbers that aren't main body, one row per row of pages that has any."""
    shared = pages.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa

        lab = Labeller(shared.value)
        for b in batches:
            ids, gone = [], []
            for i, t, c, d, u in zip(*(b.column(k).to_pylist() for k in range(5))):
                ids.append(i)
                gone.append(lab.furniture(t, c, d, u))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(gone, pa.list_(pa.int32()))], ["id", "gone"])

    p = pages.select("id", "title", "content", "domain", "url").where("id is not null and content is not null")
    return p.mapInArrow(run, "id string, gone array<int>").where(F.size("gone") > 0)


def main_bodies(pages: DataFrame, models: PageModels) -> DataFrame:
    """(id, url, content): each row of pages with its main body only, lines in their order."""
    shared = pages.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa

        lab = Labeller(shared.value)
        for b in batches:
            out = []
            for u, t, c, d in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                gone = set(lab.furniture(t, c, d, u))
                out.append(None if c is None else "\n".join(x for i, x in enumerate(c.split("\n")) if i not in gone))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "url", "content"])

    return pages.select("id", "url", "title", "content", "domain").mapInArrow(run, "id string, url string, content string")


def p1_found(spark, sf_dir: str) -> DataFrame:
    found = furniture_lines(table(spark, sf_dir, "docs"), page_models(spark, sf_dir))
    once = found.groupBy("id").agg(F.first("gone").alias("gone"))
    return once.select("id", F.explode("gone").alias("line_no"))


def p1_bodies(spark, sf_dir: str) -> DataFrame:
    """The main body of each page, each id once."""
    got = main_bodies(table(spark, sf_dir, "docs").where("id is not null"), page_models(spark, sf_dir))
    return got.groupBy("id").agg(F.first("url").alias("url"), F.first("content").alias("content"))
