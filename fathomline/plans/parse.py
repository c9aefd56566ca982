"""The query language: a search string becomes a ParsedQuery."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from fathomline.lexicons import QUERY_STOP_WORDS, SYNONYMS


@dataclass
class ParsedQuery:
    raw: str = ""
    phrases: list[str] = field(default_factory=list)
    site: str = ""
    lang: str = ""
    country: str = ""
    intitle: str = ""
    inurl: str = ""
    intext: str = ""
    filetypes: list[str] = field(default_factory=list)
    before: str = ""
    after: str = ""
    not_peers: list[str] = field(default_factory=list)
    peer: str = ""
    https: bool = False
    terms: list[str] = field(default_factory=list)
    not_terms: list[str] = field(default_factory=list)
    or_groups: list[list[str]] = field(default_factory=list)

    @property
    def fuzzy(self) -> bool:
        return len(self.terms) <= 3

    @property
    def cleaned(self) -> str:
        return " ".join([*self.terms, *self.phrases])


#: (names of the operator, attribute, form, all or the first); taken out of the string in this order.
_OPERATORS = [
    ("site", "site", str.lower, False), ("lang", "lang", str.lower, False), ("country", "country", str.upper, False), ("intitle", "intitle", str.lower, False), ("inurl", "inurl", str.lower, False),
    ("intext|inbody", "intext", str.lower, False), ("filetype|ext", "filetypes", str.lower, True), ("before", "before", str, False), ("after", "after", str, False), ("-peer", "not_peers", str, True), ("peer", "peer", str, False),
]


def parse(raw: str | None) -> ParsedQuery:
    """Phrases first, then operators, then terms: -x excludes, upper-case OR joins its neighbours, stop words go."""
    q = ParsedQuery(raw or "")
    rest = q.raw.strip()
    q.phrases = [p.strip() for p in re.findall(r'"([^"]+)"', rest) if p.strip()]
    rest = re.sub(r'"[^"]+"', " ", rest)
    for names, attr, form, every in _OPERATORS:
        found = [form(x) for x in re.findall(rf"(?i)(?:{names}):(\S+)", rest)]
        if found:
            setattr(q, attr, found if every else found[0])
        rest = re.sub(rf"(?i)(?:{names}):\S+", " ", rest)
    has = re.findall(r"(?i)has:(\S+)", rest)
    q.https = bool(has) and has[0].lower() == "https"
    words = re.sub(r"(?i)has:\S+", " ", rest).split()
    i = 0
    while i < len(words):
        w = words[i]
        if len(w) > 1 and w[0] == "-":
            q.not_terms.append(w[1:].lower())
        elif w == "OR" and 0 < i < len(words) - 1:
            if q.terms:
                group = [q.terms.pop()]
                while i < len(words) - 1 and words[i] == "OR":
                    group.append(words[i + 1].lower())
                    i += 2
                q.or_groups.append(group)
                continue
        elif w.lower() not in QUERY_STOP_WORDS:
            q.terms.append(w.lower())
        i += 1
    return q


def expand(q: ParsedQuery) -> list[str]:
    """Synonyms of the terms, and of longer keys that the cleaned query holds; none that is a term already."""
    out = [s for t in q.terms for s in SYNONYMS.get(t, [])]
    out += [s for k, v in SYNONYMS.items() if " " in k and k in q.cleaned.lower() for s in v]
    return [s for s in dict.fromkeys(out) if s not in q.terms]
