"""What a single line of a page looks like: furniture or content, in any language.

A logistic model over a line's words, word pairs, first and last words and its
shape (length, ending, separators, capitals), and over its place in the page.
It is fitted by self-training on a bounded sample of pages (``page_models``):
lines that recur, names and numbers apart, on pages of different sites are
furniture, prose that recurs nowhere is content, and notices that recur only on
pages without prose are content too. The few hand-written lines below stand for
furniture of the web at large and are no lines of any table.
"""

from __future__ import annotations

import re
from functools import cache

from fathomline.llm.keyword_spam import FUNCTION_WORDS

# Furniture as sites in general print it; ~ stands for the name of a site.
SEEDS = """
Advertisement|Sponsored by our partners|Get our mobile app for iPhone and Android|Manage your consent preferences|We and selected third parties use cookies or similar technologies
Cookie settings|Read our privacy statement to learn how your personal data are used|Follow ~ on Facebook, Instagram and YouTube|Sign in with Google|Create a free account
Join thousands of readers and get the weekly digest in your inbox|Unsubscribe at any time|Share on WhatsApp|Copy link|Send this to someone by e-mail|Add a comment|Be the first to comment
Recommended for you|Popular this week|Trending now|Up next|More stories like this|Read next: the garden in spring|All content is protected by copyright law|Terms and conditions apply|« Older post: the bridge | Newer post: the mill »|‹ Previous article|Next article ›|← Back to the list|Next →|The old mill was built when the town had no ...|In spring the gardens by the lake are full of …|« The long road from the village to the sea and back again in one summer | A short history of the mill beside the river and of its keepers »|« Warum der Fluss im Winter über die Felder tritt und was dann geschieht | Wie ein Boot aus Holz gebaut wird »|« Pourquoi la rivière déborde en hiver et ce que font les gens | Comment on construit un bateau en bois »|« Por qué el río se desborda en invierno y qué hace la gente | Cómo se construye un barco de madera »
This article contains affiliate links|Views expressed are solely the writer's|Breadcrumb: Start » Topics » Garden|Go to top|Skip navigation|Toggle menu|Site map|Contact the editors|About the author
By Anna Smith|Text: Peter Jones|Reported by Mary Brown on 4 May|Updated 3 hours ago|Reading time: 7 minutes|Topics: wood, garden, tools|Keywords: boats, rivers|Filed in: news, travel|Editors' remark: the names were changed
Anzeige|Cookie-Einstellungen ändern|Mit der Nutzung dieser Website erklären Sie sich mit Cookies einverstanden|Folgen Sie uns auf Facebook|Newsletter abonnieren|Jetzt kostenlos registrieren|Per E-Mail weiterleiten|Kommentar schreiben
Das könnte Sie auch interessieren|Meistgelesen|Zum Seitenanfang|Von Anna Schmidt|Aktualisiert vor 3 Stunden|Lesezeit: 7 Minuten|Themen: Holz, Garten|Sämtliche Inhalte sind urheberrechtlich geschützt|Anmerkung der Redaktion: die Namen wurden geändert
Publicité|Gérer mes cookies|Suivez-nous sur Facebook|S'inscrire à la newsletter|Créer un compte gratuit|Envoyer par courriel|Ajouter un commentaire|À lire également|Les plus lus|Retour en haut|Par Anne Martin|Mis à jour il y a 3 heures
Temps de lecture : 7 minutes|Thèmes : bois, jardin|Reproduction interdite sans autorisation|Remarque de la rédaction : les noms ont été changés|Publicidad|Configurar las cookies|Síguenos en Facebook|Suscríbete a nuestro boletín
Crear una cuenta gratis|Enviar por correo|Añadir un comentario|Te puede interesar|Lo más leído|Ir arriba|Por Ana Martínez|Actualizado hace 3 horas|Tiempo de lectura: 7 minutos|Temas: madera, jardín|Prohibida la reproducción sin permiso
Publicidade|Configurar cookies|Siga-nos no Facebook|Assine a nossa newsletter|Criar uma conta grátis|Enviar por e-mail|Adicionar um comentário|Leia também|As mais lidas|Ir para o topo|Por Ana Martins|Atualizado há 3 horas
Tempo de leitura: 7 minutos|Temas: madeira, jardim|Proibida a reprodução sem autorização|Advertentie|Cookies beheren|Volg ons op Facebook|Schrijf je in voor onze nieuwsbrief|Gratis account aanmaken|Doorsturen per e-mail
Plaats een reactie|Lees ook|Meest gelezen artikelen|Terug naar boven|Door Anna de Vries|Bijgewerkt 3 uur geleden|Leestijd: 7 minuten|Onderwerpen: hout, tuin|Overname zonder toestemming verboden|Opmerking van de redactie: de namen zijn veranderd
""".strip().replace("\n", "|").split("|")  # fmt: skip

_CODE = re.compile(r"https?://\S+|(?<!\S)/\S+|\b(?=[^\W\d_]*\d)(?=\d*[^\W\d_])\w+\b")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[©@#|·›»«>:…]")
_WORD = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"^(?:[-*•–]|\d{1,3}[.)]|[a-z]\))\s+\S")
_NOISE = re.compile(r"\s*\((?:\d+/\d+|[a-z]+-[a-z]+|\d+)\)$")
_CLOSERS = "\"'”’»)]"
TEASER = re.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\])\s*(?:\([^()]*\))?$")
_NEXT = re.compile(r"^(?:«|<<|←|‹)\s*\S|\S\s*(?:»|>>|→|›)$")
_SEPARATORS = "|·›»>•«/–"
#: Log odds by the words of a line from which it is furniture without a look at its page.
TOLD = 1.5
#: Bound of what the form of a line and its place can say, and of what the form of a lone heading can.
FORM, HEAD = 2.5, -0.4
#: What a line that is cut off, or points to another page, says by its form.
LINK = 3.0
#: What it says that the sample holds the line itself on many pages.
RECURS = 3.0


def host_names(*hosts: str | None) -> frozenset[str]:
    """What a site may call itself: the letters of its host's labels, the last label apart."""
    out = set()
    for h in hosts:
        if h:
            h = h.strip().lower().split("://")[-1].split("/")[0].split("@")[-1].split(":")[0]
            for label in h.split(".")[:-1]:
                name = "".join(c for c in label if c.isalpha())
                if len(name) >= 4:
                    out.add(name)
    return frozenset(out)


_DIGIT = re.compile(r"\d")
_NONE: frozenset[str] = frozenset()


def tokens(line: str, names: frozenset[str] = _NONE) -> list[str]:
    """Lower-cased words and marks; numbers, codes and paths as 0, the site's own name as @."""
    low = line.lower()
    if "/" in low or _DIGIT.search(low):
        found = ["0" if t[0].isdigit() else t for t in _TOKEN.findall(_CODE.sub("0", low))]
    else:
        found = _TOKEN.findall(low)
    return ["@" if t in names else t for t in found] if names else found


def _bucket(n: int, *bounds: int) -> int:
    return sum([n > b for b in bounds])


def trimmed(line: str) -> str:
    """The stripped line without a counter or tag in brackets at its end."""
    x = line.strip()
    return _NOISE.sub("", x) or x if x.endswith(")") else x


def form(line: str, toks: list[str]) -> tuple:
    """The form of a stripped line in a few classes, without its words."""
    words = [t for t in toks if t == "@" or t.isalpha()]
    n = len(words)
    end = line.rstrip(_CLOSERS)[-1:] or line[-1:]
    end = "a" if end.isalpha() else "0" if end.isdigit() else end if end in ".!?:;…,|»›" else "%"
    first = line[:1]
    first = "A" if first.isupper() else "a" if first.isalpha() else "0" if first.isdigit() else first if first in "[#©«»<>‹›←•*-–¿\"“" else "%"
    caps = sum(map(str.isupper, [w[0] for w in line.split()]))
    fn = sum(map(FUNCTION_WORDS.__contains__, words))
    return (
        _bucket(n, 0, 1, 2, 3, 5, 8, 13, 20, 40), end, first, _bucket(10 * caps // max(1, n), 0, 3, 6, 9), _bucket(10 * fn // max(1, n), 0, 1, 3),
        _bucket(separators(line), 0, 1, 2, 4), _bucket(line.count(","), 0, 1, 3), TEASER.search(line) is not None, "://" in line,
    )


def separators(line: str) -> int:
    return sum([line.count(c) for c in _SEPARATORS])


def form_features(f: tuple) -> list[str]:
    size, end, first, cap, fn, seps, commas, teaser, url = f
    out = [f"z:{size}", f"e:{end}", f"f:{first}", f"c:{cap}", f"n:{fn}", f"s:{seps}", f"ze:{size}{end}", f"zc:{size}{cap}", f"zn:{size}{fn}", f"zs:{size}{seps}", f"k:{commas}"]
    return out + ["teaser"] * teaser + ["url"] * url


def word_features(toks: list[str]) -> list[str]:
    """Features of the words of a line."""
    return [*map(" ".join, zip(toks, toks[1:])), *dict.fromkeys(toks)]


def edge_features(toks: list[str]) -> list[str]:
    """Features of the first and last words of a line."""
    if not toks:
        return []
    out = ["^ " + toks[0], toks[-1] + " $"]
    if len(toks) >= 2:
        out += (f"^ {toks[0]} {toks[1]}", f"{toks[-2]} {toks[-1]} $")
    if len(toks) >= 3:
        out.append(f"^ {toks[0]} {toks[1]} {toks[2]}")
    return out


@cache
def says(feature: str) -> bool:
    """Whether a feature of words holds a word, the name or the sign of copyright: numbers and marks alone say nothing."""
    return any(t[0].isalpha() or t in "@©" for t in feature.split())


def place_features(i: int, n: int) -> tuple[str, str]:
    """Features of the place of line i of the n non-blank lines of a page."""
    return f"top:{_bucket(i, 0, 1, 2, 3, 5)}", f"end:{_bucket(n - 1 - i, 0, 1, 2, 3, 5)}"


def spread(words: list[str]) -> float:
    """Weight of one word feature of a line, of which words are all: a long line's words count by their mean."""
    return min(1.0, 12.0 / len(words)) if words else 0.0


class LineModel:
    """Log odds of furniture for lines; positive: furniture."""

    def __init__(self, weights: dict[str, float], bias: float, recurring: frozenset[str] = frozenset()):
        self.weights, self.bias, self.recurring = weights, bias, recurring
        self.seen: dict[str, tuple[float, str, float]] = {}
        self.forms: dict[tuple, float] = {}

    def score(self, line: str, names: frozenset[str] = frozenset()) -> tuple[float, str, float]:
        """(log odds without the place, shape, the words' part of the odds): shape is ``menu``, ``teaser``, ``next``, ``tags``, ``title`` or ``text``."""
        low = line.lower()
        named = False
        for x in names:
            if x in low:
                named = True
        if not named and (got := self.seen.get(line)) is not None:
            return got
        raw = trimmed(line) or line
        toks = tokens(raw, names if named else _NONE)
        get = self.weights.get
        ws = word_features(toks)
        told = sum(filter(None, map(get, edge_features(toks)))) + spread(ws) * sum(filter(None, map(get, ws)))
        if self.recurring and " ".join(toks) in self.recurring:
            told += RECURS
        f = form(raw, toks)
        if (of_form := self.forms.get(f)) is None:
            of_form = self.forms[f] = self.bias + sum(get(x, 0.0) for x in form_features(f))
        shape = self.shape(raw, toks, f[7])
        if shape in ("teaser", "next"):
            got = LINK + max(-1.0, min(3.0, told)), shape, told
        else:
            got = max(-FORM, min(HEAD if shape == "title" else FORM, of_form)) + told, shape, told
        if not named and len(line) < 200:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[line] = got
        return got

    @staticmethod
    def shape(raw: str, toks: list[str], cut: bool) -> str:
        if cut:
            return "teaser"
        if _NEXT.search(raw) and not (raw[0] == "«" and raw.rstrip(".")[-1:] == "»" and "|" not in raw):
            return "next"
        if raw.startswith("#") or ":" in raw[:24] and raw.count(",") >= 1 and raw[-1:] not in ".!?":
            return "tags"
        if len(toks) <= 40 and raw[-1:] not in ".!?" and separators(raw) >= 2:
            return "menu"
        end = raw.rstrip(_CLOSERS)[-1:]
        if end in ".!?:;。！？" and end:
            return "text"
        return "title" if len(toks) <= 18 else "text"

    def place(self, i: int, n: int) -> float:
        a, b = place_features(i, n)
        return self.weights.get(a, 0.0) + self.weights.get(b, 0.0)

    def sure(self, line: str, names: frozenset[str] = frozenset()) -> bool:
        """Furniture by its words, whatever its shape."""
        total, _, told = self.score(line, names)
        return total >= 2.0 and told >= TOLD

    def body(self, lines: list[str], names: frozenset[str] = frozenset()) -> list[str]:
        """The lines without what is surely furniture."""
        return [x for x in lines if not self.sure(x, names)]


def is_item(line: str) -> bool:
    return _BULLET.match(line) is not None


def fit(rows: list[tuple[list[str], list[str], list[str], float, float]]) -> tuple[dict[str, float], float]:
    """(weights, bias) from rows of (form and place, ends, words, label, weight).

    Form and words are fitted apart, so that neither explains the other away: a
    known word must say so whatever the length of its line, and unknown words
    say nothing.
    """
    form, bias = _logistic([((r[0], 1.0),) for r in rows], rows, True)
    words, _ = _logistic([((list(filter(says, r[1])), 1.0), (list(filter(says, r[2])), spread(r[2]))) for r in rows], rows, False)
    return form | words, bias


def _logistic(parts, rows, intercept: bool, rounds: int = 80, decay: float = 1e-4) -> tuple[dict[str, float], float]:
    """A logistic model by Adam on all rows at once; both classes weigh the same."""
    import numpy as np

    index: dict[str, int] = {}
    ids, owner, value = [], [], []
    for r, groups in enumerate(parts):
        for fs, v in groups:
            ids += [index.setdefault(f, len(index)) for f in fs]
            owner += [r] * len(fs)
            value += [v] * len(fs)
    if not ids:
        return {}, 0.0
    seen = np.bincount(ids, minlength=len(index))
    i, o, x = np.array(ids, np.int64), np.array(owner, np.int64), np.array(value)
    y, c = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    for k in (0.0, 1.0):
        if (total := c[y == k].sum()) > 0:
            c[y == k] *= len(rows) / 2 / total
    w = np.zeros(len(index) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(o, weights=x * w[i], minlength=len(rows)) + w[-1]
        d = c * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(i, weights=x * d[o], minlength=len(index)), d.sum() if intercept else 0.0) / len(rows) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {f: float(w[n]) for f, n in index.items() if abs(w[n]) > 0.02 and (seen[n] > 1 or " " not in f)}, float(w[-1])
