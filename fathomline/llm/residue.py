"""Problem 2: template residue, filler and error-page text.

Character n-gram models of filler, of error notices and of natural prose give
likelihood ratios; windows of them localise the residue, and a page goes by how
much of it they cover: filler by the characters that its windows cover, error
notices by their share of the body, for which a bad status speaks a little. The
model of marks reads a text as classes of signs and words, so that its windows
find delimiters about a field and values that were never rendered; what they
localise is checked by its exact spelling, and left where the text quotes it.

The models are fitted on a bounded sample of pages without labels
(``page_models``: notices recur on pages of several sites without prose), on
the standard filler passage and on a few notices written for this module.

Defined cases: null and empty pages are not residue; null titles are empty; a
null status speaks neither way.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import table
from fathomline.llm.keyword_spam import SpamModel
from fathomline.llm.ngrams import RatioModel, codes, longest_run
from fathomline.llm.page_lines import SEEDS, LineModel, host_names
from fathomline.llm.page_models import PageModels, page_models

PROSE_TEXTS = 2_000
WINDOW, BAR = 12, 1.6
ERROR_WINDOW, ERROR_BAR = 12, 0.5
#: Letters covered by windows of filler, in one stretch.
FILLER_RUN = 30
#: Share of the body's letters in error notices, and with a status of 400 or more.
ERROR_SHARE, ERROR_SHARE_BAD = 0.4, 0.3
#: Windows of the mark model, in signs.
MARK_WINDOW, MARK_BAR = 2, 0.5

# The standard filler passage.
LOREM = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.""".split("\n")
#: Placeholder phrases, in the words of this module.
FILLER = [
    "Placeholder text for layout purposes only. Sample text, to be replaced before publication. Your headline goes in this box.",
    "This is some dummy text. Type your paragraph here and delete this note. Insert an introduction of two sentences here.",
    "Content for this section will be added shortly. Add your own text by double clicking. Write something about yourself here.",
    "Welcome to your new site, this is your first entry, edit or delete it, then begin to write. A test entry. Your slogan in one line.",
    "Platzhaltertext, bitte vor der Veröffentlichung ersetzen. Geben Sie hier Ihre Überschrift ein. Dieser Blindtext zeigt nur das Layout. Ihr Absatz kommt hierher. Dieser Inhalt wird bald ergänzt.",
    "Texte fictif à remplacer avant publication. Saisissez votre paragraphe ici. Votre titre dans ce cadre. Ce contenu sera bientôt ajouté. Un exemple de texte pour la mise en page.",
    "Texto de muestra para sustituir antes de publicar. Escriba aquí su párrafo. Su titular en este cuadro. Este contenido se añadirá pronto. Un ejemplo de texto para la maqueta.",
    "Texto de exemplo para substituir antes de publicar. Escreva aqui o seu parágrafo. O seu título nesta caixa. Este conteúdo será acrescentado em breve. Um texto de amostra para o desenho da página.",
    "Voorbeeldtekst, te vervangen vóór publicatie. Typ hier uw eigen alinea. Uw kop in dit vak. Deze inhoud wordt binnenkort toegevoegd. Een proeftekst voor de opmaak.",
]
#: Notices, in the words of this module.
ERROR = [
    "404: nothing lives at this address. The document you requested could not be located, it may have been moved or deleted.",
    "An unexpected error occurred while we handled your request. Our engineers were told. Please come back in a few minutes.",
    "500 internal server error. Unhandled exception, stack trace follows. HTTP status 502 bad gateway. 503 service temporarily unavailable. Gateway timeout.",
    "We are carrying out scheduled maintenance and will be online again shortly. The connection to the database server was refused.",
    "403 forbidden: you are not allowed to open this resource. Your IP address was banned. Authorization required. You must be signed in to read this page.",
    "Verify that you are human. Complete the security check to proceed. One moment while we inspect your connection. Unusual traffic was detected, slow down and retry.",
    "JavaScript is required. This site does not work without scripts; switch JavaScript on and refresh. Your browser is not supported.",
    "Content is loading, hold on. Please be patient while the application starts. This page is not ready yet, we are still building it.",
    "Fehler 404: unter dieser Adresse gibt es nichts. Das Dokument wurde verschoben oder gelöscht. Ein unerwarteter Fehler ist passiert, versuchen Sie es in einigen Minuten erneut.",
    "Kein Zugang: Sie müssen angemeldet sein. JavaScript ist erforderlich. Inhalt wird geladen, einen Moment. Diese Website wird gerade gebaut. Wartungsarbeiten.",
    "Erreur 404 : rien à cette adresse. Le document demandé a été déplacé ou supprimé. Un problème inattendu est arrivé, revenez dans quelques minutes.",
    "Entrée interdite : vous devez vous identifier. JavaScript est requis. Le contenu se charge, un instant. Ce site est en cours de réalisation. Maintenance en cours.",
    "Error 404: no hay nada en esta dirección. El documento fue movido o borrado. Ha ocurrido un fallo inesperado, vuelva en unos minutos. Prohibido el paso: debe identificarse.",
    "Se requiere JavaScript. El contenido se está cargando, un momento. Este sitio se está construyendo. Tareas de mantenimiento.",
    "Erro 404: não há nada neste endereço. O documento foi movido ou apagado. Houve uma falha inesperada, volte em alguns minutos. Entrada proibida: é preciso identificar-se.",
    "É necessário JavaScript. O conteúdo está a carregar, um momento. Este site está a ser construído. Trabalhos de manutenção.",
    "Fout 404: op dit adres staat niets. Het document is verplaatst of verwijderd. Er ging iets onverwachts mis, kom over enkele minuten terug. Geen toegang: u moet aangemeld zijn.",
    "JavaScript is vereist. De inhoud wordt geladen, een ogenblik. Aan deze site wordt gebouwd. Onderhoud bezig.",
]
#: Prose that speaks of filler.
MENTIONS = [
    'The words "lorem ipsum" come from Cicero, and typesetters have set them for ages as a sample. A designer explained why lorem ipsum is used.',
    "An essay on dummy text: where lorem ipsum comes from and why it is still printed.",
]
# Forms of unfilled marks and of values that were rendered wrongly.
MARK = re.compile(
    r"\{\{\s*[\w.\- ]{1,40}\}\}|\[\[\s*[\w.\- ]{1,40}\]\]|[$#]\{\s*[\w.\- ]{1,40}\}|<%=?\s*[\w.\- ]{1,40}%>|%%[\w.\- ]{2,40}%%|@@[\w.\- ]{2,40}@@"
    r"|(?<!\w)__[A-Z][A-Z_]+__(?!\w)|(?<![{$#\w])\{[A-Za-z][\w]*(?:\.\w+)*\}(?!\})|\{[0-9]\}|\[(?:INSERT|YOUR|ADD|ENTER|insert|your|add|enter) [\w ]{2,40}\]|&lt;%\w+&gt;|<%s>"
    r"|\bundefined undefined\b|\bNaN\s?[€$£%]|[€$£]\s?NaN\b|\b(?:by|par|von|por|door|BY) (?:null|NULL)\b|\bInvalid Date\b|\bINVALID DATE\b|\[object Object\]|\[OBJECT OBJECT\]|#REF!|#NAME\?|#VALUE!|#DIV/0!|\bTBD\b|\bX{4,}\b"
)
#: A text without any of these has no mark.
_TRIGGERS = ("{", "[[", "<%", "%%", "@@", "__", "&lt;%", "undefined undefined", "NaN", " null", " NULL", "nvalid Date", "INVALID DATE", "[object", "[OBJECT", "#REF", "#NAME", "#VALUE", "#DIV", "TBD", "XXXX", "[INSERT", "[YOUR", "[ADD", "[ENTER", "[insert", "[your", "[add", "[enter")
_QUOTES = "`\"'“”„«»‘’"
#: Words inside a mark that name the mark itself: the text speaks of it.
_SELF = re.compile(r"\b(?:braces|brackets|curly|mustache|placeholders?)\b", re.I)


def has_mark(text: str) -> bool:
    """An unfilled mark or broken value that is neither quoted nor named by itself."""
    if not any(x in text for x in _TRIGGERS):
        return False
    for m in MARK.finditer(text):
        before, after = text[max(0, m.start() - 2) : m.start()].rstrip()[-1:], text[m.end() : m.end() + 2].lstrip()[:1]
        if before and before in _QUOTES and after and after in _QUOTES:
            continue
        if _SELF.search(m.group()):
            continue
        return True
    return False



_VALUES = ("undefined", "nan", "null", "invalid", "date", "object", "tbd", "ref", "value", "div")
_SIGNS = re.compile(r"[^\W\d_]+|\d+|\s+")
_OPEN_CLOSE = (("{{", "}}"), ("{{ ", " }}"), ("[[", "]]"), ("[[ ", " ]]"), ("${", "}"), ("#{", "}"), ("<%= ", " %>"), ("<% ", " %>"), ("%%", "%%"), ("@@", "@@"), ("__", "__"), ("{", "}"), ("&lt;%", "&gt;"))
_FIELDS = ("name", "user.name", "first_name", "NAME", "FIRST_NAME", "order-id", "item 2", "0")
_BROKEN = ("undefined undefined", "NaN €", "$NaN", "£ NaN", "NaN%", "by null", "von NULL", "Invalid Date", "[object Object]", "#REF!", "#NAME?", "#VALUE!", "#DIV/0!", "TBD", "XXXX", "[INSERT NAME]", "[YOUR TEXT]", "[ADD TITLE HERE]", "[enter name]", "<%s>")


def signs(text: str) -> str:
    """The text as classes of signs: one character a word, number, gap or mark."""

    def one(m: re.Match) -> str:
        w = m.group()
        if w[0].isspace():
            return " "
        if w[0].isdigit():
            return "0"
        low = w.lower()
        if low in _VALUES:
            return chr(0xE000 + _VALUES.index(low))
        if len(w) >= 4 and set(low) == {"x"}:
            return "\ue100"
        return "A" if w.isupper() and len(w) > 1 else "a"

    return _SIGNS.sub(one, text)


def mark_model(prose: list[str]) -> RatioModel:
    """Unfilled marks and broken values against prose, over classes of signs."""
    own = [a + f + b for a, b in _OPEN_CLOSE for f in _FIELDS] + list(_BROKEN) * 4
    return RatioModel([signs(x) for x in own], [signs(x) for x in prose], n=2, lower=False)


class ResidueModels:
    def __init__(self, models: PageModels):
        self.filler, self.error, self.marks = models.filler, models.error, models.marks

    def mark_window(self, text: str) -> bool:
        """Whether a window of signs is likelier in a mark than in prose."""
        import numpy as np

        c = np.frombuffer(signs(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return self.marks.covered(self.marks.hashes(c), len(c), MARK_WINDOW, MARK_BAR) is not None

    def marked(self, text: str) -> bool:
        """An unfilled mark or broken value: localised by the model, then spelt so and not quoted."""
        return any(x in text for x in _TRIGGERS) and any(self.mark_window(x) and has_mark(x) for x in text.split("\n"))

    def error_share(self, lines: list[str]) -> float:
        """Share of the letters of the lines that lie in error notices."""
        import numpy as np

        c, _ = codes("\n".join(lines))
        letters = c >= 65
        inside = self.error.covered(self.error.hashes(c), len(c), ERROR_WINDOW, ERROR_BAR)
        return 0.0 if inside is None else float((inside & letters).sum() / max(1, np.count_nonzero(letters)))

    def verdict(self, title: str | None, content: str | None, body=None, status: int | None = None) -> str | None:
        """``mark``, ``filler``, ``error`` or None. body(lines) drops furniture from a list of lines."""
        title, content = title or "", content or ""
        if self.marked(title) or self.marked(content):
            return "mark"
        if not content.strip():
            return None
        c, _ = codes(content)
        h = self.filler.hashes(c)
        if longest_run(self.filler.covered(h, len(c), WINDOW, BAR)) >= FILLER_RUN:
            return "filler"
        if self.error.covered(h, len(c), ERROR_WINDOW, ERROR_BAR) is not None:
            lines = [x.strip() for x in content.split("\n")]
            kept = [x for x in lines if x and x != title.strip()]
            if body is not None:
                kept = body(kept) or kept
            if self.error_share(kept) >= (ERROR_SHARE_BAD if (status or 0) >= 400 else ERROR_SHARE):
                return "error"
        return None


class PageJudge:
    """One page seen by all models: residue, keywords, furniture."""

    def __init__(self, models: PageModels, lines: LineModel | None = None):
        self.lines = lines or LineModel(models.weights, models.bias, models.recurring)
        self.residue = ResidueModels(models)
        self.spam = SpamModel()

    def verdict(self, title, content, names: frozenset[str] = frozenset(), status: int | None = None) -> str | None:
        return self.residue.verdict(title, content, lambda xs: self.lines.body(xs, names), status)

    def is_spam(self, title, content, names: frozenset[str] = frozenset()) -> bool:
        lines = [x.strip() for x in (content or "").split("\n")]

        return self.spam.is_spam(title, lines, lambda x: self.lines.sure(x, names)) and self.verdict(title, content, names) not in ("filler", "error")

    def bare(self, title, content, names: frozenset[str] = frozenset()) -> bool:
        """A page of keywords, filler or a notice, whose text is its body."""
        return self.is_spam(title, content, names) or self.verdict(title, content, names) in ("filler", "error")


def prose_sample(spark, sf_dir: str) -> list[str]:
    """At most PROSE_TEXTS sample texts, in the order of their ids."""
    rows = table(spark, sf_dir, "lang_samples").where("text is not null").orderBy("sample_id").limit(PROSE_TEXTS).select("text").collect()
    return [r[0] for r in rows]


def residue(pages: DataFrame, models: PageModels) -> DataFrame:
    """(id, residue): kind of residue of each row, rows without any left out; one row per id."""
    shared = pages.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa

        judge = PageJudge(shared.value)
        for b in batches:
            ids, kinds = [], []
            for i, t, c, s, d, u in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (v := judge.verdict(t, c, host_names(d, u), s)) is not None:
                    ids.append(i)
                    kinds.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string())], ["id", "residue"])

    p = pages.select("id", "title", "content", F.col("status_code").cast("int"), "domain", "url").where("id is not null and content is not null")
    return p.mapInArrow(run, "id string, residue string").groupBy("id").agg(F.min("residue").alias("residue"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "docs"), page_models(spark, sf_dir)).select("id")
