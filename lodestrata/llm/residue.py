"""Template residue, filler, error messages and script notices in the place of content.

Labelled exemplars of residue are kept in an inverted index from token to exemplar. Passages are windows: a sentence, or
up to four sentences in a row, also over line ends within a paragraph. The exemplars that share a window's tokens are
retrieved, and the part of the window's TF-IDF weight that the best of them contains is its coverage; an exemplar must
itself be contained for the larger part. A window of high coverage is residue; quoted residue, as in an article about
it, is not. An unfilled placeholder is a token of its own class, whatever name stands in it, and comes from the same index.

Weights of tokens come from the document frequencies over all pages, for the exemplars' own tokens alone: their
number is bounded by the exemplars. They are counted in the pass that counts lines (``boilerplate.Crawl``).
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.codepoints import map_text

PLACEHOLDER, FILLER, ERROR, SCRIPT = "placeholder", "filler", "error", "script"
#: Least share of a window's weight in one exemplar, and of an exemplar's weight in the window.
COVERAGE, HELD = 0.7, 0.55
#: Or the one exemplar has this share of the window, and all exemplars of its kind that were retrieved have the second.
HALF, TOGETHER = 0.4, 0.75
#: Sentences of the longest window.
WINDOW = 4

# Labelled exemplars, the stock wording of public software and of its translations.
EXEMPLARS = {
    # unfilled expressions of Jinja, Handlebars, Liquid, shell, ERB, Mustache, Windows, Ant, Python and form letters
    PLACEHOLDER: """{{ name }}
{% name %}
${name}
#{name}
[[name]]
<%= name %>
%%name%%
@@name@@
__NAME__
[your name]
<title>
<name goes here>
TODO: write text
TBD
[object Object]""",
    # Create React App, Vue CLI, Angular, Stack Exchange, Cloudflare, Disqus, WordPress, Discourse, Mastodon, Jira, AWS documentation, Microsoft support, and their translations
    SCRIPT: """You need to enable JavaScript to run this app.
You need to turn on scripts to use this page.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Please enable JavaScript to continue using this application.
This site works best with JavaScript enabled.
Works best with JavaScript turned on.
JavaScript is switched off or blocked by your browser.
Your browser seems to be blocking JavaScript.
Your browser seems to have JavaScript disabled.
Your browser does not support JavaScript.
Enable JavaScript and cookies to continue
Please enable JavaScript to view the comments powered by Disqus.
Please enable JavaScript to view this site.
Please enable JavaScript to view this page.
JavaScript is disabled. Please enable it in your browser settings to continue.
This site requires JavaScript.
JavaScript must be enabled to use this site.
For full functionality of this site it is necessary to enable JavaScript in your browser.
Turn on JavaScript in your browser.
To use this website, JavaScript must be enabled.
JavaScript is not available. We've detected that JavaScript is disabled in this browser.
Loading... Please wait. If nothing happens, enable scripts and reload the page.
Allow scripts and reload the page.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu sehen.
Für diese Anwendung wird JavaScript benötigt.
Diese Anwendung benötigt JavaScript und Skripte.
Veuillez activer JavaScript pour utiliser cette application.
Veuillez activer JavaScript pour afficher cette page.
Ce site nécessite JavaScript.
Por favor, active JavaScript para ver esta página.
Habilite JavaScript en su navegador para continuar.
Ative o JavaScript para ver esta página.
Habilite o JavaScript no seu navegador para continuar.
Для работы этого приложения необходимо включить JavaScript.
Пожалуйста, включите JavaScript, чтобы открыть эту страницу.
JavaScriptを有効にしてください。
このアプリを実行するには、JavaScriptを有効にしてください。
このページを表示するにはJavaScriptを有効にしてください。""",
    # Apache, nginx, IIS, Squid, Heroku, Rails, Django, Laravel, Symfony, WordPress, Drupal, Joomla, MediaWiki, phpBB, Moodle, Discourse, YouTube, Cloudflare, reCAPTCHA, and their translations
    ERROR: """404 Not Found
Not Found
Page not found
404 Page not found
Error 404
Error code 404
HTTP Error 404
The requested URL was not found on this server.
The page you were looking for could not be found.
The page you requested could not be found.
The page you are looking for doesn't exist or has been moved.
Sorry, this page no longer exists or has moved.
Oops! That page can't be found.
It looks like nothing was found at this location.
410 Gone
The requested resource is no longer available on this server.
Error
Oops
500 Internal Server Error
Internal Server Error
Our engineers have been notified.
Our engineers have been told.
Reference number
The server encountered an internal error and was unable to complete your request.
Oops! Something went wrong.
Oops! Something went wrong on our end.
We're sorry, but something went wrong.
There has been a critical error on this website.
502 Bad Gateway
Bad gateway: the server received no response in time from the upstream server.
The upstream host did not answer in time.
503 Service Unavailable
Service temporarily unavailable. Please try again in a few minutes.
The server is temporarily unable to service your request. Please try again later.
504 Gateway Timeout
Gateway timeout
Application error
Error establishing a database connection
Database connection failed
Connection timed out
timeout after 30 s
403 Forbidden
Forbidden
Access Denied
Access denied. You do not have permission to view this resource.
You don't have permission to access this resource.
You are not authorized to access this page.
401 Unauthorized
429 Too Many Requests
Too many requests from your address.
Our systems have detected unusual traffic from your computer network.
Request id
Checking your browser before accessing this site.
Checking your browser before you continue. Ray ID
Just a moment...
Please verify you are a human
Verify you are human by completing the action below.
Please complete the security check to continue
Your session has expired. Please log in again.
This content is not available in your country or region.
Sorry, this content isn't available right now.
We could not load this article. Please reload the page or come back later.
Site maintenance
Site under maintenance
Briefly unavailable for scheduled maintenance. Check back in a minute.
This page is under construction. Come back soon.
Under construction
The file you were looking for could not be found.
The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.
We couldn't find the page you were looking for.
Something went wrong. Please try again later.
An unexpected error occurred. Please try again later.
You have been logged out. Please sign in again to continue.
Too many login attempts. Please wait and try again later.
We are currently down for maintenance. We will be back shortly.
The site is temporarily offline.
The service is currently not available. Please retry later.
Could not connect to the database server.
Your request has been blocked by our security rules.
Sorry, you have been blocked. You are unable to access this site.
Fehler 404
Fehler 500
Fehler
Seite nicht gefunden
Die Seite wurde nicht gefunden.
Die angeforderte Seite konnte nicht gefunden werden.
Dieser Inhalt ist derzeit nicht verfügbar.
Bitte versuchen Sie es später erneut.
Bitte später erneut versuchen.
Zugriff verweigert
Interner Serverfehler
Die angeforderte URL wurde auf diesem Server nicht gefunden.
Der Dienst ist vorübergehend nicht verfügbar.
Wartungsarbeiten
Erreur 404
Erreur
Page introuvable
Page non trouvée
Cette page est introuvable.
La page demandée est introuvable.
Service momentanément indisponible. Réessayez dans quelques minutes.
Service temporairement indisponible, réessayez plus tard.
Accès refusé
Référence
Erreur interne du serveur
Désolé, la page que vous cherchez n'existe pas ou plus.
Une erreur est survenue.
Error 404: página no encontrada
Página no encontrada
Acceso denegado
Servicio no disponible por el momento. Inténtelo de nuevo más tarde.
Error interno del servidor
Lo sentimos, no hemos encontrado la página que busca.
Se ha producido un error.
Erro 404: página não encontrada
Erro
Página não encontrada
Acesso negado
Serviço indisponível no momento. Tente novamente mais tarde.
Erro interno do servidor
Desculpe, a página que você procura não existe.
Ocorreu um erro.
Ошибка 404: страница не найдена
Ошибка
Страница не найдена
Доступ запрещён
Сервис временно недоступен. Попробуйте позже.
Внутренняя ошибка сервера
Извините, такой страницы не существует.
Errore 404: la pagina richiesta non esiste
Accesso negato
Pagina niet gevonden
Nie znaleziono strony
404 ページが見つかりません
お探しのページが見つかりません
ページが見つかりませんでした。
現在アクセスできません。しばらくお待ちください。
しばらくしてからもう一度お試しください。
アクセスが拒否されました
サービスは一時的に利用できません""",
    # Cicero's filler as typesetters use it, HTML editors' default titles, sample texts of page builders, the metasyntactic variables, and their like in other languages
    FILLER: """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vitae semper rutrum congue mollis porta justo felis massa augue tellus turpis dictum urna lacus neque porro quisquam dolorem quia adipisci perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae illo inventore veritatis quasi architecto beatae
This is a sample paragraph. Replace this text with your own words.
Sample text. Replace with your own content.
Body copy will be added by the editor.
Headline text block goes here.
Your text goes here. Add your content here.
Placeholder text. Insert text here.
foo bar baz qux qwer asdf qwerty test xxx bla
Untitled Document
Hier steht Blindtext. Dies ist ein Typoblindtext.
Ceci est un texte de remplissage. Votre texte ici.
Este es un texto de relleno. Su texto aquí.
Este é um texto de exemplo. Seu texto aqui.
Здесь будет ваш текст. Это пример текста.
ここに本文を入力してください。これはダミーテキストです。""",
}

_FIELDS = "title|headline|author|body|caption|category|date|price|product|section|site|summary|teaser|user|name|company|address|email|phone"
# The forms of unfilled expressions, one class of tokens each.
_CLASSES = {
    "mustache": r"\{\{\s*[\w.|]+(?: [\w.|]+)*\s*\}\}",
    "tag": r"\{%\s*[\w. ]+\s*%\}",
    "dollar": r"\$\{\s*[\w.]+\s*\}",
    "hash": r"#\{[\w.]+\}",
    "square": r"\[\[\s*[\w.]+\s*\]\]",
    "erb": r"<%=?\s*[\w.]+\s*%>",
    "percent": r"%%\s*[\w.]+\s*%%",
    "at": r"@@\s*[\w.]+\s*@@",
    "dunder": r"__(?-i:[A-Z]+(?:_[A-Z]+)*)__",
    "form": r"\[(?:insert|your|add|enter) [\w ]{2,40}\]|<(?:your|insert|enter) [\w ]{2,30}>",
    "field": rf"(?:&lt;|<)(?:{_FIELDS})(?:&gt;|>)",
    "here": r"<[a-z][\w ]{1,30} (?:goes )?here>",
    "todo": r"\b(?-i:TODO): ?\w+ \w+",
    "tbd": r"\b(?-i:TBD)\b",
    "object": r"\[object Object\]",
}
_UNFILLED = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in _CLASSES.items()), re.I)
_MAYBE = re.compile(r"[{$#]\{|\{%|\[\[|\[[A-Za-z]|<[A-Za-z%]|&lt;|%%|@@|__|TODO|TBD")
_APART = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_OTHER, _CYRILLIC, _WIDE = re.compile("[Ѐ-ӿ぀-ヿ一-鿿]"), re.compile("[Ѐ-ӿ]+"), re.compile("[぀-ヿ一-鿿]+")
#: Bytes that characters of these scripts begin with.
_LEADS = bytes([*range(0xD0, 0xD4), *range(0xE3, 0xEA)])
_QUOTES = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|「[^」\n]*」")
_ENDS = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_STOPS = (". ", "! ", "? ", "… ", "。", "！", "？")


_ENDINGS = re.compile("(?<=...)(?:ing|ed|es|s|e)$")


class _Stems(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        stem = self[word] = _ENDINGS.sub("", word)
        return stem


_STEMS = _Stems()


def _raw(text: str) -> list[str]:
    """Words in lower case, without accented letters or what a wrong encoding made of them; of Japanese, pairs of characters."""
    return _apart(text.lower())


def _apart(low: str) -> list[str]:
    out = low.encode("ascii", "ignore").translate(_APART).decode("ascii").split()
    if not low.isascii() and len(b := low.encode("utf-8", "surrogatepass")) > len(b.translate(None, _LEADS)) and _OTHER.search(low):
        out += _CYRILLIC.findall(low)
        out += [w[i:i + 2] for w in _WIDE.findall(low) for i in range(max(1, len(w) - 1))]
    return out


def _words(text: str) -> list[str]:
    """The words of a text without their commonest endings; identifiers and request numbers, which hold digits, are no words."""
    return [_STEMS[w] for w in _raw(text) if w.isalpha()]


def surfaces(stems: frozenset[str] | set[str]) -> dict[str, str]:
    """The words that have one of these stems, with it: a text's words are looked up in it as they stand."""
    return {w: t for t in stems for e in ("", "s", "es", "e", "ed", "ing") if _STEMS[w := t + e] == t}


def _masked(quotation: re.Match[str]) -> str:
    """As many words that no exemplar has as a quotation has: what is quoted is no residue."""
    return " " + "quotation " * max(3, quotation.group().count(" ") + 1)


def sentences(line: str) -> list[str]:
    """The sentences of a line as ``_ENDS`` parts them, but for blanks at their ends, quotations masked."""
    if not line.isascii() or "`" in line or '"' in line:
        line = _QUOTES.sub(_masked, line)
    if not line.isprintable():  # white space other than blanks
        return _ENDS.split(line)
    for end in _STOPS[:3] if line.isascii() else _STOPS:
        if end in line:
            line = line.replace(end, end + "\n")
    return line.split("\n")


def may_be_unfilled(text: str) -> bool:
    """Whether an unfilled expression may begin somewhere in a text; most texts are told by the first look."""
    return ("{" in text or "[" in text or "<" in text or "__" in text or "%%" in text or "@@" in text or "&lt;" in text or "TODO" in text or "TBD" in text) and _MAYBE.search(text) is not None


def unfilled_expressions(text: str) -> list[re.Match[str]]:
    """The unfilled expressions of a text, tried only where one may begin."""
    out: list[re.Match[str]] = []
    end = 0
    if not may_be_unfilled(text):
        return out
    for at in _MAYBE.finditer(text):
        if at.start() >= end and (m := _UNFILLED.match(text, at.start())):
            out.append(m)
            end = m.end()
    return out


def token_set(text: str, known: dict[str, str], normal: str | None = None) -> set[str]:
    """The distinct tokens of a text that are among ``known``, as ``surfaces`` gives them, and its unfilled expressions; the ``normal`` form of its lines has the same words, but for those with digits, which no exemplar has."""
    out = {known[w] for w in known.keys() & (_raw(text) if normal is None else _apart(normal))}
    out.update([f"<{m.lastgroup}>" for m in unfilled_expressions(text)])
    return out


def tokens(text: str) -> list[str]:
    """Words as ``_words`` has them, and a token ``<class>`` for each unfilled expression."""
    found = unfilled_expressions(text)
    if not found:
        return _words(text)
    edges = [0, *(x for m in found for x in m.span()), len(text)]
    return [f"<{m.lastgroup}>" for m in found] + _words(" ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))


class Exemplars:
    """The inverted index of labelled residue, with the weight of each token."""

    def __init__(self, labelled: dict[str, str] = EXEMPLARS, weights: dict[str, float] | None = None, other: float = 1.0) -> None:
        self.kinds: list[str] = []
        self.sets: list[frozenset[str]] = []
        for name, lines in labelled.items():
            for line in lines.split("\n"):
                self.kinds.append(name)
                self.sets.append(frozenset(tokens(line)))
        #: Filler is a bag of words in any order and number; no part of the bag has to be complete.
        self.bags = [name == FILLER for name in self.kinds]
        self.index: dict[str, list[int]] = {}
        for k, own in enumerate(self.sets):
            for t in own:
                self.index.setdefault(t, []).append(k)
        self.weights = weights or {}
        #: Weight of a token no exemplar has.
        self.other = other
        self.totals = [sum(self.weight(t) for t in own) for own in self.sets]
        self._units: dict[str, tuple[tuple[list[str], int, str | None], ...]] = {}
        #: By which exemplars are retrieved: the heaviest tokens of each, without one of which too little of it would be held.
        self.anchors = surfaces({t for k in range(len(self.sets)) for t in self._rarer(k)})
        #: Weights of words as they stand.
        self._weigh = {w: self.weight(t) for w, t in surfaces(self.index.keys()).items()}

    def _rarer(self, k: int) -> list[str]:
        if self.bags[k]:  # any heavy word of the bag
            return [t for t in self.sets[k] if self.weight(t) >= self.other / 2]
        out, rest = [], self.totals[k]
        for t in sorted(self.sets[k], key=self.weight, reverse=True):
            if rest < HELD * self.totals[k]:
                break
            out.append(t)
            rest -= self.weight(t)
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_units": {}}

    def weight(self, token: str) -> float:
        return self.weights.get(token, self.other)

    @classmethod
    def weighted(cls, labelled: dict[str, str], rows: dict[str, int], n: int) -> Exemplars:
        """Weights from how many of ``n`` texts hold each token; a token no exemplar has weighs like the median of those the texts hold at all."""
        weights = {t: log((n + 1) / (rows.get(t, 0) + 0.5)) + 0.1 for lines in labelled.values() for t in tokens(lines)}
        met = sorted(w for t, w in weights.items() if rows.get(t))
        return cls(labelled, weights, met[len(met) // 2] if met else 1.0)

    def match(self, own: list[str]) -> str | None:
        """The kind of the exemplar that covers enough of a window's tokens, if one does."""
        held = [t for t in own if t in self.index]
        known = sum([self.weight(t) for t in held])
        total = known + self.other * (len(own) - len(held))
        if not held or known < COVERAGE * total:
            return None
        shared: dict[int, float] = {}
        seen: set[str] = set()
        for t in held:
            w = self.weight(t)
            first = t not in seen
            seen.add(t)
            for k in self.index[t]:
                if first or self.bags[k]:
                    shared[k] = shared.get(k, 0.0) + w
        found, share = None, 0.0
        least = COVERAGE
        for name in {self.kinds[k] for k in shared}:
            if sum([self.weight(t) for t in held if any(self.kinds[k] == name for k in self.index[t])]) >= TOGETHER * total:
                least = HALF
        for k, w in shared.items():
            cover = w / total
            if cover > share and (self.bags[k] and (len(own) >= 4 or cover == 1.0 and len(seen) >= min(2, len(self.sets[k]))) or not self.bags[k] and sum([self.weight(t) for t in seen & self.sets[k]]) >= HELD * self.totals[k]):
                found, share = k, cover
        return self.kinds[found] if found is not None and share >= least else None

    def unfilled(self, text: str) -> list[re.Match[str]]:
        """The windows of one token that an exemplar of a placeholder contains, but for those in quotation marks."""
        found = [m for m in unfilled_expressions(text) if self.match([f"<{m.lastgroup}>"]) == PLACEHOLDER]
        if not found:
            return []
        quoted = [m.span() for m in _QUOTES.finditer(text)]
        return [m for m in found if not any(a <= m.start() and m.end() <= b for a, b in quoted)]

    def _sentences(self, line: str) -> tuple[tuple[list[str], int, str | None], ...]:
        """(tokens, characters, kind by itself) of each sentence of a line."""
        known = self._units.get(line)
        if known is None:
            if len(self._units) > 100_000:
                self._units.clear()
            out = []
            maybe = may_be_unfilled(line)
            for s in sentences(line):
                if size := len(s.strip()):
                    own = tokens(s) if maybe or self._worth(_raw(s)) else []
                    out.append((own, size, self.match(own) if own else None))
            known = self._units[line] = tuple(out)
        return known

    def _worth(self, words: list[str]) -> bool:
        """Whether a sentence of these words may be hopeful; a hair's breadth for sums in another order. Most sentences end here, without their tokens."""
        known = [self._weigh[w] for w in words if w in self._weigh]
        return sum(known) >= (COVERAGE - 1e-6) * (sum(known) + self.other * (sum(map(str.isalpha, words)) - len(known)))

    def _hopeful(self, own: list[str]) -> bool:
        """Whether all exemplars together hold enough of a sentence for it to be a part of a window."""
        known = sum([self.weight(t) for t in own if t in self.index])
        return bool(own) and known >= COVERAGE * (known + self.other * sum(t not in self.index for t in own))

    def of_lines(self, lines: list[str], forms: list[str] | None = None) -> list[str | None]:
        """The kind of residue each line is, if windows of residue cover most of it; windows do not go over blank lines. ``forms`` are the lines in lower case or normal."""
        out: list[str | None] = [None] * len(lines)
        run: list[tuple[int, list[str], int, str | None]] = []

        def close() -> None:
            if not run:
                return
            kinds = [r[3] for r in run]
            if len(run) > 1 and any(k is None for k in kinds):
                for size in range(2, WINDOW + 1):
                    for a in range(len(run) - size + 1):
                        if any(k is None for k in kinds[a:a + size]) and (k := self.match([t for r in run[a:a + size] for t in r[1]])):
                            kinds[a:a + size] = [x or k for x in kinds[a:a + size]]
            covered: dict[int, Counter[str]] = {}
            for (i, _, size, _), k in zip(run, kinds, strict=True):
                if k:
                    covered.setdefault(i, Counter())[k] += size
            for i, by in covered.items():
                k, _ = by.most_common(1)[0]
                if sum(by.values()) >= COVERAGE * sum(u[1] for u in self._sentences(lines[i])):
                    out[i] = k
            run.clear()

        text = "\n".join(lines)
        maybe = may_be_unfilled(text)
        low = text.lower() if forms is None else "\n".join(forms)
        anchors = self.anchors.keys() & _apart(low)
        if not maybe and not anchors:
            return out
        held = [self._anchored(form, anchors) or maybe and may_be_unfilled(line) for line, form in zip(lines, low.split("\n"), strict=True)]
        if not any(held):
            return out
        near = {j for i, x in enumerate(held) if x for j in range(i - WINDOW + 1, i + WINDOW)}
        for i, line in enumerate(lines):
            units = self._sentences(line) if i in near else ()
            if not units:
                close()
            for own, size, k in units:
                if k or self._hopeful(own):
                    run.append((i, own, size, k))
                else:
                    close()
        close()
        return out

    @staticmethod
    def _anchored(form: str, anchors: set[str]) -> bool:
        """Whether a line has one of its page's anchors; only lines are parted that one stands in somewhere."""
        plain = form if form.isascii() else form.encode("ascii", "ignore").decode("ascii")
        for x in anchors:
            if x in plain or x in form:
                return not anchors.isdisjoint(_apart(form))
        return False

    def best(self, text: str) -> str | None:
        """The kind of residue a single line is, if it is any."""
        return self.of_lines([text])[0]


_SUFFIX = re.compile(r"\s+(?:[|–—-]|â€“|â€”|ÔÇô|ÔÇö|‚Äì|‚Äî|вЂ“)\s+[^|–—-]{2,40}$")


def _field_kind(exemplars: Exemplars, title: str) -> str | None:
    t = title.strip()
    if not t:
        return None
    if exemplars.unfilled(t):
        return PLACEHOLDER
    return exemplars.best(t) or exemplars.best(_SUFFIX.sub("", t))


def residue_fields(pages: DataFrame, **columns: str) -> DataFrame:
    """(page_id, field_name, residue_kind) of every field that is to be left out.

    A placeholder outside quotation marks is enough. Otherwise the field's own content, site furniture aside, must be
    residue for the larger part, or too short beside it for an article; a script notice counts only in the second case. Null and empty fields
    have no case; repeated rows are judged each; very long texts are read whole; further columns are ignored; an
    empty table gives an empty result.
    """
    from lodestrata.llm.boilerplate import LEAST_ARTICLE, Forms, headlike, judged
    from lodestrata.llm.repeated_lines import standing_numbers

    rows, classifier = judged(pages, **columns)
    exemplars = classifier.exemplars

    def own_kind(lines: list[str], kinds: list[str | None], title: str | None, standing: set[int]) -> str | None:
        size = {FILLER: 0, ERROR: 0, SCRIPT: 0, PLACEHOLDER: 0}
        rest = 0
        labels = classifier.label(lines, title, standing, kinds)
        for line, r, good in zip(lines, kinds, labels, strict=True):
            if r:
                size[r] += len(line.strip())
            elif good and not headlike(line):
                rest += len(line.strip())
        if (size[FILLER] or size[ERROR]) and (size[FILLER] + size[ERROR] > rest or rest < LEAST_ARTICLE):
            return FILLER if size[FILLER] >= size[ERROR] else ERROR
        return SCRIPT if size[SCRIPT] and rest < LEAST_ARTICLE else None

    def run(block: pa.RecordBatch) -> pa.RecordBatch | None:
        at, fields, found = [], [], []
        titles, texts = (block.column(c).to_pylist() for c in ("title", "text"))
        in_doubt: dict[int, tuple[list[str], list[str | None]]] = {}
        for k, (title, text) in enumerate(zip(titles, texts, strict=True)):
            if title and (r := _field_kind(exemplars, title)):
                at.append(k)
                fields.append("title")
                found.append(r)
            if not text:
                continue
            if may_be_unfilled(text) and any(exemplars.unfilled(x) for x in _paragraphs(text)):
                at.append(k)
                fields.append("text_content")
                found.append(PLACEHOLDER)
                continue
            lines = text.split("\n")
            kinds = exemplars.of_lines(lines)
            if any(kinds):
                in_doubt[k] = lines, kinds
        if in_doubt:  # only here does it matter what the site adds
            take = pa.array(list(in_doubt))
            standing = standing_numbers(doubted := [texts[k] for k in in_doubt], block.column("hot").take(take), Forms(doubted))
            for (k, (lines, kinds)), own in zip(in_doubt.items(), standing, strict=True):
                if r := own_kind(lines, kinds, titles[k], own):
                    at.append(k)
                    fields.append("text_content")
                    found.append(r)
        if not at:
            return None
        return pa.RecordBatch.from_arrays([block.column("page_id").take(pa.array(at)), pa.array(fields), pa.array(found)], ["page_id", "field_name", "residue_kind"])

    return map_text(rows.where(F.col("text").isNotNull() | F.col("title").isNotNull()).select("page_id", "title", "text", "hot"), run, "page_id long, field_name string, residue_kind string", "text")


def _paragraphs(text: str) -> list[str]:
    """Runs of lines between blank ones, joined: a quotation may go over a line's end."""
    return [" ".join(p.split("\n")) for p in re.split(r"\n[ \t\r]*\n", text)]
