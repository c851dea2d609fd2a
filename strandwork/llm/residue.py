"""Problem 10: template residue, filler, error pages and script notices, found from labelled exemplars.

A passage (a sentence or line, in windows of a few words where it is long) asks an inverted index of the exemplars' terms for the
exemplars of a kind that hold most of its weight; its score is its TF-IDF containment, the share of its weight that these few hold
together, with document frequencies counted over the whole corpus. So a notice worded like none of the exemplars is
found if its words are, and a sentence that only mentions such words isn't. An unfilled slot is a passage of its own:
the term of its delimiters, weighed by how few documents use them, and the words between them. Code is masked first:
text that shows a placeholder in code speaks of it and is no residue.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.sources.tables import table

# Labelled exemplars, one a line, by kind. Numbers stand for any number.
EXEMPLARS = {
    "filler": """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum placeat
Sample text. Sample text. Sample text.
blah blah blah blah
asdf asdf asdf qwerty test test test
test entry please ignore
xxxx xxxx xxxx xxxx xx xxxxx
Your abstract goes here. Replace this text before you submit the form.
Replace this text with your own.
Insert lay summary here.
Insert text here.
Your text here.
Summary to follow.
Abstract to follow.
Text to be added.
Details to be confirmed.
Type the aims of the project in this box (max. 100 words).
Enter a description of the project here.
Click to add text
Click here to edit this text.
Description coming soon!
Coming soon
Content coming soon
This page is under construction.
This is placeholder text.
placeholder
placeholder text
TBD
TBC
TBA
TODO
to be determined
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit
neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem ut enim ad minima veniam quis nostrum exercitationem ullam corporis suscipit laboriosam nisi ut aliquid ex ea commodi consequatur
quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur vel illum qui dolorem eum fugiat quo voluptas nulla pariatur at vero eos et accusamus et iusto odio dignissimos ducimus
vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas
This is sample text. Test text.
Sample content goes here
blah blah blah
qwerty qwerty asdf asdf asdf
test test test test
This is a test entry, please ignore it.
This is only a test. Please ignore this post.
xxx xxxx xxxxx xxxx xxx
Your summary goes here. Replace this placeholder text with your own.
Replace this with your own abstract.
Add your text here. Write your content here.
Insert your summary here.
Enter your text here
Put your description here.
More details to follow.
Full text to be added later.
Further information to be confirmed.
To be completed.
Type your summary in this box (max. 250 words).
Describe the aims of your project in the box below.
Please enter a short description of the project.
Click here to add content.
Page content coming soon, check back later.
This page has no content yet.
Our website is under construction. Please check back soon.
Dummy text for layout purposes only.
This is dummy content, placeholder copy for the layout.
content to follow
text to follow
coming soon
n/a to be confirmed
""",
    "error": """
404 - page not available The page you asked for could not be found. Return to the home page or use the search.
404 Not Found
404 Page not found
The requested URL was not found on this server.
The page you are looking for does not exist.
Sorry, the page you requested could not be found.
Access denied. You do not have permission to view this project on this server. Incident 123.
403 Forbidden You don't have permission to access this resource.
500 Internal Server Error The server encountered an internal error and was unable to complete your request.
The server met an internal problem and could not finish your request.
502 Bad Gateway
503 Service Unavailable
504 Gateway Time-out
Service is temporarily down for maintenance. Please try again in a few minutes.
We'll be back soon. The site is down for scheduled maintenance.
Gateway time-out: upstream did not answer within 30 seconds.
Too many requests. Slow down and retry later.
We're sorry, something went wrong on our side. Our engineers have been told.
Oops! Something went wrong. Please try again later.
Could not reach the database (code 1234)
Error establishing a database connection
Your session has expired. Sign in again to continue.
Please log in to view this page.
You must be signed in to view this content.
This repository has been disabled. Nothing to see here.
This repository is unavailable due to a takedown notice.
Traceback (most recent call last): File "render.py", line 12 KeyError: 'lay_summary'
{"error": {"status": 404, "message": "resource not available"}}
Fehler 404: Die angeforderte Seite wurde nicht gefunden.
Seite nicht gefunden
Error del servidor: la página no está disponible.
Página no encontrada
Erreur : cette page n'existe pas ou a été déplacée.
Page introuvable
お探しのページは見つかりませんでした。
ページが見つかりません。
404 error: the page you requested could not be found. Go back to the home page or try a search.
The page cannot be displayed.
File not found. The file you requested does not exist on this server.
This page has been moved or deleted and is no longer available.
410 Gone. The requested resource has been permanently removed.
The content you are looking for is no longer available.
You are not authorised to access this page. Access is denied.
401 Unauthorized: authentication is required to access this resource.
401 Unauthorized. Authentication required to access the server.
Your IP address has been blocked. Access to this site is forbidden.
Sorry, you have been blocked. You are unable to access this site.
You do not have permission to view this page. Contact the administrator.
500 Internal error: the server was unable to complete the request.
An unexpected error has occurred. Please try again later or contact support.
The server encountered a problem and could not process your request. Please try again.
502 Bad gateway: the web server reported an error from the upstream server.
The service is currently unavailable. Please try again in a few minutes.
The website is temporarily unavailable due to maintenance. We will be back soon.
Sorry for the inconvenience, we are performing scheduled maintenance at the moment.
504 Gateway timeout. The upstream server did not respond in time.
The connection has timed out. The server took too long to respond.
This site cannot be reached.
429 Too many requests. You have sent too many requests, please wait and retry later.
Rate limit exceeded. Please slow down and try again later.
Something went wrong. Our team has been told about the problem, please try again.
We are sorry, an error occurred on our side. Our engineers are looking into it.
Database error: could not connect to the database server (code 1049)
Connection to the database failed
Your session has timed out. Please sign in again to continue.
Session expired, log in again.
Please sign in to continue. You need to log in to view this page.
You need an account to see this content. Log in or register.
This account has been suspended.
This repository has been removed or is not available.
This repository has been disabled due to a takedown notice. Nothing here to see.
Access to this content has been disabled by the owner.
Fatal error: Uncaught exception in index.php on line 12
Uncaught exception: fatal error in main.php on line 7
Traceback (most recent call last): File "main.py", line 7, in module ValueError: invalid literal
TypeError: 'NoneType' object is not subscriptable File "app.py", line 30 KeyError: 'summary'
{"error": {"code": 500, "message": "internal server error"}}
{"status": "error", "message": "resource not found", "code": 404}
Fehler 404: Die gesuchte Seite existiert nicht oder wurde verschoben. Die Seite wurde nicht gefunden.
Der Dienst ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später erneut.
Error 404: la página solicitada no existe. Error del servidor, página no disponible.
Diese Seite ist vorübergehend nicht verfügbar, bitte versuchen Sie es später noch einmal.
Ce service est temporairement indisponible, veuillez réessayer plus tard.
El servicio no está disponible. Inténtelo de nuevo más tarde.
Erreur 404 : la page demandée n'existe pas. Cette page a été supprimée ou déplacée.
Le service est temporairement indisponible. Veuillez réessayer plus tard.
お探しのページは存在しません。ページは見つかりませんでした。
申し訳ありません。ページが見つかりません。
""",
    "script": """
This site requires JavaScript and cookies. Please turn them on in your browser and reload.
JavaScript has to be switched on before this listing can start.
Your browser does not support scripts, so the project listing cannot be shown.
Scripts are switched off. Turn scripts on to read this abstract.
Please enable JavaScript to view this page.
You need to enable JavaScript to run this app.
JavaScript is disabled in your browser.
Please enable cookies and reload the page.
Veuillez activer JavaScript pour afficher le résumé.
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.
Active JavaScript para ver este contenido.
JavaScriptを有効にしてください。
One moment, we are looking at your browser...
Checking your browser before accessing the site.
Just a moment... Verifying you are human.
Solve the puzzle below to show that you are a person.
Please complete the captcha to continue.
We use cookies. Accept all / Reject all / Manage settings. Content is hidden until you choose.
Loading... Loading... Loading...
Loading, please wait...
Please wait while the page loads.
This website requires JavaScript. Please enable JavaScript and cookies in your browser and reload the page.
JavaScript must be enabled to use this site. It has to be switched on in your browser settings.
Your browser does not support JavaScript or it is turned off, so this page cannot be shown.
Scripts are disabled. Please turn on scripts in your browser to read this page.
Cookies are disabled in your browser. Turn cookies on and reload the page to continue.
This application needs scripts to run. Switch scripts on before you start.
Your browser is out of date. Please update your browser to view this site.
Veuillez activer JavaScript dans votre navigateur pour afficher cette page. Ce site nécessite JavaScript.
Bitte aktivieren Sie JavaScript in Ihrem Browser. Diese Seite benötigt JavaScript, um angezeigt zu werden.
Active JavaScript en su navegador para ver esta página. Este sitio necesita JavaScript.
このページを表示するにはJavaScriptを有効にしてください。
One moment, please. We are checking your browser before you can access the site.
Checking if the site connection is secure. This may take a few seconds.
Verifying that you are human. Please wait a moment.
Please complete the security check to access the site. Solve the puzzle below to prove that you are a human and not a robot.
Complete the captcha below to show that you are not a robot.
We use cookies to improve your experience. Accept cookies, reject all or manage your settings.
Please accept cookies to continue. Content is hidden until you accept.
Loading... please wait. Loading
Loading content, please wait a moment...
Please wait while the content is loading.
""",
}
# What slots ask for, and the words around it.
SLOT_WORDS = "name names first last full id ids number date dates start end title titles institution institutions summary abstract applicant applicants funder funders owner recipient type contact address email mail phone signature company organisation organization position city country author authors pi lead project department role amount reference description text placeholder value year keywords reason topic link url insert your enter add type here to be inserted added completed confirmed supplied filled in tbc tbd"
# Notations of slots (name, what it looks like); what is between the delimiters is on one line and holds none of them.
SHAPES = {
    "{{}}": r"\{\{[^{}\n]*\}\}", "{%}": r"\{%[^{}%\n]*%\}", "${}": r"\$\{[^{}\n]*\}", "[[]]": r"\[\[[^\[\]\n]*\]\]", "<<>>": r"<<[^<>\n]*>>", "@@": r"@@[^@\n]+@@", "<>": r"<[^<>\n/!=\"]*>", "&lt;": r"&lt;[^&<>\n]*&gt;",
    "##": r"(?<![A-Za-z0-9_])#[^\W\d_][\w-]*#(?![A-Za-z0-9_])", "%%": r"(?<![A-Za-z0-9_%])%[^\W\d_][A-Za-z_]*%(?![A-Za-z0-9_%])", "__": r"(?<![A-Za-z0-9_])__[A-Za-z][A-Za-z_]*?__(?![A-Za-z0-9_])", "$": r"(?<![A-Za-z0-9_$])\$[A-Z][A-Z_]{2,}(?![A-Za-z0-9_])", "_": r"(?<![A-Za-z0-9_])_{6,}(?![A-Za-z0-9_])", "x": r"(?<![A-Za-z0-9_])X{5,}(?![A-Za-z0-9_])",
    "[]": r"\[[^\[\]\n]*\](?!\()", "()": r"\([^()\n]*\)", "{}": r"(?<![\\A-Za-z0-9_^$}])\{[^{}\n\"':,]*\}",
}
_SHAPES = re.compile(r"(?=[{$\[<@#%_X(&])(?:" + "|".join(f"(?P<s{n}>{p})" for n, p in enumerate(SHAPES.values())) + ")")
#: what a text must hold for a notation, where it isn't the first half of its name
_MARKS = {"${}": "${", "{%}": "{%", "&lt;": "&lt;", "@@": "@", "_": "______", "x": "XXXXX", "$": "$"}
_SHAPE_NAMES = tuple("\x00" + k for k in SHAPES)
#: any of these has to be in a text that holds a slot
_MAY_HOLD_SLOT = re.compile(r"[{$\[<@#%(&]|_{6}|X{5}|__[A-Za-z]")
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|<code>.*?(?:</code>|\Z)|\b[fFrR]\"[^\"\n]*\"|\b[fFrR]'[^'\n]*'|\$[^$\n\\]*\\[^$\n]*\$", re.S)
_MAY_HOLD_CODE = re.compile(r"[`~\\]|<code>|\b[fFrR][\"']")
_RULE = re.compile(r"^[ \t]*[_X-]{3,}[ \t]*$", re.M)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_HIDDEN = re.compile(r"<(head|title|style|script)\b[^<>]*>", re.I)
_FURNITURE = re.compile(r"^\s*(?:\[\d{4}-\d\d-\d\d[^\]\n]*\]|Home >[^\n]*)|\(c\) \d{4} [^\n|]*(?:\|[^\n|]*)+$", re.M | re.I)
_TERM = re.compile(r"[぀-ヿ㐀-鿿가-힯]+|[^\W_]+")
_ASCII_TERM = re.compile(r"[A-Za-z0-9]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_PASSAGE = re.compile(r"(?<=[.!?…}])\s+|\s+(?=\{)|(?<=[。！？])|\s*[\n|•]+\s*")
#: a line that goes on in lower case is the one before it, wrapped
_WRAPPED = re.compile(r"(?<=[^\s.!?…:])\n(?=[a-z])")
_NAME = re.compile(r"[^\W\d_]+|\d+")


def without_hidden(text: str) -> str:
    """A page without its head, titles, styles and scripts, in one run over it; one that isn't closed hides nothing."""
    low, out, at, open_for_good = text.lower(), [], 0, set()
    for m in _HIDDEN.finditer(text):
        name = m.group(1).lower()
        if m.start() < at or name in open_for_good:
            continue
        end = low.find(f"</{name}>", m.end())
        if end < 0:
            open_for_good.add(name)
            continue
        out.append(text[at : m.start()])
        at = end + len(name) + 3
    return "\n".join([*out, text[at:]])


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """A word without case and plural, its first six letters; numbers are all ``0``."""
    word = word.casefold()
    if word.isdigit():
        return "0"
    return (word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word)[:6]


def terms(text: str) -> list[str]:
    """Terms of a plain text: stems, and pairs of characters where words aren't spaced."""
    if text.isascii():
        return list(map(stem, _ASCII_TERM.findall(text)))
    out: list[str] = []
    for t in _TERM.findall(text):
        if _WIDE.match(t):
            out.extend(t[i : i + 2] for i in range(max(1, len(t) - 1)))
        else:
            out.append(stem(t))
    return out


def read(text: str) -> tuple[str, list[tuple[str, ...]]]:
    """(the text without code, markup and slots, its slots as terms: the one of the delimiters, then those of the name)."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if _MAY_HOLD_CODE.search(text):
        text = _CODE.sub(" \x01 ", text)
    slots: list[tuple[str, ...]] = []
    if "__" in text or "XX" in text or "--" in text:
        text = _RULE.sub("\n", text)
    if "<" in text:
        text = without_hidden(text)

    def slot(m: re.Match) -> str:
        n = int(m.lastgroup[1:])
        found = (_SHAPE_NAMES[n], *[stem(t) for t in _NAME.findall(m.group().removeprefix("&lt;").removesuffix("&gt;"))]) if n < 12 or n > 13 else (_SHAPE_NAMES[n],)
        slots.append(found)
        return " \x02 " if n not in _PROSE else m.group()

    if _MAY_HOLD_SLOT.search(text):
        text = _SHAPES.sub(slot, text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "\n" in text:
        text = _WRAPPED.sub(" ", text)
    return (html.unescape(text) if "&" in text else text), slots


#: brackets are mostly prose: what they hold stays in the text too; tags are markup before they are slots
_PROSE = frozenset(n for n, k in enumerate(SHAPES) if k in ("[]", "()", "<>"))


@dataclass(frozen=True)
class Exemplar:
    kind: str
    text: str
    terms: tuple[str, ...]


def exemplars() -> list[Exemplar]:
    """The labelled exemplars; slots are labelled by a rule, every notation with every word."""
    words = tuple(dict.fromkeys(stem(w) for w in SLOT_WORDS.split()))
    found = [Exemplar("slot", k, (f"\x00{k}", *words)) for k in SHAPES]
    for kind, block in EXEMPLARS.items():
        found += [Exemplar(kind, line, tuple(terms(line))) for line in dict.fromkeys(block.strip().splitlines())]
    return found


class ResidueIndex:
    """Inverted index of the exemplars' terms, with the weights of the corpus.

    ``frequency`` has the terms of the exemplars and all that are common. A passage of four terms or more counts if the ``together`` exemplars of a kind that hold most of it hold ``containment`` of
    its weight, if that is ``least_weight`` at least, and if the best one alone holds ``alone``. Up to three words say nothing within a
    text; as a paragraph of their own, or over and over, they count if an exemplar is the same. A slot counts from ``slot_containment`` on.
    """

    def __init__(self, known: list[Exemplar], frequency: dict[str, int], documents: int, window: int = 16, together: int = 6, containment: float = 0.7, alone: float = 0.34, least_weight: float = 9.0, slot_containment: float = 0.6):
        self.known, self.window, self.together, self.containment, self.alone, self.least_weight, self.slot_containment = known, window, together, containment, alone, least_weight, slot_containment
        self.vocabulary = frozenset(t for x in known if x.kind != "slot" for t in x.terms)
        self.names = frozenset(t for x in known if x.kind == "slot" for t in x.terms)
        weight = lambda n: max(0.0, math.log((documents + 1) / (n + 0.5)))
        self.cost = {t: weight(frequency.get(t, 0)) for t in self.vocabulary | self.names | frequency.keys()}
        #: a term that neither an exemplar holds nor many documents counts as a rare one: it is evidence that the passage is something else
        self.other = weight(documents * COMMON) if documents else 1.0
        self.held = {t: self.cost[t] for t in self.vocabulary}
        self.index: dict[str, list[int]] = {}
        for n, x in enumerate(known):
            if x.kind != "slot":
                for t in set(x.terms):
                    self.index.setdefault(t, []).append(n)
        self.short = {frozenset(x.terms): x for x in reversed(known) if x.kind != "slot" and len(set(x.terms)) <= 3}

    def slot(self, slot: tuple[str, ...]) -> float:
        """Containment of a slot in what slots are known to hold."""
        shape = self.cost.get(slot[0])
        if shape is None:
            return 0.0
        held = shape + sum(self.cost[t] for t in slot[1:] if t in self.names)
        whole = held + sum(self.other for t in slot[1:] if t not in self.names)
        empty = len(slot) == 1 and slot[0] not in ("\x00_", "\x00x")
        return 0.0 if empty or whole <= 0 or shape < 0.5 and len(slot) < 4 else held / whole

    def passage(self, window: list[str]) -> tuple[float, int]:
        """The containment of a window in the few exemplars of one kind that hold most of it, and the best of these."""
        present = set(window)
        whole = sum(self.cost[t] if t in self.vocabulary else min(self.other, self.cost.get(t, self.other)) for t in present)
        gain: dict[int, float] = {}
        for t in present:
            for n in self.index.get(t, ()):
                gain[n] = gain.get(n, 0.0) + self.cost[t]
        best = (0.0, -1)
        by_kind: dict[str, list[int]] = {}
        for n in sorted(gain, key=lambda n: (-gain[n], n)):
            few = by_kind.setdefault(self.known[n].kind, [])
            if len(few) < self.together:
                few.append(n)
        for few in by_kind.values():
            held = {t for n in few for t in self.known[n].terms} & present
            mass = sum(self.cost[t] for t in held)
            if mass >= self.least_weight and gain[few[0]] >= self.alone * whole and mass / whole > best[0]:
                best = (mass / whole, few[0])
        return best

    def windows(self, seq: list[str]) -> Iterator[list[str]]:
        """The windows of a passage whose weight the exemplars' terms could hold; sums run along, so a long passage takes linear time."""
        held = [self.held.get(t, 0.0) for t in seq]
        if sum(held) < self.least_weight:
            return
        size = min(self.window, len(seq))
        lost = [0.0 if t in self.vocabulary else min(self.other, self.cost.get(t, self.other)) for t in seq]
        got, miss = sum(held[:size]), sum(lost[:size])
        for k in range(size, len(seq) + 1):
            if got >= self.least_weight and got >= self.containment * (got + miss) * 0.9:
                yield seq[k - size : k]
            if k < len(seq):
                got += held[k] - held[k - size]
                miss += lost[k] - lost[k - size]

    def judge(self, text: str | None) -> tuple[str, str, float] | None:
        """(kind, exemplar, containment) of the best match, None for texts without residue and for null, empty and blank ones."""
        if not text or not text.strip():
            return None
        clean, slots = read(text)
        best: tuple[str, str, float] | None = None
        for s in slots:
            score = self.slot(s)
            if score >= self.slot_containment and score > (best[2] if best else 0.0):
                best = ("slot", s[0][1:], score)
        lines = [p for p in _FURNITURE.sub("\n", clean).split("\n") if p.strip()]
        bodies = [terms(p) for p in lines] if any(len(p) < 60 for p in lines) else []
        for own in [*bodies, [t for b in bodies for t in b]]:
            x = self.short.get(frozenset(own))
            if x and (best is None or best[2] < 1.0):
                best = (x.kind, x.text, 1.0)
        run = (frozenset(), 0)
        for p in _PASSAGE.split(clean):
            seq = terms(p)
            if not seq:
                continue
            # a few words over and over are one term each: what counts is that nothing else comes between
            own = frozenset(seq)
            run = (own, run[1] + len(seq) if own == run[0] else len(seq))
            x = self.short.get(own) if run[1] >= max(3, 2 * len(own)) else None
            if x and (best is None or best[2] < 1.0):
                best = (x.kind, x.text, 1.0)
            if len(seq) >= 4:
                for w in self.windows(seq):
                    score, n = self.passage(w)
                    if score >= self.containment and score > (best[2] if best else 0.0):
                        best = (self.known[n].kind, self.known[n].text, score)
        return best


#: share of the documents from which on a word is common
COMMON = 0.02
_SPLIT = r"[^\p{L}\p{N}]+"


def term_frequencies(docs: DataFrame, text: str, known: list[Exemplar]) -> tuple[dict[str, int], int]:
    """In how many documents each exemplar term, each notation of a slot and each common word occurs, and how many documents there are.

    Counted on the JVM over all whole texts as they are, markup and code included; a stem's number is the sum over its words. Common is what ``COMMON`` of the documents hold, so the
    collected result has at most the mean number of words over ``COMMON`` rows beside the exemplars' terms, whatever the corpus.
    """
    vocabulary = sorted({t for x in known for t in x.terms if t[:1] != "\x00"})
    # a notation's mark is looked for first, which is far cheaper than its pattern
    shapes = [F.when(F.col("text").contains(_MARKS.get(k, k[: (len(k) + 1) // 2])) & F.col("text").rlike(p), F.lit("\x00" + k)) for k, p in SHAPES.items()]
    source = docs.select(F.col(text).cast("string").alias("text")).filter("text is not null")
    documents = source.count()
    # words are counted first and stemmed then: there are far fewer of them than places where they stand
    spelled = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"\d+", "0"), _SPLIT))
    words = source.select(F.explode(F.concat(spelled, F.array_compact(F.array(*shapes)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    cut_ = F.when(F.col("w").startswith("\x00"), F.col("w")).otherwise(F.substring(F.regexp_replace("w", r"(?<=..[^s])s$", ""), 1, 6))
    found = words.groupBy(cut_.alias("term")).agg(F.sum("n").alias("n"))
    kept = found.filter((F.col("n") >= COMMON * documents) | F.col("term").isin(vocabulary) | F.col("term").startswith("\x00"))
    return {r["term"]: r["n"] for r in kept.collect()}, documents


def detect_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: list[Exemplar] | None = None) -> DataFrame:
    """(doc_id, kind, exemplar, containment) of every document row that holds residue, wholly or in one place.

    Two passes over the texts: document frequencies, then the passages of every text. Nothing but the frequencies is
    shuffled. Null, empty and blank texts, and an empty table, give no row; ties go to the exemplar listed first;
    repeated rows are judged alike.
    """
    known = exemplars() if known is None else known
    frequency, documents = term_frequencies(docs, text, known)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ResidueIndex(known, frequency, documents)
        for batch in batches:
            out = [(d, *found) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (found := index.judge(t))]
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "kind", "exemplar", "containment"])

    return source.mapInArrow(run, "doc_id bigint, kind string, exemplar string, containment double")


def without_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no residue."""
    return docs.join(detect_residue(docs, doc_id, text).select(F.col("doc_id").alias(doc_id)), doc_id, "left_anti")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return detect_residue(table(spark, folder, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Residue per kind and exemplar."""
    return detect_residue(table(spark, folder, "documents")).groupBy("kind", "exemplar").agg(F.count("*").alias("docs"))


QUERIES = {"p10_found": p10_found, "p10_kinds": p10_kinds}
ORACLE_SQL: dict[str, str] = {}
