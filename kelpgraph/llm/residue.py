"""Template residue, filler, unfilled outlines and error pages in documents.

Labelled exemplars of residue stand in an inverted index: token to exemplars.
A document is cut into passages (lines; long lines into windows of words). A
passage retrieves the exemplars that share one of their rare tokens, and is a
match if it contains the exemplar (weight of shared tokens over the exemplar's
weight) and the exemplar explains the passage (shared weight over the passage's
weight). Weights are TF-IDF; the document frequencies of the exemplars'
vocabulary, which is bounded by the bundled list, are counted over all
documents. The vocabulary of filler is learnt from the corpus: words that stand
in many of the documents that hold well-known filler words, and hardly anywhere
else. A document is residue if matches make up most of its content
weight, headings and navigation lines left out. Unfilled placeholders are
slots with a shape of their own: outside code and quoting one is enough.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgraph.session import cut_lineage

# Labelled exemplars, one a line. X stands for any word or number.
ERRORS = """
404 not found
error 404 not found
page not found
the page you asked for could not be found
the page you are looking for does not exist
the requested url was not found on this server
no such page
error 404 not here return to the start page
not here
nothing was found at this address
gone
the document was moved or deleted
this page has been removed
this repository is empty or has been removed by its owner
this content is no longer available
403 forbidden
forbidden
access denied you do not have permission to view this resource
you do not have permission to access this page
access to this folder is not allowed
401 unauthorized
authorization required
authentication required please log in
you must be logged in to view this page
please sign in to continue
your session has expired please sign in again to see this page
session expired
this link has expired
your token has expired
500 internal server error
internal server error
internal error
something went wrong on our side incident
something went wrong please try again
an unexpected error has occurred
unhandled exception in X
application error a client side exception has occurred
400 bad request
bad request
malformed X
oops we can t find that page
oops the page can t be found
sorry this page isn t available
sorry we could not find what you were looking for
sorry the page you requested does not exist
this site can t be reached
this page isn t working
hmm we re having trouble finding that site
you don t have access to this page
you are not authorized to view this page
this account has been suspended
this video is unavailable
the content you requested is not available in your region
please log in to see this content
the invitation is no longer valid
an error occurred while processing your request
we re sorry but something went wrong
the server encountered an internal error and was unable to complete your request
405 method not allowed
method not allowed
408 request timeout
429 too many requests
too many requests
rate limit reached for X
rate limit exceeded
502 bad gateway
bad gateway
upstream sent no valid answer
upstream connect error or disconnect before headers reset reason X
503 service unavailable
service unavailable
the service is temporarily unavailable try again in X seconds
over capacity please try again later
over capacity
down for maintenance
we are down for maintenance and will be back soon
504 gateway timeout
gateway timeout
connection timed out
connection refused
request blocked by the gateway
if you think this is a mistake quote id
your request has been blocked
the database connection could not be established
error code message request
status detail id
http X
http error X
status code X
request failed with status code X
fatal could not read remote got status X for X
fatal unable to access the requested url returned error X
the requested url returned error X
could not resolve host X
connection reset by peer
seite nicht gefunden die angeforderte seite existiert nicht mehr
die angeforderte seite existiert nicht
zugriff verweigert
interner serverfehler
ihre sitzung ist abgelaufen bitte melden sie sich erneut an
página no encontrada volver al inicio
la página solicitada no existe
acceso denegado
error interno del servidor
su sesión ha caducado
page introuvable
la page demandée n existe pas
accès refusé
erreur X le serveur a rencontré un problème
erreur interne du serveur
votre session a expiré
ページが見つかりません
アクセスが拒否されました
サーバーエラーが発生しました
"""
SCRIPTS = """
please enable javascript to view this page
you need to enable javascript to run this app
javascript is disabled in your browser please enable it to continue
javascript is required
javascript must be enabled
this app works best with javascript enabled
we re sorry but this site doesn t work properly without javascript enabled please enable it to continue
you need cookies and javascript to use this site
this site requires scripts turn them on in your browser settings and reload
your browser does not run scripts so the X viewer cannot be shown
checking your browser before you go on scripts and cookies must be on
please turn on cookies and reload the page
verify that you are human
just a moment checking your browser
bitte aktivieren sie javascript um fortzufahren
javascript ist deaktiviert bitte aktivieren sie javascript
active javascript para continuar
habilite javascript para continuar
javascript est désactivé veuillez l activer pour afficher X
veuillez activer javascript pour continuer
javascriptを有効にしてください
続行するにはjavascriptを有効にしてください
"""
TAILS = """
go back to the home page
return to the start page
check the address and retry
please try again later
contact the administrator of this server
contact the administrator
ray X
trace X
reference X
incident X
request id X
nginx X
proxy X
"""
OUTLINE = """
tbd
tba
to be done
to be defined
to be written
coming soon
write here
n a
fill me
fill in
todo
describe your change
add your text here
your text here
text goes here
insert text here
explain how to X it
explain how to X
a short description of the X goes here
description goes here
replace this paragraph with your own words
replace this text
lorem ipsum
under construction
page under construction
section X
your content here
content goes here
to be added
not yet written
no description provided
work in progress
folgt
hier steht später der text
noch zu schreiben
wird noch ergänzt
lista pendiente de rellenar
pendiente de rellenar
por completar
à compléter
à venir
texte à venir
準備中
ここに説明を書く
"""
FILLER = """
some placeholder words that will be replaced later
paragraph X
sample text
placeholder text
dummy text
foo text
foo bar baz
bla bla
blah blah
asdf qwer
asdf asdf
text text text
test test test
the quick brown fox jumps over the lazy dog
"""
# Words of the customary pseudo-Latin filler, which no other text is full of.
LATIN = """
lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore aliqua veniam quis nostrud exercitation
ullamco laboris aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur excepteur
occaecat cupidatat proident culpa officia deserunt mollit laborum vestibulum habitant morbi tristique senectus netus malesuada fames
turpis egestas pellentesque tellus fermentum vulputate lacinia tincidunt sollicitudin bibendum ultrices posuere cubilia curae
phasellus suspendisse vivamus maecenas praesent curabitur mauris faucibus porttitor ullamcorper scelerisque
"""
#: A word is learnt as filler if it stands in this share of the documents with filler lines, and is theirs to this share.
SPREAD, OWN = 0.02, 0.8
NAVIGATION = re.compile(
    r"^(menu|search|about|home|docs|help|log ?in|sign ?in|sign ?up|imprint|skip to content|back to top|©.*|\(c\).*|copyright .*"
    r"|privacy\b.*terms.*|(home|start)\s*[|>/·].*|[\w ]{1,20}(\s*\|\s*[\w ]{1,20}){2,})$",
    re.I,
)
HEADING = re.compile(r"^\s{0,3}(#{1,6}\s.*|[=\-*_]{3,})$")
FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?^[ \t]*\1[`~]*[ \t]*$", re.S | re.M)
INLINE = re.compile(r"(`+)[^`\n]*(?:\n[^`\n]+)?\1")
#: Slots of template languages and of failed filling in.
SLOT = re.compile(
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|\{\$[\w.>-]{1,40}\}|\{%[^\n%]{1,60}%\}|<%[^\n]{1,60}?%>|<\?=[^\n]{1,60}?\?>"
    r"|%\(\w{1,40}\)[sdr]|\[\[[A-Z_][\w .:-]{0,40}\]\]|<[A-Z]{2,}[A-Z_ -]*>"
    r"|(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)|@@[A-Z][A-Z_]*@@|(?<![\w@])@[A-Z][A-Z_]*[A-Z]@"
    r"|(?<![\w%])%[A-Z][A-Z_]*[A-Z]%|\bX{3,}(?:-[A-Z]+-X{3,})?\b|\[object Object\]|(?<![\w/.:-])\{[a-z][a-z_.]*\}|(?<![\w/])\{\d\}|(?<![\w.'\"/-])(?:undefined|NaN)(?![\w'\"/(-])",
)
_TODO_SLOT = re.compile(r"\[(?:[A-Z][a-z]+ ){0,2}(?:Name|Address|Date|Email|Company|Title|Number|Amount|Phone|City|Street|Signature|Position|Link|Recipient|Sender|Product)\](?![(\[:])|\[(?:[Yy]our|YOUR|[Ii]nsert|INSERT|[Ee]nter|[Aa]dd|TODO|TBD|[Ff]ill|FILL|NAME|COMPANY|DATE|TITLE)\b[^\]\n]{0,50}\](?!\()|<(?:[Yy]our|[Ii]nsert|[Ee]nter)[ _-][\w -]{1,40}>")
QUOTED = re.compile(r"[\"“„«'‘](?=[^\"”“»'’\n]{0,80}$)")
#: Files of program code; markup and data files are told by their text.
CODE_PATH = re.compile(r"\.(py|js|mjs|cjs|jsx|ts|tsx|go|rs|java|rb|cs|php|c|h|cc|cpp|hpp|sh)$", re.I)
MARKUP_LINE = re.compile(r"^\s*(?:</?[a-zA-Z!?][^>]*>?.*|[\w-]+\s*:\s*[^\s].*;?|\"[^\"]*\"\s*:.*)$")
CODE_LINE = re.compile(r"^\s*(?:[{}\])]+[;,)]*|.*[;{]|(?:def|class|func|fn|end|import|from|use|package|require|return|elif|else|if|for|while)\b.*|[\w.]+\s*[+\-*/:]?=[^=].*|[#@/*].*|.*\)\s*|)$")
TOKEN = re.compile(r"[^\W\d_]+|\d+|_+", re.UNICODE)
#: Words between which a slot like ``undefined`` is a statement about code, not a leftover.
SAID = re.compile(r"\b(?:is|are|was|be|returns?|yields?|remains?|stays?|becomes?|left|value|values|of|or|as|behaviou?r|to be)\s+$", re.I)
WINDOW = 24
_TAGS = re.compile(r"</?[a-z][^>]*>|[{}\"]")
_STUB = re.compile(r"(?:\d+[.)]|[-*+])\s*(?:\[[ x]?\])?")
_SENTENCE_END = re.compile(r"(?<=[.!?。])\s+|(?<=。)")
_LETTERS = re.compile(r"[a-z]+")
_LETTERS_DIGITS = re.compile(r"[a-z]+|\d+")
_DIGIT = re.compile(r"\d")
_HEX_ID = re.compile(r"(?<!\w)(?=[0-9a-f]*\d)[0-9a-f]{6,}(?!\w)")


def words_of(text: str) -> list[str]:
    """Lower-case words; every number and hexadecimal id is one token."""
    text = text.lower()
    if text.isascii():
        if not _DIGIT.search(text):
            return _LETTERS.findall(text)
        return [t if t.isalpha() else "#" for t in _LETTERS_DIGITS.findall(_HEX_ID.sub("0", text))]
    out = []
    for m in re.finditer(r"(?=[0-9a-f]*\d)[0-9a-f]{6,}(?![\w])|\w+", text):
        w = m.group()
        if not w.isascii():
            out.extend(re.findall(r"[぀-ヿ一-鿿]{2}|[^\W\d_]+", w) if re.search(r"[぀-鿿]", w) else re.findall(r"[^\W_]+", w))
        elif w.isalpha():
            out.append(w)
        elif re.fullmatch(r"\d+|[0-9a-f]{6,}", w):
            out.append("#")
        else:
            out.extend(x if x.isalpha() else "#" for x in re.findall(r"[a-z]+|\d+", w))
    return out


@dataclass
class ResidueIndex:
    """Exemplars as weighted token bags, and the inverted index of their rare tokens."""

    weight: dict[str, float]
    default: float
    bags: list[dict[str, float]] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    postings: dict[str, list[int]] = field(default_factory=dict)
    latin: frozenset = frozenset()


def exemplars() -> list[tuple[str, list[str]]]:
    """(kind, tokens) of the bundled exemplars."""
    out = []
    for kind, block in (("error", ERRORS), ("scripts", SCRIPTS), ("tail", TAILS), ("outline", OUTLINE), ("filler", FILLER)):
        for line in block.strip().splitlines():
            tokens = [t for t in words_of(re.sub(r"\bX\b", " ", line))]
            if tokens:
                out.append((kind, tokens))
    return out


def vocabulary() -> list[str]:
    """All tokens of the exemplars; bounded by the bundled list."""
    return sorted({t for _, tokens in exemplars() for t in tokens} | set(LATIN.split()))


def build_index(frequency: dict[str, int], documents: int, learnt: frozenset[str] = frozenset()) -> ResidueIndex:
    """The index with weights ln(1 + (N + 1) / (df + 1)) from the frequencies of all ``documents``; ``learnt`` are further words of filler."""
    n = max(1, documents)

    def idf(token: str) -> float:
        return math.log(1 + (n + 1) / (frequency.get(token, 0) + 1))

    out = ResidueIndex({t: idf(t) for t in [*vocabulary(), *learnt]}, math.log(2 + math.sqrt(n)))
    out.weight["#"] = 0.5
    postings: dict[str, list[int]] = defaultdict(list)
    for number, (kind, tokens) in enumerate(exemplars()):
        bag = {t: out.weight[t] * c for t, c in Counter(tokens).items()}
        out.bags.append(bag)
        out.totals.append(sum(bag.values()))
        out.kinds.append(kind)
        covered = 0.0
        for t in sorted(bag, key=bag.get, reverse=True)[:3]:
            if t != "#" or len(bag) == 1:
                postings[t].append(number)
                covered += bag[t]
                if covered > 0.21 * out.totals[-1]:  # a passage with 0.8 of the weight has one of these
                    break
    out.postings = dict(postings)
    out.latin = frozenset(LATIN.split()) | learnt
    return out


def is_code(text: str, source: str | None, path: str | None) -> bool:
    """Source code: by the path's extension, or by source and the look of most lines."""
    if path and CODE_PATH.search(path):
        return True
    lines = [x for x in text.splitlines() if x.strip()]
    looks = sum(1 for x in lines if CODE_LINE.match(x)) / max(1, len(lines))
    return len(lines) >= 3 and looks > (0.6 if (source or "").strip().lower().replace("-", "_").replace(" ", "_") == "code_file" else 0.8)


def is_markup(text: str) -> bool:
    """A template, style sheet or data file: nearly all lines are markup."""
    lines = [x for x in text.splitlines() if x.strip()]
    return len(lines) >= 3 and sum(1 for x in lines if MARKUP_LINE.match(x)) > 0.9 * len(lines) and sum(1 for x in lines if x.lstrip()[:1] in "<\"{}") >= 0.5 * len(lines)


def open_slots(text: str) -> list[str]:
    """Unfilled slots in prose: outside fenced and inline code, quotes, paths and statements about code."""
    if "{" not in text and "<" not in text and "[" not in text and "%" not in text and "__" not in text and "@" not in text and "XXX" not in text and "undefined" not in text and "NaN" not in text:
        return []
    prose = INLINE.sub(" ", FENCE.sub("\n", text))
    out = []
    for pattern in (SLOT, _TODO_SLOT):
        for m in pattern.finditer(prose):
            line_start = prose.rfind("\n", 0, m.start()) + 1
            before = prose[line_start : m.start()]
            after = prose[m.end() : m.end() + 1]
            if before[-1:] in "\"'“‘«„" and before[-1:] and after and after in "\"'”’»“":
                continue
            if before.startswith(("    ", "\t")) and "\n" in prose[:line_start]:
                continue  # an indented code block
            if m.group() in ("undefined", "NaN") and SAID.search(before):
                continue
            if re.match(r"(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) ", before):
                continue  # a parameter of an address
            out.append(m.group())
    return out


def _passages(line: str) -> Iterable[list[str]]:
    for sentence in _SENTENCE_END.split(line):
        tokens = words_of(sentence)
        if tokens:
            yield tokens


def _matches(line: str, index: ResidueIndex) -> Iterable[tuple[str | None, float, float]]:
    """(kind or None, explained, weight) of the line as one passage if that matches, else of its sentences and windows.

    A sentence longer than a window is read in windows that overlap by half, so
    that no exemplar of half a window is cut by all; each word weighs once.
    """
    tokens = words_of(line)
    known = list(filter(index.weight.__contains__, tokens))
    if not _may_match(tokens, known, index):
        return [(None, 0.0, sum(map(index.weight.__getitem__, known)) + index.default * (len(tokens) - len(known)))]
    if 0 < len(tokens) <= 2 * WINDOW:
        kind, got, total = match_passage(tokens, index)
        if kind and got >= 0.6 * total:
            return [(kind, got, total)]
    out = []
    for part in _passages(line):
        if len(part) <= WINDOW:
            kind, got, total = match_passage(part, index)
            out.append((kind if kind and got >= 0.6 * total else None, got, total))
            continue
        kinds: list[str | None] = [None] * len(part)
        for at in range(0, len(part) - WINDOW // 2, WINDOW // 2):
            kind, got, total = match_passage(part[at : at + WINDOW], index)
            if kind and got >= 0.6 * total:
                kinds[at : at + WINDOW] = [kind] * len(kinds[at : at + WINDOW])
        for kind in set(kinds):
            weight = sum(index.weight.get(t, index.default) for t, k in zip(part, kinds) if k == kind)
            out.append((kind, weight, weight))
    return out


def _may_match(tokens: list[str], known: list[str], index: ResidueIndex) -> bool:
    """False only if no part of the tokens can match: each rule of ``match_passage`` that a part meets, the whole meets here."""
    bag = set(known)
    return (
        any(0.79 * index.totals[e] <= sum(w for t, w in index.bags[e].items() if t in bag) for e in {e for t in bag for e in index.postings.get(t, ())})
        or sum(map(index.latin.__contains__, known)) >= 3
        # at least 8 with at most 3 different ones: four of them that begin at a multiple of 4 hold one twice
        or len(tokens) >= 8 and len(set(tokens)) <= len(tokens) - 5 and any(len({*tokens[i : i + 4]}) < 4 for i in range(0, len(tokens) - 3, 4))
    )


def match_passage(tokens: list[str], index: ResidueIndex) -> tuple[str | None, float, float]:
    """(kind, explained weight, weight) of a passage; several exemplars may explain it together."""
    weigh = index.weight.get
    known = list(filter(index.weight.__contains__, tokens))
    total = sum(map(index.weight.__getitem__, known)) + index.default * (len(tokens) - len(known))
    latin = sum(map(index.latin.__contains__, known))
    if latin >= 3 and latin >= 0.7 * len(tokens):
        return "filler", total, total
    if len(tokens) >= 8 and len(set(tokens)) <= 3:
        return "filler", total, total
    candidates = {e for t in set(known) for e in index.postings.get(t, ())}
    if not candidates:
        return None, 0.0, total
    bag = Counter(tokens)
    explained: set[str] = set()
    kind, best = None, 0.0
    for e in candidates:
        ex = index.bags[e]
        shared = [t for t in ex if t in bag]
        got = sum(ex[t] for t in shared)
        if got >= 0.8 * index.totals[e]:
            explained.update(shared)
            if index.kinds[e] != "tail" and got > best:
                kind, best = index.kinds[e], got
            elif kind is None:
                kind = "tail"
    if not explained:
        return None, 0.0, total
    # a slot of an exemplar: up to one unknown word for each four explained ones, at least one
    rest = sorted((weigh(t, index.default) * n for t, n in bag.items() if t not in explained), reverse=True)
    allowed = max(1, len(explained) // 4)
    free = sum(rest[:allowed])
    known = sum(weigh(t, index.default) * bag[t] for t in explained)
    return kind, known, total - free


def judge(text: str | None, source: str | None, path: str | None, index: ResidueIndex) -> str | None:
    """The kind of residue a text is, or None."""
    if not text or not text.strip() or path and CODE_PATH.search(path):
        return None
    if open_slots(text):
        return None if is_code(text, source, path) or is_markup(text) else "placeholder"
    explained = weight = 0.0
    kinds: Counter = Counter()
    headings = stubs = 0
    for line in FENCE.sub("\n```\n", text).splitlines():
        bare = line.strip().strip("|").strip()
        if not bare or NAVIGATION.match(bare):
            continue
        if HEADING.match(line):
            headings += 1
            if not match_passage(words_of(bare), index)[0] == "error":
                continue
        if _STUB.fullmatch(bare):
            stubs += 1
            continue
        for kind, got, total in _matches(_TAGS.sub(" ", bare), index):
            if kind:
                kinds[kind] += total
                explained += total
            weight += total
    if weight == 0.0:
        found = "outline" if headings >= 1 and stubs >= 1 or headings >= 2 else None
    elif explained >= 0.6 * weight and kinds.keys() - {"tail"}:
        found = max(kinds.keys() - {"tail"}, key=kinds.get)
    else:
        found = None
    return found if found and not is_code(text, source, path) else None


def _words(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", text.lower()))


def _counted(documents: DataFrame, count) -> dict[str, int]:
    """The sums of ``count(text, counter)`` over all documents, added up in each task before they are shuffled; collected, so the keys must be bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count(text, seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    sums = cut_lineage(documents.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    filler = sums.where("token = '~'").first()
    # of the words of filler documents (marked ~) only those in a share of SPREAD of them: at most (their mean number of words) / SPREAD
    least = max(3, SPREAD * filler["n"]) if filler else 0
    return {r["token"]: r["n"] for r in sums.where(~F.startswith("token", F.lit("~")) | (F.col("n") >= least)).collect()}


def exemplar_frequencies(documents: DataFrame) -> tuple[dict[str, int], int, frozenset[str]]:
    """Document frequencies of the exemplars' tokens over all documents, the number of documents, and the learnt filler words.

    Candidates for filler are the words of lines with well-known filler words
    that stand in a share of ``SPREAD`` of such documents; learnt are those that
    stand in a document without a well-known one at most once in 1 / (1 - ``OWN``).
    The second pass, over the candidates, runs only where there are any.
    """
    known, seeds = frozenset(vocabulary()), frozenset(LATIN.split())

    def first(text: str | None, seen: Counter) -> None:
        seen[""] += 1
        if not text:
            return
        words = known.intersection(_words(text))
        seen.update(words)
        if not seeds.isdisjoint(words):
            lines = [words_of(line) for line in text.splitlines()]
            full = [line for line in lines if len(line) >= 6 and sum(map(seeds.__contains__, line)) >= max(2, 0.1 * len(line))]
            if full:
                seen["~"] += 1
                seen.update({"~" + w for line in full for w in line if len(w) > 3})

    found = _counted(documents, first)
    more = frozenset(t[1:] for t in found if t[:1] == "~") - seeds - {""}

    def second(text: str | None, seen: Counter) -> None:
        if text:
            words = _words(text)
            mine = more.intersection(words)
            if mine:
                seen.update(mine)
                if not seeds.isdisjoint(words):
                    seen.update(["+" + w for w in mine])

    again = _counted(documents, second) if more else {}
    learnt = frozenset(w for w in more if again.get("+" + w, 0) >= OWN * again.get(w, 0) > 0)
    frequency = {t: n for t, n in found.items() if t[:1] != "~"} | {w: again[w] for w in learnt}
    return frequency, frequency.pop("", 0), learnt


def find_residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that are residue; kind is placeholder, filler, outline, error or scripts.

    Each id of a repeated text counts. Null, empty and blank texts are no
    residue. source and file_path may be null; further columns are ignored.
    """
    index = build_index(*exemplar_frequencies(documents))
    shared = documents.sparkSession.sparkContext.broadcast(index)  # bounded by the bundled exemplars and the learnt words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sources, paths = (c.to_pylist() for c in batch.columns)
            kinds = [judge(t, s, p, shared.value) for t, s, p in zip(texts, sources, paths)]
            keep = [i for i, k in enumerate(kinds) if k]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([kinds[i] for i in keep], pa.string())], names=["doc_id", "kind"])

    return documents.select(F.col("doc_id").cast("long"), "text", "source", "file_path").mapInArrow(run, "doc_id long, kind string")
