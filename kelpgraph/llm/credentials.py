"""Credentials embedded in source code: found and redacted by a linear-chain CRF.

Texts are cut into lexical tokens, a whole batch of texts at a time; each token
gets shape features (character classes, length, known forms) and context
features (the name it is assigned to, the words before it, its place in a call,
address or string, words of a comment). The features are columns of numbers
over all tokens of the batch, so that a token costs a few array operations. A
CRF labels the tokens of each line O, B or I; its Viterbi spans are the literal
characters to redact, and nothing else is changed. Lines of which no token can
outweigh O whatever the transitions are O throughout and skip Viterbi: a proven
bound, not a gate. The CRF is trained here, on ``TRAINING_LINES`` labelled lines
that a seeded generator makes up (``credential_lines``).

Every line of any length is labelled as one sequence. The BEGIN line of a
private key is a Viterbi span that is drawn out to the END mark; what follows
that on its line is labelled like anything else.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgraph.llm.credential_lines import credential_lines
from kelpgraph.llm.crf import Crf, train

O, B, I = 0, 1, 2
TRAINING_LINES = 24_000
KNOWN = 200_000
#: Characters of texts that are labelled together; a longer text is a batch of its own.
TOGETHER = 1 << 17
MASK = "[REDACTED]"

# Words of names that hold credentials, in several languages.
SECRET_WORDS = frozenset(
    "pass password passwd passwords pwd pw passphrase passcode passwort kennwort clave contrasena contrasenya senha motdepasse mdp secret secrets token tok tokens key keys apikey auth authorization bearer credential credentials cred creds pin accesskey secretkey authtoken secretaccesskey privatekey login signing".split()
)
STRONG_WORDS = frozenset("pass password passwd pwd pw passphrase passcode passwort kennwort clave contrasena senha mdp motdepasse secret token tok apikey bearer credential cred creds authtoken accesskey secretkey secretaccesskey rootpw dbpass userpass".split())
#: Words of names that hold something else although they look like it.
OTHER_WORDS = frozenset(
    "hash hashed hashes digest checksum sum md5 sha sha1 sha256 sha512 commit rev revision integrity fingerprint label column field limit max min length len count id ids uuid guid public pub shape template example sample hint prompt name title icon image img logo version build etag nonce salt ref file path dir type kind state opcode placeholder message msg error text help ttl expiry expires policy rule regex pattern format env var variable size index number primary foreign tree parent".split()
)
FETCH_WORDS = frozenset("getenv environ env load_secret loadsecret get_secret getsecret vault secretmanager environment getenvironmentvariable process config settings read_secret fetch_secret lookup resolve keyring os param ssm input getpass".split())
NOTE_WORDS = frozenset("key token secret password credential prod production sign signs requests commit api billing rotation temporary login".split())
LEADS = "basic bearer password login key u token secret passphrase digest commit checkout revert in see change is was pw pwd user pem-private pem-other".split()
DIALS = frozenset("connect login authenticate auth open dial signin sign_in logon".split())
LINK_WORDS = frozenset("the a an is are was in of for and to by from at this that must be has have not until before after when if it as your you please enter can will should or no with only".split())
TYPES = frozenset("string str String number int64 bool Optional &str".split())
PLACEHOLDERS = re.compile(
    r"^(?:<[^>]*>?|\{[^}]*\}|\$\{.*|\{\{.*|%[sdv]|%\(\w+\)s?|\$\w+|\*{3,}|x{3,}|X{3,}|\.{3,}|-+|_+|•+|\#+|none|null|nil|undefined|true|false|empty|unset|n/?a|todo|tbd|fixme|test|dummy|example|sample|secret|password|passwd|pass|pwd|token|user|admin|root|string"
    r"|(?:your|my|insert|enter|replace|change|put|add|use|set|the|some|a|fake|dummy|example|sample|test|redacted|masked|hidden|placeholder|removed|changeme)[-_ ](?:.*[-_ ])?(?:key|token|secret|password|passwd|pass|here|me|it|this|value|placeholder|credential|credentials|redacted)?(?:[-_ ]?here)?|\[?redacted\]?|changeme|xxxx.*|your.*|insert.*here|replace.*me)$",
    re.I,
)
_D = r"""\s"'`,;(){}\[\]<>"""
_BODY = r"(?!-----BEGIN)(?![^\s{q}]*://)(?!\w+=[^\s{q};]*;)(?:[^\s{q}\\]|\\.)++{q}"
#: Tokens tile the text. In order: line end, blanks, word before a delimiter (told first, as most are; the later rules would say the same), key mark, address, quoted text without blanks, value after : or =, name before them, runs that are no name, number, name, sign.
LEX = re.compile(
    rf"""\n|[^\S\n]+|[^\W\d]\w*+(?=[{_D}])|-----(?:BEGIN|END)[ A-Z0-9]*-----|[A-Za-z][\w+.\-]*://(?:[^\s:/@"'`<>]*:[^\s/"'`]*@)?[^{_D}]*+"""
    rf"""|"{_BODY.format(q='"')}|`{_BODY.format(q='`')}|(?<![A-Za-z0-9]{{2}})'{_BODY.format(q="'")}"""
    rf"""|(?<=[=:])(?<!::)(?<!==)(?![A-Z][A-Z_]{{2,}}=)[^{_D}=:/][^{_D}]*+(?![(\[{{])|[A-Za-z_$][\w$.\-]*+(?=(?::=|[=:])(?![=/:]))"""
    rf"""|(?<![^\s=:"'`>])(?![A-Za-z_$][\w$.\-]*+(?![^{_D}]))[^{_D}]{{6,}}+(?![(\[{{])|[A-Za-z0-9+/_\-.~]{{12,}}+={{0,2}}+(?![^{_D}]|[(\[])"""
    rf"""|\d[\w.]*+|[^\W\d][\w$]*+|:=|=>|==|!=|->|::|.""",
)
_USERINFO = re.compile(r"([A-Za-z][\w+.\-]*://)([^\s:/@\"'`<>]*)(:)([^\s/\"'`]*)(@)")
_PARAMETER = re.compile(r"([?&])([\w.\-]+)(=)([^&\s#]+)")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
MARK = re.compile(r">>>|<<<")
_KEY_END = re.compile(r"-----END[ A-Z0-9]*-----")


def _parts(name: str) -> list[str]:
    return [p.lower() for p in PART.findall(name)]


@lru_cache(maxsize=1 << 15)
def _name_class(name: str) -> str:
    """What a name says it holds; its last word counts most."""
    parts = [p for p in _parts(name) if not p.isdigit()]
    joined = "".join(parts)
    last = parts[-1] if parts else ""
    strong = any(p in STRONG_WORDS for p in parts) or joined in STRONG_WORDS
    secret = strong or any(p in SECRET_WORDS for p in parts) or joined in SECRET_WORDS
    if last in OTHER_WORDS or parts[:1] == ["primary"] or parts[:1] == ["foreign"]:
        return "other+" if secret else "other"
    if parts[:1] == ["env"] and secret:
        return "fetch"
    return "strong" if last in STRONG_WORDS or joined in STRONG_WORDS else "secret" if last in SECRET_WORDS or joined in SECRET_WORDS else "inner" if secret else "plain"


def _spread(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def _form(text: str) -> str:
    """The kind of literal a text looks like."""
    n = len(text)
    if PLACEHOLDERS.match(text):
        return "placeholder"
    if text in LINK_WORDS:
        return "link"
    if re.fullmatch(r"-?\d[\d_.]*[uUlLfF]*|0[xX][\da-fA-F]+", text):
        return "number"
    if re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", text, re.I):
        return "uuid"
    if re.fullmatch(r"(?:[0-9a-f]{2}:){5,}[0-9a-f]{2}", text, re.I):
        return "fingerprint"
    if re.match(r"(?:sha\d+|md5|blake\w+|pbkdf2\w*|bcrypt|scrypt|argon2\w*)[:\-$]|\$2[aby]\$|\$argon|\$[156]\$", text):
        return "digest"
    if text.startswith(("data:", "image/")):
        return "data"
    if re.match(r"(?:AKIA|ASIA)[A-Z0-9]{12,}$|gh[pousr]_\w{16,}|xox[abpors]-[\w-]{8,}|eyJ[\w-]{6,}\.[\w-]+|sk[-_](?:live|test|proj)?[-_]?\w{12,}|AIza[\w-]{20,}|glpat-[\w-]{10,}|npm_\w{20,}|SG\.[\w-]+\.[\w-]+", text):
        return "vendor"
    if re.match(r"[a-z]{2,6}_[a-z]{2,6}_[A-Za-z0-9]{14,}$", text) and (re.search(r"\d", text) or re.search(r"[a-z][A-Z].*[a-z][A-Z]", text)):
        return "vendor"
    if re.fullmatch(r"[0-9a-f]+", text) and n >= 6 and re.search(r"\d", text):
        return f"hex{n}" if n in (32, 40, 48, 64, 128) else "hex-long" if n >= 16 else "hex-short"
    if re.fullmatch(r"[0-9a-f]{6,12}:[A-Za-z0-9]{12,}", text):
        return "pair"
    if re.fullmatch(r"[A-Za-z]+(?:[-_.][A-Za-z]+){1,}\d+", text):
        return "phrase"
    if re.fullmatch(r"[A-Z]?[a-z]+(?:[-_][a-z]+)?[-_]?\d{1,3}", text):
        return "numbered"
    if re.fullmatch(r"[A-Za-z]+\d{2,}[^\w\s]+", text):
        return "word-number-mark"
    if re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)*", text) or len(PART.findall(text)) * 4 < n and re.fullmatch(r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*", text):
        return "words"
    if re.fullmatch(r"[A-Z]+(?:_[A-Z0-9]+)*", text):
        return "capitals"
    if re.fullmatch(r"[\w.\-]+(?:/[\w.\-]+)+", text) and not re.search(r"\d.*[A-Z]|[A-Z].*\d", text):
        return "path"
    if re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", text) and _spread(text) < 3.9:
        return "dotted"
    if re.fullmatch(r"\W+", text):
        return "signs"
    if n >= 16 and _spread(text) >= 3.5 and len(PART.findall(text)) * 3 > n:
        return "mixed-long"
    kinds = sum(bool(re.search(p, text)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    spread = _spread(text)
    if n >= 8 and kinds >= 3 and spread >= 2.7:
        return "mixed-long" if n >= 20 else "mixed"
    if n >= 8 and kinds >= 2 and re.search(r"\d", text) and spread >= 2.5:
        return "half-long" if n >= 20 else "half"
    if n >= 6 and kinds >= 3:
        return "mixed-short"
    return "short" if n < 6 else "letters" if text.isalpha() else "rest"


FORMS = "mark sign placeholder link number uuid fingerprint digest data vendor hex32 hex40 hex48 hex64 hex128 hex-long hex-short pair phrase numbered word-number-mark words capitals path dotted signs mixed-long mixed half-long half mixed-short short letters rest pem-private pem-other url user".split()
CLASSES = "none plain inner secret strong other other+ fetch".split()
MARKS = "~ ( ) [ ] { } < > = : , ; . + - * / # @ $ & | ! ? % \" ' ` := => == -> ^ \\".split()
#: Columns of what a token's text alone says.
FORM, WHERE, CLASS, SAID, LEAD, NAME, QUOTE, OP, LINE, BLANK, FETCH, DIAL, NOTE, LINK, SIGN, SKIP, SIZE, COMMENT, TYPE = range(19)


def _static(token: str) -> tuple[int, ...]:
    """The columns of one token text. A first character \\x01 marks the password of an address, \\x02 its user."""
    out = [0] * 19
    role = token[0]
    body = token[1:] if role in "\x01\x02" else token
    lower = body.lower()
    quoted = len(token) > 2 and role in "\"'`" and token[-1] == role
    if quoted:
        body = body[1:-1]
        lower = lower[1:-1]
    name = not quoted and bool(re.match(r"[^\W\d]|\$\w", body)) and role not in "\x01\x02" and "://" not in body
    plain_name = name and bool(re.fullmatch(r"[\w$.\-]+", body))
    if token == "\n":
        out[LINE] = 1
    out[BLANK] = int(token.isspace())
    if body.startswith("-----"):
        form = "pem-private" if "BEGIN" in body and "PRIVATE KEY" in body else "pem-other"
    elif role == "\x02":
        form = "user"
    elif "://" in body:
        form = "url"
    elif len(body) <= 2 and not body[:1].isalnum():
        form = "sign"
    else:
        form = _form(body) if len(body) > 1 else "mark"
    out[FORM] = FORMS.index(form)
    if form.startswith("pem"):
        lower = form
    out[WHERE] = 1 if quoted else 2 if role == "\x01" else 3 if plain_name and not out[BLANK] else 4 if form == "number" else 5 if form in ("sign", "mark") else 6
    out[CLASS] = CLASSES.index(_name_class(body)) if plain_name or quoted else 0
    parts = _parts(body)
    out[SAID] = int(any(p in SECRET_WORDS for p in parts) or lower in SECRET_WORDS)
    out[LEAD] = LEADS.index(lower) + 1 if lower in LEADS else 0
    out[NAME] = int(plain_name)
    out[QUOTE] = 1 + "\"'`".index(token) if token in ("\"", "'", "`") else 0
    out[OP] = int(token in ("=", ":", ":=", "=>"))
    out[FETCH] = int(name and (lower in FETCH_WORDS or any(p in FETCH_WORDS for p in parts)))
    out[DIAL] = int(name and (lower in DIALS or lower.rsplit(".", 1)[-1] in DIALS))
    out[NOTE] = int(any(p in NOTE_WORDS for p in parts))
    out[LINK] = int(lower in LINK_WORDS)
    out[SIGN] = MARKS.index(token) if token in MARKS else 0
    out[SKIP] = int(token in ("\"", "'", "`", ")", "]", ":", "*", "=", ":=", "=>"))
    out[SIZE] = min(len(body), 63)
    out[COMMENT] = int(token in ("#", "--", "/*", "*") or body.startswith(("//", "#", "/*")))
    out[TYPE] = int(token in TYPES)
    return tuple(out)


class _Codes(dict):
    """Numbers of token texts, and their static columns; forgets all when it is full."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, ...]] = []
        self.table = np.zeros((19, 0), dtype="i4")

    def __missing__(self, token: str) -> int:
        self[token] = code = len(self.rows)
        self.rows.append(_static(token))
        return code

    def columns(self) -> np.ndarray:
        """(columns, texts) of all texts known."""
        known = self.table.shape[1]
        if known < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[known:], dtype="i4").reshape(-1, 19).T], axis=1)
        return self.table

    def tidy(self) -> None:
        if len(self.rows) > KNOWN:
            self.clear()
            self.rows, self.table = [], np.zeros((19, 0), dtype="i4")


def _lexed(text: str) -> tuple[list[str], list[int] | None]:
    """Tokens that tile the text; addresses with a password or parameters in parts, then lengths are given too."""
    tokens = LEX.findall(text)
    if "://" not in text:
        return tokens, None
    out: list[str] = []
    lengths: list[int] = []

    def put(token: str, role: str = "") -> None:
        if token:
            out.append(role + token)
            lengths.append(len(token))

    for token in tokens:
        if "://" not in token or len(token) > 2 and token[0] in "\"'`":
            put(token)
            continue
        m = _USERINFO.match(token)
        if m:
            for i, role in ((1, ""), (2, "\x02"), (3, ""), (4, "\x01"), (5, "")):
                put(m.group(i), role)
            token = token[m.end() :]
        at = 0
        for m in _PARAMETER.finditer(token):
            put(token[at : m.start()])
            for i in (1, 2, 3, 4):
                put(m.group(i))
            at = m.end()
        put(token[at:])
    return out, lengths


def _radix(*columns: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    total, size = columns[0][0].astype("i4"), columns[0][1]
    for values, n in columns[1:]:
        total = total * n + values
        size *= n
    return total, size


class Tokens:
    """The tokens of a batch of texts as columns: places, lines, and the numbers of their features."""

    def __init__(self, texts: list[str], codes: _Codes):
        names: list[str] = []
        lengths: list[int] = []
        for text in texts:
            part, sizes = _lexed(text)
            names += part
            lengths += sizes if sizes is not None else map(len, part)
            names.append("\n")  # texts end lines; this one has no place
            lengths.append(0)
        code = np.fromiter(map(codes.__getitem__, names), "i8", len(names))
        table = codes.columns()
        lengths = np.array(lengths, dtype="i8")
        ends = np.cumsum(lengths)
        breaks = table[LINE][code]
        line = np.cumsum(breaks) - breaks
        keep = np.nonzero(table[BLANK][code] == 0)[0]
        self.start, self.end, self.line = (ends - lengths)[keep], ends[keep], line[keep]
        self.static = s = table[:, code[keep]]
        quoted = s[WHERE] == 1
        self.start, self.end = self.start + quoted, self.end - quoted
        n = len(keep)
        self.first = np.nonzero(np.append(True, self.line[1:] != self.line[:-1]))[0] if n else np.zeros(0, "i8")
        self.ids, self.features = self._numbers(keep)

    def _numbers(self, keep: np.ndarray) -> tuple[np.ndarray, int]:
        s, n = self.static, len(keep)
        at = np.arange(n)
        begin = np.zeros(n, "i8")
        begin[self.first] = self.first
        begin = np.maximum.accumulate(begin) if n else begin
        no = np.cumsum(np.isin(at, self.first)) - 1
        lines = len(self.first)

        def last(mask: np.ndarray, shift: int = 1) -> np.ndarray:
            """The last place of the mask before each token on its line, or -1."""
            seen = np.maximum.accumulate(np.where(mask, at, -1)) if n else at
            if shift:
                seen = np.append(-1, seen[:-1])[:n] if n else seen
            return np.where(seen >= begin, seen, -1)

        def back(k: int) -> np.ndarray:
            return np.where(at - k >= begin, at - k, -1)

        def pick(values: np.ndarray, places: np.ndarray, default: int) -> np.ndarray:
            return np.where(places >= 0, values[places], default) if n else values

        in_line = lambda mask: (np.bincount(no, mask, lines) > 0)[no] if n else mask.astype(bool)
        form, where, cls, sign = s[FORM], s[WHERE], s[CLASS], s[SIGN]
        before = back(1)
        typed = (s[TYPE] == 1) & (pick(sign, before, 0) == MARKS.index(":"))
        named = last((s[SKIP] == 0) & ~typed)
        quoted = where == 1
        said_before = last(quoted)
        name_ok = (named >= 0) & ((pick(s[NAME], named, 0) == 1) | (pick(where, named, 0) == 1))
        op = (s[OP] == 1) & name_ok
        value_word = pick(s[SIZE], named, 0) == 5
        key_of = pick(cls, named, 0)
        # of <entry key="..." value="...">: the value goes by the text quoted before
        generic = op & value_word & (key_of == CLASSES.index("plain")) & (said_before >= 0) & (said_before < named)
        key_of = np.where(generic, pick(cls, said_before, 1), key_of)
        comma = sign == MARKS.index(",")
        event = last(op | comma)
        key = np.where(event >= 0, np.where(pick(comma, event, False), 1, pick(key_of, event, 0)), 0)
        close_name = last(op)
        has_op = close_name >= 0
        word = last((s[QUOTE] == 0) & (s[OP] == 0))
        last_class = np.where(word < 0, 8, np.where(pick(s[NAME], word, 0) == 1, pick(cls, word, 0), 9))
        lead_at = last(s[LEAD] > 0)
        lead = np.where((lead_at >= 0) & (at - lead_at <= 5), pick(s[LEAD], lead_at, 0), 0)
        said_at = last(s[SAID] == 1)
        said = ((said_at >= 0) & (at - said_at <= 6)).astype("i4")
        following = np.append(at[1:], -1)[:n]
        following = np.where((following >= 0) & np.isin(following, self.first, invert=True), following, -1)
        after = pick(sign, following, MARKS.index("^"))
        prev = pick(sign, before, MARKS.index("^"))
        called = np.isin(after, [MARKS.index(x) for x in "([."])
        fetched = in_line((s[FETCH] == 1) & called)
        dial_at = last((s[DIAL] == 1) & (after == MARKS.index("(")))
        dial = (dial_at >= 0).astype("i4")
        strings = np.cumsum(quoted) - quoted
        strings = np.minimum(strings - pick(strings, begin, 0), 4)
        opened = (s[COMMENT] == 1) & ((sign != MARKS.index("*")) | (at == begin)) | (sign == MARKS.index("/")) & (pick(sign, following, 0) == MARKS.index("/"))
        comment = (last(opened) >= 0).astype("i4")
        noted = in_line((s[NOTE] == 1) & (comment == 1))
        context = np.where(fetched, 1, np.where(noted, 2, 0))
        plus = (pick(sign, before, 0) == MARKS.index("+")) | (pick(sign, back(2), 0) == MARKS.index("+"))
        size = s[SIZE]
        glued = np.append(False, keep[1:] == keep[:-1] + 1)[:n].astype("i4")
        # strings of several words: the quote that is open, whether it is the value of a name, how many words, link words among them
        phrase = np.zeros(n, "i4")
        inside = np.zeros(n, bool)
        for q in (1, 2, 3):
            mine = s[QUOTE] == q
            if not mine.any():
                continue
            count = np.cumsum(mine)
            odd = (count - pick(count - mine, begin, 0)) % 2 == 1
            opener = last(mine, 0)
            within = odd & ~mine & (opener >= 0)
            words = np.bincount(opener[within], minlength=n + 1)
            links = np.bincount(opener[within], s[LINK][within], minlength=n + 1)
            valued = pick(s[OP], pick(before, opener, -1), 0)
            many = np.minimum(words[opener], 7) // 2
            phrase = np.where(within, 1 + valued * 8 + many * 2 + (links[opener] > 0), phrase)
            inside |= within
        f, w, k = (form, len(FORMS)), (where, 8), (key, len(CLASSES))
        c, l, d, y = (context, 3), (last_class, 10), (lead, len(LEADS) + 1), (said, 2)
        p, x, z, h = (prev, len(MARKS)), (after, len(MARKS)), (size // 4, 16), (phrase, 18)
        before_form = (pick(form, word, len(FORMS)), len(FORMS) + 1)
        templates = [
            (np.zeros(n, "i4"), 1), f, w, _radix(f, w), _radix(f, k), _radix(f, k, w), _radix(f, c), _radix(f, k, c), _radix(f, l), _radix(f, d), _radix(d, w), _radix(f, y), _radix(f, y, w), _radix(f, z),
            _radix((dial, 2), (strings, 5), w), _radix((dial, 2), (strings, 5), f), x, p, _radix(f, p), _radix(f, x), _radix(f, (plus.astype("i4"), 2), k), (fetched.astype("i4"), 2),
            _radix(f, (comment, 2)), _radix(f, (comment, 2), d), _radix(f, h), _radix(k, h), _radix(f, k, h), _radix(f, before_form), _radix(f, k, z), _radix(f, (glued, 2), p), _radix(f, (has_op.astype("i4"), 2), y),
        ]
        out = np.zeros((len(templates), n), dtype="i4")
        base = 0
        for i, (values, count) in enumerate(templates):
            out[i] = values + base
            base += count
        return out, base


def label_lines(lines: list[tuple[str, list[tuple[int, int]]]]) -> tuple[Tokens, np.ndarray]:
    """Tokens of labelled lines and their labels."""
    tokens = Tokens([line for line, _ in lines], _Codes())
    labels = np.zeros(len(tokens.start), dtype="i8")
    at = 0
    for line, spans in lines:
        for a, b in spans:
            hit = np.nonzero((tokens.start < at + b) & (tokens.end > at + a))[0] if spans else []
            labels[hit] = I
            labels[hit[:1]] = B
        at += len(line)
    return tokens, labels


@lru_cache(maxsize=2)
def trained(lines: int = TRAINING_LINES, seed: int = 3) -> Crf:
    """The CRF, trained once per driver process on made-up lines."""
    tokens, gold = label_lines(credential_lines(lines, seed))
    return train(tokens.ids, tokens.first, gold, tokens.features, 3)


class CredentialFinder:
    """Spans of credentials in texts: Viterbi over the lines that may hold one."""

    def __init__(self, model: Crf):
        self.model, self.most, self.codes = model, model.reach(), _Codes()

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of each credential of each text; a private key is one span, to its END mark."""
        self.codes.tidy()
        tokens = Tokens(texts, self.codes)
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(tokens.start):
            return found
        scores = self.model.scores(tokens.ids)
        maybe = scores.max(axis=1) + self.most >= 0
        stops = np.append(tokens.first[1:], len(tokens.start))
        open_lines = np.nonzero(np.logical_or.reduceat(maybe, tokens.first))[0]
        labels = self.model.viterbi(scores, tokens.first[open_lines], stops[open_lines])
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for i in np.nonzero(labels)[0]:
            owner = int(np.searchsorted(offsets, tokens.start[i], side="right")) - 1
            start, end = int(tokens.start[i] - offsets[owner]), int(tokens.end[i] - offsets[owner])
            out = found[owner]
            if labels[i] == I and labels[i - 1] != O and tokens.line[i - 1] == tokens.line[i] and out and start - out[-1][1] <= 1:
                out[-1] = (out[-1][0], end)
            elif tokens.static[SIZE, i] > 1:
                out.append((start, end))
        return [self._whole(text, spans) if spans else spans for text, spans in zip(texts, found)]

    @staticmethod
    def _whole(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Draws BEGIN marks out to the END of their key; spans inside a key are part of it."""
        out: list[tuple[int, int]] = []
        for a, b in spans:
            if out and a < out[-1][1]:
                continue
            if text.startswith("-----BEGIN", a):
                stop = _KEY_END.search(text, b)
                b = stop.end() if stop else len(text)
            out.append((a, b))
        return out


def without_marks(snippet: str) -> tuple[str, list[int]]:
    """The snippet without ``>>>`` and ``<<<``, and the place of each of its characters in the snippet."""
    places: list[int] = []
    at = 0
    for m in MARK.finditer(snippet):
        places.extend(range(at, m.start()))
        at = m.end()
    places.extend(range(at, len(snippet)))
    return "".join(snippet[i] for i in places) if len(places) < len(snippet) else snippet, places


def redact(text: str, spans: list[tuple[int, int]], mask: str = MASK) -> str:
    """The text with each span replaced by the mask; line ends inside a span stay, and so do a snippet's marks."""
    out, at = [], 0
    for a, b in spans:
        kept = "".join(re.findall(r"\r?\n|\\n|>>>|<<<", text[a:b]))
        out += [text[at:a], mask, kept]
        at = b
    return "".join([*out, text[at:]])


def find_in_texts(finder: CredentialFinder, texts: list[str], marked: list[bool]) -> list[list[tuple[int, int]]]:
    """Spans of each text; the marks of snippets are looked through."""
    bare = [without_marks(t) if m and MARK.search(t) else (t, None) for t, m in zip(texts, marked)]
    out: list[list[tuple[int, int]]] = []
    at = 0
    while at < len(bare):
        stop, size = at, 0
        while stop < len(bare) and (stop == at or size + len(bare[stop][0]) <= TOGETHER):
            size += len(bare[stop][0])
            stop += 1
        out += finder.spans([t for t, _ in bare[at:stop]])
        at = stop
    return [spans if places is None else [(places[a], places[b - 1] + 1) for a, b in spans] for spans, (_, places) in zip(out, bare)]


def credential_items(embeddings: DataFrame, hits: DataFrame) -> DataFrame:
    """(src, row_id, text) of all chunks and snippets; rows with a null id have no name and leave."""
    chunks = embeddings.where("id is not null").select(F.lit("chunk").alias("src"), F.col("id").cast("long").alias("row_id"), F.col("chunk_text").alias("text"))
    snippets = hits.where("hit_id is not null and snippet is not null").select(F.lit("snippet").alias("src"), F.col("hit_id").cast("long").alias("row_id"), F.col("snippet").alias("text"))
    return chunks.unionByName(snippets)


def find_credentials(items: DataFrame, model: Crf | None = None) -> DataFrame:
    """(src, row_id, lines array<int>, redacted): the items that hold credentials.

    Null and empty texts hold none; repeated rows give equal rows. Everything
    but the credentials' characters comes back unchanged.
    """
    shared = items.sparkSession.sparkContext.broadcast(model or trained())  # features x 3 floats, a number fixed by the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = CredentialFinder(shared.value)
        for batch in batches:
            filled = batch.filter(pa.compute.greater(pa.compute.utf8_length(batch.column(2)), 0))
            sources, ids, texts = (c.to_pylist() for c in filled.columns)
            out: list[tuple] = []
            for src, row_id, text, spans in zip(sources, ids, texts, find_in_texts(finder, texts, [s == "snippet" for s in sources])):
                if spans:
                    out.append((src, row_id, sorted({text.count("\n", 0, a) + 1 for a, _ in spans}), redact(text, spans)))
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["src", "row_id", "lines", "redacted"])

    return items.select("src", "row_id", "text").mapInArrow(run, "src string, row_id long, lines array<int>, redacted string")
