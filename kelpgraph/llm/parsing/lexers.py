"""Lexers: source text to the terminal numbers of a grammar's tables.

One regular expression per language cuts a text into lexemes; their numbers are
looked up, and worked out only the first time a lexeme is seen. What is no
lexeme of the language gets the number ``BAD``, which no state accepts.
"""

from __future__ import annotations

import re

from kelpgraph.llm.parsing import grammars
from kelpgraph.llm.parsing.tables import Grammar, Recogniser, Tables, build

BAD = 511
MEMO = 300_000
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*+'"
_NUM = r"\.?\d(?:[eEpP][+-](?=\d)|[^\W]|\.(?!\.)(?![A-Za-z_]{2,}))*+"
_WORD = r"[^\W\d][\w$]*+"
_BLOCK = r"/\*[\s\S]*?\*/"
_SKIP_C = rf"(?:[ \t\r\n\f﻿]++|//[^\n]*+|{_BLOCK})*+"


def _signs(*signs: str) -> str:
    return "|".join(re.escape(s) for s in sorted(signs, key=len, reverse=True))


_C_SIGNS = _signs(*"... <<= >>= -> ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= + - * / % & | ^ ~ ! < > = ? : ; , . ( ) [ ] { }".split())
_JAVA_SIGNS = _signs(*">>>= <<= >>= ... -> :: ++ -- << <= >= == != && || += -= *= /= %= &= |= ^= + - * / % & | ^ ~ ! < > = ? : ; , . @ ( ) [ ] { }".split())
_GO_SIGNS = _signs(*"<<= >>= &^= ... := <- ++ -- << >> &^ <= >= == != && || += -= *= /= %= &= |= ^= + - * / % & | ^ ~ ! < > = : ; , . ( ) [ ] { }".split())
_RUST_SIGNS = _signs(*"<<= >>= ... ..= .. -> => :: << <= >= == != && || += -= *= /= %= &= |= ^= + - * / % & | ^ ! < > = ? : ; , . @ # $ ( ) [ ] { }".split())
_PY_SIGNS = _signs(*"**= //= >>= <<= ... := -> ** // << >> <= >= == != += -= *= /= %= @= &= |= ^= + - * / % @ & | ^ ~ < > = : , . ; ( ) [ ] { }".split())
_JS_SIGNS = _signs(*">>>= **= <<= >>= &&= ||= ??= === !== ... => ?. ?? ** ++ -- << <= >= == != && || += -= *= /= %= &= |= ^= + - * / % & | ^ ~ ! < > = ? : ; , . @ ( ) [ ] { }".split())
_CS_SIGNS = _signs(*"<<= >>= ??= => ?? ?. :: .. -> ++ -- << <= >= == != && || += -= *= /= %= &= |= ^= + - * / % & | ^ ~ ! < > = ? : ; , . ( ) [ ] { }".split())
_PHP_SIGNS = _signs(*"<=> **= <<= >>= ??= === !== ... ?-> #[ => -> :: ?? ** ++ -- << >> <= >= == != <> && || += -= *= /= .= %= &= |= ^= + - * / % & | ^ ~ ! < > = ? : ; , . @ $ ( ) [ ] { }".split())
_RB_SIGNS = _signs(*"**= <=> === ||= &&= <<= >>= ... .. :: => -> =~ !~ &. ** << >> <= >= == != && || += -= *= /= %= |= &= ^= + - * / % & | ^ ~ ! < > = ? : , . ; ( ) [ ] { }".split())
_INT = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*)"
_FLOAT = r"(?:(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?|\d[\d_]*\.(?:[eE][+-]?\d[\d_]*)?|\d[\d_]*[eE][+-]?\d[\d_]*)"


class Lexer:
    """A language: its lexemes, its recogniser, and how lexemes are classed."""

    grammar = ""
    pattern = ""
    number = rf"(?:{_INT}|{_FLOAT})"
    newline = semicolon = ""
    flags = 0

    def __init__(self, tables: Tables):
        self.terminals = tables.terminals
        self.regex = re.compile(self.pattern, self.flags)
        self.number_regex = re.compile(self.number)
        owner = self

        class Memo(dict):
            def __missing__(self, lexeme: str) -> int:
                found = owner.terminal(lexeme)
                if len(self) < MEMO:
                    self[lexeme] = found
                return found

        self.memo = Memo()
        ids = self.terminals.get
        closers = frozenset(x for x in (ids("'}"), 0) if x is not None) if self.semicolon else frozenset()
        self.parser = Recogniser(tables, newline=510 if self.newline else -1, semicolon=ids(self.semicolon, -1), closers=closers)

    def terminal(self, lexeme: str) -> int:
        if lexeme == "\0":
            return 0
        if lexeme == "\n":
            return 510
        found = self.terminals.get("'" + lexeme)
        return found if found is not None else self.terminals.get(self.kind(lexeme), BAD)

    def kind(self, lexeme: str) -> str:
        """The terminal class of a lexeme that is no keyword or sign of the grammar."""
        first = lexeme[0]
        if first.isdigit() or first == "." and lexeme[1:2].isdigit():
            return "NUM" if self.number_regex.fullmatch(lexeme) else "BAD"
        if first in "\"" and len(lexeme) > 1:
            return "STR"
        if first.isalpha() or first in "_$":
            return "NAME"
        return "BAD"

    def numbers(self, text: str) -> list[int]:
        return list(map(self.memo.__getitem__, self.regex.findall(text + "\n\0")))

    def first_error(self, text: str) -> int:
        """The number of the first token at which no parse goes on, -1 for a valid text."""
        return self.parser.decide(self.numbers(text.replace("\r\n", "\n")))


class C(Lexer):
    grammar = grammars.C
    _directive = r"^[ \t]*+#[ \t]*+(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:[^\n\\]|\\[\s\S])*+"
    pattern = rf"(?:[ \t\r\n\f﻿]++|//[^\n]*+|{_BLOCK}|{_directive})*+((?:u8|[LuU])?{_DQ}|(?:[LuU])?{_SQ}|{_WORD}|{_NUM}|{_C_SIGNS}|[\s\S])"
    number = rf"(?:{_INT}|{_FLOAT}|0[xX][\da-fA-F.]+[pP][+-]?\d+)[uUlLfF]*"
    flags = re.M

    def kind(self, lexeme: str) -> str:
        if len(lexeme) > 1 and lexeme[-1] == '"' and re.match(r'(?:u8|[LuU])?"', lexeme):
            return "STR"
        if len(lexeme) > 2 and lexeme[-1] == "'" and re.match(r"[LuU]?'", lexeme):
            return "CHAR"
        return super().kind(lexeme)


class Java(Lexer):
    grammar = grammars.JAVA
    pattern = rf'{_SKIP_C}("""[\s\S]*?"""|{_DQ}|{_SQ}|non-sealed\b|{_WORD}|{_NUM}|{_JAVA_SIGNS}|[\s\S])'
    number = rf"(?:{_INT}[lL]?|(?:{_INT}|{_FLOAT})[fFdD]?|0[xX][\da-fA-F.]+[pP][+-]?\d+[fFdD]?)"

    def kind(self, lexeme: str) -> str:
        return ("CHAR" if len(lexeme) > 2 else "BAD") if lexeme[0] == "'" else super().kind(lexeme)


class Go(Lexer):
    grammar = grammars.GO
    pattern = rf"(?:[ \t\r\f﻿]++|//[^\n]*+|/\*[^*\n]*+\*/)*+(\n|/\*[\s\S]*?\*/|`[^`]*+`|{_DQ}|{_SQ}|{_WORD}|{_NUM}|{_GO_SIGNS}|[\s\S])"
    number = rf"(?:{_INT}|{_FLOAT}|0[xX][\da-fA-F.]+[pP][+-]?\d+)i?"
    _ends = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])

    def kind(self, lexeme: str) -> str:
        if lexeme[0] == "`":
            return "STR" if len(lexeme) > 1 else "BAD"
        if lexeme[0] == "'":
            return "CHAR" if len(lexeme) > 2 else "BAD"
        return super().kind(lexeme)

    def numbers(self, text: str) -> list[int]:
        if not hasattr(self, "ends"):
            names = [self.terminals[x] for x in ("NAME", "NUM", "STR", "CHAR")]
            self.ends = frozenset([*names, *(self.terminals["'" + x] for x in self._ends)])
        out: list[int] = []
        memo, ends, semicolon, last = self.memo, self.ends, self.terminals["';"], -1
        for lexeme in self.regex.findall(text + "\n\0"):
            if lexeme.startswith("/*"):
                if "\n" not in lexeme:
                    continue
                lexeme = "\n"
            token = memo[lexeme]
            if token == 510:
                if last not in ends:
                    continue
                token = semicolon
            out.append(token)
            last = token
        return self._close(out)

    def _close(self, tokens: list[int]) -> list[int]:
        """Go lets the semicolon before a closing bracket go; the grammar has it optional there."""
        return tokens


class Rust(Lexer):
    grammar = grammars.RUST
    pattern = rf"""{_SKIP_C}([bc]?r(#*)"[\s\S]*?"\2|[bc]?"(?:[^"\\]|\\[\s\S])*+"|b?'(?:\\[^\n]{{1,10}}?|[^\\'\n])'|'[A-Za-z_]\w*|r#{_WORD}|{_WORD}|{_NUM}|{_RUST_SIGNS}|[\s\S])"""
    number = rf"(?:{_INT}|{_FLOAT})(?:_?(?:[iuf]\d+|usize|isize))?"

    def numbers(self, text: str) -> list[int]:
        return list(map(self.memo.__getitem__, [m[0] for m in self.regex.findall(text + "\n\0")]))

    def kind(self, lexeme: str) -> str:
        if len(lexeme) > 1 and lexeme[-1] == '"' or re.match(r'[bc]?r#*"', lexeme) and lexeme[-1] == "#":
            return "STR"
        if len(lexeme) > 2 and lexeme[-1] == "'":
            return "CHAR"
        if lexeme[0] == "'" and len(lexeme) > 1:
            return "LIFE"
        if lexeme == "_":
            return "BAD"
        return super().kind(lexeme)


class Python(Lexer):
    grammar = grammars.PYTHON
    _prefix = r"(?:[rR][bBfF]?|[bBfFtT][rR]?|[uU])?"
    pattern = rf"""(?:[ \t\f﻿\r]++|#[^\n]*+|\\\r?\n)*+(\n[ \t\f]*+|{_prefix}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|{_DQ}|{_SQ})|{_WORD}|{_NUM}|{_PY_SIGNS}|[\s\S])"""
    number = rf"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0(?:_?0)*|[1-9](?:_?\d)*|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?|\d(?:_?\d)*\.(?:[eE][+-]?\d+)?|\d(?:_?\d)*[eE][+-]?\d+|\d(?:_?\d)*(?=[jJ]))[jJ]?"

    def kind(self, lexeme: str) -> str:
        if len(lexeme) > 1 and lexeme[-1] in "\"'":
            mark = re.match(r"([A-Za-z]*)(\"\"\"|\'\'\'|\"|\')", lexeme)
            if re.search("[fFtT]", mark.group(1)):
                return "STR" if self._fields(lexeme[mark.end() : -len(mark.group(2))]) else "BAD"
            return "STR"
        return "BAD" if "$" in lexeme else super().kind(lexeme)

    def _fields(self, body: str) -> bool:
        """The replacement fields of a formatted string, and those in their formats, hold expressions."""
        at = 0
        while at < len(body):
            if body.startswith(("{{", "}}"), at) or body.startswith("\\N{", at):
                at = body.find("}", at) + 1 if body[at] == "\\" else at + 2
                continue
            if body[at] == "}":
                return False
            if body[at] != "{":
                at += 1
                continue
            start, depth, colon = at + 1, 0, -1
            at += 1
            while at < len(body) and not (depth == 0 and body[at] == "}"):
                c = body[at]
                if c in "\"'":  # a string inside the field
                    close = body.find(c, at + 1)
                    at = close if close > 0 else len(body)
                elif c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth -= 1
                elif c == ":" and depth == 0:
                    colon = at
                    break
                at += 1
            expression = body[start : colon if colon > 0 else at]
            if colon > 0:  # the format goes on to the closing bracket and may hold fields
                depth = 0
                while at < len(body) and not (depth == 0 and body[at] == "}"):
                    depth += (body[at] == "{") - (body[at] == "}")
                    at += 1
                if not self._fields(body[colon + 1 : at]):
                    return False
            if at >= len(body):
                return False
            expression = re.sub(r"\s*(?:(?<![=!<>])=\s*)?(?:![rsa]\s*)?$", "", expression)
            if not expression.strip() or self.parser.decide(self.numbers(f"({expression}\n)")) != -1 and self.parser.decide(self.numbers(f"[{expression}\n]")) != -1:
                return False
            at += 1
        return True

    def numbers(self, text: str) -> list[int]:
        ids = self.terminals
        newline, indent, dedent = ids["NEWLINE"], ids["INDENT"], ids["DEDENT"]
        memo, out, levels, depth = self.memo, [], [0], 0
        lexemes = self.regex.findall("\n" + text + "\n\0")
        fresh = False  # the last token ended a line
        column = 0
        started = True
        for lexeme in lexemes[:-1]:  # a NUL before the last one is none of the end
            if lexeme[0] == "\n":
                if depth == 0:
                    if not started:
                        out.append(newline)
                        started = True
                    column = len(lexeme.expandtabs(8)) - 1
                continue
            if started and depth == 0:
                if column > levels[-1]:
                    levels.append(column)
                    out.append(indent)
                while column < levels[-1]:
                    levels.pop()
                    out.append(dedent)
                    if column > levels[-1]:
                        return [*out, BAD]
                started = False
            if lexeme in "([{":
                depth += 1
            elif lexeme in ")]}":
                depth -= 1
                if depth < 0:
                    return [*out, BAD]
            out.append(memo[lexeme])
        if depth:
            return [*out, BAD]
        return [*out, *[newline] * (not started), *[dedent] * (len(levels) - 1), 0]


class _Script(Lexer):
    newline, semicolon = "NEWLINE", "';"
    _regex = r"(?:(?<=[(,=:\[!&|?{};+\n])|(?<=[(,=:\[!&|?{};+>] )|(?<=\breturn )|(?<=\n[ ]{4})|(?<=\n[ ]{8}))/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+"
    #: The same, and after any blanks of a line.
    _opening = _regex.replace(r"(?<=\n[ ]{4})|(?<=\n[ ]{8})", "|".join([r"(?<=\n[ ]{%d})" % n for n in range(1, 41)] + [r"(?<=\n\t{%d})" % n for n in range(1, 13)]) + r"|(?<=\breturn )")
    pattern = rf"(?:[ \t\r\f﻿\xa0]++|//[^\n]*+|/\*[^*\n]*+\*/)*+(\n|/\*[\s\S]*?\*/|#![^\n]*+|{_regex}|`(?:[^`\\]|\\[\s\S])*+`|{_DQ}|{_SQ}|\#?[^\W\d][\w$]*+|[$][\w$]*+|{_NUM}|{_JS_SIGNS}|[\s\S])"
    number = rf"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|0|[1-9][\d_]*)n?|{_FLOAT}"

    def kind(self, lexeme: str) -> str:
        first = lexeme[0]
        if first == "#":
            return "HASHBANG" if lexeme[1:2] == "!" else "PRIVATE" if len(lexeme) > 1 else "BAD"
        if first == "'" and len(lexeme) > 1:
            return "STR"
        if first == "`":
            return "TEMPLATE" if len(lexeme) > 1 else "BAD"
        if first == "/" and len(lexeme) > 2:
            return "REGEX"
        return super().kind(lexeme)

    def terminal(self, lexeme: str) -> int:
        return 510 if lexeme.startswith("/*") and "\n" in lexeme else 509 if lexeme.startswith("/*") else super().terminal(lexeme)

    def numbers(self, text: str) -> list[int]:
        return self._numbers(text, self.regex)

    def _numbers(self, text: str, regex: re.Pattern) -> list[int]:
        tokens = list(map(self.memo.__getitem__, regex.findall(text + "\n\0")))
        return [t for t in tokens if t != 509] if 509 in tokens else tokens

    def first_error(self, text: str) -> int:
        """As for all; whether a slash at the beginning of a line divides or opens a pattern is left to the parser: a text is invalid if it is so both ways."""
        text = text.replace("\r\n", "\n")
        found = self.parser.decide(self._numbers(text, self.regex))
        if found >= 0 and re.search(r"^[ \t]*/(?![/*])", text, re.M):
            self.other = getattr(self, "other", None) or re.compile(self.pattern.replace(self._regex, self._opening), self.flags)
            found = min(found, self.parser.decide(self._numbers(text, self.other)))
        return found


class Module(_Script):
    grammar = grammars.MODULE


class Script(_Script):
    grammar = grammars.SCRIPT
    number = rf"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]*|[1-9][\d_]*)n?|{_FLOAT}"


class TypeScript(_Script):
    grammar = grammars.TYPESCRIPT


class CSharp(Lexer):
    grammar = grammars.CSHARP
    _directive = r"^[ \t]*+#[ \t]*+(?:if|elif|else|endif|define|undef|region|endregion|pragma|nullable|warning|error|line)\b[^\n]*+"
    pattern = rf'(?:[ \t\r\n\f﻿]++|//[^\n]*+|{_BLOCK}|{_directive})*+(\$*"""[\s\S]*?"""|(?:\$@|@\$)"(?:[^"]|"")*+"|@"(?:[^"]|"")*+"|\$?{_DQ}|{_SQ}|@?{_WORD}|{_NUM}|{_CS_SIGNS}|[\s\S])'
    number = rf"(?:{_INT}[uUlL]*|(?:{_INT}|{_FLOAT})[fFdDmM]?)"
    flags = re.M

    def kind(self, lexeme: str) -> str:
        if len(lexeme) > 1 and lexeme[-1] == '"':
            return "STR"
        if lexeme[0] == "'":
            return "CHAR" if len(lexeme) > 2 else "BAD"
        if lexeme[0] == "@" and len(lexeme) > 1:
            return "NAME"
        return "BAD" if "$" in lexeme else super().kind(lexeme)


class Php(Lexer):
    grammar = grammars.PHP
    _heredoc = r"<<<[ \t]*[\"']?([A-Za-z_]\w*)[\"']?\r?\n[\s\S]*?^[ \t]*\2\b"
    pattern = rf"""(?:[ \t\r\n\f]++|//(?:(?!\?>)[^\n])*+|\#(?!\[)(?:(?!\?>)[^\n])*+|{_BLOCK})*+(\?>\n?|{_heredoc}|"(?:[^"\\]|\\[\s\S])*+"|'(?:[^'\\]|\\[\s\S])*+'|`[^`]*+`|\$[^\W\d]\w*+|\((?i:int|integer|bool|boolean|float|double|string|array|object)\)|\\?[^\W\d]\w*+(?:\\[^\W\d]\w*+)*+|{_NUM}|{_PHP_SIGNS}|[\s\S])"""
    flags = re.M

    def terminal(self, lexeme: str) -> int:
        if lexeme == "\0":
            return self.terminals["END"]
        found = self.terminals.get("'" + lexeme.lower())
        return found if found is not None else self.terminals.get(self.kind(lexeme), BAD)

    def kind(self, lexeme: str) -> str:
        first = lexeme[0]
        if first == "$" and len(lexeme) > 1:
            return "VAR"
        if first in "\"'`":
            return "STR" if len(lexeme) > 1 else "BAD"
        if lexeme.startswith("<<<") and len(lexeme) > 3:
            return "STR"
        if first == "(" and len(lexeme) > 1:
            return "CAST"
        if first == "\\" and len(lexeme) > 1:
            return "NAME"
        return super().kind(lexeme)

    def numbers(self, text: str) -> list[int]:
        ids, memo = self.terminals, self.memo
        out: list[int] = []
        at, size = 0, len(text)
        opener = re.compile(r"<\?(?:php\b|=)", re.I)
        while at < size:
            m = opener.search(text, at)
            if not m:
                out.append(ids["HTML"])
                break
            if m.start() > at:
                out.append(ids["HTML"])
            out.append(ids["OPEN"])
            if m.group() == "<?=":
                out.append(ids["'echo"])
            at = m.end()
            body = text[at:] + "\n\0"
            for found in self.regex.finditer(body):
                lexeme = found.group(1)
                if lexeme.startswith("?>"):
                    out += [ids["';"], ids["CLOSE"]]
                    at += found.end()
                    break
                if lexeme == "\0" and found.end() < len(body):
                    return [*out, BAD]
                out.append(memo[lexeme])
                if lexeme == "\0":
                    return [*out, 0]
            else:
                return [*out, BAD]
        return [*out, 0]


class Ruby(Lexer):
    grammar = grammars.RUBY
    _start = r"(?:(?<=[(,=~\[!&|?{};:\n])|(?<=[(,=~\[!&|?{};:] )|(?<=\b(?:if|or|in) )|(?<=\b(?:and|not) )|(?<=\bwhen )|(?<=\bunless )|(?<=\breturn )|(?<=\belsif ))"
    _regex = _start + r"/(?:[^/\\\n]|\\[^\n])*+/[a-z]*+"
    pattern = rf"""(?:[ \t\r\f﻿]++|\#[^\n]*+|^=begin\b[\s\S]*?^=end\b[^\n]*+|\\\r?\n|\n(?=\s*(?:\#[^\n]*+\n\s*)*+(?:\.(?!\.)|&\.)))*+(\n|^__END__\s*?\n[\s\S]*\Z|(?<!\w)<<[~-]?(["'`]?)([A-Z_a-z]\w*)\2(?=[^\n]*+\n[\s\S]*?^[ \t]*\3[ \t]*\r?$)|{_regex}|"(?:[^"\\]|\\[\s\S])*+"(?::(?!:))?|'(?:[^'\\]|\\[\s\S])*+'(?::(?!:))?|`[^`]*+`|%[wWiI](?:\[[^\]]*+\]|\([^)]*+\)|\{{[^}}]*+\}}|<[^>]*+>|\|[^|]*+\|)|%[qQ](?:\[[^\]]*+\]|\([^)]*+\)|\{{[^}}]*+\}}|\|[^|]*+\|)|%r\{{[^}}]*+\}}[a-z]*+|:"(?:[^"\\]|\\[\s\S])*+"|(?<![:\w)\]]):(?:[^\W\d]\w*+[?!=]?(?![=~>])|\[\]=?|[+\-*/%<>=!~^&|]+)|\?[A-Za-z](?!\w)|@@?[^\W\d]\w*+|\$(?:[^\W\d]\w*+|[0-9~*$?!@/\;,.=:<>"])|[^\W\d]\w*+[?!]?:(?![:])(?=[\s,)\]}}|]|$)|defined\?|[^\W\d]\w*+[?!](?![=~])|{_WORD}|{_NUM}|(?<=[\w)\]}}?!])\[(?!\])|\[\]|{_RB_SIGNS}|[\s\S])"""
    number = rf"(?:{_INT}|(?:\d[\d_]*)\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*[eE][+-]?\d+)[ri]*"
    flags = re.M
    _modifiers = frozenset(["if", "unless", "while", "until", "rescue"])
    _heredocs = re.compile(r"<<([~-]?)([\"'`]?)([A-Z_a-z]\w*)\2")

    def numbers(self, text: str) -> list[int]:
        ids, memo = self.terminals, self.memo
        out: list[int] = []
        stack: list[str] = []
        nl, at, text = ids["NL"], 0, text + "\n\0"
        bodies: list[tuple[str, str]] = []
        last = "\n"
        while at < len(text):
            m = self.regex.match(text, at)
            if m is None:
                return [*out, BAD]
            lexeme, start = m.group(1), m.start(1)
            at = m.end()
            if lexeme == "\n":
                for mark, name in bodies:
                    end = re.compile(rf"^{'[ \t]*' if mark else ''}{name}[ \t]*\r?$", re.M).search(text, at)
                    if not end:
                        return [*out, BAD]
                    at = min(len(text), end.end() + 1)
                bodies = []
                if not (stack and stack[-1] in "([") and (not out or out[-1] != nl):
                    out.append(nl)
                last = lexeme
                continue
            if lexeme == "\0" or lexeme.startswith("__END__"):
                break
            if lexeme == ";":
                if not out or out[-1] != nl:
                    out.append(nl)
                last = lexeme
                continue
            if m.group(3):
                mark = self._heredocs.match(lexeme)
                if last in ("class", ")") or last[-1:].isalnum() and text[start - 1] != " " or not (mark.group(1) or mark.group(3).isupper()):
                    at = start + 2
                    out.append(ids["'<<"])
                    last = "<<"
                    continue
                bodies.append((mark.group(1), mark.group(3)))
                out.append(ids["HEREDOC"])
                last = lexeme
                continue
            if lexeme == "[" and start and (text[start - 1].isalnum() or text[start - 1] in "_)]}?!") and last not in ("return", "and", "or", "in", "when", "if"):
                out.append(ids["INDEX"])
                stack.append("[")
                last = lexeme
                continue
            if lexeme in "([{":
                stack.append(lexeme)
            elif lexeme in ")]}":
                if not stack or stack.pop() != {")": "(", "]": "[", "}": "{"}[lexeme]:
                    return [*out, BAD]
            if last in (".", "&.") and lexeme[-1] == ":" and len(lexeme) > 1 and lexeme[0].isalpha():
                lexeme = lexeme[:-1]
                at -= 1
            elif last == "def" and lexeme[-1] == ":" and len(lexeme) > 1:
                lexeme = lexeme[:-1]
                at -= 1
            if lexeme in self._modifiers and out and last not in (".", "&.", "def") and out[-1] in self._value_ends():
                out.append(ids["RESCUEMOD" if lexeme == "rescue" else "MOD"])
            else:
                out.append(memo[lexeme])
            last = lexeme
        if stack:
            return [*out, BAD]
        return [*out, 0]

    def _value_ends(self) -> frozenset:
        """Terminals that end a value: an ``if`` after them is a modifier."""
        if not hasattr(self, "ends"):
            classes = "NAME CONST IVAR FNAME NUM STR XSTR REGEX SYMBOL WORDS HEREDOC".split()
            signs = ") ] } [] end self nil true false return break next redo retry yield super __method__".split()
            self.ends = frozenset(self.terminals[x] for x in [*classes, *("'" + x for x in signs)] if x in self.terminals)
        return self.ends

    def kind(self, lexeme: str) -> str:
        first = lexeme[0]
        if first in "\"'" and len(lexeme) > 1:
            return "STRLABEL" if lexeme[-1] == ":" else "STR"
        if first == "`" and len(lexeme) > 1:
            return "XSTR"
        if first == "/" and len(lexeme) > 1:
            return "REGEX"
        if first == "%" and len(lexeme) > 2:
            return "REGEX" if lexeme[1] == "r" else "WORDS" if lexeme[1] in "wWiI" else "STR"
        if first == ":" and len(lexeme) > 1:
            return "SYMBOL"
        if first == "?" and len(lexeme) > 1:
            return "STR"
        if first in "@$" and len(lexeme) > 1:
            return "IVAR"
        if first.isalpha() or first == "_":
            if lexeme[-1] == ":":
                return "LABEL"
            if lexeme[-1] in "?!":
                return "FNAME"
            return "BAD" if "$" in lexeme else "CONST" if first.isupper() else "NAME"
        return super().kind(lexeme)


LEXERS: dict[str, type[Lexer]] = {"python": Python, "module": Module, "script": Script, "typescript": TypeScript, "go": Go, "rust": Rust, "java": Java, "ruby": Ruby, "csharp": CSharp, "php": Php, "c": C}


def _with_tokens(text: str) -> str:
    """A grammar whose class TOKEN stands for every terminal but brackets."""
    if "TOKEN" not in text:
        return text
    signs = sorted({f"'{s}'" for s in re.findall(r"'((?:[^'\\]|\\.)+)'", text) if s not in ("(", ")", "[", "]", "{", "}")} | {"'$'", "'?'"})
    classes = sorted({w for w in re.findall(r"\b[A-Z]{3,}\b", re.sub(r"'[^']*'", "", text)) if w != "TOKEN"})
    return text.replace("TOKEN", "anytoken") + "anytoken = " + " | ".join([*signs, *classes]) + "\n"


def build_tables(languages: list[str] | None = None) -> dict[str, Tables]:
    """The tables of the languages' grammars."""
    return {name: build(Grammar(_with_tokens(LEXERS[name].grammar))) for name in languages or LEXERS}
