"""Grammars in EBNF, SLR tables with all their conflicts, and a parser that follows every conflict.

``Grammar`` reads rules ``name = alternative | alternative`` with ``*``, ``+``,
``?``, groups, ``x % y`` (x, separated by y), quoted terminals and terminal
classes in capitals. ``Tables`` is its LR(0) automaton with SLR(1) actions;
where several actions apply, all are kept.

``Recogniser`` runs all of them at once over sets of stacks. Stacks and their
sets are interned, and a step from a set by a token is computed once and looked
up afterwards: over many files of one language nearly every token costs one
dictionary access. The few texts with too many stacks for that are run again
over stacks that share what they have in common, one top for each state, so
that their number no longer matters.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

_PIECE = re.compile(r"'((?:[^'\\]|\\.)+)'|([A-Za-z_]\w*)|([*+?|()%])|(\s+)")
END = "EOF"
#: More stacks at one token are not followed one by one; the text is then decided over shared stacks. Ordinary texts
#: have at most 32, where looking up is faster; a higher bound changes no verdict, only time and memory.
UNDECIDED = 256


class Grammar:
    """Plain productions from EBNF text; the first rule is the start."""

    def __init__(self, text: str):
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        self.names: dict[str, list[int]] = defaultdict(list)
        self._made: dict[tuple, str] = {}
        bodies = []
        for block in re.split(r"\n(?=\S)", "\n".join(line for line in text.splitlines() if line.strip() and not line.startswith("--"))):
            name, _, body = block.strip().partition(" = ")
            bodies.append((name.strip(), body))
        self.start = bodies[0][0]
        self.defined = {name for name, _ in bodies}
        for name, body in bodies:
            self._at, self._pieces = 0, [m for m in _PIECE.finditer(body) if not m.group(4)]
            if sum(len(m.group()) for m in self._pieces) != len(re.sub(r"\s+", "", re.sub(r"'((?:[^'\\]|\\.)+)'", lambda m: "'" + m.group(1).replace(" ", "_") + "'", body))):
                raise ValueError(f"rule {name} has something that is no grammar: {body}")
            for alternative in self._alternatives():
                self._add(name, alternative)
            if self._at != len(self._pieces):
                raise ValueError(f"rule {name} is not closed")
        unknown = {s for _, body in self.rules for s in body if s in () or (s.islower() and s.isidentifier() and s not in self.names and not s.startswith("'"))}
        if unknown:
            raise ValueError(f"undefined rules: {sorted(unknown)}")

    def _add(self, name: str, body: tuple[str, ...]) -> None:
        if (name, body) not in [self.rules[i] for i in self.names[name]]:
            self.names[name].append(len(self.rules))
            self.rules.append((name, body))

    def _peek(self) -> str | None:
        return self._pieces[self._at].group(3) if self._at < len(self._pieces) else ")"

    def _alternatives(self) -> list[tuple[str, ...]]:
        out = self._sequence()
        while self._at < len(self._pieces) and self._peek() == "|":
            self._at += 1
            out += self._sequence()
        return out

    def _sequence(self) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = [()]
        while self._at < len(self._pieces) and self._peek() not in ("|", ")"):
            choices = self._factor()
            out = [left + right for left in out for right in choices]
        return out

    def _factor(self) -> list[tuple[str, ...]]:
        m = self._pieces[self._at]
        self._at += 1
        if m.group(3) == "(":
            choices = self._alternatives()
            self._at += 1
        else:
            choices = [("'" + m.group(1),)] if m.group(1) else [(m.group(2),)]
        while self._at < len(self._pieces) and self._peek() in ("*", "+", "?", "%"):
            mark = self._peek()
            self._at += 1
            if mark == "?":
                choices = [(), *choices]
            elif mark == "%":
                choices = [(self._list(self._single(choices), self._single(self._factor())),)]
            else:
                many = self._list(self._single(choices), None)
                choices = [(many,)] if mark == "+" else [(), (many,)]
        return choices

    def _single(self, choices: list[tuple[str, ...]]) -> str:
        if len(choices) == 1 and len(choices[0]) == 1:
            return choices[0][0]
        key = ("g", tuple(choices))
        if key not in self._made:
            self._made[key] = f"_g{len(self._made)}"
            for c in choices:
                self._add(self._made[key], c)
        return self._made[key]

    def _list(self, item: str, separator: str | None) -> str:
        key = ("l", item, separator)
        if key not in self._made:
            self._made[key] = name = f"_l{len(self._made)}"
            self._add(name, (item,))
            self._add(name, (name, item) if separator is None else (name, separator, item))
        return self._made[key]


@dataclass
class Tables:
    """``actions[state][terminal]``: shift targets (>= 0) and rules to reduce by (~rule); ``goto[state][name]``."""

    actions: list[dict[int, tuple[int, ...]]]
    goto: list[dict[int, int]]
    rules: list[tuple[int, int]]
    terminals: dict[str, int]
    accept: int = -1


def build(grammar: Grammar) -> Tables:
    """The SLR(1) tables of a grammar."""
    rules = [("_start", (grammar.start, END)), *grammar.rules]
    names = {"_start": [0], **{n: [i + 1 for i in ids] for n, ids in grammar.names.items()}}
    terminals = {END: 0}
    for _, body in rules:
        for s in body:
            if s not in names:
                terminals.setdefault(s, len(terminals))
    empty: set[str] = set()
    first: dict[str, set[str]] = {n: set() for n in names} | {t: {t} for t in terminals}
    changed = True
    while changed:
        changed = False
        for name, body in rules:
            before = len(first[name])
            for s in body:
                first[name] |= first[s]
                if s not in empty:
                    break
            else:
                if name not in empty:
                    empty.add(name)
                    changed = True
            changed |= len(first[name]) != before
    follow: dict[str, set[str]] = {n: set() for n in names}
    changed = True
    while changed:
        changed = False
        for name, body in rules:
            tail = follow[name]
            for s in reversed(body):
                if s in names:
                    before = len(follow[s])
                    follow[s] |= tail
                    changed |= len(follow[s]) != before
                    tail = (tail | first[s]) if s in empty else first[s]
                else:
                    tail = {s}
    starts: dict[str, frozenset[int]] = {}

    def opened(name: str) -> frozenset[int]:
        """All rules that may begin where ``name`` is expected."""
        if name not in starts:
            seen, todo = set(), [name]
            while todo:
                n = todo.pop()
                if n in seen:
                    continue
                seen.add(n)
                todo += [rules[r][1][0] for r in names[n] if rules[r][1] and rules[r][1][0] in names]
            starts[name] = frozenset(r for n in seen for r in names[n])
        return starts[name]

    kernels = {frozenset([(0, 0)]): 0}
    order = [frozenset([(0, 0)])]
    actions: list[dict[int, tuple[int, ...]]] = []
    goto: list[dict[int, int]] = []
    ids = {n: i for i, n in enumerate(names)}
    at = 0
    while at < len(order):
        items = set(order[at])
        for rule, dot in order[at]:
            body = rules[rule][1]
            if dot < len(body) and body[dot] in names:
                items |= {(r, 0) for r in opened(body[dot])}
        moves: dict[str, set[tuple[int, int]]] = defaultdict(set)
        row: dict[int, list[int]] = defaultdict(list)
        for rule, dot in items:
            name, body = rules[rule]
            if dot == len(body):
                for t in follow[name]:
                    row[terminals[t]].append(~rule)
            else:
                moves[body[dot]].add((rule, dot + 1))
        jumps: dict[int, int] = {}
        for symbol, kernel in moves.items():
            key = frozenset(kernel)
            if key not in kernels:
                kernels[key] = len(order)
                order.append(key)
            if symbol in names:
                jumps[ids[symbol]] = kernels[key]
            else:
                row[terminals[symbol]].append(kernels[key])
        actions.append({t: tuple(sorted(set(a), reverse=True)) for t, a in row.items()})
        goto.append(jumps)
        at += 1
    accept = next(i for i, k in enumerate(order) if (0, 2) in k)
    return Tables(actions, goto, [(ids[n], len(b)) for n, b in rules], terminals, accept)


class _Top:
    """A state on top of all the stacks that end in one of the tops below it."""

    __slots__ = ("state", "below")

    def __init__(self, state: int, below: list[_Top]):
        self.state, self.below = state, below


@dataclass
class Recogniser:
    """Runs the tables over token numbers. ``newline`` and ``semicolon`` give automatic semicolons where set."""

    tables: Tables
    newline: int = -1
    semicolon: int = -1
    closers: frozenset = frozenset()
    limit: int = 1_500_000
    nodes: list[tuple[int, int]] = field(default_factory=list)
    node_ids: dict[tuple[int, int], int] = field(default_factory=dict)
    sets: list[tuple[frozenset, bool]] = field(default_factory=list)
    set_ids: dict[tuple[frozenset, bool], int] = field(default_factory=dict)
    steps: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.nodes, self.node_ids, self.sets, self.set_ids, self.steps = [], {}, [], {}, {}
        self.begin = self._set(frozenset([self._node(0, -1)]), False)

    def _forget(self, nodes: int, sets: int, steps: int) -> None:
        """Back to so many nodes, sets and steps: what a text with too many stacks has left is large and of no use to others."""
        for ids, size in ((self.node_ids, nodes), (self.set_ids, sets), (self.steps, steps)):
            while len(ids) > size:
                ids.popitem()
        del self.nodes[nodes:], self.sets[sets:]

    def _node(self, state: int, parent: int) -> int:
        key = (state, parent)
        found = self.node_ids.get(key)
        if found is None:
            found = self.node_ids[key] = len(self.nodes)
            self.nodes.append(key)
        return found

    def _set(self, members: frozenset, after_newline: bool) -> int:
        key = (members, after_newline)
        found = self.set_ids.get(key)
        if found is None:
            found = self.set_ids[key] = len(self.sets)
            self.sets.append(key)
        return found

    def _advance(self, members: frozenset, token: int) -> frozenset:
        actions, goto, rules, nodes = self.tables.actions, self.tables.goto, self.tables.rules, self.nodes
        out: set[int] = set()
        todo, seen = list(members), set(members)
        while todo:
            node = todo.pop()
            for action in actions[nodes[node][0]].get(token, ()):
                if action >= 0:
                    out.add(self._node(action, node))
                    continue
                name, size = rules[~action]
                base = node
                for _ in range(size):
                    base = nodes[base][1]
                target = goto[nodes[base][0]].get(name)
                if target is not None:
                    made = self._node(target, base)
                    if made not in seen:
                        seen.add(made)
                        todo.append(made)
                        if len(seen) > UNDECIDED:
                            raise OverflowError
        return frozenset(out)

    def _step(self, at: int, token: int) -> int:
        members, after = self.sets[at]
        if token == self.newline:
            return self._set(members, True)
        found = self._advance(members, token)
        if not found and self.semicolon >= 0 and (after or token in self.closers):
            closed = self._advance(members, self.semicolon)
            found = self._advance(closed, token) if closed else found
        return self._set(found, False) if found else -1

    def decide(self, tokens: list[int]) -> int:
        """The number of the first token that no parse can take, -1 for none; the tokens end with EOF's number."""
        found = self.first_error(tokens)
        return self.shared_error(tokens) if found == -2 else found

    def first_error(self, tokens: list[int]) -> int:
        """As ``decide``, by stacks followed one by one; -2 if these are more than ``UNDECIDED`` at one token."""
        if len(self.steps) > self.limit:
            self._reset()
        steps, at = self.steps, self.begin
        before = len(self.nodes), len(self.sets), len(steps)
        for i, token in enumerate(tokens):
            key = at << 9 | token
            following = steps.get(key)
            if following is None:
                try:
                    following = self._step(at, token)
                except OverflowError:
                    self._forget(*before)
                    return -2
                steps[key] = following
            if following < 0:
                return i
            at = following
        return -1

    def shared_error(self, tokens: list[int]) -> int:
        """As ``decide``, by shared stacks alone; slower for each token, and for any number of stacks."""
        tops, after = [_Top(0, [])], False
        for i, token in enumerate(tokens):
            if token == self.newline:
                after = True
                continue
            found = self._shared_advance(tops, token)
            if not found and self.semicolon >= 0 and (after or token in self.closers):
                closed = self._shared_advance(tops, self.semicolon)
                found = self._shared_advance(closed, token) if closed else found
            if not found:
                return i
            tops, after = found, False
        return -1

    def _shared_advance(self, tops: list[_Top], token: int) -> list[_Top]:
        """The tops after the token; ``tops`` stay as they are, as they may be asked again with a semicolon."""
        actions, goto, rules = self.tables.actions, self.tables.goto, self.tables.rules
        made: dict[int, _Top] = {}  # what reductions have put on, by state
        known: set[tuple[int, _Top]] = set()
        above: dict[_Top, list[_Top]] = defaultdict(list)  # tops made here that stand on a top made here
        todo: list[tuple[_Top, _Top | None]] = [(top, under) for top in tops for under in (None, *top.below)]
        while todo:  # a top with one of those below it: the reductions that go through both; with none, the empty ones
            top, under = todo.pop()
            for action in actions[top.state].get(token, ()):
                if action >= 0:
                    continue
                name, size = rules[~action]
                if (size == 0) != (under is None):
                    continue
                bases = {top} if under is None else {under}
                for _ in range(size - 1):
                    bases = {b for base in bases for b in base.below}
                for base in bases:
                    target = goto[base.state].get(name)
                    if target is None or (target, base) in known:
                        continue
                    known.add((target, base))
                    reached = made.get(target)
                    if reached is None:
                        reached = made[target] = _Top(target, [base])
                        todo.append((reached, None))
                    else:
                        reached.below.append(base)
                    todo.append((reached, base))
                    if made.get(base.state) is base:
                        above[base].append(reached)
                    seen, higher = {reached}, [*above[reached]]
                    while higher:  # their reductions may go through what is new below
                        other = higher.pop()
                        if other not in seen:
                            seen.add(other)
                            higher += above[other]
                            todo += [(other, b) for b in other.below]
        out: dict[int, _Top] = {}
        for top in (*tops, *made.values()):
            for action in actions[top.state].get(token, ()):
                if action >= 0:
                    out.setdefault(action, _Top(action, [])).below.append(top)
        return list(out.values())
