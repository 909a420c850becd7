"""A packrat parser for parsing-expression grammars over tokens.

A grammar is text: ``name = choice`` a line, continued by indented lines. A choice is sequences parted by ``/``; items are rule names (lower
case), token kinds (upper case), quoted token texts, groups, ``?`` ``*`` ``+`` after an item, ``&`` ``!`` before one, ``^`` (the next token stands on a
new line) and ``~`` (it does not). Later definitions of a name replace earlier ones, so a language can build on another's grammar.
Rules become Python functions that keep their result per position. A rule that is used once and is no loop within a loop stands in its user's code instead, and so adds a bounded number of steps to each
evaluation of it; loops run along their tokens for every position at which their rule is tried.
"""

from __future__ import annotations

import re

_ITEM = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_][A-Za-z_0-9]*)|(.))")


def _read(text: str) -> dict[str, tuple]:
    rules: dict[str, str] = {}
    name = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] in " \t":
            rules[name] += " " + line.strip()
        else:
            name, _, body = line.partition("=")
            name = name.strip()
            rules[name] = body.strip()
    return {n: _choice([m for m in _ITEM.findall(b) if any(m)], [0]) for n, b in rules.items()}


def _choice(items: list, at: list[int]) -> tuple:
    options = [_sequence(items, at)]
    while at[0] < len(items) and items[at[0]][2] == "/":
        at[0] += 1
        options.append(_sequence(items, at))
    return options[0] if len(options) == 1 else ("or", options)


def _sequence(items: list, at: list[int]) -> tuple:
    parts = []
    while at[0] < len(items) and items[at[0]][2] not in ("/", ")"):
        parts.append(_one(items, at))
    return parts[0] if len(parts) == 1 else ("seq", parts)


def _one(items: list, at: list[int]) -> tuple:
    literal, word, sign = items[at[0]]
    at[0] += 1
    if sign in ("&", "!"):
        return (sign, _one(items, at))
    if sign in ("^", "~"):
        out: tuple = ("nl", sign == "^")
    elif sign == "(":
        out = _choice(items, at)
        at[0] += 1
    elif literal:
        out = ("text", literal[1:-1].replace("\\'", "'"))
    elif word:
        out = ("kind", word) if word.isupper() else ("rule", word)
    else:
        raise ValueError(sign)
    while at[0] < len(items) and items[at[0]][2] in ("?", "*", "+"):
        out = (items[at[0]][2], out)
        at[0] += 1
    return out


#: A rule that is used once needs no memory of its own, as the rule around it has one, unless it loops within a loop; nor does a choice of tokens. Down to this depth their code stands in place.
INLINE = 24


def _count(node: tuple, uses: dict[str, int]) -> None:
    """How often each rule is named below ``node``."""
    if node[0] == "rule":
        uses[node[1]] = uses.get(node[1], 0) + 1
    elif node[0] in ("seq", "or"):
        for part in node[1]:
            _count(part, uses)
    elif node[0] in ("?", "*", "+", "&", "!"):
        _count(node[1], uses)


def _looped(node: tuple, inside: bool, found: dict[str, bool]) -> bool:
    """Whether ``node`` has a loop; notes of each rule below it whether it is named inside one."""
    if node[0] == "rule":
        found[node[1]] = found.get(node[1], False) or inside
        return False
    if node[0] in ("seq", "or"):
        return any([_looped(part, inside, found) for part in node[1]])
    if node[0] in ("?", "*", "+", "&", "!"):
        loop = node[0] in ("*", "+")
        return _looped(node[1], inside or loop, found) or loop
    return False


def _plain(node: tuple) -> bool:
    """Whether a rule is a choice of tokens, which is quicker to read again than to remember."""
    return node[0] in ("text", "kind", "nl") or (node[0] == "or" and all(o[0] in ("text", "kind") for o in node[1]))


#: What may begin anything.
_ANY = (frozenset(), frozenset(), True)


class Grammar:
    """A compiled grammar: :meth:`parse` gives whether rule ``file`` takes the whole input."""

    def __init__(self, text: str):
        self.rules = _read(text)
        self.lines: list[str] = []
        self.fresh = 0
        uses: dict[str, int] = {}
        for node in self.rules.values():
            _count(node, uses)
        inside: dict[str, bool] = {}
        loops = {n: _looped(node, False, inside) for n, node in self.rules.items()}
        self.once = {n for n in self.rules if n != "file" and ((uses.get(n) == 1 and not (loops[n] and inside.get(n))) or _plain(self.rules[n]))}
        self.firsts: dict[str, tuple] = {}
        source = []
        for track in (False, True):
            source.append(f"def make_{int(track)}(K, X, N, far):")
            for name in self.rules:
                source.append(f"    memo_{name} = {{}}")
            for name, node in self.rules.items():
                self.lines, self.fresh = [], 0
                source += [f"    def r_{name}(i):", f"        v = memo_{name}.get(i)", "        if v is not None: return v", "        start = i"]
                self._emit(node, 2, track)
                source += self.lines + [f"        memo_{name}[start] = i", "        return i"]
            source.append("    return r_file")
        scope: dict = {}
        exec(compile("\n".join(source), "<grammar>", "exec"), scope)  # noqa: S102
        self.make = (scope["make_0"], scope["make_1"])

    def _first(self, node: tuple) -> tuple[frozenset, frozenset, bool]:
        """(texts, kinds) of the tokens with which ``node`` may begin, and whether it may take none; what is looked at but not taken is passed over."""
        kind = node[0]
        if kind == "text":
            return frozenset([node[1]]), frozenset(), False
        if kind == "kind":
            return frozenset(), frozenset([node[1]]), False
        if kind == "rule":
            if node[1] not in self.firsts:
                self.firsts[node[1]] = _ANY
                self.firsts[node[1]] = self._first(self.rules[node[1]])
            return self.firsts[node[1]]
        if kind in ("nl", "&", "!"):
            return _ANY
        if kind in ("?", "*", "+"):
            texts, kinds, none = self._first(node[1])
            return texts, kinds, none or kind != "+"
        texts, kinds, none = frozenset(), frozenset(), kind == "seq"
        for part in node[1]:
            t, k, n = self._first(part)
            texts, kinds = texts | t, kinds | k
            none = none and n if kind == "seq" else none or n
            if kind == "seq" and not n:
                break
        return texts, kinds, none

    def _guard(self, node: tuple, track: bool) -> str | None:
        """A test that fails where ``node`` can't begin, so that no rule is tried there; none while failures are tracked."""
        if track or node[0] in ("text", "kind", "nl", "&", "!"):
            return None
        texts, kinds, none = self._first(node)
        if none:
            return None
        tests = []
        for where, some in (("X", sorted(texts)), ("K", sorted(kinds))):
            if some:
                tests.append(f"{where}[i] in {set(some)!r}" if len(some) > 1 else f"{where}[i] == {some[0]!r}")
        return " or ".join(tests)

    def _guarded(self, node: tuple, depth: int, track: bool) -> None:
        test = self._guard(node, track)
        if test is None:
            self._emit(node, depth, track)
        else:
            self.lines.append(f"{'    ' * depth}if {test}:")
            self._emit(node, depth + 1, track)
            self.lines.append(f"{'    ' * depth}else: i = -1")

    def _emit(self, node: tuple, depth: int, track: bool) -> None:
        """Code that moves ``i`` over ``node``, or sets it to -1."""
        pad = "    " * depth
        add = self.lines.append
        kind = node[0]
        if kind in ("text", "kind"):
            where = "X" if kind == "text" else "K"
            if track:
                add(f"{pad}if i > far[0]: far[0] = i")
            add(f"{pad}i = i + 1 if {where}[i] == {node[1]!r} else -1")
        elif kind == "nl":
            add(f"{pad}if {'not ' if node[1] else ''}N[i]: i = -1")
        elif kind == "rule":
            if node[1] not in self.rules:
                raise ValueError(f"no rule {node[1]}")
            if node[1] in self.once and depth <= INLINE:
                self._emit(self.rules[node[1]], depth, track)
            else:
                add(f"{pad}i = r_{node[1]}(i)")
        elif kind == "seq":
            if not node[1]:
                add(f"{pad}pass")
            for n, part in enumerate(node[1]):
                if n:
                    add(f"{pad}if i >= 0:")
                    depth += 1
                    pad = "    " * depth
                self._emit(part, depth, track)
        elif kind == "or":
            s = self._name()
            add(f"{pad}{s} = i")
            texts = all(o[0] in ("text", "kind") for o in node[1])
            if texts and not track:
                tests = []
                for where, k in (("X", "text"), ("K", "kind")):
                    some = tuple(o[1] for o in node[1] if o[0] == k)
                    if some:
                        tests.append(f"{where}[i] in {set(some)!r}" if len(some) > 1 else f"{where}[i] == {some[0]!r}")
                add(f"{pad}i = i + 1 if {' or '.join(tests)} else -1")
                return
            for n, option in enumerate(node[1]):
                if n:
                    add(f"{pad}if i < 0:")
                    depth += 1
                    pad = "    " * depth
                    add(f"{pad}i = {s}")
                self._guarded(option, depth, track)
        elif kind == "?":
            s = self._name()
            add(f"{pad}{s} = i")
            self._guarded(node[1], depth, track)
            add(f"{pad}if i < 0: i = {s}")
        elif kind in ("*", "+"):
            s = self._name()
            if kind == "+":
                self._emit(node[1], depth, track)
                add(f"{pad}if i >= 0:")
                depth += 1
                pad = "    " * depth
            add(f"{pad}while {self._guard(node[1], track) or True}:")
            add(f"{pad}    {s} = i")
            self._emit(node[1], depth + 1, track)
            add(f"{pad}    if i <= {s}: i = {s}; break")
        else:
            s = self._name()
            add(f"{pad}{s} = i")
            self._emit(node[1], depth, track)
            add(f"{pad}i = {s} if i {'>=' if kind == '&' else '<'} 0 else -1")

    def _name(self) -> str:
        self.fresh += 1
        return f"s{self.fresh}"

    def accepts(self, kinds: list[str], texts: list[str], new_line: list[bool]) -> bool:
        """Whether the whole input is taken."""
        return self.make[0](kinds, texts, new_line, None)(0) >= 0

    def parse(self, kinds: list[str], texts: list[str], new_line: list[bool]) -> int:
        """-1 if the whole input is taken, else the furthest token at which something else was expected."""
        if self.accepts(kinds, texts, new_line):
            return -1
        far = [0]
        self.make[1](kinds, texts, new_line, far)(0)
        return min(far[0], len(kinds) - 1)
