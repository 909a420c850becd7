"""Tokens of program texts, as terminals of the grammars."""

from __future__ import annotations

import re
from functools import cache

_ID = r"[^\W\d][\w]*"
_NUM = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?[a-zA-Z]*|0[bB][01_]+\w*|0[oO][0-7_]+\w*|(?:\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[a-zA-Z_]*\w*"
_LINE = r"//[^\n]*"
_DQ = r'"(?:[^"\\\n]|\\.)*"'
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_BLOCK = r"/\*[\s\S]*?\*/"


class Lexer:
    """Splits a text into kinds, texts, positions and whether a line began before each token.

    ``strings`` are (opening pattern, kind of string): ``plain`` patterns lie in ``literals``; the others name how to go on inside. A
    string with code inside gives SB, the tokens of the code, SM, more code, and SE. What is no token becomes BAD.
    """

    def __init__(self, ops: str, keywords: str, literals: list[tuple[str, str]], *, ident: str = _ID, number: str = _NUM, nested: bool = False, comments: str = _LINE, openers: tuple[tuple[str, str, str, str], ...] = (), regex: bool = False, go: bool = False, jsx: bool = False, directives: bool = False):
        self.keywords, self.nested, self.regex, self.go, self.jsx = frozenset(keywords.split()), nested, regex, go, jsx
        signs = "|".join(re.escape(o) for o in sorted(ops.split(), key=len, reverse=True))
        self.openers = {f"o{i}": o for i, o in enumerate(openers)}
        parts = [("ws", r"[ \t\r\f\v\xa0\ufeff\u2028\u2029\u3000]+"), ("nl", r"\n+"), ("comment", comments)]
        parts += [("nest", r"/\*")] if nested else [("block", _BLOCK)] if comments.startswith("//") else []
        if directives:
            parts.append(("directive", r"(?m:^)[ \t]*#(?:[^\n\\]|\\[\s\S])*"))
        parts += [(f"o{i}", o[0]) for i, o in enumerate(openers)]
        parts += literals + [("NUM", number), ("ID", ident), ("OP", signs)]
        self.master = re.compile("|".join(f"(?P<{k}>{p})" for k, p in parts)).match
        self.inside = {k: re.compile(o[2]) for k, o in self.openers.items()}

    def __call__(self, text: str) -> tuple[list[str], list[str], list[int], list[bool]]:
        self.text, self.K, self.X, self.P, self.N = text, [], [], [], []
        end = self.run(0, None)
        if end < len(text):
            self.put("BAD", "", end, False)
        if self.go and self.ends():
            self.put(";", ";", len(text), False)
        self.put("EOF", "", len(text), True)
        return self.K, self.X, self.P, self.N

    def put(self, kind: str, text: str, at: int, line: bool) -> None:
        self.K.append(kind)
        self.X.append(text)
        self.P.append(at)
        self.N.append(line)

    def ends(self) -> bool:
        """Whether Go puts a semicolon after the last token at a line's end."""
        return bool(self.K) and (self.K[-1] in ("ID", "NUM", "STR", "CHR", "SE") or self.X[-1] in ("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))

    def value_before(self) -> bool:
        """Whether the token before can end an operand, so that a slash or angle divides or compares."""
        if not self.K:
            return False
        k, x = self.K[-1], self.X[-1]
        return k in ("ID", "NUM", "STR", "RE", "SE", "PRIV", "CHR") or x in (")", "]", "}", "this", "super", "null", "true", "false")

    def run(self, pos: int, stop: str | None) -> int:
        """Tokens from ``pos`` up to the bracket that closes the surrounding code; returns the place where it stops."""
        text, master, keywords = self.text, self.master, self.keywords
        K, X, P, N = self.K, self.X, self.P, self.N
        depth, line, size = 0, False, len(text)
        opening = {"}": "{", ")": "("}.get(stop or "")
        while pos < size:
            m = master(text, pos)
            if m is None:
                K.append("BAD")
                X.append("")
                P.append(pos)
                N.append(line)
                line = False
                pos += 1
                continue
            kind = m.lastgroup
            end = m.end()
            if kind == "ID":
                word = text[pos:end]
                K.append("KW" if word in keywords else "ID")
                X.append(word)
            elif kind == "OP":
                sign = text[pos:end]
                if sign == stop and depth == 0:
                    return pos
                if sign == opening:
                    depth += 1
                elif sign == stop:
                    depth -= 1
                if self.regex and sign[0] == "/" and not self.value_before():
                    r = _REGEX.match(text, pos)
                    if r:
                        K.append("RE")
                        X.append("")
                        P.append(pos)
                        N.append(line)
                        line, pos = False, r.end()
                        continue
                if self.jsx and sign[0] == "<" and not self.value_before() and _JSX.match(text, pos):
                    P_at = len(K)
                    pos = self.element(pos, line)
                    line = False
                    if pos < 0:
                        del K[P_at:], X[P_at:], P[P_at:], N[P_at:]
                        self.put("BAD", "", size, False)
                        return size
                    continue
                K.append("OP")
                X.append(sign)
            elif kind == "ws":
                pos = end
                continue
            elif kind == "nl":
                if self.go and self.ends():
                    self.put(";", ";", pos, False)
                line = True
                pos = end
                continue
            elif kind == "comment":
                pos = end
                continue
            elif kind == "block":
                if "\n" in m[0]:
                    if self.go and self.ends():
                        self.put(";", ";", pos, False)
                    line = True
                pos = end
                continue
            elif kind == "directive":
                pos, line = end, True
                continue
            elif kind == "nest":
                level, at = 1, end
                while level and (c := _NEST.search(text, at)):
                    level += 1 if c[0] == "/*" else -1
                    at = c.end()
                if level:
                    self.put("BAD", "", pos, line)
                    return size
                line = line or "\n" in text[pos:at]
                pos = at
                continue
            elif kind in self.openers:
                pos = self.string(kind, m, line)
                line = False
                if pos < 0:
                    return size
                continue
            else:
                K.append("ID" if kind == "QID" else kind)
                X.append("")
            P.append(pos)
            N.append(line)
            line = False
            pos = end
        return size

    def string(self, kind: str, m: re.Match, line: bool) -> int:
        """A string that may hold code: its parts and the tokens between; -1 if it has no end."""
        _, closer, _, code = self.openers[kind]
        close = m.expand(closer)
        hashes = m.groupdict().get(f"h{kind}") or ""
        find = self.inside[kind].search
        text, pos, first = self.text, m.end(), m.start()
        begun = False
        while True:
            s = find(text, pos)
            if s is None or (s[0] == "\n" and "\n" not in close and len(close.strip("#")) == 1 and close[0] != "`"):
                self.put("BAD", "", first, line)
                return -1
            if text.startswith(close, s.start()):
                self.put("SE" if begun else "STR", "", first if not begun else s.start(), line and not begun)
                return s.end() if set(s[0]) == {'"'} else s.start() + len(close)
            if code and s[0].startswith(code) and (not hashes or s[0].startswith("\\" + hashes)):
                self.put("SM" if begun else "SB", "", first if not begun else s.start(), line and not begun)
                begun = True
                at = self.run(s.end(), "}" if code.endswith("{") else ")")
                if at >= len(text):
                    self.put("BAD", "", len(text), False)
                    return -1
                pos = at + 1
            else:
                pos = max(s.end(), s.start() + 1)

    def element(self, pos: int, line: bool) -> int:
        """A JSX element or fragment: SB, the code in braces, SM ..., SE; -1 if it has no end."""
        text = self.text
        self.put("SB", "", pos, line)

        def brace(at: int) -> int:
            self.put("SM", "", at, False)
            at = self.run(at + 1, "}")
            self.put("SM", "", at, False)
            return at + 1 if at < len(text) else -1

        open_tags = 0
        while True:
            m = _TAG.match(text, pos)
            if not m:
                return -1
            pos = m.end()
            while not (e := _TAG_END.match(text, pos)):
                a = _ATTRIBUTE.match(text, pos)
                if a:
                    pos = a.end()
                elif text.startswith("{", pos):
                    pos = brace(pos)
                    if pos < 0:
                        return -1
                elif pos < len(text) and text[pos].isspace():
                    pos += 1
                else:
                    return -1
            pos = e.end()
            if m[0].startswith("</"):
                open_tags -= 1
            elif e[0] != "/>":
                open_tags += 1
            while open_tags > 0:
                t = _TEXT.match(text, pos)
                pos = t.end()
                if text.startswith("{", pos):
                    pos = brace(pos)
                    if pos < 0:
                        return -1
                else:
                    break
            if open_tags <= 0:
                self.put("SE", "", pos, False)
                return pos


_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_NEST = re.compile(r"/\*|\*/")
_JSX = re.compile(r"<(?:>|[A-Za-z_$][\w.$:-]*(?!\s*(?:,|extends\b))[\s/>])")
_TAG = re.compile(r"</?\s*(?:[A-Za-z_$][\w.$:-]*)?")
_TAG_END = re.compile(r"\s*/?>")
_ATTRIBUTE = re.compile(r"""\s+[A-Za-z_$][\w:.$-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?=\{)))?""")
_TEXT = re.compile(r"[^<{]*")

_C_OPS = "{ } ( ) [ ] ; , . ... ? : :: -> => = == != === !== < > <= >= + - * / % ++ -- += -= *= /= %= && || ! ~ & | ^ << <<= >>= >>>= &= |= ^= ** **= ?? ??= ?. ||= &&= @ # $ \\"

#: Reserved words.
_JS_WORDS = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await"
_JAVA_WORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _"
_GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_RUST_WORDS = "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try gen"
_SWIFT_WORDS = "associatedtype class deinit enum extension fileprivate func import init inout internal let operator private precedencegroup protocol public rethrows static struct subscript typealias var break case catch continue default defer do else fallthrough for guard if in repeat return throw switch where while as false is nil self Self super throws true try"
_KOTLIN_WORDS = "as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while"
_DART_WORDS = "assert break case catch class const continue default do else enum extends false final finally for if in is new null rethrow return super switch this throw true try var void while with"
_C_WORDS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while"


_PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<nl>\r?\n|\r)|(?P<str>(?P<pre>[A-Za-z]{0,2})(?P<q>\"\"\"|'''|"|'))"""
    r"""|(?P<NUM>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"""
    r"""|(?P<ID>[^\W\d]\w*)|(?P<OP>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[-+*/%@&|^=!<>]=|\*\*|//|<<|>>|[-+*/%@&|^~<>=(){}\[\],:.;!])"""
)
_PY_END = {q: re.compile(rf"\\[\s\S]|{q}" + (r"|\n" if len(q) == 1 else "")) for q in ('"', "'", '"""', "'''")}
_PY_CODE = {q: re.compile(rf"{{{{|}}}}|\\[\s\S]|{q}|{{|}}" + (r"|\n" if len(q) == 1 else "")) for q in ('"', "'", '"""', "'''")}
_PREFIXES = frozenset(["", "r", "u", "b", "f", "t", "br", "rb", "fr", "rf", "tr", "rt"])


class PythonLexer:
    """Tokens of Python with NEWLINE, INDENT and DEDENT; bad indentation gives BAD."""

    def __call__(self, text: str) -> tuple[list[str], list[str], list[int], list[bool]]:
        self.text, self.K, self.X, self.P = text, [], [], []
        self.levels, self.brackets = [0], []
        self.run(0, False)
        if self.K and self.K[-1] != "NEWLINE":
            self.put("NEWLINE", "", len(text))
        for _ in self.levels[1:]:
            self.put("DEDENT", "", len(text))
        self.put("EOF", "", len(text))
        return self.K, self.X, self.P, [False] * len(self.K)

    def put(self, kind: str, text: str, at: int) -> None:
        self.K.append(kind)
        self.X.append(text)
        self.P.append(at)

    def indent(self, width: int, at: int) -> None:
        if width > self.levels[-1]:
            self.levels.append(width)
            self.put("INDENT", "", at)
        while width < self.levels[-1]:
            self.levels.pop()
            self.put("DEDENT", "", at)
        if width != self.levels[-1]:
            self.put("BAD", "", at)

    def run(self, pos: int, nested: bool) -> int:
        """Tokens from ``pos``; in a replacement field up to the sign that ends its expression."""
        text, size, begins, depth = self.text, len(self.text), not nested, len(self.brackets)
        while pos < size:
            m = _PY.match(text, pos)
            if m is None:
                self.put("BAD", "", pos)
                return size
            kind, end = m.lastgroup, m.end()
            if kind == "q":
                kind = "str"
            if kind == "ws":
                if not begins or m[0][0] == "\\":
                    pos = end
                    continue
                ahead = _PY.match(text, end)
                if ahead and ahead.lastgroup not in ("nl", "comment"):
                    column = 0
                    for c in m[0]:
                        column = column // 8 * 8 + 8 if c == "\t" else 0 if c == "\f" else column + 1
                    self.indent(column, end)
                    begins = False
                pos = end
                continue
            if kind == "comment":
                pos = end
                continue
            if kind == "nl":
                if not self.brackets and not begins and not nested:
                    self.put("NEWLINE", "", pos)
                    begins = True
                pos = end
                continue
            if begins and not self.brackets:
                self.indent(0 if pos == 0 or text[pos - 1] in "\r\n\f\ufeff" else self.levels[-1], pos)
                begins = False
            if kind == "str":
                pos = self.string(m)
                if pos < 0:
                    return size
                continue
            word = m[0]
            if kind == "OP":
                if nested and len(self.brackets) == depth and (word in ("}", ":", "!") or (word == "=" and re.match(r"=\s*[}!:]", text[pos : pos + 80]))):
                    return pos
                if word in "([{":
                    self.brackets.append(word)
                elif word in ")]}":
                    if not self.brackets or self.brackets.pop() + word not in ("()", "[]", "{}"):
                        self.put("BAD", "", pos)
                        return size
                self.put("OP", word, pos)
            elif kind == "ID":
                self.put("KW" if word in _PY_WORDS else "ID", word, pos)
            else:
                self.put("NUM", "", pos)
                if end < size and (text[end].isalpha() or text[end] == "_") and not _PY_AFTER.match(text, end):
                    self.put("BAD", "", end)
                    return size
            pos = end
        return size

    def string(self, m: re.Match) -> int:
        prefix, quote, text = m["pre"].lower(), m["q"], self.text
        if prefix not in _PREFIXES:
            self.put("ID", m["pre"], m.start())
            prefix, at = "", m.start("q")
        else:
            at = m.start()
        pos = m.end()
        code = "f" in prefix or "t" in prefix
        find = (_PY_CODE if code else _PY_END)[quote].search
        self.put("STR", "b" if "b" in prefix else "s", at)
        while True:
            s = find(text, pos)
            if s is None or s[0] == "\n":
                self.put("BAD", "", at)
                return -1
            if s[0] == quote:
                return s.end()
            pos = s.end()
            if s[0] == "{":
                pos = self.field(pos)
                if pos < 0:
                    return -1
            elif s[0] == "}":
                self.put("BAD", "", s.start())
                return -1

    def field(self, pos: int) -> int:
        """A replacement field after its brace: FB expression FE; -1 if it has no end."""
        text = self.text
        self.put("FB", "", pos)
        pos = self.run(pos, True)
        self.put("FE", "", pos)
        if text.startswith("=", pos):
            pos += 1
            while pos < len(text) and text[pos].isspace():
                pos += 1
        if text.startswith("!", pos):
            if text[pos + 1 : pos + 2] not in ("r", "s", "a"):
                self.put("BAD", "", pos)
                return -1
            pos += 2
        if text.startswith(":", pos):
            pos += 1
            while pos < len(text) and text[pos] not in "}\n":
                if text[pos] == "{":
                    pos = self.field(pos + 1)
                    if pos < 0:
                        return -1
                else:
                    pos += 1
        if not text.startswith("}", pos):
            self.put("BAD", "", min(pos, len(text)))
            return -1
        return pos + 1


_PY_AFTER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")


@cache
def lexer(name: str) -> Lexer:
    """The lexer of a language; one for each worker."""
    if name == "py":
        return PythonLexer()
    js_strings = [("PRIV", rf"#{_ID}"), ("STR", _DQ.replace(r"\\.", r"\\[\s\S]") + "|" + _SQ.replace(r"\\.", r"\\[\s\S]"))]
    template = ((r"`", "`", r"`|\\[\s\S]|\$\{", "${"),)
    js_id = r"(?:[^\W\d]|\$)[\w$]*"
    if name in ("js", "ts", "tsx"):
        return Lexer(_C_OPS, _JS_WORDS, js_strings, ident=js_id, openers=template, regex=True, jsx=name == "tsx")
    if name == "java":
        return Lexer(_C_OPS, _JAVA_WORDS, [("STR", r'"""[ \t\f]*\n(?:[^\\]|\\[\s\S])*?"""|' + r'"(?!"")(?:[^"\\\n]|\\.)*"|""(?!")'), ("CHR", r"'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'")], ident=r"(?:[^\W\d]|\$)[\w$]*")
    if name == "go":
        return Lexer(_C_OPS + " := <- &^ &^=", _GO_WORDS, [("STR", r"`[^`]*`|" + _DQ), ("CHR", r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'")], go=True)
    if name == "rs":
        return Lexer(_C_OPS.replace("++ -- ", "").replace(" ?. ", " ").replace(" ?? ??= ", " ") + " .. ..=", _RUST_WORDS, [("STR", r'b?c?r(?P<rh>#*)"[\s\S]*?"(?P=rh)|[bc]?"(?:[^"\\]|\\[\s\S])*"'), ("CHR", r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'"), ("LIFE", rf"'{_ID}(?!')"), ("RAW", rf"r#{_ID}")], nested=True)
    if name == "swift":
        return Lexer("{ } ( ) [ ] ; , . : -> = == != === !== < > <= >= + - * / % ++ -- += -= *= /= %= && || ! ~ & | ^ << <<= &= |= ^= ?? ? @ # ... ..< &+ &- &* ~= \\", _SWIFT_WORDS, [("QID", rf"`{_ID}`|\$\d+"), ("AT", rf"#{_ID}")], nested=True, openers=(
            (r'(?P<ho0>#+)"""', r'"""\g<ho0>', r'"""#+|\\#+\(', "\\"), (r'(?P<ho1>#+)"', r'"\g<ho1>', r'"#+|\\#+\(|\n', "\\"),
            (r'"""', '"""', r'"""|\\\(|\\[\s\S]', "\\("), (r'"', '"', r'"|\\\(|\\[\s\S]|\n', "\\(")))
    if name == "kt":
        return Lexer(_C_OPS.replace("?? ??= ", "") + " .. ..< ?: !! !in !is", _KOTLIN_WORDS, [("CHR", r"'(?:[^'\\\n]|\\u[0-9a-fA-F]{4}|\\.)'"), ("QID", r"`[^`\n]+`")], nested=True, openers=((r'"""', '"""', r'"""+|\$\{', "${"), (r'"', '"', r'"|\\[\s\S]|\$\{|\n', "${")))
    if name == "dart":
        return Lexer(_C_OPS + " .. ...? ?.. ~/ ~/= ?[", _DART_WORDS, [("STR", r"r'''[\s\S]*?'''|r\"\"\"[\s\S]*?\"\"\"|r'[^'\n]*'|r\"[^\"\n]*\"")], ident=r"(?:[^\W\d]|\$)[\w$]*", nested=True, openers=(
            (r"'''", "'''", r"'''|\\[\s\S]|\$\{", "${"), (r'"""', '"""', r'"""|\\[\s\S]|\$\{', "${"), (r"'", "'", r"'|\\[\s\S]|\$\{|\n", "${"), (r'"', '"', r'"|\\[\s\S]|\$\{|\n', "${")))
    if name == "objc":
        return Lexer(_C_OPS.replace("=== !== ", "").replace("?? ??= ?. ||= &&= ", "").replace("** **= ", ""), _C_WORDS, [("AT", r"@(?:interface|implementation|protocol|end|property|synthesize|dynamic|class|optional|required|public|private|protected|package|selector|encode|try|catch|finally|throw|synchronized|autoreleasepool|import|available|compatibility_alias|defs)\b"), ("STR", "@?" + _DQ.replace(r"\\.", r"\\[\s\S]")), ("CHR", r"[LuU]?'(?:[^'\\\n]|\\[0-7]{1,3}|\\x[0-9a-fA-F]+|\\.)+'")], directives=True)
    raise ValueError(name)
