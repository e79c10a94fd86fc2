"""Identifiers in source code: error-tolerant recognisers over a token stream, one for each family of languages.

A recogniser gives every identifier of a text with its span and, where it is a definition, what it defines. There is no grammar
behind them, so malformed code is read as far as it makes sense; reserved words are never identifiers. Precision ends where a
grammar would be needed: names in macros, and definitions that differ from uses by their types alone.
"""

from __future__ import annotations

import keyword
import re
from itertools import accumulate
from typing import NamedTuple


class Occurrence(NamedTuple):
    start: int
    end: int
    name: str
    category: str | None  # of a definition, else None


# The reserved words of each language's standard, with the literals that act as such; they are never renamed.
_CPP = frozenset("""alignas alignof and and_eq asm auto bitand bitor bool break case catch char char16_t char32_t char8_t class co_await co_return co_yield
compl concept const const_cast consteval constexpr constinit continue decltype default delete do double dynamic_cast else enum explicit export extern
false float for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator or or_eq private protected public register
reinterpret_cast requires return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef
typeid typename union unsigned using virtual void volatile wchar_t while xor xor_eq""".split())
_PYTHON = frozenset(keyword.kwlist)
_JS = frozenset("""arguments as async await break case catch class const continue debugger default delete do else enum eval export extends false finally for
from function if implements import in instanceof interface let namespace new null of package private protected public return static super switch this
throw true try type typeof undefined var void while with yield""".split())
_JAVA = frozenset("""abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float
for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch
synchronized this throw throws transient true try void volatile while""".split())
RESERVED = {"python": _PYTHON, "java": _JAVA, "cpp": _CPP, "javascript": _JS, "typescript": _JS}
# Names with a meaning of their own, by language.
_SPECIAL = {"python": frozenset({"self", "cls"}), "java": frozenset({"main", "toString", "equals", "hashCode", "clone", "finalize"})}
#: Further words that open or qualify declarations but may not be names here.
_CPP_MORE = frozenset("final override noexcept explicit wchar_t size_t".split())

_COMMENTS = r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z))"
_STRING = r"(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
_REST = r"(?P<number>\.?\d(?:[eE][+-]|[\w.'])*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>::|->|=>|==|!=|<=|>=|:=|&&|\|\||\+\+|--|\*\*|\.\.\.|[^\s\w])"
_LEX = {
    "cpp": re.compile(rf"{_COMMENTS}|(?P<pre>^[ \t]*\#(?:\\\r?\n|[^\n])*)|{_STRING}|{_REST}", re.S | re.M),
    "java": re.compile(rf"{_COMMENTS}|(?P<long>\"\"\".*?(?:\"\"\"|\Z))|{_STRING}|{_REST}", re.S),
    "js": re.compile(rf"{_COMMENTS}|(?P<quasi>`(?:\\.|[^`\\])*`?)|{_STRING}|{_REST}", re.S),
    "python": re.compile(rf"(?P<skip>\#[^\n]*)|(?P<long>[A-Za-z]{{0,2}}(?:\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'''(?:\\.|.)*?(?:'''|\Z)))|(?P<text>[A-Za-z]{{0,2}}(?:\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))|{_REST}|(?P<line>\\\n|\n)", re.S),
}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def _tokens(language: str, text: str, base: int = 0) -> list[Token]:
    return [Token(m.lastgroup, m.group(), base + m.start(), base + m.end()) for m in _LEX[language].finditer(text) if m.lastgroup not in ("skip", "pre")]


def _close(tokens: list[Token], at: int) -> int:
    """Where the bracket at ``at`` closes, or the end."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].text in ("(", "[", "{"):
            depth += 1
        elif tokens[i].text in (")", "]", "}"):
            depth -= 1
            if depth <= 0:
                return i
    return len(tokens)


def _parts(tokens: list[Token], begin: int, end: int, angle: bool = False) -> list[list[Token]]:
    """Tokens between two places, split at commas outside all brackets."""
    out, depth = [[]], 0
    for t in tokens[begin:end]:
        depth += (t.text in ("(", "[", "{") or angle and t.text == "<") - (t.text in (")", "]", "}") or angle and t.text == ">")
        if t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


class _Found:
    def __init__(self, language: str):
        self.reserved, self.at, self.defined = RESERVED[language], {}, {}

    def name(self, t: Token) -> bool:
        return t.kind == "name" and t.text not in self.reserved

    def use(self, t: Token) -> None:
        if self.name(t):
            self.at[t.start] = t

    def define(self, t: Token, category: str) -> None:
        if self.name(t):
            self.at[t.start] = t
            self.defined.setdefault(t.start, category)

    def result(self) -> list[Occurrence]:
        return [Occurrence(t.start, t.end, t.text, self.defined.get(start)) for start, t in sorted(self.at.items())]


def _inside(found: _Found, language: str, text: str, base: int, pattern: str) -> None:
    """Identifiers in the expressions of an interpolated string."""
    for m in re.finditer(pattern, text):
        for t in _tokens(language, m.group(1), base + m.start(1)):
            found.use(t)


def _python(text: str) -> list[Occurrence]:
    found, tokens = _Found("python"), _tokens("python", text)
    bare = [t for t in tokens if t.kind != "line"]
    place = list(accumulate((t.kind != "line" for t in tokens), initial=0))  # of a token, counted without line ends
    depth, begins, scopes, header = 0, True, [], False
    line_start = 0
    for i, t in enumerate(tokens):
        if t.kind in ("text", "long") and "f" in re.match(r"[A-Za-z]*", t.text).group().lower():
            _inside(found, "python", t.text, t.start, r"(?<!\{)\{(?!\{)([^{}!:]+)")
        if t.kind == "line":
            if t.text == "\n" and depth == 0:
                begins, header = True, False
            line_start = t.end
            continue
        nxt = tokens[i + 1] if i + 1 < len(tokens) else Token("op", "", t.end, t.end)
        last = tokens[i - 1].text if i else ""
        if begins and t.text in ("async",):
            continue
        if begins:
            indent = len(text[line_start : t.start].expandtabs()) if not text[line_start : t.start].strip() else None
            header = t.text in ("if", "elif", "else", "for", "while", "try", "except", "finally", "with", "class", "def")
            if t.text in ("class", "def") and nxt.kind == "name":
                indent = indent if indent is not None else (scopes[-1][0] + 1 if scopes else 0)
                while scopes and scopes[-1][0] >= indent:
                    scopes.pop()
                if t.text == "class":
                    found.define(nxt, "class")
                else:
                    found.define(nxt, "method" if scopes and scopes[-1][1] == "class" else "function")
                    if i + 2 < len(tokens) and tokens[i + 2].text == "(":
                        for part in _parts(bare, place[i + 2] + 1, place[_close(tokens, i + 2)]):
                            names = [x for x in part if x.text not in ("*", "**")]
                            if names:
                                found.define(names[0], "variable")
                scopes.append((indent, t.text))
            elif t.text == "for" and nxt.kind == "name" and i + 2 < len(tokens) and tokens[i + 2].text == "in":
                found.define(nxt, "variable")
            elif t.kind == "name" and (nxt.text == "=" or nxt.text == ":" and not header):
                found.define(t, "variable")
        elif t.kind == "name" and depth == 0 and last == "=" and nxt.text == "=":
            found.define(t, "variable")  # a = b = value
        if t.kind == "name" and nxt.text == ":=":
            found.define(t, "variable")
        found.use(t)
        depth = max(0, depth + (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}")))
        begins = t.text == ";" and depth == 0 or t.text == ":" and depth == 0 and header
        header = header and not begins
    return found.result()


_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; && || => return typeof case".split())


_JS_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def _js_tokens(text: str) -> list[Token]:
    """Tokens in one pass; a slash after an operator opens a regular expression, which is a text like a string."""
    out, at = [], 0
    while m := _LEX["js"].search(text, at):
        at = m.end()
        if m.lastgroup == "skip":
            continue
        whole = _JS_REGEX.match(text, m.start()) if m.group() == "/" and (not out or out[-1].text in _BEFORE_REGEX) else None
        at = whole.end() if whole else at
        out.append(Token("text", '""', m.start(), at) if whole else Token(m.lastgroup, m.group(), m.start(), at))
    return out


def _js(language: str, text: str) -> list[Occurrence]:
    found, tokens = _Found(language), _js_tokens(text)
    classes: list[int] = []  # depths of class bodies
    depth, pending = 0, False
    n = len(tokens)
    get = lambda i: tokens[i].text if 0 <= i < n else ""

    def params(at: int) -> int:
        end = _close(tokens, at)
        for part in _parts(tokens, at + 1, end, angle=False):
            part = [t for t in part if t.text not in ("...", "public", "private", "protected", "readonly")]
            if part and part[0].kind == "name":
                found.define(part[0], "variable")
        return end

    for i, t in enumerate(tokens):
        last, after = get(i - 1), get(i + 1)
        if t.kind == "quasi":
            _inside(found, "js", t.text, t.start, r"\$\{([^{}]*)\}")
        if t.text == "{":
            depth += 1
            if pending:
                classes.append(depth)
                pending = False
        elif t.text == "}":
            if classes and classes[-1] == depth:
                classes.pop()
            depth = max(0, depth - 1)
        if t.kind != "name":
            continue
        found.use(t)
        if last in ("class", "interface", "enum") and get(i - 2) != ".":
            found.define(t, last)
        elif last == "type" and after in ("=", "<") and get(i - 2) in ("", ";", "}", "{", "export", "declare", ")") and language == "typescript":
            found.define(t, "typedef")
        elif last == "function" or last == "*" and get(i - 2) == "function":
            found.define(t, "function")
            if after == "(":
                params(i + 1)
        elif last in ("const", "let", "var"):
            found.define(t, "variable")
            j, level = i + 1, 0
            while j < n and not (level == 0 and (tokens[j].text in (";", ")", "}") or tokens[j].text in ("of", "in") or "\n" in text[tokens[j - 1].end : tokens[j].start] and tokens[j].kind == "name" and tokens[j - 1].text not in (",", "=", "+", "(", "?", ":", "&&", "||", "=>"))):
                level += (tokens[j].text in ("(", "[", "{")) - (tokens[j].text in (")", "]", "}"))
                if tokens[j].text == "," and level == 0 and j + 1 < n and tokens[j + 1].kind == "name":
                    found.define(tokens[j + 1], "variable")
                j += 1
        elif after == "(" and found.name(t) and last not in (".", "new", "function"):
            end = _close(tokens, i + 1)
            inside = bool(classes) and classes[-1] == depth
            j = end + 1
            if inside and get(j) == ":":
                while j < n and tokens[j].text not in ("{", ";", "}"):
                    j += 1
            if get(j) == "{" and (inside or last in ("{", ",", "async", "get", "set", "*", "static", "")) and (inside or last != ""):
                found.define(t, "method")
                params(i + 1)
        elif classes and classes[-1] == depth and (after in (":", "=", ";") or after in ("?", "!") and get(i + 2) in (":", "=", ";")) and last in ("{", ";", "}", "public", "private", "protected", "readonly", "static", "declare", "#"):
            found.define(t, "variable")
        elif classes and classes[-1] == depth and language == "javascript" and after in ("}",) and last in ("{", ";", "}"):
            found.define(t, "variable")
        if t.text == "class":
            pending = True
    return found.result()


_CPP_TYPES = frozenset("void int char bool float double long short unsigned signed auto".split())
_JAVA_TYPES = frozenset("void int char boolean byte short long float double".split())
_QUALIFIERS = frozenset("""const constexpr static virtual inline extern register volatile mutable friend typename explicit public private protected final abstract
synchronized native transient default struct class enum union""".split())


def _c_family(language: str, text: str) -> list[Occurrence]:
    """C++ and Java: scopes by braces, definitions by what may stand at the head of a statement."""
    found, tokens = _Found(language), _tokens(language, text)
    types = _CPP_TYPES if language == "cpp" else _JAVA_TYPES
    n = len(tokens)
    get = lambda i: tokens[i].text if 0 <= i < n else ""
    isname = lambda i: 0 <= i < n and found.name(tokens[i]) and tokens[i].text not in _CPP_MORE
    scopes, pending = [], None  # what each open brace is: type, enum, namespace or body

    def angles(i: int) -> int:
        """Past a list of type arguments at ``i``, or ``i`` if it is none."""
        if get(i) != "<":
            return i
        level, j = 0, i
        while j < n and get(j) not in (";", "{", "}"):
            level += (get(j) == "<") - (get(j) == ">")
            j += 1
            if level == 0:
                return j
        return i

    def a_type(i: int) -> int:
        """Past a type at ``i``, or ``i`` if there is none."""
        j = i
        while get(j) in _QUALIFIERS:
            j += 1
        k = j
        while get(k) in types:
            k += 1
        if k == j:
            if not isname(j):
                return i
            k = angles(j + 1)
            while get(k) in ("::", ".") and isname(k + 1):
                k = angles(k + 2)
        while get(k) in ("*", "&", "&&", "const", "...") or get(k) == "[" and get(k + 1) == "]":
            k += 2 if get(k) == "[" else 1
        return k

    def params(at: int) -> int:
        end = _close(tokens, at)
        for part in _parts(tokens, at + 1, end, angle=True):
            part = [t for t in part if t.text not in ("const", "final")]
            head, k = [], 0
            while k < len(part) and part[k].text != "=":
                if part[k].text == "[":
                    if k + 1 < len(part) and part[k + 1].text == "]":
                        k += 2
                        continue
                    break
                head.append(part[k])
                k += 1
            star = next((k for k, t in enumerate(head) if t.text == "(" and k + 1 < len(head) and head[k + 1].text == "*"), None)
            if star is not None and star + 2 < len(head):
                found.define(head[star + 2], "variable")
            elif len(head) > 1 and head[-1].kind == "name" and head[-2].text not in ("::", "."):
                found.define(head[-1], "variable")
        return end

    def declarators(i: int, category: str) -> None:
        """``i``: the first name of a declaration; more follow commas."""
        found.define(tokens[i], category)
        level, j = 0, i + 1
        while j < n and not (level <= 0 and get(j) in (";", "{", "}", ")", ":")):
            level += (get(j) in ("(", "[", "{")) - (get(j) in (")", "]", "}"))
            if get(j) == "," and level == 0:
                k = j + 1
                while get(k) in ("*", "&"):
                    k += 1
                if isname(k):
                    found.define(tokens[k], category)
            j += 1

    def enum_body(at: int) -> int:
        end = _close(tokens, at)
        stop = next((k for k in range(at, end) if get(k) == ";"), end) if language == "java" else end
        for part in _parts(tokens, at + 1, stop):
            while len(part) > 2 and part[0].text == "@":
                part = part[2:]
            found.define(part[0], "enum_member")
        return stop

    i, fresh = 0, True
    while i < n:
        t = tokens[i]
        found.use(t)
        in_type = bool(scopes) and scopes[-1] == "type"
        in_body = bool(scopes) and scopes[-1] == "body"
        if t.text == "{":
            scopes.append(pending or ("body"))
            pending, fresh = None, True
        elif t.text == "}":
            if scopes:
                scopes.pop()
            fresh = True
        elif t.text == ";":
            fresh, pending = True, None
        elif t.text in ("class", "struct", "interface", "namespace", "enum", "record") and isname(i + 1 + (t.text == "enum" and get(i + 1) in ("class", "struct"))) and get(i - 1) not in ("<", ",", "friend", "enum", "::", "."):
            at = i + 1 + (t.text == "enum" and get(i + 1) in ("class", "struct"))
            after = angles(at + 1)
            if get(after) in ("{", ":", "final", "extends", "implements", "permits", "(", ";", "", "::") and not (get(after) == "(" and t.text != "record") and (t.text != "namespace" or get(after) in ("{", "::")):
                found.define(tokens[at], {"struct": "struct", "record": "class"}.get(t.text, t.text))
                if get(after) != ";":
                    pending = "enum" if t.text == "enum" else "namespace" if t.text == "namespace" else "type"
                    if t.text == "enum":
                        brace = next((k for k in range(after, n) if get(k) in ("{", ";")), n)
                        if get(brace) == "{":
                            enum_body(brace)
                            pending = "type" if language == "java" else "enum"
                fresh = False
        elif language == "cpp" and t.text == "using" and isname(i + 1) and get(i + 2) == "=":
            found.define(tokens[i + 1], "typedef")
        elif language == "cpp" and t.text == "typedef":
            end = next((k for k in range(i, n) if get(k) == ";"), n)
            start = next((k for k in range(i, end) if get(k) == "}"), i)
            for part in _parts(tokens, start + 1, end, angle=True):
                star = next((k for k, x in enumerate(part) if x.text == "(" and k + 1 < len(part) and part[k + 1].text in ("*", "&")), None)
                if star is not None and star + 2 < len(part):
                    found.define(part[star + 2], "typedef")
                    continue
                names = [x for k, x in enumerate(part) if found.name(x) and not any(y.text == "[" for y in part[:k])]
                if names:
                    found.define(names[-1], "typedef")
            for k in range(i, end):
                found.use(tokens[k])
            i = end
            continue
        elif language == "cpp" and t.text == "template" and get(i + 1) == "<":
            end = angles(i + 1)
            for k in range(i, end):
                found.use(tokens[k])
            i = end
            continue
        elif t.text in ("public", "private", "protected") and get(i + 1) == ":":
            i += 2
            fresh = True
            continue
        elif t.text == "@" and isname(i + 1):  # an annotation
            end = i + 2
            if get(end) == "(":
                end = _close(tokens, end) + 1
            for k in range(i, end):
                found.use(tokens[k]) if k < n else None
            i = end
            continue
        elif t.text in ("for", "try") and get(i + 1) == "(" and get(i + 2) != ")":
            j = a_type(i + 2)
            if j > i + 2 and isname(j) and get(j + 1) in ("=", ":", ";", ",", "{"):
                declarators(j, "variable")
            fresh = False
        elif fresh:
            j = a_type(i)
            name = j
            while isname(name) and get(name + 1) == "::" and (isname(name + 2) or get(name + 2) == "~"):
                name += 2 + (get(name + 2) == "~")
            constructor = in_type and isname(j - 1) and get(j) == "(" and not isname(name)
            qualified = False
            if constructor:  # a name and its parameters, without a type
                name = j - 1
            elif j > i and get(j) == "(" and j - 2 >= i and get(j - 2) in ("::", "~") and isname(j - 1):
                name, qualified = j - 1, True
            elif get(name - 1) in ("::", "~") and name > j:
                qualified = True
            if j > i and isname(name) and get(name + 1) == "(" and not (in_body and not qualified and language == "java"):
                end = _close(tokens, name + 1)
                follow = get(end + 1)
                if in_body and not qualified:
                    if follow in (";", ",") and not constructor:
                        declarators(name, "variable")
                elif follow in ("{", ";", "const", "override", "noexcept", "throws", "=", ":", "final", "->", "default"):
                    found.define(tokens[name], "method" if in_type or qualified else "function")
                    params(name + 1)
                    for k in range(i, min(end + 1, n)):
                        found.use(tokens[k])
                    pending = "body"
                    i, fresh = end + 1, False
                    continue
            elif j > i and isname(j) and get(j + 1) in ("=", ";", ",", "[", "{", ":") and get(j - 1) not in ("::", "."):
                declarators(j, "variable")
            fresh = t.text in _QUALIFIERS and j == i
        if t.text not in ("{", "}", ";") and not (t.text in _QUALIFIERS and fresh):
            fresh = False
        i += 1
    return found.result()


def occurrences(language: str | None, text: str | None) -> list[Occurrence]:
    """All identifiers of a text in order; none for a language without a recogniser."""
    if not text:
        return []
    if language == "python":
        return _python(text)
    if language in ("javascript", "typescript"):
        return _js(language, text)
    if language in ("cpp", "java"):
        return _c_family(language, text)
    return []


def is_ignored(language: str, name: str) -> bool:
    """Dunder names, reserved words and names with a meaning of their own."""
    return len(name) > 4 and name.startswith("__") and name.endswith("__") or name in RESERVED.get(language, ()) or name in _SPECIAL.get(language, ())
