"""Finds functions in JavaScript text, in plain Python.

A tokenizer with a stack of open brackets decides what each brace, slash and
back-quote means and matches brackets; then the members of every object
literal and class body are read from its top-level tokens. Nothing recurses,
so deep nesting is no danger, and each token is looked at a few times at most.

`extract(text)` gives the character spans of

- methods with a plain identifier name, in object literals and classes, from
  their first modifier to the closing brace;
- arrow functions and function expressions that are the whole value of a
  property with a plain identifier key.

If the text calls `<expr>.extend(..., {...})` with an object literal as last
argument and something before it, only functions inside the first such object
count.

Broken text is read on: a character that fits nowhere and a bracket that
closes nothing are passed over, a string without an end stops at its line's
end, and what is left open ends with what encloses it, though a function
without its last brace is none. `problems(text)` lists what was mended. Markup
in the place of a value is read as one value, and the code in its braces like
any other.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

_SKIP = re.compile(r"[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/", re.S)
_NAME = re.compile(r"(?:[^\W\d]|\$|\\u\{?[0-9a-fA-F]+\}?)(?:[\w$\u200c\u200d]+|\\u\{?[0-9a-fA-F]+\}?)*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?n?")
_STRING = re.compile(r'"(?:[^"\\\n\r]|\\(?:\r\n|.))*"' + r"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*'", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+/[\w$]*")
_LINE = re.compile(r"[^\n\r]*")
_ANY = re.compile(r".", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_TAG = re.compile(r"""[\s\ufeff]+|/\*.*?\*/|//[^\n\r]*|[\w$.:=-]+|"[^"]*"|'[^']*'""", re.S)
_MARKUP = re.compile(r"<(?:[^\W\d]|[$>])")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$")
_SINGLE = frozenset("()[]{},;:")  # signs that no longer one begins with
_SIGN = re.compile(r"\.\.\.|=>|\?\.(?!\d)|\+\+|--|[^\w\s]")

#: Digits that stand by themselves. How many there are and which is nothing to the parser, in whatever they stand.
_DIGITS = re.compile(r"([0-9](?<![\w$\\.][0-9])[0-9]*+)(?![\w$.])")
#: Texts up to this length are parsed once for all that differ in such digits alone; so many of them are remembered.
ALIKE_CHARS, ALIKE_TEXTS = 8192, 512

_BEFORE_VALUE = frozenset("return typeof case in of instanceof new void delete throw yield await default const let var import export extends do else".split())
_BEFORE_BLOCK = frozenset("else do try finally catch".split())
_CONTROL = frozenset("if while for with".split())
_MODIFIERS = frozenset("async get set static accessor".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}

NAME, PROPERTY, PRIVATE, NUMBER, STRING, REGEX, SIGN = range(7)
_WORDED = (SIGN, NAME, PROPERTY)


class _Frame:
    __slots__ = ("open", "kind", "ternaries", "in_class", "control", "value")

    def __init__(self, open_: int, kind: str, control: bool = False, value: bool = False):
        self.open, self.kind = open_, kind
        self.ternaries = 0
        self.in_class = False  # a class header has begun and its body is still to come
        self.control = control  # parentheses of if, while, for, with
        self.value = value  # of a function that is a value, not a declaration


class Tokens:
    """Tokens of a text, with matching brackets and what each brace opens."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] = []
        self.end: list[int] = []
        self.kind: list[int] = []
        self.word: list[str] = []
        self.fresh: list[bool] = []  # a line end stands before the token
        self.match: dict[int, int] = {}
        self.braces: dict[int, str] = {}  # opening token to block, object or class
        self.unclosed: set[int] = set()  # opening tokens whose `match` is only where they had to end
        self.problems: list[tuple[int, str]] = []
        self._scan()

    def __len__(self) -> int:
        return len(self.start)

    def is_(self, i: int, word: str) -> bool:
        return 0 <= i < len(self.word) and self.word[i] == word and self.kind[i] in _WORDED

    def _statement_start(self, i: int, ended: bool) -> bool:
        """Whether a token after token i begins a statement; `ended`: i ends an expression."""
        if i < 0:
            return True
        word = self.word[i]
        if self.kind[i] == SIGN:
            if word == "{":
                return self.braces.get(i) != "object"
            return word == ";" or word in "})" and not ended
        return self.kind[i] == NAME and word in ("else", "do", "export", "default")

    def _scan(self) -> None:
        text, n = self.text, len(self.text)
        at = 0
        if text.startswith("#!"):
            at = text.find("\n") if "\n" in text else n
        frames = [_Frame(-1, "block")]
        ended = False  # the last token ends an expression
        label = False  # the last token is the colon of a label or case
        fresh = False

        starts, words, kinds = self.start, self.word, self.kind
        put_start, put_end, put_kind, put_word, put_fresh = starts.append, self.end.append, kinds.append, words.append, self.fresh.append

        def add(kind: int, a: int, b: int) -> int:
            nonlocal fresh
            put_start(a)
            put_end(b)
            put_kind(kind)
            put_word(text[a:b])
            put_fresh(fresh)
            fresh = False
            return len(starts) - 1

        while True:
            top = frames[-1]
            if top.kind == "template":
                m = _TEMPLATE.match(text, at)
                at = m.end()
                if text.startswith("${", at):
                    frames.append(_Frame(add(SIGN, at, at + 2), "hole"))
                    at += 2
                    ended = False
                elif text.startswith("`", at):
                    i = add(SIGN, at, at + 1)
                    self.match[top.open] = i
                    self.match[i] = top.open
                    frames.pop()
                    at += 1
                    ended = True
                else:
                    self.problems.append((self.start[top.open], "a template does not end"))
                    self._leave(frames.pop(), len(self.start))
                continue
            if top.kind == "markup":
                at = next((k for k in range(at, n) if text[k] in "<{"), n) if text[at : at + 1] not in ("<", "{") else at
                if at >= n:
                    break
                if text[at] == "{":
                    frames.append(_Frame(add(SIGN, at, at + 1), "hole"))
                    at += 1
                    ended = False
                elif text.startswith("</", at):
                    at = text.find(">", at)
                    if at < 0:
                        at = n
                        break
                    self._pair(frames.pop(), add(SIGN, at, at + 1))
                    at += 1
                    ended = True
                else:
                    frames.append(_Frame(add(SIGN, at, at + 1), "tag"))
                    at += 1
                continue
            if top.kind == "tag":
                m = _TAG.match(text, at)
                if m:
                    at = m.end()
                elif at >= n:
                    break
                elif text.startswith("/>", at):
                    self._pair(frames.pop(), add(SIGN, at + 1, at + 2))
                    at += 2
                    ended = True
                elif text[at] == ">":
                    top.kind = "markup"
                    at += 1
                elif text[at] == "{":
                    frames.append(_Frame(add(SIGN, at, at + 1), "hole"))
                    at += 1
                    ended = False
                else:
                    self.problems.append((at, f"unexpected {text[at]!r}"))
                    at += 1
                continue
            if at >= n:
                break
            c = text[at]
            if c <= " " or c == "/" or c > "~":  # all that white space and comments begin with
                m = _SKIP.match(text, at)
                if m:
                    fresh = fresh or "\n" in m[0] or "\r" in m[0]
                    at = m.end()
                    continue
            last = len(starts) - 1
            before = words[last] if last >= 0 else ""
            letter = c in _LETTERS
            if not letter and c in "\"'":
                m = _STRING.match(text, at)
                if not m:
                    self.problems.append((at, "a string does not end"))
                    m = _LINE.match(text, at)
                add(STRING, at, m.end())
                ended = True
            elif not letter and (c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit()):
                m = _NUMBER.match(text, at) or _ANY.match(text, at)
                add(NUMBER, at, m.end())
                ended = True
            elif (letter or c > "~" or c == "\\") and (m := _NAME.match(text, at)):
                named = before in (".", "?.") and kinds[last] == SIGN or top.kind == "object" and last >= 0 and (last == top.open or before == "," and self.kind[last] == SIGN)
                add(PROPERTY if named else NAME, at, m.end())
                if not named and m[0] == "class":
                    top.in_class = True
                ended = named or m[0] not in _BEFORE_VALUE
            elif c == "#":
                m = _NAME.match(text, at + 1)
                if not m:
                    self.problems.append((at, "unexpected '#'"))
                    at += 1
                    continue
                add(PRIVATE, at, m.end())
                ended = True
            elif text.startswith("/*", at):
                self.problems.append((at, "a comment does not end"))
                break
            elif c == "/" and not ended and (m := _REGEX.match(text, at)):
                add(REGEX, at, m.end())
                ended = True
            elif c == "<" and not ended and _MARKUP.match(text, at):
                frames.append(_Frame(add(SIGN, at, at + 1), "tag"))
                at += 1
                if text[at] == ">":  # a fragment has no name
                    frames[-1].kind = "markup"
                    at += 1
                continue
            elif c == "`":
                i = add(SIGN, at, at + 1)
                frames.append(_Frame(i, "template"))
                at += 1
                continue
            else:
                m = None if c in _SINGLE else _SIGN.match(text, at)
                if not m and c not in _SINGLE or c in _CLOSES and not self._closes(frames, c):
                    self.problems.append((at, f"unexpected {c!r}"))
                    at += 1
                    continue
                if c == "/" and not ended:
                    self.problems.append((at, "a pattern does not end"))
                sign = m[0] if m else c
                end = at + len(sign)
                i = add(SIGN, at, end)
                if sign == "(":
                    control = last >= 0 and self.kind[last] == NAME and (before in _CONTROL or before == "await" and self.is_(last - 1, "for"))
                    frames.append(_Frame(i, "(", control))
                    ended = False
                elif sign == "[":
                    frames.append(_Frame(i, "["))
                    ended = False
                elif sign == "{":
                    kind, value = self._brace(top, last, label)
                    self.braces[i] = kind
                    frames.append(_Frame(i, kind, value=value))
                    ended = False
                elif sign in _CLOSES:
                    while not self._fits(frames[-1], sign):
                        self.problems.append((self.start[frames[-1].open], "a bracket is not closed"))
                        self._leave(frames.pop(), i)
                    frame = frames.pop()
                    self._pair(frame, i)
                    ended = frame.kind in ("[", "object") or frame.value or frame.kind == "(" and not frame.control
                elif sign in ("++", "--"):
                    pass  # after a value it ends one, before a value it doesn't
                elif sign == "?":
                    top.ternaries += 1
                    ended = False
                elif sign == ":":
                    label = top.kind in ("block", "hole") and not top.ternaries
                    top.ternaries = max(0, top.ternaries - 1)
                    ended = False
                    at = end
                    continue
                else:
                    ended = False
                    if sign in (";", ","):
                        top.ternaries = 0
                label = False
                at = end
                continue
            label = False
            at = m.end()
        for frame in frames[1:]:
            self.problems.append((self.start[frame.open], "a bracket is not closed"))
            self._leave(frame, len(self.start))

    def _pair(self, frame: _Frame, close: int) -> None:
        self.match[frame.open] = close
        self.match[close] = frame.open

    def _leave(self, frame: _Frame, end: int) -> None:
        """Ends what is not closed before token `end`."""
        self.match[frame.open] = end
        self.unclosed.add(frame.open)

    @staticmethod
    def _fits(frame: _Frame, sign: str) -> bool:
        return frame.kind in ("block", "object", "class", "hole") if sign == "}" else frame.kind == _CLOSES[sign]

    def _closes(self, frames: list[_Frame], sign: str) -> bool:
        """Whether a closing sign has an open one: braces end what is open inside them, other brackets don't end braces."""
        for frame in reversed(frames[1:]):
            if self._fits(frame, sign):
                return True
            if frame.kind not in ("(", "["):
                return False
        return False

    def _function_value(self, last: int) -> bool:
        """Whether parentheses after token `last` are the parameters of a function that is a value."""
        i = last
        if i >= 0 and self.kind[i] == NAME and self.word[i] != "function":
            i -= 1
        if self.is_(i, "*"):
            i -= 1
        if not (self.is_(i, "function") and self.kind[i] == NAME):
            return False
        i -= 1
        if self.is_(i, "async") and self.kind[i] == NAME:
            i -= 1
        ended = self.is_(i, "}") and self.braces.get(self.match.get(i, -1)) == "object" or self.is_(i, ")") and not self._control(i)
        return not self._statement_start(i, ended)

    def _control(self, close: int) -> bool:
        before = self.match.get(close, 0) - 1
        return before >= 0 and self.kind[before] == NAME and self.word[before] in _CONTROL

    def _brace(self, top: _Frame, last: int, label: bool) -> tuple[str, bool]:
        """What a brace after token `last` opens, and whether its end ends an expression."""
        if top.in_class:
            top.in_class = False
            return "class", False
        if last < 0 or label:
            return "block", False
        word, kind = self.word[last], self.kind[last]
        if kind == SIGN:
            if word == ")":
                return "block", self._function_value(self.match[last] - 1)
            if word == "=>":
                return "block", True
            if word in (";", "}", "]", "`") or word == "{" and self.braces.get(last) in ("block", "class"):
                return "block", False
            return "object", False
        if kind == NAME and word in _BEFORE_VALUE and word not in _BEFORE_BLOCK:
            return "object", False
        return "block", False


def _next_comma(t: Tokens, i: int, close: int) -> int:
    """The first comma at top level from i on, or `close`."""
    while i < close:
        if t.kind[i] == SIGN:
            if t.word[i] == ",":
                return i
            if t.match.get(i, -1) > i:
                i = t.match[i]
        i += 1
    return close


def _scope(t: Tokens) -> tuple[int, int] | None:
    """The object of the first `.extend(..., {...})` call, as its tokens."""
    for i in range(1, len(t) - 1):
        if t.word[i] != "extend" or t.kind[i] != PROPERTY or not (t.is_(i - 1, ".") or t.is_(i - 1, "?.")):
            continue
        call = i + 2 if t.is_(i + 1, "?.") else i + 1
        if not t.is_(call, "(") or _constructed(t, i - 1):
            continue
        close = t.match[call]
        starts = [call + 1]
        while (comma := _next_comma(t, starts[-1], close)) < close:
            starts.append(comma + 1)
        if starts[-1] == close:
            starts.pop()  # a trailing comma
        if len(starts) < 2:
            continue
        first = starts[-1]
        last = _next_comma(t, first, close) - 1
        if t.braces.get(first) == "object" and t.match[first] == last:
            return first, last
    return None


def _constructed(t: Tokens, dot: int) -> bool:
    """Whether the member chain before `dot` is the callee of `new`."""
    i = dot - 1
    while i >= 0:
        if t.kind[i] == SIGN and t.word[i] == "]" and t.match.get(i, -1) > 0:
            i = t.match[i] - 1
            continue
        if t.kind[i] not in (NAME, PROPERTY, PRIVATE):
            return False
        if t.is_(i - 1, ".") or t.is_(i - 1, "?."):
            i -= 2
            continue
        return i > 0 and t.is_(i - 1, "new") and t.kind[i - 1] == NAME
    return False


def _function_end(t: Tokens, i: int, close: int) -> int | None:
    """The last token of the function that is the whole value from i on, if there is one."""
    j = i
    if t.is_(j, "async") and not t.is_(j + 1, "=>") and j + 1 < close:
        j += 1
    if t.is_(j, "function"):
        if t.is_(j + 1, "*"):
            return None
        k = j + 1 if t.is_(j + 1, "(") else j + 2
        if not t.is_(k, "("):
            return None
        body = t.match[k] + 1
        end = t.match[body] if t.is_(body, "{") and body not in t.unclosed else None
    else:
        if t.is_(j, "("):
            arrow = t.match[j] + 1
        elif t.kind[j] in (NAME, PROPERTY):
            arrow = j + 1
        else:
            return None
        if not t.is_(arrow, "=>"):
            return None
        body = arrow + 1
        end = t.match[body] if t.is_(body, "{") else _next_comma(t, body, close) - 1
        if body in t.unclosed or end < body:
            return None
    if end is None or not (end + 1 == close or t.is_(end + 1, ",")):
        return None
    return end


def _member(t: Tokens, i: int, close: int) -> tuple[int, int, bool]:
    """From the first token of a member: where its name is, where the name ends, whether it is a plain identifier."""
    while i < close:
        if t.is_(i, "*"):
            i += 1
        elif t.word[i] in _MODIFIERS and t.kind[i] in (NAME, PROPERTY) and i + 1 < close and not (t.kind[i + 1] == SIGN and t.word[i + 1] in "(,:=;}"):
            i += 1
        else:
            break
    if i < close and t.is_(i, "["):
        return i, t.match[i], False
    return i, i, i < close and t.kind[i] in (NAME, PROPERTY)


def _object_members(t: Tokens, open_: int, spans: list[tuple[int, int]]) -> None:
    close = t.match[open_]
    i = open_ + 1
    while i < close:
        first = i
        name, end, plain = _member(t, i, close)
        if name < close and t.is_(end + 1, "(") and t.is_(t.match[end + 1] + 1, "{"):
            body = t.match[t.match[end + 1] + 1]
            if plain and t.match[end + 1] + 1 not in t.unclosed:
                spans.append((t.start[first], t.end[body]))
            i = _next_comma(t, body + 1, close) + 1
            continue
        if first == name and plain and t.is_(end + 1, ":") and end + 2 < close:
            last = _function_end(t, end + 2, close)
            if last is not None:
                spans.append((t.start[end + 2], t.end[last]))
        i = _next_comma(t, i, close) + 1


def _class_members(t: Tokens, open_: int, spans: list[tuple[int, int]]) -> None:
    close = t.match[open_]
    i = open_ + 1
    while i < close:
        if t.is_(i, ";"):
            i += 1
            continue
        first = i
        while t.is_(i, "@"):  # decorators
            i += 2
            while t.is_(i, "."):
                i += 2
            if t.is_(i, "("):
                i = t.match[i] + 1
        if t.is_(i, "static") and t.is_(i + 1, "{"):
            i = t.match[i + 1] + 1
            continue
        name, end, plain = _member(t, i, close)
        if name < close and t.is_(end + 1, "(") and t.is_(t.match[end + 1] + 1, "{"):
            body = t.match[t.match[end + 1] + 1]
            if plain and t.match[end + 1] + 1 not in t.unclosed:
                spans.append((t.start[first], t.end[body]))
            i = body + 1
            continue
        i = end + 1
        value_ended = True
        while i < close and not t.is_(i, ";"):  # a field, up to a semicolon or a line end that stands for one
            if t.fresh[i] and value_ended and (t.kind[i] != SIGN or t.word[i] == "@") and t.word[i] not in ("in", "instanceof"):
                break
            value_ended = t.kind[i] != SIGN or t.word[i] in ")]}`" or t.word[i] in ("++", "--")
            i = t.match[i] if t.match.get(i, -1) > i else i
            value_ended = value_ended or i < len(t) and t.kind[i] == SIGN and t.word[i] in ")]}`"
            i += 1


def extract(text: str) -> list[tuple[int, int]]:
    """Character spans of the functions, in order of their start."""
    t = Tokens(text)
    inside = _scope(t) or (-1, len(t))
    spans: list[tuple[int, int]] = []
    for open_, kind in t.braces.items():
        if inside[0] <= open_ <= inside[1]:
            if kind == "object":
                _object_members(t, open_, spans)
            elif kind == "class":
                _class_members(t, open_, spans)
    return sorted(set(spans))


def problems(text: str) -> list[tuple[int, str]]:
    """Line and kind of whatever is broken in a text, in order."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return [(bisect_left(ends, at) + 1, what) for at, what in sorted(Tokens(text).problems)]


def _placed(text: str) -> list[tuple[int, int, int, int]]:
    """Span and first and last line of each function."""
    spans = extract(text)
    if not spans:
        return []
    ends = [m.start() for m in re.finditer("\n", text)]
    return [(a, b, bisect_left(ends, a) + 1, bisect_left(ends, b) + 1) for a, b in spans]


@lru_cache(ALIKE_TEXTS)
def _placed_alike(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """The same of a text in which one digit stands for many, with the runs of digits before start and end."""
    runs = [m.start() for m in _DIGITS.finditer(text)]
    return [(a, b, bisect_left(runs, a), bisect_left(runs, b), first, last) for a, b, first, last in _placed(text)]


def fragments(text: str) -> list[tuple[str, int, int]]:
    """Code and first and last line of each function."""
    if len(text) > ALIKE_CHARS:
        return [(text[a:b], first, last) for a, b, first, last in _placed(text)]
    parts = _DIGITS.split(text)
    found = _placed_alike("0".join(parts[::2]))
    if not found:
        return []
    more = list(accumulate((len(p) - 1 for p in parts[1::2]), initial=0))
    return [(text[a + more[i] : b + more[j]], first, last) for a, b, i, j, first, last in found]
