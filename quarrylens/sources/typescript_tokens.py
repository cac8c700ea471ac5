"""What one TypeScript or JavaScript file declares, from its tokens and a stack of brackets. A small helper for tasks.

The lexer keeps a stack of modes, since code stands inside templates and JSX, and these inside code. Declarations are then found by what stands around a pair of brackets.
"""

from __future__ import annotations

import hashlib
import re

_CODE = re.compile(
    r"""(?P<doc>/\*\*[\s\S]*?\*/)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<tick>`)|(?P<number>\d[\w.]*)"""
    r"""|(?P<decorator>@[A-Za-z_$][\w$.]*)|(?P<name>\#?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<space>\s+)|(?P<op>=>|\?\?=?|\?\.(?!\d)|&&=?|\|\|=?|[=!]==?|\.\.\.|\+\+|--|[-+*/%&|^]=|[\s\S])"""
)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TAG = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*)")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
#: Words after which an expression begins, so a slash begins a pattern and ``<`` a tag.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof", "default", "extends"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with"}
_BRANCH = {"if", "else", "for", "while", "do", "catch", "case"}
_MODIFIERS = {"export", "default", "async", "abstract", "declare", "public", "private", "protected", "static", "readonly", "override", "get", "set", "const", "let", "var", "function", "*", "accessor"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}$"}, {")", "]", "}", "}$"}
_KEYWORDS = {"var", "let", "const", "function", "class", "interface", "import", "from", "as", "any", "unknown", "try", "finally", "true", "false", "null", "undefined", "this", "super", "break", "continue", "type", "enum"} | _BEFORE_VALUE | _BRANCH | _CONTROL


class Tokens:
    """kind, value and line of each token; where a doc comment stands before it; the comments."""

    def __init__(self, text: str, jsx: bool):
        self.kind: list[str] = []
        self.value: list[str] = []
        self.line: list[int] = []
        self.doc: list[bool] = []
        self.comments: list[tuple[int, str]] = []
        self.documented = False
        self._read(text, jsx)
        self.match, self.parent, self.balanced = self._brackets()

    def _add(self, kind: str, value: str, line: int) -> None:
        self.kind.append(kind)
        self.value.append(value)
        self.line.append(line)
        self.doc.append(self.documented)
        self.documented = False

    def _value_next(self) -> bool:
        """Whether an expression may begin here."""
        if not self.kind:
            return True
        kind, value = self.kind[-1], self.value[-1]
        return value in _BEFORE_VALUE if kind == "name" else kind == "op" and value not in (")", "]", "}", "}$", "++", "--")

    def _read(self, text: str, jsx: bool) -> None:
        at, line, modes = 0, 1, [["code", 0]]  # code: braces open; template; jsx: tags open, inside a tag, a closing one
        while at < len(text):
            mode = modes[-1]
            if mode[0] == "template":
                end = at
                while end < len(text) and text[end] != "`" and text[end : end + 2] != "${":
                    end += 2 if text[end] == "\\" else 1
                line += text.count("\n", at, end)
                if text[end : end + 1] == "`":
                    modes.pop()
                    at = end + 1
                else:
                    if end < len(text):
                        self._add("op", "${", line)
                        modes.append(["code", 0])
                    at = end + 2
            elif mode[0] == "jsx":
                at, line = self._jsx(text, at, line, modes)
            else:
                m = _CODE.match(text, at)
                kind, value = m.lastgroup, m.group()
                if value == "/" and self._value_next() and (r := _REGEX.match(text, at)):
                    kind, value = "string", r.group()
                if value == "<" and jsx and self._value_next() and _TAG.match(text, at):
                    self._add("string", "<jsx>", line)
                    modes.append(["jsx", 0, True, False])
                    at += 1
                    continue
                at += len(value)
                if kind == "tick":
                    self._add("string", "`", line)
                    modes.append(["template"])
                elif kind in ("doc", "comment"):
                    self.comments.append((line, value))
                    self.documented = kind == "doc"
                elif value == "}" and mode[1] == 0 and len(modes) > 1:
                    modes.pop()
                    self._add("op", "}$", line)
                elif kind != "space":
                    mode[1] += (value == "{") - (value == "}")
                    self._add(kind, value, line)
                line += value.count("\n")

    def _jsx(self, text: str, at: int, line: int, modes: list) -> tuple[int, int]:
        mode, c = modes[-1], text[at]
        step = 1
        if c == "{":
            self._add("op", "${", line)
            modes.append(["code", 0])
        elif mode[2]:
            if c in "\"'" and (m := _JSX_STRING.match(text, at)):
                step = len(m.group())
            elif text[at : at + 2] == "/>":
                step, mode[2] = 2, False
                if mode[1] == 0:
                    modes.pop()
            elif c == ">" and text[at - 1] != "=":
                mode[1] += -1 if mode[3] else 1
                mode[2] = mode[3] = False
                if mode[1] <= 0:
                    modes.pop()
        elif c == "<":
            mode[2], mode[3] = True, text[at : at + 2] == "</"
            step = 1 + mode[3]
        return at + step, line + text.count("\n", at, at + step)

    def _brackets(self) -> tuple[dict[int, int], list[int], bool]:
        match, parent, stack, good = {}, [], [], True
        for i, v in enumerate(self.value):
            op = self.kind[i] == "op"
            if op and v in _CLOSE:
                if stack and _OPEN[self.value[stack[-1]]] == v:
                    match[stack[-1]] = i
                    match[i] = stack.pop()
                else:
                    good = False
            parent.append(stack[-1] if stack else -1)
            if op and v in _OPEN:
                stack.append(i)
        return match, parent, good and not stack

    def at(self, i: int) -> str:
        return self.value[i] if 0 <= i < len(self.value) else ""

    def begin(self, i: int) -> int:
        """The first token of a declaration's modifiers and decorators."""
        while True:
            if self.at(i - 1) in _MODIFIERS:
                i -= 1
            elif i > 0 and self.kind[i - 1] == "decorator":
                i -= 1
            elif self.at(i - 1) == ")" and (m := self.match.get(i - 1, 0)) > 0 and self.kind[m - 1] == "decorator":
                i = m - 1
            else:
                return i

    def type_end(self, i: int) -> int:
        """Past a type that begins at i: up to an arrow, a body, or what ends a declaration."""
        angle, first = 0, True
        while i < len(self.value):
            v = self.value[i]
            if v in ("(", "[") or (v == "{" and (first or self.at(i - 1) in ("|", "&", "<", ",", "=>"))):
                i = self.match.get(i, len(self.value)) + 1
            elif angle == 0 and (v in ("=>", "{", ";", ",", ")", "]", "}", "=", "}$")):
                return i
            else:
                angle += (v == "<") - (v == ">")
                i += 1
            first = False
        return i

    def before_generics(self, i: int) -> int:
        """From the token before an opening bracket, back over ``<...>``."""
        if self.at(i) == ">":
            depth = 0
            while i >= 0:
                depth += (self.value[i] == ">") - (self.value[i] == "<")
                i -= 1
                if depth == 0:
                    break
        return i

    def parts(self, open_: int) -> list[tuple[int, int]]:
        """Spans between the commas of a pair of brackets."""
        close, out, begin, angle = self.match.get(open_, len(self.value)), [], open_ + 1, 0
        i = begin
        while i < close:
            v = self.value[i]
            if v in _OPEN and self.kind[i] == "op":
                i = self.match.get(i, close)
            elif v == "," and angle == 0:
                out.append((begin, i))
                begin = i + 1
            elif self.kind[i] == "op" and v in "<>":
                angle = max(0, angle + (1 if v == "<" else -1))
            i += 1
        return [(a, b) for a, b in [*out, (begin, close)] if b > a]

    def statement_end(self, i: int) -> int:
        """The last token of an expression or type that begins at i."""
        while i < len(self.value):
            v = self.value[i]
            if self.kind[i] == "op" and v in _OPEN:
                i = self.match.get(i, len(self.value) - 1)
            following = self.at(i + 1)
            if following in ("", ";", ",", ")", "]", "}", "}$"):
                return min(i, len(self.value) - 1)
            carries = self.kind[i] == "op" and v not in (")", "]", "}", "}$", ">")
            if self.line[i + 1] > self.line[i] and not carries and not (self.kind[i + 1] == "op" and following not in ("{", "@", "<")):
                return i
            i += 1
        return len(self.value) - 1


def _parameters(t: Tokens, open_: int) -> list[str]:
    out = []
    for a, b in t.parts(open_):
        while a < b and (t.value[a] in _MODIFIERS or t.value[a] == "..." or t.kind[a] == "decorator"):
            a = t.match.get(a + 1, a) + 1 if t.kind[a] == "decorator" and t.at(a + 1) == "(" else a + 1
        if a < b and t.value[a] in ("{", "["):
            out.append(" ".join(t.value[a : t.match.get(a, b) + 1]))
        elif a < b and t.value[a] != "this":
            out.append(t.value[a])
    return out


def _branches(t: Tokens, a: int, b: int) -> int:
    n = 0
    for i in range(a, b + 1):
        v, before = t.value[i], t.at(i - 1)
        if t.kind[i] == "name" and v in _BRANCH and before not in (".", "?.") and t.at(i + 1) != ":":
            # The ``while`` of a ``do`` is no loop of its own.
            n += not (v == "while" and before == "}" and t.at(t.match.get(i - 1, 0) - 1) == "do")
        elif t.kind[i] == "op":
            n += v in ("&&", "||", "??") or (v == "?" and t.at(i + 1) not in (":", ",", ")", "=", "]"))
    return n


def _nesting(t: Tokens, a: int, b: int) -> int:
    best, depth, closes = 0, 0, []
    for i in range(a, b + 1):
        while closes and i > closes[-1]:
            closes.pop()
            depth -= 1
        if t.value[i] == "{" and t.kind[i] == "op":
            head = t.at(t.match.get(i - 1, 0) - 1) if t.at(i - 1) == ")" else t.at(i - 1)
            if head in _CONTROL | {"else", "do", "try", "finally"}:
                depth += 1
                closes.append(t.match.get(i, b))
                best = max(best, depth)
    return best


def _cognitive(t: Tokens, a: int, b: int) -> int:
    """One for each break in the flow, one more for each block of control that it lies in; a run of equal boolean operators counts one."""
    total, closes, last = 0, [], ""
    for i in range(a, b + 1):
        while closes and i > closes[-1]:
            closes.pop()
        v, before = t.value[i], t.at(i - 1)
        if t.kind[i] == "name" and v in _CONTROL - {"with"} | {"do"} and before not in (".", "?."):
            follows = v == "while" and before == "}" and t.at(t.match.get(i - 1, 0) - 1) == "do"
            total += 0 if follows else 1 if before == "else" else 1 + len(closes)
        elif v == "else" and t.kind[i] == "name" and t.at(i + 1) != "if":
            total += 1
        elif t.kind[i] == "op":
            if v == "?" and t.at(i + 1) not in (":", ",", ")", "=", "]"):
                total += 1 + len(closes)
            total += v in ("&&", "||", "??") and v != last
            if v == "{" and (t.at(t.match.get(i - 1, 0) - 1) if before == ")" else before) in _CONTROL | {"else", "do"}:
                closes.append(t.match.get(i, b))
        if v in ("&&", "||", "??", ";", "{", "}"):
            last = v
    return total


_EMPTY = {"false", "null", "undefined"}
_COMPARES = {"===", "!==", "==", "!=", "<", ">", "instanceof", "in"}


def _contract(t: Tokens, a: int, b: int, returns: str) -> dict:
    """What the names of functions may promise: a body that rejects, ensures, creates, answers yes or no, or tries."""
    words = [(i, t.value[i]) for i in range(a, b + 1) if t.kind[i] == "name" and t.at(i - 1) not in (".", "?.")]
    calls = {t.value[i] for i in range(a, b + 1) if t.kind[i] == "name" and t.at(i + 1) == "("}
    given = [(i + 1, t.statement_end(i + 1)) for i, v in words if v == "return" and t.at(i + 1) not in (";", "}", "")]
    if t.at(a) != "{":
        given = [(a, b)]
    throws = any(v == "throw" for _, v in words)
    empty = any(t.value[x] in _EMPTY and x == y for x, y in given)
    yes = lambda x, y: t.value[x] in ("!", "true", "false") or any(t.value[i] in _COMPARES and t.parent[i] == t.parent[x] for i in range(x, y + 1))
    sets = any(t.value[i] == "=" and t.at(i - 2) == "." for i in range(a, b + 1)) or bool(calls & {"set", "add", "push", "mkdir", "mkdirSync"})
    lead = next((i for i in range(a + 1, min(b, a + 2)) if t.value[i] == "if"), None) if t.at(a) == "{" else None
    leaves = t.match.get(lead + 1, b) + 1 if lead is not None else b
    return {
        "raises": throws or bool(given) or sets, "rejects": throws or empty or bool(calls & {"reject", "abort"}), "creates": any(v == "new" for _, v in words) or bool({c for c in calls if c.startswith(("create", "insert", "build", "make"))}),
        "boolean": returns in ("boolean", "Promise < boolean >") or " is " in f" {returns} " or (bool(given) and all(yes(*g) for g in given)), "tries": any(v == "try" for _, v in words) or "catch" in calls or empty or "null" in returns or "undefined" in returns,
        "guarded": lead is not None and (t.at(leaves) in ("return", "throw") or (t.at(leaves) == "{" and t.at(leaves + 1) in ("return", "throw"))),
        "exceptions": sorted({t.at(i + 2) for i, v in words if v == "throw" and t.at(i + 1) == "new"}), "cognitive": _cognitive(t, a, b),
        "positive": sum(t.value[i] == "expect" for i in range(a, b + 1)) - sum(t.value[i] in ("toThrow", "rejects", "not") for i in range(a, b + 1)), "negative": sum(t.value[i] in ("toThrow", "rejects", "not") for i in range(a, b + 1)),
    }


def _function(t: Tokens, name: str, begin: int, open_: int, params: list[str], returns: tuple[int, int] | None, body: int, end: int) -> dict:
    shape = ["n" if t.kind[i] == "name" and t.value[i] not in _KEYWORDS else "s" if t.kind[i] == "string" else "0" if t.kind[i] == "number" else t.value[i] for i in range(body, end + 1)]
    modifiers = {t.value[i] for i in range(begin, open_)}
    given = " ".join(t.value[slice(*returns)]) if returns else ""
    return _contract(t, body, end, given) | {
        "name": name, "line": t.line[begin], "end_line": t.line[end], "complexity": 1 + _branches(t, open_, end), "parameters": params, "nesting": _nesting(t, body, end), "exported": "export" in modifiers, "is_async": "async" in modifiers,
        "has_docstring": t.doc[begin], "returns": given or None, "decorators": [t.value[i][1:] for i in range(begin, open_) if t.kind[i] == "decorator"],
        "body_hash": hashlib.sha256("\n".join(t.value[body : end + 1]).encode()).hexdigest(), "ngrams": [" ".join(shape[i : i + 3]) for i in range(len(shape) - 2)], "any_types": sum(t.value[i] == "any" and t.at(i - 1) in (":", "<", "|", ",") for i in range(open_, body)),
    }


def _functions(t: Tokens, bodies: dict[int, str]) -> list[dict]:
    out = []
    for i, v in enumerate(t.value):
        if t.kind[i] != "op":
            continue
        if v == "=>" and t.at(i - 1) != ")" and t.kind[i - 1] == "name":  # x => ...; of a type no more than a name
            if (found := _assigned(t, i - 1, bodies)) is not None:
                out.append(_arrow(t, *found, i - 1, [t.value[i - 1]], None, i))
            continue
        if v != "(" or i not in t.match:
            continue
        close, before = t.match[i], t.before_generics(i - 1)
        after, returns = close + 1, None
        if t.at(after) == ":":
            returns = (after + 1, t.type_end(after + 1))
            after = returns[1]
        if t.at(after) == "=>":
            if (found := _assigned(t, i, bodies)) is not None:
                out.append(_arrow(t, *found, i, _parameters(t, i), returns, after))
        elif t.at(after) == "{" and after in t.match and before >= 0 and t.kind[before] in ("name", "string"):
            name = t.value[before].strip("\"'")
            if t.at(before - 1) == "function" or t.at(before - 2) == "function" and t.at(before - 1) == "*":
                out.append(_function(t, name, t.begin(before), i, _parameters(t, i), returns, after, t.match[after]))
            elif t.parent[i] in bodies and name not in _CONTROL | {"function"}:
                out.append(_function(t, f"{bodies[t.parent[i]]}.{name}", t.begin(before), i, _parameters(t, i), returns, after, t.match[after]))
    return out


def _assigned(t: Tokens, i: int, bodies: dict[int, str]) -> tuple[str, int] | None:
    """Name and first token of a variable or class property that an arrow, whose parameters begin at i, is given to."""
    k = t.before_generics(i - 1)
    k -= t.at(k) == "async"
    if t.at(k) != "=":
        return None
    k -= 1
    for j in range(k, max(-1, k - 60), -1):
        if t.value[j] in (";", "=>") or (t.value[j] in ("{", "}") and j in t.match and not j < t.match[j] <= k and t.match[j] < j - 60):
            return None
        declared = t.at(j - 1) in ("const", "let", "var")
        property_ = t.parent[j] in bodies and t.kind[j] == "name" and (t.at(j - 1) in ("{", ";", "}") or t.at(j - 1) in _MODIFIERS or t.line[j] > t.line[j - 1])
        if t.kind[j] == "name" and (declared or property_) and t.at(j + 1) in ("=", ":", "!", "?"):
            return (t.value[j] if declared else f"{bodies[t.parent[j]]}.{t.value[j]}"), t.begin(j)
    return None


def _arrow(t: Tokens, name: str, begin: int, open_: int, params: list[str], returns: tuple[int, int] | None, arrow: int) -> dict:
    body = arrow + 1
    end = t.match.get(body, t.statement_end(body)) if t.at(body) == "{" else t.statement_end(body)
    return _function(t, name, begin, open_, params, returns, min(body, len(t.value) - 1), end)


def _types(t: Tokens) -> tuple[list[dict], dict[int, str]]:
    """Classes, interfaces and aliases; the class that each body belongs to."""
    out, bodies = [], {}
    for i, v in enumerate(t.value):
        if t.kind[i] != "name" or t.at(i - 1) in (".", "?.") or t.at(i + 1) == ":":
            continue
        named = i + 1 < len(t.kind) and t.kind[i + 1] == "name" and t.value[i + 1] not in ("extends", "implements")
        begin = t.begin(i)
        head = {"line": t.line[begin], "exported": any(t.value[k] == "export" for k in range(begin, i)), "has_docstring": t.doc[begin], "decorators": [t.value[k][1:] for k in range(begin, i) if t.kind[k] == "decorator"]}
        if v in ("class", "interface") and (named or v == "class"):
            k, bases, angle, listing = i + 1 + named, [], 0, False
            while k < len(t.value) and (t.value[k] != "{" or angle):
                if t.value[k] in ("(", "["):
                    k = t.match.get(k, len(t.value))
                else:
                    angle += (t.value[k] == "<") - (t.value[k] == ">")
                    if angle == 0 and t.kind[k] == "name":
                        if t.value[k] in ("extends", "implements"):
                            listing = True
                        elif listing and t.at(k - 1) in ("extends", "implements", ",", "."):
                            bases = [*bases[:-1], f"{bases[-1]}.{t.value[k]}"] if t.at(k - 1) == "." else [*bases, t.value[k]]
                k += 1
            if k not in t.match:
                continue
            name = t.value[i + 1] if named else "anonymous"
            if v == "class":
                bodies[k] = name
            inside = [j for j in range(k + 1, t.match[k]) if t.parent[j] == k]
            members = [t.value[j] for j in inside if t.kind[j] == "name" and t.at(j + 1) in ("(", ":", "?", "!", "=", "<", ";") and (j == k + 1 or t.at(j - 1) in ("{", ";", ",", "}") or t.at(j - 1) in _MODIFIERS or t.line[j] > t.line[j - 1])]
            out.append(head | {"name": name, "kind": v, "end_line": t.line[t.match[k]], "bases": bases, "members": list(dict.fromkeys(members))})
        elif v == "type" and named and t.at(i + 2) in ("=", "<") and t.parent[i] == -1:
            equals = next((k for k in range(i + 2, min(len(t.value), i + 200)) if t.value[k] == "="), i + 2)
            out.append(head | {"name": t.value[i + 1], "kind": "type", "end_line": t.line[t.statement_end(equals + 1)], "bases": [], "members": []})
    return out, bodies


def _bypasses(t: Tokens) -> list[dict]:
    """Ways around the type system: kind, line and ``before`` (the names of a member access that an assertion ends)."""
    out = []
    for i, v in enumerate(t.value):
        if v == "as" and t.kind[i] == "name" and t.at(i + 1) == "any" and t.at(i + 2) != ".":
            out.append({"kind": "as_any", "line": t.line[i], "before": ""})
        elif v == "as" and t.at(i + 1) == "unknown" and t.at(i + 2) == "as":
            out.append({"kind": "double_cast", "line": t.line[i], "before": ""})
        elif v == "!" and t.kind[i] == "op" and i and (t.kind[i - 1] == "name" and t.value[i - 1] not in _BEFORE_VALUE or t.value[i - 1] in (")", "]")) and t.line[i] == t.line[i - 1] and t.at(i + 1) not in (":",):
            following = t.kind[i + 1] if i + 1 < len(t.kind) else "op"
            if following == "op" and t.at(i + 1) not in ("{", "(", "[") or t.at(i + 1) in ("(", "["):
                out.append({"kind": "non_null_assertion", "line": t.line[i], "before": f"{t.at(i - 2)}{t.value[i - 1]}" if t.kind[i - 1] == "name" else ""})
    for line, text in t.comments:
        if m := re.search(r"@ts-(ignore|expect-error)", text):
            out.append({"kind": f"ts_{m.group(1).replace('-', '_')}", "line": line, "before": ""})
    return sorted(out, key=lambda x: x["line"])


def describe(content: str, jsx: bool = False) -> dict:
    """functions, types, bypasses and error of a source text."""
    t = Tokens(content, jsx)
    types, bodies = _types(t)
    return {"functions": _functions(t, bodies) if t.value else [], "types": types, "bypasses": _bypasses(t), "error": None if t.balanced else "UnbalancedBrackets"}
