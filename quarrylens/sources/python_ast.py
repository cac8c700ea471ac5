"""What one Python file declares, by the standard parser. A small helper for tasks."""

from __future__ import annotations

import ast
import builtins
import hashlib

_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)
_NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try)
_BROAD = {"Exception", "BaseException", "bare"}
_BUILTIN = set(dir(builtins))
# Assertions that expect a failure; settings (name and value) that are insecure, with their rule and score.
_NEGATIVE = {"raises", "assertRaises", "assertRaisesRegex", "assertFalse", "assertNotEqual", "assertNotIn", "assertIsNone"}
INSECURE = {
    ("DEBUG", "True"): ("insecure_debug_mode", 0.8),
    ("ALLOWED_HOSTS", "star"): ("insecure_allowed_hosts", 0.7),
    ("ALLOWED_HOSTS", "empty"): ("insecure_allowed_hosts", 0.5),
    ("CORS_ALLOW_ALL_ORIGINS", "True"): ("insecure_cors", 0.7),
    ("CORS_ORIGIN_ALLOW_ALL", "True"): ("insecure_cors", 0.7),
    ("SESSION_COOKIE_SECURE", "False"): ("insecure_cookie", 0.6),
    ("CSRF_COOKIE_SECURE", "False"): ("insecure_cookie", 0.6),
    ("SECURE_SSL_REDIRECT", "False"): ("insecure_ssl_redirect", 0.5),
}


def _linked(tree: ast.AST) -> ast.AST:
    """Notes each node's children on it, once for a file, so walks don't look through its fields again."""
    nodes = [tree]
    for x in nodes:
        x.kids_ = list(ast.iter_child_nodes(x))
        nodes += x.kids_
    return tree


def _walk(node: ast.AST) -> list[ast.AST]:
    """A node and all below it, breadth first, as ``ast.walk`` does; kept on the node."""
    found = node.__dict__.get("all_")
    if found is None:
        found = [node]
        for x in found:
            found += x.kids_
        node.all_ = found
    return found


def _complexity(node: ast.AST) -> int:
    return 1 + sum(isinstance(x, _BRANCH) for x in _walk(node)) + sum(len(x.values) - 1 for x in _walk(node) if isinstance(x, ast.BoolOp))


def _depth(body: list[ast.stmt], at: int = 0) -> int:
    best = at
    for s in body:
        below = [x for f in ("body", "orelse", "finalbody") for x in getattr(s, f, []) or []] + [x for h in getattr(s, "handlers", []) for x in h.body]
        if below and not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            best = max(best, _depth(below, at + isinstance(s, _NEST)))
    return best


def _cognitive(body: list[ast.stmt], at: int = 0) -> int:
    """One for each break in the flow and one more for each level that it lies in; runs of boolean operators count one."""
    total = 0
    for s in body:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            total += _cognitive(s.body, at + 1)
            continue
        heads = [x for x in s.kids_ if isinstance(x, ast.expr)]
        total += sum(isinstance(x, ast.BoolOp) + isinstance(x, ast.IfExp) * (1 + at) for h in heads for x in _walk(h))
        if isinstance(s, (ast.If, ast.For, ast.AsyncFor, ast.While)):
            total += 1 + at + _cognitive(s.body, at + 1)
            again = len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If) and isinstance(s, ast.If)
            # An elif counts once, without its level.
            total += _cognitive(s.orelse, at) - at if again else bool(s.orelse) + _cognitive(s.orelse, at + 1)
        elif isinstance(s, (ast.Try, ast.With, ast.AsyncWith)):
            total += _cognitive(s.body, at) + sum(1 + at + _cognitive(h.body, at + 1) for h in getattr(s, "handlers", ())) + _cognitive(getattr(s, "orelse", []), at) + _cognitive(getattr(s, "finalbody", []), at)
    return total


def _own(node: ast.AST, kind) -> list:
    return [x for x in _walk(node) if isinstance(x, kind)]


def _boolean(e: ast.expr | None) -> bool:
    return (isinstance(e, ast.Constant) and isinstance(e.value, bool)) or isinstance(e, ast.Compare) or (isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not)) or (isinstance(e, ast.BoolOp) and all(map(_boolean, e.values)))


def _creates(body: list[ast.stmt]) -> bool:
    """Whether an assignment or return follows a condition, or a condition has another branch."""
    asked = False
    for s in body:
        if asked and isinstance(s, (ast.Assign, ast.Return)):
            return True
        asked |= isinstance(s, (ast.If, ast.Try))
    return any(x.orelse for s in body for x in _own(s, ast.If))


def _guarded(body: list[ast.stmt], parameters: set[str]) -> bool:
    """Whether one of the first statements rejects by a parameter: a condition that leaves at once, an assertion or a type test."""
    for s in body[: max(3, len(body) // 3)]:
        names = {x.id for x in _own(s.test, ast.Name)} if isinstance(s, (ast.If, ast.Assert)) else set()
        if names & parameters and (isinstance(s, ast.Assert) or isinstance(s.body[0], (ast.Return, ast.Raise))):
            return True
    return False


def _asserts(node: ast.AST) -> tuple[int, int]:
    """Assertions that expect success, and those that expect a failure."""
    calls = [x.func.attr if isinstance(x.func, ast.Attribute) else getattr(x.func, "id", "") for x in _own(node, ast.Call)]
    bad = sum(c in _NEGATIVE for c in calls) + sum(isinstance(x.test, ast.UnaryOp) and isinstance(x.test.op, ast.Not) for x in _own(node, ast.Assert))
    return sum(c.startswith("assert") and c not in _NEGATIVE for c in calls) + len(_own(node, ast.Assert)) - (bad - sum(c in _NEGATIVE for c in calls)), bad


#: What can be asked of a function besides its name and lines.
FIELDS = frozenset("complexity parameters decorators has_docstring returns nesting body_hash ngrams cognitive raises rejects creates boolean tries guarded exceptions positive negative".split())
#: What can be asked of a file.
PARTS = frozenset("functions classes imports handlers settings names".split())


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, fields: frozenset[str]) -> dict:
    """Only the fields that are asked for are worked out."""
    body = node.body[1:] if ast.get_docstring(node) is not None else node.body
    a = node.args
    out: dict = {"name": node.name, "line": node.lineno, "end_line": node.end_lineno}
    names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
    returned = [x.value for x in _own(node, ast.Return) if x.value is not None] if fields & {"rejects", "boolean"} else []
    raised = [x.exc.func if isinstance(x.exc, ast.Call) else x.exc for x in _own(node, ast.Raise)] if fields & {"raises", "rejects", "exceptions"} else []
    positive, negative = _asserts(node) if fields & {"positive", "negative"} else (None, None)
    of = {
        "complexity": lambda: _complexity(node), "parameters": lambda: names, "decorators": lambda: [ast.unparse(d) for d in node.decorator_list], "has_docstring": lambda: len(body) < len(node.body),
        "returns": lambda: ast.unparse(node.returns) if node.returns else None, "nesting": lambda: _depth(node.body), "body_hash": lambda: hashlib.sha256("\n".join(ast.dump(s) for s in body).encode()).hexdigest(),
        "ngrams": lambda: _ngrams(body), "cognitive": lambda: _cognitive(body), "raises": lambda: bool(raised), "rejects": lambda: bool(raised) or any(isinstance(v, ast.Constant) and (v.value is False or v.value is None) for v in returned),
        "creates": lambda: _creates(body), "boolean": lambda: (node.returns is not None and ast.unparse(node.returns) in ("bool", "builtins.bool")) or (bool(returned) and all(map(_boolean, returned))), "tries": lambda: bool(_own(node, ast.Try)),
        "guarded": lambda: _guarded(body, set(names)), "exceptions": lambda: sorted({ast.unparse(x) if x is not None else "reraise" for x in raised}), "positive": lambda: positive, "negative": lambda: negative,
    }
    return out | {k: of[k]() for k in of if k in fields}


def _ngrams(body: list[ast.stmt]) -> list[str]:
    kinds = [type(x).__name__ for s in body for x in _walk(s)]
    return [" ".join(kinds[i : i + 3]) for i in range(len(kinds) - 2)]


def _settings(tree: ast.Module) -> list[dict]:
    """Settings that are insecure: rule, name, score, line."""
    out = []
    for node in _own(tree, ast.Assign):
        for target in node.targets:
            name, v = getattr(target, "id", None), node.value
            given = "star" if isinstance(v, ast.List) and [getattr(x, "value", None) for x in v.elts] == ["*"] else "empty" if isinstance(v, ast.List) and not v.elts else str(v.value) if isinstance(v, ast.Constant) and isinstance(v.value, bool) else None
            if (found := INSECURE.get((name, given))) is not None:
                out.append({"rule": found[0], "name": name, "score": found[1], "line": node.lineno})
    for call in _own(tree, ast.Call):
        if any(k.arg == "verify" and isinstance(k.value, ast.Constant) and k.value.value is False for k in call.keywords):
            out.append({"rule": "insecure_ssl_verify", "name": "verify", "score": 0.7, "line": call.lineno})
    return out


def _names(tree: ast.Module) -> dict:
    """Names that the file calls and those that it binds in any scope."""
    bound = {x.id for x in _own(tree, ast.Name) if isinstance(x.ctx, (ast.Store, ast.Del))} | {x.name for x in _own(tree, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))} | {x.arg for x in _own(tree, ast.arg)}
    bound |= {x.name for x in _own(tree, ast.ExceptHandler) if x.name} | {(x.asname or x.name).split(".")[0] for i in _own(tree, (ast.Import, ast.ImportFrom)) for x in i.names}
    called = {x.func.id for x in _own(tree, ast.Call) if isinstance(x.func, ast.Name)}
    return {"called": sorted(called - _BUILTIN), "bound": sorted(bound), "open": "*" in bound or bool({"exec", "eval"} & called)}


def _handler(node: ast.ExceptHandler) -> dict:
    types = ["bare"] if node.type is None else [ast.unparse(x) for x in (node.type.elts if isinstance(node.type, ast.Tuple) else [node.type])]
    quiet = all(isinstance(s, (ast.Pass, ast.Continue)) or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)) for s in node.body)
    return {"line": node.lineno, "exceptions": types, "broad": any(t in _BROAD for t in types), "swallows": quiet}


def describe(content: str, parts: frozenset[str] = PARTS, fields: frozenset[str] = FIELDS) -> dict:
    """functions, classes, imports, handlers, settings, names and error of a source text. Of ``parts`` and of the functions' ``fields`` only those that are asked for; the others are empty."""
    out: dict = {"functions": [], "classes": [], "imports": [], "handlers": [], "settings": [], "names": {"called": [], "bound": [], "open": True}, "error": None}
    try:
        tree = ast.parse(content)
        if parts - {"imports", "classes"}:
            _linked(tree)
    except (SyntaxError, ValueError, RecursionError) as e:
        return out | {"error": type(e).__name__}
    if "settings" in parts:
        out["settings"] = _settings(tree)
    if "names" in parts:
        out["names"] = _names(tree)
    top = set(map(id, tree.body))
    for node in ast.walk(tree) if not parts - {"imports", "classes"} else _walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if "functions" in parts:
                out["functions"].append(_function(node, fields))
        elif isinstance(node, ast.ClassDef):
            out["classes"].append({"name": node.name, "line": node.lineno, "bases": [ast.unparse(b) for b in node.bases]})
        elif isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "names": [a.asname or a.name], "line": node.lineno, "level": 0, "top": id(node) in top} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"module": node.module or "", "names": [a.name for a in node.names], "line": node.lineno, "level": node.level, "top": id(node) in top})
        elif isinstance(node, ast.ExceptHandler):
            out["handlers"].append(_handler(node))
    return out
