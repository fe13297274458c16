"""Formulas and block formulas read as a syntax tree and walked, never evaluated as Python.

For rules that are rows of a table, each with its own formula: expressions, and blocks of assignments, ``if`` and bounded
``for`` that leave their value in ``result``. What is not on the list raises FormulaError, as do missing names, a division
by zero and more than STEPS steps.
"""

from __future__ import annotations

import ast
import math
import operator

from sparloom.functions.formula import FormulaError, to_python

STEPS = 10_000


def _bits(width) -> float:
    if not 0 < width <= 64:
        raise FormulaError("width out of range")
    return 2 ** int(width)


def _range(*a):
    r = range(*map(int, a))
    if len(r) > STEPS:
        raise FormulaError("too many steps")
    return list(r)


#: The functions of the formula language.
CALLS = {
    "abs": abs, "round": round, "int": int, "float": float, "min": min, "max": max, "len": len, "sum": sum, "range": _range, "enumerate": lambda x: [list(p) for p in enumerate(x)], "list": list, "dict": dict,
    "floor": math.floor, "ceil": math.ceil, "pow": pow, "clip": lambda x, a, b: min(max(x, a), b), "clamp": lambda x, a, b: min(max(x, a), b), "scale": lambda x, f, o=0: x * f + o,
    "signed": lambda x, w: x - _bits(w) if x >= _bits(w) / 2 else x, "unsigned": lambda x, w: x + _bits(w) if x < 0 else x,
}
BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod,
    ast.BitAnd: lambda a, b: int(a) & int(b), ast.BitOr: lambda a, b: int(a) | int(b), ast.BitXor: lambda a, b: int(a) ^ int(b), ast.LShift: lambda a, b: int(a) << min(int(b), 64), ast.RShift: lambda a, b: int(a) >> int(b),
}
COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}


class _Walk:
    def __init__(self, names: dict):
        self.names, self.left = dict(names), STEPS

    def value(self, n):
        self.left -= 1
        if self.left < 0:
            raise FormulaError("too many steps")
        match n:
            case ast.Constant() if n.value is None or isinstance(n.value, (int, float, str, bool)):
                return n.value
            case ast.Name():
                if n.id not in self.names:
                    raise FormulaError(f"unknown name {n.id}")
                if self.names[n.id] is None:
                    raise FormulaError(f"missing {n.id}")
                return self.names[n.id]
            case ast.BinOp(op=ast.Pow()):
                a, b = self.value(n.left), self.value(n.right)
                if abs(b) > 64:
                    raise FormulaError("power out of range")
                return a**b
            case ast.BinOp() if type(n.op) in BINARY:
                return BINARY[type(n.op)](self.value(n.left), self.value(n.right))
            case ast.UnaryOp(op=ast.USub()):
                return -self.value(n.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return +self.value(n.operand)
            case ast.UnaryOp(op=ast.Not()):
                return not self.value(n.operand)
            case ast.BoolOp():
                out = None
                for v in n.values:
                    out = self.value(v)
                    if bool(out) == isinstance(n.op, ast.Or):
                        break
                return out
            case ast.Compare() if all(type(o) in COMPARE for o in n.ops):
                sides = [self.value(n.left), *map(self.value, n.comparators)]
                return all(COMPARE[type(o)](a, b) for o, a, b in zip(n.ops, sides, sides[1:]))
            case ast.IfExp():
                return self.value(n.body if self.value(n.test) else n.orelse)
            case ast.List() | ast.Tuple():
                return [self.value(e) for e in n.elts]
            case ast.Dict() if None not in n.keys:
                return {self.value(k): self.value(v) for k, v in zip(n.keys, n.values)}
            case ast.Subscript():
                return self.value(n.value)[self.value(n.slice)]
            case ast.Call(func=ast.Name()) if n.func.id in CALLS and not n.keywords:
                return CALLS[n.func.id](*map(self.value, n.args))
        raise FormulaError(f"not allowed: {type(n).__name__}")

    def run(self, body):
        for n in body:
            match n:
                case ast.Assign(targets=[ast.Name()]):
                    self.names[n.targets[0].id] = self.value(n.value)
                case ast.AugAssign(target=ast.Name()) if type(n.op) in BINARY:
                    self.names[n.target.id] = BINARY[type(n.op)](self.value(ast.Name(n.target.id)), self.value(n.value))
                case ast.If():
                    self.run(n.body if self.value(n.test) else n.orelse)
                case ast.For() if isinstance(n.target, (ast.Name, ast.Tuple)) and not n.orelse:
                    for v in self.value(n.iter):
                        parts = [n.target] if isinstance(n.target, ast.Name) else n.target.elts
                        for t, x in zip(parts, [v] if len(parts) == 1 else v):
                            self.names[t.id] = x
                        self.run(n.body)
                case ast.Pass():
                    pass
                case _:
                    raise FormulaError(f"not allowed: {type(n).__name__}")


def parse(text: str) -> ast.Module:
    try:
        return ast.parse(to_python(text).strip() if "\n" not in text.strip() else text.strip())
    except (SyntaxError, ValueError, RecursionError) as e:
        raise FormulaError(f"syntax: {e}") from e


def evaluate(text: str, names: dict):
    """The value of an expression, or of ``result`` after a block; names without a value raise."""
    tree = parse(text)
    walk = _Walk(names)
    try:
        if len(tree.body) == 1 and isinstance(tree.body[0], ast.Expr):
            return walk.value(tree.body[0].value)
        walk.run(tree.body)
    except FormulaError:
        raise
    except (ArithmeticError, TypeError, ValueError, KeyError, IndexError, AttributeError) as e:
        raise FormulaError(f"{type(e).__name__}: {e}") from e
    if "result" not in walk.names:
        raise FormulaError("a block leaves its value in result")
    return walk.names["result"]


def check(text: str | None) -> str | None:
    """Why a formula is not one expression, else None."""
    try:
        tree = parse(text or "")
    except FormulaError as e:
        return str(e)
    return None if len(tree.body) == 1 and isinstance(tree.body[0], ast.Expr) else "not an expression"


def rename(text: str, names: dict[str, str]) -> str:
    """The formula with whole names replaced; dotted names count as one."""
    import re

    return re.sub(r"[A-Za-z_][\w.]*", lambda m: names.get(m[0], m[0]), text)
