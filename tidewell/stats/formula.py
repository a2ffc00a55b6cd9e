"""A small parser for formulas: numbers, names, + - * / ^, parentheses and a fixed list of functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

FUNCTIONS: dict[str, Callable] = {"exp": np.exp, "ln": np.log, "log": np.log, "sqrt": np.sqrt, "abs": np.abs, "sin": np.sin, "cos": np.cos, "tan": np.tan, "min": np.minimum, "max": np.maximum}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(\*\*|[-+*/^(),]))")


def parse(text: str) -> Callable[[dict], np.ndarray]:
    """A function of an environment of names; anything not in the grammar is an error."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r}")
        tokens.append(m.groups())
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos][2] if pos < len(tokens) else None

    def take(sign: str) -> None:
        nonlocal pos
        if peek() != sign:
            raise ValueError(f"expected {sign!r}")
        pos += 1

    def total() -> Callable:
        nonlocal pos
        left = product()
        while peek() in ("+", "-"):
            op = tokens[pos][2]
            pos += 1
            right = product()
            left = (lambda a, b: lambda e: a(e) + b(e))(left, right) if op == "+" else (lambda a, b: lambda e: a(e) - b(e))(left, right)
        return left

    def product() -> Callable:
        nonlocal pos
        left = signed()
        while peek() in ("*", "/"):
            op = tokens[pos][2]
            pos += 1
            right = signed()
            left = (lambda a, b: lambda e: a(e) * b(e))(left, right) if op == "*" else (lambda a, b: lambda e: a(e) / b(e))(left, right)
        return left

    def signed() -> Callable:
        nonlocal pos
        if peek() in ("+", "-"):
            op = tokens[pos][2]
            pos += 1
            inner = signed()
            return inner if op == "+" else lambda e: -inner(e)
        base = atom()
        if peek() in ("^", "**"):
            pos += 1
            exponent = signed()
            return lambda e: base(e) ** exponent(e)
        return base

    def atom() -> Callable:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("the formula ends early")
        number, name, sign = tokens[pos]
        pos += 1
        if number is not None:
            value = float(number)
            return lambda e: value
        if name is not None:
            if peek() == "(":
                if name not in FUNCTIONS:
                    raise ValueError(f"unknown function {name}")
                take("(")
                args = [total()]
                while peek() == ",":
                    take(",")
                    args.append(total())
                take(")")
                fn = FUNCTIONS[name]
                return lambda e: fn(*[a(e) for a in args])
            return lambda e: e[name]
        if sign == "(":
            inner = total()
            take(")")
            return inner
        raise ValueError(f"unexpected {sign!r}")

    tree = total()
    if pos != len(tokens):
        raise ValueError("something follows the formula")
    return tree
