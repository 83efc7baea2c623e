"""Expressions that are written down at import, when there is no session yet, and built when a query runs."""

from __future__ import annotations

import operator
from collections.abc import Callable
from typing import Any


class Deferred:
    """Records attribute access, calls and operators."""

    __slots__ = ("_build",)
    __hash__ = None

    def __init__(self, build: Callable[[], Any]):
        self._build = build

    def __getattr__(self, name: str) -> Deferred:
        return Deferred(lambda: getattr(built(self), name))

    def __call__(self, *args: Any, **named: Any) -> Deferred:
        return Deferred(lambda: built(self)(*map(built, args), **{k: built(v) for k, v in named.items()}))


def built(x: Any) -> Any:
    """x with every deferred part made."""
    if isinstance(x, Deferred):
        return built(x._build())
    if isinstance(x, tuple | list):
        return type(x)(map(built, x))
    return x


def defer(x: Any) -> Deferred:
    return Deferred(lambda: x)


def _two(op: Callable, turned: bool = False) -> Callable:
    def method(self: Deferred, other: Any) -> Deferred:
        return Deferred(lambda: op(built(other), built(self)) if turned else op(built(self), built(other)))

    return method


for _name in ("add", "sub", "mul", "mod", "truediv", "and", "or"):
    _op = getattr(operator, _name + "_" * (_name in ("and", "or")))
    setattr(Deferred, f"__{_name}__", _two(_op))
    setattr(Deferred, f"__r{_name}__", _two(_op, True))
for _name in ("eq", "ne", "lt", "le", "gt", "ge"):
    setattr(Deferred, f"__{_name}__", _two(getattr(operator, _name)))
for _name in ("neg", "invert"):
    setattr(Deferred, f"__{_name}__", (lambda op: lambda self: Deferred(lambda: op(built(self))))(getattr(operator, _name)))
