"""Named operators: register a function of a DataFrame and find it again."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Operator:
    name: str
    run: Callable[..., DataFrame]
    version: str = "1.0"
    description: str = ""
    author: str = ""
    extra: dict = field(default_factory=dict)


_OPERATORS: dict[str, Operator] = {}


def operator(name: str, **about) -> Callable:
    """Decorator: makes run(df, **params) available by name."""

    def mark(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _OPERATORS:
            raise ValueError(f"{name} is registered")
        _OPERATORS[name] = Operator(name, f, description=(f.__doc__ or "").strip(), **about)
        return f

    return mark


def get(name: str) -> Operator:
    return _OPERATORS[name]


def names() -> list[str]:
    return sorted(_OPERATORS)


def remove(name: str) -> None:
    _OPERATORS.pop(name, None)


def analyze(name: str, df: DataFrame, **params) -> DataFrame:
    return _OPERATORS[name].run(df, **params)


def load() -> list[str]:
    """Registers the library's operators as module.function: those of fossilframe.operators that begin with a DataFrame
    and give one, or a dictionary of them. Returns all names; a second call adds nothing."""
    for part in ("charts", "clustering", "ecology", "hypothesis", "macroevolution", "morphometrics", "multivariate", "phylogenetics", "stratigraphy", "tables", "transforms"):
        module = importlib.import_module(f"fossilframe.operators.{part}")
        for name, f in vars(module).items():
            if name.startswith("_") or not inspect.isfunction(f) or f.__module__ != module.__name__:
                continue
            s = inspect.signature(f)
            first = next(iter(s.parameters.values()), None)
            if first is not None and first.annotation == "DataFrame" and s.return_annotation in ("DataFrame", "dict[str, DataFrame]") and f"{part}.{name}" not in _OPERATORS:
                operator(f"{part}.{name}")(f)
    return names()
