"""Registry of operators: names, aliases, parameters, outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Other names of parameters.
PARAMETER_ALIASES = {"lookback": "period", "length": "period", "field": "source", "fast": "fast_period", "slow": "slow_period", "signal": "signal_period"}
INPUTS = ("source", "a", "b", "price", "upper", "lower")


@dataclass(frozen=True)
class Operator:
    name: str
    fn: Callable[..., Any]
    aliases: tuple[str, ...] = ()
    parameters: dict[str, Any] = field(default_factory=dict)
    outputs: tuple[str, ...] = ("value",)
    description: str = ""

    def bind(self, args: tuple = (), kwargs: dict | None = None) -> dict[str, Any]:
        """Parameters by name, checked; defaults filled in."""
        names = list(self.parameters)
        if len(args) > len(names):
            raise ValueError(f"{self.name} takes at most {len(names)} parameters")
        given = dict(zip(names, args))
        for k, v in (kwargs or {}).items():
            k = k if k in self.parameters else PARAMETER_ALIASES.get(k, k)
            if k not in self.parameters:
                raise ValueError(f"{self.name} has no parameter {k!r}; it has {', '.join(names) or 'none'}")
            if k in given:
                raise ValueError(f"{self.name} is given {k!r} twice")
            given[k] = v
        return {k: _coerce(self.name, k, given.get(k, default), default) for k, default in self.parameters.items()}


def _coerce(op: str, name: str, value: Any, default: Any) -> Any:
    if name in INPUTS or isinstance(default, str) or value is None:
        return value
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("true", "1", "yes")
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{op}: {name} must be a number, not {value!r}") from None
    if isinstance(default, int):
        if number != int(number):
            raise ValueError(f"{op}: {name} must be a whole number, not {value!r}")
        number = int(number)
        if number < 1 and name != "periods":
            raise ValueError(f"{op}: {name} must be above 0, not {value!r}")
    return number


_OPERATORS: dict[str, Operator] = {}
_NAMES: dict[str, str] = {}


def register(name: str, aliases: tuple[str, ...] = (), outputs: tuple[str, ...] = ("value",), **parameters: Any):
    """Make a function from a builder and parameters an operator."""

    def add(fn: Callable[..., Any]) -> Callable[..., Any]:
        for n in (name, *aliases):
            if n.lower() in _NAMES:
                raise ValueError(f"{n!r} is registered already")
        _OPERATORS[name] = Operator(name, fn, tuple(aliases), parameters, outputs, (fn.__doc__ or "").strip())
        _NAMES.update({n.lower(): name for n in (name, *aliases)})
        return fn

    return add


def unregister(name: str) -> None:
    op = _OPERATORS.pop(_NAMES[name.lower()])
    for n in (op.name, *op.aliases):
        _NAMES.pop(n.lower(), None)


def find(name: str) -> Operator:
    """By name or alias, in any case."""
    from tickloom.functions import indicators, pattern  # noqa: F401  they register themselves

    key = _NAMES.get(name.lower())
    if key is None:
        raise ValueError(f"unknown operator {name!r}")
    return _OPERATORS[key]


def names() -> list[str]:
    find("sma")
    return sorted(_OPERATORS)


def catalog(spark: SparkSession) -> DataFrame:
    """All operators: (name, aliases, parameters, outputs)."""
    rows = [(n, list(_OPERATORS[n].aliases), {k: str(v) for k, v in _OPERATORS[n].parameters.items()}, list(_OPERATORS[n].outputs)) for n in names()]
    return spark.createDataFrame(rows, "name string, aliases array<string>, parameters map<string,string>, outputs array<string>")


def apply(df: DataFrame, name: str, *args: Any, **kwargs: Any) -> DataFrame:
    """The frame with the operator's outputs as further columns, ``name`` or ``name_output``."""
    from tickloom.functions.build import Build

    op = find(name)
    b = Build(df)
    out = op.fn(b, **op.bind(args, kwargs))
    if isinstance(out, dict):
        return b.done(**{f"{op.name}_{o}": c for o, c in out.items()})
    if not isinstance(out, (list, tuple)):
        return b.done(**{op.name: out})
    return b.done(**{f"{op.name}_{o}": c for o, c in zip(op.outputs, out)})
