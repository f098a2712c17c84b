"""Tagged JSON: values with their kind, so that dates, errors, NaN and missing values survive a round trip."""

from __future__ import annotations

import json
import math
from datetime import datetime, timezone
from typing import Any


class Undefined:
    """A value that is absent, other than null."""

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Undefined)

    def __hash__(self) -> int:
        return 0


UNDEFINED = Undefined()


def _number(x: float) -> str:
    if isinstance(x, float):
        if math.isnan(x):
            return "NaN"
        if math.isinf(x):
            return "Infinity" if x > 0 else "-Infinity"
        if x.is_integer() and abs(x) < 1e21:
            return str(int(x))
    return repr(x)


def _tagged(x: Any, above: tuple[int, ...]) -> dict:
    if x is None:
        return {"type": "null", "value": ""}
    if isinstance(x, Undefined):
        return {"type": "undefined", "value": ""}
    if isinstance(x, bool):
        return {"type": "boolean", "value": "true" if x else "false"}
    if isinstance(x, (int, float)):
        return {"type": "number", "value": _number(x)}
    if isinstance(x, str):
        return {"type": "string", "value": x}
    if isinstance(x, datetime):
        at = x.replace(tzinfo=timezone.utc) if x.tzinfo is None else x.astimezone(timezone.utc)
        return {"type": "date", "value": at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"}
    if id(x) in above:
        raise ValueError("a value holds itself")
    inside = (*above, id(x))
    if isinstance(x, (list, tuple)):
        return {"type": "array", "value": {str(i): _tagged(v, inside) for i, v in enumerate(x)}}
    if isinstance(x, BaseException):
        return {"type": "error", "value": {"name": _tagged(type(x).__name__, inside), "message": _tagged(str(x), inside), "cause": _tagged(x.__cause__, inside)}}
    if isinstance(x, dict):
        return {"type": "object", "value": {str(k): _tagged(v, inside) for k, v in x.items()}}
    raise TypeError(f"Unsupported type: {type(x).__name__}")


def serialize(x: Any) -> str:
    """Null, undefined, numbers, strings, booleans, dates, errors, lists and dictionaries; cycles and other kinds are refused."""
    return json.dumps(_tagged(x, ()))


def _plain(t: dict) -> Any:
    kind, value = t["type"], t.get("value")
    if kind == "null":
        return None
    if kind == "undefined":
        return UNDEFINED
    if kind == "boolean":
        return value == "true"
    if kind == "number":
        x = float(value)
        return int(x) if x.is_integer() and "." not in value and "e" not in value.lower() else x
    if kind == "string":
        return value
    if kind == "date":
        return datetime.fromisoformat(value.replace("Z", "+00:00"))
    if kind == "array":
        return [_plain(value[k]) for k in sorted(value, key=int)]
    if kind == "error":
        error = Exception(_plain(value["message"]))
        error.__cause__ = _plain(value["cause"])
        return error
    if kind == "object":
        return {k: _plain(v) for k, v in value.items()}
    raise ValueError(f"Unknown type: {kind}")


def deserialize(s: str) -> Any:
    return _plain(json.loads(s))
