"""Replies of language models: the JSON object in them, and the call itself as a column."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def balanced(text: str) -> list[str]:
    """All outermost {...} of a text; braces in strings and behind backslashes do not count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"' and depth:
            quoted, escaped = True, False
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def _object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def recovered(text: str | None) -> str | None:
    """The text if it is a JSON object, else the longest object in it; None without one."""
    if text is None:
        return None
    bare = text.strip()
    if bare.startswith("```"):
        bare = bare.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    if _object(bare):
        return bare
    return max(filter(_object, balanced(bare)), key=len, default=None)


def _recovered(texts: pd.Series) -> pd.Series:
    return texts.map(recovered)


def recover_json(text: Column) -> Column:
    return F.pandas_udf(_recovered, "string")(text)


REPLY = "text string, error string, cost_usd double, wall_s double, input_tokens long, output_tokens long"


def model_call(call: Callable[[str, str], dict], instruction: str) -> Callable[[Column], Column]:
    """A column function that sends each payload to ``call(instruction, payload)``; what it raises becomes the error."""

    def run(payloads: pd.Series) -> pd.DataFrame:
        rows = []
        for p in payloads:
            try:
                r = call(instruction, p)
            except Exception as e:  # noqa: BLE001  a failed call is a row
                r = {"error": f"{type(e).__name__}: {e}"}
            rows.append({k: r.get(k) for k in ("text", "error", "cost_usd", "wall_s", "input_tokens", "output_tokens")})
        out = pd.DataFrame(rows, columns=["text", "error", "cost_usd", "wall_s", "input_tokens", "output_tokens"])
        return out.astype({"cost_usd": "float64", "wall_s": "float64", "input_tokens": "Int64", "output_tokens": "Int64"})

    run.__annotations__ = {"payloads": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, REPLY).asNondeterministic()
