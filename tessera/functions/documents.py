"""JSON documents: canonical text, patches, key removal; Arrow-batched functions where Spark has no built-in."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def stable_json(texts: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no spaces; null for what is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def apply_patch(document: object, operations: list[dict], allowed: tuple[str, ...]) -> object:
    """A copy of a document after replace, add and remove operations whose paths start with an allowed one.

    Raises ValueError for a path that is not allowed or does not exist.
    """
    copy = json.loads(json.dumps(document))
    for op in operations:
        path = op["path"]
        if not any(path == a or path.startswith(f"{a}/") for a in allowed):
            raise ValueError(f"path not allowed: {path}")
        *way, last = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
        at = copy
        for key in way:
            if isinstance(at, list):
                at = at[int(key)] if key.isdigit() and int(key) < len(at) else None
            else:
                at = at.get(key) if isinstance(at, dict) else None
            if at is None:
                raise ValueError(f"no such path: {path}")
        if isinstance(at, list):
            k = len(at) if last == "-" else int(last) if last.isdigit() else -1
            if not 0 <= k < len(at) + (op["op"] == "add"):
                raise ValueError(f"no such path: {path}")
            if op["op"] == "add":
                at.insert(k, op["value"])
            elif op["op"] == "remove":
                del at[k]
            else:
                at[k] = op["value"]
        elif op["op"] == "remove":
            if last not in at:
                raise ValueError(f"no such path: {path}")
            del at[last]
        else:
            if op["op"] == "replace" and last not in at:
                raise ValueError(f"no such path: {path}")
            at[last] = op["value"]
    return copy


def patched(document: Column, patch: Column, allowed: tuple[str, ...]) -> Column:
    """JSON text after a JSON patch; null where the patch is refused."""

    @F.pandas_udf(StringType())
    def run(documents: pd.Series, patches: pd.Series) -> pd.Series:
        out = []
        for d, p in zip(documents, patches):
            try:
                out.append(json.dumps(apply_patch(json.loads(d), json.loads(p), allowed), separators=(",", ":"), sort_keys=True, ensure_ascii=False))
            except (ValueError, TypeError, KeyError):
                out.append(None)
        return pd.Series(out, dtype="object")

    return run(document, patch)
