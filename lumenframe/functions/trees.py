"""Metadata trees: JSON patches and property paths.

Trees as JSON text are walked in Arrow functions (a patch is sequential); flat properties are maps.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _merge(target, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


def _steps(pointer: str) -> list[str]:
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]


def _at(tree, pointer: str):
    for step in _steps(pointer):
        tree = tree[int(step)] if isinstance(tree, list) else tree[step]
    return tree


def apply_patch(tree, operations: list[dict]):
    """RFC 6902: add, remove, replace, move, copy and test; raises if an operation does not apply."""
    tree = json.loads(json.dumps(tree))
    for op in operations:
        kind, path = op["op"], op["path"]
        value = op.get("value")
        if kind in ("move", "copy"):
            value = json.loads(json.dumps(_at(tree, op["from"])))
        if kind == "test":
            if _at(tree, path) != value:
                raise ValueError(f"test of {path} failed")
            continue
        if kind == "move":
            tree = apply_patch(tree, [{"op": "remove", "path": op["from"]}])
        if not path:
            tree = value
            continue
        *above, last = _steps(path)
        holder = tree
        for step in above:
            holder = holder[int(step)] if isinstance(holder, list) else holder[step]
        if isinstance(holder, list):
            i = len(holder) if last == "-" else int(last)
            if not (last == "-" or last.isdigit()) or i > len(holder) or (i == len(holder) and kind not in ("add", "move", "copy")):
                raise IndexError(path)
            if kind in ("add", "move", "copy"):
                holder.insert(i, value)
            elif kind == "remove":
                del holder[i]
            else:
                holder[i] = value
        elif kind in ("add", "move", "copy"):
            holder[last] = value
        elif last not in holder:
            raise KeyError(path)
        elif kind == "remove":
            del holder[last]
        else:
            holder[last] = value
    return tree


def _dump(tree) -> str:
    return json.dumps(tree, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def merge_patch(target: pd.Series, patch: pd.Series) -> pd.Series:
    """RFC 7396 over JSON texts; null where either is null or not JSON."""

    def one(t, p):
        try:
            return _dump(_merge(json.loads(t), json.loads(p)))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(t, p) for t, p in zip(target, patch, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def json_patch(target: pd.Series, patch: pd.Series) -> pd.Series:
    """RFC 6902 over JSON texts; null where it does not apply."""

    def one(t, p):
        try:
            return _dump(apply_patch(json.loads(t), json.loads(p)))
        except (TypeError, ValueError, KeyError, IndexError):
            return None

    return pd.Series([one(t, p) for t, p in zip(target, patch, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def sorted_keys(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return pd.Series([one(t) for t in text], dtype=object)


def pointer(text: Column, path: str) -> Column:
    """The value at a JSON pointer, as text. A step of digits is an array's place or an object's key, whichever stands there."""
    ways = [""]
    for s in _steps(path):
        ways = [w + x for w in ways for x in ([f"[{s}]", f"['{s}']"] if s.isdigit() else [f"['{s}']"])]
    return F.coalesce(*[F.get_json_object(text, "$" + w) for w in ways])


def differences(before, after, path: str = "") -> list[dict]:
    """RFC 6902 operations that turn one tree into the other."""
    if isinstance(before, dict) and isinstance(after, dict):
        out = []
        for k in sorted({*before, *after}):
            at = f"{path}/{k.replace('~', '~0').replace('/', '~1')}"
            if k not in after:
                out.append({"op": "remove", "path": at})
            elif k not in before:
                out.append({"op": "add", "path": at, "value": after[k]})
            else:
                out += differences(before[k], after[k], at)
        return out
    if isinstance(before, list) and isinstance(after, list):
        out = [op for i, (a, b) in enumerate(zip(before, after, strict=False)) for op in differences(a, b, f"{path}/{i}")]
        out += [{"op": "remove", "path": f"{path}/{i}"} for i in range(len(before) - 1, len(after) - 1, -1)]
        return out + [{"op": "add", "path": f"{path}/-", "value": x} for x in after[len(before) :]]
    same = type(before) is type(after) and before == after
    return [] if same else [{"op": "replace", "path": path, "value": after}]


@F.pandas_udf(StringType())
def made_patch(before: pd.Series, after: pd.Series) -> pd.Series:
    """The patch that turns one JSON text into the other; null where either is null or not JSON."""

    def one(a, b):
        try:
            return _dump(differences(json.loads(a), json.loads(b)))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


def sort_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def properties(packets: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, namespace, path, value) of the leaves of a metadata packet: simple properties, array items, struct fields, qualifiers as attributes."""
    import xml.etree.ElementTree as ET

    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    rows = packets.select(F.col(id_col).cast("string").alias("id"), F.col(xml_col).cast("string").alias("xml"))

    def leaves(text):
        try:
            root = ET.fromstring(text)
        except (ET.ParseError, TypeError):
            return
        stack = [(e, "") for d in reversed([*root.iter(f"{{{rdf}}}Description")]) for e in reversed([*d])]
        for d in root.iter(f"{{{rdf}}}Description"):
            for name, value in d.attrib.items():
                ns, _, local = name[1:].rpartition("}")
                if ns != rdf:
                    yield ns, local, value
        while stack:
            e, above = stack.pop()
            ns, _, local = e.tag[1:].rpartition("}")
            if ns == rdf and local in ("Bag", "Seq", "Alt"):
                stack.extend((item, f"{above}[{i}]") for i, item in reversed([*enumerate(e, 1)]))
                continue
            path = above if ns == rdf and local == "li" else f"{above}/{local}" if above else local
            for name, value in e.attrib.items():
                q = name[1:].rpartition("}")
                if q[0] != rdf:
                    yield q[0] or ns, f"{path}/?{q[2]}", value
            if len(e):
                stack.extend((c, path) for c in reversed([*e]))
            elif (e.text or "").strip():
                yield ns, path, e.text.strip()

    def run(frames):
        for frame in frames:
            found = [(i, *leaf) for i, x in zip(frame["id"], frame["xml"], strict=True) for leaf in leaves(x)]
            yield pd.DataFrame(found, columns=["id", "namespace", "path", "value"])

    return rows.mapInPandas(run, "id string, namespace string, path string, value string")
