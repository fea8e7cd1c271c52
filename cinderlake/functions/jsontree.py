"""Walks over JSON of any shape and depth: small Arrow-batched helpers.

Native JSON and VARIANT expressions address fixed paths, and give up below a nesting of
1,000; these helpers find keys at any depth.  Nothing here recurses: a text nested too
deeply for the fast reader is read by a tokenizer that pulls one token at a time and
keeps the open containers on a stack, and values are walked and written the same way.
What a walk returns is linear in the text, however deep it is.  Objects are walked in
key order, so results don't depend on how a text was written.  Text that isn't JSON
gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types as objects: workers import this module, and only the driver can parse type strings.
TEXT = T.StringType()
TEXTS = T.ArrayType(TEXT)


def rows_type(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


NODE = rows_type(ord=T.IntegerType(), parent=T.IntegerType(), depth=T.IntegerType(), key=TEXT, kind=TEXT, value=TEXT, size=T.IntegerType(), under=TEXTS)
SERVER = rows_type(name=TEXT, spec=TEXT, pairs=rows_type(key=TEXT, value=TEXT))
TOOLS = rows_type(name=TEXT, description=TEXT, inputSchema=TEXT, annotations=TEXT)
PINS = rows_type(name=TEXT, version=TEXT, resolved=TEXT, integrity=TEXT)
#: Keys that members below them are marked with.
MARKS = ("hooks", "mcpServers")

_SPACE = re.compile(r"[ \t\n\r]*").match
_PLAIN = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?").match
_CLOSER = {"{": "}", "[": "]"}


def pulled(text: str) -> Iterator[tuple[str, object]]:
    """Tokens of a JSON text: the brackets, ``key`` and ``value`` with what they hold.  A text that isn't JSON is a ValueError."""
    open_: list[str] = []
    at, need = _SPACE(text, 0).end(), "value"
    while True:
        c = text[at : at + 1]
        if need == "after":
            if not open_:
                if c:
                    raise ValueError("text after the value")
                return
            if c == ",":
                at, need = at + 1, "value" if open_[-1] == "[" else "key"
            elif c == _CLOSER[open_[-1]]:
                open_.pop()
                at += 1
                yield c, None
            else:
                raise ValueError("no comma or end")
        elif need in ("key", "key or end"):
            if c == "}" and need == "key or end":
                need = "after"
                continue
            if c != '"':
                raise ValueError("no key")
            key, at = scanstring(text, at + 1, True)
            at = _SPACE(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            at, need = at + 1, "value"
            yield "key", key
        elif c == "]" and need == "value or end":
            need = "after"
            continue
        elif c and c in "{[":
            open_.append(c)
            at, need = at + 1, "key or end" if c == "{" else "value or end"
            yield c, None
        else:
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            else:
                plain = _PLAIN(text, at)
                if not plain:
                    raise ValueError("no value")
                value, at = json.loads(plain[0]), plain.end()
            need = "after"
            yield "value", value
        at = _SPACE(text, at).end()


def built(text: str):
    """The value of a JSON text of any depth."""
    top: list = []
    above: list = []  # containers that are open, with the key that the next value goes to
    into, key = top, None
    for kind, x in pulled(text):
        if kind == "key":
            key = x
            continue
        if kind in "}]":
            into, key = above.pop()
            continue
        value = {} if kind == "{" else [] if kind == "[" else x
        if isinstance(into, dict):
            into[key] = value
        else:
            into.append(value)
        if kind in "{[":
            above.append((into, key))
            into = value
    return top[0]


def _load(text):
    try:
        return True, json.loads(text)
    except RecursionError:
        pass
    except (TypeError, ValueError):
        return False, None
    try:
        return True, built(text)
    except ValueError:
        return False, None


_compact = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def canonical(value) -> str:
    """Keys sorted, no white space, numbers as Python writes them."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo = [iter([(None, value)])]  # members that are left of each open container
    closers, fresh = [""], True
    while todo:
        member = next(todo[-1], None)
        if member is None:
            todo.pop()
            out.append(closers.pop())
            fresh = False
            continue
        key, x = member
        if not fresh:
            out.append(",")
        if key is not None:
            out.append(f"{_compact(key)}:")
        if isinstance(x, (dict, list)):
            out.append("{" if isinstance(x, dict) else "[")
            closers.append("}" if isinstance(x, dict) else "]")
            todo.append(iter(sorted(x.items())) if isinstance(x, dict) else ((None, v) for v in x))
            fresh = True
        else:
            out.append(_compact(x))
            fresh = False
    return "".join(out)


def _kind(v) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")


def _values(value) -> Iterator[tuple]:
    """Every value, depth first: key (of a member of an object), value, number of the member that holds it, its depth, marks above."""
    todo = [(None, value, -1, 0, ())]
    number = -1
    while todo:
        key, v, parent, depth, under = todo.pop()
        if key is not None:
            number += 1
            yield key, v, parent, depth, under
            parent, depth = number, depth + 1
            if key in MARKS and key not in under:
                under = (*under, key)
        else:
            yield key, v, parent, depth, under
        if isinstance(v, dict):
            todo += [(k, v[k], parent, depth, under) for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            todo += [(None, x, parent, depth, under) for x in reversed(v)]


def _members(value) -> Iterator[tuple]:
    return (x for x in _values(value) if x[0] is not None)


def _shallow(v) -> str:
    """A value as text; of a container, what it holds itself, without the containers inside."""
    if isinstance(v, dict):
        v = {k: x for k, x in v.items() if not isinstance(x, (dict, list))}
    elif isinstance(v, list):
        v = [x for x in v if not isinstance(x, (dict, list))]
    return v if isinstance(v, str) else canonical(v)


def _each(texts: pd.Series, f) -> pd.Series:
    out = []
    for t in texts:
        ok, v = _load(t)
        out.append(f(v) if ok else None)
    return pd.Series(out, dtype=object)


@F.arrow_udf(TEXT)
def canonical_json(texts: pa.Array) -> pa.Array:
    """One text for all spellings of a value: keys sorted, no white space, numbers as written."""
    return pa.array([canonical(v) if ok else None for ok, v in map(_load, texts.to_pylist())], pa.string())


@F.pandas_udf(NODE)
def nodes(texts: pd.Series) -> pd.Series:
    """Every object member at any depth, in the order of a depth-first walk.

    ``parent``: the ``ord`` of the member that holds it, -1 at the top; ``depth``: how many
    hold it; ``under``: which of ``MARKS`` these are.  ``value`` of an object or array is
    what it holds itself; what is deeper has rows of its own.
    """

    def f(v):
        return [
            {"ord": i, "parent": p, "depth": d, "key": k, "kind": _kind(x), "size": len(x) if isinstance(x, (list, dict, str)) else 0, "under": list(u), "value": _shallow(x)}
            for i, (k, x, p, d, u) in enumerate(_members(v))
        ]

    return _each(texts, f)


def nodes_of(keys: list[str], text: Column) -> Column:
    """Of ``nodes``, those with one of these keys.  A text that holds none of them isn't read; a key may be spelled with escapes."""
    kept = frozenset(keys)

    @F.pandas_udf(NODE)
    def found(texts: pd.Series) -> pd.Series:
        def f(v):
            return [
                {"ord": i, "parent": p, "depth": d, "key": k, "kind": _kind(x), "size": len(x) if isinstance(x, (list, dict, str)) else 0, "under": list(u), "value": _shallow(x)}
                for i, (k, x, p, d, u) in enumerate(_members(v)) if k in kept
            ]

        return _each(texts, f)

    return found(may_hold(keys, text))


def may_hold(keys: list[str], text: Column) -> Column:
    """A text that can have members with one of these keys, else null."""
    held = F.contains(text, F.lit("\\u"))
    for k in keys:
        held = held | F.contains(text, F.lit(f'"{k}"'))
    return F.when(held, text)


@F.pandas_udf(TEXTS)
def string_values(texts: pd.Series) -> pd.Series:
    """Every string value, in the order of a depth-first walk."""
    return _each(texts, lambda v: [x for _, x, *_ in _values(v) if isinstance(x, str)])


@F.pandas_udf(TEXTS)
def property_names(texts: pd.Series) -> pd.Series:
    """Keys of every object named ``properties``, at any depth."""
    return _each(texts, lambda v: [n for k, x, *_ in _members(v) if k == "properties" and isinstance(x, dict) for n in sorted(x)])


def _pins(value) -> list[dict]:
    """Packages of ``dependencies`` maps, and of those in them, depth first."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        inner = v.get("dependencies") if isinstance(v, dict) else None
        if isinstance(inner, dict):
            todo += [inner[k] for k in sorted(inner, reverse=True)]
            out += [(k, inner[k]) for k in sorted(inner)]
    as_text = lambda x: x if x is None or isinstance(x, str) else canonical(x)
    return [{"name": k} | {f: as_text(x.get(f)) for f in ("version", "resolved", "integrity")} for k, x in out if isinstance(x, dict)]


@F.pandas_udf(PINS)
def locked_packages(texts: pd.Series) -> pd.Series:
    """Packages of a lock whose ``dependencies`` hold ``dependencies``."""
    return _each(texts, _pins)


def _tools(value, notes=lambda x: x) -> list[dict] | None:
    """Tools of a manifest as ``manifest.tools_array`` finds them.  ``notes``: what is kept of annotations."""
    if isinstance(value, dict):
        result = value.get("result")
        if isinstance(result, dict) and isinstance(result.get("tools"), list):
            value = result["tools"]
        elif isinstance(result, list):
            value = result
        elif isinstance(value.get("tools"), list):
            value = value["tools"]
        elif value.get("name") is not None:
            value = [value]
    if not isinstance(value, list):
        return None
    as_text = lambda x: x if x is None or isinstance(x, str) else canonical(x)
    fields = lambda t: {f: as_text(t.get(f)) for f in ("name", "description", "inputSchema")} | {"annotations": as_text(notes(t.get("annotations")))}
    return [fields(t) if isinstance(t, dict) else None for t in value]


def _flagged_tools(value) -> list[dict] | None:
    """``_tools``; of annotations that are objects, only the members that are booleans."""
    return _tools(value, lambda x: dict(_booleans(x)) if isinstance(x, dict) else x)


@F.pandas_udf(TOOLS)
def deep_tools(texts: pd.Series) -> pd.Series:
    """The tools of manifests that are nested too deeply for native expressions."""
    return _each(texts, _tools)


@F.pandas_udf(TOOLS)
def deep_flagged_tools(texts: pd.Series) -> pd.Series:
    """``deep_tools`` for those who read only booleans of annotations: the others, which may be long, stay behind."""
    return _each(texts, _flagged_tools)


def _booleans(value) -> list[tuple[str, bool]]:
    return [(k, x) for k, x in value.items() if isinstance(x, bool)] if isinstance(value, dict) else []


@F.arrow_udf(T.MapType(TEXT, T.BooleanType()))
def top_booleans(texts: pa.Array) -> pa.Array:
    """Members of the outermost object that are JSON booleans.  Of a batch, one value is held at a time: a deep one takes many times its text."""
    return pa.array([_booleans(_load(t.as_py())[1]) for t in texts], pa.map_(pa.string(), pa.bool_()))


@F.pandas_udf(SERVER)
def tool_servers(texts: pd.Series) -> pd.Series:
    """Servers under every ``mcpServers``: command line, and strings of env, headers and args that may be secrets."""

    def server(name, cfg):
        cfg = cfg if isinstance(cfg, dict) else {}
        args = cfg.get("args") if isinstance(cfg.get("args"), list) else []
        pairs = [(k, v) for part in ("env", "headers") if isinstance(cfg.get(part), dict) for k, v in sorted(cfg[part].items()) if isinstance(v, str)]
        pairs += [(f"args[{i}]", v) for i, v in enumerate(args) if isinstance(v, str)]
        command = cfg.get("command")
        spec = " ".join([command, *[a for a in args if isinstance(a, str)]]) if isinstance(command, str) else None
        return {"name": name, "spec": spec, "pairs": [{"key": k, "value": v} for k, v in pairs]}

    def f(v):
        return [server(n, c) for k, x, *_ in _members(v) if k == "mcpServers" and isinstance(x, dict) for n, c in sorted(x.items())]

    return _each(texts, f)


def strict_bool(json_text: Column, key: str) -> Column:
    """A member that is a JSON boolean, else null (the string "true" is no boolean)."""
    whole = F.try_parse_json(json_text)
    v = F.try_variant_get(whole, f"$.{key}", "variant")
    native = F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(whole, f"$.{key}", "boolean"))
    # Only a text that native expressions can't read goes to the walk.
    deep = top_booleans(F.when(whole.isNull(), json_text))
    return F.coalesce(native, F.try_element_at(deep, F.lit(key)))
