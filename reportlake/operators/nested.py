"""Deeply nested records as flat related tables with Merkle subtree identities.

Every JSON value is canonicalised and hashed bottom-up: the hash of an object or
array covers the hashes of its children, so equal subtrees have equal hashes
wherever they occur.  Distinct subtrees are stored once; each occurrence is a row
of the bridge table with parent, key path and ordinal.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OCCURRENCES = (
    "parent_id string, child string, path string, pos int, kind string, parent_hash string, node_hash string, node string"
)
#: Hex digits of a subtree identity (128 bits).
HASH_HEX = 32


class _Pairs(list):
    """An object's members as read: order and repeated keys kept."""


_TOKEN = re.compile(r'[\s]*([\[\]{},:]|"(?:[^"\\]|\\.)*"|[^\s\[\]{},:"]+)', re.S)


def _parse_deep(text: str):
    """JSON value of a text nested deeper than the standard reader goes, by a stack."""
    stack: list[list] = []  # [container, pending key or None]
    at, value, done = 0, None, False
    end = len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or done:
            raise ValueError("no JSON")
        at, t = m.end(), m.group(1)
        if t in "{[":
            stack.append([_Pairs() if t == "{" else [], None])
            continue
        if t in ",:":
            continue
        if t in "}]":
            value = stack.pop()[0] if stack else None
            if value is None or isinstance(value, _Pairs) != (t == "}"):
                raise ValueError("no JSON")
        else:
            value = json.loads(t)
        if not stack:
            done = True
        elif not isinstance(stack[-1][0], _Pairs):
            stack[-1][0].append(value)
        elif stack[-1][1] is None:
            if not isinstance(value, str):
                raise ValueError("no JSON")
            stack[-1][1] = (value,)
        else:
            stack[-1][0].append((stack[-1][1][0], value))
            stack[-1][1] = None
    if not done:
        raise ValueError("no JSON")
    return value


def _load(text: str):
    """JSON value of a text, of any depth.  A string that itself holds JSON is opened
    again, as often as it is quoted; a text that is no JSON raises ValueError."""
    value = text
    while isinstance(value, str):
        try:
            value = json.loads(value, object_pairs_hook=_Pairs)
        except RecursionError:
            value = _parse_deep(value)
    return value


def _identities(root) -> dict[int, tuple[str, str]]:
    """id of each container and leaf position -> (hash, canonical text naming the
    children by hash), bottom-up in one pass without recursion."""
    known: dict[int, tuple[str, str]] = {}
    stack = [(root, False)]
    while stack:
        value, ready = stack.pop()
        parts = [v for _, v in value] if isinstance(value, _Pairs) else value
        if not ready:
            stack.append((value, True))
            stack += [(v, False) for v in parts if isinstance(v, list)]
        elif isinstance(value, _Pairs):
            members = sorted(((k, _identity(v, known)[0]) for k, v in value), key=lambda kv: kv[0])
            known[id(value)] = _digest("{" + ",".join(f"{json.dumps(k)}:{h}" for k, h in members) + "}")
        else:
            known[id(value)] = _digest("[" + ",".join(_identity(v, known)[0] for v in value) + "]")
    return known


def _digest(body: str) -> tuple[str, str]:
    return hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()[:HASH_HEX], body


def _identity(value, known: dict[int, tuple[str, str]]) -> tuple[str, str]:
    return known[id(value)] if isinstance(value, list) else _digest(json.dumps(value, ensure_ascii=False))


def _walk(doc_id: str, text: str, out: list[tuple]) -> None:
    """Bridge rows of one JSON text, parents before children; one row of kind
    ``broken`` holds a text that is no JSON object or array."""
    try:
        root = _load(text)
    except ValueError:
        root = text
    if not isinstance(root, list):
        if root is not None and text.strip():
            out.append((doc_id, "finding", "", 0, "broken", None, *_digest(text)))
        return
    known = _identities(root)
    out.append((doc_id, "finding", "", 0, "root", None, *_identity(root, known)))
    stack = [(root, (), "")]
    while stack:
        value, path, inner = stack.pop()
        here = known[id(value)][0]
        below = []
        if isinstance(value, _Pairs):
            rows = []
            for n, (key, sub) in enumerate(value):
                at = (*path, key)
                if isinstance(sub, str):
                    rows.append((at, 0, "element", sub))
                elif isinstance(sub, list):
                    rows.append((at, n, "object" if isinstance(sub, _Pairs) else "array", sub))
                    below.append((sub, at, inner))
                else:
                    rows.append((at, n, "member", sub))
        else:
            rows = [(path, n, "null" if v is None else "element", v) for n, v in enumerate(value)]
            below = [(v, (*path, f"[{n}]"), "inner ") for n, v in enumerate(value) if isinstance(v, list)]
        out += [(doc_id, "finding", " > ".join(p), i, inner + kind, here, *_identity(v, known)) for p, i, kind, v in rows]
        stack += reversed(below)


def json_occurrences(reports: DataFrame, id_col: str = "report_id", json_col: str = "findings_tree") -> DataFrame:
    """Bridge rows of a JSON column (see ``OCCURRENCES``), one per value; a text in place
    of an array is an element at 0.

    ``kind`` is ``root``, ``object``, ``array``, ``element``, ``null`` (in an array) or
    ``member`` (number, boolean or null of an object); what lies within an array element
    has ``inner`` before it and the element's ordinal in the path.  Null and empty texts
    give no rows; a text that is no JSON object or array gives one of kind ``broken`` with
    the whole text.  Rows without id are left out, as nothing could lead back to them."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in OCCURRENCES.split(", ")]
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b["id"], b["tree"], strict=True):
                _walk(i, t, out)
            yield pd.DataFrame(out, columns=names)

    src = reports.select(F.col(id_col).alias("id"), F.col(json_col).alias("tree")).where("id is not null and tree is not null")
    return src.mapInPandas(parse, OCCURRENCES)


def array_occurrences(rows: DataFrame, child: str, id_col: str, array_col: str) -> DataFrame:
    """Bridge rows of an array-of-struct column, with built-in functions: the array as
    ``root``, its elements, and their fields as ``inner member``, hashed like JSON.

    Null and empty arrays give no rows; a null element is of kind ``null``."""
    src = rows.select(F.col(id_col).alias("parent_id"), F.col(array_col).alias("items")).where(
        "parent_id is not null and size(items) > 0"
    )
    names = sorted(src.schema["items"].dataType.elementType.names)
    digest = lambda c: F.substring(F.sha2(c, 256), 1, HASH_HEX)
    # a field as JSON: its own text, or null
    text = lambda x, n: F.coalesce(F.substr(F.to_json(F.array(x[n])), F.lit(2), F.length(F.to_json(F.array(x[n]))) - 2), F.lit("null"))
    fields = lambda x: F.array(*(F.struct(F.lit(n).alias("name"), text(x, n).alias("node")) for n in names))
    hashed = lambda fs: F.transform(fs, lambda f: F.struct(f["name"].alias("name"), f.node.alias("node"), digest(f.node).alias("hash")))
    body = lambda fs: F.concat(F.lit("{"), F.array_join(F.transform(fs, lambda f: F.concat(F.lit('"'), f["name"], F.lit('":'), f.hash)), ","), F.lit("}"))
    read = src.withColumn("xs", F.transform("items", lambda x: F.when(x.isNotNull(), hashed(fields(x)))))
    read = read.withColumn("bodies", F.transform("xs", lambda fs: F.coalesce(body(fs), F.lit("null"))))
    read = read.withColumn("root", F.concat(F.lit("["), F.array_join(F.transform("bodies", digest), ","), F.lit("]")))
    row = lambda path, pos, kind, parent, node: F.struct(
        path.alias("path"), pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), parent.alias("parent_hash"), digest(node).alias("node_hash"), node.alias("node")
    )
    none = F.lit(None).cast("string")
    root = F.array(row(F.lit(""), F.lit(0), "root", none, F.col("root")))
    elements = F.transform("bodies", lambda b, i: row(F.lit(""), i, "element", digest(F.col("root")), b))
    members = F.flatten(
        F.transform(
            F.arrays_zip("xs", "bodies"),
            lambda z, i: F.transform(
                F.coalesce(z.xs, F.array().cast("array<struct<name:string,node:string,hash:string>>")),
                lambda f, k: row(F.concat(F.lit("["), i.cast("string"), F.lit("] > "), f["name"]), k, "inner member", digest(z.bodies), f.node),
            ),
        )
    )
    kind = F.when((F.col("r.kind") == "element") & (F.col("r.node") == "null"), "null").otherwise(F.col("r.kind"))
    return read.select("parent_id", F.explode(F.concat(root, elements, members)).alias("r")).select(
        "parent_id", F.lit(child).alias("child"), "r.path", "r.pos", kind.alias("kind"), "r.parent_hash", "r.node_hash", "r.node"
    )


def occurrences(reports: DataFrame, records: DataFrame) -> DataFrame:
    """Bridge rows of findings, impressions and trails of all given rows."""
    return (
        json_occurrences(reports)
        .unionByName(array_occurrences(reports, "impression", "report_id", "impression"))
        .unionByName(array_occurrences(records, "trail", "id", "trail"))
    )


def subtree_store(bridge: DataFrame) -> DataFrame:
    """``node_hash, node, uses``: every distinct subtree once."""
    return bridge.groupBy("node_hash").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("uses"))


def child_rows(bridge: DataFrame) -> DataFrame:
    """``parent_id, child, path, pos``: one row per non-null array element, repeated
    rows and further versions of a parent counted once."""
    return bridge.where("kind = 'element'").select("parent_id", "child", "path", "pos").distinct()
