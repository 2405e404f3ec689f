"""Deeply nested records to flat tables, with Merkle identities of objects.

Objects are hashed bottom-up: the identity of an object covers its scalars and the identities of the objects inside it.
Equal objects get one row in `objects`, wherever they occur; each occurrence keeps a bridge row with its record, its
parent object, its place (path, position in its array) and its depth. One narrow pass over the records makes both; only
the distinct objects are shuffled, after combining on the map side.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRIDGE = "table_name string, column_name string, record_id long, path string, parent_path string, field string, position int, depth int, node_id binary, parent_id binary, body string"
BATCH_CHARS = 8_000_000


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse)
_TOKEN = re.compile(r'[ \t\n\r]*([{}\[\],"]|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null)', re.A)
_COLON, _BLANK = re.compile(r"[ \t\n\r]*:"), re.compile(r"[ \t\n\r]*\Z")


def loads(text: str) -> object:
    """The value of a JSON text of any depth. A byte-order mark is skipped; NaN and infinities aren't JSON."""
    text = text.removeprefix("\ufeff")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str) -> object:
    """The same with a stack of its own, for texts nested deeper than the decoder may call itself."""
    root, stack, key, want, at = None, [], None, "value", 0
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        t, at = m[1], m.end()
        if want.startswith("key") and t == '"':
            key, at = json.decoder.scanstring(text, at, True)
            m = _COLON.match(text, at)
            if not m:
                raise ValueError(f"no colon at {at}")
            at, want = m.end(), "value"
            continue
        if t == ",":
            if want != "next":
                raise ValueError(f"a comma at {at}")
            want = "value" if isinstance(stack[-1], list) else "key"
            continue
        if t in ("]", "}"):
            if want not in ("next", "key or end", "value or end") or not isinstance(stack[-1], list if t == "]" else dict):
                raise ValueError(f"an end at {at}")
            stack.pop()
            want = "next"
        else:
            if not want.startswith("value"):
                raise ValueError(f"a value at {at}")
            if t == '"':
                v, at = json.decoder.scanstring(text, at, True)
            else:
                v = {} if t == "{" else [] if t == "[" else json.loads(t)
            if not stack:
                root = v
            elif isinstance(stack[-1], list):
                stack[-1].append(v)
            else:
                stack[-1][key] = v
            want = "next"
            if t in ("[", "{"):
                stack.append(v)
                want = "value or end" if t == "[" else "key or end"
        if not stack:
            if not _BLANK.match(text, at):
                raise ValueError(f"more text at {at}")
            return root


class _Text(str):
    """Written as it stands."""


def _canonical(value: object) -> str:
    """JSON with sorted keys and no blanks, of any depth."""
    try:
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Text):
            out.append(v)
        elif isinstance(v, list | dict):
            parts: list = []
            for x in sorted(v.items()) if isinstance(v, dict) else v:
                parts += [_Text("," if parts else ""), *((_Text(json.dumps(x[0], ensure_ascii=False) + ":"), x[1]) if isinstance(v, dict) else (x,))]
            todo += reversed([_Text("[" if isinstance(v, list) else "{"), *parts, _Text("]" if isinstance(v, list) else "}")])
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def parse(text: str | None) -> object:
    """The value in a JSON text, None if it does not parse; texts of texts are read through."""
    if text is None:
        return None
    try:
        return unfold(loads(text))
    except ValueError:
        return None


def unfold(value: object) -> object:
    """A string whose content is a JSON object or array is that object or array."""
    while isinstance(value, str):
        head = value.lstrip()[:1]
        if head not in ("{", "[", '"') or not head:
            return value
        try:
            inner = loads(value)
        except ValueError:
            return value
        if not isinstance(inner, dict | list | str):
            return value
        if isinstance(inner, str) and not isinstance(unfold(inner), dict | list):
            return value
        value = inner
    return value


def walk(value: object) -> list[tuple]:
    """(path, parent_path, field, position, depth, body, node, parent) of every object, children first.

    The stack is explicit, so depth has no limit, and a record gives all its rows or none.
    """
    done: list[tuple] = []

    def opened(v: dict | list, key, path: str, above: str, field: str, position: int | None, depth: int) -> tuple:
        """v with its parts to come, what stands for it in its parent's identity, and the rows that still need that identity."""
        inside = isinstance(v, dict)
        return iter(v.items() if inside else enumerate(v)), inside, {} if inside else [None] * len(v), [], key, path, above, field, position, depth

    value = unfold(value)
    if not isinstance(value, dict | list):
        return []
    stack = [opened(value, None, "$", "", "", None, 0)]
    while stack:
        parts, inside, made, rows, key, path, above, field, position, depth = stack[-1]
        for k, x in parts:
            if type(x) in (int, float, bool) or x is None:
                made[k] = x
                continue
            if isinstance(x, str):
                x = unfold(x)
            if not isinstance(x, dict | list):
                made[k] = x
                continue
            stack.append(opened(x, k, f"{path}.{k}", path, k, None, depth + 1) if inside else opened(x, k, f"{path}[{k}]", above if depth else "$", field, k, depth))
            break
        else:
            stack.pop()
            if inside:
                body = _canonical(made)
                node = blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                done += [(*r, node) for r in rows]
                made, rows = {"#": node.hex()}, [(path, above, field, position, depth, body, node)]
            if stack:
                stack[-1][2][key] = made
                stack[-1][3].extend(rows)
            else:
                done += [(*r, None) for r in rows]
    return done


def _flatten(batches: Iterator[pa.RecordBatch], lists: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in BRIDGE.split(", ")]
    cols: list[list] = [[] for _ in names]
    size = 0
    for batch in batches:
        for table, column, record, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            value = parse(text)
            if isinstance(value, dict) and column == "labels_json" and lists:
                value = [value]
            for path, above, field, position, depth, body, node, parent in walk(value):
                for c, x in zip(cols, (table, column, record, path, above, field, position, depth, node, parent, body), strict=True):
                    c.append(x)
                size += 100 + len(path) + len(above) + len(body)
                if size >= BATCH_CHARS:
                    yield _batch(cols, names)
                    cols, size = [[] for _ in names], 0
    if cols[0]:
        yield _batch(cols, names)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(cols: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [_ARROW[f.split(" ")[1]] for f in BRIDGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def bridge(records: DataFrame, lone_label_lists: bool = False) -> DataFrame:
    """One row for each occurrence of an object: where it stands and what it is.

    records: table_name, column_name, record_id, text. Columns of the result as in BRIDGE: `position` is the index in
    the array that holds the object (null outside arrays), `field` the key it stands under, `node_id` its identity,
    `parent_id` that of the object around it (null at the root), `body` its canonical content with inner objects as
    {"#": identity}. Null, blank or broken texts and texts that hold no object give no rows. Strings that hold an object
    or array are read as such at any depth. Places are those of the text as it stands: a lone label object is `$`, and
    only with lone_label_lists the first element of a list of one (`$[0]`).
    """
    plain = records.select("table_name", "column_name", "record_id", "text").where("text is not null")
    return plain.mapInArrow(lambda it: _flatten(it, lone_label_lists), BRIDGE)


def objects(bridged: DataFrame) -> DataFrame:
    """node_id, body, occurrences: every distinct object once."""
    return bridged.groupBy("node_id").agg(F.first("body").alias("body"), F.count("*").alias("occurrences"))


def flat_table(bridged: DataFrame, table_name: str, column_name: str, place: str) -> DataFrame:
    """A typed table of the objects that stand at one place of a column, such as `$[].regions[]` or `$.capture.device`.

    record_id, path, parent_path, position, node_id name the row, its parent row and its place there; then come the
    object's own values, typed by the schema of all of them (arrays of values stay arrays, inner objects are rows of
    their own place). A value's column whose name clashes with these gets a trailing underscore. No such objects: none
    but the five columns.
    """
    here = bridged.where((F.col("table_name") == table_name) & (F.col("column_name") == column_name) & (F.regexp_replace("path", r"\[\d+\]", "[]") == place))
    bodies = here.groupBy("node_id").agg(F.first("body").alias("body"))  # equal objects are read once
    schema = bodies.agg(F.schema_of_variant_agg(F.try_parse_json("body"))).first()[0]
    keys = ["record_id", "path", "parent_path", "position", "node_id"]
    if not schema or not schema.startswith("OBJECT<"):
        return here.select(*keys)
    typed = bodies.select("node_id", F.from_json("body", schema.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")).alias("o"))
    fields = [f for f in typed.schema["o"].dataType.fields if not _inner(f.dataType)]
    own = typed.select("node_id", *[F.col("o")[f.name].alias(f"{f.name}_" if f.name in keys else f.name) for f in fields])
    return here.select(*keys).join(own, "node_id").select(*keys, *[c for c in own.columns if c not in keys])


def _inner(kind) -> bool:
    """Whether values of this type are references to objects of their own."""
    while hasattr(kind, "elementType"):
        kind = kind.elementType
    return hasattr(kind, "fieldNames") and kind.fieldNames() == ["#"]


def catalog_records(samples: DataFrame, algorithms: DataFrame, tasks: DataFrame) -> DataFrame:
    """The four nested columns of the catalog in one shape."""
    out = None
    for name, df, columns in (("samples", samples, ("labels_json", "metadata_json")), ("algorithms", algorithms, ("input_contract_json",)), ("tasks", tasks, ("result_json",))):
        pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in columns]
        one = df.select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), F.explode(F.array(*pairs)).alias("x")).select("table_name", "x.column_name", "record_id", "x.text")
        out = one if out is None else out.unionByName(one)
    return out
