"""Tables, expressions and relationships out of TMDL text.

One vectorised helper turns each file into tagged rows (an indented block is an object, ``key: value`` a property, text after = an
expression that goes on over deeper lines); DataFrame operations shape the rows into tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PK = ["project_id", "snapshot_id"]
ROWS = "project_id string, snapshot_id string, path string, object string, table_name string, name string, parent string, expression string, props map<string,string>, ordinal int"
_OBJECT = re.compile(r"^(table|column|measure|partition|calculationGroup|calculationItem|refreshPolicy|relationship|expression|hierarchy|level|role|culture|annotation|changedProperty|variation)\b\s*(.*)$")
_WORDS = ("table", "column", "measure", "partition", "calculation", "refreshPolicy", "relationship", "expression", "hierarchy", "level", "role", "culture", "annotation", "changedProperty", "variation")
_PROPERTY = re.compile(r"^([A-Za-z]\w*)\s*:\s*(.*)$")
_EXPRESSION = re.compile(r"^(source|sourceExpression|pollingExpression|expression|formatStringDefinition|detailRowsDefinition)\s*=\s*(.*)$")
_FLAG = re.compile(r"^[a-z][A-Za-z]*$")


def unquoted(name: str) -> str:
    name = name.strip()
    return name[1:-1].replace("''", "'") if len(name) > 1 and name[0] == name[-1] == "'" else name


def _depth(line: str) -> int:
    if not line or not line[0].isspace():
        return 0
    lead = line[: len(line) - len(line.lstrip())]
    return lead.count("\t") + lead.replace("\t", "").count(" ") // 4


def _split_name(rest: str) -> tuple[str, str | None]:
    """Name and text after the equals sign, which counts outside quotes only."""
    m = re.match(r"^('(?:[^']|'')*'|[^=]*?)\s*(?:=\s*(.*))?$", rest, re.S)
    return (unquoted(m[1]), m[2]) if m else (rest, None)


def parse(text: str | None) -> list[dict]:
    """Objects of a TMDL text in order: object, name, parent (names of what it stands in), expression, props."""
    out: list[dict] = []
    stack: list[tuple[int, dict]] = []
    lines = (text or "").split("\n")
    if "\r" in (text or ""):
        lines = [x.rstrip("\r") for x in lines]
    i = 0

    def expression(first: str, depth: int, at: int) -> tuple[str, int]:
        """The expression that begins on a line, with what goes on deeper; ends where a property, flag or object of the level below begins."""
        body, n = [first] if first.strip() and first.strip() != "```" else [], at + 1
        while n < len(lines):
            s = lines[n].strip()
            d = _depth(lines[n])
            if s and d <= depth:
                break
            if s and d == depth + 1 and (_PROPERTY.match(s) or _FLAG.match(s) or _OBJECT.match(s) or _EXPRESSION.match(s)) and s not in ("let", "in"):
                break
            body.append(lines[n])
            n += 1
        while body and (not body[-1].strip() or body[-1].strip() == "```"):
            body.pop()
        lead = min((len(x) - len(x.lstrip()) for x in body[1 if first.strip() else 0 :] if x.strip()), default=0)
        return "\n".join(x if k == 0 and first.strip() else x[lead:] for k, x in enumerate(body)).strip(), n

    while i < len(lines):
        s, depth = lines[i].strip(), _depth(lines[i])
        if not s or s.startswith("///"):
            i += 1
            continue
        while stack and stack[-1][0] >= depth:
            stack.pop()
        owner = stack[-1][1] if stack else None
        if "=" in s and (m := _EXPRESSION.match(s)) and owner is not None and not (m[1] == "expression" and depth == 0):
            value, i = expression(m[2], depth, i)
            owner["props"][m[1]] = value
            if m[1] in ("source", "sourceExpression") and owner["expression"] is None:
                owner["expression"] = value
        elif s.startswith(_WORDS) and (m := _OBJECT.match(s)):
            name, first = _split_name(m[2])
            node = {"object": m[1], "name": name, "parent": [x["name"] for _, x in stack], "expression": None, "props": {}}
            i += 1
            if first is not None and m[1] == "partition":
                node["props"]["type"] = first.strip().lower()
            elif first is not None and m[1] != "annotation":
                node["expression"], i = expression(first, depth, i - 1)
            stack.append((depth, node))
            out.append(node)
        else:
            if owner is not None and (m := _PROPERTY.match(s)):
                owner["props"][m[1]] = m[2].strip()
            elif owner is not None and _FLAG.match(s):
                owner["props"][s] = "true"
            i += 1
    return out


_ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "string": pa.string()}.get(c.split()[1], pa.map_(pa.string(), pa.string()))) for c in ROWS.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def batches(files: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """The objects of all files, size at most in a batch, so that what a task holds is one file's objects and not those of all its files."""
    out: list[tuple] = []
    for b in files:
        for p, s, path, content in zip(*(b.column(c) for c in ("project_id", "snapshot_id", "path", "content"))):
            p, s, path, found = p.as_py(), s.as_py(), path.as_py(), parse(content.as_py())
            table = next((o["name"] for o in found if o["object"] == "table"), None)
            for k, o in enumerate(found):
                out.append((p, s, path, o["object"], table, o["name"], o["parent"][-1] if o["parent"] else None, o["expression"], list(o["props"].items()), k))
                if len(out) == size:
                    yield _batch(out)
                    out = []
    if out:
        yield _batch(out)


def rows(files: DataFrame) -> DataFrame:
    """One row per object of each file. No shuffle; file contents are parsed where they are read."""
    return files.select(*PK, "path", "content").mapInArrow(batches, ROWS)


def _flag(name: str):
    return F.coalesce(F.lower(F.col("props")[name]) == "true", F.lit(False))


def columns(objects: DataFrame) -> DataFrame:
    o = objects.filter("object = 'column'")
    return o.select(*PK, "table_name", "name", F.col("props")["dataType"].alias("data_type"), unquoted_sql(F.col("props")["sourceColumn"]).alias("source_column"), "expression", _flag("isHidden").alias("is_hidden"), F.col("expression").isNotNull().alias("is_calculated"))


def measures(objects: DataFrame) -> DataFrame:
    return objects.filter("object = 'measure'").select(*PK, "table_name", "name", "expression", _flag("isHidden").alias("is_hidden"), F.col("props")["formatString"].alias("format_string"), "props")


def partitions(objects: DataFrame) -> DataFrame:
    """Partitions; a refresh policy's source comes before the partition's own body."""
    policy = objects.filter("object = 'refreshPolicy'").groupBy(*PK, "table_name").agg(F.min("expression").alias("policy"))
    p = objects.filter("object = 'partition'").join(policy, [*PK, "table_name"], "left")
    return p.select(*PK, "table_name", "name", F.col("props")["type"].alias("type"), F.lower(F.col("props")["mode"]).alias("mode"), F.coalesce("policy", "expression").alias("m_body"), "ordinal", *(unquoted_sql(F.col("props")[k]).alias(c) for k, c in (("entityName", "entity_name"), ("schemaName", "schema_name"), ("expressionSource", "expression_source"))))


def calculation_items(objects: DataFrame) -> DataFrame:
    return objects.filter("object = 'calculationItem'").select(*PK, "table_name", "name", "expression")


def expressions(objects: DataFrame) -> DataFrame:
    """Shared expressions; a literal with a meta record is a parameter with a value."""
    e = objects.filter("object = 'expression'")
    literal = F.regexp_extract("expression", r'(?s)^"((?:[^"]|"")*)"\s*meta\s*\[', 1)
    is_parameter = F.col("expression").rlike(r'(?s)^("(?:[^"]|"")*"|-?\d+(\.\d+)?|true|false|null)\s*meta\s*\[')
    return e.select(*PK, "name", F.when(is_parameter, "parameter").otherwise("expression").alias("kind"), F.col("expression").alias("body"), F.when(is_parameter, F.when(F.col("expression").startswith('"'), literal).otherwise(F.regexp_extract("expression", r"^(\S+)", 1))).alias("value"))


def unquoted_sql(c):
    return F.when(c.rlike("^'.*'$"), F.regexp_replace(F.regexp_extract(c, "^'(.*)'$", 1), "''", "'")).otherwise(c)


def _endpoint(c):
    """(table, column) of a.b, 'a'.b, a.'b' and a[b]: the first dot outside quotes parts them."""
    p = r"^('(?:[^']|'')*'|[^.'\[]+)(?:\.|\[)('(?:[^']|'')*'|[^\]]+)\]?$"
    return unquoted_sql(F.regexp_extract(c, p, 1)), unquoted_sql(F.regexp_extract(c, p, 2))


def relationships(objects: DataFrame) -> DataFrame:
    r = objects.filter("object = 'relationship'")
    (ft, fc), (tt, tc) = _endpoint(F.col("props")["fromColumn"]), _endpoint(F.col("props")["toColumn"])
    both = F.when(F.lower(F.col("props")["crossFilteringBehavior"]).contains("both"), "both").otherwise("single")
    return r.select(*PK, "name", ft.alias("from_table"), fc.alias("from_column"), tt.alias("to_table"), tc.alias("to_column"), both.alias("cross_filter"), (F.lower(F.coalesce(F.col("props")["isActive"], F.lit("true"))) != "false").alias("is_active"))
