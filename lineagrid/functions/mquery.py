"""Facts in Power Query (M) and SQL text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import call_arguments, split_top

_ARG = r'(?:"([^"]*)"|(#"[^"]*"|[A-Za-z_]\w*(?=\s*[,)])))'
# fixed values: connector functions and the systems that they read
SERVER_DATABASE = {
    r"Sql\.Databases?": "SQL Server", r"AnalysisServices\.Database": "Analysis Services", r"Snowflake\.Databases": "Snowflake", r"PostgreSQL\.Database": "PostgreSQL",
    r"MySQL\.Database": "MySQL", r"(?:AzureDataExplorer|Kusto)\.Contents": "Azure Data Explorer",
}
SERVER = {r"Oracle\.Database": "Oracle", r"Teradata\.Database": "Teradata", r"SapHana\.Database": "SAP HANA", r"Odbc\.(?:DataSource|Query)": "ODBC", r"Fabric\.Warehouse": "Fabric Warehouse", r"Databricks\.Catalogs": "Databricks"}
URL = {r"OData\.Feed": "OData", r"Web\.Contents": "Web", r"SharePoint\.Tables": "SharePoint Tables", r"SharePoint\.Files": "SharePoint Files", r"AzureStorage\.Blobs": "Azure Blob Storage", r"Dataverse\.Contents": "Dataverse"}
FILE = {r"Excel\.Workbook\s*\(\s*File\.Contents": "Excel", r"Csv\.Document\s*\(\s*File\.Contents": "CSV"}
BARE = {r"PowerBI\.Dataflows": "Power BI Dataflow", r"Lakehouse\.Contents": "Fabric Lakehouse"}
# fixed values: systems that need a gateway, systems that do not, hosts in the cloud
ON_PREMISES = ["SQL Server", "Oracle", "Teradata", "SAP HANA", "ODBC", "Analysis Services"]
CLOUD = ["Azure Blob Storage", "Dataverse", "Snowflake", "Google BigQuery", "Power BI Dataflow", "OData", "SharePoint Tables", "SharePoint Files", "Fabric Lakehouse", "Fabric Warehouse", "Azure Data Explorer", "Databricks", "Web", "MySQL", "PostgreSQL"]
CLOUD_HOST = r"(?i)\.database\.windows\.net|\.sql\.azuresynapse\.net|\.datawarehouse\.fabric\.microsoft\.com|\.pbidedicated\.windows\.net|\.asazure\.windows\.net"

_SOURCE = "array<struct<type:string,server:string,database:string,url:string,path:string,parameter:string,database_parameter:string>>"


def strip_comments(m: Column) -> Column:
    """M text without comments; what looks like one inside a string literal stays."""
    return F.regexp_replace(m, r'("(?:[^"]|"")*")|//[^\r\n]*|/\*(?s:.*?)\*/', "$1")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def data_sources(m: Column) -> Column:
    """Connector calls of an M text in which comments are stripped: type, server, database, url, path; the names of the parameters that stand for server (or url, path) and database."""
    none = F.lit(None).cast("string")
    unquoted = lambda c: F.regexp_replace(_filled(c), r'^#"(.*)"$', "$1")

    def calls(pattern: str, kind: str, field: str, second: bool = False) -> Column:
        p = pattern + r"\s*\(\s*" + _ARG + (r"\s*(?:,\s*" + _ARG + ")?" if second else "")
        groups = [_all(m, p, g).alias(f"g{g}") for g in range(1, 5 if second else 3)]

        def one(x: Column) -> Column:
            first = F.coalesce(_filled(x.g1), unquoted(x.g2))
            db = F.coalesce(_filled(x.g3), unquoted(x.g4)) if second else none
            at = {c: first if c == field else none for c in ("server", "url", "path")}
            return F.struct(F.lit(kind).alias("type"), at["server"].alias("server"), db.alias("database"), at["url"].alias("url"), at["path"].alias("path"), unquoted(x.g2).alias("parameter"), (unquoted(x.g4) if second else none).alias("database_parameter"))

        return F.transform(F.arrays_zip(*groups), one).cast(_SOURCE)

    parts = [calls(p, t, "server", True) for p, t in SERVER_DATABASE.items()] + [calls(p, t, "server") for p, t in SERVER.items()]
    parts += [calls(p, t, "url") for p, t in URL.items()] + [calls(p, t, "path") for p, t in FILE.items()]
    bare = [F.when(m.rlike(p + r"\s*\("), F.array(F.struct(F.lit(t).alias("type"), *(none.alias(c) for c in ("server", "database", "url", "path", "parameter", "database_parameter"))))).otherwise(F.array().cast(_SOURCE)) for p, t in BARE.items()]
    bq = _all(m, r'GoogleBigQuery\.Database\s*\(\s*\[[^\]]*BillingProject\s*=\s*(?:"([^"]*)"|#?"?([A-Za-z_]\w*)"?)', 1)
    bq = F.transform(bq, lambda x: F.struct(F.lit("Google BigQuery").alias("type"), _filled(x).alias("server"), *(none.alias(c) for c in ("database", "url", "path", "parameter", "database_parameter"))))
    return F.concat(*parts, *bare, bq.cast(_SOURCE))


def source_key(s: Column) -> Column:
    return F.lower(F.concat_ws("|", s["type"], F.coalesce(s["server"], F.lit("")), F.coalesce(s["database"], F.lit("")), F.coalesce(s["url"], F.lit("")), F.coalesce(s["path"], F.lit(""))))


def native_query(m: Column) -> Column:
    """The SQL argument of Value.NativeQuery as written, null where there is none."""
    return F.get(split_top(F.get(call_arguments(m, ["Value.NativeQuery"]), 0)), 1)


def concatenation(text: Column) -> Column:
    """Operands of a string concatenation, in order: (literal, parameter), one of them null."""
    ops = split_top(text, "&")
    return F.transform(ops, lambda o: F.struct(F.when(o.startswith('"'), F.regexp_replace(F.regexp_extract(o, r'(?s)^"(.*)"$', 1), '""', '"')).alias("literal"), F.when(~o.startswith('"'), F.regexp_replace(o, r'^#"(.*)"$', "$1")).alias("parameter")))


def resolve_concatenations(texts: DataFrame, text: str, parameters: DataFrame, keys: list[str]) -> DataFrame:
    """texts with ``resolved`` and ``complete``: operands put together, parameters by their values, unknown ones as {name}.

    parameters: (project_id, snapshot_id, parameter, value).
    """
    pk = ["project_id", "snapshot_id"]
    each = texts.select(*keys, F.posexplode(concatenation(F.col(text))).alias("i", "o")).select(*keys, "i", "o.literal", "o.parameter")
    each = each.join(parameters, [*pk, "parameter"], "left")
    piece = F.coalesce("literal", "value", F.concat(F.lit("{"), "parameter", F.lit("}")))
    done = each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("t")))), lambda x: x.t), "").alias("resolved"), F.bool_and(F.col("literal").isNotNull() | F.col("value").isNotNull()).alias("complete"))
    return texts.join(done, keys, "left")


def navigation(m: Column, values: Column | None = None) -> Column:
    """(schema, item, dataset, project) of the records that a text navigates by, null where nothing is written.

    The last Schema/Item record counts; else the last record tagged as a schema or dataset and as a table or view. Records without a tag are
    positional: the last three are project, dataset and table. Where something else names the table they are the connector's own: a native query's, or the
    project in front of tagged ones. values: a map of parameters, whose names may stand for texts.
    """
    record = r"(?i)\{\s*\[([^\]]*)\]\s*\}\s*\[\s*Data\s*\]"

    def field(r: Column, key: str) -> Column:
        g = [F.regexp_extract(r, r"\b" + key + r'\s*=\s*(?:"([^"]*)"|#"([^"]*)"|([A-Za-z_]\w*))', i) for i in (1, 2, 3)]
        name = F.coalesce(_filled(g[1]), _filled(g[2]))
        return F.coalesce(_filled(g[0]), name if values is None else F.coalesce(F.try_element_at(values, name), name))

    records = F.transform(_all(m, record, 1), lambda r: F.struct(field(r, "Schema").alias("schema"), field(r, "Item").alias("item"), field(r, "Name").alias("name"), F.lower(field(r, "Kind")).alias("kind")))
    last = lambda keep: F.try_element_at(F.filter(records, keep), F.lit(-1))
    stated = last(lambda r: r.schema.isNotNull() & r.item.isNotNull())
    named = lambda *kinds: last(lambda r: r.kind.isin(*kinds) & r["name"].isNotNull())["name"]
    loose = F.transform(F.filter(records, lambda r: r.kind.isNull() & r["name"].isNotNull()), lambda r: r["name"])
    back = lambda k: F.try_element_at(loose, F.lit(-k))
    place = lambda a, b, c, d: F.struct(a.alias("schema"), b.alias("item"), c.alias("dataset"), d.alias("project"))
    none = F.lit(None).cast("string")
    schema, item = named("schema", "dataset"), named("table", "view")
    return (
        F.when(stated.isNotNull(), place(stated["schema"], stated["item"], none, none))
        .when(item.isNull() & ~m.rlike(r"Value\.NativeQuery\s*\("), place(schema, back(1), back(2), back(3)))
        .otherwise(place(schema, item, none, F.try_element_at(loose, F.lit(1))))
    )


def _pairs(args: Column) -> Column:
    p = r'\{\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\}'
    return F.flatten(F.transform(args, lambda a: F.zip_with(_all(a, p, 1), _all(a, p, 2), lambda x, y: F.struct(x.alias("old"), y.alias("new")))))


def rename_pairs(m: Column) -> Column:
    return _pairs(call_arguments(m, ["Table.RenameColumns"]))


def _strings(args: Column) -> Column:
    return _all(args, r'"([^"]+)"', 1)


def selected_columns(m: Column) -> Column:
    """Columns of the last Table.SelectColumns without those that Table.RemoveColumns takes; null where nothing is selected."""
    kept = F.element_at(call_arguments(m, ["Table.SelectColumns"]), -1)
    gone = F.flatten(F.transform(call_arguments(m, ["Table.RemoveColumns"]), _strings))
    return F.when(F.size(call_arguments(m, ["Table.SelectColumns"])) > 0, F.array_except(_strings(kept), gone))


def added_columns(m: Column) -> Column:
    return F.transform(call_arguments(m, ["Table.AddColumn"]), lambda a: F.regexp_extract(a, r'^[^"]*(?:#"[^"]*"[^"]*)?,\s*"([^"]+)"', 1))


def nested_joins(m: Column) -> Column:
    """(expression, column, left_keys, right_keys) of Table.NestedJoin calls: what is joined, the new column, the keys of both sides."""
    keys = r'(\{[^{}]*\}|"[^"]*")'
    p = r'(?s)^\s*(?:#"[^"]*"|[A-Za-z_]\w*)\s*,\s*' + keys + r'\s*,\s*(?:#"([^"]+)"|([A-Za-z_]\w*))\s*,\s*' + keys + r'\s*,\s*"([^"]+)"'
    part = lambda a, g: F.regexp_extract(a, p, g)
    one = lambda a: F.struct(F.coalesce(_filled(part(a, 2)), _filled(part(a, 3))).alias("expression"), part(a, 5).alias("column"), _strings(part(a, 1)).alias("left_keys"), _strings(part(a, 4)).alias("right_keys"))
    return F.filter(F.transform(call_arguments(m, ["Table.NestedJoin"]), one), lambda j: j.expression.isNotNull())


def expand_pairs(m: Column) -> Column:
    """(column, source_name, new_name) of Table.ExpandTableColumn calls; a column without a new name keeps its own."""
    names = r'\{((?:\s*"[^"]*"\s*,?)*)\s*\}'
    p = r',\s*"([^"]+)"\s*,\s*' + names + r"(?:\s*,\s*" + names + ")?"

    def one(a: Column) -> Column:
        part = lambda g: _strings(F.regexp_extract(a, p, g))
        return F.zip_with(part(2), F.slice(part(3), 1, F.size(part(2))), lambda old, new: F.struct(F.regexp_extract(a, p, 1).alias("column"), old.alias("source_name"), F.coalesce(new, old).alias("new_name")))

    return F.flatten(F.transform(call_arguments(m, ["Table.ExpandTableColumn"]), one))


def combined(m: Column) -> Column:
    """Operands of all Table.Combine lists, in order."""
    lists = F.transform(call_arguments(m, ["Table.Combine"]), lambda a: F.regexp_extract(a, r"(?s)^\s*\{([^}]+)\}", 1))
    return F.filter(F.transform(F.flatten(F.transform(lists, lambda a: F.split(a, ","))), lambda s: F.regexp_replace(F.trim(s), r'^#"(.*)"$', "$1")), lambda s: s != "")


# fixed values: prefixes of connector calls, and the kind of step that each table function makes; any other is Custom
_CONNECTORS = r"(?i)^(?:Sql\.|GoogleBigQuery\.|AzureDataExplorer\.|Kusto\.|Lakehouse\.|Fabric\.|Databricks\.|Snowflake\.|PostgreSQL\.|MySQL\.|Teradata\.|SapHana\.|Odbc\.|Oracle\.|Excel\.|Csv\.|OData\.|SharePoint\.|PowerBI\.|Web\.|Value\.NativeQuery)"
_KINDS = {
    "Table.SelectColumns": "Projection", "Table.RemoveColumns": "Projection", "Table.ReorderColumns": "Projection", "Table.RenameColumns": "Rename", "Table.SelectRows": "Filter", "Table.NestedJoin": "Join", "Table.Combine": "Join",
    "Table.AddColumn": "AddColumn", "Table.TransformColumnTypes": "TypeChange", "Table.ExpandTableColumn": "Expand",
}
# fixed values: table functions that leave column names alone
KEEPS_NAMES = [
    "Table.SelectRows", "Table.SelectRowsWithErrors", "Table.RemoveRowsWithErrors", "Table.FindText", "Table.FirstN", "Table.LastN", "Table.Skip", "Table.Range", "Table.AlternateRows", "Table.Repeat",
    "Table.RemoveFirstN", "Table.RemoveLastN", "Table.RemoveRows", "Table.ReverseRows", "Table.InsertRows", "Table.ReplaceRows",
    "Table.Distinct", "Table.RemoveMatchingRows", "Table.ReplaceMatchingRows", "Table.Sort", "Table.MinN", "Table.MaxN",
    "Table.SelectColumns", "Table.RemoveColumns", "Table.ReorderColumns",
    "Table.RenameColumns", "Table.ExpandTableColumn", "Table.NestedJoin",
    "Table.ReplaceValue", "Table.ReplaceErrorValues", "Table.FillDown", "Table.FillUp", "Table.TransformColumns", "Table.TransformColumnTypes", "Table.AddColumn",
    "Table.Buffer", "Table.StopFolding", "Value.NativeQuery",
]
_NAME = r'#"[^"]*"|[A-Za-z_][A-Za-z0-9_]*'


def steps(m: Column) -> Column:
    """Steps of a let expression in order: (name, expression)."""
    body = F.regexp_extract(m, r"(?s)^\s*let\b(.*)\bin\b[^,]*$", 1)
    parts = F.filter(split_top(body), lambda s: s.contains("="))
    return F.transform(parts, lambda s: F.struct(F.regexp_replace(F.trim(F.regexp_extract(s, r'(?s)^\s*(#"[^"]*"|[^=\s]+)\s*=', 1)), r'^#"(.*)"$', "$1").alias("name"), F.trim(F.regexp_replace(s, r'(?s)^\s*(#"[^"]*"|[^=\s]+)\s*=', "")).alias("expression")))


def step_kind(expression: Column) -> Column:
    name = r'(?:#"[^"]*"|\w+)'
    called = F.regexp_extract(expression, r"^(Table\.\w+)\b", 1)
    kinds = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))
    navigation = expression.rlike(rf"^{name}\s*\{{\s*\[") | expression.rlike(rf"^{name}\s*\[")
    return F.when(expression.rlike(_CONNECTORS), "Source").when(navigation, "Navigation").otherwise(F.coalesce(F.try_element_at(kinds, called), F.lit("Custom")))


def bare_name(expression: Column) -> Column:
    """The name that an expression consists of, null where it is more than a name."""
    return F.when(expression.rlike("^(?:" + _NAME + ")$"), F.regexp_replace(expression, r'^#"(.*)"$', "$1"))


def affects_names(expression: Column) -> Column:
    """Whether a step may rename columns: true for every function that is not known to keep names, and for a conditional if either arm may.

    A bare reference, a source and a navigation rename nothing; MissingField.UseNull makes columns up and counts as renaming.
    """
    fn = F.regexp_extract(expression, r"^([A-Za-z_][A-Za-z0-9_.]*)\s*\(", 1)
    # an arm is a call, kept with its bracket, or a reference; a nested conditional shows its own arms
    arms = F.filter(_all(expression, r"\b(?:then|else)\s+((?:" + _NAME + r")(?:\.[A-Za-z0-9_.]+)?\s*\(?)", 1), lambda a: ~a.rlike(r"^if\b"))
    call = lambda a: F.regexp_extract(a, r"^([A-Za-z_][A-Za-z0-9_.]*)\s*\($", 1)
    creates = expression.contains("MissingField.UseNull")
    of_arm = F.exists(arms, lambda a: a.endswith("(") & ~call(a).isin(KEEPS_NAMES))
    simple = F.when(step_kind(expression).isin("Source", "Navigation") | bare_name(expression).isNotNull(), False).otherwise(~fn.isin(KEEPS_NAMES) | creates)
    return F.when(expression.rlike(r"^if\b"), (F.size(arms) == 0) | of_arm | creates).otherwise(simple)


def dangling(expression: Column, names: Column) -> Column:
    """Whether a step merely names something that is no step of its query."""
    return bare_name(expression).isNotNull() & ~F.array_contains(names, bare_name(expression))


def step_references(expression: Column, names: Column) -> Column:
    """Steps of the query that a step's expression names outside string literals, once each, in order: a name counts after an opening bracket,
    a comma or white space and before a comma, an opening bracket, a closing round one or the end."""
    bare = F.regexp_replace(expression, r'(#"[^"]*")|"(?:[^"]|"")*"', "$1")
    said = F.transform(_all(bare, r"(?<=^|[,({\s])(?:" + _NAME + r")(?=\s*(?:[,\[{)]|$))", 0), lambda x: F.regexp_replace(x, r'^#"(.*)"$', "$1"))
    return F.array_intersect(said, names)


def sql_first_path(sql: Column) -> Column:
    """Path of the first table after FROM, without quotes and brackets; null where there is none."""
    part = r'(?:[\w$]+|"[^"]+"|\[[^\]]+\]|`[^`]+`)'
    return _filled(F.regexp_replace(F.regexp_extract(sql, r"(?i)\bFROM\s+(" + part + r"(?:\." + part + ")*)", 1), r'["`\[\]]', ""))


def sql_tables(sql: Column) -> Column:
    """Distinct tables after FROM and JOIN, with quotes and brackets taken off."""
    names = _all(sql, r'(?i)\b(?:FROM|JOIN)\s+((?:[\w$]+|"[^"]+"|\[[^\]]+\]|`[^`]+`)(?:\.(?:[\w$]+|"[^"]+"|\[[^\]]+\]|`[^`]+`))*)', 1)
    return F.array_distinct(F.transform(names, lambda n: F.regexp_replace(n, r'["`\[\]]', "")))


def sql_select_list(sql: Column) -> Column:
    """Output names of the first select list: alias, else last part of the name; one element '*' for a star."""
    body = F.regexp_extract(sql, r"(?is)^\s*SELECT\s+(?:DISTINCT\s+|TOP\s+\d+\s+)?(.*?)\bFROM\b", 1)
    name = lambda p: F.coalesce(_filled(F.regexp_extract(p, r'(?is)\bAS\s+["\[`]?([^"\]`]+?)["\]`]?\s*$', 1)), F.regexp_replace(F.element_at(F.split(p, r"\."), -1), r'["`\[\]]', ""))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.transform(split_top(body), lambda p: F.when(p.rlike(r"(^|\.)\*$"), "*").otherwise(F.trim(name(p)))))


def needs_gateway(kind: Column, server: Column, path: Column) -> Column:
    """True, false, or null where it cannot be told."""
    return F.when(F.coalesce(server, F.lit("")).rlike(CLOUD_HOST), False).when(kind.isin(ON_PREMISES), True).when(kind.isin(CLOUD), False).when(path.rlike(r"(?i)^https?://"), False).when(path.isNotNull(), True)


def physical_path(*parts) -> Column:
    """Filled parts, most qualified first."""
    return F.concat_ws(".", *(_filled(F.col(p) if isinstance(p, str) else p) for p in parts))
