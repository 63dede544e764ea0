"""Read-only SQL over the gold layer."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import zip_longest
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.sources.tables import Lakehouse

# Fixed value: the row cap of the dashboard.
ROW_LIMIT = 5000

LAYERS = ("bronze", "silver", "gold")

# What a query's parsed plan may consist of, besides plain expressions. Not among them: commands,
# writes, external programs, and names that are worked out while the query runs.
_QUERY_NODES = set(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit LimitAll Offset Distinct Union Except"
    " Intersect SubqueryAlias OneRowRelation LocalRelation Generate Sample Pivot Unpivot PipeOperator"
    " WithWindowDefinition GroupingSets UnresolvedRelation UnresolvedWith UnresolvedInlineTable UnresolvedHaving"
    " UnresolvedHint UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedStar UnresolvedAlias"
    " UnresolvedAttribute UnresolvedFunction UnresolvedGenerator UnresolvedExtractValue UnresolvedRegex"
    " UnresolvedOrdinal NamedParameter".split()
)
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
_TABLE_FUNCTIONS = set(
    "range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split()
)
_REFLECTION = {"reflect", "try_reflect", "java_method"}

# Parts of a statement in which no name is to be replaced
_TEXT = r"""[rR]'[^']*'|[rR]"[^"]*"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|--[^\n]*|/\*.*?\*/"""


def clean_sql(sql: str) -> str:
    """Take off Markdown code fences and one closing semicolon."""
    sql = re.sub(r"```(?:sql)?", "", sql, flags=re.I).strip()
    return sql.removesuffix(";").rstrip()


@lru_cache(maxsize=256)
def _session(lake: Lakehouse) -> SparkSession:
    """A session of the lakehouse's own, in which its gold layer is the current schema and no
    path can stand for a table. The catalog is shared with all sessions."""
    spark = lake.spark.newSession()
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    spark.sql(f"USE {lake.schema_name('gold')}")
    return spark


def _nodes(tree: Any) -> Iterator[dict[str, Any]]:
    if isinstance(tree, dict):
        if "class" in tree:
            yield tree
        tree = list(tree.values())
    for part in tree if isinstance(tree, list) else ():
        yield from _nodes(part)


def _name(parts: str) -> list[str]:
    return [p.strip().lower() for p in parts.strip("[]").split(",")]


def check_read_only(lake: Lakehouse, sql: str, catalog_alias: str = "iceberg") -> None:
    """Refuse all but one query on the lakehouse's tables. Spark parses it; nothing is run.

    Spark runs commands as soon as it is given them, so this must come before `spark.sql`. What the
    statement does is read off the parsed plan, by a list of what may be in it. The plan comes from the
    session's parser in the JVM, so this needs a session that is not a remote one.
    """
    jvm = getattr(_session(lake), "_jsparkSession", None)
    if jvm is None:
        raise ValueError("read-only SQL is decided by Spark's parser in the session's JVM, which a remote session lacks")
    try:
        parsed = jvm.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise ValueError(f"only a single SELECT is allowed: {sql}") from error
    plan = list(_nodes(json.loads(parsed.toJSON())))
    schemas = {lake.schema_name(layer).rsplit("`", 2)[1].lower() for layer in LAYERS}
    catalogs = {catalog_alias.lower(), (lake.catalog or "spark_catalog").lower()}

    def allowed(node: dict[str, Any]) -> bool:
        kind = node["class"].rsplit(".", 1)[-1]
        if kind == "UnresolvedRelation":
            *where, _ = _name(node["multipartIdentifier"])
            return not where or (where[-1] in schemas and (len(where) == 1 or where[0] in catalogs and len(where) == 2))
        if kind == "UnresolvedTableValuedFunction":
            return _name(node["name"])[-1] in _TABLE_FUNCTIONS
        if kind == "UnresolvedGenerator":
            return node["name"]["funcName"].lower() in _TABLE_FUNCTIONS
        if kind == "UnresolvedFunction":
            *where, name = _name(node["nameParts"])
            return not where and name not in _REFLECTION
        return node["class"].startswith(_EXPRESSIONS) or kind in _QUERY_NODES

    refused = {node["class"].rsplit(".", 1)[-1] for node in plan if not allowed(node)}
    if refused:
        raise ValueError(f"only a SELECT on the lakehouse's tables is allowed, not {sorted(refused)}: {sql}")


def _local_names(lake: Lakehouse, sql: str, catalog_alias: str) -> str:
    """`<catalog_alias>.<layer>.` in front of a table as this lakehouse's schema, outside literals
    and comments; with or without back quotes."""
    layers = "|".join(LAYERS)
    name = rf"(?<![\w`.])`?{re.escape(catalog_alias)}`?\s*\.\s*`?(?P<layer>{layers})`?\s*\.\s*(?=[\w`])"

    def replaced(match: re.Match[str]) -> str:
        return f"{lake.schema_name(match['layer'].lower())}." if match["layer"] else match[0]

    return re.sub(f"{_TEXT}|{name}", replaced, sql, flags=re.I | re.S)


def gold_sql(lake: Lakehouse, sql: str, catalog_alias: str = "iceberg") -> DataFrame:
    """The whole result of a query whose unqualified tables are those of the gold layer.

    Names written `<catalog_alias>.gold.<table>` are understood as well, also in a session that has no
    catalog of that name. The result belongs to a session of the lakehouse's own.
    """
    sql = clean_sql(sql)
    if lake.spark.conf.get(f"spark.sql.catalog.{catalog_alias}", None) is None:
        sql = _local_names(lake, sql, catalog_alias)
    check_read_only(lake, sql, catalog_alias)
    return _session(lake).sql(sql)


def capped(df: DataFrame, max_rows: int = ROW_LIMIT) -> DataFrame:
    """At most `max_rows` rows, as a dashboard shows them."""
    return df.limit(max_rows)


class Records:
    """The records of a DataFrame as dicts, never held together: each iteration runs the query and fetches one
    partition at a time, the length is counted by Spark. `frame` is the DataFrame."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def __iter__(self) -> Iterator[dict[str, Any]]:
        return (row.asDict(recursive=True) for row in self.frame.toLocalIterator())

    def __len__(self) -> int:
        return self.frame.count()

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, (list, Records)):
            return NotImplemented
        return all(a == b for a, b in zip_longest(self, other))


def answer(lake: Lakehouse, sql: str, max_rows: int | None = None) -> dict[str, Any]:
    """A query's result for display: its SQL, its records and the column names.

    All records, lazily (`Records`), unless `max_rows` is given: then a list, and `truncated` tells whether
    there are more.
    """
    df = gold_sql(lake, sql)
    if max_rows is None:
        return {"sql": clean_sql(sql), "rows": Records(df), "columns": df.columns, "truncated": False}
    rows = [row.asDict(recursive=True) for row in capped(df, max_rows + 1).toLocalIterator()]
    return {
        "sql": clean_sql(sql),
        "rows": rows[:max_rows],
        "columns": df.columns,
        "truncated": len(rows) > max_rows,
    }


#: How cursors write and read times: to the microsecond.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def page(
    lake: Lakehouse, sql: str, size: int = ROW_LIMIT, cursor: str | None = None, order_by: Sequence[str] = ()
) -> dict[str, Any]:
    """One page of a query's result for display: its SQL, at most `size` records, the column names, and the `cursor` of
    the next page, None after the last.

    Records come by the columns `order_by`, then by the others from left to right, nulls first; an ORDER BY of the
    query itself has no effect. The cursor holds the page's last row and how many equal ones were given, so each
    page is a query with a filter and a limit, whatever came before it, and all pages together are the result as
    long as the tables stay the same. A task passes on no more rows than the page and its cursor have; only where more
    than a page of rows equal to the cursor's was given, equal rows are grouped and counted instead, which shuffles
    all that follow. Columns must be of types that have an order: no maps.
    """
    df = gold_sql(lake, sql)
    if size < 1:
        raise ValueError(f"a page has at least one row, not {size}")
    if len(set(df.columns)) < len(df.columns) or not set(order_by) <= set(df.columns):
        raise ValueError(f"pages need columns of different names, and an order by some of them: {df.columns}, {list(order_by)}")
    keys = [*order_by, *[c for c in df.columns if c not in order_by]]
    row = F.struct(*[F.col(f"`{c}`") for c in keys])
    rest, given = df, 0
    if cursor is not None:
        last = json.loads(cursor)
        given = last["given"]
        schema = df.select(*[F.col(f"`{c}`") for c in keys]).schema
        at = F.from_json(F.lit(last["row"]), schema, _TIMES)
        first = F.col(f"`{keys[0]}`")
        # the first column alone can be pushed down to the files
        rest = df.filter((at[keys[0]].isNull() | (first >= at[keys[0]])) & (row >= at))
    if given <= size:
        rest = rest.orderBy(row).limit(given + size)
    counted = rest.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_copies"))
    shown = counted.select(row.alias("r"), "_copies", F.to_json(row, {**_TIMES, "ignoreNullFields": "false"}).alias("_text"))
    # the rows of the cursor may have been given all: one more
    found = shown.orderBy("r").limit(size + 1 if given else size).collect()
    rows: list[dict[str, Any]] = []
    following = None
    for k, each in enumerate(found):
        record = each["r"].asDict(recursive=True)
        record = {c: record[c] for c in df.columns}
        rest = each["_copies"] - (given if k == 0 else 0)
        take = min(rest, size - len(rows))
        rows += [dict(record) for _ in range(take)]
        if len(rows) == size:
            before = given if k == 0 else 0
            following = json.dumps({"row": each["_text"], "given": before + take})
            break
    return {"sql": clean_sql(sql), "rows": rows, "columns": df.columns, "cursor": following}
