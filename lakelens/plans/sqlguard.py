"""Guarded read-only SQL on Spark's own parser and analyser (SQ1-SQ5, SQ10, AG21, FL9).

A statement passes in two steps. Its parsed plan is walked first, with all expressions and subqueries, before anything is
looked up: every node must be one of a query, every table a name of one part (or one of ``tables``), every function one of
Spark's harmless groups, whatever their quoting, so files named as tables and functions that run foreign code are refused
unseen. The analysed plan is walked next: what its names were resolved to must be tables, views or literal rows, and no
expression may call methods or code of a user. Bodies of views belong to whoever made them and are not walked.

The row cap is a limit on the analysed plan; the user's own limits keep their meaning. ``screened`` judges a column of
statements by their words alone, in Spark, for logs of statements that are not run.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

DEFAULT_ROWS, MOST_ROWS = 50, 500

# ---- fixed values: words whose presence as a token is refused ----
FORBIDDEN = "INSERT UPDATE DELETE DROP ALTER CREATE TRUNCATE REPLACE EXEC EXECUTE PRAGMA ATTACH DETACH VACUUM REINDEX GRANT REVOKE COMMIT ROLLBACK SAVEPOINT TRANSACTION LOCK MERGE UPSERT".split()
FORBIDDEN_FUNCTIONS = "LOAD_EXTENSION READFILE WRITEFILE EDIT".split()
# ---- end of fixed values ----

#: Groups of Spark's own functions that only work on their arguments, single functions besides, and functions of tables.
GROUPS = frozenset("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs window_funcs".split())
FUNCTIONS = frozenset("typeof equal_null".split())
TABLE_FUNCTIONS = frozenset("explode explode_outer inline inline_outer posexplode posexplode_outer range stack".split())
QUERY_NODES = frozenset(
    "CTE Project Aggregate Filter Join Sort GlobalLimit LocalLimit Limit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith With WithWindowDefinition "
    "UnresolvedHaving Generate OneRowRelation UnresolvedInlineTable LocalRelation Window Pivot Unpivot LateralJoin UnresolvedTableValuedFunction CTERelationDef CTERelationRef WithCTE Expand GroupingSets BaseGroupingSets UnresolvedHint Hint View Sample "
    "UnresolvedTVFAliases UsingJoin NaturalJoin AsOfJoin ResolvedHint Deduplicate Range InlineTable LogicalQueryStage".split()
)
#: Unresolved expressions whose names are in the statement as they stand; others, such as names made at run time, are refused.
NAMED = frozenset("UnresolvedAttribute UnresolvedFunction UnresolvedStar UnresolvedStarWithColumns UnresolvedStarExceptOrReplace UnresolvedAlias UnresolvedGenerator UnresolvedExtractValue UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedWindowExpression UnresolvedRegex UnresolvedSubqueryColumnAliases UnresolvedInlineTable".split())
#: Resolved expressions that run foreign code or tell of files.
FOREIGN = re.compile("Reflect|ScalaUDF|ScalaUDAF|ScalaAggregator|PythonUD|PandasUD|HiveGenericUD|HiveSimpleUD|HiveUDA|Invoke|InputFile|ExternalUDF|V2Function|ApplyFunctionExpression|ScriptTransformation|SQLFunction|SQLTableFunction")
#: Leaves of an analysed plan that are no stored table.
MADE_ROWS = frozenset("OneRowRelation LocalRelation Range CTERelationRef UnionLoopRef InlineTable".split())
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*|.", re.S)


class UnsafeSQL(ValueError):
    """The statement is not one read-only query."""


class FailedSQL(ValueError):
    """The statement is allowed but can't run."""


def bare_words(query: str) -> list[str]:
    return [t.upper() for t in _TOKEN.findall(query) if t[0].isalpha() or t[0] == "_"]


def _items(seq: JavaObject) -> Iterator[JavaObject]:
    each = seq.iterator()
    while each.hasNext():
        yield each.next()


def _name(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def plan_parts(spark: SparkSession, plan: JavaObject, above: Collection[str] = ()) -> Iterator[tuple[str, JavaObject, bool]]:
    """(class name, node, whether it is an expression) of a plan, its expressions and all plans inside them.

    What lies below a plan node of a class in ``above`` is left out.
    """
    nests = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    todo = [(plan, False)]
    while todo:
        node, is_expression = todo.pop()
        name = _name(node)
        yield name, node, is_expression
        if is_expression:
            todo += [(c, True) for c in _items(node.children())]
            if nests.isInstance(node):
                todo.append((node.plan(), False))
        elif name not in above:
            todo += [(c, False) for c in _items(node.children())] + [(e, True) for e in _items(node.expressions())]
            if name == "UnresolvedWith":  # the plans of its names; those of other nodes are in their expressions
                todo += [(c, False) for c in _items(node.innerChildren())]
            elif name == "WithWindowDefinition":
                todo += [(w, True) for w in _items(node.windowDefinitions().values())]


@functools.lru_cache(maxsize=4096)
def _group(jvm: object, name: str) -> str | None:  # of one JVM: its functions are fixed
    """Group of one of Spark's own functions; None if there is none of that name."""
    found = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return found.get().getGroup() if found.isDefined() else None


def check_names(spark: SparkSession, plan: JavaObject, tables: Collection[str] | None = None, functions: Collection[str] = ()) -> None:
    """UnsafeSQL for a parsed plan with a node, table or function that is not allowed; nothing is looked up in a catalog."""
    known = None if tables is None else {t.lower() for t in tables}
    more = {f.lower() for f in functions}
    relations, own = [], set()
    for name, node, is_expression in plan_parts(spark, plan):
        if not is_expression and name not in QUERY_NODES:
            raise UnsafeSQL(f"Forbidden plan node {name}.")
        if is_expression and (name.startswith("Unresolved") and name not in NAMED or "Identifier" in name or "Parameter" in name):
            raise UnsafeSQL(f"Forbidden expression {name}.")
        if name == "UnresolvedRelation":
            relations.append([str(p) for p in _items(node.multipartIdentifier())])
            if node.isStreaming() or len(node.options()):
                raise UnsafeSQL("Streams and options of tables are not permitted.")
        elif name == "SubqueryAlias":
            own.add(node.alias().lower())
        elif name in ("UnresolvedFunction", "UnresolvedGenerator", "UnresolvedTableValuedFunction"):
            if name == "UnresolvedGenerator":
                parts = [node.name().unquotedString()]
            else:
                parts = _items(node.nameParts() if name == "UnresolvedFunction" else node.name())
            parts = [str(p).lower() for p in parts]
            at_table = name == "UnresolvedTableValuedFunction" and parts[0] not in TABLE_FUNCTIONS
            if len(parts) != 1 or at_table or parts[0] not in more | FUNCTIONS | TABLE_FUNCTIONS and _group(spark._jvm, parts[0]) not in GROUPS:
                raise UnsafeSQL(f"Forbidden function '{'.'.join(parts)}'.")
    for parts in relations:
        dotted = ".".join(parts).lower()
        if known is None and len(parts) > 1 or known is not None and dotted not in known | own:
            raise UnsafeSQL(f"Table '{dotted}' is not permitted.")


def check_resolved(spark: SparkSession, plan: JavaObject, functions: Collection[str] = ()) -> None:
    """UnsafeSQL if names of an analysed plan were resolved to anything but tables, views, literal rows and Spark's functions."""
    for name, node, is_expression in plan_parts(spark, plan, above={"View"}):
        if FOREIGN.search(name) and not (functions and name in ("ScalaUDF", "PythonUDF")):
            raise UnsafeSQL(f"Forbidden expression {name}.")
        if is_expression or name in MADE_ROWS or not node.children().isEmpty():
            continue
        named = name == "LogicalRelation" and node.catalogTable().isDefined() or name == "DataSourceV2Relation" and node.identifier().isDefined()
        if not named and name not in ("View", "HiveTableRelation"):
            raise UnsafeSQL(f"Forbidden relation {name}.")


def check(spark: SparkSession, query: str, tables: Collection[str] | None = None, functions: Collection[str] = ()) -> str:
    """The statement without its final semicolon, if it is one read-only query over allowed names; else UnsafeSQL.

    ``tables``: names that may be read; without it, every name of one part. ``functions``: names allowed besides Spark's own.
    """
    query = query.strip()
    query = query[:-1].strip() if query.endswith(";") else query
    if not query:
        raise UnsafeSQL("SQL query string cannot be empty.")
    words = bare_words(query)
    for word in words:
        if word in FORBIDDEN or word in FORBIDDEN_FUNCTIONS:
            raise UnsafeSQL(f"Forbidden SQL keyword or function '{word}'.")
    if not words or words[0] not in ("SELECT", "WITH"):
        raise UnsafeSQL("Only SELECT queries are permitted.")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as error:
        text = str(error)
        if ";" in query:
            raise UnsafeSQL("Multiple SQL statements detected (stacked queries are strictly prohibited).") from error
        raise FailedSQL(f"can't be parsed: {text.splitlines()[0][:300]}") from error
    check_names(spark, plan, tables, functions)
    return query


SCREENED = "verdict string, word string"


def screened(statement: Column) -> Column:
    """verdict (ok, empty, stacked, not_select or forbidden) and the first forbidden word of a statement, by its words alone.

    Text in quotes and comments is passed over. Null counts as empty. That a statement is ok here does not mean that it may
    run; ``check`` decides that on its plan.
    """
    quotes = "'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\\n]*|/\\*(?s:.*?)\\*/"
    bare = F.trim(F.regexp_replace(F.coalesce(statement, F.lit("")), quotes, " ? "))
    bare = F.regexp_replace(F.regexp_replace(bare, "^[\\s?]+|\\s+$", ""), "\\s*;$", "")
    words = F.filter(F.split(F.upper(bare), "[^A-Z0-9_]+"), lambda w: F.length(w) > 0)
    refused = F.get(F.filter(words, lambda w: w.isin(*FORBIDDEN, *FORBIDDEN_FUNCTIONS)), 0)
    verdict = F.when(F.trim(F.coalesce(statement, F.lit(""))).isin("", ";"), "empty").when(F.contains(bare, F.lit(";")), "stacked").when(~F.coalesce(F.get(words, 0), F.lit("")).isin("SELECT", "WITH"), "not_select").when(refused.isNotNull(), "forbidden").otherwise("ok")
    return F.struct(verdict.alias("verdict"), F.when(verdict == "forbidden", refused).alias("word"))


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    is_truncated: bool

    @property
    def row_count(self) -> int:
        return len(self.rows)


def capped(spark: SparkSession, query: str, max_rows: int | None = None, tables: Collection[str] | None = None) -> DataFrame:
    """The query's rows, at most one more than the cap."""
    return run(spark, query, tables).limit(min(max_rows or DEFAULT_ROWS, MOST_ROWS) + 1)


def run(spark: SparkSession, query: str, tables: Collection[str] | None = None, functions: Collection[str] = ()) -> DataFrame:
    """The checked query as a DataFrame, without a cap."""
    try:
        df = spark.sql(check(spark, query, tables, functions))
    except (AnalysisException, ParseException) as error:
        raise FailedSQL(str(error).splitlines()[0]) from error
    check_resolved(spark, df._jdf.queryExecution().analyzed(), functions)
    return df


def execute(spark: SparkSession, query: str, max_rows: int | None = None, tables: Collection[str] | None = None) -> Result:
    """Rows up to the cap and whether there were more."""
    cap = min(max_rows or DEFAULT_ROWS, MOST_ROWS)
    df = capped(spark, query, cap, tables)
    rows = [list(r) for r in df.collect()]  # at most 501
    return Result(df.columns, rows[:cap], len(rows) > cap)


def type_name(kind: DataType) -> str:
    """A type by its SQL name; both kinds of timestamps have one name, as which of them a file gives depends on the session."""
    return kind.simpleString().replace("timestamp_ntz", "timestamp").replace("timestamp_ltz", "timestamp")


def reflected(tables: dict[str, DataFrame], only: list[str] | None = None) -> DataFrame:
    """(table_name, column_name, type, nullable, row_count) of tables, counted by Spark; names are matched without case."""
    wanted = None if only is None else {n.lower() for n in only}
    parts = []
    for name, df in tables.items():
        if (wanted is None or name.lower() in wanted) and df.schema.fields:
            columns = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(type_name(f.dataType)).alias("type"), F.lit(f.nullable).alias("nullable")) for f in df.schema))
            parts.append(df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), F.inline(columns), "row_count"))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "table_name string, column_name string, type string, nullable boolean, row_count long")
    return functools.reduce(DataFrame.unionByName, parts)


def reflect(tables: dict[str, DataFrame], only: list[str] | None = None, samples: int = 2) -> list[dict]:
    """Columns, types, row count and sample rows of tables; names are matched without case."""
    wanted = None if only is None else {n.lower() for n in only}
    out = []
    for name, df in tables.items():
        if wanted is None or name.lower() in wanted:
            columns = [{"name": f.name, "type": type_name(f.dataType), "nullable": f.nullable} for f in df.schema]
            out.append({"table": name, "columns": columns, "row_count": df.count(), "sample_rows": [list(r) for r in df.limit(samples).collect()]})
    return out
