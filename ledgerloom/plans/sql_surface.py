"""A read-only SQL surface over named views, with a capped result.

The guard refuses anything but one query. One scan takes literals, comments and quoted names out together, so that none of
them can hide another; what is left must be one statement that starts with a reading word, without writing phrases, file
formats as schemas or functions that reach into the JVM. `sql` then has Spark parse it and walks the plan and its
expressions: only nodes that read, built-in functions that stay in the engine and relations of known databases may run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: words that may start a statement, phrases that change something, and functions that leave the engine.
LEADS = ("select", "with", "from", "values", "show", "describe", "explain")
WRITES = r"\b(insert\s+(into|overwrite)|merge\s+into|delete\s+from|drop\s+(table|view|database|schema|function)|create\s+(or\s+replace|table|view|temporary|external|database|schema|function)|alter\s+(table|view|database|schema)|truncate\s+table|copy\s+into|load\s+data|cache\s+table|refresh\s+table)\b"
REACHING_NAMES = ("reflect", "java_method", "try_reflect", "read_files")
REACHING = rf"\b({'|'.join(REACHING_NAMES)})\s*\("
FORMATS = r"\b(parquet|csv|json|orc|text|avro|xml|binaryfile|delta|iceberg|hudi)\s*\.\s*q?`"


class RefusedSql(ValueError):
    pass


def _bare(query: str) -> str:
    """The statement with literals as '', quoted names as `` and comments as blanks. Comments in brackets may nest."""
    out, i, n = [], 0, len(query)
    while i < n:
        c, two = query[i], query[i : i + 2]
        if two == "--":
            end = query.find("\n", i)
            i = n if end < 0 else end
            out.append(" ")
        elif two == "/*":
            depth, i = 1, i + 2
            while depth and i < n:
                if query[i : i + 2] == "/*":
                    depth, i = depth + 1, i + 2
                elif query[i : i + 2] == "*/":
                    depth, i = depth - 1, i + 2
                else:
                    i += 1
            if depth:
                raise RefusedSql("a comment isn't closed")
            out.append(" ")
        elif c in "'\"`":
            raw = c != "`" and query[max(0, i - 1) : i].lower() == "r" and not re.match(r"[\w`]", query[max(0, i - 2) : i - 1])
            i += 1
            while i < n and query[i] != c:  # in a raw literal a backslash is a backslash
                i += 2 if query[i] == "\\" and c != "`" and not raw else 1
            if i >= n:
                raise RefusedSql("a literal or name isn't closed")
            i += 1  # a doubled quote starts the next literal at once
            out.append("``" if c == "`" else "''")
        else:
            out.append(c)
            i += 1
    return "".join(out)


def guard(query: str) -> str:
    text = _bare(query).lower()
    parts = [p for p in text.split(";") if p.strip()]
    if len(parts) != 1:
        raise RefusedSql("exactly one statement is allowed")
    words = re.findall(r"[a-z_]+", parts[0])
    if not words or words[0] not in LEADS or not re.match(r"[\s(]*[a-z]", parts[0]):
        raise RefusedSql("only reading statements are allowed")
    bad = re.search(WRITES, parts[0]) or re.search(REACHING, parts[0])
    if bad:
        raise RefusedSql(f"refused: {bad.group(0)}")
    if re.search(FORMATS, parts[0]):
        raise RefusedSql("files can't be read by path")
    return query.rstrip().rstrip(";")


def _refused(spark: SparkSession, query: str) -> list[str]:
    """What the parsed statement holds that may not run: nodes that do something other than read, functions that aren't
    built in or that reach into the JVM, files read by path, and an alias that stands where another engine has a join."""
    jvm = spark._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    kind = lambda name: loader.loadClass(f"org.apache.spark.sql.catalyst.{name}")
    writes = [kind(f"plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    function, relation, alias = kind("analysis.UnresolvedFunction"), kind("analysis.UnresolvedRelation"), kind("plans.logical.SubqueryAlias")
    table_function = kind("analysis.UnresolvedTableValuedFunction")
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    plans, found = [spark._jsparkSession.sessionState().sqlParser().parsePlan(query)], []

    analysis = jvm.org.apache.spark.sql.catalyst.analysis
    registries = [analysis.FunctionRegistry.builtin(), analysis.TableFunctionRegistry.builtin()]

    def name_of(parts: list[str]) -> None:
        name = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[0].lower())
        if len(parts) > 1 or parts[0].lower() in REACHING_NAMES or not any(r.functionExists(name) for r in registries):
            found.append(f"function {'.'.join(parts)}")

    while plans:
        node = plans.pop()
        if any(k.isInstance(node) for k in writes):
            found.append(node.nodeName())
        if alias.isInstance(node) and node.alias().lower() == "asof":
            found.append("asof")
        if table_function.isInstance(node):
            name_of(each(node.name()))
        if relation.isInstance(node):
            parts = each(node.multipartIdentifier())
            if len(parts) > 1 and not spark.catalog.databaseExists(parts[0]):
                found.append(f"files of {parts[0]}")
        todo = each(node.expressions())
        while todo:
            e = todo.pop()
            if function.isInstance(e):
                name_of(each(e.nameParts()))
            todo += each(e.children())
        for inner in (node.children(), node.innerChildren()):
            plans += [x for x in each(inner) if hasattr(x, "innerChildren")]
    return found


def register(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def sql(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    text = guard(query)
    if not re.match(r"[\s(]*(show|describe|explain)\b", _bare(text).lower()):
        bad = _refused(spark, text)
        if bad:
            raise RefusedSql(f"refused: {', '.join(bad)}")
    return spark.sql(text, args=args or {})


def sql_limited(spark: SparkSession, query: str, limit: int, args: dict | None = None) -> tuple[list, bool]:
    """(at most `limit` rows, whether there were more)."""
    rows = sql(spark, query, args).limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def emitted(df: DataFrame) -> DataFrame:
    """Rows as they leave for other tools: exact numbers beyond 2**53 as text."""
    return df.select(*[F.col(c).cast("string").alias(c) if t.startswith("decimal") or t == "bigint" else F.col(c) for c, t in df.dtypes])
