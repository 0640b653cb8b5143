"""Ad-hoc SQL over one table, after its parsed plan is found to read only."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Logical operators of a query that only reads its table.
READS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Distinct SubqueryAlias UnresolvedRelation Window UnresolvedHaving Join Union OneRowRelation WithCTE CTERelationDef CTERelationRef UnresolvedWith UnresolvedSubqueryColumnAliases Pivot Unpivot Generate Except Intersect Sample LocalRelation Tail Offset UnresolvedInlineTable".split()
)
BANNED = ("java_method", "reflect", "try_reflect", "input_file_name", "read_files", "load_extension")
MOST_CHARS, PREVIEW = 600, 50


def run_query(df: DataFrame, sql: str, name: str = "data", rows: int = PREVIEW) -> DataFrame:
    """At most `rows` rows of a query over the view `name`; anything but reading that one table is refused."""
    if len(sql) > MOST_CHARS:
        raise ValueError(f"a query has at most {MOST_CHARS} characters")
    lowered = sql.lower()
    if any(b in lowered for b in BANNED):
        raise ValueError("the query calls a function that is not allowed")
    spark = df.sparkSession
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    todo, views = [plan], {name.lower()}
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind not in READS:
            raise ValueError(f"the query does more than read: {kind}")
        if kind == "UnresolvedRelation" and node.tableName().lower().strip("`") not in views:
            raise ValueError(f"unknown table {node.tableName()}")
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    if "." in lowered.split("from", 1)[-1].split("where", 1)[0].replace(f"{name.lower()}.", "") and "`" in sql:
        raise ValueError("only the view itself can be read")
    df.createOrReplaceTempView(name)
    try:
        return spark.createDataFrame(spark.sql(sql).limit(rows).toArrow())
    finally:
        spark.catalog.dropTempView(name)
