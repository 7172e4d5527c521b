"""Analytics over tables of logged SQL statements.

Splitting and classifying are projections. Only script folds, history and preflight lookups
shuffle, and those reduce on the map side first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import (
    collapse,
    normalize_sql,
    split_commas,
    split_plain,
    split_quoted,
    strip,
    without_comments,
    without_literals,
    without_parens,
)
from tidemark.functions.windows import running
from tidemark.sources.tables import broadcast_if_small

# Fixed values: (lock type, ticks, failure rate, destroys data) of each kind of statement.
DROP_OLD = ("ACCESS_EXCLUSIVE", 5, 0.25, False)
DESTROY = ("ACCESS_EXCLUSIVE", 20, 1.0, True)
INDEX_CONCURRENT = ("SHARE_UPDATE_EXCLUSIVE", 0, 0.0, False)
INDEX_PLAIN = ("SHARE", 8, 0.6, False)
CREATE_TABLE = ("ACCESS_EXCLUSIVE", 0, 0.0, False)
INSERT_VALUES = ("ROW_EXCLUSIVE", 1, 0.02, False)
ALTER_TYPE = ("ACCESS_EXCLUSIVE", 12, 0.9, False)
RENAME_COLUMN = ("ACCESS_EXCLUSIVE", 3, 0.25, False)
RENAME_TABLE = ("ACCESS_EXCLUSIVE", 1, 0.05, False)
DROP_COLUMN = ("ACCESS_EXCLUSIVE", 5, 0.4, False)
DROP_CONSTRAINT = ("ACCESS_EXCLUSIVE", 2, 0.2, False)
ADD_FOREIGN_KEY = ("SHARE_ROW_EXCLUSIVE", 4, 0.3, False)
ADD_DEFAULTED = ("SHARE_UPDATE_EXCLUSIVE", 0, 0.0, False)
ADD_PLAIN = ("ACCESS_EXCLUSIVE", 10, 0.8, False)
READ_ONLY = ("NONE", 0, 0.0, False)
UNKNOWN = ("UNKNOWN", 1, 0.5, False)
# Cost of copying rows by INSERT ... SELECT.
COPY_LOCK = "ROW_EXCLUSIVE"
COPY_DEFAULT_ROWS = 1000
COPY_ROWS_PER_UNIT = 1000
COPY_TICKS_PER_UNIT = 15
COPY_RATE_BOUNDED = 0.15
COPY_RATE_UNBOUNDED = 0.6
# Messages of a preflight.
MISSING_CONSTRAINT = "constraint %s does not exist on %s"
DUPLICATE_CONSTRAINT = "constraint %s already exists on %s"
MISSING_COLUMN = "column %s.%s does not exist for foreign key"
MISSING_REFERENCE = "referenced column %s.%s does not exist"


# an altered table, plain, qualified or quoted; a clause that adds a column; clauses that do something else
ALTERED = r'(?is)^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?((?:"[^"]+"|\w+)(?:\.(?:"[^"]+"|\w+))?)\s+'
ADDS_COLUMN = r"(?is)^ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(?!(?:CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK|EXCLUDE)\b)"
SHORT_RENAME = r"(?is)^RENAME\s+(?!(?:TO|CONSTRAINT)\s)\S+\s+TO\s"
SHORT_DROP = r"(?is)^DROP\s+(?:IF\s+EXISTS\s+)?(?!(?:CONSTRAINT|COLUMN)\b)"
OTHER_ACTION = r"(?is)^(?:ADD|DROP|ALTER|RENAME|SET|RESET|VALIDATE|ENABLE|DISABLE|OWNER|ATTACH|DETACH|CLUSTER|INHERIT|NO)\s"


def _profile(values: tuple[str, int, float, bool]) -> Column:
    lock, ticks, rate, destroys = values
    return F.struct(
        F.lit(lock).alias("lock_type"),
        F.lit(ticks).cast("bigint").alias("lock_ticks"),
        F.lit(rate).alias("failure_rate"),
        F.lit(destroys).alias("destroys_data"),
    )


def split_statements(df: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per statement of a script, with its position (from 1)."""
    parts = df.select("*", F.posexplode(split_plain(F.col(sql))).alias("__at", "statement"))
    return parts.withColumn("pos", F.col("__at") + 1).drop("__at")


def expand_add_columns(df: DataFrame, statement: str = "statement") -> DataFrame:
    """One row per added column of an ALTER TABLE that adds several.

    The statement is cut at the commas outside brackets. Its first clause names the table for all;
    a clause that adds nothing but a column, with or without its keywords, becomes a statement of
    its own. Statements with any other clause stay whole.
    """
    whole = F.rtrim(strip(F.col(statement)), F.lit(";"))
    clauses = split_commas(whole)
    table = F.regexp_extract(F.get(clauses, 0), ALTERED, 1)
    actions = F.transform(clauses, lambda clause: F.regexp_replace(clause, ALTERED, ""))
    added = F.transform(actions, lambda action: F.regexp_replace(action, ADDS_COLUMN, ""))
    first_adds = F.get(actions, 0).rlike(ADDS_COLUMN)
    others = F.exists(added, lambda column: column.rlike(OTHER_ACTION))
    each = F.transform(added, lambda column: F.concat_ws(" ", F.lit("ALTER TABLE"), table, F.lit("ADD COLUMN"), column))
    several = (table != "") & first_adds & ~others & (F.size(clauses) > 1)
    return df.select("*", F.posexplode(F.when(several, each).otherwise(F.array(whole))).alias("part", "expanded"))


# quoted names with their quotes, words and numbers, and single signs
_TOKEN = r'"(?:[^"]++|"")++"|\w++|[^\s\w]'


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _says(tokens: Column, at: Column | int, *words: str) -> Column:
    """Whether these words stand one after the other from a position on, in any case."""
    at = at if isinstance(at, Column) else F.lit(at)
    told = [F.upper(F.get(tokens, at + n)) == word for n, word in enumerate(words)]
    return F.coalesce(reduce(Column.__and__, told), F.lit(False))


def _name(token: Column) -> Column:
    """A name without its quotes."""
    quoted = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit('""'), F.lit('"'))
    return F.when(token.startswith('"'), quoted).otherwise(token)


def _announced_rows(tokens: Column) -> Column:
    """Rows from the first BETWEEN with two numbers, else from the first LIMIT with one, else null."""

    def number(at: Column) -> Column:
        return F.get(tokens, at).try_cast("decimal(38,0)")

    whole = r"^[0-9]+$"
    places = F.transform(tokens, lambda _, at: at)
    ranges = F.filter(
        places,
        lambda at: _says(tokens, at, "BETWEEN") & _says(tokens, at + 2, "AND")
        & F.get(tokens, at + 1).rlike(whole) & F.get(tokens, at + 3).rlike(whole),
    )
    limits = F.filter(places, lambda at: _says(tokens, at, "LIMIT") & F.get(tokens, at + 1).rlike(whole))
    between, limit = F.get(ranges, 0), F.get(limits, 0)
    return F.coalesce(number(between + 3) - number(between + 1) + 1, number(limit + 1))


def copy_cost(sql: Column) -> Column:
    """Lock profile of ``INSERT … SELECT`` from the number of rows that its text announces."""
    text = F.upper(sql)
    rows = F.greatest(F.lit(1), F.coalesce(_once(_tokens(text), _announced_rows), F.lit(COPY_DEFAULT_ROWS)))
    ticks = F.greatest(F.lit(1), F.ceil(rows / COPY_ROWS_PER_UNIT) * COPY_TICKS_PER_UNIT)
    bounded = text.contains("BETWEEN") | text.contains("LIMIT") | text.contains("WHERE")
    return F.struct(
        F.lit(COPY_LOCK).alias("lock_type"),
        ticks.try_cast("bigint").alias("lock_ticks"),
        F.when(bounded, COPY_RATE_BOUNDED).otherwise(COPY_RATE_UNBOUNDED).alias("failure_rate"),
        F.lit(False).alias("destroys_data"),
    )


def _lock_rules(text: Column, bare: Column) -> Column:
    """Lock profile from a collapsed statement and the same without the contents of literals.

    The first word picks the rules, and bracketed parts are removed only where they matter.
    """
    verb = F.substring_index(F.substring_index(bare, " ", 1), ";", 1)
    main = F.when(verb == "WITH", F.regexp_extract(without_parens(bare), r"\b(SELECT|INSERT|UPDATE|DELETE)\b", 1)).otherwise(verb)

    def says(*words: str) -> Column:
        found = F.lit(True)
        for word in words:
            found = found & text.contains(word)
        return found

    dropped = F.regexp_extract(bare, r'^DROP TABLE (?:IF EXISTS )?(?:"?\w+"?\.)*"?(\w+)', 1)
    drop = F.when(dropped.endswith("_OLD"), _profile(DROP_OLD)).when(bare.rlike(r"^DROP TABLE\b"), _profile(DESTROY))
    delete = F.when(~without_parens(bare).rlike(r"\bWHERE\b"), _profile(DESTROY))
    create = (
        F.when(bare.rlike(r"^CREATE (?:UNIQUE )?INDEX CONCURRENTLY\b"), _profile(INDEX_CONCURRENT))
        .when(bare.rlike(r"^CREATE (?:UNIQUE )?INDEX\b"), _profile(INDEX_PLAIN))
        .when(
            bare.rlike(r"^CREATE (?:(?:GLOBAL |LOCAL )?TEMP(?:ORARY)? |UNLOGGED )?TABLE\b"), _profile(CREATE_TABLE)
        )
    )
    insert = F.when(says("SELECT"), copy_cost(text)).otherwise(_profile(INSERT_VALUES))
    action = F.regexp_replace(bare, ALTERED, "")
    alter = F.when(
        bare.startswith("ALTER TABLE "),
        F.when(says("ALTER COLUMN", "TYPE"), _profile(ALTER_TYPE))
        .when(says("RENAME COLUMN"), _profile(RENAME_COLUMN))
        .when(says("RENAME TO"), _profile(RENAME_TABLE))
        .when(says("DROP COLUMN"), _profile(DROP_COLUMN))
        .when(says("DROP CONSTRAINT"), _profile(DROP_CONSTRAINT))
        .when(says("ADD CONSTRAINT", "FOREIGN KEY"), _profile(ADD_FOREIGN_KEY))
        .when(says("ADD COLUMN", "DEFAULT"), _profile(ADD_DEFAULTED))
        .when(says("ADD COLUMN"), _profile(ADD_PLAIN))
        # the keyword COLUMN may be left out
        .when(action.rlike(SHORT_RENAME), _profile(RENAME_COLUMN))
        .when(action.rlike(SHORT_DROP), _profile(DROP_COLUMN))
        .when(action.rlike(ADDS_COLUMN) & says("DEFAULT"), _profile(ADD_DEFAULTED))
        .when(action.rlike(ADDS_COLUMN), _profile(ADD_PLAIN)),
    )
    select = F.when(~without_parens(bare).rlike(r"\b(?:UNION|EXCEPT|INTERSECT)\b"), _profile(READ_ONLY))
    known = (
        F.when(main == "ALTER", alter)
        .when(main == "INSERT", insert)
        .when(main == "SELECT", select)
        .when(main == "CREATE", create)
        .when(main == "DROP", drop)
        .when(main == "DELETE", delete)
        .when(main == "TRUNCATE", _profile(DESTROY))
    )
    return F.coalesce(known, _profile(UNKNOWN))


def classify_locks(df: DataFrame, statement: str = "statement") -> DataFrame:
    """Add the lock profile of each statement as four columns. Comments do not count."""
    texts = df.withColumn("__text", collapse(without_comments(F.col(statement))))
    texts = texts.withColumn("__bare", without_literals(F.col("__text")))
    ruled = texts.withColumn("__p", _lock_rules(F.col("__text"), F.col("__bare")))
    return ruled.select(*df.columns, "__p.*")


def script_locks(sql: Column) -> Column:
    """Lock profiles of the statements of a script, in order. Comments do not count."""
    texts = F.transform(
        F.transform(split_quoted(without_comments(sql)), collapse),
        lambda text: F.struct(text.alias("text"), without_literals(text).alias("bare")),
    )
    return F.transform(texts, lambda forms: _lock_rules(forms["text"], forms["bare"]))


def worst_lock(each: Column) -> Column:
    """Lock profile of a whole script from those of its statements.

    Any unrecognised statement, or none at all, makes the script UNKNOWN. Otherwise destructive
    statements come first, then the greatest (ticks, rate), the earliest on ties. Statements
    without any cost do not count. A script lies within one cell, so its fold stays in its row.
    """
    ranked = F.transform(
        each,
        lambda p, at: F.struct(
            p["destroys_data"].alias("destroys_data"),
            p["lock_ticks"].alias("lock_ticks"),
            p["failure_rate"].alias("failure_rate"),
            (-at).alias("back"),
            p["lock_type"].alias("lock_type"),
        ),
    )
    worst = F.array_max(ranked)
    costs = worst["destroys_data"] | (worst["lock_ticks"] > 0) | (worst["failure_rate"] > 0)
    return (
        F.when(F.exists(each, lambda p: p["lock_type"] == UNKNOWN[0]) | (F.size(each) <= 0), _profile(UNKNOWN))
        .when(
            costs,
            F.struct(
                worst["lock_type"].alias("lock_type"),
                worst["lock_ticks"].alias("lock_ticks"),
                worst["failure_rate"].alias("failure_rate"),
                worst["destroys_data"].alias("destroys_data"),
            ),
        )
        .otherwise(_profile(READ_ONLY))
    )


def script_profile(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Add the lock profile of each script as four columns."""
    each = df.withColumn("__each", script_locks(F.coalesce(F.col(sql), F.lit(""))))
    return each.withColumn("__p", worst_lock(F.col("__each"))).select(*df.columns, "__p.*")


def flag_unsafe(sql: Column, cleanup: Sequence[str]) -> Column:
    """True for empty text, TRUNCATE, DROP SCHEMA, and any DROP TABLE but a plain drop of a clean-up table."""
    text = collapse(normalize_sql(sql))
    names = "|".join(name.upper() for name in cleanup) or "(?!)"
    allowed = text.rlike(rf"^DROP TABLE (?:IF EXISTS )?(?:{names})(?: CASCADE)?;$")
    return (
        F.when(text == "", True)
        .when(text.contains("TRUNCATE") | text.contains("DROP SCHEMA"), True)
        .when(text.contains("DROP TABLE"), ~allowed)
        .otherwise(False)
    )


def flag_repeats(
    df: DataFrame, episode: str = "episode_id", step: str = "step", sql: str = "sql", result: str = "result"
) -> DataFrame:
    """Add ``repeats_failed``: the statement equals the one just before it, and that one failed."""
    named = df.withColumn("__sql", normalize_sql(F.col(sql)))
    last = F.struct(F.col(step).alias("at"), F.col("__sql").alias("sql"), F.col(result).alias("result"))
    seen = running(named, [episode], step, {"__last": ("max", last, False)})
    repeats = (F.col("__sql") != "") & (F.col("__last.result") != "SUCCESS") & (F.col("__sql") == F.col("__last.sql"))
    return seen.select(*df.columns, F.coalesce(repeats, F.lit(False)).alias("repeats_failed"))


def _actions(statement: Column) -> Column:
    """The clauses of an ALTER TABLE as (table_name, tokens), without comments; empty for other statements.

    The table's name comes without its schema and its quotes.
    """
    clauses = split_commas(F.rtrim(strip(without_comments(statement)), F.lit("; \t\n\r")))
    table = _name(F.element_at(_tokens(F.regexp_extract(F.get(clauses, 0), ALTERED, 1)), -1))
    told = F.transform(
        clauses,
        lambda clause: F.struct(table.alias("table_name"), _tokens(F.regexp_replace(clause, ALTERED, "")).alias("tokens")),
    )
    return F.when(F.get(clauses, 0).rlike(ALTERED), told)


def preflight_rename(stmts: DataFrame, fks: DataFrame, by: Sequence[str] = (), statement: str = "statement") -> DataFrame:
    """Column renames with the foreign keys that block them.

    ``fks`` holds (table_name, fk_name, ref_table, ref_column) and the columns in ``by``, such as
    the schema a statement ran against. Names may be quoted or qualified, and the keyword COLUMN may be
    left out. The blockers of a column are listed once, before the
    join, so the join adds no rows. Without ``by`` there is one schema for all statements, which is
    broadcast when it is measured to be small.
    """
    actions = stmts.select("*", F.inline(_actions(F.col(statement))))
    tokens = F.col("tokens")
    old = F.when(_says(tokens, 1, "COLUMN"), 2).otherwise(1)
    renames = actions.filter(_says(tokens, 0, "RENAME") & _says(tokens, old + 1, "TO")).select(
        *stmts.columns,
        "table_name",
        _name(F.get(tokens, old)).alias("old_name"),
        _name(F.get(tokens, old + 2)).alias("new_name"),
    )
    blockers = fks.groupBy(*by, F.lower("ref_table").alias("__t"), F.lower("ref_column").alias("__c")).agg(
        F.concat_ws(", ", F.array_sort(F.collect_set(F.concat_ws(".", "table_name", "fk_name")))).alias("blockers")
    )
    keyed = renames.withColumn("__t", F.lower("table_name")).withColumn("__c", F.lower("old_name"))
    joined = keyed.join(blockers if by else broadcast_if_small(blockers), [*by, "__t", "__c"], "left")
    return joined.select(
        *stmts.columns,
        "table_name",
        "old_name",
        "new_name",
        F.coalesce("blockers", F.lit("")).alias("blockers"),
        F.col("blockers").isNotNull().alias("blocked"),
    )


def preflight_constraints(
    stmts: DataFrame, columns: DataFrame, constraints: DataFrame, by: Sequence[str] = (), statement: str = "statement"
) -> DataFrame:
    """Constraint changes with the first reason that forbids them, or NULL.

    ``columns`` holds (table_name, col_name), ``constraints`` holds (table_name, fk_name), both with
    the columns in ``by``. Checked in order: a dropped constraint is missing, an added one exists,
    its column is missing, the referenced column is missing. Each clause of a statement has its own row;
    keys of several columns, and keys that name no referenced column, are not judged. Lookups go by
    distinct names.
    """
    actions = stmts.select("*", F.inline(_actions(F.col(statement))))
    tokens = F.col("tokens")
    drops, guarded = _says(tokens, 0, "DROP", "CONSTRAINT"), _says(tokens, 2, "IF", "EXISTS")
    # the name of the other table may be qualified
    other = F.when(F.get(tokens, F.lit(10)) == ".", 11).otherwise(9)
    adds = (
        _says(tokens, 0, "ADD", "CONSTRAINT") & _says(tokens, 3, "FOREIGN", "KEY", "(") & _says(tokens, 7, ")", "REFERENCES")
        & _says(tokens, other + 1, "(") & _says(tokens, other + 3, ")")
    )

    def of_add(at: Column) -> Column:
        return F.when(adds, _name(F.get(tokens, at)))

    changes = actions.filter(adds | drops).select(
        *stmts.columns,
        F.when(adds, "ADD").otherwise("DROP").alias("action"),
        "table_name",
        _name(F.get(tokens, F.when(drops & guarded, 4).otherwise(2))).alias("constraint_name"),
        (drops & guarded).alias("if_exists"),
        of_add(F.lit(6)).alias("local_column"),
        of_add(other).alias("ref_table"),
        of_add(other + 2).alias("ref_column"),
    )

    def lookup(frame: DataFrame, names: DataFrame, name: str, table: str, col: str, flag: str) -> DataFrame:
        held = names.select(*by, F.lower("table_name").alias("__t"), F.lower(name).alias("__c")).distinct()
        held = (held if by else broadcast_if_small(held)).withColumn(flag, F.lit(True))
        keyed = frame.withColumn("__t", F.lower(table)).withColumn("__c", F.lower(col))
        return keyed.join(held, [*by, "__t", "__c"], "left").drop("__t", "__c")

    seen = lookup(changes, constraints, "fk_name", "table_name", "constraint_name", "__has")
    seen = lookup(seen, columns, "col_name", "table_name", "local_column", "__local")
    seen = lookup(seen, columns, "col_name", "ref_table", "ref_column", "__ref")
    add = F.col("action") == "ADD"
    problem = (
        F.when(
            ~add & ~F.col("if_exists") & F.col("__has").isNull(),
            F.format_string(MISSING_CONSTRAINT, "constraint_name", "table_name"),
        )
        .when(
            add & F.col("__has").isNotNull(),
            F.format_string(DUPLICATE_CONSTRAINT, "constraint_name", "table_name"),
        )
        .when(
            add & F.col("__local").isNull(),
            F.format_string(MISSING_COLUMN, "table_name", "local_column"),
        )
        .when(
            add & F.col("__ref").isNull(),
            F.format_string(MISSING_REFERENCE, "ref_table", "ref_column"),
        )
    )
    return seen.select(*stmts.columns, "action", "table_name", "constraint_name", problem.alias("problem"))


def lock_summary(df: DataFrame, keys: Sequence[str], rollup: bool = False) -> DataFrame:
    """Statements, ticks, worst rate and destructive count per key; with subtotals if asked."""
    grouped = df.rollup(*keys) if rollup else df.groupBy(*keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("statements"),
        F.sum("lock_ticks").alias("ticks"),
        F.max("failure_rate").alias("worst_rate"),
        F.count_if(F.col("destroys_data")).alias("destructive"),
    )
