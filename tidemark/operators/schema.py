"""Analytics over tables of schema snapshots.

A schema is a set of frames with one row per table, column, foreign key, partition spec or
partition child. Frames of current schemas are keyed by (snapshot_id, target_id), frames of target
schemas by target_id. A DDL text is taken apart once, into one row per feature of any kind, of which
the frames are selections. Scores are sums of points per snapshot over these features, which meet all
that their target wants in one join. All snapshots share a few targets and column names, so a shuffle
by those would put most rows into a few tasks: targets are measured once and broadcast when small, and
only larger ones are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import unit
from tidemark.functions.text import child_name, cut, split_commas, split_quoted, strip, without_comments
from tidemark.functions.windows import running
from tidemark.sources.tables import broadcast_if_small, is_small

# Points in hundredths for target features found in a schema.
TABLE_POINTS = 100
COLUMN_POINTS = {"present": 50, "col_type": 20, "col_default": 10, "not_null": 10, "is_primary": 10}
FK_POINTS = 100
MODE_POINTS = 60
MODE_COLUMNS_POINTS = 40
CHILD_POINTS = 50
CHILD_NAME_POINTS = 25
# Penalties in hundredths for unexpected features, and their cap.
EXTRA_COLUMN_COST = 3
EXTRA_FK_COST = 4
EXTRA_CHILD_COST = 2
CHANGED_MODE_COST = 5
PENALTY_CAP = 20

ATTRIBUTES = ("col_type", "col_default", "not_null", "is_primary")

# a name without its schema and quotes
_NAME = r'(?:"?\w+"?\s*\.\s*)?"?(\w+)"?'
_CREATE = (
    r"(?is)^CREATE\s+(?:(?:GLOBAL|LOCAL)\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?" + _NAME
)
_BODY = _CREATE + r"\s*\((.*?)\)\s*(?:PARTITION\s+BY\s+(\w+)\s*\(([^)]*)\))?\s*$"
_CHILD = _CREATE + r"\s+PARTITION\s+OF\s+" + _NAME + r"\s+(.*)$"
# without these, a statement has no partition spec, and is no partition
_HAS_SPEC = r"(?i)PARTITION\s+BY"
_HAS_PARENT = r"(?i)PARTITION\s+OF"
_LIKE = r"(?is)^LIKE\s+" + _NAME + r"\s+INCLUDING\s+ALL$"
_NOT_A_COLUMN = r"(?is)^(?:CONSTRAINT|PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|EXCLUDE|LIKE)\b"
_COLUMN = (
    r'(?is)^"?(\w+)"?\s+((?:double\s+precision|character\s+varying|timestamp\s+with(?:out)?\s+time\s+zone|\w+)'
    r"(?:\s*\([^)]*\))?)(.*)$"
)
_DEFAULT = r"(?is)\bDEFAULT\s+('[^']*'|[^\s(]+(?:\([^)]*\))?)"
# the referenced column may be left out
_FK = (
    r'(?is)^(?:CONSTRAINT\s+"?(\w+)"?\s+)?FOREIGN\s+KEY\s*\(\s*"?(\w+)"?[^)]*\)\s*REFERENCES\s+'
    + _NAME
    + r'(?:\s*\(\s*"?(\w+)"?|\s|$).*$'
)
# Other names of types.
TYPE_NAMES = {
    "bool": "boolean", "character": "char", "character varying": "varchar", "dec": "decimal", "float4": "real",
    "float8": "double precision", "int": "integer", "int2": "smallint", "int4": "integer", "int8": "bigint",
    "numeric": "decimal", "timestamp without time zone": "timestamp", "timestamptz": "timestamp with time zone",
}


@dataclass(frozen=True)
class Schema:
    """Frames that describe many schemas, or many targets."""

    tables: DataFrame  # key, table_name
    columns: DataFrame  # key, table_name, ordinal, col_name, col_type, col_default, not_null, is_primary
    fks: DataFrame  # key, table_name, fk_name, col_name, ref_table, ref_column
    partitions: DataFrame  # key, table_name, mode, columns
    children: DataFrame  # key, parent, child, bounds
    small: bool | None = None  # whether all frames together were measured to be small
    features: DataFrame | None = None  # the rows of all frames with their ``kind``, where one pass yields them


def _measured(tgt: Schema) -> Schema:
    """The target, worked out once when it was measured to be small.

    A small target is needed at a dozen joins. Its few rows are fetched, as a broadcast would do
    each time, and serve as local rows from then on.
    """
    if tgt.small is not None:
        return tgt
    frames = {name: getattr(tgt, name) for name in ("tables", "columns", "fks", "partitions", "children")}
    if not is_small(*frames.values()):
        return replace(tgt, small=False)
    local = {name: df.sparkSession.createDataFrame(df.toArrow(), df.schema) for name, df in frames.items()}
    return Schema(**local, small=True)


def type_text(raw: Column) -> Column:
    """Lower-case type, by one name for each type, without blanks next to brackets and commas."""
    return _type_name(_tight_type(raw))


def _tight_type(raw: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(strip(raw)), r"\s+", " ")
    return F.regexp_replace(squeezed, r"\s*([(),])\s*", "$1")


def _type_name(tight: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    name = F.substring_index(tight, "(", 1)
    arguments = F.regexp_extract(tight, r"\(.*$", 0)
    return F.concat(F.coalesce(F.try_element_at(names, name), name), arguments)


def _column_clauses(body: Column) -> Column:
    return F.filter(split_commas(body), lambda clause: ~clause.rlike(_NOT_A_COLUMN))


def _fk_clauses(body: Column) -> Column:
    return F.filter(split_commas(body), lambda clause: clause.rlike(_FK))


def _column_fields(parts: Column) -> list[Column]:
    """Name, type and constraints from a clause cut by the column pattern."""
    rest = F.coalesce(F.get(parts, 2), F.lit(""))
    tight = _tight_type(F.coalesce(F.get(parts, 1), F.lit("")))
    return [F.get(parts, 0).alias("col_name"), *_typed_fields(tight, rest)]


def _typed_fields(tight: Column, rest: Column) -> list[Column]:
    return [
        _type_name(tight).alias("col_type"),
        F.lower(F.regexp_extract(rest, _DEFAULT, 1)).alias("col_default"),
        rest.rlike(r"(?i)\bNOT\s+NULL\b").alias("not_null"),
        rest.rlike(r"(?i)\bPRIMARY\s+KEY\b").alias("is_primary"),
    ]


def _fk_fields(parts: Column) -> list[Column]:
    return [F.get(parts, at).alias(name) for at, name in enumerate(("fk_name", "col_name", "ref_table", "ref_column"))]


def column_defs(body: Column) -> Column:
    """Column definitions of a table body as an array of structs."""
    parts = F.transform(_column_clauses(body), lambda clause: cut(clause, _COLUMN, 3))
    return F.transform(parts, lambda p: F.struct(*_column_fields(p)))


def fk_defs(body: Column) -> Column:
    """Foreign keys of a table body as an array of structs; the first column of each counts."""
    parts = F.transform(_fk_clauses(body), lambda clause: cut(clause, _FK, 4))
    return F.transform(parts, lambda p: F.struct(*_fk_fields(p)))


def names_list(text: Column) -> Column:
    """``a, b`` as an array of names."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda name: name != "")


def _taken_apart(stmt: Column) -> Column:
    """Name, body, and partition texts of a CREATE TABLE statement, as they are written; '' where there is none."""
    has_spec, has_parent = stmt.rlike(_HAS_SPEC), stmt.rlike(_HAS_PARENT)

    def found(has: Column, pattern: str, group: int) -> Column:
        return F.when(has, F.regexp_extract(stmt, pattern, group)).otherwise("")

    return F.struct(
        F.regexp_extract(stmt, _CREATE, 1).alias("table_name"),
        F.regexp_extract(stmt, _BODY, 2).alias("body"),
        found(has_spec, _BODY, 3).alias("mode"),
        found(has_spec, _BODY, 4).alias("mode_columns"),
        found(has_parent, _CHILD, 2).alias("parent"),
        found(has_parent, _CHILD, 3).alias("bounds"),
    )


def _last_ones(stmts: Column, names: Column) -> Column:
    """Of the statements that share a name, the last one."""
    backwards = F.reverse(names)
    # the place in the reversed list counts from 1
    last = F.filter(stmts, lambda _, at: F.array_position(backwards, F.get(names, at)) == F.size(names) - at)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), stmts).otherwise(last)


def _clause_features(body: Column) -> Column:
    """(kind, ordinal, clause) of the table itself, its columns and its foreign keys; a body is cut once."""

    def listed(kind: str, clauses: Column) -> Column:
        return F.transform(
            clauses, lambda clause, at: F.struct(F.lit(kind).alias("kind"), (at + 1).alias("ordinal"), clause.alias("clause"))
        )

    def both(clauses: Column) -> Column:
        columns = F.filter(clauses, lambda clause: ~clause.rlike(_NOT_A_COLUMN))
        fks = F.filter(clauses, lambda clause: clause.rlike(_FK))
        return F.concat(listed("table", F.array(F.lit(""))), listed("column", columns), listed("fk", fks))

    return F.flatten(F.transform(F.array(split_commas(body)), both))


def _features(ddl: DataFrame, text: str) -> DataFrame:
    """One row per table, column, foreign key, partition spec (``mode``) and partition child of each text.

    Of the statements of a text that share a name, the last one holds; a later definition without a spec
    leaves the spec of an earlier one. What one step yields is used several times in the next, and lists are
    exploded with their empty ones (which the filters leave out again), so that the planner works out no
    step twice: it would copy what is exploded into a filter on its length.
    """
    keys = [c for c in ddl.columns if c != text]
    clean = ddl.select(*keys, without_comments(F.col(text)).alias("__text"))
    creates = F.filter(F.transform(split_quoted(F.col("__text")), _taken_apart), lambda stmt: stmt["table_name"] != "")
    apart = clean.select(*keys, creates.alias("__stmts"))
    chosen = apart.select(
        *keys,
        F.col("__stmts"),
        F.filter("__stmts", lambda stmt: stmt["mode"] != "").alias("__specs"),
        F.filter("__stmts", lambda stmt: stmt["parent"] != "").alias("__children"),
    )
    child_names = F.transform("__children", lambda stmt: F.concat_ws("\n", stmt["parent"], stmt["table_name"]))

    def tagged(kind: str, stmts: Column) -> Column:
        return F.transform(stmts, lambda stmt: F.struct(F.lit(kind).alias("of"), stmt.alias("stmt")))

    every = F.concat(
        tagged("table", _last_ones(F.col("__stmts"), F.col("__stmts.table_name"))),
        tagged("mode", _last_ones(F.col("__specs"), F.col("__specs.table_name"))),
        tagged("child", _last_ones(F.col("__children"), child_names)),
    )
    stmts = chosen.select(*keys, F.explode_outer(every).alias("__one")).filter(F.col("__one").isNotNull())
    one = F.array(F.struct(F.col("__one.of").alias("kind"), F.lit(1).alias("ordinal"), F.lit("").alias("clause")))
    parts = F.when(F.col("__one.of") == "table", _clause_features(F.col("__one.stmt.body"))).otherwise(one)
    each = stmts.select(*keys, F.col("__one.stmt").alias("__stmt"), F.explode_outer(parts).alias("__part")).filter(
        F.col("__part").isNotNull()
    )
    kind, clause = F.col("kind"), F.col("__part.clause")
    named = each.select(*keys, "__stmt", F.col("__part.kind").alias("kind"), "__part")
    cells = named.withColumn("__cut", F.when(kind == "column", cut(clause, _COLUMN, 3)).when(kind == "fk", cut(clause, _FK, 4)))

    def of(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    tight = _tight_type(F.coalesce(F.get("__cut", F.lit(1)), F.lit("")))
    texts = cells.withColumns(
        {"__tight": of("column", tight), "__rest": of("column", F.coalesce(F.get("__cut", F.lit(2)), F.lit("")))}
    )
    fk_name, fk_column, ref_table, ref_column = _fk_fields(F.col("__cut"))
    typed = zip(ATTRIBUTES, _typed_fields(F.col("__tight"), F.col("__rest")), strict=True)
    return texts.select(
        *keys,
        "kind",
        F.when(kind != "child", F.col("__stmt.table_name")).alias("table_name"),
        of("column", F.col("__part.ordinal")).alias("ordinal"),
        of("column", F.get("__cut", F.lit(0))).when(kind == "fk", fk_column).alias("col_name"),
        *[of("column", value).alias(name) for name, value in typed],
        of("fk", fk_name).alias("fk_name"),
        of("fk", ref_table).alias("ref_table"),
        of("fk", ref_column).alias("ref_column"),
        of("mode", F.upper(F.col("__stmt.mode"))).alias("mode"),
        of("mode", names_list(F.col("__stmt.mode_columns"))).alias("columns"),
        of("child", F.col("__stmt.parent")).alias("parent"),
        of("child", F.col("__stmt.table_name")).alias("child"),
        of("child", F.lower(F.regexp_replace(F.col("__stmt.bounds"), r"\s+", " "))).alias("bounds"),
    )


_FIELDS = {
    "table": ["table_name"],
    "column": ["table_name", "ordinal", "col_name", *ATTRIBUTES],
    "fk": ["table_name", "fk_name", "col_name", "ref_table", "ref_column"],
    "mode": ["table_name", "mode", "columns"],
    "child": ["parent", "child", "bounds"],
}


def _of_kind(features: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    return features.filter(F.col("kind") == kind).select(*keys, *_FIELDS[kind])


def _ddl_to(kind: str, ddl: DataFrame, text: str) -> DataFrame:
    return _of_kind(_features(ddl, text), [c for c in ddl.columns if c != text], kind)


def ddl_to_tables(ddl: DataFrame, text: str = "ddl") -> DataFrame:
    """Tables created by each DDL text. A table that is defined several times has its last definition."""
    return _ddl_to("table", ddl, text)


def ddl_to_columns(ddl: DataFrame, text: str = "ddl") -> DataFrame:
    """Columns of the tables created by each DDL text."""
    return _ddl_to("column", ddl, text)


def ddl_to_fks(ddl: DataFrame, text: str = "ddl") -> DataFrame:
    """Foreign keys of the tables created by each DDL text."""
    return _ddl_to("fk", ddl, text)


def ddl_to_partitions(ddl: DataFrame, text: str = "ddl") -> tuple[DataFrame, DataFrame]:
    """Partition specs, and partition children with their bounds."""
    return _ddl_to("mode", ddl, text), _ddl_to("child", ddl, text)


def ddl_to_schema(ddl: DataFrame, text: str = "ddl") -> Schema:
    """All frames of the schemas in a DDL corpus. No frame needs a shuffle."""
    features = _features(ddl, text)
    keys = [c for c in ddl.columns if c != text]
    return Schema(*[_of_kind(features, keys, kind) for kind in _FIELDS], features=features)


_KEY = ["snapshot_id", "target_id"]
_EXTRAS = ("extra_columns", "extra_fks", "extra_children", "changed_modes")


def _part(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    names = ("points", *_EXTRAS)
    return df.select(*keys, *[values.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])


_NAMES = ["__n1", "__n2", "__n3", "__n4"]


def _named(df: DataFrame, *names: Column) -> DataFrame:
    """A feature's kind and the up to four names by which a target knows it."""
    filled = [*names, *[F.lit("")] * (len(_NAMES) - len(names))]
    return df.withColumns(dict(zip(_NAMES, filled, strict=True)))


def _stacked(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _wanted(tgt: Schema, has_table: DataFrame) -> DataFrame:
    """What targets want, of every kind, with the values that a found feature is compared with."""
    child_tables = tgt.children.select("target_id", F.col("child").alias("table_name"))
    tables = has_table.join(child_tables, ["target_id", "table_name"], "left_anti")
    fk = ["table_name", "col_name", "ref_table", "ref_column"]
    scored = tgt.partitions.select("target_id", F.col("table_name").alias("parent"), F.lit(1).alias("__scored"))
    kinds = {
        "table": _named(tables, F.col("table_name")),
        "column": _named(tgt.columns.withColumnsRenamed({a: f"t_{a}" for a in ATTRIBUTES}), F.col("table_name"), F.col("col_name")),
        "fk": _named(tgt.fks.select("target_id", *fk).distinct(), *[F.col(c) for c in fk]),
        "mode": _named(tgt.partitions.withColumnsRenamed({"mode": "t_mode", "columns": "t_columns"}), F.col("table_name")),
        "child": _named(
            tgt.children.withColumnsRenamed({"child": "t_child", "bounds": "t_bounds"}).join(scored, ["target_id", "parent"], "left"),
            F.col("parent"),
            child_name(F.col("t_child")),
        ),
    }
    values = [*[f"t_{a}" for a in ATTRIBUTES], "t_mode", "t_columns", "t_child", "t_bounds", "__scored"]
    return _stacked(
        [
            df.select("target_id", F.lit(kind).alias("kind"), *_NAMES, F.lit(True).alias("__in"), *[c for c in values if c in df.columns])
            for kind, df in kinds.items()
        ]
    )


def _cur_features(cur: Schema) -> DataFrame:
    """The features of current schemas in one frame."""
    if cur.features is not None:
        return cur.features
    frames = zip(_FIELDS.items(), (cur.tables, cur.columns, cur.fks, cur.partitions, cur.children), strict=True)
    return _stacked([df.select(*_KEY, F.lit(kind).alias("kind"), *[c for c in fields if c != "ordinal" and c != "fk_name"]) for (kind, fields), df in frames])


def _parts(cur: Schema, tgt: Schema) -> DataFrame:
    """Points and unexpected features of the current schemas: one sum per snapshot for tables, columns and
    partition specs, and one row for each different foreign key and partition child."""

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if tgt.small else df

    has_table = tgt.tables.select("target_id", "table_name").distinct()
    kind = F.col("kind")

    def name(**by_kind: Column) -> Column:
        chosen = F.lit("")
        for of, value in by_kind.items():
            chosen = F.when(kind == of, value).otherwise(chosen)
        return chosen

    rows = _named(
        _cur_features(cur),
        F.when(kind == "child", F.col("parent")).otherwise(F.col("table_name")),
        name(column=F.col("col_name"), fk=F.col("col_name"), child=child_name(F.col("child"))),
        name(fk=F.col("ref_table")),
        name(fk=F.col("ref_column")),
    )
    met = rows.join(side(has_table.withColumn("__known", F.lit(True))), ["target_id", "table_name"], "left").join(
        side(_wanted(tgt, has_table)), ["target_id", "kind", *_NAMES], "left"
    )
    found = F.col("__in").isNotNull()
    # columns and keys count in tables of the target, tables and specs where they are wanted, children always
    counted = met.filter(
        F.when(kind.isin("column", "fk"), F.col("__known").isNotNull()).when(kind.isin("table", "mode"), found).otherwise(True)
    )

    column_points = F.lit(COLUMN_POINTS["present"])
    for a in ATTRIBUTES:
        column_points = column_points + F.when(F.col(a).eqNullSafe(F.col(f"t_{a}")), COLUMN_POINTS[a]).otherwise(0)
    same_mode = F.col("mode").eqNullSafe(F.col("t_mode"))
    same_columns = F.col("columns").eqNullSafe(F.col("t_columns"))
    mode_points = F.when(same_mode, MODE_POINTS).otherwise(0) + F.when(same_columns, MODE_COLUMNS_POINTS).otherwise(0)
    exact = (F.col("child") == F.col("t_child")) & F.col("bounds").eqNullSafe(F.col("t_bounds"))
    child_points = F.when(F.col("__scored").isNull(), 0).when(exact, CHILD_POINTS).otherwise(CHILD_NAME_POINTS)
    points = (
        F.when(kind == "child", child_points)
        .when(~found, 0)
        .when(kind == "table", TABLE_POINTS)
        .when(kind == "column", column_points)
        .when(kind == "fk", FK_POINTS)
        .otherwise(mode_points)
    )

    def extra(of: str, when: Column) -> Column:
        return F.when((kind == of) & when, 1).otherwise(0)

    once = kind.isin("fk", "child")
    which = [
        F.when(once, kind).alias("__once"),
        F.when(once, F.col("__n1")).alias("__i1"),
        F.when(once, F.col("__n2")).alias("__i2"),
        F.when(kind == "fk", F.col("__n3")).when(kind == "child", F.col("t_child")).alias("__i3"),
        F.when(kind == "fk", F.col("__n4")).alias("__i4"),
    ]
    valued = counted.select(
        *_KEY,
        *which,
        points.alias("points"),
        extra("column", ~found).alias("extra_columns"),
        extra("fk", ~found).alias("extra_fks"),
        extra("child", F.col("t_child").isNull()).alias("extra_children"),
        extra("mode", ~(same_mode & same_columns)).alias("changed_modes"),
    )
    different = valued.groupBy(*_KEY, "__once", "__i1", "__i2", "__i3", "__i4").agg(
        F.sum("points").alias("__sum"),
        F.max("points").alias("__max"),
        F.sum("extra_columns").alias("extra_columns"),
        F.max("extra_fks").alias("extra_fks"),
        F.max("extra_children").alias("extra_children"),
        F.sum("changed_modes").alias("changed_modes"),
    )
    summed = F.when(F.col("__once").isNull(), F.col("__sum")).otherwise(F.col("__max"))
    return _part(different, _KEY, points=summed, **{name: F.col(name) for name in _EXTRAS})


def target_points(tgt: Schema) -> DataFrame:
    """The points that a perfect schema reaches, per target."""
    child_tables = tgt.children.select("target_id", F.col("child").alias("table_name"))

    def no_child(df: DataFrame) -> DataFrame:
        return df.join(child_tables, ["target_id", "table_name"], "left_anti")

    specs = tgt.partitions.select("target_id", F.col("table_name").alias("parent"))
    parts = [
        (no_child(tgt.tables.select("target_id", "table_name").distinct()), TABLE_POINTS),
        (no_child(tgt.columns), sum(COLUMN_POINTS.values())),
        (no_child(tgt.fks), FK_POINTS),
        (tgt.partitions, MODE_POINTS + MODE_COLUMNS_POINTS),
        (tgt.children.join(specs, ["target_id", "parent"], "left_semi"), CHILD_POINTS),
    ]
    listed = [df.select("target_id", F.lit(points).alias("p")) for df, points in parts]
    return reduce(DataFrame.unionByName, listed).groupBy("target_id").agg(F.sum("p").alias("target_points"))


def _penalty() -> Column:
    cost = (
        F.col("extra_columns") * EXTRA_COLUMN_COST
        + F.col("extra_fks") * EXTRA_FK_COST
        + F.col("extra_children") * EXTRA_CHILD_COST
        + F.col("changed_modes") * CHANGED_MODE_COST
    )
    return F.least(F.lit(PENALTY_CAP), cost) / 100


def _totals(snapshots: DataFrame, cur: Schema, tgt: Schema) -> DataFrame:
    """Points and extras per snapshot; a snapshot without any feature has zeros."""
    every = reduce(DataFrame.unionByName, [_part(snapshots, _KEY), _parts(cur, tgt)])
    return every.groupBy(*_KEY).agg(*[F.sum(n).alias(n) for n in ("points", *_EXTRAS)])


def schema_extras(snapshots: DataFrame, cur: Schema, tgt: Schema) -> DataFrame:
    """Unexpected features of each snapshot and their capped penalty."""
    return _totals(snapshots, cur, _measured(tgt)).select(*_KEY, *_EXTRAS, _penalty().alias("penalty"))


def schema_match(snapshots: DataFrame, cur: Schema, tgt: Schema, ddl: str | None = None, target_ddl: DataFrame | None = None) -> DataFrame:
    """Match of each snapshot with its target, in [0, 1].

    ``snapshots`` lists (snapshot_id, target_id). If it also holds the schema text in ``ddl``, and
    ``target_ddl`` gives (target_id, target_ddl), equal texts match fully. So does any schema when
    its target has no tables.
    """
    tgt = _measured(tgt)
    whole = target_points(tgt)
    totals = _totals(snapshots, cur, tgt).join(F.broadcast(whole) if tgt.small else whole, "target_id", "left")
    base = F.least(F.lit(1.0), F.col("points") / F.col("target_points"))
    score = F.when(F.col("target_points").isNull(), F.lit(1.0)).otherwise(unit(base - _penalty()))
    scored = totals.select(*_KEY, score.alias("schema_match"))
    if ddl is None or target_ddl is None:
        return scored
    equal = (
        snapshots.join(broadcast_if_small(target_ddl), "target_id")
        .filter(strip(F.col(ddl)) == strip(F.col("target_ddl")))
        .select(*_KEY, F.lit(1.0).alias("__equal"))
    )
    return scored.join(equal, _KEY, "left").select(
        *_KEY, F.coalesce("__equal", "schema_match").alias("schema_match")
    )


def schema_diff(snapshots: DataFrame, cur: Schema, tgt: Schema) -> DataFrame:
    """Columns that are missing, extra (in tables the target knows) or changed, and in which attributes."""
    tgt = _measured(tgt)
    name = ["table_name", "col_name"]
    wanted = tgt.columns.select(
        "target_id", *name, *[F.col(a).alias(f"t_{a}") for a in ATTRIBUTES], F.lit(True).alias("__t")
    )
    has_table = tgt.tables.select("target_id", "table_name").distinct()
    if tgt.small:
        wanted, has_table = F.broadcast(wanted), F.broadcast(has_table)
    expected = snapshots.select(*_KEY).join(wanted, "target_id")
    present = cur.columns.select(*_KEY, *name, *ATTRIBUTES, F.lit(True).alias("__c")).join(
        has_table, ["target_id", "table_name"], "left_semi"
    )
    both = expected.join(present, [*_KEY, *name], "full_outer")
    changed = F.array_compact(
        F.array(*[F.when(~F.col(a).eqNullSafe(F.col(f"t_{a}")), F.lit(a)) for a in ATTRIBUTES])
    )
    kind = (
        F.when(F.col("__c").isNull(), "missing")
        .when(F.col("__t").isNull(), "extra")
        .when(F.size(changed) > 0, "changed")
    )
    attributes = F.when(kind == "changed", F.concat_ws(",", changed)).otherwise("")
    return both.select(*_KEY, *name, kind.alias("difference"), attributes.alias("attributes")).filter(
        F.col("difference").isNotNull()
    )


_COLUMN_STATE = (
    "array<struct<table_name:string,col_name:string,col_type:string,col_default:string,"
    "not_null:boolean,is_primary:boolean>>"
)
_FK_STATE = "array<struct<table_name:string,fk_name:string,col_name:string,ref_table:string,ref_column:string>>"
_MODE_STATE = "array<struct<table_name:string,mode:string,columns:array<string>>>"
_CHILD_STATE = "array<struct<parent:string,child:string,bounds:string>>"

_ALTER = r"(?is)^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?" + _NAME + r"\s+"
_ADD_COLUMNS = (
    _ALTER + r"ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(?!(?:CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK|EXCLUDE)\b)(.+)$"
)
_RENAME_COLUMN = _ALTER + r'RENAME\s+(?:COLUMN\s+)?(?!(?:TO|CONSTRAINT)\s)"?(\w+)"?\s+TO\s+"?(\w+)"?'
_DROP_CONSTRAINT = _ALTER + r'DROP\s+CONSTRAINT\s+(?:IF\s+EXISTS\s+)?"?(\w+)"?'
_IF_CONSTRAINT = _ALTER + r"DROP\s+CONSTRAINT\s+IF\s+EXISTS\s"
_ADD_CONSTRAINT = _ALTER + r"ADD\s+(CONSTRAINT\s+.+)$"
_RENAME_TABLE = _ALTER + r'RENAME\s+TO\s+"?(\w+)"?'
_DROP_TABLE = r"(?is)^DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?" + _NAME


def schema_changes(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Typed schema changes of a statement log, one row per statement that changes a schema.

    A projection: each statement becomes an operation name, up to three names, and the columns,
    foreign keys and partition columns that it brings in.
    """
    keys = [c for c in log.columns if c != sql]
    each = log.select(*keys, F.posexplode(split_quoted(without_comments(F.col(sql)))).alias("pos", "stmt"))
    s = F.col("stmt")
    body = F.regexp_extract(s, _BODY, 2)

    def table_rows(struct: Column, table: Column, to: str) -> Column:
        return F.transform(
            struct, lambda one: F.struct(table.alias("table_name"), *[one[f].alias(f) for f in to.split()])
        )

    op = (
        F.when(s.rlike(_CHILD), "create_child")
        .when(s.rlike(_BODY) & body.rlike(_LIKE), "create_like")
        .when(s.rlike(_CREATE), "create")
        .when(s.rlike(_ADD_COLUMNS), "add_columns")
        .when(s.rlike(_RENAME_COLUMN), "rename_column")
        .when(s.rlike(_DROP_CONSTRAINT), "drop_constraint")
        .when(s.rlike(_ADD_CONSTRAINT), "add_constraint")
        .when(s.rlike(_RENAME_TABLE), "rename_table")
        .when(s.rlike(_DROP_TABLE), "drop_table")
    )
    typed = each.withColumn("op", op).filter(F.col("op").isNotNull())

    def pick(**patterns: tuple[str, int]) -> Column:
        chosen = F.lit("")
        for name, (pattern, group) in patterns.items():
            chosen = F.when(F.col("op") == name, F.regexp_extract(s, pattern, group)).otherwise(chosen)
        return chosen

    table = pick(
        create_child=(_CREATE, 1),
        create_like=(_CREATE, 1),
        create=(_CREATE, 1),
        add_columns=(_ADD_COLUMNS, 1),
        rename_column=(_RENAME_COLUMN, 1),
        drop_constraint=(_DROP_CONSTRAINT, 1),
        add_constraint=(_ADD_CONSTRAINT, 1),
        rename_table=(_RENAME_TABLE, 1),
        drop_table=(_DROP_TABLE, 1),
    )
    a = F.when(F.col("op") == "create_like", F.regexp_extract(body, _LIKE, 1)).otherwise(
        pick(
            create_child=(_CHILD, 2),
            rename_column=(_RENAME_COLUMN, 2),
            drop_constraint=(_DROP_CONSTRAINT, 2),
            rename_table=(_RENAME_TABLE, 2),
        )
    )
    b = F.when(F.col("op") == "create_child", F.lower(F.regexp_replace(F.regexp_extract(s, _CHILD, 3), r"\s+", " ")))
    b = b.otherwise(pick(rename_column=(_RENAME_COLUMN, 3)))
    clauses = F.when(F.col("op") == "create", body).when(
        F.col("op") == "add_columns", F.regexp_replace(F.regexp_extract(s, _ADD_COLUMNS, 2), r"(?i),\s*ADD\s+COLUMN\s+", ", ")
    ).when(F.col("op") == "add_constraint", F.regexp_extract(s, _ADD_CONSTRAINT, 2)).otherwise("")
    named = typed.withColumns({"table_name": table, "a": a, "b": b, "__clauses": clauses})
    t = F.col("table_name")
    return named.select(
        *keys,
        "pos",
        "op",
        "table_name",
        "a",
        "b",
        F.upper(F.regexp_extract(s, _BODY, 3)).alias("mode"),
        names_list(F.regexp_extract(s, _BODY, 4)).alias("mode_columns"),
        s.rlike(_IF_CONSTRAINT).alias("if_exists"),
        table_rows(column_defs(F.col("__clauses")), t, "col_name col_type col_default not_null is_primary").alias("columns"),
        table_rows(fk_defs(F.col("__clauses")), t, "fk_name col_name ref_table ref_column").alias("fks"),
    )


def _renamed(value: Column, old: Column, new: Column) -> Column:
    return F.when(F.lower(value) == F.lower(old), new).otherwise(value)


def apply_change(state: Column, change: Column) -> Column:
    """The schema after one change.

    Statements of other kinds never get here. Creating a table that exists, or changing one that
    does not, leaves the schema as it is.
    """
    op, table, a, b = change["op"], change["table_name"], change["a"], change["b"]

    def is_table(name: Column) -> Column:
        return F.lower(name) == F.lower(table)

    def moved(rows: Column, fields: str, **new: object) -> Column:
        """Rows with some fields replaced; other fields are kept."""
        return F.transform(
            rows, lambda r: F.struct(*[(new[f](r) if f in new else r[f]).alias(f) for f in fields.split()])
        )

    column_fields = "table_name col_name col_type col_default not_null is_primary"
    fk_fields = "table_name fk_name col_name ref_table ref_column"
    columns, fks, modes, children = state["columns"], state["fks"], state["modes"], state["children"]
    own_mode = F.filter(
        F.array(F.struct(table.alias("table_name"), change["mode"].alias("mode"), change["mode_columns"].alias("columns"))),
        lambda m: m["mode"] != "",
    ).cast(_MODE_STATE)

    def of_source(rows: Column) -> Column:
        return F.filter(rows, lambda r: F.lower(r["table_name"]) == F.lower(a))

    liked_columns = moved(of_source(columns), column_fields, table_name=lambda _: table)
    liked_fks = moved(of_source(fks), fk_fields, table_name=lambda _: table)
    known = F.exists(columns, lambda c: is_table(c["table_name"]))
    held = F.transform(columns, lambda c: F.concat_ws(".", F.lower(c["table_name"]), F.lower(c["col_name"])))
    added = F.filter(
        change["columns"],
        lambda c: ~F.array_contains(held, F.concat_ws(".", F.lower(c["table_name"]), F.lower(c["col_name"]))),
    )

    new_columns = (
        F.when(
            ((op == "create") & ~known) | ((op == "add_columns") & known),
            F.concat(columns, added.cast(_COLUMN_STATE)),
        )
        .when((op == "create_like") & ~known, F.concat(columns, liked_columns.cast(_COLUMN_STATE)))
        .when(
            op == "rename_column",
            moved(
                columns,
                column_fields,
                col_name=lambda r: F.when(is_table(r["table_name"]), _renamed(r["col_name"], a, b)).otherwise(r["col_name"]),
            ),
        )
        .when(op == "rename_table", moved(columns, column_fields, table_name=lambda r: _renamed(r["table_name"], table, a)))
        .when(op == "drop_table", F.filter(columns, lambda r: ~is_table(r["table_name"])))
        .otherwise(columns)
    )
    new_fks = (
        F.when(
            ((op == "create") & ~known) | ((op == "add_constraint") & known),
            F.concat(fks, change["fks"].cast(_FK_STATE)),
        )
        .when((op == "create_like") & ~known, F.concat(fks, liked_fks.cast(_FK_STATE)))
        .when(
            op == "rename_column",
            moved(
                fks,
                fk_fields,
                col_name=lambda r: F.when(is_table(r["table_name"]), _renamed(r["col_name"], a, b)).otherwise(r["col_name"]),
            ),
        )
        .when(
            op == "drop_constraint",
            F.filter(fks, lambda r: ~(is_table(r["table_name"]) & (F.lower(r["fk_name"]) == F.lower(a)))),
        )
        .when(
            op == "rename_table",
            moved(
                fks,
                fk_fields,
                table_name=lambda r: _renamed(r["table_name"], table, a),
                ref_table=lambda r: _renamed(r["ref_table"], table, a),
            ),
        )
        .when(op == "drop_table", F.filter(fks, lambda r: ~is_table(r["table_name"])))
        .otherwise(fks)
    )
    new_modes = (
        F.when(op.isin("create", "create_like") & ~known, F.concat(modes, own_mode))
        .when(op == "rename_table", moved(modes, "table_name mode columns", table_name=lambda r: _renamed(r["table_name"], table, a)))
        .when(op == "drop_table", F.filter(modes, lambda r: ~is_table(r["table_name"])))
        .otherwise(modes)
    )
    one_child = F.array(F.struct(a.alias("parent"), table.alias("child"), b.alias("bounds"))).cast(_CHILD_STATE)

    def child_moved(r: Column) -> Column:
        number = F.regexp_extract(r["child"], r"(_p\d+)$", 1)
        own = (number != "") & (F.lower(r["child"]) == F.lower(F.concat(table, number)))
        return F.when(own, F.concat(a, number)).otherwise(r["child"])

    new_children = (
        F.when(op == "create_child", F.concat(children, one_child))
        .when(
            op == "rename_table",
            moved(children, "parent child bounds", parent=lambda r: _renamed(r["parent"], table, a), child=child_moved),
        )
        .when(op == "drop_table", F.filter(children, lambda r: ~is_table(r["parent"]) & ~is_table(r["child"])))
        .otherwise(children)
    )
    return F.struct(
        new_columns.cast(_COLUMN_STATE).alias("columns"),
        new_fks.cast(_FK_STATE).alias("fks"),
        new_modes.cast(_MODE_STATE).alias("modes"),
        new_children.cast(_CHILD_STATE).alias("children"),
    )


def empty_schema() -> Column:
    return F.struct(
        F.array().cast(_COLUMN_STATE).alias("columns"),
        F.array().cast(_FK_STATE).alias("fks"),
        F.array().cast(_MODE_STATE).alias("modes"),
        F.array().cast(_CHILD_STATE).alias("children"),
    )


#: What a fold over an episode reads of each change.
CHANGE = ["step", "pos", "op", "table_name", "a", "b", "mode", "mode_columns", "if_exists", "columns", "fks"]


def listed_changes(changes: DataFrame, tasks: DataFrame, episode: str, *more: str) -> DataFrame:
    """The changes of each episode in order, as the array ``changes``: those that its task lets happen.

    The task of an episode is that of its first row, and sets the limit for all its rows; an episode of an
    unlisted task has the largest limit of all. Nothing is executed beyond the limit, so leaving those rows
    out is exact. Rows beyond every limit go before the shuffle, and copies of a row collapse on the map
    side, so what one episode can bring into the fold is bounded however often it was logged.
    """
    most = tasks.select(F.max("max_steps")).scalar()
    limits = tasks.select(F.col("task_id").alias("__listed"), F.col("max_steps").alias("__max"))
    rows = changes.filter(F.col("step") <= most).join(limits, F.col("task_id") == F.col("__listed"), "left")
    entry = F.struct(*CHANGE, *more, "__max")
    listed = rows.groupBy(episode).agg(F.array_sort(F.collect_set(entry)).alias("changes")).withColumn("__most", most)
    limit = F.coalesce(F.get("changes", F.lit(0))["__max"], F.col("__most"))
    return listed.select(episode, F.filter("changes", lambda c: c["step"] <= limit).alias("changes"))


def replay_schema(changes: DataFrame, tasks: DataFrame, episode: str = "episode_id", as_of: int | None = None) -> DataFrame:
    """The schema of each episode after its step ``as_of``, or after its last step.

    ``changes`` comes from ``schema_changes`` with (episode_id, task_id, step, pos, …) for statements
    that succeeded; the starting schema is step 0.
    """
    listed = listed_changes(changes, tasks, episode)
    if as_of is not None:
        listed = listed.withColumn("changes", F.filter("changes", lambda c: c["step"] <= as_of))
    return listed.select(episode, F.aggregate("changes", empty_schema(), apply_change).alias("schema"))


def schema_progress(steps: DataFrame, episode: str = "episode_id", start_match: float = 0.0) -> DataFrame:
    """Match before each step, and the gain of the step (never negative).

    ``steps`` holds (episode_id, step, schema_match) and optionally ``valid``. The match of an invalid
    step is not measured and carries over. Step 0, if logged, is the reset; without it an episode
    begins at ``start_match``.
    """
    valid = F.col("valid") if "valid" in steps.columns else F.lit(True)
    measured = F.when(valid, F.struct(F.col("step").alias("at"), F.col("schema_match").alias("match")))
    seen = running(steps, [episode], "step", {"__seen": ("max", measured, False)})
    previous = F.coalesce(F.col("__seen.match"), F.lit(start_match))
    now = F.when(valid, F.col("schema_match")).otherwise(F.col("previous_match"))
    return seen.select(*steps.columns, previous.alias("previous_match")).withColumn(
        "match_gain", F.greatest(F.lit(0.0), now - F.col("previous_match"))
    )
