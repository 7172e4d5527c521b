"""Column expressions over SQL text. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ending of a partition child's name.
CHILD_SUFFIX = r"_p(\d+)$"

_SEPARATOR = "\u0001"


_BLANKS = " \t\n\u000b\f\r"


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(col, F.lit(_BLANKS))


def strip_right(col: Column) -> Column:
    """Remove white space of any kind from the right end."""
    return F.rtrim(col, F.lit(_BLANKS))


def cut(col: Column, pattern: str, groups: int) -> Column:
    """All groups of a pattern that covers the whole text, as an array, from one pass."""
    marks = _SEPARATOR.join(f"${n}" for n in range(1, groups + 1))
    return F.split(F.regexp_replace(col, pattern, marks), _SEPARATOR)


def collapse(col: Column) -> Column:
    """Upper-case text with every run of white space turned into one space."""
    return strip(F.regexp_replace(F.upper(col), r"\s+", " "))


def _clean(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def split_plain(col: Column) -> Column:
    """Statements of a script, cut at every semicolon; blanks are dropped."""
    return _clean(F.split(col, ";"))


def split_quoted(col: Column) -> Column:
    """Statements of a script, cut at semicolons outside single quotes.

    Cutting at the quote first puts quoted text at odd positions, so no backtracking pattern is
    needed and the work stays linear in the length of the script.
    """
    pieces = F.transform(
        F.split(col, "'"),
        lambda piece, at: F.when(at % 2 == 0, F.replace(piece, F.lit(";"), F.lit(_SEPARATOR))).otherwise(piece),
    )
    quoted = F.split(F.array_join(pieces, "'"), _SEPARATOR)
    return _clean(F.when(col.contains("'"), quoted).otherwise(F.split(col, ";")))


def without_comments(col: Column) -> Column:
    """Text with line and block comments replaced by a blank; what only looks like one in a literal stays."""
    cleaned = F.regexp_replace(col, r"('(?:[^']++|'')*+')|--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/", "$1 ")
    return F.when(col.contains("--") | col.contains("/*"), cleaned).otherwise(col)


def without_literals(col: Column) -> Column:
    """Text with the contents of single-quoted literals removed."""
    return F.array_join(F.filter(F.split(col, "'"), lambda _, at: at % 2 == 0), "''")


_BRACKETED = r"\([^()]*\)"


def without_parens(col: Column) -> Column:
    """Text with each bracketed part replaced by a blank, however deep; brackets without a partner stay.

    Patterns take away what is nested up to three deep. Only where a pair is left, the text is
    folded piece by piece with a stack of what stands before each open bracket.
    """
    for _ in range(3):
        col = F.regexp_replace(col, _BRACKETED, " ")
    rest = F.transform(F.array(col), lambda text: F.when(text.rlike(_BRACKETED), _fold_parens(text)).otherwise(text))
    return F.get(rest, 0)


def _fold_parens(col: Column) -> Column:
    pieces = F.regexp_extract_all(col, F.lit(r"[()]|[^()]+"), F.lit(0))

    def take(stack: Column, piece: Column) -> Column:
        top, below = F.element_at(stack, -1), F.slice(stack, 1, F.size(stack) - 1)
        closed = F.concat(
            F.slice(stack, 1, F.greatest(F.size(stack) - 2, F.lit(0))),
            F.array(F.concat(F.coalesce(F.get(stack, F.size(stack) - 2), F.lit("")), F.lit(" "))),
        )
        return (
            F.when(piece == "(", F.concat(stack, F.array(F.lit(""))))
            .when((piece == ")") & (F.size(stack) > 1), closed)
            .otherwise(F.concat(below, F.array(F.concat(top, piece))))
        )

    return F.aggregate(pieces, F.array(F.lit("")), take, lambda stack: F.array_join(stack, "("))


# a part between commas, with brackets up to three deep; possessive, so it never backtracks
_PART = r"(?:[^,()]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))++"


def split_commas(col: Column) -> Column:
    """Parts between commas that stand outside every bracket, trimmed, blanks dropped.

    One pattern does for texts with brackets up to three deep. Where the parts that it finds do
    not make up the text again, because brackets are deeper or unbalanced, the text is folded
    piece by piece with a count of open brackets.
    """
    found = F.regexp_extract_all(col, F.lit(_PART), F.lit(0))
    parts = F.transform(
        F.array(found), lambda these: F.when(F.array_join(these, ",") == col, these).otherwise(_fold_commas(col))
    )
    return _clean(F.get(parts, 0))


def _fold_commas(col: Column) -> Column:
    def count(piece: Column, sign: str) -> Column:
        return F.length(piece) - F.length(F.replace(piece, F.lit(sign), F.lit("")))

    def state(parts: Column, held: Column, depth: Column) -> Column:
        return F.struct(
            parts.cast("array<string>").alias("parts"),
            held.cast("string").alias("held"),
            depth.cast("int").alias("depth"),
        )

    def take(acc: Column, piece: Column) -> Column:
        depth = F.greatest(F.lit(0), acc["depth"] + count(piece, "(") - count(piece, ")"))
        text = F.when(acc["depth"] > 0, F.concat(acc["held"], F.lit(","), piece)).otherwise(piece)
        return state(
            F.when(depth == 0, F.concat(acc["parts"], F.array(text))).otherwise(acc["parts"]),
            F.when(depth == 0, F.lit("")).otherwise(text),
            depth,
        )

    return F.aggregate(
        F.split(col, ","),
        state(F.array(), F.lit(""), F.lit(0)),
        take,
        lambda acc: F.concat(acc["parts"], F.array(acc["held"])),
    )


def normalize_sql(col: Column) -> Column:
    """Drop code fences, blank lines and trailing white space; end with a semicolon."""
    text = strip(F.coalesce(col, F.lit("")))
    unfenced = strip(F.regexp_replace(text, r"^`+|`+$", ""))
    unfenced = F.when(F.lower(unfenced).startswith("sql"), strip(F.substring(unfenced, 4, 1 << 30))).otherwise(unfenced)
    text = F.when(text.startswith("```"), unfenced).otherwise(text)
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), strip_right)
    text = F.array_join(F.filter(lines, lambda line: line != ""), "\n")
    return F.when((text == "") | text.endswith(";"), text).otherwise(F.concat(text, F.lit(";")))


def child_name(col: Column) -> Column:
    """Partition child name without its table prefix: ``orders_p7`` becomes ``p7``."""
    number = F.regexp_extract(F.lower(col), CHILD_SUFFIX, 1)
    return F.when(number != "", F.concat(F.lit("p"), number)).otherwise(F.lower(col))
