"""Database dump text to typed rows, with built-in expressions only.

A dump is read one statement per record (statements end in ``;`` and a line end; newlines inside
text values are escaped), so a CREATE TABLE block stays together, no line order is needed and the
file is split between tasks. Both kinds of line ends are known. Values are matched to columns by
name: by the list of the INSERT statement, else by the table's CREATE TABLE.

Statements that are too large for one record are read tuple by tuple instead (``read_tuples``): byte ranges
are cut at ``),(``, quotes tell which of these stand inside a text value, and the last INSERT head before a
range tells whose tuples it begins with. Text values hold no raw line ends and quotes are balanced outside
of ``--`` comments; both line ends are known, mixed in one file as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrina.sources.ranges import Start, fragments, joined, records, starts

# Dump grammar. Possessive repeats keep long text values off the regex stack.
_TEXT = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_BINARY = rf"_binary\s+{_TEXT}"
_NUMBER = r"-?\d++(?:\.\d++)?+(?:[eE][-+]?\d++)?+"
_ROW = rf"\(((?:[^'()]++|{_TEXT})*+)\)"
_FIELD = rf"({_BINARY}|{_TEXT}|NULL|{_NUMBER})"
_COMMENTS = r"\A(?:\s++|--[^\n]*+(?:\n|\z))++"
_TABLE = r"(?s)^(?:CREATE TABLE(?: IF NOT EXISTS)?|INSERT INTO) `(\w+)`"
_COLUMN = r"(?m)^\s+`(\w+)`\s"
_VALUES = r"(?s)^INSERT INTO `\w+`(?:\s*\([^)]*\))?\s+VALUES\s*(.+)$"
_LISTED = r"(?s)^INSERT INTO `\w+`\s*\(([^)]*)\)\s+VALUES"
_SECOND = r";\s*(?:INSERT INTO|CREATE TABLE(?: IF NOT EXISTS)?) `"
# Escape sequences of dump text; any other escaped character stands for itself.
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "Z": "\x1a", "b": "\b"}


def line_end(spark: SparkSession, path: str) -> str:
    """The line end of the first line of a dump."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    return "\r\n" if first is not None and first["value"].endswith("\r") else "\n"


def read_statements(
    spark: SparkSession, path: str, encoding: str = "UTF-8", newline: str | None = None
) -> DataFrame:
    """One ``statement`` per record. The reader passes bytes through untouched, so any encoding
    can be decoded afterwards. ``newline`` is looked up in the first line where not given."""
    newline = newline or line_end(spark, path)
    raw = spark.read.option("lineSep", f";{newline}").text(path)
    text = F.decode(F.col("value").cast("binary"), encoding) if encoding != "UTF-8" else F.col("value")
    return raw.select(text.alias("statement"))


def route(statements: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """Add the ``tabla`` a CREATE or INSERT statement is about; other statements drop out, as do
    tables outside the list. Write the result partitioned by ``tabla`` to demultiplex a dump."""
    bare = statements.withColumn("statement", F.regexp_replace("statement", _COMMENTS, ""))
    name = F.regexp_extract("statement", _TABLE, 1)
    routed = bare.withColumn("tabla", name).where(F.col("tabla") != "")
    return routed.where(F.col("tabla").isin(*tables)) if tables else routed


def write_routed(routed: DataFrame, path: str) -> None:
    """Demultiplexed dump: one folder of statements per table, a big table split over several."""
    routed.hint("rebalance", "tabla").write.mode("overwrite").partitionBy("tabla").parquet(path)


def declared_columns(routed: DataFrame) -> DataFrame:
    """``tabla`` and the array ``columnas`` of each CREATE TABLE, keys and constraints left out."""
    body = F.col("statement")
    return routed.where(body.startswith("CREATE TABLE")).select(
        "tabla", F.regexp_extract_all(body, F.lit(_COLUMN), F.lit(1)).alias("columnas")
    )


def _unescaped(text: Column) -> Column:
    """Escape sequences undone from left to right: the text is cut into sequences and what lies
    between them, and each piece is replaced on its own."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]++"), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])

    def plain(piece: Column) -> Column:
        escaped = F.substring(piece, 2, 1)
        return F.when(piece.startswith("\\"), F.coalesce(F.try_element_at(known, escaped), escaped)).otherwise(piece)

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def _value(field: Column) -> Column:
    """Text of one field: NULL, 0/1 for a binary byte, unescaped text, or the number as is."""
    inner = F.regexp_extract(field, r"(?s)^[^']*'(.*)'$", 1)
    plain = _unescaped(inner)
    return (
        F.when(field == "NULL", F.lit(None))
        .when(
            field.startswith("_binary"),
            F.when(inner.isin("", "\0", "\\0"), "0").otherwise("1"),
        )
        .when(field.startswith("'"), plain)
        .otherwise(field)
    )


def _inserts(routed: DataFrame, table: str) -> DataFrame:
    return routed.where((F.col("tabla") == table) & F.col("statement").startswith("INSERT INTO"))


# Where tuples meet, and the grammar around them.
_BETWEEN = "),("
_END = re.compile(r"\)\s*;[ \t]*(?:\r?\n|\Z)")
_INSERT = re.compile(r"(?:\A|(?<=\n))INSERT INTO `(\w+)`(?:\s*\(([^)]*)\))?\s+VALUES\s*\(")
_CREATE = re.compile(r"(?:\A|(?<=\n))CREATE TABLE(?: IF NOT EXISTS)? `(\w+)` \((.*?)\n\)", re.DOTALL)
_LAST_INSERT = r"(?s).*\n(INSERT INTO `\w+`(?:\s*\([^)]*\))?\s+VALUES\s*\()"
_TUPLE = "archivo string, inicio long, parte string, marca string, tabla string, columnas array<string>, texto string"


def _odd_quotes(value: str, first: bool) -> bool:
    """Whether a fragment changes from inside to outside of a text value or back. Whole lines within it,
    comments among them, do not count, nor does a comment that begins the file."""
    if "\\" in value:
        value = re.sub(r"(?s)\\.", "", value)
    head, line, rest = value.partition("\n")
    if line:
        value = ("" if first and head.startswith("--") else head) + rest.rpartition("\n")[2]
    return value.count("'") % 2 == 1


def _of_head(head: str | None) -> tuple[str, list[str] | None] | None:
    """Table and column list of an INSERT head."""
    found = _INSERT.match(head) if head else None
    return (found[1], re.findall(r"\w+", found[2]) if found[2] else None) if found else None


def _in_record(text: str, head: str | None) -> tuple[list[tuple[str, str, list[str] | None, str]], str | None]:
    """What a record between two ``),(`` holds, given the head it begins under: ``(kind, table, columns, text)`` of
    its tuples (``fila``) and tables (``tabla``), and the head that holds behind it."""
    found: list[tuple[str, str, list[str] | None, str]] = []
    at = 0
    while True:
        end = _END.search(text, at) if "\n" in text or text.rstrip().endswith(";") else None
        if (of := _of_head(head)) is not None:
            found.append(("fila", *of, text[at : end.start() if end else len(text)]))
            if end is None:
                return found, head
            at = end.end()
        following = _INSERT.search(text, at)
        for made in _CREATE.finditer(text, at, following.start() if following else len(text)):
            found.append(("tabla", made[1], re.findall(r"(?m)^\s+`(\w+)`\s", made[2]), ""))
        if following is None:
            return found, None
        head, at = following[0], following.end()


def read_tuples(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``(tipo, tabla, columnas, texto)``: a ``fila`` per value tuple of the INSERT statements, without its
    parentheses (tuples that are not parted by ``),(`` come together), and a ``tabla`` per CREATE TABLE, with
    its columns. A statement may be larger than a task."""
    pieces = fragments(spark, path, _BETWEEN, encoding)
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    ends = F.concat(F.substring_index(bare, "\n", 1), F.substring_index(bare, "\n", -1))
    bare = F.when(bare.contains("\n"), ends).otherwise(bare)
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit("'"), F.lit("")))
    last = F.regexp_extract(F.when(F.col("value").contains("\nINSERT INTO"), F.col("value")), _LAST_INSERT, 1)
    # What begins a file has no line end before it: an INSERT head, which holds while there is no other,
    # or a comment, whose quotes do not count.
    begin = pieces.where("inicio = 0").select("archivo", F.substring("value", 1, 4_000).alias("value"), F.monotonically_increasing_id().alias("place"))
    first = {r.archivo: r.value for r in begin.groupBy("archivo").agg(F.min_by("value", "place").alias("value")).collect()}
    noted = frozenset(f for f, v in first.items() if v.startswith("--") and _odd_quotes(v, False) != _odd_quotes(v, True))
    known = starts(pieces, quotes, F.when(last != "", last), noted)
    heads = {f: found[0] for f, v in first.items() if (found := _INSERT.match(v))}
    known = {k: Start(s.inside, s.mark if s.mark is not None or k[1] == 0 else heads.get(k[0])) for k, s in known.items()}

    def tuples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, head = [], None, None
        for file, start, part, text in records(batches, known, _odd_quotes, _BETWEEN):
            if (file, start) != now:
                now, head = (file, start), known[file, start].mark
            if part is None:
                found, head = _in_record(text, head)
                out += [(file, start, None, *row) for row in found]
            else:
                # Parts are read once they are whole; what follows an end stands under the last head in it.
                out.append((file, start, part, head, None, None, text))
                heads = [m[0] for m in _INSERT.finditer(text) if m.start()]
                head = heads[-1] if part == "cabeza" and heads else head
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=_TUPLE_COLUMNS)
                out = []
        yield pd.DataFrame(out, columns=_TUPLE_COLUMNS)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for text, head in zip(batch["texto"], batch["marca"]) for row in _in_record(text, head)[0]]
            yield pd.DataFrame(out, columns=["tipo", "tabla", "columnas", "texto"])

    made = pieces.mapInPandas(tuples, _TUPLE)
    parts = joined(made.where("parte IS NOT NULL"), _BETWEEN, "marca")
    return (
        made.where("parte IS NULL")
        .select(F.col("marca").alias("tipo"), "tabla", "columnas", "texto")
        .unionByName(parts.mapInPandas(whole, "tipo string, tabla string, columnas array<string>, texto string"))
    )


_TUPLE_COLUMNS = [c.split()[0] for c in _TUPLE.split(", ")]


def tuple_columns(tuples: DataFrame, table: str) -> list[str] | None:
    """Column names of the table's CREATE TABLE in ``read_tuples``, or None where the dump has none."""
    found = tuples.where((F.col("tipo") == "tabla") & (F.col("tabla") == table)).select("columnas").first()
    return list(found["columnas"]) if found else None


def parsed_tuples(tuples: DataFrame, table: str) -> DataFrame:
    """``parsed_rows`` of a dump read tuple by tuple."""
    own = tuples.where((F.col("tipo") == "fila") & (F.col("tabla") == table))
    each = F.regexp_extract_all(F.concat(F.lit("("), "texto", F.lit(")")), F.lit(_ROW), F.lit(1))
    rows = own.select("columnas", F.explode(each).alias("row"))
    fields = F.regexp_extract_all(F.col("row"), F.lit(_FIELD), F.lit(1))
    return rows.select("columnas", F.transform(fields, _value).alias("fields"))


def load_tuples(
    tuples: DataFrame, table: str, schema: StructType | str, columns: list[str] | None = None
) -> DataFrame:
    """``load_rows`` of a dump read tuple by tuple."""
    return _typed_rows(parsed_tuples(tuples, table), schema, columns)


def parsed_rows(routed: DataFrame, table: str) -> DataFrame:
    """One row per value tuple of the table's INSERT statements: ``fields``, still text, and
    ``columnas``, the statement's own column list (NULL where it has none)."""
    listed = F.regexp_extract("statement", _LISTED, 1)
    names = F.when(listed != "", F.regexp_extract_all(listed, F.lit(r"\w+"), F.lit(0)))
    values = F.regexp_extract("statement", _VALUES, 1)
    tuples = _inserts(routed, table).select(
        names.alias("columnas"), F.explode(F.regexp_extract_all(values, F.lit(_ROW), F.lit(1))).alias("row")
    )
    fields = F.regexp_extract_all(F.col("row"), F.lit(_FIELD), F.lit(1))
    return tuples.select("columnas", F.transform(fields, _value).alias("fields"))


def table_columns(routed: DataFrame, table: str) -> list[str] | None:
    """Column names of the table's CREATE TABLE, or None where the dump has none."""
    found = declared_columns(routed).where(F.col("tabla") == table).select("columnas").first()
    return list(found["columnas"]) if found else None


def load_rows(
    routed: DataFrame, table: str, schema: StructType | str, columns: list[str] | None = None
) -> DataFrame:
    """Typed rows of one table, values matched to ``schema`` by column name. A statement without a
    column list follows ``columns`` (see ``table_columns``), or else the schema. Columns a statement
    does not list are NULL. Rows whose number of values is not that of their columns are left out
    (see ``rejected_rows``); a value that does not parse as its type becomes NULL."""
    return _typed_rows(parsed_rows(routed, table), schema, columns)


def _typed_rows(parsed: DataFrame, schema: StructType | str, columns: list[str] | None) -> DataFrame:
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    names = F.coalesce("columnas", F.array(*[F.lit(c) for c in columns or [f.name for f in schema]]))
    rows = parsed.withColumn("columnas", names).where(F.size("fields") == F.size("columnas"))
    by_name = rows.select(F.map_from_arrays("columnas", "fields").alias("m"))
    return by_name.select(*[_typed(F.try_element_at("m", F.lit(f.name)), f).alias(f.name) for f in schema])


def _typed(value: Column, field) -> Column:
    kind = field.dataType.simpleString()
    if kind == "string":
        return value
    if kind == "boolean":
        return value.try_cast("int").cast("boolean")
    return value.try_cast(field.dataType)


def rejected_rows(routed: DataFrame, table: str, n_columns: int) -> DataFrame:
    """One row: how many tuples were read and how many had the wrong number of fields."""
    expected = F.coalesce(F.size("columnas"), F.lit(n_columns))
    return parsed_rows(routed, table).agg(
        F.count(F.lit(1)).alias("leidas"), F.count_if(F.size("fields") != expected).alias("descartadas")
    )


def merged_statements(routed: DataFrame) -> DataFrame:
    """One row: how many records hold more than one statement, which happens when the line end given
    to the reader is not the dump's. They must not be loaded."""
    outside = F.regexp_replace("statement", _TEXT, "''")
    return routed.agg(F.count_if(outside.rlike(_SECOND)).alias("varias"))
