"""Loading delimited records of many layouts, with every bad record set apart and explained.

Two passes over one scan, all in the JVM:

1. *Permissive read.* Each record is parsed by ``from_csv`` in ``PERMISSIVE`` mode under the explicit,
   typed schema of its file's header; what does not fit keeps its raw text in a corrupt-record column.
2. *Reclassification.* Only records the reader marked corrupt, or whose text holds characters on which
   the reader is more lenient than the contract (quotes, line breaks, control and non-ASCII
   characters), are examined again: quoting, then number of cells, then casts. That gives the reason, and
   also takes back records the reader was too strict with, such as ``1_000`` or `` 12 ``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.runtime import cut

CORRUPT = "__corrupt"
#: Above this number of marks a record isn't handed to the reader, whose column buffer is fixed; the second pass takes it.
READER_COLUMNS = 20_000
#: Layouts that get a reader of their own.
MOST_LAYOUTS = 256


@dataclass(frozen=True)
class IntCell:
    """A column of 64-bit integers."""

    nullable: bool = True
    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class TextCell:
    """A column of free text; an empty cell is NULL."""


Cell = IntCell | TextCell


def int_cell(text: Column) -> Column:
    """The integer a cell stands for, or NULL: ASCII digits, spaces around, a sign, leading zeros, single ``_`` between digits."""
    bare = F.trim(text)
    shaped = bare.rlike(r"\A[+-]?[0-9][0-9_]*\z") & ~F.contains(bare, F.lit("__")) & ~F.endswith(bare, F.lit("_"))
    digits = F.regexp_replace(F.replace(bare, F.lit("_"), F.lit("")), r"\A([+-]?)0+(?=[0-9])", "$1")
    return F.when(shaped & (F.length(digits) <= 20), digits.try_cast("bigint"))


def split_quoted(line: Column, mark: Column) -> tuple[Column, Column]:
    """(is the quoting sound, cells) of a record; cells are only meaningful where the quoting is sound.

    Cutting at ``"`` makes pieces that lie outside and inside quotes by turns. Sound quoting means an odd
    number of pieces, of which each outer one touches a quote only with a mark, or is the nothing between
    two doubled quotes. For the cells, the text is carried as hex, so that no separator can clash with it.
    """
    pieces = F.split(line, F.lit('"'), -1)
    last = F.size(pieces) - 1
    hexed = lambda s: F.hex(F.encode(s, "UTF-8"))
    literal = F.concat(F.lit(r"\Q"), mark, F.lit(r"\E"))

    def sound(piece: Column, i: Column) -> Column:
        left = (i == 0) | (piece == "") | F.startswith(piece, mark)
        right = (i == last) | (piece == "") | F.endswith(piece, mark)
        return ((i % 2) == 1) | (left & right)

    def coded(piece: Column, i: Column) -> Column:
        outer = F.array_join(F.transform(F.split(piece, literal, -1), hexed), "|")
        doubled = (piece == "") & (i > 0) & (i < last)
        return F.when((i % 2) == 1, hexed(piece)).when(doubled, F.lit("22")).otherwise(outer)

    is_sound = ((last % 2) == 0) & F.forall(F.transform(pieces, lambda p, i: sound(p, i)), lambda ok: ok)
    cells = F.transform(F.split(F.array_join(F.transform(pieces, coded), ""), r"\|", -1), lambda h: F.decode(F.unhex(h), "UTF-8"))
    return is_sound, cells


def _header_cells(header: Column, mark: Column) -> Column:
    """Names in a header, without spaces and quotes around them."""
    cells = F.split(F.regexp_replace(header, r"\r+\z", ""), F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")), -1)
    return F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(c, r"\A\s+|\s+\z", ""), r'\A"+|"+\z', ""))


def read_records(
    records: DataFrame,
    files: DataFrame,
    columns: dict[str, Cell],
    *,
    record_id: str = "record_id",
    file_id: str = "file_id",
    raw_line: str = "raw_line",
    header_line: str = "header_line",
    cell_mark: str = "cell_mark",
    target: str = "target_name",
) -> DataFrame:
    """Parse every record under the header of its file.

    Returns one row per record that isn't blank: ``record_id, file_id, target, reason, bad_column,
    raw_line`` and one typed column per entry of ``columns``, named ``v_<column>``. ``reason`` is NULL for
    a valid record, else the first that holds of ``no_file`` (its file or header is not known),
    ``quoting``, ``column_count``, ``bad_value`` (``bad_column`` names the first such column of
    ``columns``). Typed columns of a bad record are NULL; ``raw_line`` keeps the text as received, and is NULL
    for valid records.

    Defined cases: a NULL or blank record (spaces only, after one trailing carriage return) is skipped;
    an empty table gives an empty result; repeated rows are parsed each by itself; a header column
    that is not in ``columns`` is read as text and dropped; a header that names a column twice yields its first
    cell; extra columns of either table are ignored, whatever their names; a record may be of any length.

    What reaches the driver are the layouts, the distinct pairs of a mark and of the kinds of cells in their order, whatever the names: a few for
    columns of two kinds, however many files and headers there are. Of more than ``MOST_LAYOUTS`` the others are left to the second pass,
    which reads any. The join with ``files`` is left to Spark.
    """
    files = files.select(
        F.col(file_id).alias("f_id"), F.col(target).alias("f_target"), F.col(header_line).alias("f_header"), F.col(cell_mark).alias("f_mark")
    ).where(F.col("f_id").isNotNull() & F.col("f_header").isNotNull() & (F.length("f_mark") == 1))
    # What a header means is worked out once per file, not per record: its width, the place of each column in it, and the kinds of its cells.
    whole = [n for n, kind in columns.items() if isinstance(kind, IntCell)]
    names = F.col("names")
    places = [F.nullif(F.array_position(names, n), F.lit(0)).cast("int") - 1 for n in columns]
    files = files.withColumn("names", _header_cells(F.col("f_header"), F.col("f_mark")))
    files = files.withColumn("head", F.struct(F.size("names").alias("width"), *[at.alias(f"at{i}") for i, at in enumerate(places)]))
    files = files.withColumn("kinds", F.array_join(F.transform(names, lambda n: F.when(n.isin(whole), "i").otherwise("t")), "")).drop("names", "f_header")
    layouts = sorted((r[0], r[1]) for r in files.select("kinds", "f_mark").distinct().limit(MOST_LAYOUTS).collect())
    number = F.lit(None).cast("int")
    for k, (kinds, mark) in reversed(list(enumerate(layouts))):
        number = F.when((F.col("kinds") == kinds) & (F.col("f_mark") == mark), F.lit(k)).otherwise(number)
    files = files.withColumn("layout", number).drop("kinds")

    raw = F.col(raw_line)
    lines = records.select(
        F.col(record_id).alias("r_id"), F.col(file_id).alias("r_file"), raw.alias("r_raw"), F.when(F.endswith(raw, F.lit("\r")), F.left(raw, F.length(raw) - 1)).otherwise(raw).alias("line")
    ).where(F.trim("line") != "")
    joined = lines.join(files, lines.r_file == files.f_id, "left")
    mark, width = F.col("f_mark"), F.col("head.width")

    # Pass 1: the permissive reader, one explicit schema per layout, its cells by kind and place.
    simple = F.length("line") - F.length(F.replace(F.col("line"), mark, F.lit(""))) < READER_COLUMNS
    parsed = F.lit(None).cast(f"struct<i: array<bigint>, t: array<string>, {CORRUPT}: string>")
    for k, (kinds, sep) in enumerate(layouts):
        fields = ", ".join(f"`c{i}` {'BIGINT' if kind == 'i' else 'STRING'}" for i, kind in enumerate(kinds))
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "sep": "\\\\" if sep == "\\" else sep, "quote": '"', "escape": '"', "maxColumns": str(READER_COLUMNS + 480), "maxCharsPerColumn": "-1", "inputBufferSize": "4096"}
        read = F.from_csv(F.col("line"), f"{fields}, `{CORRUPT}` STRING", options)

        def shaped(row: Column) -> Column:
            sides = [F.array(*[row[f"c{i}"] if kind == side else F.lit(None).cast(to) for i, kind in enumerate(kinds)]).alias(side) for side, to in (("i", "bigint"), ("t", "string"))]
            return F.struct(*sides, row[CORRUPT].alias(CORRUPT))

        parsed = F.when((F.col("layout") == k) & simple, F.get(F.transform(F.array(read), shaped), F.lit(0))).otherwise(parsed)
    lenient = F.col("line").rlike(r'["\x00-\x08\x0a-\x1f\x7f]|[^\x00-\x7f]')
    first = joined.withColumn("parsed", parsed).withColumn("again", F.col("parsed").isNull() | F.col(f"parsed.{CORRUPT}").isNotNull() | lenient)

    # Pass 2: what the reader found corrupt, or may have been lenient with.
    again = F.col("again")
    sound, cells = split_quoted(F.col("line"), mark)
    second = first.withColumn("sound", F.when(again & width.isNotNull(), sound)).withColumn("cells", F.when(F.col("sound"), cells))
    second = second.withColumn("fits", F.size("cells") == width)
    second = second.withColumns({f"s{i}": F.when(F.col("fits"), F.nullif(F.get("cells", F.col(f"head.at{i}")), F.lit(""))) for i in range(len(columns))})
    second = second.withColumns({f"v{i}": F.when(again, int_cell(F.col(f"s{i}")) if isinstance(kind, IntCell) else F.col(f"s{i}")).otherwise(F.get(F.col(f"parsed.{'i' if isinstance(kind, IntCell) else 't'}"), F.col(f"head.at{i}"))) for i, kind in enumerate(columns.values())})
    bad = F.lit(None).cast("string")
    for i, (name, kind) in reversed(list(enumerate(columns.items()))):
        if isinstance(kind, IntCell):
            value = F.col(f"v{i}")
            wrong = F.col(f"s{i}").isNotNull() & value.isNull()
            if kind.least is not None:
                wrong = wrong | (value < kind.least)
            if kind.most is not None:
                wrong = wrong | (value > kind.most)
            if not kind.nullable:
                wrong = wrong | (F.col(f"head.at{i}").isNotNull() & value.isNull())
            bad = F.when(wrong, F.lit(name)).otherwise(bad)
    reason = (
        F.when(width.isNull(), F.lit("no_file"))
        .when(again & ~F.col("sound"), F.lit("quoting"))
        .when(again & ~F.col("fits"), F.lit("column_count"))
        .when(F.col("bad").isNotNull(), F.lit("bad_value"))
    )
    out = second.withColumn("bad", bad).withColumn("reason", reason)
    good = F.col("reason").isNull()
    loaded = out.select(
        F.col("r_id").alias(record_id), F.col("r_file").alias(file_id), F.col("f_target").alias("target"), "reason", F.when(F.col("reason") == "bad_value", F.col("bad")).alias("bad_column"), F.when(~good, F.col("r_raw")).alias("raw_line"),
        *[F.when(good, F.col(f"v{i}")).alias(f"v_{n}") for i, n in enumerate(columns)],
    )
    # Written once for all who split it. It also keeps a filter on the reason from being pushed into the parser, which would parse
    # every record again for each of the many places that lead to its reason.
    return cut(loaded)


def valid_rows(parsed: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """The typed valid rows meant for one target table."""
    return parsed.where(F.col("reason").isNull() & (F.col("target") == target)).select("record_id", *[F.col(f"v_{c}").alias(c) for c in columns])


def rejected(parsed: DataFrame) -> DataFrame:
    """The bad records with their reason, the column at fault and the raw text."""
    return parsed.where(F.col("reason").isNotNull()).select("record_id", "file_id", "target", "reason", "bad_column", "raw_line")
