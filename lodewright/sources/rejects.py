"""Loading delimited records with the failed ones set apart (problem 3).

Structural checks (quoting, number of fields) are one projection. Values are cast or validated once per distinct value
and column; the values that fail form a dictionary with reasons, which is joined back to the records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.operators.hotkeys import join_group
from lodewright.session import Scratch

#: Stand-ins while a line is cut; the escape keeps them apart from the same characters in the data.
_CUT, _ESC = "\u0001", "\u0002"

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Entries of a dictionary of invalid values that may be sent to every task (and a hundred times as many characters).
SMALL_DICTIONARY = 50_000
_NOT_ROUND = "".join(chr(c) for c in range(128) if chr(c) not in "()")
STRUCTURE_CHARS = r"^[A-Za-z0-9()\[\]=#@+\-/\\.]*$"


@dataclass(frozen=True)
class RecordKind:
    """What a file's records hold: the field names in order, the structure and the (optional) number among them."""

    name: str
    fields: tuple[str, ...]
    structure: int
    number: int


KINDS = (
    RecordKind("train_val", ("drug_id", "structure", "result"), 1, 2),
    RecordKind("testcase", ("structure", "result"), 0, 1),
)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once: an expression named inside a lambda is computed for every element."""
    return F.transform(F.array(value), body)[0]


def quote_parts(line: Column) -> Column:
    """The pieces of a line between double quotes; those at odd places stand inside quotes."""
    return F.split(line, '"', -1)


def quoting_error(parts: Column) -> Column:
    """Reason why the quoting is broken, or null.

    A piece outside quotes that is not at an end of the line must be empty (a doubled quote) or begin and end with a
    comma; at the ends it must be empty or touch the quote with a comma.
    """

    def reason(xs: Column) -> Column:
        n = F.size(xs)

        def outside_ok(x: Column, i: Column) -> Column:
            first, last = i == 0, i == n - 1
            return (i % 2 == 1) | (first & last) | (x == "") | ((first | x.startswith(",")) & (last | x.endswith(",")))

        sound = F.forall(F.transform(xs, outside_ok), lambda ok: ok)
        return F.when(n % 2 == 0, F.lit("unclosed quote")).when(~sound, F.lit("misplaced quote"))

    return let(parts, reason)


def split_fields(line: Column) -> Column:
    """Fields of a line with sound quoting: unquoted, doubled quotes undone, spaces around the content removed."""
    safe = F.replace(F.replace(line, F.lit(_ESC), F.lit(_ESC + "b")), F.lit(_CUT), F.lit(_ESC + "a"))

    def join(xs: Column) -> Column:
        n = F.size(xs)

        def piece(x: Column, i: Column) -> Column:
            doubled = (x == "") & (i > 0) & (i < n - 1)
            return F.when(i % 2 == 1, x).when(doubled, F.lit('"')).otherwise(F.replace(x, F.lit(","), F.lit(_CUT)))

        return F.array_join(F.transform(xs, piece), "")

    joined = let(quote_parts(safe), join)
    undo = lambda x: F.replace(F.replace(x, F.lit(_ESC + "a"), F.lit(_CUT)), F.lit(_ESC + "b"), F.lit(_ESC))
    return F.transform(F.split(joined, _CUT, -1), lambda x: F.trim(undo(x)))


def number_error(value: Column) -> Column:
    """Reason why a number field is invalid, or null; an empty field is a missing number."""
    return F.when((value != "") & ~value.rlike(NUMBER), F.lit("invalid number"))


def structure_error(value: Column) -> Column:
    """Reason why a structure field is invalid, or null; what stands outside square brackets is cut out once."""

    def reason(outside: Column) -> Column:
        depth = F.aggregate(
            F.split(F.translate(outside, _NOT_ROUND, ""), ""),
            F.lit(0),
            lambda d, c: F.when(d < 0, d).when(c == "(", d + 1).when(c == ")", d - 1).otherwise(d),
        )
        odd_digit = F.lit(False)
        for digit in "0123456789":
            odd_digit = odd_digit | ((F.length(outside) - F.length(F.replace(outside, F.lit(digit), F.lit("")))) % 2 == 1)
        return (
            F.when(value == "", F.lit("empty structure"))
            .when(~value.rlike(STRUCTURE_CHARS), F.lit("invalid character in structure"))
            .when(outside.rlike(r"[\[\]]"), F.lit("unbalanced square bracket"))
            .when(depth != 0, F.lit("unbalanced round bracket"))
            .when(odd_digit, F.lit("unpaired ring digit"))
        )

    return let(F.regexp_replace(value, r"\[[^\[\]()]*\]", ""), reason)


def parse_records(
    df: DataFrame, id_col: str = "raw_id", kind_col: str = "record_kind", line_col: str = "raw_line",
    kinds: tuple[RecordKind, ...] = KINDS,
) -> DataFrame:
    """Every input row with `reason` (null: it loads), `structure` and `result`.

    The output has the input's columns but the line, then `drug_id`, `structure`, `result`, `reason`; input columns of
    those names are replaced. A null line and an unknown record kind are failures with their own reasons. Rows are kept
    one for one, repeated ones included, and an empty input gives an empty output. Very long lines are safe: no pattern
    with nested repetition runs over a line. One carriage return at the end of a line is ignored.

    Lines are cut once and written. Values are checked once per distinct value and column; a dictionary of invalid
    values of at most `SMALL_DICTIONARY` entries goes to every task, a greater one is joined, with frequent values and
    missing ones spread over parts.
    """
    scratch = Scratch(df.sparkSession)
    keep = [c for c in df.columns if c not in (line_col, "drug_id", "structure", "result", "reason")]
    line = F.regexp_replace(F.col(line_col), r"\r\z", "")
    n_fields, at = F.lit(None).cast("int"), {c: F.lit(None).cast("int") for c in ("drug_id", "structure", "number")}
    for k in kinds:
        here = F.col(kind_col) == k.name
        n_fields = F.when(here, F.lit(len(k.fields))).otherwise(n_fields)
        places = {"drug_id": k.fields.index("drug_id") if "drug_id" in k.fields else None, "structure": k.structure, "number": k.number}
        at = {c: F.when(here, F.lit(places[c]).cast("int")).otherwise(e) for c, e in at.items()}
    cut = scratch.save(
        df.select(*keep, line.alias("__line"))
        .withColumn("__quoting", quoting_error(quote_parts(F.col("__line"))))
        .withColumn("__fields", F.when(F.col("__quoting").isNull(), split_fields(F.col("__line"))))
        .withColumn(
            "__reason",
            F.when(F.col("__line").isNull(), F.lit("no line"))
            .when(n_fields.isNull(), F.lit("unknown record kind"))
            .when(F.col("__quoting").isNotNull(), F.col("__quoting"))
            .when(F.size("__fields") != n_fields, F.concat(F.lit("field count "), F.size("__fields").cast("string"))),
        )
        .withColumn("__ok", F.when(F.col("__reason").isNull(), F.col("__fields")))
        .select(*keep, "__reason", *(F.get("__ok", e).alias(f"__{c}") for c, e in at.items()))
    )
    out = cut
    for column, error in (("__structure", structure_error), ("__number", number_error)):
        # Each distinct value of a column is cast or checked once; the invalid ones, with their number of rows, are the dictionary.
        values = cut.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("__n"))
        invalid = scratch.save(values.withColumn(f"{column}_why", error(F.col(column))).where(F.col(f"{column}_why").isNotNull()))
        size, characters = invalid.agg(F.count("*"), F.coalesce(F.sum(F.length(column)), F.lit(0))).first()
        if size <= SMALL_DICTIONARY and characters <= 100 * SMALL_DICTIONARY:
            out = out.join(F.broadcast(invalid.drop("__n")), column, "left")  # measured: within the two bounds
        else:
            out = join_group(out, invalid, [column], id_col, n_col="__n", how="left")
    return (
        out.withColumn("reason", F.coalesce("__reason", F.when(F.col("__structure") == "", F.lit("empty structure")), "__structure_why", "__number_why"))
        .select(
            *keep,
            F.when(F.col("reason").isNull(), F.col("__drug_id")).alias("drug_id"),
            F.when(F.col("reason").isNull(), F.col("__structure")).alias("structure"),
            F.when(F.col("reason").isNull(), F.expr("try_cast(__number as double)")).alias("result"),
            "reason",
        )
    )
