"""From raw rows to validated molecule records, with the bad ones set aside."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F, types as T

from foldgraph.errors import RecordError
from foldgraph.functions import text
from foldgraph.functions.pairing import unmatched_brackets
from foldgraph.session import bound_batches, materialize, number_rows
from foldgraph.spec import MAX_LENGTH

# Room for the windows of one row inside a record ordinal. A molecule has
# under 2**24 different windows and a repeated one is an error.
WINDOW_BITS = 24
# Copies of the repeated-id table, so that one id holding a large part of all
# records is met in many tasks instead of one.

RECORD_COLUMNS = [
    "graph_id", "molecule_id", "sequence", "structure", "start", "end", "length", "core_length", "record_ord",
]
REJECT_COLUMNS = ["source", "line", "molecule_id", "rule", "message", "raw", "record_ord"]


@dataclass(frozen=True)
class Columns:
    """Names of the input columns; ``start`` and ``end`` may both be None."""

    identifier: str = "transcript_id"
    sequence: str = "sequence"
    structure: str = "secondary_structure"
    start: str | None = "start"
    end: str | None = "end"

    def __post_init__(self):
        if (self.start is None) != (self.end is None):
            raise RecordError("name both window columns or neither")
        named = [getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None]
        if "" in named:
            raise RecordError("a column name is empty")
        if len(set(named)) < len(named):
            raise RecordError("two inputs share one column name")

    def without_windows(self) -> Columns:
        return Columns(self.identifier, self.sequence, self.structure, None, None)

    def resolve(self, present: list[str]) -> Columns:
        """Check against a header; window columns are used only if both are there."""
        if len(set(present)) < len(present):
            raise RecordError("a column name occurs twice in the header")
        missing = [c for c in (self.identifier, self.sequence, self.structure) if c not in present]
        if missing:
            raise RecordError("missing columns: " + ", ".join(missing))
        if self.start is None:
            return self
        absent = [c for c in (self.start, self.end) if c not in present]
        if len(absent) == 1:
            raise RecordError(f"missing columns: {absent[0]}")
        return self.without_windows() if absent else self


@dataclass(frozen=True)
class Cleaned:
    records: DataFrame
    rejects: DataFrame

    def checked(self) -> DataFrame:
        """The records, or an error naming the first reject in input order."""
        first = self.rejects.orderBy("record_ord").limit(1).collect()
        if first:
            r = first[0]
            where = "" if r.source is None else f"{r.source}" + ("" if r.line is None else f" line {r.line}") + ": "
            raise RecordError(f"{where}{r.message}")
        return self.records


def _fault(rule: str, message) -> Column:
    return F.struct(F.lit(rule).alias("rule"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def standardize(rows: DataFrame, columns: Columns, order: str | None = None) -> DataFrame:
    """Rows of any shape -> identifier, sequence, structure, starts, ends, provenance.

    ``source``, ``line``, ``raw`` and ``extra_fields`` are taken along where a
    reader supplied them. ``order`` names a non-negative unique integer column
    that gives the input order; without it, partition order is numbered.
    """
    columns = columns.resolve(rows.columns) if order is None else columns.resolve([c for c in rows.columns if c != order])
    if order is None:
        rows, order = number_rows(rows, "_row_ord"), "_row_ord"
    types = {f.name: f.dataType for f in rows.schema.fields}

    def cell(name):
        return F.col(f"`{name}`")

    def required(name):
        return cell(name) if isinstance(types[name], T.StringType) else F.lit(None).cast("string")

    def given(name, dtype):
        return (cell(name) if name in types else F.lit(None)).cast(dtype)

    def positions(name, label):
        return text.parse_position_list(F.lit(None) if name is None else cell(name), T.NullType() if name is None else types[name], label)

    return rows.select(
        required(columns.identifier).alias("raw_id"),
        required(columns.sequence).alias("raw_sequence"),
        required(columns.structure).alias("raw_structure"),
        positions(columns.start, "start").alias("starts"),
        positions(columns.end, "end").alias("ends"),
        cell(order).cast("long").alias("row_ord"),
        given("_source", "string").alias("source"),
        given("_line", "long").alias("line"),
        given("_raw", "string").alias("raw"),
        F.coalesce(given("_extra_fields", "boolean"), F.lit(False)).alias("extra_fields"),
    )


def normalize_records(rows: DataFrame) -> DataFrame:
    """Trim, upper-case, T to U; the identifier is trimmed later, after its suffix."""
    return rows.withColumn("sequence", text.normalize_sequence(F.col("raw_sequence"))).withColumn(
        "structure", text.strip(F.col("raw_structure"))
    )


def judge_rows(rows: DataFrame, maximum: int = MAX_LENGTH) -> DataFrame:
    """Add ``fault``: the first broken rule of a row, in the fixed order."""
    starts, ends = F.col("starts"), F.col("ends")
    n_starts, n_ends = F.size(starts["values"]), F.size(ends["values"])
    parity = F.concat(
        F.lit("start has "), n_starts.cast("string"), F.lit(" entries and end has "), n_ends.cast("string")
    )
    scanned = normalize_records(bound_batches(rows)).withColumn("brackets", unmatched_brackets("structure"))
    missing = F.col("raw_id").isNull() | F.col("raw_sequence").isNull() | F.col("raw_structure").isNull()
    return scanned.withColumn(
        "fault",
        F.when(F.col("extra_fields"), _fault("extra_fields", "more fields than the header"))
        .when(missing, _fault("required_text", "identifier, sequence and structure must be text"))
        .when(starts["error"].isNotNull(), _fault("start_list", starts["error"]))
        .when(ends["error"].isNotNull(), _fault("end_list", ends["error"]))
        .when(n_starts != n_ends, _fault("window_lists", parity))
        .otherwise(text.molecule_fault(F.col("sequence"), F.col("structure"), F.col("brackets"), maximum)),
    ).drop("brackets")


def _ordinal() -> Column:
    """row_ord, refused where it leaves no room for the window's number."""
    fits = F.col("row_ord").between(0, (1 << (63 - WINDOW_BITS)) - 1)
    refused = F.raise_error(F.concat(F.lit("row order out of range: "), F.col("row_ord").cast("string"))).cast("long")
    return F.when(fits, F.col("row_ord")).otherwise(refused)


def expand_windows(rows: DataFrame, suffix_identifier: bool = True) -> DataFrame:
    """One row per listed window; a row listing none stays one full record."""
    windows = F.arrays_zip(F.col("starts.values").alias("start"), F.col("ends.values").alias("end"))
    exploded = rows.select(
        "*", F.size("starts.values").alias("n_windows"), F.posexplode_outer(windows).alias("window_ord", "window")
    ).select("*", F.col("window.start").alias("start"), F.col("window.end").alias("end"))
    renamed = F.col("start").isNotNull() & F.lit(suffix_identifier)
    suffixed = F.when(renamed, text.window_identifier(F.col("raw_id"), F.col("start"), F.col("end"))).otherwise(F.col("raw_id"))
    return (
        exploded.withColumn("molecule_id", text.strip(F.col("raw_id")))
        .withColumn("graph_id", text.strip(suffixed))
        .withColumn("length", F.length("sequence"))
        .withColumn("core_length", F.coalesce(F.col("end") - F.col("start"), F.col("length")).cast("int"))
        .withColumn("record_ord", F.shiftleft(_ordinal(), WINDOW_BITS) + F.coalesce(F.col("window_ord"), F.lit(0)))
    )


def judge_records(records: DataFrame) -> DataFrame:
    """Identifier and window rules, where the row itself passed."""
    return records.withColumn(
        "fault",
        F.coalesce(
            F.col("fault"),
            text.identifier_fault(F.col("graph_id")),
            text.window_fault(F.col("start"), F.col("end"), F.col("length")),
        ),
    )


def repeated_ids(records: DataFrame, key: str = "graph_id") -> DataFrame:
    """Identifiers held by several records, with the ordinal of the first.

    A grouped minimum and count, so copies of one identifier are combined
    before the shuffle however many there are.
    """
    return (
        records.groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"), F.min("record_ord").alias("first_ord"))
        .where("copies > 1")
    )


def flag_repeats(records: DataFrame) -> DataFrame:
    """Fault the records that share their id with an earlier one.

    The judged records are written to shared scratch, so nothing upstream runs
    twice. Without a repeat they are not joined at all; else the repeated ids
    are written too, and adaptive execution may split an id however common.
    """
    # The texts as they came are kept in no record; ``raw`` has the whole line.
    judged = materialize(records.drop("raw_sequence", "raw_structure"))
    repeats = materialize(repeated_ids(judged.where("fault is null").select("graph_id", "record_ord")).select("graph_id", "first_ord"))
    if repeats.isEmpty():
        return judged
    joined = judged.join(repeats, "graph_id", "left")
    later = F.col("fault").isNull() & (F.col("record_ord") > F.col("first_ord"))
    repeat = _fault("duplicate_identifier", F.concat(F.lit("identifier seen before: "), F.col("graph_id")))
    return joined.withColumn("fault", F.when(later, repeat).otherwise(F.col("fault"))).drop("first_ord").select(*judged.columns)


def judged_records(
    rows: DataFrame,
    columns: Columns = Columns(),
    *,
    order: str | None = None,
    suffix_identifier: bool = True,
    maximum: int = MAX_LENGTH,
    unique: bool = True,
) -> DataFrame:
    """Every record of every row with its verdict in ``fault``."""
    rows = judge_rows(standardize(rows, columns, order), maximum)
    if not suffix_identifier:
        several = _fault("single_window", "a record that keeps its identifier takes one window")
        rows = rows.withColumn("fault", F.when(F.col("fault").isNull() & (F.size("starts.values") > 1), several).otherwise(F.col("fault")))
    faulty = F.col("fault").isNotNull()
    empty = F.struct(F.array().cast("array<long>").alias("values"), F.lit(None).cast("string").alias("error"))
    rows = rows.withColumn("starts", F.when(faulty, empty).otherwise(F.col("starts")))
    rows = rows.withColumn("ends", F.when(faulty, empty).otherwise(F.col("ends")))
    records = judge_records(expand_windows(rows, suffix_identifier))
    return flag_repeats(records) if unique else records


def split_judged(judged: DataFrame) -> Cleaned:
    records = judged.where("fault is null").select(
        *[F.col(c).cast("int") if c in ("start", "end", "length") else F.col(c) for c in RECORD_COLUMNS]
    )
    rejects = judged.where("fault is not null").select("source", "line", "molecule_id", "fault.rule", "fault.message", "raw", "record_ord")
    return Cleaned(records, rejects)


def records_from_df(rows: DataFrame, columns: Columns = Columns(), **options) -> Cleaned:
    """The input contract applied to rows that are already a DataFrame."""
    return split_judged(judged_records(rows, columns, **options))


def record_measures(records: DataFrame) -> DataFrame:
    return records.select(
        "graph_id", "length", F.col("start").isNotNull().alias("sliced"), "core_length"
    )


def require_non_empty(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise RecordError(f"the {what} holds no records")
    return df
