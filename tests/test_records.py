import pytest
from pyspark.sql import functions as F

from foldgraph.errors import RecordError
from foldgraph.operators.records import Columns, records_from_df
from tests.conftest import ROWS, STEM


def judge(spark, rows, columns=Columns(), **options):
    padded = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
    cleaned = records_from_df(spark.createDataFrame(padded, ROWS).coalesce(1), columns, **options)
    return cleaned.records.orderBy("record_ord").collect(), cleaned.rejects.orderBy("record_ord").collect()


def test_text_is_normalised(spark):
    good, bad = judge(spark, [(" id ", " acgt\n", "\x1f(()) ")])
    assert not bad
    assert (good[0].graph_id, good[0].sequence, good[0].structure) == ("id", "ACGU", "(())")


def test_first_broken_rule_wins(spark):
    rows = [
        ("a", "  ", "."), ("b", "A" * 4097, "."), ("c", "ACGN", "..."), ("d", "ANCX", "[].."), ("e", "ACGU", "[..]"),
        ("f", "ACGU", "())("), ("g", "ACGU", "((.)"), ("  ", "ACGU", "...."), ("i\tj", "ACGU", "...."), (None, "ACGU", "...."),
        ("k", "ACGU", "....", "1,", "2"), ("l", "ACGU", "....", "1", "2.5"), ("m", "ACGU", "....", "1,2", "3"), ("n", "ANGU", "....", "x", "3"),
    ]
    good, bad = judge(spark, rows)
    assert not good
    assert [r.rule for r in bad] == [
        "empty_sequence", "too_long", "length_mismatch", "sequence_alphabet", "structure_alphabet", "unmatched_close",
        "unmatched_open", "empty_identifier", "identifier_break", "required_text", "start_list", "end_list", "window_lists", "start_list",
    ]
    assert bad[3].message.endswith("N X") and bad[5].message.endswith("position 2") and bad[6].message.endswith("position 0")


@pytest.mark.parametrize("start,end", [("-1", "2"), ("2", "2"), ("3", "2"), ("0", "5"), ("9" * 30, "9" * 31)])
def test_windows_stay_inside(spark, start, end):
    _, bad = judge(spark, [("a", "ACGU", "....", start, end)])
    assert [r.rule for r in bad] == ["window_bounds"]


def test_window_lists_expand_and_rename(spark):
    good, _ = judge(spark, [("m", *STEM, "6,+9", "1_2, 16"), ("n", *STEM, "", " "), ("", *STEM, "0", "4"), ("x ", *STEM, "0", "4")])
    assert [r.graph_id for r in good] == ["m:6-12", "m:9-16", "n", ":0-4", "x :0-4"]
    assert [(r.start, r.end, r.core_length) for r in good[:3]] == [(6, 12, 6), (9, 16, 7), (None, None, 16)]


def test_a_single_window_keeps_its_name_without_suffix(spark):
    good, bad = judge(spark, [("m", *STEM, "6", "12"), ("n", *STEM, "1,2", "3,4")], suffix_identifier=False)
    assert [r.graph_id for r in good] == ["m"]
    assert [(r.molecule_id, r.rule) for r in bad] == [("n", "single_window")]


def test_an_ordinal_without_room_is_refused(spark):
    rows = spark.createDataFrame([(1 << 39, "a", "ACGU", "....")], "at long, transcript_id string, sequence string, secondary_structure string")
    with pytest.raises(Exception, match="row order out of range"):
        records_from_df(rows, order="at").records.collect()


def test_repeats_are_judged_after_expansion(spark):
    good, bad = judge(spark, [("m", *STEM, "6,6", "9,9"), ("a", *STEM), ("a", "ACGU", "...."), ("a", "N", "."), ("m:6-9", *STEM)])
    assert [r.graph_id for r in good] == ["m:6-9", "a"]
    assert [r.rule for r in bad] == ["duplicate_identifier", "duplicate_identifier", "sequence_alphabet", "duplicate_identifier"]


def test_one_identifier_on_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(
        F.expr("case when id % 3 = 0 then 'hot' else 'id-' || id end").alias("transcript_id"),
        F.lit("ACGU").alias("sequence"), F.lit("....").alias("secondary_structure"), "id",
    )
    cleaned = records_from_df(rows, order="id")
    assert cleaned.records.count() == 2001 and cleaned.rejects.count() == 999
    assert cleaned.records.where("graph_id = 'hot'").first().record_ord == 0


def test_typed_window_columns(spark):
    base = "transcript_id string, sequence string, secondary_structure string, start {}, `end` {}"
    for kind, start, end in (("int", 2, 4), ("double", 2.0, 4.0)):
        df = spark.createDataFrame([("a", "ACGU", "....", start, end)], base.format(kind, kind))
        assert records_from_df(df).checked().first().graph_id == "a:2-4"
    for kind, start, end in (("boolean", True, True), ("double", 1.5, 3.0)):
        df = spark.createDataFrame([("a", "ACGU", "....", start, end)], base.format(kind, kind))
        assert records_from_df(df).rejects.first().rule == "start_list"


def test_column_names_are_checked(spark):
    with pytest.raises(RecordError):
        Columns(start="start", end=None)
    with pytest.raises(RecordError):
        Columns(sequence="x", structure="x")
    for present in (["transcript_id", "sequence"], ["transcript_id", "sequence", "secondary_structure", "start"], ["a", "a"]):
        with pytest.raises(RecordError):
            Columns().resolve(present)
    df = spark.createDataFrame([("ACGU", "a", "....")], "Bases string, name string, fold string")
    assert records_from_df(df, Columns("name", "Bases", "fold")).checked().count() == 1


def test_letters_of_texts_as_pieces_of_bases(spark):
    from foldgraph.functions.text import base_pieces

    texts = [(0, None), (1, ""), (2, "é1 \n"), (3, "aBcD-eZ"), (4, "xé" * 9), (5, "Ab c")]
    rows = spark.createDataFrame(texts, "i int, t string").coalesce(1)
    got = {r.i: r.p for r in rows.select("i", base_pieces("t", 4).alias("p")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["ACGU", "AC"], 4: ["UUUU", "UUUU", "U"], 5: ["ACG"]}


def test_scratch_of_judged_records_holds_each_text_once(spark):
    from foldgraph.operators.records import judged_records

    rows = spark.createDataFrame([(0, " m ", " acgt ", "(())"), (1, "n", "ACGN", "....")], "o long, transcript_id string, sequence string, secondary_structure string")
    judged = judged_records(rows, order="o")
    assert not {"raw_sequence", "raw_structure"} & set(judged.columns)
    assert sorted((r.molecule_id, r.sequence, r.fault and r.fault.rule) for r in judged.collect()) == [("m", "ACGU", None), ("n", "ACGN", "sequence_alphabet")]
