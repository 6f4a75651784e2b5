import csv
import io
import random

import pytest

from foldgraph.errors import RecordError
from foldgraph.operators.records import Columns
from foldgraph.sources.tables import read_records, scan_table

HEAD = "transcript_id\tsequence\tsecondary_structure"


def put(tmp_path, text, name="t.tsv"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def test_rows_keep_order_and_lines(spark, tmp_path):
    path = put(
        tmp_path,
        f"{HEAD}\tstart\tend\r\nrna-1\tACGUACGU\t((....))\t2,4\t6, 8\r\n\r\nshort\tACGU\t....\r\n"
        "long\tACGU\t....\t\t\tmore\r\nbad\tACGN\t....\t\t\r\n\t\t\t\t\r\nrna-1\tACGUACGU\t........\t2\t6\r\n",
    )
    got = read_records(spark, path)
    assert [r.graph_id for r in got.records.orderBy("record_ord").collect()] == ["rna-1:2-6", "rna-1:4-8", "short"]
    rejects = got.rejects.orderBy("record_ord").collect()
    assert [(r.line, r.rule) for r in rejects] == [
        (5, "extra_fields"), (6, "sequence_alphabet"), (7, "empty_sequence"), (8, "duplicate_identifier"),
    ]
    assert rejects[0].source.endswith("t.tsv")


def test_a_table_split_over_many_tasks_numbers_the_same(spark, tmp_path):
    lines = [f"id-{i}\tACGU\t...." if i % 100 else f"id-{i}\tACGN\t...." for i in range(5000)]
    path = put(tmp_path, "\n".join([HEAD, *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = read_records(spark, path)
        order = [r.graph_id for r in got.records.orderBy("record_ord").collect()]
        bad = [r.line for r in got.rejects.orderBy("record_ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert order == [f"id-{i}" for i in range(5000) if i % 100]
    assert bad == [i + 2 for i in range(0, 5000, 100)]


def test_splits_that_change_lose_nothing(spark, tmp_path):
    lines = [f"id-{i}\tACGU\t...." for i in range(20000)]
    path = put(tmp_path, "\n".join([HEAD, *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for planned, executed in (("64k", "40k"), ("40k", "64k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", planned)
            records = read_records(spark, path).records.select("graph_id", "record_ord")
            spark.conf.set("spark.sql.files.maxPartitionBytes", executed)
            got = records.orderBy("record_ord").collect()
            assert [r.graph_id for r in got] == [f"id-{i}" for i in range(20000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quotes_inside_fields_are_data(spark, tmp_path):
    path = put(tmp_path, f'{HEAD}\tnote\na"1\tACGU\t....\t5" cap\nb\tACGU\t....\t"x\ty"\nc\tACGU\t....\tone "odd\n')
    got = read_records(spark, path)
    assert [r.graph_id for r in got.records.orderBy("record_ord").collect()] == ['a"1', "b", "c"]
    assert got.rejects.isEmpty()


def test_bytes_that_are_not_text_are_refused(spark, tmp_path):
    (tmp_path / "bad.tsv").write_bytes(HEAD.encode() + b"\nx\xff\tACGU\t....\n")
    with pytest.raises(RecordError, match="UTF-8"):
        read_records(spark, str(tmp_path / "bad.tsv"))


def test_remapped_columns_and_quotes(spark, tmp_path):
    columns = Columns("rna_name", "bases", "dot_bracket")
    plain = 'dot_bracket,source,rna_name,bases\n(()),"a, ""b""",first,ACGU\n....,x,second,GGAA\n'
    broken = 'dot_bracket,source,rna_name,bases\n(()),"a\nb",first,ACGU\n....,x,second,GGAA\n....,x\n....,x,t,GGAA,more\n'
    for name, text, rules in (("a.csv", plain, []), ("b.csv", broken, ["extra_fields", "required_text"])):
        got = read_records(spark, put(tmp_path, text, name), columns, delimiter=",")
        assert [r.graph_id for r in got.records.orderBy("record_ord").collect()] == ["first", "second"]
        assert sorted(r.rule for r in got.rejects.collect()) == rules


def test_window_columns_can_be_ignored(spark, tmp_path):
    path = put(tmp_path, f"{HEAD}\tstart\tend\nstem\tACGU\t....\t9\t16\n")
    assert read_records(spark, path, use_windows=False).checked().first().length == 4


@pytest.mark.parametrize(
    "text,match",
    [
        ("", "empty"), (f"{HEAD}\tsequence\n", "twice"), ("transcript_id\tsequence\n", "secondary_structure"),
        (f"{HEAD}\tstart\n", "end"), (f"{HEAD}\n", "no records"), (f"{HEAD}\nbad\tACGN\t....\n", "line 2"),
    ],
)
def test_bad_tables(spark, tmp_path, text, match):
    with pytest.raises(RecordError, match=match):
        read_records(spark, put(tmp_path, text), on_error="fail")


def test_files_must_agree_on_the_header(spark, tmp_path):
    put(tmp_path, f"{HEAD}\na\tACGU\t....\n", "a.tsv")
    put(tmp_path, f"{HEAD}\textra\nb\tACGU\t....\t\n", "b.tsv")
    with pytest.raises(RecordError, match="headers"):
        read_records(spark, str(tmp_path))
    with pytest.raises(RecordError, match="single"):
        read_records(spark, str(tmp_path), delimiter="::")


def test_files_follow_each_other_by_path(spark, tmp_path):
    for quoted in ("x", '"x\ny"'):
        folder = tmp_path / ("plain" if quoted == "x" else "broken")
        folder.mkdir()
        for name, rows in (("b", 1), ("a", 40), ("c", 7)):
            lines = [f"{name}{i}\tACGU\t....\t{quoted}" for i in range(rows)]
            put(folder, "\n".join([HEAD + "\tnote", *lines]) + "\n", f"{name}.tsv")
        got = [r.graph_id for r in read_records(spark, str(folder)).records.orderBy("record_ord").collect()]
        assert got == [f"a{i}" for i in range(40)] + ["b0"] + [f"c{i}" for i in range(7)]


def quoted_table(seed, rows):
    """A table in which fields hold delimiters, quotes and line breaks, and some rows are short, long or blank."""
    rng = random.Random(seed)

    def field():
        text = "".join(rng.choice(["a", "b", '"', "\n", "\n\n", ",", " ", "xyz" * 9]) for _ in range(rng.randrange(5)))
        if any(c in text for c in ',\n"') or rng.random() < 0.1:
            return '"' + text.replace('"', '""') + '"'
        return text if rng.random() < 0.8 else text + 'q"'

    lines = [",".join(["h0", '"h\n1"', "h2"])]
    for _ in range(rows):
        lines.append(",".join(field() for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))) if rng.random() < 0.95 else "")
    return "\n".join(lines) + "\n"


def scanned(spark, path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        header, rows = scan_table(spark, path, ",")
        return header, [tuple(r) for r in rows.orderBy("_row_ord").select(*[f"`{c}`" for c in header], "_line", "_raw", "_extra_fields").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("seed", range(2))
def test_quoted_breaks_read_alike_at_any_split(spark, tmp_path, seed):
    text = quoted_table(seed, 150)
    path = put(tmp_path, text)
    reader = csv.reader(io.StringIO(text, newline=""))
    head = next(reader)
    want = [(tuple([*row, None, None, None][:3]), reader.line_num, len(row) > 3) for row in reader if row]
    one = scanned(spark, path, "64m")
    assert one[0] == head == ["h0", "h\n1", "h2"]
    assert [(r[:3], r[3], r[5]) for r in one[1]] == want
    assert all(raw in text for raw in (r[4] for r in one[1]))
    for split in ("1500", "173"):
        assert scanned(spark, path, split) == one


def test_large_table_with_breaks_in_small_splits(spark, tmp_path):
    lines = [f'id-{i}\tACGU\t....\t"{"x" * (i % 97)}\n{"y" * (i % 89)}"' if i % 3 else f"id-{i}\tACGN\t....\tplain" for i in range(3000)]
    put(tmp_path, "\n".join([HEAD + "\tnote", *lines]) + "\n")
    put(tmp_path, f"{HEAD}\tnote\nlast\tACGU\t....\tx\nworse\tACGN\t....\tx\n", "u.tsv")
    got = []
    for split in ("64k", "64m"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            found = read_records(spark, str(tmp_path))
            got.append(([r.graph_id for r in found.records.orderBy("record_ord").collect()], [(r.line, r.raw) for r in found.rejects.orderBy("record_ord").collect()]))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1]
    assert got[0][0] == [f"id-{i}" for i in range(3000) if i % 3] + ["last"]
    assert got[0][1] == [(2 + 5 * k, lines[3 * k]) for k in range(1000)] + [(3, "worse\tACGN\t....\tx")]


def test_a_quote_that_never_closes_is_an_error(spark, tmp_path):
    path = put(tmp_path, HEAD + '\nok\tACGU\t....\nbad\t"ACGU\t....\n' + "x\tACGU\t....\n" * 10_001)
    with pytest.raises(RecordError, match="line 3: a quoted field"):
        read_records(spark, path)
