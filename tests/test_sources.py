import gzip

import pytest
from pyspark.sql import types as T

from viewtide.schema import INTERACTIONS
from viewtide.sources import interactions, order, records


@pytest.fixture
def write(tmp_path):
    def write_gz(name, *lines):
        with gzip.open(tmp_path / name, "wt", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
        return str(tmp_path / name)

    return write_gz


def rows(df):
    return [tuple(r) for r in df.orderBy("row_id").collect()]


EXAMPLE = "1,34347669376,grimnax,5415,5419"


def test_example_row_without_header(spark, write):
    path = write("a.csv.gz", EXAMPLE)
    assert rows(interactions.scan_interactions(spark, path, skip_header=False)) == [
        (0, 1, "34347669376", "grimnax", 5415, 5419, 4)
    ]


def test_first_line_is_dropped_by_default_even_if_it_is_data(spark, write):
    path = write("a.csv.gz", EXAMPLE, "2,s,b,1,3")
    assert rows(interactions.scan_interactions(spark, path)) == [(0, 2, "s", "b", 1, 3, 2)]


def test_quotes_and_spaces_are_ordinary_characters(spark, write):
    path = write("a.csv.gz", '1,"s1",b",1,3', "2, s2,c ,4,6")
    assert rows(interactions.scan_interactions(spark, path, skip_header=False)) == [
        (0, 1, '"s1"', 'b"', 1, 3, 2),
        (1, 2, " s2", "c ", 4, 6, 2),
    ]


def test_blanks_around_a_line_do_not_matter(spark, write):
    path = write("a.csv.gz", "  1,s,b,1,3  ", "2,s,b,1,4\t")
    assert [r[1:] for r in rows(interactions.scan_interactions(spark, path, skip_header=False))] == [
        (1, "s", "b", 1, 3, 2),
        (2, "s", "b", 1, 4, 3),
    ]


@pytest.mark.parametrize("bad", ["1,s,b,1", "1,s,b,1,2,3", "x,s,b,1,2", "1,s,b,1,2.5", "1,s,b,,2"])
def test_malformed_rows_fail(spark, write, tmp_path, bad):
    path = write("a.csv.gz", EXAMPLE, bad)
    with pytest.raises(Exception, match="(?i)malformed|not a whole number"):
        interactions.ingest_interactions(spark, path, str(tmp_path / "out"), skip_header=False)


def test_quarantine(spark, write):
    bad = ["1,s,b,1", "x,s,b,1,2", "1,s,b,1,2,3"]
    path = write("a.csv.gz", EXAMPLE, *bad, "2,s,b,1,3")
    good, quarantined = interactions.scan_with_quarantine(spark, path, skip_header=False)
    assert [r[0] for r in rows(good)] == [0, 4]
    assert rows(quarantined) == [(i + 1, line) for i, line in enumerate(bad)]


def test_order_over_many_files(spark, write, tmp_path):
    for f in range(4):
        write(f"part-{f}.csv.gz", "user,stream,streamer,start,stop", *[f"{f},s,b,{i},{i + 1}" for i in range(5 + f)])
    got = rows(interactions.scan_interactions(spark, str(tmp_path)))
    want = [(f, i) for f in range(4) for i in range(5 + f)]
    assert [(r[1], r[4]) for r in got] == want
    assert [r[0] for r in got] == list(range(len(want)))


def test_order_over_splits_of_one_plain_file(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("".join(f"{i},s,b,{i},{i + 1}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = interactions.scan_interactions(spark, str(path), skip_header=False)
        assert df.where("row_id != user_id").count() == 0
        assert df.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ingest_and_read_back(spark, write, tmp_path):
    path = write("a.csv.gz", "header", *[f"{i % 7},s{i},b,{i},{i + 2}" for i in range(50)])
    table = interactions.ingest_interactions(spark, path, str(tmp_path / "log"))
    assert table.schema == INTERACTIONS
    assert [r[0] for r in rows(table)] == list(range(50))


def test_text_is_decoded_once_and_rows_stay_where_they_are(spark, write, tmp_path, monkeypatch):
    for name, first, n in (("part-10.csv.gz", 30, 25), ("part-9.csv.gz", 0, 30), ("part-11.csv.gz", 55, 0), ("part-12.csv.gz", 55, 7)):
        write(name, "header", *[f"{i},s,b,{i},{i + 1}" for i in range(first, first + n)])
    raw = interactions._strict_rows(spark, str(tmp_path), True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, staged = order.staged_text_order(raw, interactions._all_fields_valid())
        plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "FileScan csv" not in plan and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        by_path = sorted((r["row_id"], int(r["user_id"])) for r in got.collect())
        assert by_path == [(i, i) for i in range(62)]
        monkeypatch.setattr(order, "BROADCAST_PIECES", 0)
        joined, _ = order.staged_text_order(raw, interactions._all_fields_valid())
        assert sorted((r["row_id"], int(r["user_id"])) for r in joined.collect()) == by_path
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_files_ingest_in_order(spark, tmp_path):
    text = tmp_path / "text"
    text.mkdir()
    for part in range(3):
        (text / f"{part}.csv").write_text("".join(f"{i},s,b,{i},{i + 1}\n" for i in range(part * 5000, part * 5000 + 5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        table = interactions.ingest_interactions(spark, str(text), str(tmp_path / "log"), skip_header=False)
        assert (table.where("row_id != user_id").count(), table.count()) == (0, 15_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_log_reads_back(spark, golden, tmp_path):
    interactions.write_log(golden, str(tmp_path / "text"))
    assert rows(interactions.scan_interactions(spark, str(tmp_path / "text"))) == rows(golden)


def test_parquet_row_order(spark, tmp_path):
    spark.range(100, numPartitions=3).write.parquet(str(tmp_path / "t"))
    numbered = order.parquet_row_order(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in numbered.orderBy("row_id").select("row_id", "id").collect()] == [(i, i) for i in range(100)]


RECORD = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("live", T.BooleanType()),
        T.StructField("span", T.ArrayType(T.LongType())),
    ]
)


def test_records(spark, write):
    path = write(
        "r.gz",
        "{'id': 1, 'name': 'a'}",
        '{"id": 2, "name": "it\'s", "live": true}',
        "{'id': 3, 'name': None}",
        "{'id': 4, 'live': True, 'name': \"d\"}",
        "{'id': 5, 'span': (7, 8)}",
        "",
        "{'id': 6, 'name': ",
        "__import__('os').getcwd()",
        "[1, 2]",
    )
    good, failed = records.load_records(spark, path, RECORD)
    assert [tuple(r) for r in good.orderBy("id").collect()] == [
        (1, "a", None, None),
        (2, "it's", True, None),
        (3, None, None, None),
        (4, "d", True, None),
        (5, None, None, [7, 8]),
    ]
    assert sorted(r[0] for r in failed.collect()) == ["[1, 2]", "__import__('os').getcwd()", "{'id': 6, 'name': "]


def test_empty_text_fields_are_keys(spark, tmp_path):
    (tmp_path / "log.csv").write_text("1,,b,1,3\n1,s,,1,4\n")
    strict = interactions.scan_interactions(spark, str(tmp_path), skip_header=False).select("stream_id", "streamer").collect()
    good, bad = interactions.scan_with_quarantine(spark, str(tmp_path), skip_header=False)
    assert sorted(map(tuple, strict)) == [("", "b"), ("s", "")] == sorted(map(tuple, good.select("stream_id", "streamer").collect()))
    assert bad.count() == 0


def test_lines_of_more_than_one_value_fail(spark, write):
    lines = [
        "{'id': 1} garbage",
        "{'id': 2}, {'id': 3}",
        "{'id': 4}{'id': 5}",
        "{'id': 6}] garbage",
        "{'id': 7}} garbage",
        "{'id': 8}, 'a': {'id': 9}",
    ]
    good, failed = records.load_records(spark, write("m.gz", *lines, "  {'id': 10} "), RECORD)
    assert [r.id for r in good.collect()] == [10]
    assert sorted(r.line for r in failed.collect()) == sorted(lines)


def test_files_are_numbered_in_the_order_of_their_numbers(spark, tmp_path):
    names = ["log-2.csv", "log-10.csv", "part-99998.csv", "part-100000.csv"]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(f"{i},s,b,1,3\n")
    table = interactions.scan_interactions(spark, str(tmp_path), skip_header=False)
    assert [r.user_id for r in table.orderBy("row_id").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("line", ["1,s,b,1", "1,s,b,1,3,4", "x,s,b,1,3", "1,s,b,1,y"])
def test_strict_scan_checks_fields_a_query_does_not_use(spark, tmp_path, line):
    (tmp_path / "log.csv").write_text(f"1,s,b,1,3\n{line}\n")
    scan = interactions.scan_interactions(spark, str(tmp_path), skip_header=False)
    for use in (scan.count, scan.select("streamer").collect, scan.select("row_id").collect):
        with pytest.raises(Exception, match="MALFORMED|not a whole number"):
            use()
