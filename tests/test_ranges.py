"""Multi-line CSV and large dump statements, read in byte ranges."""

import csv
import random
from contextlib import contextmanager

import pytest

from vitrina.sources import dump, views
from vitrina.sources.ranges import fragments

SMALL = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@contextmanager
def ranges_of(spark, size):
    before = {k: spark.conf.get(k) for k in SMALL}
    for k in SMALL:
        spark.conf.set(k, str(size))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def csv_text(rows, line_end):
    def field(x):
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n\r') or x == "" else x

    return "".join(",".join(map(field, r)) + line_end for r in [("b", "a"), *rows])


def made_rows(seed):
    rng = random.Random(seed)
    bits = ["x", "ñ", '"', '""', ",", "\n", "\r\n", "日", " ", "plain words", "\n\n", "';"]
    rows = [("".join(rng.choices(bits, k=rng.randint(1, 6))), str(i)) for i in range(120)]
    return [("word" + a + "end", b) for a, b in rows] + [("long " + "line\n" * 200, "9001"), ("last\n", "9002")]


@pytest.mark.parametrize("size", [31, 400, 1 << 20])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_split_csv_equals_whole_read(spark, tmp_path, size, line_end):
    rows = made_rows(size)
    path = tmp_path / "v.csv"
    path.write_bytes(csv_text(rows, line_end).encode())
    with path.open(newline="", encoding="utf-8") as file:
        expected = sorted(tuple(r) for r in list(csv.reader(file))[1:])
    with ranges_of(spark, size):
        read = views.read_csv(spark, str(path), ["b", "a", "none"], multi_line=True)
        found = read.collect()
        if size <= 400:
            assert fragments(spark, str(path), "\n").select("inicio").distinct().count() > 5
    assert sorted((r.b, r.a) for r in found) == expected == sorted(rows)
    assert all(r.none is None and r[views.CORRUPT] is None for r in found)


def test_split_csv_over_files_and_short_rows(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'a,b\n{i},"x\ny{i}"\n\nshort{i}\n{i},2,3\n')
    with ranges_of(spark, 9):
        read = views.read_csv(spark, str(tmp_path), ["a", "b"], multi_line=True)
        found = read.collect()
        counts = views.corrupt_rows(read).first()
    assert sorted(r.b for r in found if r[views.CORRUPT] is None) == ["x\ny0", "x\ny1", "x\ny2"]
    assert sorted(r[views.CORRUPT] for r in found if r[views.CORRUPT]) == sorted([f"short{i}" for i in range(3)] + [f"{i},2,3" for i in range(3)])
    assert tuple(counts) == (9, 6)
    (tmp_path / "3.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        views.read_csv(spark, str(tmp_path), ["a", "b"], multi_line=True).collect()


def test_empty_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text("a,b\n")
    assert views.read_csv(spark, str(tmp_path / "v.csv"), ["a", "b"], multi_line=True).count() == 0


# -- dumps


def sql_text(value):
    escapes = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
    return "NULL" if value is None else "'" + "".join(escapes.get(c, c) for c in value) + "'"


def made_values(seed, n):
    rng = random.Random(seed)
    bits = ["x", "ñ", "'", "\\", "),(", ");", "(", ")", ",", "\n", "\t", "INSERT INTO `t` VALUES (", '"', "--", ";"]
    return [None if rng.random() < 0.05 else "".join(rng.choices(bits, k=rng.randint(0, 8))) for _ in range(n)]


CREATE = "CREATE TABLE `{0}` (\n  `id` bigint NOT NULL COMMENT 'it''s',\n  `s` text,\n  PRIMARY KEY (`id`),\n  KEY `k` (`s`)\n) ENGINE=InnoDB"


def made_dump(seed, encoding="utf-8"):
    """Two tables: one statement of many tuples, many statements of few, a column list, both line ends."""
    values = made_values(seed, 150)
    if encoding == "latin-1":
        values = [v and v.encode("latin-1", "ignore").decode("latin-1") for v in values]
    big = ",".join(f"({i},{sql_text(v)})" for i, v in enumerate(values))
    small = "".join(f"INSERT INTO `u` (`s`, `id`) VALUES ({sql_text(v)},{i}),({sql_text(v)},{-i});\r\n" for i, v in enumerate(values[:30], 1))
    text = (
        "-- a dump of John's\n/*!40101 SET NAMES utf8 */;\n"
        + CREATE.format("t") + ";\nLOCK TABLES `t` WRITE;\n"
        + f"INSERT INTO `t` VALUES {big};\nUNLOCK TABLES;\n-- it's the second\r\n"
        + CREATE.format("u").replace("\n", "\r\n") + ";\r\n" + small
        + "INSERT INTO `t` VALUES (1000,'one');\nINSERT INTO `t` VALUES (1001,'two'),\n(1002,'three');\n"
    )
    expected = {
        "t": [*enumerate(values), (1000, "one"), (1001, "two"), (1002, "three")],
        "u": [(k, v) for i, v in enumerate(values[:30], 1) for k in (i, -i)],
    }
    return text.encode(encoding), expected


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_tuples_of_a_split_dump(spark, tmp_path, size):
    raw, expected = made_dump(size)
    path = tmp_path / "d.sql"
    path.write_bytes(raw)
    with ranges_of(spark, size):
        tuples = dump.read_tuples(spark, str(path)).cache()
        for name in ("t", "u"):
            columns = dump.tuple_columns(tuples, name)
            assert columns == ["id", "s"]
            rows = dump.load_tuples(tuples, name, "id long, s string", columns).collect()
            assert sorted(((r.id, r.s) for r in rows), key=repr) == sorted(expected[name], key=repr)
        tuples.unpersist()


def test_tuples_of_several_files_and_an_encoding(spark, tmp_path):
    expected = []
    for i in range(3):
        raw, of = made_dump(70 + i, "latin-1")
        (tmp_path / f"{i}.sql").write_bytes(raw)
        expected += of["t"]
    (tmp_path / "3.sql").write_bytes(b"INSERT INTO `t` VALUES (7,'a'),(8,'b')")  # neither a start nor an end
    (tmp_path / "4.sql").write_bytes(b"")
    expected += [(7, "a"), (8, "b")]
    with ranges_of(spark, 90):
        rows = dump.load_tuples(dump.read_tuples(spark, str(tmp_path), "ISO-8859-1"), "t", "id long, s string").collect()
    assert sorted(((r.id, r.s) for r in rows), key=repr) == sorted(expected, key=repr)


def test_one_statement_over_several_tasks(spark, tmp_path):
    path = tmp_path / "d.sql"
    n = 200_000
    path.write_text("INSERT INTO `t` VALUES " + ",".join(f"({i},'name {i} ),( x')" for i in range(n)) + ";\n")
    with ranges_of(spark, 1 << 20):
        rows = dump.load_tuples(dump.read_tuples(spark, str(path)), "t", "id long, s string")
        assert rows.rdd.getNumPartitions() > 4
        assert rows.selectExpr("count(*)", "count(distinct id)", "sum(id)", "count_if(s = concat('name ', id, ' ),( x'))").first()[:] == (
            n, n, n * (n - 1) // 2, n,
        )
