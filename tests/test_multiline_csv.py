"""CSV files with quoted line breaks, cut into small ranges, against Spark's own reader of whole files."""

import gzip
import os
import random

import numpy as np
import pytest

from starloom.plans import bronze
from starloom.sources import multiline_csv
from starloom.sources.csv_files import read_csv, text_csv
from starloom.sources.multiline_csv import multiline_csv as in_ranges
from starloom.sources.multiline_csv import read_records, stays_open

COLUMNS = ["a", "b", "c"]


def whole(spark, path):
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.mark.parametrize(
    ("line", "after_out", "after_in"),
    [
        ("", False, True),
        ("a,b", False, True),
        ('a,"b"', False, False),
        ('a,"b', True, False),
        ('"', True, False),
        ('""', False, True),
        ('"""', True, False),
        ('x"y,z', False, False),
        ('a 5" pipe,b', False, False),
        ('"a"b"c,d', False, False),
        ('a,"b"",c', True, False),
        ('b"", still","next', True, True),
        ('",","', True, False),
    ],
)
def test_stays_open(line, after_out, after_in):
    assert stays_open(line, False) is after_out
    assert stays_open(line, True) is after_in


def field(rng):
    kind = rng.random()
    plain = "".join(rng.choices("abc é日 0\t'", k=rng.randint(0, 6)))
    if kind < 0.4:
        return plain
    inner = "".join(rng.choice(["x", ",", "\n", '""', " ", "\n\n", "é", "y,z", '"",""\n']) for _ in range(rng.randint(0, 8)))
    return f'"{inner}"'


def text_of(rng, n, end="\n"):
    lines = ["a,b,c"]
    for _ in range(n):
        width = 3 if rng.random() < 0.9 else rng.choice([1, 2, 4])
        lines.append(",".join(field(rng) for _ in range(width)))
        if rng.random() < 0.05:
            lines.append("")
    return end.join(lines) + (end if rng.random() < 0.7 else "")


@pytest.mark.parametrize(("size", "most"), [(20, 1 << 20), (20, 3), (400, 1 << 20), (400, 3)])
def test_like_whole_files(spark, tmp_path, monkeypatch, size, most):
    """Ranges shorter than records, pieces too long to keep, several files at once."""
    monkeypatch.setattr(multiline_csv, "PIECE_SIGNS", most)
    rng = random.Random(size + most)
    for k in range(3):
        write(tmp_path / "csv", f"{k}.csv", text_of(rng, 40))
    path = str(tmp_path / "csv")
    want = rows(whole(spark, path))
    got = in_ranges(spark, path, COLUMNS, range_bytes=size)
    assert rows(got) == want
    assert len(want) > 100


def test_carriage_returns(spark, tmp_path):
    rng = random.Random(5)
    path = write(tmp_path, "r.csv", text_of(rng, 60, "\r\n"))
    want = rows(whole(spark, path))
    assert rows(in_ranges(spark, path, COLUMNS, range_bytes=50)) == want


@pytest.mark.parametrize(
    "text",
    [
        "a,b,c\n",
        "a,b,c",
        'a,b,c\n1,"open to the end\n2,x,y',
        'a,"b\nb",c\n1,2,3\n',
        '"a","b","c"\n"1","","3"\n,,\n',
        "a,b,c\n" + 'x,"' + "line\n" * 200 + '",z\n1,2,3\n',
        'a,b,c\n5" pipe,b,c\n"q"r,s,t\nlast,"é""é",\n',
    ],
)
def test_odd_files(spark, tmp_path, text):
    path = write(tmp_path, "odd.csv", text)
    want = whole(spark, path)
    want_rows = rows(want)
    for size in (5, 64):
        assert rows(in_ranges(spark, path, want.columns, range_bytes=size)) == want_rows
    got = text_csv(spark, path, multiline=True)
    assert got.columns == want.columns
    assert rows(got) == want_rows


def test_empty_and_compressed(spark, tmp_path):
    write(tmp_path / "many", "a.csv", "")
    write(tmp_path / "many", "b.csv", 'a,b,c\n1,"x\ny",3\n')
    with gzip.open(tmp_path / "many" / "c.csv.gz", "wt") as f:
        f.write('a,b,c\n4,"p\n\nq",6\n')
    got = text_csv(spark, str(tmp_path / "many"), multiline=True)
    assert rows(got) == [("1", "x\ny", "3"), ("4", "p\n\nq", "6")]


def test_headers_must_agree(spark, tmp_path):
    write(tmp_path / "two", "a.csv", "a,b\n1,2\n")
    write(tmp_path / "two", "b.csv", "b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        text_csv(spark, str(tmp_path / "two"), multiline=True)


def test_not_utf8(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes(b'a,b\n\xe9,"x\ny"\n')
    assert rows(text_csv(spark, str(path), multiline=True)) == [("�", "x\ny")]


def test_many_tasks_read_one_file(spark, tmp_path):
    rng = random.Random(8)
    path = write(tmp_path, "one.csv", text_of(rng, 4000))
    _, found = read_records(spark, path, range_bytes=os.path.getsize(path) // 16)
    assert found.rdd.getNumPartitions() >= 16
    per_task = [n for n in found.rdd.glom().map(len).collect() if n]
    assert len(per_task) >= 16 and max(per_task) < 1000


def test_ranges_cut_otherwise_are_told():
    starts, inside = np.array([100, 200]), np.array([200])
    ranges = multiline_csv._Ranges({(1, 2): starts}, {(1, 2): inside})
    assert [ranges.begins_inside((1, 2, k)) for k in (0, 100, 200)] == [False, False, True]
    assert not ranges.begins_inside((3, 4, 0))
    with pytest.raises(ValueError, match="read them again"):
        ranges.begins_inside((1, 2, 150))


def test_typed(spark, tmp_path):
    path = write(tmp_path, "t.csv", 'n,text\n1,"x\n2"\nbad,y\n')
    got = read_csv(spark, path, {"n": "int"}, ["n", "text"], multiline=True)
    assert rows(got) == sorted([(1, "x\n2"), (None, "y")], key=str)
    with pytest.raises(ValueError, match="lacks the columns"):
        text_csv(spark, path, ["missing"], multiline=True)
    assert bronze.SOURCES["order_reviews"].multiline
