import pytest

from tabspark.sources import dialect as D
from tabspark.sources import ingest as I


@pytest.mark.parametrize(
    "text, want",
    [
        ("a,b,c\n1,2,x\n3,4,y", D.Dialect(",", '"', '"', True, False, 3)),
        ("a;b\n1,5;2\n3,25;4", D.Dialect(";", '"', '"', True, False, 2)),
        ("id\ttext\n1\thello, you, there\n2\ta, b", D.Dialect("\t", '"', '"', True, False, 2)),
        ("1|x\n2|y\n3|z", D.Dialect("|", '"', '"', False, False, 2)),
        ("2024-01-01,1.5\n2024-01-02,2", D.Dialect(",", '"', '"', False, False, 2)),
        ("day,v\n2024-01-01,1.5\n2024-01-02 10:00:00,2", D.Dialect(",", '"', '"', True, False, 2)),
        ("name,city\nann,rome\nbob,oslo", D.Dialect(",", '"', '"', True, False, 2)),  # all text: a header is assumed
        ("ann,ann\nbob,oslo", D.Dialect(",", '"', '"', False, False, 2)),  # repeated names are none
        ('k,v\n1,"a\nb"\n2,"c ""d"" e"', D.Dialect(",", '"', '"', True, True, 2)),
        ("k;v\n1;'a;b'\n2;'c''d'", D.Dialect(";", "'", "'", True, False, 2)),
        ('k,v\n1,"a \\"b\\", c"\n2,"d"', D.Dialect(",", '"', "\\", True, False, 2)),
        ("only\n1\n2", D.Dialect(",", '"', '"', True, False, 1)),
        ("line\none, two\nthree\nfour, five, six\nseven", D.Dialect(";", '"', '"', True, False, 1)),
        ("a,b\n1,2\n3\n4,5", D.Dialect(",", '"', '"', True, False, 2)),  # a short row stays malformed
        ("", D.Dialect()),
    ],
)
def test_sniffed_dialects(text, want):
    assert D.sniff_lines(text.split("\n") if text else []) == want


def write(scratch, name, text):
    path = f"{scratch}/{name}.csv"
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_read_source_finds_the_dialect(spark, scratch):
    df = I.read_source(spark, write(scratch, "a", "\ufeffk;v\n1;'x;y'\n2;''\n"), "csv")
    assert df.columns == ["k", "v"] and [tuple(r) for r in df.collect()] == [(1, "x;y"), (2, None)]
    df = I.read_source(spark, write(scratch, "b", "7\tx\n8\ty\n"), "csv")
    assert df.columns == ["column0", "column1"] and df.count() == 2
    df = I.read_source(spark, write(scratch, "c", 'k,v\n1,"a\nb"\n2,c\n'), "csv")
    assert [tuple(r) for r in df.collect()] == [(1, "a\nb"), (2, "c")]


def test_given_parts_win(spark, scratch):
    path = write(scratch, "d", "a;b\nx;1\n")
    assert I.read_source(spark, path, "csv", delimiter=",").columns == ["a;b"]
    assert I.read_source(spark, path, "csv", header=False).columns == ["column0", "column1"]


def test_a_malformed_row_fails(spark, scratch):
    path = write(scratch, "e", "a;b\n" + "1;2\n" * 20 + "3\n" + "1;2\n" * 20)
    with pytest.raises(Exception, match="(?i)malformed"):
        I.ingest(spark, path, f"{scratch}/out")
