"""Delimiters and columns of delimited files."""

from basaltiq.sources import profiles, readers

FILES = {
    "comma.csv": 'a,b,c\n1,"x;y;z;w",3\n\n4,"say ""hi, you""",6\n',
    "semi.csv": "a;b\n1,5;2\n2,5;3\n3;4\n",
    "tab.tsv": "a\tb\n1\t2\n",
    "pipe.txt": "a|b|c|d\n1|2|3|4\n1|2|3|4\nbroken|line\n",
    "one.csv": "word\nother\n",
}


def test_delimiters(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "empty.csv").write_text("")
    got = {r.file.rsplit("/", 1)[1]: (r.delimiter, r.columns, r.share) for r in profiles.delimiters(spark, str(tmp_path)).collect()}
    assert got == {"comma.csv": (",", 3, 1.0), "semi.csv": (";", 2, 1.0), "tab.tsv": ("\t", 2, 1.0), "pipe.txt": ("|", 4, 0.75), "one.csv": (None, 1, 1.0)}


def test_read_with_found_delimiter(spark, tmp_path):
    (tmp_path / "semi.csv").write_text(FILES["semi.csv"])
    found = profiles.delimiters(spark, str(tmp_path / "semi.csv")).first()
    rows = readers.read_csv(spark, str(tmp_path / "semi.csv"), sep=found.delimiter)
    assert rows.columns == ["a", "b"] and rows.count() == 3
    details = {r.column_name: r for r in profiles.column_details(rows).collect()}
    # 1,5 is no number here; one of three is.
    assert details["a"].kind == "text" and details["b"].kind == "numeric" and details["b"].mean == 3.0


def test_column_details(spark):
    rows = [("1", "x", None, "-2.5"), ("2", "", None, "7"), ("2", "y", None, "n/a"), ("", "1", None, None)] * 3
    got = {r.column_name: tuple(r)[1:] for r in profiles.column_details(spark.createDataFrame(rows, "`n.o` string, word string, none string, mixed string")).collect()}
    assert got == {
        "n.o": (9, 3, 2, "numeric", 1.0, 2.0, 1.67, "1|2"),
        "word": (9, 3, 3, "text", None, None, None, "1|x|y"),
        "none": (0, 12, 0, "text", None, None, None, None),
        "mixed": (9, 3, 3, "numeric", -2.5, 7.0, 2.25, "-2.5|7|n/a"),
    }


def test_no_rows(spark):
    got = profiles.column_details(spark.createDataFrame([], "a int, column_name string, v string")).collect()
    assert sorted(tuple(r) for r in got) == [(c, 0, 0, 0, "text", None, None, None, None) for c in ("a", "column_name", "v")]
