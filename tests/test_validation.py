"""Data-quality tests, schemas and reports."""

import pytest

from tagloom import TagFrame
from tagloom import validation as v
from tagloom.errors import SchemaError


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: TagFrame.from_rows(spark, rows)


def column(make, test, cells, tag="#x"):
    """Bad cells of one column, with what each should be."""
    frame = make([[tag], *([c] for c in cells)])
    return [(r._value, r._suggestion) for r in test.violations(frame).orderBy(frame.order[0][0]).collect()]


def bad(make, test, cells, tag="#x"):
    return [value for value, _ in column(make, test, cells, tag)]


def test_cell_tests(make):
    assert bad(make, v.DatatypeTest("#x", "number"), ["1", "1,000", "", "x", "1e3"]) == ["1,000", "x"]
    assert bad(make, v.DatatypeTest("#x", "date"), ["2018-01-01", "1 Mar", "bad", ""]) == ["bad"]
    assert bad(make, v.DatatypeTest("#x", "url"), ["http://x.org/a", "x.org", "mailto:a"]) == ["x.org", "mailto:a"]
    assert bad(make, v.DatatypeTest("#x", "email"), ["a@b", "a@b@c", "ab"]) == ["a@b@c", "ab"]
    assert bad(make, v.DatatypeTest("#x", "phone"), ["+1 (613) 555x12", "12", "call me"]) == ["12", "call me"]
    assert bad(make, v.RangeTest("#x", "3", "10"), ["2", "3", "10", "11", ""]) == ["2", "11"]
    assert bad(make, v.RangeTest("#date", "2018-01-01"), ["1 Dec 2017", "Jan 5 2018"], "#date") == ["1 Dec 2017"]
    assert bad(make, v.RangeTest("#x", "bbb", "ddd"), ["aaa", "ccc", "eee"]) == ["aaa", "eee"]
    assert column(make, v.WhitespaceTest("#x"), [" a", "a  b", "a b", "a\tb"]) == [(" a", "a"), ("a  b", "a b"), ("a\tb", "a b")]
    assert bad(make, v.RegexTest("#x", "^ab+$"), ["abb", "ABB", "x"]) == ["ABB", "x"] and bad(make, v.RegexTest("#x", "b", False), ["aB", "x"]) == ["x"]
    assert column(make, v.EnumerationTest("#x", ["Health", "Education"]), ["health", "Educatoin", "zzz", ""]) == [("Educatoin", "Education"), ("zzz", None)]
    assert bad(make, v.EnumerationTest("#x", ["Aa"], True), ["aa", "Aa"]) == ["aa"]
    with pytest.raises(SchemaError):
        v.DatatypeTest("#x", "colour")


def test_uniqueness(make):
    assert bad(make, v.UniqueValueTest("#x"), ["a", "b", " A ", "a", ""]) == [" A ", "a"]
    f = make([["#a", "#b"], ["1", "x"], ["1", "y"], ["1.0", "X"], ["2", "x"]])
    assert v.UniqueRowTest("#a,#b").violations(f).count() == 1 and v.UniqueRowTest("#a").violations(f).count() == 2 and v.UniqueRowTest().violations(f).count() == 1


def test_correlation(make):
    f = make([["#adm1+name", "#adm1+code"], ["Coast", "1"], ["Coast", "1"], ["Coast", "2"], ["Plains", "3"], ["coast", "1"]])
    got = v.CorrelationTest("#adm1+code", "#adm1+name").violations(f).collect()
    assert [(r._value, r._suggestion) for r in got] == [("2", "1")]


def test_consistent_datatypes(make):
    assert bad(make, v.ConsistentDatatypesTest("#x"), ["1", "2", "x", "", "3"]) == ["x"]


def test_spelling(make):
    assert column(make, v.SpellingTest("#x"), ["aaaaa"] * 50 + ["bbbbb"] * 50 + ["aabaa"]) == [("aabaa", "aaaaa")]
    assert column(make, v.SpellingTest("#x"), ["aaaaa"] * 50 + ["bbbbb"] * 50 + ["zzzzz"]) == []
    assert column(make, v.SpellingTest("#x"), ["aaaaa"] * 500 + [f"w{i}" for i in range(50)]) == []  # too uneven to tell


def test_outliers(make):
    cells = ["1", "1000000"] + ["100", "200", "800"] * 10
    assert bad(make, v.OutlierTest("#x"), cells) == ["1000000"]
    assert bad(make, v.OutlierTest("#x"), ["1", "2", "x", ""]) == []


def test_required(make):
    f = make([["#x", "#x", "#y"], ["a", "", "1"], ["", "", "2"], ["a", "b", "3"]])
    assert v.RequiredTest("#x").violations(f).count() == 1 and v.RequiredTest("#x", 1, 1).violations(f).count() == 2
    (one,) = v.RequiredTest("#z").violations(f).collect()
    assert one._scope == "dataset"


SCHEMA = [
    ["#valid_tag", "#valid_required", "#valid_required+max", "#valid_datatype", "#valid_value+min", "#valid_value+max", "#valid_value+list", "#valid_severity", "#description"],
    ["#sector", "true", "", "", "", "", "WASH|Health", "", ""],
    ["#targeted", "", "", "number", "100", "1000", "", "warning", "Wrong target"],
    ["#country,#adm1", "", "1", "", "", "", "", "info", ""],
]


def test_schema(make):
    good = make([["#sector", "#targeted", "#country", "#adm1"], ["wash", "200", "Mali", "Coast"]])
    assert good.validate(SCHEMA).is_valid
    result = make([["#sector", "#targeted", "#country", "#adm1"], ["Food", "x", "Mali", ""], ["", "5", "", ""], ["Food", "500", "", ""]]).validate(SCHEMA)
    assert not result.is_valid and result.has_errors()
    report = result.report()
    assert report["stats"] == {"info": 0, "warning": 2, "error": 3, "external": 0, "total": 5}  # one place a rule, however many of its tests fail
    by = {i["tag_pattern"]: i for i in report["issues"]}
    assert by["#targeted"]["description"] == "Wrong target" and {"row": 0, "col": 1, "hashtag": "#targeted", "location_value": "x"} in by["#targeted"]["locations"]
    seen = []
    assert not result.for_each(seen.append) and len(seen) == 6
    with pytest.raises(SchemaError):
        v.Schema.parse([["#valid_tag", "#valid_required"], ["#x", "perhaps"]])


def test_taxonomies_and_what_cannot_be_read(make):
    f = make([["#org"], ["A"]])
    result = f.validate([["#valid_tag", "#valid_value+url"], ["#org", "/no/such/file.csv"]])
    assert result.is_valid and result.report()["stats"]["external"] == 1


def test_default_rules(make):
    f = make([["#date", "#affected", "#x"], ["2018-01-01", "5", "ok"], ["never", "many", "two  blanks"]])
    severities = sorted(r.severity for r in f.validate().issues.collect())
    assert severities == ["error", "error", "warning"]
