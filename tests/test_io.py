"""Sources, sinks, command line."""

import io
import json
import zipfile

import pytest

import tagloom
from tagloom import TagFrame, cli
from tagloom.errors import HTMLSourceError, SourceError, TagsNotFoundError
from tagloom.sources import readers, sinks
from tagloom.sources.readers import InputOptions, data, info, raw_rows, rewrite_url
from tagloom.sources.tagger import tag_rows

LOCAL = InputOptions(allow_local=True)
CSV = "Org,,Où\r\n#org,,#adm1\r\nNGO A,x,Côte\r\n\"NGO\nB\",,\"Pl\"\"ains\"\r\n"
WANT = [["NGO A", "x", "Côte"], ["NGO\nB", "", 'Pl"ains']]


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_csv_delimiters_are_found(spark, tmp_path, sep):
    path = tmp_path / "x.csv"
    path.write_text(CSV.replace(",", sep), encoding="utf-8")
    f = data(str(path), LOCAL)
    assert f.display_tags == ["#org", "", "#adm1"] and f.headers == ["Org", "", "Où"] and f.collect() == WANT
    big = readers.read_csv(spark, str(path))
    assert big.display_tags == f.display_tags and big.collect() == WANT


def test_bytes_streams_and_encodings(spark):
    assert data(CSV.encode()).collect() == WANT and data(io.BytesIO(CSV.encode())).collect() == WANT and data(io.StringIO(CSV)).collect() == WANT
    assert data("#a\né\n".encode("latin-1"), InputOptions(encoding="latin-1")).collect() == [["é"]]


def test_json_sources(spark):
    rows = [["#org", "#n"], ["A", 1], ["B", None]]
    objects = [{"#org": "A", "#n": 1}, {"#n": {"x": [1]}, "#new": True}]
    read = lambda v, **o: data(json.dumps(v).encode(), InputOptions(**o))
    assert read(rows).collect() == [["A", "1"], ["B", ""]]
    assert read(objects).display_tags == ["#org", "#n", "#new"] and read(objects).collect()[1] == ["", '{"x": [1]}', "True"]
    nested = {"meta": [1, 2], "deep": {"data": rows}, "other": {"sel": [["#x"], ["1"]]}}
    assert read(nested).display_tags == ["#org", "#n"] and read(nested, selector="$.other.sel").display_tags == ["#x"] and read({"a": rows, "b": [["#z"], ["1"]]}, selector="b").display_tags == ["#z"]
    with pytest.raises(SourceError):
        read(nested, selector="missing")


def test_refused_sources(spark, tmp_path):
    with pytest.raises(HTMLSourceError):
        data(b"  <!DOCTYPE html><html></html>")
    with pytest.raises(TagsNotFoundError):
        data(b"a,b\n1,2\n")
    (tmp_path / "x.png").write_bytes(b"\x89PNG")
    with pytest.raises(SourceError):
        data(str(tmp_path / "x.png"), LOCAL)
    for name in (str(tmp_path / "x.csv"), "http://localhost/x.csv", "http://127.0.0.1/x", "http://[::1]/x", "http://h.localdomain/x", "ftp://a.b/x"):
        with pytest.raises(SourceError):
            data(name)


def workbook(rows, merged=""):
    cell = lambda r, c, v: f'<c r="{"ABCDEFG"[c]}{r + 1}"' + (f' t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f' s="{1 if isinstance(v, tuple) else 0}"><v>{v[0] if isinstance(v, tuple) else v}</v></c>')
    sheet = lambda data: '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v != "") + "</row>" for r, row in enumerate(data)) + f"</sheetData>{merged}</worksheet>"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="first" sheetId="1" r:id="r1"/><sheet name="tagged" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", sheet([["no tags"]]))
        z.writestr("xl/worksheets/s2.xml", sheet(rows))
    return out.getvalue()


def test_workbooks(spark):
    book = workbook([["Org", "N", "When"], ["#org", "#n", "#date"], ["A", 3.0, (43101,)], ["", 2.5, ""]], '<mergeCells><mergeCell ref="A3:A4"/></mergeCells>')
    assert data(book).collect() == [["A", "3", "2018-01-01"], ["", "2.5", ""]]
    assert data(book, InputOptions(expand_merged=True)).collect()[1][0] == "A"
    assert raw_rows(book, InputOptions(sheet_index=0)) == [["no tags"]]
    about = info(book)
    assert [s["name"] for s in about] == ["first", "tagged"] and [s["is_tagged"] for s in about] == [False, True] and about[1]["tags"] == ["#org", "#n", "#date"]


def test_zipped_csv(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("readme.md", "x")
        z.writestr("data.CSV", CSV)
    assert data(out.getvalue()).collect() == WANT


def test_rewritten_urls():
    assert rewrite_url("https://docs.google.com/spreadsheets/d/abc/edit#gid=7") == "https://docs.google.com/spreadsheets/d/abc/export?format=csv&gid=7"
    assert rewrite_url("https://docs.google.com/spreadsheets/d/abc/edit") == "https://docs.google.com/spreadsheets/d/abc/export?format=csv"
    assert rewrite_url("https://drive.google.com/file/d/abc/view") == rewrite_url("https://drive.google.com/open?id=abc") == "https://drive.google.com/uc?export=download&id=abc"
    assert rewrite_url("https://www.dropbox.com/s/k/f.csv?dl=0") == "https://www.dropbox.com/s/k/f.csv?dl=1" and rewrite_url("https://x.org/a.csv") == "https://x.org/a.csv"


def test_tagger(spark):
    rows = [["title"], ["Organisation name", "Country", "Total people"], ["A", "B", "3"]]
    f = tag_rows(spark, rows, {"organisation": "#org", "country": "#country", "people": "#affected+num"})
    assert f.display_tags == ["#org", "#country", "#affected+num"] and f.collect() == [["A", "B", "3"]]
    assert tag_rows(spark, rows, [("country", "#country")], default_tag="#meta").display_tags == ["#meta", "#country", "#meta"]
    with pytest.raises(TagsNotFoundError):
        tag_rows(spark, rows, {"organisation": "#org", "x": "#x"}, match_all=True)


def test_sinks(spark, tmp_path):
    f = TagFrame.from_rows(spark, [["Org", "N", ""], ["#org+b+a", "#n", ""], ["A, B", "1", "u"]])
    assert "".join(sinks.csv_lines(f)) == 'Org,N,\r\n#org+b+a,#n,\r\n"A, B",1,u\r\n'
    assert json.loads("".join(sinks.json_lines(f))) == [["Org", "N", ""], ["#org+b+a", "#n", ""], ["A, B", "1", "u"]]
    assert json.loads("".join(sinks.json_lines(f, use_objects=True))) == [{"#org+a+b": "A, B", "#n": "1"}]
    assert "".join(sinks.json_lines(f.with_rows("#n=2"), use_objects=True)) == "[\n]\n"
    same = TagFrame.from_rows(spark, [[" Org ", "N", ""], ["#org+b+a", "#n", ""], ["A,  B", "1", "u"]])
    assert sinks.data_hash(f) == sinks.data_hash(same) != sinks.columns_hash(f) == sinks.columns_hash(same)
    assert sinks.content_hash(f).first().rows == 1
    sinks.write_parquet(f, str(tmp_path / "p"))
    back = sinks.read_parquet(spark, str(tmp_path / "p"))
    assert back.display_tags == f.display_tags and back.headers == f.headers and back.collect() == f.collect()


def test_csv_round_trip(spark, tmp_path):
    rows = [["Name", "", "Note"], ["#name", "", "#note+x"], *([f"n{i}", " lead", ["", 'say "hi"', "a,b", "two\nlines", " "][i % 5]] for i in range(40))]
    f = TagFrame.from_rows(spark, rows)
    parts = f.with_df(f.df.repartition(3))
    for k, frame in enumerate((f, parts, f.sort("#name", reverse=True))):
        sinks.write_csv(frame, str(tmp_path / f"c{k}"))
        back = readers.read_csv(spark, str(tmp_path / f"c{k}"))
        assert (back.headers, back.display_tags) == (f.headers, f.display_tags) and back.collect() == frame.collect()
    none = f.with_rows("#name=nobody")
    sinks.write_csv(none, str(tmp_path / "none"))
    assert readers.read_csv(spark, str(tmp_path / "none")).collect() == [] and readers.read_csv(spark, str(tmp_path / "none")).display_tags == f.display_tags


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_folder(spark, tmp_path, multi_line):
    """Heads of different lengths, a row that looks like a header, and files larger than a split."""
    for k, head in enumerate(("Name,Size\n#name,#size\n", "#name,#size\n", "a title\n\nName,Size\n#name, #size\n")):
        (tmp_path / f"{k}.csv").write_text(head + "".join(f"f{k} r{i},{i}\n" for i in range(200)) + "Name,Size\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        f = readers.read_csv(spark, str(tmp_path), multi_line=multi_line)
        assert f.collect() == [r for k in range(3) for r in [*([f"f{k} r{i}", str(i)] for i in range(200)), ["Name", "Size"]]]
        assert f.df.rdd.getNumPartitions() > 3 or multi_line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def run(*args):
    out = io.StringIO()
    return cli.main(list(args), out), out.getvalue()


def test_command_line(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Org,Place,N\n#org,#adm1,#n\nA,x,1\nB,y,2\nA,y,3\n")
    p = str(path)
    assert run("select", p, "-q", "org=B")[1].splitlines()[2:] == ["B,y,2"]
    assert run("count", p, "-t", "#org", "-a", "sum(#n) as S#s")[1].splitlines() == ["Org,S", "#org,#s", "A,4", "B,2"]
    assert json.loads(run("sort", p, "-t", "#n", "-r", "--json")[1])[2] == ["A", "y", "3"]
    assert run("cut", p, "-i", "#n", "--strip-headers", "--strip-tags")[1].splitlines() == ["1", "2", "3"]
    assert run("merge", p, "-m", p, "-k", "#adm1", "-t", "#n", "--strip-headers")[1].splitlines()[1] == "A,x,1,1"
    assert len(run("hash", p)[1].strip()) == 32 and json.loads(run("info", p)[1])[0]["ncols"] == 3
    schema = tmp_path / "s.csv"
    schema.write_text("#valid_tag,#valid_datatype\n#org,number\n")
    code, text = run("validate", p, "-s", str(schema))
    assert code == 1 and json.loads(text)["stats"]["error"] == 3 and run("validate", p)[0] == 0
    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"input": p, "recipe": {"filter": "with_rows", "queries": "org=B"}}))
    assert run("spec", str(spec))[1].splitlines()[2:] == ["B,y,2"]
    raw = tmp_path / "raw.csv"
    raw.write_text("Org,N\nA,1\n")
    assert run("tag", str(raw), "-m", "org#org")[1].splitlines() == ["Org,N", "#org,", "A,1"]


def test_package_exports():
    assert {"TagFrame", "data", "tag_parquet"} <= set(tagloom.__all__)
