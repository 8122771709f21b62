"""Each operator on small literal tables."""

import pytest

import tagloom
import tagloom.sources.readers
from tagloom import TagFrame
from tagloom.errors import PatternError, RecipeError, TagsNotFoundError
from tagloom.plans.recipe import from_recipe, from_spec

STATIONS = [
    ["Station", "Kind", "Zone", "Rain", "Checked by", "Checked"],
    ["#station", "#kind", "#zone+name", "#rain", "#person", "#date"],
    ["Alta", "valley", "North", "12.5", "Mo", "2021-03-04"],
    ["Brun", "peak", "North", "40", "Lee", "2021-03-02"],
    ["Cove", "coast", "South", "7", "Mo", "2021-02-27"],
    ["Dell", "valley", "South", "19", "", "2021-03-04"],
    ["Edge", "coast", "West", "33", "Lee", "2021-01-15"],
]
ROWS = STATIONS[2:]


def rows(letters):
    """Rows of the stations with these first letters, in this order."""
    return [next(r for r in ROWS if r[0][0] == c) for c in letters]


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: TagFrame.from_rows(spark, rows)


@pytest.fixture(scope="module")
def base(make):
    return make(STATIONS)


def values(frame):
    return frame.collect()


@pytest.mark.parametrize(
    ("queries", "want"),
    [
        ("kind=coast", "CE"), ("#kind = COAST", "CE"), ("#kind!=coast", "ABD"), ("#rain>19", "BE"), ("#rain>=19", "BDE"), ("#rain<12.5", "C"), ("#rain<=12.5", "AC"),
        ("#station~[al]l", "AD"), ("#zone!~th$", "E"), (["#kind=peak", "#rain<10"], "BC"), ("#depth=1", ""), ([], "ABCDE"), ("#rain is max", "B"), ("#rain is not min", "ABDE"),
        ("#person is empty", "D"), ("#person is not empty", "ABCE"), ("#rain is number", "ABCDE"), ("#kind is number", ""), ("#date is date", "ABCDE"), ("#date>=2021-03-01", "ABD"),
        ("#rain > {{ 4 * 5 - 2 }}", "BDE"),
    ],
)
def test_with_and_without_rows(base, queries, want):
    assert values(base.with_rows(queries)) == rows(want)
    if queries:
        assert values(base.without_rows(queries)) == [r for r in ROWS if r not in rows(want)]


def test_masks_let_other_rows_pass(base):
    assert values(base.with_rows("kind=valley", mask="zone=North")) == rows("ACDE")
    assert values(base.without_rows("kind=valley", mask="zone=North")) == rows("BCDE")


def test_any_matching_column_counts(make):
    f = make([["#pet", "#pet"], ["cat", "dog"], ["dog", "dog"], ["cat", "cat"]])
    assert values(f.with_rows("#pet=cat")) == [["cat", "dog"], ["cat", "cat"]]
    assert len(values(f.with_rows("#pet!=cat"))) == 2


def test_dates_are_compared_as_dates(make):
    f = make([["#date"], ["4 July 2020"], ["2019-12-31"], ["unknown"]])
    assert values(f.with_rows("#date>2020-06-30")) == [["4 July 2020"], ["unknown"]]  # text falls back to text
    assert values(f.with_rows("#date=4/7/2020")) == [["4 July 2020"]]
    assert values(f.with_rows("#date is date")) == [["4 July 2020"], ["2019-12-31"]]


def test_columns(base, make):
    assert base.with_columns("#zone").display_tags == ["#zone+name"]
    assert base.with_columns(["#rain", "#kind"]).display_tags == ["#kind", "#rain"]
    assert base.without_columns("#zone,#person,#date").display_tags == ["#station", "#kind", "#rain"]
    f = make([["One", "Two", "Three", "Four"], ["#one", "", "#three", ""], ["1", "2", "3", "4"]]).without_columns(skip_untagged=True)
    assert (f.headers, f.display_tags, values(f)) == (["One", "Three"], ["#one", "#three"], [["1", "3"]])


def test_add_columns(base):
    f = base.add_columns("Network#network+name=Blue")
    assert f.headers[-1] == "Network" and f.display_tags[-1] == "#network+name" and {r[-1] for r in values(f)} == {"Blue"}
    f = base.add_columns([("#first", "v"), "Both#both={{#rain * 2}} {{#kind}}."], before=True)
    assert f.display_tags[:2] == ["#first", "#both"] and values(f)[1][:2] == ["v", "80 peak."]
    assert values(base.add_columns("#z={{#missing}}"))[0][-1] == "None"
    with pytest.raises(PatternError):
        base.add_columns("no spec")


def test_rename(base, make):
    f = base.rename_columns("#person:Keeper#keeper+name")
    assert f.tags[4] == "#keeper" and f.headers[4] == "Keeper" and f.display_tags[4] == "#keeper+name"
    twins = make([["Min", "Max", "Day"], ["#temp", "#temp", "#date"], ["1", "9", "2020"]])
    assert twins.rename_columns("Max#temp:High#temp+max").headers == ["Min", "High", "Day"]
    assert twins.rename_columns("Max#temp:High#temp+max").display_tags == ["#temp", "#temp+max", "#date"]


def test_append(base, make):
    other = [["Zone", "Height", "Name", "Note", "Note"], ["#zone+name", "#height", "#station", "#note", "#note"], ["East", "310", "Fell", "old", "far"], ["North", "22", "Glen", "", "new"]]
    f = base.append(other)
    assert f.headers == [*STATIONS[0], "Height", "Note", "Note"]
    fell, glen = ["Fell", "", "East", "", "", "", "310", "old", "far"], ["Glen", "", "North", "", "", "", "22", "", "new"]
    assert values(f) == [*([*r, "", "", ""] for r in ROWS), fell, glen]
    assert values(base.append(make(other), add_columns=False))[-1] == glen[:6]
    assert values(base.append(other, queries="zone=North"))[5:] == [glen]
    assert len(values(base.append([make(other), make(other)]))) == 9


def test_append_external_list(base, make, tmp_path):
    names = []
    for k in range(2):
        names.append(tmp_path / f"{k}.csv")
        names[-1].write_text(f"#station,#extra\nNew {k},x{k}\n")
    listed = make([["#x_source"], *([str(n)] for n in names)])
    with pytest.raises(OSError):
        base.append_external_list(listed)  # local files are not allowed unless asked for
    frames = [tagloom.data(str(n), tagloom.sources.readers.InputOptions(allow_local=True)) for n in names]
    assert [r[0] for r in values(base.append(frames))[5:]] == ["New 0", "New 1"]


def test_cache_and_limit(base):
    from tagloom.operators.rows import overflow

    assert values(base.cache()) == ROWS
    assert values(base.sort("#rain", reverse=True).cache(3)) == rows("BED")
    assert overflow(base, 4) and not overflow(base, 5)


def test_sort(base, make):
    assert values(base.sort("#rain")) == rows("CADEB") and values(base.sort(["#kind", "#rain"])) == rows("CEBAD")
    assert values(base.sort("#zone", reverse=True)) == rows("ECDAB")  # equal keys keep their order
    assert values(base.sort("#date")) == rows("ECBAD")
    assert values(make([["#x"], ["pear"], ["30"], ["4"], ["Fig"], [""]]).sort()) == [["4"], ["30"], [""], ["Fig"], ["pear"]]
    assert values(make([["#date"], ["5 May 2011"], ["2010-09-01"], ["May 2011"]]).sort("#date")) == [["2010-09-01"], ["May 2011"], ["5 May 2011"]]
    ragged = make([["#a", "#b"], ["8"], ["3", "k", "more"]])
    assert values(ragged.sort()) == [["3", "k"], ["8", ""]]


def test_dedup(base, make):
    doubled = make(STATIONS + ROWS)
    assert values(doubled.dedup()) == ROWS
    assert values(doubled.dedup(queries="kind=coast")) == [*ROWS, *rows("ABD")]
    assert values(base.dedup("#zone")) == rows("ACE") and values(base.dedup("#kind,#person")) == rows("ABCDE") and values(base.dedup("#person")) == rows("ABD")
    assert values(make([["#x"], ["5"], ["5.0"], [" Yes "], ["yes"]]).dedup()) == [["5"], [" Yes "]]
    once = doubled.dedup()
    assert values(once.dedup()) == values(once)


def test_count(base, make):
    f = base.count("kind", "count() as Stations#meta+count")
    assert (f.headers, f.display_tags) == (["Kind", "Stations"], ["#kind", "#meta+count"])
    assert values(f) == [["coast", "2"], ["peak", "1"], ["valley", "2"]]
    pick = lambda spec, by="kind": [r[-1] for r in values(base.count(by, spec))]
    assert pick("sum(#rain)") == ["40", "40", "31.5"] and pick("average(#rain)") == ["20", "40", "15.75"]
    assert pick("min(#rain)") == ["7", "40", "12.5"] and pick("max(#rain) as #m") == ["33", "40", "19"]
    assert pick("concat(#zone) as Zones#zone+list") == ["South|West", "North", "North|South"]
    assert values(base.count("#kind", queries="zone=South")) == [["coast", "1"], ["valley", "1"]]
    assert values(base.count("#nothing")) == [["", "5"]] and values(base.with_rows("kind=x").count()) == []
    assert values(make([["#team"], ["red"], ["red "], ["blue"]]).count("#team")) == [["blue", "1"], ["red", "2"]]
    mixed = make([["#n"], ["8"], [5], ["none"]])
    assert values(mixed.count(aggregators="min(#n)")) == [["5"]] and values(mixed.count(aggregators="max(#n)")) == [["none"]]
    dates = make([["#trip", "#date"], ["x", "2012-05-06 10:00:00"], ["x", "8 Aug 2013"], ["x", "11/30/2013"]])
    assert values(dates.count("trip", "min(#date)")) == [["x", "2012-05-06 10:00:00"]] and values(dates.count("trip", "max(#date)")) == [["x", "11/30/2013"]]
    with pytest.raises(PatternError):
        base.count("kind", "sum()")


def test_extremes_and_value_set(base, make):
    assert base.min("#rain").first()[0] == "7" and base.max("#station").first()[0] == "Edge"
    assert {r[0] for r in base.value_set("#zone").collect()} == {"North", "South", "West"}
    assert {r[0] for r in make([["#x"], ["Tea"], [" tea"]]).value_set("#x", normalise=True).collect()} == {"tea"}


def test_merge(base, make):
    zones = make([["Zone", "Number"], ["#zone+name", "#zone+number"], ["NORTH", "10"], [" Sóuth", "20"]])
    f = base.merge_data(zones, "#zone+name", "#zone+number")
    assert f.headers[-1] == "Number" and [r[-1] for r in values(f)] == ["10", "10", "20", "20", ""]
    areas = make([["#zone+number", "#area"], ["20", "5 km2"], ["10", ""]])
    assert [r[-1] for r in values(f.merge_data(areas, "#zone+number", "#area"))] == ["", "", "5 km2", "5 km2", ""]
    twice = make([["#zone+name", "#chief", "#year"], ["West", "Ann", "1"], ["West", "Bo", "2"], ["North", "Cy", "1"]])
    assert [r[-1] for r in values(base.merge_data(twice, "zone", "chief"))] == ["Cy", "Cy", "", "", "Bo"]  # the last row counts
    assert [r[-1] for r in values(base.merge_data(twice, "zone", "chief", queries="year=1"))] == ["Cy", "Cy", "", "", "Ann"]


def test_merge_tries_every_candidate(make):
    prices = make([["#fruit", "#price"], ["plum", "3"], ["lime", "4"]])
    for first in ("", "mud"):
        f = make([["#box", "#fruit", "#fruit"], ["1", first, "lime"]])
        assert values(f.merge_data(prices, "#fruit", "#price")) == [["1", first, "lime", "4"]]


def test_merge_replace(make):
    left = make([["#k", "#v"], ["a", "old"], ["b", ""], ["c", "kept"]])
    right = make([["#k", "#v"], ["a", "new a"], ["b", "new b"]])
    assert values(left.merge_data(right, "#k", "#v", replace=True)) == [["a", "old"], ["b", "new b"], ["c", "kept"]]
    assert values(left.merge_data(right, "#k", "#v", replace=True, overwrite=True)) == [["a", "new a"], ["b", "new b"], ["c", "kept"]]


def test_clean(make, base):
    column = lambda cells, **o: [r[0] for r in values(make([["#date" if "date" in o else "#x"], *([r] for r in cells)]).clean_data(**o))]
    assert column(["  tea", "milk  ", "ice    cream"], whitespace="x") == ["tea", "milk", "ice cream"]
    numbers = ["  85", "2,040 ", 7, "3.2E4"]
    assert column(numbers, number="x") == ["85", "2040", "7", "32000"]
    assert column(numbers, number="x", number_format="0.1f") == ["85.0", "2040.0", "7.0", "32000.0"]
    dates = ["May 9 2012", "3/4/12", "6 Jul/12", "2012-11-30"]
    assert column(dates, date="date") == ["2012-05-09", "2012-04-03", "2012-07-06", "2012-11-30"]
    assert column(dates, date="date", date_format="%d.%m.%Y") == ["09.05.2012", "03.04.2012", "06.07.2012", "30.11.2012"]
    assert column(["10-25-13", "28-10-13", "10-30-13", "04-05-13"], date="date") == ["2013-10-25", "2013-10-28", "2013-10-30", "2013-04-05"]  # mostly months first
    assert column(["25-10-13", "10-28-13", "30-10-13", "04-05-13"], date="date") == ["2013-10-25", "2013-10-28", "2013-10-30", "2013-05-04"]
    assert column(["1357000000000"], date="date") == ["2013-01-01"]
    assert [r[1] for r in values(base.clean_data(upper="kind"))] == ["VALLEY", "PEAK", "COAST", "VALLEY", "COAST"]
    assert [r[2] for r in values(base.clean_data(lower="zone", queries="kind=coast"))] == ["North", "North", "south", "South", "west"]
    places = make([["#x", "#geo+lat", "#geo+lon", "#geo+coord"], ["12E 15 00", "60N 15 00", "12E 15 00", "60N 15 00,12E 15 00"]])
    assert values(places.clean_data(latlon="geo")) == [["12E 15 00", "60.2500", "12.2500", "60.2500,12.2500"]]
    mixed = make([["#date", "#rain", "#geo+lat", "#geo+lon"], ["8/Oct/2019", "lots", "60N15", "here"], ["once", "4,500", "there", "12E15"]])
    options = {"date": "date", "number": "rain", "latlon": "geo"}
    assert values(mixed.clean_data(**options)) == [["2019-10-08", "lots", "60.2500", "here"], ["once", "4500", "there", "12.2500"]]
    assert values(mixed.clean_data(**options, purge=True)) == [["2019-10-08", "", "60.2500", ""], ["", "4500", "", "12.2500"]]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("peak", "summit", "#kind"), "summit"), (("peak", "", "#kind"), ""), (("p.*k", None, "#kind", True), ""), (("peak", "summit", "#kind,#depth"), "summit"),
        (("peak", "summit", "#zone"), "peak"), (("  PEAK ", "summit"), "summit"), (("eak", "x", "#kind"), "peak"), (("eak$", "ony", "#kind", True), "pony"),
        (("^eak", "x", "#kind", True), "peak"), (("(p)(e)", r"\2\1 $", "#kind", True), "ep $ak"),
    ],
)
def test_replace(base, args, want):
    assert values(base.replace_data(*args))[1][1] == want


def test_replace_map_and_queries(base, make, monkeypatch):
    rules = make([["#x_pattern", "#x_substitution", "#x_tag", "#x_regex"], ["lee", "Leander", "person", ""], ["^M", "Mr M", "person", "yes"]])
    assert [r[4] for r in values(base.replace_data_map(rules))] == ["Mr Mo", "Leander", "Mr Mo", "", "Leander"]
    assert [r[2] for r in values(base.replace_data("South", "Low", "#zone", queries="kind=coast"))] == ["North", "North", "Low", "South", "West"]
    literal = make([["#x_pattern", "#x_substitution", "#x_tag"], ["LEE", "Leander", "person"], ["south", "Low", ""]])
    want = values(base.replace_data_map(literal))
    monkeypatch.setattr("tagloom.operators.cells.MANY_RULES", 1)  # long maps are joined
    assert values(base.replace_data_map(literal)) == want and want[1][4] == "Leander" and want[2][2] == "Low"


def test_jsonpath(make):
    f = make([["#j"], ['{"size": {"w": 3, "h": 5}, "tags": ["u", "v"]}'], ["not json"]])
    first = lambda path, **o: values(f.jsonpath(path, **o))[0][0]
    assert first("size.h") == "5" and first("tags[1]") == "v" and first("size.d") == "" and first("$.size") == '{"w": 3, "h": 5}'
    assert first("tags[*]") == '["u", "v"]' and first("tags[*]", use_json=False) == "u | v" and first("$.size.w", native=True) == "3"
    assert values(f.jsonpath("size.w"))[1][0] == values(f.jsonpath("$.size.w", native=True))[1][0] == "not json"
    assert values(make([["#j"], ['[{"k": 1, "v": 10}, {"k": 2, "v": 20}]']]).jsonpath("$[?(@.k=2)].v")) == [["20"]]
    with pytest.raises(ValueError):
        f.jsonpath("a b c")


def test_explode_and_implode(make):
    wide = make([["Shop", "Mon", "Tue", "Wed"], ["#shop", "#sales+label", "#sales+label", "#sales+label"], ["A", "5", "6", "7"], ["B", "1", "", "3"]])
    long = wide.explode()
    assert long.display_tags == ["#shop", "#sales+header", "#sales+value"]
    assert values(long) == [["A", "Mon", "5"], ["A", "Tue", "6"], ["A", "Wed", "7"], ["B", "Mon", "1"], ["B", "Tue", ""], ["B", "Wed", "3"]]
    assert wide.explode("day", "sum").display_tags[1:] == ["#sales+day", "#sales+sum"]
    back = long.implode("#sales+header", "#sales+value")
    assert back.headers == ["Shop", "Mon", "Tue", "Wed"] and values(back) == [["A", "5", "6", "7"], ["B", "1", "", "3"]]
    simple = make([["#shop", "#day", "#sales"], ["A", "Tue", "1"], ["B", "Mon", "2"], ["A", "Tue", "9"]]).implode("#day", "#sales")
    assert simple.display_tags == ["#shop", "#sales+label", "#sales+label"] and values(simple) == [["A", "", "1"], ["B", "2", ""]]
    with pytest.raises(PatternError):
        wide.implode("#day", "#sales")
    two = make([["P", "Q", "R", "S"], ["#in+label", "#in+label", "#out+label", "#out+label"], ["1", "2", "3", "4"]]).explode()
    assert values(two) == [["P", "1", "R", "3"], ["P", "1", "S", "4"], ["Q", "2", "R", "3"], ["Q", "2", "S", "4"]]


def test_expand_lists(make):
    f = make([["#shop", "#fruit+list", "#price+list"], ["A", "fig| plum ", "3|4"], ["B", "lime", "5|6"]])
    assert f.expand_lists().display_tags == ["#shop", "#fruit", "#price"]
    assert values(f.expand_lists())[:4] == [["A", "fig", "3"], ["A", "fig", "4"], ["A", "plum", "3"], ["A", "plum", "4"]]
    assert values(f.expand_lists(correlate=True)) == [["A", "fig", "3"], ["A", "plum", "4"], ["B", "lime", "5"], ["B", "", "6"]]
    assert values(f.expand_lists("#fruit", queries="shop=B")) == [["A", "fig| plum ", "3|4"], ["B", "lime", "5|6"]]
    assert values(make([["#x+list"], ["k;m"]]).expand_lists(separator=";")) == [["k"], ["m"]]


def test_fill(make, monkeypatch):
    f = make([["#row", "#seat"], ["1", "a"], ["", "b"], ["", ""], ["2", ""], ["", "c"]])
    want = [["1", "a"], ["1", "b"], ["1", "b"], ["2", "b"], ["2", "c"]]
    assert values(f.fill_data()) == want
    assert [r[0] for r in values(f.fill_data("#row", queries="seat=c"))] == ["1", "", "", "2", "2"]
    monkeypatch.setattr("tagloom.operators.rows.BLOCK", 2)  # many blocks
    assert values(f.fill_data()) == want
    assert values(f.sort("#seat").fill_data("#row"))[0] == ["", ""]  # an order without a whole number


def test_row_counter(base):
    for queries, n in ((None, 5), ("kind=valley", 2)):
        counter = base.row_counter(queries)
        assert values(counter.frame) == ROWS and counter.row_count == n


def test_recipes(base, spark):
    steps = [{"filter": "with_rows", "queries": "kind=coast"}, {"filter": "sort", "keys": "#rain", "reverse": True}, {"filter": "add_columns", "specs": ["#x=1"]}, {"filter": "cache"}]
    assert values(from_recipe(base, steps)) == [[*r, "1"] for r in rows("EC")]
    more = {"input": STATIONS, "recipe": {"filter": "with_rows", "queries": "kind=peak"}}
    spec = {"input": STATIONS, "recipe": [{"filter": "append", "append_sources": [more]}, {"filter": "count", "patterns": "kind"}]}
    assert values(from_spec(spec)) == [["coast", "2"], ["peak", "2"], ["valley", "2"]]
    tagged = from_spec({"input": [["Pet name", "n"], ["X", "1"]], "tagger": {"specs": {"pet": "#pet"}, "default_tag": "#num"}})
    assert tagged.display_tags == ["#pet", "#num"]
    for bad in ({"filter": "no such"}, {"filter": "with_columns"}, {"filter": "with_rows", "queries": None}):
        with pytest.raises(RecipeError):
            from_recipe(base, bad)


def test_no_hashtags(make):
    with pytest.raises(TagsNotFoundError):
        make([["a", "b"], ["1", "2"]])
