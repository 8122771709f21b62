"""Data quality: tests compiled to DataFrames of violations, schemas of rules, reports.

Each test's violations(frame) gives the rows it finds fault with, as the frame has them, with columns _col (place of
the cell, null for whole rows), _value, _suggestion, _message and _scope. A schema joins them in one table of issues.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError
from .frame import TagFrame
from .functions import normalize as nz
from .functions.dates import norm_date
from .operators.rows import key_of
from .plans.patterns import TagPattern, find_any
from .plans.predicates import RowQuery

EXTRA = ("_col", "_value", "_suggestion", "_message", "_scope")
#: Patterns of the datatypes, share of the mean at which a spelling is rare, rows from which extremes are trimmed, deviations of an outlier.
EMAIL, PHONE, URL = r"^[^@]+@[^@]+$", r"^\+?[0-9xX()\s-]{5,}$", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
RARE, TRIM_FROM, DEVIATIONS = 0.05, 10, 3
DATATYPES = ("text", "number", "url", "email", "phone", "date")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _rows(df: DataFrame, message: str, col: Column | None = None, value: Column | None = None, suggestion: Column | None = None, scope: str = "cell") -> DataFrame:
    return df.withColumns({
        "_col": _null("int") if col is None else col, "_value": _null("string") if value is None else value,
        "_suggestion": _null("string") if suggestion is None else suggestion, "_message": F.lit(message), "_scope": F.lit(scope),
    })


def _text(frame: TagFrame, i: int) -> Column:
    return nz.as_text(F.col(f"c{i}"), frame.type(i))


def _filled(frame: TagFrame, i: int) -> Column:
    return ~nz.is_empty(F.col(f"c{i}"), frame.type(i))


@dataclass(frozen=True)
class CellTest:
    """Base of tests of single cells: a subclass says which cells are bad and what they should be. Empty cells are not tested."""

    pattern: str | TagPattern

    message = "Bad value"

    def places(self, frame: TagFrame) -> list[int]:
        return TagPattern.parse(self.pattern).find(frame.columns)

    def bad(self, frame: TagFrame, i: int) -> Column:
        raise NotImplementedError

    def suggestion(self, frame: TagFrame, i: int) -> Column:
        return _null("string")

    def violations(self, frame: TagFrame) -> DataFrame:
        out = None
        for i in self.places(frame):
            own = frame.df.where(_filled(frame, i) & self.bad(frame, i)) if nz.is_text(frame.type(i)) else frame.df.where(self.bad(frame, i))
            part = _rows(own, self.message, F.lit(i), _text(frame, i), self.suggestion(frame, i))
            out = part if out is None else out.union(part)
        return _rows(frame.df.limit(0), self.message) if out is None else out


@dataclass(frozen=True)
class DatatypeTest(CellTest):
    datatype: str = "text"

    def __post_init__(self):
        if self.datatype not in DATATYPES:
            raise SchemaError(f"unknown datatype {self.datatype!r}")

    @property
    def message(self) -> str:
        return f"Cell is no {self.datatype}"

    def bad(self, frame, i):
        c, t = F.col(f"c{i}"), frame.type(i)
        if self.datatype == "number":
            return c.isNotNull() & ~nz.is_number(c, t)
        if self.datatype == "date":
            return c.isNotNull() & norm_date(c, t).isNull()
        regex = {"url": URL, "email": EMAIL, "phone": PHONE}.get(self.datatype)
        return F.lit(False) if regex is None else c.isNotNull() & ~_text(frame, i).rlike(regex)


@dataclass(frozen=True)
class RangeTest(CellTest):
    low: str | None = None
    high: str | None = None

    message = "Outside of the limits"

    def bad(self, frame, i):
        one = lambda op, v: RowQuery(TagPattern.parse(self.pattern), op, nz.python_norm_string(v)).test_cell(frame, frame.cell(i)) if v not in (None, "") else F.lit(False)
        return one("<", self.low) | one(">", self.high)


@dataclass(frozen=True)
class WhitespaceTest(CellTest):
    message = "Needless blanks"

    def bad(self, frame, i):
        return F.col(f"c{i}").rlike(r"(?U)^\s|\s$|\s\s|[\t\r\n]") if nz.is_text(frame.type(i)) else F.lit(False)

    def suggestion(self, frame, i):
        return nz.norm_space(F.col(f"c{i}"), frame.type(i))


@dataclass(frozen=True)
class RegexTest(CellTest):
    regex: str = ""
    case_sensitive: bool = True

    message = "Does not have the given form"

    def bad(self, frame, i):
        nz.check_regex(frame.df.sparkSession, self.regex)
        return ~_text(frame, i).rlike(("" if self.case_sensitive else "(?iu)") + nz.java_regex(self.regex))


@dataclass(frozen=True)
class EnumerationTest(CellTest):
    allowed: Sequence[str] = ()
    case_sensitive: bool = False

    message = "Not in the list"

    def _norm(self, frame: TagFrame, i: int) -> Column:
        return nz.norm_space(F.col(f"c{i}"), frame.type(i)) if self.case_sensitive else nz.norm_string(F.col(f"c{i}"), frame.type(i))

    def _allowed(self) -> list[tuple[str, str]]:
        norm = (lambda v: " ".join(str(v).split())) if self.case_sensitive else nz.python_norm_string
        return sorted({norm(v): str(v) for v in reversed(list(self.allowed))}.items())

    def bad(self, frame, i):
        return F.col(f"c{i}").isNotNull() & ~self._norm(frame, i).isin([k for k, _ in self._allowed()])

    def suggestion(self, frame, i):
        words = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in self._allowed()))
        return closest_match(self._norm(frame, i), words)


@dataclass(frozen=True)
class ListedTest:
    """Filled cells that a table of values, of any length, does not hold. Values are joined; only different bad values are compared with the table for a suggestion, and only with values of similar length."""

    pattern: str | TagPattern
    allowed: DataFrame
    case_sensitive: bool = False

    def violations(self, frame: TagFrame) -> DataFrame:
        places = TagPattern.parse(self.pattern).find(frame.columns)
        if not places:
            return _rows(frame.df.limit(0), "")
        norm = nz.norm_space if self.case_sensitive else nz.norm_string
        text = self.allowed.select(F.col(self.allowed.columns[0]).cast("string").alias("_v")).where(F.col("_v").isNotNull())
        known = text.groupBy(norm(F.col("_v"), T.StringType()).alias("_k")).agg(F.min("_v").alias("_v"))
        cells = _cells(frame, places).withColumn("_word", norm(F.col("_value"), T.StringType()))
        bad = cells.join(known, F.col("_word") == F.col("_k"), "left_anti")
        best = nearest(bad.select("_word").distinct(), known.select("_k", "_v"), []).withColumnRenamed("_word", "_w")
        found = bad.join(best, F.col("_word") == F.col("_w"), "left")
        return _rows(found.select(*frame.df.columns, "_col", "_value", "_best"), EnumerationTest.message, F.col("_col"), F.col("_value"), F.col("_best")).select(*frame.df.columns, *EXTRA)


def nearest(words: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _word, _best): for rows (keys, _word), _v of the nearest of known (keys, _k, _v), a third of the word's length away at most. Words meet only those of a length within reach."""
    n = F.length("_word")
    reach = F.sequence(F.ceil(n * 2 / 3).cast("int"), F.floor(n * 4 / 3).cast("int"))
    sized = words.select("*", F.explode(reach).alias("_length"))
    distance = F.levenshtein("_word", "_k")
    near = sized.join(known.withColumn("_length", F.length("_k")), [*keys, "_length"]).where(distance <= n / 3)
    return near.groupBy(*keys, "_word").agg(F.min_by("_v", F.struct(distance, -common_start(F.col("_word"), F.col("_k")), F.col("_k"))).alias("_best"))


def closest_match(text: Column, words: Column) -> Column:
    """v of the word (k, v) nearest to a text by edit distance, a third of its length at most; then by common start, then by order of words."""
    near = F.transform(words, lambda w: F.struct(F.levenshtein(text, w["k"]).alias("d"), (-common_start(text, w["k"])).alias("p"), w["k"].alias("k"), w["v"].alias("v")))
    return F.array_min(F.filter(near, lambda x: x["d"] <= F.length(text) / 3))["v"]


def common_start(a: Column, b: Column) -> Column:
    """Length of the common start of two texts."""
    shorter = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), shorter), lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
    return F.array_max(same)


def _cells(frame: TagFrame, places: Sequence[int]) -> DataFrame:
    """A row for each filled cell: the frame's row, _col, _value, _key (what makes values equal) and _spec (its column's tagspec)."""
    keys = [key_of(frame.cell(i), frame.columns[i].tag == "#date") for i in places]
    same = len({str(frame.type(i)) for i in places}) == 1
    keys = keys if same else [F.to_json(F.struct(k.alias("k"))) for k in keys]
    items = [F.when(_filled(frame, i), F.struct(F.lit(i).alias("_col"), _text(frame, i).alias("_value"), k.alias("_key"), F.lit(frame.columns[i].sorted_tag).alias("_spec"))) for i, k in zip(places, keys, strict=True)]
    return frame.df.select("*", F.explode(F.array_compact(F.array(*items))).alias("_x")).select(*frame.df.columns, "_x.*")


def _place(frame: TagFrame, *more: str) -> Column:
    return F.struct(*(F.col(n) for n, _ in frame.order), *(F.col(m) for m in more))


@dataclass(frozen=True)
class UniqueValueTest:
    """Cells whose value, over all matching columns, has come before."""

    pattern: str | TagPattern

    def violations(self, frame: TagFrame) -> DataFrame:
        places = TagPattern.parse(self.pattern).find(frame.columns)
        if not places:
            return _rows(frame.df.limit(0), "")
        cells = _cells(frame, places).withColumn("_at", _place(frame, "_col"))
        first = cells.groupBy("_key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumnRenamed("_key", "_k")
        again = cells.join(first, F.col("_key") == F.col("_k")).where("_at > _first")
        return _rows(again.select(*frame.df.columns, "_col", "_value"), "Repeated value", F.col("_col"), F.col("_value")).select(*frame.df.columns, *EXTRA)


@dataclass(frozen=True)
class UniqueRowTest:
    """Rows whose key, the columns of the patterns or all columns, has come before."""

    patterns: object = None

    def violations(self, frame: TagFrame) -> DataFrame:
        places = find_any(TagPattern.parse_list(self.patterns), frame.columns) or list(range(len(frame.columns)))
        keys = F.struct(*(key_of(frame.cell(i), frame.columns[i].tag == "#date").alias(f"k{i}") for i in places))
        rows = frame.df.select("*", keys.alias("_key"), _place(frame).alias("_at"))
        first = rows.groupBy("_key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumnRenamed("_key", "_k")
        again = rows.join(first, F.col("_key").eqNullSafe(F.col("_k"))).where("_at > _first")
        return _rows(again.select(*frame.df.columns), "Repeated row", scope="row")


@dataclass(frozen=True)
class CorrelationTest:
    """For each value of the key, cells that differ from the most frequent value (of equals the first)."""

    pattern: str | TagPattern
    key: object = None

    def violations(self, frame: TagFrame) -> DataFrame:
        places = TagPattern.parse(self.pattern).find(frame.columns)
        if not places:
            return _rows(frame.df.limit(0), "")
        others = find_any(TagPattern.parse_list(self.key), frame.columns)
        key = F.struct(F.lit(0).alias("n"), *(key_of(frame.cell(i), frame.columns[i].tag == "#date").alias(f"k{i}") for i in others))
        cells = _cells(frame, places).withColumn("_group", key)
        counts = cells.groupBy("_spec", "_group", "_value").agg(F.count(F.lit(1)).alias("_n"), F.min(_place(frame, "_col")).alias("_first"))
        best = Window.partitionBy("_spec", "_group").orderBy(F.desc("_n"), "_first")
        ranked = counts.select("_spec", "_group", "_value", F.row_number().over(best).alias("_r"), F.first("_value").over(best).alias("_best"))
        odd = ranked.where("_r > 1").select(F.col("_spec").alias("_s"), F.col("_group").alias("_g"), F.col("_value").alias("_v"), "_best")
        found = cells.join(odd, (F.col("_spec") == F.col("_s")) & F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_value") == F.col("_v")))
        return _rows(found.select(*frame.df.columns, "_col", "_value", "_best"), "Unexpected value", F.col("_col"), F.col("_value"), F.col("_best")).select(*frame.df.columns, *EXTRA)


def typeof(cell, date: bool) -> Column:
    """date, number, empty or string."""
    c, t = cell.column, cell.type
    dated = norm_date(c, t).isNotNull() if date else F.lit(False)
    return F.when(nz.is_empty(c, t), "empty").when(dated, "date").when(nz.is_number(c, t), "number").otherwise("string")


@dataclass(frozen=True)
class ConsistentDatatypesTest:
    """Cells whose kind is not the most frequent one of their tagspec."""

    pattern: str | TagPattern

    def violations(self, frame: TagFrame) -> DataFrame:
        places = TagPattern.parse(self.pattern).find(frame.columns)
        if not places:
            return _rows(frame.df.limit(0), "")
        kinds = F.create_map(*(x for i in places for x in (F.lit(i), typeof(frame.cell(i), frame.columns[i].tag == "#date"))))
        cells = _cells(frame, places).withColumn("_kind", F.element_at(kinds, F.col("_col")))
        counts = cells.groupBy("_spec", "_kind").agg(F.count(F.lit(1)).alias("_n"), F.min(_place(frame, "_col")).alias("_first"))
        usual = counts.withColumn("_r", F.row_number().over(Window.partitionBy("_spec").orderBy(F.desc("_n"), "_first"))).where("_r = 1").select(F.col("_spec").alias("_s"), F.col("_kind").alias("_usual"))
        found = cells.join(usual, F.col("_spec") == F.col("_s")).where("_kind <> _usual")
        return _rows(found.select(*frame.df.columns, "_col", "_value"), "Kind differs from the usual one", F.col("_col"), F.col("_value")).select(*frame.df.columns, *EXTRA)


@dataclass(frozen=True)
class SpellingTest:
    """Rare spellings that are close to a frequent one of their tagspec; none where frequencies vary by more than their mean."""

    pattern: str | TagPattern
    case_sensitive: bool = False

    def violations(self, frame: TagFrame) -> DataFrame:
        places = TagPattern.parse(self.pattern).find(frame.columns)
        if not places:
            return _rows(frame.df.limit(0), "")
        cells = _cells(frame, places)
        norm = nz.norm_space if self.case_sensitive else nz.norm_string
        cells = cells.withColumn("_word", norm(F.col("_value"), T.StringType()))
        counts = cells.groupBy("_spec", "_word").agg(F.count(F.lit(1)).alias("_n"))
        shape = counts.groupBy("_spec").agg(F.avg("_n").alias("_mean"), F.stddev_pop("_n").alias("_sd")).where("_sd / _mean <= 1")
        judged = counts.join(shape, "_spec").withColumn("_rare", F.col("_n") <= F.col("_mean") * RARE)
        good = judged.where("not _rare").select("_spec", F.col("_word").alias("_k"), F.col("_word").alias("_v"))
        best = nearest(judged.where("_rare").select("_spec", "_word"), good, ["_spec"])
        found = cells.join(best, ["_spec", "_word"])
        return _rows(found.select(*frame.df.columns, "_col", "_value", "_best"), "Close to a frequent spelling", F.col("_col"), F.col("_value"), F.col("_best")).select(*frame.df.columns, *EXTRA)


@dataclass(frozen=True)
class OutlierTest:
    """Numbers more than three standard deviations from the mean of their tagspec; the least and the greatest do not count where there are ten or more."""

    pattern: str | TagPattern

    def violations(self, frame: TagFrame) -> DataFrame:
        places = TagPattern.parse(self.pattern).find(frame.columns)
        if not places:
            return _rows(frame.df.limit(0), "")
        items = [F.struct(F.lit(i).alias("_col"), _text(frame, i).alias("_value"), nz.number(F.col(f"c{i}"), frame.type(i)).cast("double").alias("_x"), F.lit(frame.columns[i].sorted_tag).alias("_spec")) for i in places]
        cells = frame.df.select("*", F.explode(F.array(*items)).alias("_c")).select(*frame.df.columns, "_c.*").where("_x is not null")
        raw = cells.groupBy("_spec").agg(F.count("_x").alias("n"), F.avg("_x").alias("m"), F.var_pop("_x").alias("v"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        # Taking x out of n values with mean m and sum of squares q: m' = (n m - x) / (n - 1), q' = q - (x - m)(x - m').
        stats = raw.select("_spec", "n", "lo", "hi", F.col("m").alias("m0"), (F.col("v") * F.col("n")).alias("q0"))
        for k, x in enumerate(("lo", "hi")):
            m, q, n = F.col(f"m{k}"), F.col(f"q{k}"), F.col("n") - k
            new = F.when(F.col("n") >= TRIM_FROM, (n * m - F.col(x)) / (n - 1)).otherwise(m)
            stats = stats.withColumn(f"m{k + 1}", new).withColumn(f"q{k + 1}", F.when(F.col("n") >= TRIM_FROM, q - (F.col(x) - m) * (F.col(x) - F.col(f"m{k + 1}"))).otherwise(q))
        left = F.when(F.col("n") >= TRIM_FROM, F.col("n") - 2).otherwise(F.col("n"))
        stats = stats.select(F.col("_spec").alias("_s"), F.col("m2").alias("_m"), F.sqrt(F.greatest(F.col("q2"), F.lit(0.0)) / left).alias("_sd"))
        stats = stats.where(F.when(F.col("_m") == 0, 0.0).otherwise(F.col("_sd") / F.nullif(F.col("_m"), F.lit(0.0))) <= 1)
        found = cells.join(stats, F.col("_spec") == F.col("_s")).where(F.abs(F.col("_x") - F.col("_m")) > DEVIATIONS * F.col("_sd"))
        return _rows(found.select(*frame.df.columns, "_col", "_value"), "Far from the other numbers", F.col("_col"), F.col("_value")).select(*frame.df.columns, *EXTRA)


@dataclass(frozen=True)
class RequiredTest:
    """Rows with fewer filled cells than low or more than high; one fault of the dataset if there are too few columns."""

    pattern: str | TagPattern
    low: int | None = 1
    high: int | None = None

    def violations(self, frame: TagFrame) -> DataFrame:
        places = TagPattern.parse(self.pattern).find(frame.columns)
        if self.low is not None and len(places) < self.low:
            empty = frame.df.sparkSession.range(1).select(*(_null(f.dataType.simpleString()).alias(f.name) for f in frame.df.schema.fields))
            return _rows(empty, "Not enough columns", scope="dataset")
        filled = F.lit(0)
        for i in places:
            filled = filled + _filled(frame, i).cast("int")
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (filled < self.low)
        if self.high is not None:
            bad = bad | (filled > self.high)
        return _rows(frame.df.where(bad), "Wrong number of values", scope="row")


@dataclass
class Rule:
    pattern: TagPattern
    severity: str = "error"
    description: str | None = None
    tests: list = field(default_factory=list)

    @property
    def rule_id(self) -> str:
        """Name of the rule in reports: depends on all that it says, so equal rules share it."""
        told = {"tags": str(self.pattern), "severity": self.severity, "says": self.description, "tests": [repr(t) for t in self.tests]}
        return "rule-" + hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:12]


#: Tags, severities and kinds of tests of the rules that hold without a schema. The descriptions are free.
_NUMERIC = "#population,#affected,#inneed,#targeted,#reached,#indicator+num,#output+num,#value"
_LISTED = "#org,#sector,#subsector,#status,#beneficiary,#indicator+name,#access,#frequency,#item,#operations,#service,#channel,#modality,#currency,#impact,#group,#severity"
_PLACED = "#region,#country,#adm1,#adm2,#adm3,#adm4,#adm5,#loc"
DEFAULT_RULES = (
    {"#valid_tag": "#date", "#valid_severity": "error", "#valid_datatype": "date"},
    {"#valid_tag": _NUMERIC, "#valid_severity": "error", "#valid_datatype": "number"},
    {"#valid_tag": _NUMERIC, "#valid_severity": "info", "#valid_value+outliers": "true"},
    {"#valid_tag": _LISTED, "#valid_severity": "warning", "#valid_value+case": "true", "#valid_value+spelling": "true", "#description": "Seldom used; compare with similar values"},
    {"#valid_tag": _PLACED, "#valid_severity": "info", "#valid_value+case": "true", "#valid_value+spelling": "true", "#description": "Seldom used; compare with similar values"},
    {"#valid_tag": "#indicator", "#valid_severity": "warning", "#valid_datatype+consistent": "true", "#description": "An indicator should keep to one kind of value"},
    {"#valid_tag": "#*", "#valid_severity": "warning", "#valid_value+whitespace": "true", "#description": "Blanks make equal values look different"},
)


def _true(text: str) -> bool:
    value = (text or "").strip().lower()
    if value in ("", "0", "n", "no", "f", "false"):
        return False
    if value in ("1", "y", "yes", "t", "true"):
        return True
    raise SchemaError(f"neither true nor false: {text!r}")


class _SchemaRow:
    """First filled cell of a schema's row for a pattern."""

    def __init__(self, columns, cells: Sequence[str]) -> None:
        self.columns, self.cells = columns, cells

    def __call__(self, pattern: str) -> str:
        return next((self.cells[i] for i in TagPattern.parse(pattern).find(self.columns) if self.cells[i] not in ("", None)), "")


@dataclass
class Schema:
    rules: list[Rule]
    external: list[tuple[Rule, str]] = field(default_factory=list)

    @staticmethod
    def parse(source=None, spark=None) -> Schema:
        """From a frame whose rows are rules, anything data() reads, or the default rules."""
        from .sources.readers import data, object_rows

        if isinstance(source, Schema):
            return source
        if source is None:
            source = object_rows(DEFAULT_RULES)
        frame = data(source, spark=spark)
        schema = Schema([])
        for cells in frame.rows():
            row = _SchemaRow(frame.columns, cells)
            for pattern in TagPattern.parse_list(row("#valid_tag") or None):
                rule = Rule(pattern, row("#valid_severity") or "error", row("#description") or None)
                schema._add_tests(rule, row)
                schema.rules.append(rule)
        return schema

    def _add_tests(self, rule: Rule, row: _SchemaRow) -> None:
        p, case = rule.pattern, _true(row("#valid_value+case"))
        number = lambda text: int(text) if text else None
        add = rule.tests.append
        if _true(row("#valid_required-min-max")):
            add(RequiredTest(p))
        low, high = number(row("#valid_required+min")), number(row("#valid_required+max"))
        if low is not None or high is not None:
            add(RequiredTest(p, low, high))
        if kind := row("#valid_datatype-consistent"):
            add(DatatypeTest(p, nz.python_norm_string(kind)))
        if row("#valid_value+min") or row("#valid_value+max"):
            add(RangeTest(p, row("#valid_value+min") or None, row("#valid_value+max") or None))
        if _true(row("#valid_value+whitespace")):
            add(WhitespaceTest(p))
        if regex := row("#valid_value+regex"):
            add(RegexTest(p, regex, case))
        if _true(row("#valid_value+spelling")):
            add(SpellingTest(p, case))
        if _true(row("#valid_unique-key")):
            add(UniqueValueTest(p))
        if key := row("#valid_unique+key").strip():
            add(UniqueRowTest(None if key.lower() in ("y", "yes", "t", "true", "1") else key))
        if key := row("#valid_correlation").strip():
            add(CorrelationTest(p, key))
        if _true(row("#valid_datatype+consistent")):
            add(ConsistentDatatypesTest(p))
        if _true(row("#valid_value+outliers")):
            add(OutlierTest(p))
        if allowed := row("#valid_value+list").strip():
            add(EnumerationTest(p, re.split(r"\s*\|\s*", allowed), case))
        if url := row("#valid_value+url").strip():
            self._add_taxonomy(rule, url, row("#valid_value+target_tag"), case)

    def _add_taxonomy(self, rule: Rule, url: str, target: str, case: bool) -> None:
        """Allowed values from another source; without a target tag all its cells are allowed. What cannot be read is reported apart."""
        from .sources.readers import data

        try:
            values = data(url).value_set(target or None)
            some = not values.isEmpty()
        except Exception as e:  # a rule's list may be out of reach; the other rules still hold
            self.external.append((rule, f"list of {url} could not be read: {e}"))
            return
        if some:
            rule.tests.append(ListedTest(rule.pattern, values, case))

    def validate(self, frame: TagFrame) -> Validation:
        parts = []
        hashtag = F.create_map(*(x for i, c in enumerate(frame.columns) for x in (F.lit(i), F.lit(c.display_tag)))) if frame.columns else F.create_map(F.lit(0), F.lit(""))
        for rule in self.rules:
            for test in rule.tests:
                row = F.col(frame.order[-1][0]).cast("long") if frame.order else _null("long")
                parts.append(test.violations(frame).select(
                    F.lit(rule.rule_id).alias("rule_id"), F.lit(str(rule.pattern)).alias("tag_pattern"), F.lit(rule.severity).alias("severity"),
                    F.coalesce(F.lit(rule.description), F.col("_message")).alias("description"), F.col("_scope").alias("scope"), row.alias("row"),
                    F.col("_col").cast("int").alias("col"), F.element_at(hashtag, F.col("_col")).alias("hashtag"), F.col("_value").alias("value"),
                    F.col("_suggestion").alias("suggestion"), F.col("_message").alias("message"),
                ))
        issues = None
        for p in parts:
            issues = p if issues is None else issues.union(p)
        if issues is None:
            kinds = "rule_id string, tag_pattern string, severity string, description string, scope string, row long, col int, hashtag string, value string, suggestion string, message string"
            issues = frame.df.sparkSession.createDataFrame([], kinds)
        return Validation(issues, self.external)


@dataclass
class Validation:
    """A lazy table of issues, and errors of sources that rules name."""

    issues: DataFrame
    external: list[tuple[Rule, str]]

    @property
    def is_valid(self) -> bool:
        """Whether there is no issue of any severity."""
        return self.issues.isEmpty()

    def for_each(self, callback) -> bool:
        """Hand every issue, as a row, to a function on the driver; whether there was none."""
        valid = True
        for issue in self.issues.toLocalIterator():
            valid = False
            callback(issue)
        return valid

    def has_errors(self) -> bool:
        return not self.issues.where("severity = 'error'").isEmpty()

    def report(self) -> dict:
        """A report by rule: issues with their different places, and counts by severity. Collects the issues."""
        rows = self.issues.collect()
        groups: dict[str, list] = {}
        for r in rows:
            groups.setdefault(r.rule_id, []).append(r)
        stats = {"info": 0, "warning": 0, "error": 0, "external": len(self.external), "total": len(self.external)}
        issues = []
        for rule_id, found in groups.items():
            places = list(dict.fromkeys((r.row, r.col, r.hashtag, r.value, r.suggestion) for r in found))
            stats[found[0].severity] = stats.get(found[0].severity, 0) + len(places)
            stats["total"] += len(places)
            names = ("row", "col", "hashtag", "location_value", "suggested_value")
            issues.append({
                "rule_id": rule_id, "tag_pattern": found[0].tag_pattern, "description": found[0].description, "severity": found[0].severity, "scope": found[0].scope,
                "location_count": len(found), "locations": [{n: v for n, v in zip(names, p, strict=True) if v is not None} for p in places],
            })
        external = [{"rule_id": r.rule_id, "tag_pattern": str(r.pattern), "description": text, "severity": r.severity, "scope": "dataset"} for r, text in self.external]
        return {"timestamp": datetime.now(UTC).isoformat(), "is_valid": not rows, "stats": stats, "issues": issues, "external_issues": external}

    def report_json(self) -> str:
        return json.dumps(self.report(), indent=2)


def validate(frame: TagFrame, schema=None) -> Validation:
    return Schema.parse(schema, frame.df.sparkSession).validate(frame)
