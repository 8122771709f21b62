"""One command with a sub-command for each operator: python -m tagloom.cli count -t '#adm1' data.csv"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from .frame import TagFrame
from .plans.recipe import from_spec
from .sources import sinks
from .sources.readers import InputOptions, data, info, raw_rows
from .sources.tagger import tag_rows
from .validation import Schema

_COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(name: str, arguments: Callable[[argparse.ArgumentParser], None]):
    def register(run):
        _COMMANDS[name] = (arguments, run)
        return run

    return register


def _flag(p, *names, **options):
    p.add_argument(*names, **options)


def _list(text: str) -> list[str]:
    return [t for t in text.split(",") if t.strip()]


def _options(a) -> InputOptions:
    headers = dict(h.split(":", 1) for h in a.http_header or [])
    return InputOptions(allow_local=True, sheet_index=a.sheet, selector=a.selector, encoding=a.encoding, http_headers=headers, verify_ssl=not a.ignore_certs, expand_merged=a.expand_merged)


def _other(a, name: str) -> TagFrame:
    return data(name, InputOptions(allow_local=True))


def _q(p):
    _flag(p, "-q", "--query", action="append", default=[])


@command("add", lambda p: (_flag(p, "-s", "--spec", action="append", required=True), _flag(p, "-b", "--before", action="store_true")))
def _(f, a):
    return f.add_columns(a.spec, a.before)


@command("append", lambda p: (_flag(p, "-a", "--append", action="append", default=[]), _flag(p, "-l", "--list"), _flag(p, "-x", "--exclude-extra-columns", action="store_true"), _q(p)))
def _(f, a):
    f = f.append([_other(a, s) for s in a.append], not a.exclude_extra_columns, a.query) if a.append else f
    return f.append_external_list(_other(a, a.list), not a.exclude_extra_columns, a.query) if a.list else f


def _clean_arguments(p):
    for short, name in (("-w", "whitespace"), ("-u", "upper"), ("-l", "lower"), ("-d", "date"), ("-n", "number"), ("--latlon", "latlon")):
        _flag(p, *((short,) if short.startswith("--") else (short, f"--{name}")), dest=name)
    _flag(p, "--date-format")
    _flag(p, "--number-format")
    _flag(p, "-p", "--purge", action="store_true")
    _q(p)


@command("clean", _clean_arguments)
def _(f, a):
    return f.clean_data(whitespace=a.whitespace, upper=a.upper, lower=a.lower, date=a.date, number=a.number, latlon=a.latlon, date_format=a.date_format, number_format=a.number_format, purge=a.purge, queries=a.query)


@command("count", lambda p: (_flag(p, "-t", "--tags", type=_list, default=None), _flag(p, "-a", "--aggregator", action="append"), _q(p)))
def _(f, a):
    return f.count(a.tags, a.aggregator, a.query)


@command("cut", lambda p: (_flag(p, "-i", "--include", type=_list), _flag(p, "-x", "--exclude", type=_list), _flag(p, "-s", "--skip-untagged", action="store_true")))
def _(f, a):
    return f.with_columns(a.include) if a.include else f.without_columns(a.exclude, a.skip_untagged)


@command("dedup", lambda p: (_flag(p, "-t", "--tags", type=_list), _q(p)))
def _(f, a):
    return f.dedup(a.tags, a.query)


@command("hash", lambda p: _flag(p, "-H", "--headers-only", action="store_true"))
def _(f, a):
    print(sinks.columns_hash(f) if a.headers_only else sinks.data_hash(f), file=a.out)


@command("merge", lambda p: (_flag(p, "-m", "--merge", required=True), _flag(p, "-k", "--keys", type=_list, required=True), _flag(p, "-t", "--tags", type=_list, required=True), _flag(p, "-r", "--replace", action="store_true"), _flag(p, "-O", "--overwrite", action="store_true"), _q(p)))
def _(f, a):
    return f.merge_data(_other(a, a.merge), a.keys, a.tags, a.replace, a.overwrite, a.query)


@command("rename", lambda p: _flag(p, "-r", "--rename", action="append", required=True))
def _(f, a):
    return f.rename_columns(a.rename)


@command("replace", lambda p: (_flag(p, "-p", "--pattern"), _flag(p, "-s", "--substitution", default=""), _flag(p, "-t", "--tags", type=_list), _flag(p, "-r", "--regex", action="store_true"), _flag(p, "-m", "--map"), _q(p)))
def _(f, a):
    f = f.replace_data_map(_other(a, a.map), a.query) if a.map else f
    return f.replace_data(a.pattern, a.substitution, a.tags, a.regex, a.query) if a.pattern else f


@command("fill", lambda p: (_flag(p, "-t", "--tag", action="append"), _q(p)))
def _(f, a):
    return f.fill_data(a.tag, a.query)


@command("expand", lambda p: (_flag(p, "-t", "--tags", type=_list), _flag(p, "-s", "--separator", default="|"), _flag(p, "-c", "--correlate", action="store_true"), _q(p)))
def _(f, a):
    return f.expand_lists(a.tags, a.separator, a.correlate, a.query)


@command("explode", lambda p: (_flag(p, "-H", "--header-att", default="label"), _flag(p, "-V", "--value-att", default="value")))
def _(f, a):
    return f.explode(a.header_att, a.value_att)


@command("implode", lambda p: (_flag(p, "-L", "--label", required=True), _flag(p, "-V", "--value", required=True)))
def _(f, a):
    return f.implode(a.label, a.value)


@command("jsonpath", lambda p: (_flag(p, "-p", "--path", required=True), _flag(p, "-t", "--tags", type=_list), _q(p)))
def _(f, a):
    return f.jsonpath(a.path, a.tags, a.query)


@command("select", lambda p: (_q(p), _flag(p, "-r", "--reverse", action="store_true")))
def _(f, a):
    return f.without_rows(a.query) if a.reverse else f.with_rows(a.query)


@command("sort", lambda p: (_flag(p, "-t", "--tags", type=_list), _flag(p, "-r", "--reverse", action="store_true")))
def _(f, a):
    return f.sort(a.tags, a.reverse)


@command("validate", lambda p: (_flag(p, "-s", "--schema"), _flag(p, "-e", "--error-level", choices=["info", "warning", "error"], default="info")))
def _(f, a):
    result = Schema.parse(_other(a, a.schema) if a.schema else None, f.df.sparkSession).validate(f)
    print(result.report_json(), file=a.out)
    return 1 if result.has_errors() else 0


def _write(frame: TagFrame, a) -> None:
    lines = sinks.json_lines(frame, not a.strip_headers, not a.strip_tags, a.objects) if a.json or a.objects else sinks.csv_lines(frame, not a.strip_headers, not a.strip_tags)
    a.out.writelines(lines)


def main(argv: Sequence[str] | None = None, out=None) -> int:
    parser = argparse.ArgumentParser(prog="tagloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("info", "spec", "tag", *_COMMANDS):
        p = commands.add_parser(name)
        p.add_argument("input")
        for flag, options in (("--sheet", {"type": int}), ("--selector", {}), ("--encoding", {}), ("--http-header", {"action": "append"})):
            p.add_argument(flag, **options)
        for flag in ("--ignore-certs", "--expand-merged", "--json", "--objects", "--strip-headers", "--strip-tags"):
            p.add_argument(flag, action="store_true")
        if name == "tag":
            p.add_argument("-m", "--map", action="append", required=True, help="Header text#tagspec")
            p.add_argument("-d", "--default-tag")
            p.add_argument("-a", "--match-all", action="store_true")
        elif name in _COMMANDS:
            _COMMANDS[name][0](p)
    a = parser.parse_args(argv)
    a.out = out or sys.stdout
    options = _options(a)
    source = sys.stdin.buffer if a.input == "-" else a.input
    if a.command == "info":
        print(json.dumps(info(source, options), indent=2), file=a.out)
        return 0
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if a.command == "spec":
        with open(a.input, encoding="utf-8") as f:
            frame = from_spec(f.read(), options, spark)
    elif a.command == "tag":
        specs = [(m.partition("#")[0], "#" + m.partition("#")[2]) for m in a.map]
        frame = tag_rows(spark, raw_rows(source, options), specs, a.default_tag, a.match_all)
    else:
        done = _COMMANDS[a.command][1](data(source, options, spark), a)
        if not isinstance(done, TagFrame):
            return done or 0
        frame = done
    _write(frame, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
