"""Reading frames from arrays, files, archives, workbooks, streams and the web.

Small sources (one file, read whole) are parsed on the driver and checked for a row of hashtags. Large ones belong in
Parquet, or in CSV that Spark reads itself: read_csv() looks only at the first rows on the driver.
"""

from __future__ import annotations

import csv
import hashlib
import io
import ipaddress
import json
import os
import re
import urllib.error
import urllib.request
import zipfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import AuthorizationError, HTMLSourceError, SourceError, TagsNotFoundError
from ..frame import TagFrame, order_name
from ..functions.json_path import evaluate
from ..operators.cells import flatten
from ..plans.patterns import TagColumn, tags_of
from .workbook import read_sheet, sheets

#: Delimiters tried, bytes looked at for them, rows looked at for hashtags.
DELIMITERS, SNIFF_BYTES, HEAD_ROWS = ",\t;:|", 16384, 25
TEXT_TYPES = ("", ".csv", ".tsv", ".ssv", ".txt", ".text")


@dataclass(frozen=True)
class InputOptions:
    allow_local: bool = False
    sheet_index: int | None = None
    timeout: float | None = None
    verify_ssl: bool = True
    http_headers: dict[str, str] = field(default_factory=dict)
    selector: str | None = None
    encoding: str | None = None
    expand_merged: bool = False
    scan_resources: bool = False


def session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def is_list_of_sources(source: object) -> bool:
    """Whether a list names several sources: its first item is a text, a mapping or a frame. A list of lists is one table."""
    return isinstance(source, (list, tuple)) and bool(source) and isinstance(source[0], (str, dict, TagFrame))


def data(source, options: InputOptions | None = None, spark: SparkSession | None = None) -> TagFrame:
    """A frame of anything: a frame, a spec {"input": ...}, rows, an open file, bytes, a path or a URL."""
    if isinstance(source, TagFrame):
        return source
    if isinstance(source, dict) and source.get("input"):
        from ..plans.recipe import from_spec

        return from_spec(source, options=options, spark=spark)
    return TagFrame.from_rows(session(spark), raw_rows(source, options))


def raw_rows(source, options: InputOptions | None = None) -> list[list[object]]:
    """Rows of a source before any look for hashtags."""
    options = options or InputOptions()
    if isinstance(source, (list, tuple)):
        if source and all(isinstance(r, dict) for r in source):
            return object_rows(source)
        return [list(r) for r in source]
    if hasattr(source, "read"):
        content = source.read()
        return parse(content.encode("utf-8") if isinstance(content, str) else content, "", options)
    if isinstance(source, bytes):
        return parse(source, "", options)
    content, kind, encoding = fetch(str(source), options)
    return parse(content, kind, options, encoding)


def fetch(name: str, options: InputOptions) -> tuple[bytes, str, str | None]:
    """(content, extension, encoding) of a URL or, if allowed, a local file."""
    parts = urlsplit(name)
    if parts.scheme in ("http", "https"):
        return _fetch_url(rewrite_url(name), options)
    if parts.scheme not in ("", "file"):
        raise SourceError(f"cannot read {parts.scheme} sources: {name}")
    if not options.allow_local:
        raise SourceError(f"local files are not allowed: {name}")
    path = parts.path if parts.scheme == "file" else name
    with open(path, "rb") as f:
        return f.read(), os.path.splitext(path)[1].lower(), None


def check_host(name: str, options: InputOptions) -> None:
    """Refuse addresses of this machine and its network, which a recipe from elsewhere could otherwise reach."""
    host = (urlsplit(name).hostname or "").lower()
    try:
        ipaddress.ip_address(host)
        local = True
    except ValueError:
        local = host in ("", "localhost") or host.endswith((".localhost", ".localdomain", ".local"))
    if local and not options.allow_local:
        raise SourceError(f"local addresses are not allowed: {name}")


def _fetch_url(url: str, options: InputOptions) -> tuple[bytes, str, str | None]:
    import ssl

    check_host(url, options)
    context = ssl.create_default_context()
    if not options.verify_ssl:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=dict(options.http_headers)), timeout=options.timeout, context=context) as r:
            kind = {"application/json": ".json", "text/html": ".html", "text/csv": ".csv"}.get(r.headers.get_content_type(), os.path.splitext(urlsplit(url).path)[1].lower())
            return r.read(), kind, r.headers.get_content_charset()
    except urllib.error.HTTPError as e:
        if e.code in (401, 403):
            raise AuthorizationError(f"not allowed to read {url}") from e
        raise SourceError(f"cannot read {url}: {e}") from e
    except OSError as e:
        raise SourceError(f"cannot read {url}: {e}") from e


#: Pages that show a table, and where its data are.
_PAGES = (
    (re.compile(r"https?://docs\.google\.com/spreadsheets/d/(?P<id>[^/]+)/(?!.*pub)(?:.*gid=(?P<gid>\d+))?.*"), lambda m: f"https://docs.google.com/spreadsheets/d/{m['id']}/export?format=csv" + (f"&gid={m['gid']}" if m["gid"] else "")),
    (re.compile(r"https?://drive\.google\.com/file/d/(?P<id>[^/]+)/.*"), lambda m: f"https://drive.google.com/uc?export=download&id={m['id']}"),
    (re.compile(r"https?://(?:www\.)?dropbox\.com/s/(?P<id>[^/]+)/(?P<name>[^?]+)(?:\?.*)?"), lambda m: f"https://www.dropbox.com/s/{m['id']}/{m['name']}?dl=1"),
)


def rewrite_url(url: str) -> str:
    """The address of the data behind a page's address; no request is made."""
    parts = urlsplit(url)
    if parts.hostname == "drive.google.com" and parts.path == "/open" and (found := parse_qs(parts.query).get("id")):
        return f"https://drive.google.com/uc?export=download&id={found[0]}"
    return next((make(m) for pattern, make in _PAGES if (m := pattern.fullmatch(url))), url)


def parse(content: bytes, kind: str, options: InputOptions, encoding: str | None = None) -> list[list[object]]:
    """Rows of a file's content by its first bytes, or else its extension."""
    encoding = options.encoding or encoding or "utf-8-sig"
    start = content[:512].lstrip().lower()
    if kind == ".html" or start.startswith((b"<!doctype html", b"<html")):
        raise HTMLSourceError("the source is a web page; is the data public?")
    if content[:4] == b"PK\x03\x04":
        return _archive_rows(content, options, encoding)
    if content[:4] == b"\xd0\xcf\x11\xe0":
        raise SourceError("old binary workbooks cannot be read; save as XLSX")
    if kind == ".json" or start[:1] in (b"[", b"{"):
        return json_rows(json.loads(content.decode(encoding, errors="replace")), options.selector)
    if kind not in TEXT_TYPES:
        raise SourceError(f"cannot read files of type {kind}")
    return csv_rows(content.decode(encoding, errors="replace"))


def _archive_rows(content: bytes, options: InputOptions, encoding: str) -> list[list[object]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if "xl/workbook.xml" in names:
            return workbook_rows(content, options)
        name = next((n for n in names if n.lower().endswith(".csv")), None)
        if name is None:
            raise SourceError("no CSV file or workbook in the archive")
        return csv_rows(z.read(name).decode(encoding, errors="replace"))


def workbook_rows(content: bytes, options: InputOptions) -> list[list[object]]:
    """Rows of the sheet asked for, else of the first with hashtags, else of the first."""
    if options.sheet_index is not None:
        return read_sheet(content, options.sheet_index, options.expand_merged)
    for i in range(len(sheets(content))):
        rows = read_sheet(content, i, options.expand_merged)
        if any(tags_of(r) for r in rows[:HEAD_ROWS]):
            return rows
    return read_sheet(content, 0, options.expand_merged)


def sniff_delimiter(sample: str) -> str:
    """The delimiter that makes a row of hashtags, else the most frequent one."""
    for line in sample.splitlines():
        if "#" in line:
            for d in DELIMITERS:
                if tags_of(next(csv.reader([line], delimiter=d), [])):
                    return d
    return max(DELIMITERS, key=sample.count)


def csv_rows(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=sniff_delimiter(text[:SNIFF_BYTES])))


def object_rows(objects: Iterable[dict]) -> list[list[object]]:
    objects = list(objects)
    names = list(dict.fromkeys(k for o in objects for k in o))
    return [names, *([flatten(o.get(n)) for n in names] for o in objects)]


def _table(value: object) -> list[list[object]] | None:
    if not isinstance(value, list) or not value:
        return None
    if all(isinstance(r, list) for r in value):
        return [[flatten(c) for c in r] for r in value]
    return object_rows(value) if all(isinstance(r, dict) for r in value) else None


def json_rows(value: object, selector: str | None = None) -> list[list[object]]:
    """Rows of the first table within a JSON value, from outside in: a list of lists or a list of objects. A selector, a name or a JSONPath, says where to look."""
    if selector:
        found = evaluate(selector, value) if selector.startswith("$") else [value[selector]] if isinstance(value, dict) and selector in value else []
        if not found:
            raise SourceError(f"the selector {selector!r} finds nothing")
        value = found[0] if len(found) == 1 else found
    level = [value]
    while level:
        tables = [t for t in map(_table, level) if t]
        best = next((t for t in tables if any(tags_of(r) for r in t[:HEAD_ROWS])), tables[0] if tables else None)
        if best:
            return best
        level = [c for v in level for c in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()) if isinstance(c, (dict, list))]
    raise SourceError("no table in the JSON data")


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", multi_line: bool = True) -> TagFrame:
    """Large CSV, a file or a folder of files that each begin with the same hashtags, on any file system that Spark reads.

    Only the first rows of one file come to the driver; cells are text. multi_line: whether quoted cells may hold line
    breaks; without, large files are split among tasks. Rows are ordered by file and place in it. Rows up to the first
    row of hashtags go in each file; a file without such a row keeps all of its rows.
    """
    lines = spark.read.option("encoding", encoding).text(path).select("value", F.col("_metadata.file_path").alias("file")).limit(HEAD_ROWS).collect()
    head = [r.value or "" for r in lines if r.file == lines[0].file]
    sep = sep or sniff_delimiter("\n".join(head))
    rows = list(csv.reader(head, delimiter=sep))
    at, columns = next(((i, c) for i, r in enumerate(rows) if (c := tags_of(r, rows[i - 1] if i else None))), (None, None))
    if columns is None:
        raise TagsNotFoundError(f"no row of hashtags in the first {HEAD_ROWS} rows of {path}")
    names = [f"c{i}" for i in range(len(columns))]
    df = spark.read.csv(path, sep=sep, schema=", ".join(f"{n} string" for n in names), header=False, multiLine=multi_line, escape='"', encoding=encoding)
    file, start, place = (order_name() for _ in range(3))
    # Rows of a block are numbered in order; the first block of a file has its head.
    df = df.select(
        *(F.coalesce(F.col(n), F.lit("")).alias(n) for n in names), F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(start), F.monotonically_increasing_id().alias(place)
    )
    tags = [c.strip() for c in (*rows[at], *[""] * len(columns))][: len(columns)]
    is_tags = (F.col(start) == 0) & F.forall(F.array(*(F.trim(n) == t for n, t in zip(names, tags, strict=True))), lambda x: x)
    heads = df.where(is_tags).groupBy(F.col(file).alias("_f")).agg(F.min(place).alias("_at"))  # a row a file
    kept = df.join(heads, F.col(file) == F.col("_f"), "left").where(F.col("_at").isNull() | (F.col(start) > 0) | (F.col(place) > F.col("_at"))).drop("_f", "_at")
    return TagFrame(tuple(columns), kept, ((file, True), (start, True), (place, True)))


def info(source, options: InputOptions | None = None) -> list[dict[str, object]]:
    """For each sheet (or the one table): name, rows, columns, whether it has hashtags, headers, tags, and an MD5 of the headers."""
    options = options or InputOptions()
    content = None
    if isinstance(source, bytes):
        content = source
    elif isinstance(source, str):
        content, _, _ = fetch(source, options)
    if content is not None and content[:4] == b"PK\x03\x04" and "xl/workbook.xml" in zipfile.ZipFile(io.BytesIO(content)).namelist():
        tables = [(name, read_sheet(content, i, options.expand_merged)) for i, name in enumerate(sheets(content))]
    else:
        tables = [("__DEFAULT__", raw_rows(content if content is not None else source, options))]
    return [_described(name, rows) for name, rows in tables]


def _described(name: str, rows: Sequence[Sequence[object]]) -> dict[str, object]:
    at = next((i for i, r in enumerate(rows[:HEAD_ROWS]) if tags_of(r)), None)
    headers = [str(c) for c in (rows[at - 1] if at else rows[0] if rows and at is None else [])]
    columns: list[TagColumn] = (tags_of(rows[at], headers) or []) if at is not None else []
    return {
        "name": name,
        "is_tagged": at is not None,
        "nrows": len(rows),
        "ncols": max(map(len, rows), default=0),
        "headers": headers,
        "tags": [c.display_tag for c in columns],
        "header_hash": hashlib.md5("\x1f".join(" ".join(h.split()) for h in headers).encode()).hexdigest(),
    }
