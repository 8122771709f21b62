"""Recipes: operators written down as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

from ..errors import RecipeError
from ..frame import TagFrame

_REQUIRED = object()


class _Args:
    """Arguments of a step; null counts as missing."""

    def __init__(self, step: dict) -> None:
        self.step = step

    def __call__(self, name: str, default: object = _REQUIRED):
        value = self.step.get(name)
        if value is None:
            if default is _REQUIRED:
                raise RecipeError(f"step {self.step.get('filter')!r} needs {name!r}")
            return default
        return value


#: filter -> how a frame takes it. Add steps here.
STEPS: dict[str, Callable[[TagFrame, _Args, object], TagFrame]] = {
    "add_columns": lambda f, a, o: f.add_columns(a("specs"), bool(a("before", False))),
    "append": lambda f, a, o: f.append(_sources(a("append_sources"), o), bool(a("add_columns", True)), a("queries", None)),
    "append_external_list": lambda f, a, o: f.append_external_list(_source(a("source_list_url"), o), bool(a("add_columns", True)), a("queries", None)),
    "cache": lambda f, a, o: f.cache(a("max_rows", None)),
    "clean_data": lambda f, a, o: f.clean_data(
        **{k: a(k, None) for k in ("whitespace", "upper", "lower", "date", "number", "latlon", "date_format", "number_format", "queries")}, purge=bool(a("purge", False))
    ),
    "count": lambda f, a, o: f.count(a("patterns", None), a("aggregators", None), a("queries", None)),
    "dedup": lambda f, a, o: f.dedup(a("patterns", None), a("queries", None)),
    "expand_lists": lambda f, a, o: f.expand_lists(a("patterns", None), a("separator", "|"), bool(a("correlate", False)), a("queries", None)),
    "explode": lambda f, a, o: f.explode(a("header_attribute", "header"), a("value_attribute", "value")),
    "fill_data": lambda f, a, o: f.fill_data(a("patterns", None) or a("pattern", None), a("queries", None)),
    "implode": lambda f, a, o: f.implode(a("label_pattern"), a("value_pattern")),
    "jsonpath": lambda f, a, o: f.jsonpath(a("path"), a("patterns", None), a("queries", None), bool(a("use_json", True))),
    "merge_data": lambda f, a, o: f.merge_data(_source(a("merge_source"), o), a("keys"), a("tags"), bool(a("replace", False)), bool(a("overwrite", False)), a("queries", None)),
    "rename_columns": lambda f, a, o: f.rename_columns(a("specs")),
    "replace_data": lambda f, a, o: f.replace_data(a("original"), a("replacement"), a("pattern", None), bool(a("use_regex", False)), a("queries", None)),
    "replace_data_map": lambda f, a, o: f.replace_data_map(_source(a("map_source"), o), a("queries", None)),
    "sort": lambda f, a, o: f.sort(a("keys", None) or a("tags", None), bool(a("reverse", False))),
    "with_columns": lambda f, a, o: f.with_columns(a("includes")),
    "with_rows": lambda f, a, o: f.with_rows(a("queries"), a("mask", None)),
    "without_columns": lambda f, a, o: f.without_columns(a("excludes", None), bool(a("skip_untagged", False))),
    "without_rows": lambda f, a, o: f.without_rows(a("queries"), a("mask", None)),
}


def _source(source, options) -> TagFrame:
    from ..sources.readers import data

    return data(source, options)


def _sources(source, options) -> list[TagFrame]:
    from ..sources.readers import is_list_of_sources

    return [_source(s, options) for s in source] if is_list_of_sources(source) else [_source(source, options)]


def from_recipe(frame: TagFrame, recipe, options=None) -> TagFrame:
    """Apply steps, each {"filter": name, ...}: JSON text, one step or a list."""
    steps = json.loads(recipe) if isinstance(recipe, str) else recipe
    for step in [steps] if isinstance(steps, dict) else steps:
        name = step.get("filter")
        if name not in STEPS:
            raise RecipeError(f"unknown step {name!r}")
        frame = STEPS[name](frame, _Args(step), options)
    return frame


def from_spec(spec, options=None, spark=None) -> TagFrame:
    """A frame from {"input": source, options..., "tagger": {...}, "recipe": [...]}."""
    from ..sources.readers import InputOptions, data, raw_rows, session
    from ..sources.tagger import tag_rows

    spec = json.loads(spec) if isinstance(spec, str) else spec
    if not spec.get("input"):
        raise RecipeError("a spec needs 'input'")
    known = {k: spec[k] for k in ("sheet_index", "timeout", "verify_ssl", "http_headers", "selector", "encoding", "expand_merged") if spec.get(k) is not None}
    base = options or InputOptions()
    merged = InputOptions(**{**base.__dict__, **known, "allow_local": base.allow_local and bool(spec.get("allow_local", True))})
    if tagger := spec.get("tagger"):
        rows = raw_rows(spec["input"], merged)
        frame = tag_rows(session(spark), rows, tagger["specs"], tagger.get("default_tag"), bool(tagger.get("match_all", False)))
    else:
        frame = data(spec["input"], merged, spark)
    return from_recipe(frame, spec.get("recipe") or [], merged)
