"""A small JSONPath: names, places, slices, wildcards, descent and comparisons."""

from __future__ import annotations

import json
import re

_STEP = re.compile(
    r"""(?P<deep>\.\.)?\.?(?:(?P<name>[A-Za-z_][\w-]*)|(?P<star>\*)|\[\s*(?:(?P<quoted>'[^']*'|"[^"]*")|(?P<index>-?\d+)|(?P<all>\*)
    |(?P<slice>-?\d*:-?\d*(?::-?\d+)?)|\?\(\s*(?P<filter>.+?)\s*\))\s*\])""",
    re.VERBOSE,
)
_TEST = re.compile(r"@(?P<path>(?:\.[A-Za-z_][\w-]*|\[[^\]]+\])*)\s*(?:(?P<op>==|!=|<=|>=|<|>|=)\s*(?P<value>.+))?")


def is_simple(path: str) -> bool:
    """Whether a path is only names and places, which Spark's own function reads."""
    return re.fullmatch(r"\$(?:\.[A-Za-z_]\w*|\[\d+\])+", path) is not None


def steps(path: str) -> list[dict]:
    text, out, at = path.strip().removeprefix("$"), [], 0
    while at < len(text):
        m = _STEP.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read JSONPath at {text[at:]!r}")
        out.append(m.groupdict())
        at = m.end()
    return out


def _children(value: object) -> list:
    return list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []


def _below(value: object) -> list:
    return [value, *(x for c in _children(value) for x in _below(c))]


def _passes(value: object, test: str) -> bool:
    m = _TEST.fullmatch(test)
    if not m:
        raise ValueError(f"cannot read condition {test!r}")
    found = evaluate("$" + m["path"], value)
    if not m["op"]:
        return bool(found)
    text = m["value"].strip()
    other = text[1:-1] if text[:1] in "'\"" else json.loads(text)
    for x in found:
        try:
            if {"==": x == other, "=": x == other, "!=": x != other}.get(m["op"]) or (m["op"] in "<=>=" and eval_order(x, m["op"], other)):
                return True
        except TypeError:
            continue
    return False


def eval_order(a, op: str, b) -> bool:
    return {"<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b}.get(op, lambda: False)()


def evaluate(path: str, value: object) -> list:
    """Everything that a path finds, in order."""
    found = [value]
    for s in steps(path):
        found = [x for v in found for x in _below(v)] if s["deep"] else found
        out: list = []
        for v in found:
            name = s["name"] or (s["quoted"] or "")[1:-1]
            if s["name"] or s["quoted"]:
                if isinstance(v, dict) and name in v:
                    out.append(v[name])
            elif s["index"]:
                if isinstance(v, list) and -len(v) <= int(s["index"]) < len(v):
                    out.append(v[int(s["index"])])
            elif s["slice"]:
                out += v[slice(*(int(x) if x else None for x in s["slice"].split(":")))] if isinstance(v, list) else []
            elif s["filter"]:
                out += [c for c in _children(v) if _passes(c, s["filter"])]
            else:
                out += _children(v)
        found = out
    return found
