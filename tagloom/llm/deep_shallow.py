"""Deep-shallow string sorting: multikey quicksort to a shallow depth, blind tries for what still agrees there."""

from __future__ import annotations

from .common import ship

ship(__name__)

#: Depth in bytes at which multikey quicksort hands over, and the bytes that it compares at once.
SHALLOW, STEP = 192, 8


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix; the first `start` bytes are known to agree."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Node:
    """Inner node of a blind trie: all strings below agree on `depth` bytes and differ in the next; -1 is their end."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int) -> None:
        self.depth, self.children = depth, {}


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def _blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[list[int]]:
    """Sorted classes of equal strings. A string goes down by branching bytes alone, is compared once with the string found there, and is hung in where they part."""
    root: _Node | list[int] = [group[0]]
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node, _Node):
            node = node.children.get(_byte(s, node.depth)) or next(iter(node.children.values()))
        other = strings[node[0]]
        shared = common_prefix(s, other, depth)
        if shared == len(s) == len(other):
            node.append(i)
            continue
        parent, node = None, root
        while isinstance(node, _Node) and node.depth < shared:
            parent, node = node, node.children[_byte(s, node.depth)]
        if isinstance(node, _Node) and node.depth == shared:
            node.children[_byte(s, shared)] = [i]
            continue
        fork = _Node(shared)
        fork.children = {_byte(other, shared): node, _byte(s, shared): [i]}
        if parent is None:
            root = fork
        else:
            parent.children[_byte(s, parent.depth)] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.children[b] for b in sorted(node.children, reverse=True)]
        else:
            out.append(node)
    return out


def deep_shallow_sort(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Sorted order of strings, which agree on their first `depth` bytes, and the common prefix of each with the one before it (0 for the first)."""
    classes: list[list[int]] = []
    stack = [(list(range(len(strings))), depth)] if strings else []
    while stack:
        group, d = stack.pop()
        if len(group) == 1:
            classes.append(group)
        elif d >= shallow or len(group) == 2:
            classes += _blind_trie(strings, group, d)
        else:
            pivot = strings[group[len(group) // 2]][d : d + STEP]
            less = [i for i in group if strings[i][d : d + STEP] < pivot]
            same = [i for i in group if strings[i][d : d + STEP] == pivot]
            more = [i for i in group if strings[i][d : d + STEP] > pivot]
            if len(pivot) < STEP:  # strings that end here are equal
                parts = [(less, d), (same, shallow), (more, d)]
            else:
                parts = [(less, d), (same, d + STEP), (more, d)]
            stack += [p for p in reversed(parts) if p[0]]
    order = [i for c in classes for i in c]
    prefix = [0] + [common_prefix(strings[a], strings[b], min(depth, len(strings[a]), len(strings[b]))) for a, b in zip(order, order[1:], strict=False)]
    return order, prefix
