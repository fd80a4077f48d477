"""C source: a lexer, functions with their calls, and a bracket tree.

This stands in for a full parser: features have the same long form (block, feature, count), so tables made by real parsers can be
used in their place.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

# Keywords of C11
KEYWORDS = set(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return "
    "short signed sizeof static struct switch typedef union unsigned void volatile while".split()
)

_TOKEN = re.compile(
    r"""(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<string>L?"(?:[^"\\\n]|\\.)*")|(?P<char>L?'(?:[^'\\\n]|\\.)*')|(?P<directive>^[ \t]*\#(?:[^\n\\]|\\.)*)"""
    r"""|(?P<number>\.?[0-9](?:[eEpP][+-]|[\w.])*)|(?P<word>[A-Za-z_]\w*)|(?P<mark>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|[-+*/%&|^<>=!]=|&&|\|\||\S)|\s+""",
    re.S | re.M | re.X,
)


@dataclass
class Token:
    kind: str
    text: str
    start: int


@dataclass
class Function:
    name: str
    start: int
    end: int
    sha256: str
    calls: list[str] = field(default_factory=list)


def tokens(source: str) -> list[Token]:
    """Tokens without white space; comments stay, keywords have a kind of their own."""
    out = []
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup
        if kind:
            out.append(Token("keyword" if kind == "word" and m.group() in KEYWORDS else kind, m.group(), m.start()))
    return out


def abstract_stream(source: str) -> list[str]:
    """Names as ID, literals as NUM, STR or CHAR, all else as it is; comments left out."""
    names = {"word": "ID", "number": "NUM", "string": "STR", "char": "CHAR"}
    return [names.get(t.kind, t.text.strip()) for t in tokens(source) if t.kind != "comment"]


def functions(source: str) -> list[Function]:
    """Functions defined at the top level: name ( ... ) { ... }, with the names they call."""
    found, code = [], [t for t in tokens(source) if t.kind not in ("comment", "directive")]
    i, begin = 0, 0
    while i < len(code):
        t = code[i].text
        if t in (";", "}"):
            begin = i + 1
        elif t == "{":
            end = _closing(code, i, "{", "}")
            name = _function_name(code[begin:i])
            if name:
                body = code[i : end + 1]
                last = code[min(end, len(code) - 1)]
                text = source[code[begin].start : last.start + len(last.text)]
                calls = sorted({a.text for a, b in zip(body, body[1:], strict=False) if a.kind == "word" and b.text == "("})
                found.append(Function(name, code[begin].start, last.start + len(last.text), hashlib.sha256(text.encode()).hexdigest(), calls))
            i = begin = end + 1
            continue
        i += 1
    return found


def _closing(code: list[Token], at: int, opening: str, closing: str) -> int:
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i].text == opening) - (code[i].text == closing)
        if depth == 0:
            return i
    return len(code) - 1


def _function_name(head: list[Token]) -> str | None:
    for a, b in zip(head, head[1:], strict=False):
        if b.text == "(":
            return a.text if a.kind == "word" else None
        if b.text == "=":
            return None
    return None


def features(source: str) -> dict[tuple[str, str], int]:
    """(block, feature) counts: kinds of tokens and names called, by function or file."""
    spans, counts = functions(source), Counter()
    code = [t for t in tokens(source) if t.kind != "comment"]
    for i, t in enumerate(code):
        owner = next((f.name for f in spans if f.start <= t.start < f.end), None)
        scope = f"function.{owner}" if owner else "file"
        label = t.text if t.kind in ("keyword", "mark") else t.kind
        counts["lexer", f"{scope}.kind.{label}"] += 1
        if owner and t.kind == "word" and i + 1 < len(code) and code[i + 1].text == "(" and t.text != owner:
            counts["lexer", f"{scope}.call.{t.text}"] += 1
    return dict(counts)


def descriptors(source: str) -> dict[str, int]:
    """Fixed arrays declared in functions, and subscripts."""
    out = Counter(fixed_arrays=0, subscripts=0)
    for f in functions(source):
        code = [t for t in tokens(source[f.start : f.end]) if t.kind != "comment"]
        for i, t in enumerate(code):
            if t.text == "[" and i and code[i - 1].kind == "word":
                declared = i > 1 and (code[i - 2].kind in ("keyword", "word") or code[i - 2].text == "*")
                sized = i + 1 < len(code) and code[i + 1].kind in ("number", "word")
                out["fixed_arrays" if declared and sized else "subscripts"] += 1
    return dict(out)


def tree(source: str) -> tuple:
    """A tree of the brackets: a node is (label, children), a leaf a token of the abstract stream."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    root: tuple = ("file", [])
    stack = [(root, "")]
    for label in abstract_stream(source):
        if label in pairs:
            node: tuple = (label, [])
            stack[-1][0][1].append(node)
            stack.append((node, pairs[label]))
        elif len(stack) > 1 and label == stack[-1][1]:
            stack.pop()
        else:
            stack[-1][0][1].append((label, []))
    return root


def tree_size(node: tuple) -> int:
    size, stack = 0, [node]
    while stack:
        size += 1
        stack.extend(stack.pop()[1])
    return size


def tree_edit_distance(a: tuple, b: tuple) -> int:
    """Least number of nodes to insert, delete or rename, with the order of children kept."""

    def numbered(root: tuple):
        labels, first, keyroots = [], [], {}

        def visit(node: tuple) -> int:
            low = None
            for child in node[1]:
                leftmost = visit(child)
                low = leftmost if low is None else low
            labels.append(node[0])
            low = len(labels) - 1 if low is None else low
            first.append(low)
            keyroots[low] = len(labels) - 1
            return low

        visit(root)
        return labels, first, sorted(keyroots.values())

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
    (la, fa, ka), (lb, fb, kb) = numbered(a), numbered(b)
    best = [[0] * len(lb) for _ in la]
    for i in ka:
        for j in kb:
            rows, columns = i - fa[i] + 2, j - fb[j] + 2
            d = [[0] * columns for _ in range(rows)]
            for x in range(1, rows):
                d[x][0] = x
            d[0] = list(range(columns))
            for x in range(1, rows):
                for y in range(1, columns):
                    p, q = fa[i] + x - 1, fb[j] + y - 1
                    step = min(d[x - 1][y], d[x][y - 1]) + 1
                    if fa[p] == fa[i] and fb[q] == fb[j]:
                        d[x][y] = min(step, d[x - 1][y - 1] + (la[p] != lb[q]))
                        best[p][q] = d[x][y]
                    else:
                        d[x][y] = min(step, d[fa[p] - fa[i]][fb[q] - fb[j]] + best[p][q])
    return best[-1][-1]


def tree_distance(a: str, b: str, max_nodes: int = 20_000) -> float | None:
    """Edit distance of the bracket trees over the larger size, 1 at most; None above max_nodes."""
    x, y = tree(a), tree(b)
    largest = max(tree_size(x), tree_size(y))
    return None if largest > max_nodes else min(1.0, tree_edit_distance(x, y) / largest)
