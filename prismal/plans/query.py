"""Requests as text: `name.suffix?op&op`, each op a selection or a call.

A selection is a name, an operator and a value: `ix<3`, `a.b =~ x.*`, `name == 'two words'`. A name is made of letters,
digits, underscores and dots between them. Of the operators that the rest may begin with, the longest is taken. A value
ends with the text; within single quotes it may hold anything but these, else anything but commas and parentheses.
A call is a name and arguments in parentheses, which commas part: `uncurry()`, `gbox(-110, 10, -80, 35)`.
"""

from __future__ import annotations

from urllib.parse import unquote_plus

from ..operators.dataset import FDataset
from ..functions.bins import BinGrid

# The operators' spellings.
OPERATORS = (">", ">=", "<", "<=", "=", "==", "!=", "=~", "!=~", "~")
#: After one of these, a single quote opens a quoted value.
_BEFORE_QUOTE = frozenset("<>=~(,")


def _name(text: str) -> tuple[str, str]:
    """The name that a text begins with, and the rest."""
    end = next((i for i, c in enumerate(text) if not (c.isalnum() or c in "_.")), len(text))
    name = text[:end]
    if not all(name.split(".")):
        raise ValueError(f"no name at the beginning of: {text}")
    return name, text[end:].lstrip()


def _split(text: str, at: str) -> list[str]:
    """Parts between separators outside quotes."""
    parts, start, quoted, last = [], 0, False, ","
    for i, c in enumerate(text):
        if quoted:
            quoted = c != "'"
        elif c == "'" and last in _BEFORE_QUOTE:
            quoted = True
        elif c == at:
            parts.append(text[start:i])
            start = i + 1
        if not c.isspace():
            last = c
    if quoted:
        raise ValueError(f"a quote without an end: {text}")
    return [*parts, text[start:]]


def _value(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == "'" and "'" not in text[1:-1]:
        return text[1:-1]
    if not text or text[0] == "'" or not text.isprintable() or any(c in ",()" for c in text):
        raise ValueError(f"no value: {text}")
    return text


def parse_selection(text: str) -> tuple[str, str, str]:
    """(name, operator, value)."""
    name, rest = _name(text.strip())
    op = max((o for o in OPERATORS if rest.startswith(o)), key=len, default=None)
    if op is None:
        raise ValueError(f"no operator after the name: {text}")
    return name, op, _value(rest[len(op) :])


def parse(text: str) -> tuple:
    """("select", name, op, value) or ("call", name, arguments)."""
    name, rest = _name(text.strip())
    if not rest.startswith("("):
        return "select", *parse_selection(text)
    if not rest.endswith(")"):
        raise ValueError(f"no closing parenthesis: {text}")
    inside = rest[1:-1]
    return "call", name, [_value(a) for a in _split(inside, ",")] if inside.strip() else []


def operations(query: str) -> list[tuple]:
    """The operations of a query. An ampersand parts them unless it is within quotes or spelled %26."""
    return [parse(unquote_plus(text)) for text in _split(query, "&") if text.strip()]


def _resample(ds: FDataset, x1, y1, x2, y2, n) -> FDataset:
    return ds.resample(BinGrid.from_extents((float(x1), float(y1)), (float(x2), float(y2)), int(n)))


#: What a request can call; others may be added.
CALLS = {
    "uncurry": lambda ds: ds.uncurry(),
    "curry": lambda ds, n="1": ds.curry(int(n)),
    "gbox": lambda ds, *a: ds.gbox(*map(float, a)),
    "rgbImagePivot": lambda ds, *a: ds.rgb_pivot(*map(float, a)),
    "geoGridResample": _resample,
    "geoSubset": lambda ds, x1, y1, x2, y2, n: ds.geo_subset((float(x1), float(y1)), (float(x2), float(y2)), int(n)),
    "stride": lambda ds, *a: ds.stride(*map(int, a)),
    "contains": lambda ds, name, *a: ds.contains(name, *map(float, a)),
    "groupByVariable": lambda ds, *a: ds.group_by_variable(*a),
    "project": lambda ds, *a: ds.project(*a),
    "rename": lambda ds, name: ds.rename(name),
    "makeRGBImage": lambda ds, *a: ds.make_rgb(*map(float, a)),
    "take": lambda ds, n: ds.take(int(n)),
    "drop": lambda ds, n: ds.drop(int(n)),
}


def apply(ds: FDataset, query: str) -> FDataset:
    for kind, *rest in operations(query):
        if kind == "select":
            ds = ds.select_op(*rest)
        elif rest[0] in CALLS:
            ds = CALLS[rest[0]](ds, *rest[1])
        else:
            raise ValueError(f"no such operation: {rest[0]}")
    return ds


def run_query(request: str, catalog) -> tuple[FDataset, str]:
    """The dataset that a request asks for, and its suffix."""
    path, _, query = request.partition("?")
    name, _, suffix = path.rpartition("/")[2].partition(".")
    return apply(catalog.get(name), query), suffix or "txt"


def respond(request: str, catalog) -> bytes:
    """As a request's suffix says: a PNG image or text."""
    from ..sinks import image, text

    ds, suffix = run_query(request, catalog)
    return image.encode(ds, suffix) if suffix == "png" else text.encode(ds)
