"""JSON of any depth: the standard parser where it can, an explicit stack where it gives up."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from json.encoder import encode_basestring

_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:"])|(-?(?:0|[1-9][0-9]*))((?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_NAMED = {"true": True, "false": False, "null": None}


def _constant(name: str):
    raise ValueError(f"{name} is not JSON")


def whole_number(s: str):
    return int(s) if len(s) < 4000 else s  # beyond, Python refuses; its digits are kept as text


_strict = json.JSONDecoder(parse_constant=_constant, parse_int=whole_number)
_lenient = json.JSONDecoder(parse_int=whole_number)


def loads(text: str, strict: bool = False):
    """The value of ``text``; ValueError if it is no JSON.  ``strict`` refuses NaN and the like."""
    try:
        return (_strict if strict else _lenient).decode(text)
    except RecursionError:
        return loads_deep(text)


def loads_deep(text: str):
    """As ``loads``, strict, with the open containers on a stack of its own."""
    top: list = []
    # the container to fill, its pending key (None in an array), and what opened it
    stack: list[list] = [[top, None]]
    want, i = "value", 0
    while True:
        m = _TOKEN.match(text, i)
        if not m:
            raise ValueError(f"no JSON at {i}")
        i, sign = m.end(), m[1]
        if want in ("value", "value]") and sign not in ("]", "}", ",", ":"):
            if sign == '"':
                value, i = scanstring(text, i, True)
            elif sign:
                value = [] if sign == "[" else {}
            elif m[2] is not None:
                value = float(m[2] + m[3]) if m[3] else whole_number(m[2])
            else:
                value = _NAMED[m[4]]
            box, key = stack[-1]
            if key is None:
                box.append(value)
            else:
                box[key] = value
            if sign in ("[", "{"):
                stack.append([value, None])
                want = "value]" if sign == "[" else "key}"
                continue
        elif want in ("key", "key}") and sign == '"':
            stack[-1][1], i = scanstring(text, i, True)
            want = ":"
            continue
        elif want == ":" and sign == ":":
            want = "value"
            continue
        elif want == "next" and sign == ",":
            want = "value" if isinstance(stack[-1][0], list) else "key"
            continue
        elif sign in ("]", "}") and want in ("next", "value]" if sign == "]" else "key}") and isinstance(stack[-1][0], list) == (sign == "]"):
            stack.pop()
        else:
            raise ValueError(f"no JSON at {i}")
        if len(stack) == 1:
            break
        want = "next"
    if text[i:].strip(" \t\r\n"):
        raise ValueError(f"extra text at {i}")
    return top[0]


def _scalar(v) -> str:
    return encode_basestring(v) if isinstance(v, str) else json.dumps(v)


def dumps(v, sort_keys: bool = False, compact: bool = False) -> str:
    """The text of a value of any depth, non-ASCII letters as they are."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    try:
        return json.dumps(v, sort_keys=sort_keys, ensure_ascii=False, separators=(comma, colon))
    except RecursionError:
        pass
    out: list[str] = []
    entries = lambda x: iter(sorted(x.items()) if sort_keys else x.items()) if isinstance(x, dict) else iter(x)
    stack: list[list] = []  # [is an object, what is left of it, is the next entry the first]
    todo = [v]
    while todo or stack:
        if todo:
            x = todo.pop()
            if isinstance(x, (dict, list)):
                out.append("{" if isinstance(x, dict) else "[")
                stack.append([isinstance(x, dict), entries(x), True])
            else:
                out.append(_scalar(x))
            continue
        is_object, rest, first = stack[-1]
        for x in rest:
            out.append("" if first else comma)
            stack[-1][2] = False
            if is_object:
                out.append(encode_basestring(x[0]) + colon)
                x = x[1]
            todo.append(x)
            break
        else:
            out.append("}" if is_object else "]")
            stack.pop()
    return "".join(out)
