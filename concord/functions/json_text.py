"""JSON texts read once, from begin to end, into the rows of a node table. Plain Python, sent to the workers by value."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Sequence

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One token after white space: a mark, a string, a number or a word.
TOKEN = re.compile(
    r"[ \t\n\r]*(?:([{}\[\],:])"
    r'|"([^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*)"'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    r"|(true|false|null))"
)
SPACE = re.compile(r"[ \t\n\r]*")
MARK, STRING, NUMBER, WORD = 1, 2, 3, 4
#: The columns of a node, in order.
FIELDS = ("ptr", "trail", "ord", "stop", "jtype", "size", "names", "num", "str", "bool")


class NameHash(dict):
    """64-bit hashes of member names, kept for names met before (bounded)."""

    def __missing__(self, name: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        return value


def unescaped(body: str) -> str:
    """The text of a string's body. Halves of surrogate pairs that stand alone become U+FFFD."""
    if "\\" not in body:
        return body
    text = json.loads(f'"{body}"')
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def tree(text: str | None, max_depth: int, hashes: NameHash, out: Sequence[list]) -> tuple[str | None, int]:
    """Append a JSON text's values in document order to the columns FIELDS of ``out``: (None, 0), or (reason, offset) of what
    is no JSON, of which nothing is appended.

    ``ord`` is the offset at which a value begins, ``stop`` the one of a container's closing mark, ``names`` the sum of the
    hashes of an object's names. The open containers are kept on a stack, so no text is nested too deep for Python; values
    below ``max_depth`` are refused. A repeated name in one object is refused too.
    """
    if text is None:
        return "no text", 0
    first = len(out[0])
    found = _tree(text, max_depth, hashes, out)
    if found[0] is not None:
        for column in out:
            del column[first:]
    return found


def _tree(text: str, max_depth: int, hashes: NameHash, out: Sequence[list]) -> tuple[str | None, int]:
    ptrs, trails, begins, stops, jtypes, sizes, sums, nums, strs, bools = out
    opened: list[list] = []  # a container's row, pointer, trail, size, and the names of an object
    match, at = TOKEN.match, 0
    ptr = trail = ""
    want, closing = "value", ""  # value, name, colon, comma or end; and the mark that may close instead
    while True:
        found = match(text, at)
        if found is None:
            begin = SPACE.match(text, at).end()
            if begin == len(text):
                return (None, 0) if want == "end" else ("text ends early", begin)
            return "unexpected text", begin
        kind, at = found.lastindex, found.end()
        token = found[kind]
        if kind == MARK and token in "}]":
            if token != closing:
                return "unexpected text", at - 1
            row, _, _, size, names = opened.pop()
            stops[row], sizes[row] = at - 1, size
            if names is not None:
                sums[row] = (sum(map(hashes.__getitem__, names)) + (1 << 63)) % (1 << 64) - (1 << 63)
        elif want == "value" and (kind != MARK or token in "{["):
            if len(trail) > max_depth:
                return "nested too deep", found.start(kind) - (kind == STRING)
            ptrs.append(ptr)
            trails.append(trail)
            begins.append(found.start(kind) - (kind == STRING))
            stops.append(None)
            sizes.append(None)
            sums.append(None)
            nums.append(float(token) if kind == NUMBER else None)
            strs.append(unescaped(token) if kind == STRING else None)
            bools.append(token == "true" if kind == WORD and token != "null" else None)
            if kind == MARK:
                row = len(ptrs) - 1
                if token == "{":
                    jtypes.append("object")
                    opened.append([row, ptr, trail, 0, set()])
                    want, closing = "name", "}"
                else:
                    jtypes.append("array")
                    opened.append([row, ptr, trail, 0, None])
                    want, closing, ptr, trail = "value", "]", f"{ptr}/0", trail + "a"
                continue
            jtypes.append("string" if kind == STRING else "number" if kind == NUMBER else "null" if token == "null" else "boolean")
        elif want == "name" and kind == STRING:
            holder = opened[-1]
            name = unescaped(token)
            if name in holder[4]:
                return "repeated name", found.start(kind) - 1
            holder[4].add(name)
            holder[3] += 1
            if "~" in name or "/" in name:
                name = name.replace("~", "~0").replace("/", "~1")
            ptr, trail = f"{holder[1]}/{name}", holder[2] + "o"
            want, closing = "colon", ""
            continue
        elif want == "colon" and token == ":" and kind == MARK:
            want = "value"
            continue
        elif want == "comma" and token == "," and kind == MARK:
            holder = opened[-1]
            if holder[4] is None:
                ptr, trail, want = f"{holder[1]}/{holder[3]}", holder[2] + "a", "value"
            else:
                want = "name"
            closing = ""
            continue
        else:
            return "unexpected text", found.start(kind) - (kind == STRING)
        # A value has ended: in an array it counts, and a comma or the container's end comes next.
        if not opened:
            want, closing = "end", ""
        elif opened[-1][4] is None:
            opened[-1][3] += 1
            want, closing = "comma", "]"
        else:
            want, closing = "comma", "}"
