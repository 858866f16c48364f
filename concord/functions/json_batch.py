"""Many JSON texts read at once into node columns, as ``json_text.tree`` reads one. Numpy and Arrow, sent to the workers by value."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from concord.functions.json_text import NameHash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a byte outside strings is.
OBJECT, END_OBJECT, ARRAY, END_ARRAY, COMMA, COLON, QUOTE, SCALAR = range(1, 9)
KIND = np.full(256, SCALAR, np.uint8)
KIND[[ord(c) for c in " \t\n\r"]] = 0
KIND[[ord(c) for c in '{}[],:"']] = [OBJECT, END_OBJECT, ARRAY, END_ARRAY, COMMA, COLON, QUOTE]
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
JTYPES = ("object", "array", "string", "number", "boolean", "null")
JTYPE = {name: code for code, name in enumerate(JTYPES)}
#: Longer texts and values nested deeper are left to ``tree``.
LONGEST, DEEPEST = 1 << 23, 64


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, of one text at least."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    cuts = np.flatnonzero(np.diff(total // most, prepend=0)).tolist()
    ends = [*[c + 1 for c in cuts if c + 1 < len(texts)], len(texts)]
    yield from zip([0, *ends[:-1]], ends)


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings from ``begin`` to ``end``."""
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings, and where each string begins, with the end."""
    _, offsets, data = texts.buffers()
    begins = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[begins[0] : begins[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, begins - begins[0]


def _scalars(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The type code of each word that is no string (-1: none), and its number."""
    code, number = np.full(len(words), -1, np.int8), np.zeros(len(words))
    for i, word in enumerate(words):
        if NUMBER.fullmatch(word):
            code[i], number[i] = JTYPE["number"], float(word)
        elif word in ("true", "false"):
            code[i], number[i] = JTYPE["boolean"], word == "true"
        elif word == "null":
            code[i] = JTYPE["null"]
    return code, number


def plain_trees(texts: pa.Array, max_depth: int, hashes: NameHash) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """(the text that each value is of, the columns FIELDS of the values, the texts that are left).

    Read are JSON texts without a backslash, not too long and not nested too deep. All others are left whole, what is no JSON
    among them: ``tree`` reads them, or says why not. Tokens of all texts are found at once, then judged by the one
    before them and by the container they stand in.
    """
    texts = texts.cast(pa.string())
    data, begins = _bytes(texts)
    of = lambda at: np.searchsorted(begins, at, "right") - 1
    left = texts.is_null().to_numpy(zero_copy_only=False) | (np.diff(begins) == 0) | (np.diff(begins) > LONGEST)
    left[of(np.flatnonzero(data == ord("\\")))] = True
    left |= (np.diff(np.searchsorted(np.flatnonzero(data == ord('"')), begins)) % 2).astype(bool)
    chosen = np.flatnonzero(~left)
    if not len(chosen):
        return np.zeros(0, np.int64), [], np.flatnonzero(left)
    if left.any():
        data, begins = _bytes(texts.take(pa.array(chosen)))
    bad = np.zeros(len(chosen), bool)

    # Tokens: marks, strings at their first quote, and runs of what is no mark, string or white space.
    quotes = np.flatnonzero(data == ord('"'))
    within = np.zeros(len(data), np.int8)
    within[quotes[0::2]], within[quotes[1::2]] = 1, -1
    within = np.cumsum(within, dtype=np.int8).astype(bool)
    bad[of(np.flatnonzero(within & (data < 32)))] = True
    kinds = KIND[data]
    kinds[within] = 0
    kinds[quotes[1::2]] = 0
    kinds[quotes[0::2]] = QUOTE
    run = kinds == SCALAR
    before, after = np.zeros(len(run), bool), np.zeros(len(run), bool)
    before[1:], after[:-1] = run[:-1], run[1:]
    before[begins[:-1]] = False
    after[begins[1:] - 1] = False
    at = np.flatnonzero((kinds > 0) & ~(run & before))
    kind = kinds[at]
    end = at + 1
    end[kind == QUOTE] = quotes[1::2]
    end[kind == SCALAR] = np.flatnonzero(run & ~after) + 1
    counts = np.diff(np.searchsorted(at, begins))
    bad |= counts == 0
    text = np.repeat(np.arange(len(chosen)), counts)
    opens, closes = (kind == OBJECT) | (kind == ARRAY), (kind == END_OBJECT) | (kind == END_ARRAY)
    step = opens.astype(np.int64) - closes
    depth = np.cumsum(step)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    depth -= np.repeat(depth[first] - step[first], counts[counts > 0])
    level = np.minimum(depth, depth - step)
    last = np.append(first[1:], len(text)) - 1
    if len(first):
        bad[text[first[(np.minimum.reduceat(level, first) < 0) | (np.maximum.reduceat(level, first) > min(max_depth, DEEPEST)) | (depth[last] != 0)]]] = True

    # Containers: of every level, the ones that open and close take turns.
    kept = ~bad[text]
    at, end, kind, text, level, opens, closes = (x[kept] for x in (at, end, kind, text, level, opens, closes))
    holder, closed = np.full(len(at), -1), np.full(len(at), -1)
    for depth_of in range(int(level.max(initial=-1)) + 1):
        here = level == depth_of
        begun, ended, inner = np.flatnonzero(here & opens), np.flatnonzero(here & closes), np.flatnonzero((level == depth_of + 1))
        closed[begun] = ended
        bad[text[begun[kind[begun] + 1 != kind[ended]]]] = True
        holder[inner] = begun[np.searchsorted(begun, inner) - 1]

    # Grammar: what may follow what, in an object, in an array and outside.
    inside = np.where(holder >= 0, kind[holder], 0) if len(at) else kind
    fresh = np.diff(text, prepend=-1) != 0
    prior = np.where(fresh, 0, np.roll(kind, 1))
    name = (kind == QUOTE) & (inside == OBJECT) & ((prior == OBJECT) | (prior == COMMA))
    named = np.roll(name, 1) & ~fresh
    done = (prior == SCALAR) | (prior == END_OBJECT) | (prior == END_ARRAY) | ((prior == QUOTE) & ~named)
    value = ((kind == QUOTE) & ~name) | (kind == SCALAR) | opens
    placed = np.select([inside == 0, inside == ARRAY], [prior == 0, (prior == ARRAY) | (prior == COMMA)], prior == COLON)
    fine = np.select(
        [value, name, kind == COLON, kind == COMMA], [placed, True, (inside == OBJECT) & named, (inside != 0) & done], done | (prior == OBJECT) | (prior == ARRAY)
    )
    bad[text[~fine]] = True

    # What is left is written out: values by their container and the name or place that they have in it.
    kept = ~bad[text]
    number_of = np.cumsum(value & kept) - 1
    nodes = np.flatnonzero(value & kept)
    in_text, in_kind, in_level = text[nodes], kind[nodes], level[nodes]
    up = np.where(holder[nodes] >= 0, number_of[holder[nodes]], -1)
    in_object, in_array = inside[nodes] == OBJECT, inside[nodes] == ARRAY
    size = np.bincount(up[up >= 0], minlength=len(nodes))
    order = np.argsort(up, kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes)) - (np.cumsum(size) - size + np.count_nonzero(up < 0))[up[order]]
    names = _spans(data, at[nodes[in_object] - 2] + 1, end[nodes[in_object] - 2]).dictionary_encode()
    code, known = names.indices.to_numpy(), names.dictionary.to_pylist()
    sums = np.zeros(len(nodes), np.uint64)
    np.add.at(sums, up[in_object], np.array([hashes[n] for n in known], np.uint64)[code])
    pairs = np.sort(up[in_object] * max(1, len(known)) + code)
    bad[in_text[pairs[1:][pairs[1:] == pairs[:-1]] // max(1, len(known))]] = True
    places = int(place[in_array].max(initial=-1)) + 1
    tokens = pa.array([n.replace("~", "~0").replace("/", "~1") for n in known] + [str(i) for i in range(places)], pa.string())
    which = np.zeros(len(nodes), np.int64)
    which[in_object], which[in_array] = code, len(known) + place[in_array]

    ptrs, trails, rows, row_of = [], [], [], np.zeros(len(nodes), np.int64)
    for depth_of in range(int(in_level.max(initial=-1)) + 1):
        here = np.flatnonzero(in_level == depth_of)
        row_of[here] = np.arange(len(here))
        if depth_of == 0:
            ptr = trail = pa.array([""] * len(here), pa.string())
        else:
            of_holder = pa.array(row_of[up[here]])
            ptr = pc.binary_join_element_wise(ptrs[-1].take(of_holder), tokens.take(pa.array(which[here])), "/")
            trail = pc.binary_join_element_wise(trails[-1].take(of_holder), pa.array(["a", "o"]).take(pa.array(in_object[here].astype(np.int8))), "")
        ptrs.append(ptr)
        trails.append(trail)
        rows.append(here)
    back = np.empty(len(nodes), np.int64)
    if rows:
        back[np.concatenate(rows)] = np.arange(len(nodes))
    in_order = lambda parts: pa.concat_arrays([*parts, pa.array([], pa.string())]).take(pa.array(back))

    is_string, is_scalar, holds = in_kind == QUOTE, in_kind == SCALAR, opens[nodes]
    words = _spans(data, at[nodes[is_scalar]], end[nodes[is_scalar]]).dictionary_encode()
    word_code, word_number = _scalars(words.dictionary.to_pylist())
    jtype, number = np.full(len(nodes), JTYPE["string"], np.int8), np.zeros(len(nodes))
    jtype[is_scalar], number[is_scalar] = word_code[words.indices.to_numpy()], word_number[words.indices.to_numpy()]
    jtype[holds] = np.where(in_kind[holds] == OBJECT, JTYPE["object"], JTYPE["array"])
    bad[in_text[jtype < 0]] = True
    strings = _spans(data, at[nodes[is_string]] + 1, end[nodes[is_string]])
    string_of = np.cumsum(is_string) - 1

    # Offsets count characters.
    shift = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    chars = lambda byte, t: byte - shift[byte] - (begins[t] - shift[begins[t]])
    stop = np.where(holds, chars(at[closed[nodes]], in_text), 0) if len(nodes) else size
    columns = [
        in_order(ptrs), in_order(trails), pa.array(chars(at[nodes], in_text)), pa.array(stop, mask=~holds),
        pa.array(JTYPES).take(pa.array(np.maximum(jtype, 0))), pa.array(size.astype(np.int32), mask=~holds), pa.array(sums.view(np.int64), mask=jtype != JTYPE["object"]),
        pa.array(number, mask=jtype != JTYPE["number"]), strings.take(pa.array(string_of, mask=~is_string)), pa.array(number == 1, mask=jtype != JTYPE["boolean"]),
    ]
    fit = np.flatnonzero(~bad[in_text])
    if len(fit) < len(nodes):
        columns = [c.take(pa.array(fit)) for c in columns]
    left[chosen[bad]] = True
    return chosen[in_text[fit]], columns, np.flatnonzero(left)
