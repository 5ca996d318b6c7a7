"""Further outputs for a recogniser's ONNX file, without its tools.

A model file is one protocol buffer message, and parsers merge what stands behind it:
fields of the graph that are appended to a file (nodes, constants, outputs) become part
of its graph.  So the file stays as it is, and nothing of it has to be understood but
the version of its operators and the name of its output.
"""

from __future__ import annotations

from collections.abc import Iterator

#: The appended outputs: the best class of each step, and its score.
COMPACT = ("token_ids", "token_probs")

# Field numbers and types of the ONNX format.
GRAPH, OPSETS = 7, 8
NODE, INITIALIZER, OUTPUT = 1, 5, 12
INT64, FLOAT, ATTRIBUTE_INT, ATTRIBUTE_INTS = 7, 1, 2, 7
#: Operators from this version on take the axes of a reduction as an input.
AXES_AS_INPUT = 18


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def field(number: int, value: int | bytes | str) -> bytes:
    """A field of a message: a whole number, or a string of bytes with its length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's own fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


def _attribute(name: str, kind: int, number: int, value: int) -> bytes:
    return field(5, field(1, name) + field(number, value) + field(20, kind))


def _node(operator: str, inputs: list[str], output: str, attributes: bytes) -> bytes:
    return field(NODE, b"".join(field(1, i) for i in inputs) + field(2, output) + field(3, output) + field(4, operator) + attributes)


def _output(name: str, kind: int) -> bytes:
    return field(OUTPUT, field(1, name) + field(2, field(1, field(1, kind))))


def operator_version(model: bytes) -> int:
    """The version of ONNX's own operators."""
    for number, value in fields(model):
        if number == OPSETS:
            own = dict(fields(value))
            if own.get(1, b"") in (b"", b"ai.onnx"):
                return own[2]
    raise ValueError("the model names no version of its operators")


def outputs(model: bytes) -> list[str]:
    """Names of the graph's outputs."""
    found = []
    for number, graph in fields(model):
        if number == GRAPH:
            found += [dict(fields(value))[1].decode() for n, value in fields(graph) if n == OUTPUT]
    return found


def with_argmax(model: bytes, scores: str | None = None, axis: int = 2) -> bytes:
    """The model with `COMPACT` outputs over the classes of its output `scores` (its first)."""
    found = outputs(model)
    if all(name in found for name in COMPACT):
        return model
    scores = scores or found[0]
    best = _node("ArgMax", [scores], COMPACT[0], _attribute("axis", ATTRIBUTE_INT, 3, axis) + _attribute("keepdims", ATTRIBUTE_INT, 3, 0))
    flat = _attribute("keepdims", ATTRIBUTE_INT, 3, 0)
    if operator_version(model) >= AXES_AS_INPUT:
        most = _node("ReduceMax", [scores, "quire_axes"], COMPACT[1], flat)
        most += field(INITIALIZER, field(1, 1) + field(2, INT64) + field(7, axis) + field(8, "quire_axes"))
    else:
        most = _node("ReduceMax", [scores], COMPACT[1], _attribute("axes", ATTRIBUTE_INTS, 8, axis) + flat)
    return model + field(GRAPH, best + most + _output(COMPACT[0], INT64) + _output(COMPACT[1], FLOAT))
