"""Protobuf payloads of an Arrow column as documents: a field is read over all messages of a piece at once.

Imported where payloads are decoded only. What is out of the ordinary (a field that breaks off, comes twice or in another form
than its type's, long nested values, very many fields) is not read here: its payload is left to the ``protobuf`` package.
"""

from __future__ import annotations

from base64 import b64encode
from typing import Any, Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from google.protobuf import message_factory
from google.protobuf.message import DecodeError
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from beaconry.sources.proto import _JSON, _plain, _snake

#: Fields of one message that are stepped through; messages are stepped through together, so a long one would go alone.
STEPS = 256
#: Bytes of a payload that is read here: working memory is many times that.
LONGEST = 4 << 20
#: Bytes of a nested value that is parsed by itself: too few to nest as deep as the package allows in a payload.
SHALLOW = 128
_NUMBERS = 2048  # those of a tag of two bytes
_PAD = 16
_VARINT, _FIXED64, _SIZED, _FIXED32, _UNKNOWN, _LEFT = 0, 1, 2, 5, 8, 9
_HEX = np.array([int.from_bytes(b"%02x" % i, "little") for i in range(256)], "<u2")


class _Payloads:
    """Payloads one after the other, and which of them are out of the ordinary."""

    def __init__(self, payloads: Any) -> None:
        payloads = payloads.cast(pa.binary())
        _, ends, data = payloads.buffers()
        ends = np.frombuffer(ends, np.int32)[payloads.offset:payloads.offset + len(payloads) + 1].astype(np.int64)
        self.data = np.concatenate((np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], np.zeros(_PAD, np.uint8)))
        self.start, self.end = ends[:-1] - ends[0], ends[1:] - ends[0]
        self.odd = np.zeros(len(payloads), bool)

    def varints(self, at: Any) -> tuple[Any, Any]:
        """Values and widths; a value without an end is wider than any payload."""
        byte = self.data[at]
        values, width = (byte & 0x7F).astype(np.uint64), np.ones(len(at), np.int64)
        more = np.flatnonzero(byte >= 128)
        for k in range(1, 10):
            if not len(more):
                break
            byte = self.data[at[more] + k]
            values[more] |= (byte & 0x7F).astype(np.uint64) << np.uint64(7 * k)
            width[more] = k + 1
            if k == 9:
                width[more[byte > 1]] = 1 << 40
            more = more[byte >= 128]
        return values, width

    def fixed(self, at: Any, kind: str) -> Any:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(self.data[at[:, None] + np.arange(size)]).view(kind)[:, 0]

    def bytes_at(self, start: Any, end: Any) -> tuple[Any, Any]:
        """Offsets and bytes of these places, one after the other."""
        offsets = np.concatenate(([0], np.cumsum(end - start)))
        return offsets, self.data[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]

    def fields(self, start: Any, end: Any, doc: Any) -> tuple[Any, ...]:
        """Message, number, wire type, value, start and end of every field, in order within a message."""
        steps: list[tuple] = []
        live = np.flatnonzero(start < end)
        at, stop = start[live], end[live]
        while len(live):
            if len(steps) == STEPS:
                self.odd[doc[live]] = True
                break
            key, width = self.varints(at)
            number, wire = key >> np.uint64(3), (key & np.uint64(7)).astype(np.int8)
            body = at + width
            good = (width <= 2) & (number > 0) & (body <= stop) & ((wire <= 2) | (wire == _FIXED32))
            body = np.where(good, body, at)
            to = body + np.where(wire == _FIXED64, 8, 4)
            value = np.zeros(len(live), np.uint64)
            read = np.flatnonzero((wire == _VARINT) | (wire == _SIZED))
            value[read], width = self.varints(body[read])
            sized = wire[read] == _SIZED
            size = np.minimum(value[read], np.uint64(1 << 40)).astype(np.int64)
            to[read] = body[read] + width + np.where(sized, size, 0)
            body[read] += np.where(sized, width, 0)
            good &= to <= stop
            if not good.all():
                self.odd[doc[live[~good]]] = True
                live, number, wire, value, body, to, stop = (a[good] for a in (live, number, wire, value, body, to, stop))
            steps.append((live, number.astype(np.int64), wire, value, body, to))
            left = to < stop
            live, at, stop = live[left], to[left], stop[left]
        if not steps:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64), none, none
        return tuple(np.concatenate(column) for column in zip(*steps))


def _masked(there: Any) -> Any:
    return pa.py_buffer(np.packbits(there, bitorder="little"))


def _varint_as(field: Any) -> Callable[[Any], Any]:
    return {
        field.TYPE_BOOL: lambda v: v != 0, field.TYPE_INT32: lambda v: v.astype(np.uint32).view(np.int32),
        field.TYPE_INT64: lambda v: v.view(np.int64), field.TYPE_UINT32: lambda v: v.astype(np.uint32), field.TYPE_UINT64: lambda v: v,
        field.TYPE_SINT32: lambda v: (v.astype(np.uint32) >> np.uint32(1)).view(np.int32) ^ -(v & np.uint64(1)).astype(np.int32),
    }[field.type]


def _fixed_as(field: Any) -> str | None:
    return {field.TYPE_FIXED64: "<u8", field.TYPE_SFIXED64: "<i8", field.TYPE_DOUBLE: "<f8", field.TYPE_FIXED32: "<u4"}.get(field.type)


def _numbers(values: Any, arrow: Any, there: Any = None) -> Any:
    return pa.array(values, mask=None if there is None else ~there, from_pandas=False).cast(arrow)


def _member(kind: T.DataType, field: Any) -> tuple[int, Callable]:
    """The wire type that is read of a field, and a function from where it stands to its Arrow array.

    The function takes the payloads, the number of messages, each one's payload, and for each field found its message, value,
    start and end.
    """
    arrow = to_arrow_type(kind)
    if isinstance(kind, T.ArrayType):
        if field.message_type is not None:
            if not isinstance(kind.elementType, T.StructType):
                return _LEFT, _never
            inner = reader(kind.elementType, field.message_type)

            def messages(p: _Payloads, n: int, doc: Any, message: Any, value: Any, start: Any, end: Any) -> Any:
                order = np.argsort(message, kind="stable")
                ends = np.concatenate(([0], np.cumsum(np.bincount(message, minlength=n))))
                return pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), inner(p, start[order], end[order], doc[message[order]]), type=arrow)

            return _SIZED, messages
        form = _fixed_as(field)
        if form is None or form == "<u4":
            return _LEFT, _never

        def packed(p: _Payloads, n: int, doc: Any, message: Any, value: Any, start: Any, end: Any) -> Any:
            at, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
            at[message], to[message] = start, end
            torn = (to - at) % 8 != 0
            p.odd[doc[torn]] = True
            to[torn] = at[torn]
            offsets, data = p.bytes_at(at, to)
            return pa.ListArray.from_arrays(pa.array(offsets // 8, pa.int32()), _numbers(data.view(form), arrow.value_type), type=arrow)

        return _SIZED, packed
    if isinstance(kind, T.StructType):
        inner = reader(kind, field.message_type)

        def message_of(p: _Payloads, n: int, doc: Any, message: Any, value: Any, start: Any, end: Any) -> Any:
            at, to, there = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            at[message], to[message], there[message] = start, end, True
            return inner(p, at, to, doc, there)

        return _SIZED, message_of
    if field.message_type is not None:  # a message wanted as text
        whole, plain = message_factory.GetMessageClass(field.message_type), _plain(field.message_type, {})

        def as_text(p: _Payloads, n: int, doc: Any, message: Any, value: Any, start: Any, end: Any) -> Any:
            out: list[str | None] = [None] * n
            p.odd[doc[message[end - start > SHALLOW]]] = True
            for m, a, b in zip(message.tolist(), start.tolist(), np.minimum(end, start + SHALLOW).tolist()):
                try:
                    out[m] = _JSON.encode(plain(whole.FromString(p.data[a:b].tobytes())))
                except (DecodeError, UnicodeDecodeError):
                    p.odd[doc[m]] = True
            return pa.array(out, arrow)

        return _SIZED, as_text
    if field.type in (field.TYPE_STRING, field.TYPE_BYTES):
        ids = field.name.endswith(("trace_id", "span_id"))
        if not isinstance(kind, T.StringType) or (field.type == field.TYPE_BYTES and not ids and field.name != "bytes_value"):
            return _LEFT, _never

        def text(p: _Payloads, n: int, doc: Any, message: Any, value: Any, start: Any, end: Any) -> Any:
            at, to, there = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            at[message], to[message], there[message] = start, end, True
            offsets, data = p.bytes_at(at, to)
            if ids:  # hex text, none if empty
                offsets, data, there = offsets * 2, _HEX[data], to > at
            elif field.type == field.TYPE_BYTES:
                return pa.array([b64encode(data[a:b]).decode() if t else None
                                 for a, b, t in zip(offsets, offsets[1:], there)], arrow)
            elif not field.has_presence:
                there = np.ones(n, bool)
            out = pa.Array.from_buffers(pa.string(), n, [_masked(there), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            try:
                out.validate(full=True)
            except pa.ArrowInvalid:
                p.odd[doc[[i for i, (a, b) in enumerate(zip(offsets, offsets[1:])) if not _is_text(data[a:b].tobytes())]]] = True
                return pa.nulls(n, arrow)
            return out.cast(arrow)

        return _SIZED, text
    form = _fixed_as(field)
    read = None if form else _varint_as(field)

    def number(p: _Payloads, n: int, doc: Any, message: Any, value: Any, start: Any, end: Any) -> Any:
        found = read(value) if form is None else p.fixed(start, form)
        values, there = np.zeros(n, found.dtype), np.zeros(n, bool)
        values[message], there[message] = found, True
        return _numbers(values, arrow, there if field.has_presence else None)

    return _VARINT if form is None else _FIXED32 if form == "<u4" else _FIXED64, number


def _is_text(value: bytes) -> bool:
    try:
        value.decode()
    except UnicodeDecodeError:
        return False
    return True


def _never(*_: Any) -> Any:
    return None


def reader(kind: T.StructType, descriptor: Any) -> Callable[..., Any]:
    """Function from the places of messages (and which of them are there) to their struct array."""
    arrow = to_arrow_type(kind)
    members: list[tuple[int, Any, Callable | None]] = []
    wires, slots = np.full(_NUMBERS, _UNKNOWN, np.int8), np.full(_NUMBERS, -1)
    for f, a in zip(kind.fields, arrow):
        d = descriptor.fields_by_name.get(_snake(f.name))
        if d is None:  # a field of another point kind
            members.append((0, a.type, None))
            continue
        wires[d.number], read = _member(f.dataType, d)
        members.append((d.number, a.type, read if wires[d.number] != _LEFT else None))
        if not d.is_repeated or d.message_type is None:  # at most once; one slot for all of a oneof
            one = d.containing_oneof
            slots[d.number] = d.number if one is None else min(o.number for o in one.fields)
    count = int(slots.max()) + 1

    def structs(p: _Payloads, start: Any, end: Any, doc: Any, there: Any = None) -> Any:
        n = len(start)
        message, number, wire, value, begin, to = p.fields(start, end, doc)
        known = wires[number] != _UNKNOWN
        message, number, wire, value, begin, to = (a[known] for a in (message, number, wire, value, begin, to))
        p.odd[doc[message[wires[number] != wire]]] = True
        if count:
            slot = slots[number]
            once = slot >= 0
            p.odd[doc[np.flatnonzero(np.bincount(message[once] * count + slot[once], minlength=n * count) > 1) // count]] = True
        arrays = []
        for field_number, type_, read in members:
            if read is None:
                arrays.append(pa.nulls(n, type_))
                continue
            at = np.flatnonzero((number == field_number) & (wire == wires[field_number]))
            arrays.append(read(p, n, doc, message[at], value[at], begin[at], to[at]))
        return pa.StructArray.from_arrays(arrays, fields=list(arrow), mask=None if there is None else pa.array(~there))

    return structs


def documents(payloads: Any, read: Callable, left: Callable[[list], Any]) -> Any:
    """The documents of an array of payloads, null for those null, empty or undecodable.

    ``read``: the reader of the root. ``left``: function from the payloads that are out of the ordinary to their documents.
    """
    n = len(payloads)
    size = pc.fill_null(pc.binary_length(payloads), 0).to_numpy(zero_copy_only=False)
    plain, odd, made = np.flatnonzero((size > 0) & (size <= LONGEST)), np.flatnonzero(size > LONGEST), None
    while len(plain):
        p = _Payloads(payloads if len(plain) == n else payloads.take(pa.array(plain)))
        try:
            made = read(p, p.start, p.end, np.arange(len(plain)))
        except pa.ArrowInvalid:  # a number beyond its column's type
            p.odd[:] = True
        if not p.odd.any():
            break
        odd, plain, made = np.concatenate((odd, plain[p.odd])), plain[~p.odd], None
    if made is not None and len(plain) == n:
        return made
    parts = ([] if made is None else [made]) + [left(payloads.take(pa.array(odd)).to_pylist())]
    index = np.full(n, -1)
    index[np.concatenate((plain, odd))] = np.arange(len(plain) + len(odd))
    return pa.concat_arrays(parts).take(pa.array(index, mask=index < 0))
