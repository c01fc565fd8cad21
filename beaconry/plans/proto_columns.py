"""Documents held in Arrow columns as protobuf payloads: a field is encoded over all messages of a piece at once."""

from __future__ import annotations

from typing import Any, Callable

#: Marks an integer that JSON shows without quotes.
BARE = "BARE:"


def _binary(offsets: Any, data: Any) -> Any:
    """Binary values that lie one after the other in ``data``."""
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _varints(values: Any) -> Any:
    """Seven bits a byte, lowest first; negative numbers as their two's complement of 64 bits."""
    import numpy as np

    values = values.astype(np.int64, copy=False).view(np.uint64) if values.dtype != np.uint64 else values
    width = np.ones(len(values), np.int64)
    for shift in range(7, 64, 7):
        width += (values >> np.uint64(shift)) != 0
    offsets = np.concatenate(([0], np.cumsum(width)))
    data = np.empty(offsets[-1], np.uint8)
    for k in range(width.max(initial=0)):
        at = np.flatnonzero(width > k)
        low = (values[at] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F
        data[offsets[at] + k] = low | np.where(width[at] > k + 1, 0x80, 0).astype(np.uint8)
    return _binary(offsets, data)


def _fixed(values: Any) -> Any:
    """Eight bytes a value, lowest first."""
    import numpy as np

    return _binary(np.arange(len(values) + 1) * 8, np.ascontiguousarray(values, values.dtype.newbyteorder("<")))


def _joined(*parts: Any) -> Any:
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(*parts, b"")


def _numbers(array: Any, kind: Any) -> Any:
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_string(array.type):
        array = pc.replace_substring(array, BARE, "")
    return pc.fill_null(array.cast(kind), pa.scalar(0).cast(kind)).to_numpy(zero_copy_only=False)


def _numeric(field: Any) -> tuple[Any, Callable, int]:
    """Arrow type, encoder and wire type of a numeric field."""
    import pyarrow as pa

    return {
        field.TYPE_BOOL: (pa.bool_(), _varints, 0), field.TYPE_INT32: (pa.int64(), _varints, 0),
        field.TYPE_INT64: (pa.int64(), _varints, 0), field.TYPE_UINT32: (pa.int64(), _varints, 0),
        field.TYPE_UINT64: (pa.uint64(), _varints, 0), field.TYPE_FIXED64: (pa.uint64(), _fixed, 1),
        field.TYPE_SFIXED64: (pa.int64(), _fixed, 1), field.TYPE_DOUBLE: (pa.float64(), _fixed, 1),
    }[field.type]


def _tag(field: Any, wire: int) -> Any:
    import numpy as np

    return _varints(np.array([field.number << 3 | wire]))[0]


def _sized(field: Any, bodies: Any) -> Any:
    """Bodies with the field's number and their length before them."""
    import pyarrow.compute as pc

    return _joined(_tag(field, 2), _varints(pc.binary_length(bodies).to_numpy(zero_copy_only=False)), bodies)


def _field(kind: Any, field: Any) -> Callable[[Any], Any]:
    """Function from the values of one field (null: not set) to their bytes, number included."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_list(kind):
        if field.message_type is not None:
            inner = messages(kind.value_type, field.message_type)
        else:
            number, encode, wire = _numeric(field)
            if wire == 0:
                raise TypeError(f"packed variable integers: {field.full_name}")

        def repeated(array: Any) -> Any:
            ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))))
            values = array.flatten()
            if field.message_type is not None:
                each = _sized(field, inner(values))
                return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), b"")
            packed = _binary(ends * 8, encode(_numbers(values, number)).buffers()[2])
            return pc.if_else(pa.array(np.diff(ends) > 0), _sized(field, packed), b"")

        return repeated
    if field.message_type is not None:
        inner = messages(kind, field.message_type)
        return lambda array: pc.if_else(array.is_valid(), _sized(field, inner(array)), b"")
    if field.type in (field.TYPE_STRING, field.TYPE_BYTES):
        def text(array: Any) -> Any:
            if field.type == field.TYPE_BYTES:  # ids, hex text in JSON
                array = pa.array([None if v is None else bytes.fromhex(v) for v in array.to_pylist()], pa.binary())
            bodies = pc.fill_null(array.cast(pa.binary()), b"")
            there = array.is_valid() if field.has_presence else pc.greater(pc.binary_length(bodies), 0)
            return pc.if_else(there, _sized(field, bodies), b"")

        return text
    number, encode, wire = _numeric(field)

    def scalar(array: Any) -> Any:
        values = _numbers(array, number)
        # bits, so that minus zero is told from the default
        there = array.is_valid() if field.has_presence else pa.array((values.view(np.int64) if wire == 1 else values) != 0)
        return pc.if_else(there, _joined(_tag(field, wire), encode(values)), b"")

    return scalar


def messages(kind: Any, descriptor: Any) -> Callable[[Any], Any]:
    """Function from a struct array with the members' JSON names to the bytes of its messages, in field order."""
    import pyarrow as pa

    by_json = {f.json_name: f for f in descriptor.fields}
    members = sorted(((by_json[m.name], i, _field(m.type, by_json[m.name])) for i, m in enumerate(kind)),
                     key=lambda member: member[0].number)

    def encode(array: Any) -> Any:
        columns = array.flatten()
        return _joined(*[one(columns[i]) for _, i, one in members]) if len(array) else pa.array([], pa.binary())

    return encode
