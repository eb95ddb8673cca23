import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logfold.codecs import cdr, proto
from logfold.errors import BufferTooShortError, EncodeError, InvalidRuleError, ParseError, UnsupportedError
from logfold.plans import schema as S
from logfold.queries.payloads import descriptors

JOINT = S.parse("sensor_msgs/msg/JointState", "std_msgs/Header header\nstring[] name\nfloat64[] position\nfloat64[] velocity\nfloat64[] effort")
VALUE = {"header": {"stamp": {"sec": 12345, "nanosec": 67890}, "frame_id": "base_link"}, "name": ["joint1", "joint2"], "position": [1.0, 2.0], "velocity": [0.1, 0.2], "effort": [0.0, 0.0]}


def test_bytes_by_hand():
    data = b"\0\1\0\0" + struct.pack("<iI", 12345, 67890) + struct.pack("<I", 10) + b"base_link\0" + b"\0\0"
    data += struct.pack("<I", 2) + struct.pack("<I", 7) + b"joint1\0" + b"\0" + struct.pack("<I", 7) + b"joint2\0" + b"\0"
    for values in ([1.0, 2.0], [0.1, 0.2], [0.0, 0.0]):
        data += struct.pack("<I", 2)
        data += bytes(-(len(data) - 4) % 8) + struct.pack("<dd", *values)
    assert cdr.Reader(JOINT).decode(data) == VALUE and cdr.Writer(JOINT).encode(VALUE) == data


def test_unterminated_string_and_damage():
    s = S.parse("a/S", "string data")
    assert cdr.Reader(s).decode(b"\0\1\0\0" + struct.pack("<I", 2) + b"ab")["data"] == "ab"
    for bad in (b"", b"\0\1", b"\0\1\0\0" + struct.pack("<I", 9) + b"ab", b"\0\1\0\0" + struct.pack("<I", 20_000_000)):
        with pytest.raises(BufferTooShortError):
            cdr.Reader(s).decode(bad)
    with pytest.raises(BufferTooShortError):  # a big-endian header in front of little-endian content
        cdr.Reader(s).decode(b"\1\0\0\0" + struct.pack("<I", 13) + b"Hello, World!")
    with pytest.raises(UnsupportedError):
        cdr.Reader(s).decode(b"\0\x77\0\0")


def test_coercion_and_missing():
    s = S.parse("a/N", "uint8 a\nint8 b\nfloat32 c\nuint8[3] d\nint32[<=2] e")
    assert cdr.Reader(s).decode(cdr.Writer(s).encode({})) == {"a": 0, "b": 0, "c": 0.0, "d": b"\0\0\0", "e": []}
    for bad in ({"a": 256}, {"b": -129}, {"a": 1.5}, {"d": [1]}, {"e": [1, 2, 3]}):
        with pytest.raises(EncodeError):
            cdr.Writer(s).encode(bad)
    with pytest.raises(EncodeError):
        cdr.Writer(s, missing="error").encode({"a": 1})


KINDS = S.parse("a/All", "bool t\nint8 a\nuint16 b\nint32 c\nuint64 d\nfloat64 e\nstring f\ntime g\nduration h\nint16[] i\nstring[2] j\nBox[] k\nuint8[] l\n===\nMSG: a/Box\nuint8 x\nfloat64 y\ntime[] z")
_int = lambda lo, hi: st.integers(lo, hi)
_text = st.text(st.characters(exclude_characters="\0", exclude_categories=["Cs"]), max_size=8)
_time = _int(0, 2**32 * 10**9 - 1)
_value = st.fixed_dictionaries(
    {"t": st.booleans(), "a": _int(-128, 127), "b": _int(0, 65535), "c": _int(-(2**31), 2**31 - 1), "d": _int(0, 2**64 - 1), "e": st.floats(allow_nan=False), "f": _text, "g": _time, "h": _int(-(2**31) * 10**9, 2**31 * 10**9 - 1),
     "i": st.lists(_int(-(2**15), 2**15 - 1), max_size=5), "j": st.lists(_text, min_size=2, max_size=2), "k": st.lists(st.fixed_dictionaries({"x": _int(0, 255), "y": st.floats(allow_nan=False), "z": st.lists(_time, max_size=3)}), max_size=3), "l": st.binary(max_size=9)}
)


@settings(max_examples=150, deadline=None)
@given(_value, st.sampled_from(sorted(cdr.KINDS)), st.sampled_from(["cdr", "headerless", "ros1", "ros1_16"]))
def test_round_trip(value, kind, framing):
    assert cdr.Reader(KINDS, framing).decode(cdr.Writer(KINDS, framing, kind if framing == "cdr" else "cdr_le").encode(value)) == value


def test_decode_plans_go_by_schema_not_by_name(spark):
    a, b = S.parse("x/T", "int32 v"), S.parse("x/T", "string v")
    rows = spark.createDataFrame([(bytearray(cdr.Writer(a).encode({"v": 7})), bytearray(cdr.Writer(b).encode({"v": "seven"}))), (None, None)], "a binary, b binary")
    out = cdr.decode(cdr.decode(rows, "a", a, into="x"), "b", b, into="y").collect()
    assert out[0].x.v == 7 and out[0].y.v == "seven" and out[1].x is None and out[1].y is None


def test_on_error(spark):
    s = S.parse("x/T", "int64 v")
    rows = spark.createDataFrame([(1, bytearray(cdr.Writer(s).encode({"v": 1}))), (2, bytearray(b"\0\1\0\0\1")), (3, None)], "i int, d binary")
    assert {(r.i, r.message and r.message.v) for r in cdr.decode(rows, "d", s, on_error="null").collect()} == {(1, 1), (2, None), (3, None)}
    assert {r.i for r in cdr.decode(rows, "d", s, on_error="drop").collect()} == {1, 3}
    with pytest.raises(Exception, match="do not fit|unpack_from"):
        cdr.decode(rows, "d", s).collect()


def test_wire_format():
    assert proto.decode_wire(b"\x08\x96\x01\x12\x07testing\x19\1\0\0\0\0\0\0\0\x25\2\0\0\0\x2a\2\xff\xfe") == {"1": 150, "2": "testing", "3": 1, "4": 2, "5": b"\xff\xfe"}
    assert proto.decode_wire(b"\x08\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01\x08\x05") == {"1": 5}
    assert proto.decode_wire(b"\x08\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01") == {"1": -1}
    for bad, error in ((b"\x08", BufferTooShortError), (b"\x12\x05ab", BufferTooShortError), (b"\x0b", UnsupportedError), (b"\x0f", ParseError), (b"\x08" + b"\xff" * 11, ParseError)):
        with pytest.raises(error):
            proto.decode_wire(bad)


def test_descriptor_rename_guards():
    for old, new in (("demo.msg.Event", "demo.msg.a.b.Event"), ("demo.msg.Event", "demo.msg.1x"), ("demo.msg.Event", "other.msg.Event")):
        with pytest.raises(InvalidRuleError):
            proto.rename(descriptors(), old, new)
