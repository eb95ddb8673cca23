import pytest

from logfold.errors import ParseError, TypeNotFoundError, UnsupportedError
from logfold.plans import schema as S
from logfold.plans.spark_types import struct_type


def test_msg_comments_constants_defaults_and_bounds():
    s = S.parse("a/B", "boolean x # c = 3\nint32 K=5\nstring NAME=a # b\ntime_msgs/Foo f\nint32[<=3] z\nstring<=5 q\nuint8[] d\nfloat32 y 1.5\nint8[2][3] m\n===\nMSG: time_msgs/Foo\nint8 a")
    assert [(f.name, S.spell(f.type)) for f in s.top.fields] == [("x", "bool"), ("f", "time_msgs/Foo"), ("z", "int32[]"), ("q", "string"), ("d", "uint8[]"), ("y", "float32"), ("m", "int8[3][2]")]
    assert s.top.constants == {"K": ("int32", "5"), "NAME": ("string", "a # b")}
    assert s.top.fields[5].default == "1.5" and s.top.fields[2].type.bound == 3


def test_empty_and_broken():
    assert S.parse("test/Empty", "").top.fields == []
    with pytest.raises(ParseError):
        S.parse("a/B", "int32")
    with pytest.raises(ParseError):
        S.parse("a/B", "module a { struct B { long x }; };")
    with pytest.raises(UnsupportedError):
        S.parse("a/B", "module a { union B switch (long) { case 1: long x; }; };")
    with pytest.raises(TypeNotFoundError):
        S.parse("a/B", "no/Such x").paths()


def test_ros1_header():
    s = S.parse("pkg/T", "Header header\nstring data\n===\nMSG: std_msgs/Header\ntime stamp\nstring frame_id", ros1=True)
    assert [f.name for f in s.top.fields] == ["data"] and [f.name for f in s.types["std_msgs/Header"].fields] == ["stamp", "seq", "frame_id"]
    assert [f.name for f in S.parse("pkg/T", "Header header\nstring data").top.fields] == ["header", "data"]


def test_idl_scopes_enums_constants_inheritance():
    s = S.parse("m/C", 'module m { const long N = 2; enum E { A, B }; typedef sequence<E> es; struct P { long id; }; struct C : P { es list; float grid[N][3]; unsigned long long u; @key string<4> k; }; };')
    assert s.paths() == [("id", "int32"), ("list", "uint32[]"), ("grid", "float32[3][2]"), ("u", "uint64"), ("k", "string")]


def test_spark_types():
    s = S.parse("a/B", "uint64 u\nuint8[] raw\ntime t\nBox[] boxes\n===\nMSG: a/Box\nfloat64 w\nuint16 n")
    assert struct_type(s).simpleString() == "struct<u:decimal(20,0),raw:binary,t:bigint,boxes:array<struct<w:double,n:int>>>"
    with pytest.raises(UnsupportedError):
        struct_type(S.parse("a/B", "B b"))
