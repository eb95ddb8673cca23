"""Schemas of messages: a small tree, and parsers for .msg, OMG IDL and ROS 2 IDL texts.

Parsing runs on the driver, on the channel dimension. A parsed schema compiles to a decode plan (``codecs.cdr``) and
to Spark types (``plans.spark_types``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..errors import ParseError, TypeNotFoundError, UnsupportedError

#: Primitive types by their spellings, and bytes each takes (None: variable).
PRIMITIVES = {
    "bool": 1, "int8": 1, "int16": 2, "int32": 4, "int64": 8, "uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8,
    "float32": 4, "float64": 8, "string": None, "wstring": None, "byte": 1, "char": 1, "time": 8, "duration": 8,
}
ALIASES = {"boolean": "bool", "float": "float32", "double": "float64"}


@dataclass(frozen=True)
class Prim:
    name: str

    @property
    def alignment(self) -> int:
        return 4 if self.name in ("string", "wstring", "time", "duration") else PRIMITIVES[self.name]


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Array:
    """``size``: the fixed length, None for a sequence. ``bound``: the most a sequence holds."""

    element: Prim | Ref | Array
    size: int | None = None
    bound: int | None = None


@dataclass(frozen=True)
class Field:
    name: str
    type: Prim | Ref | Array
    default: str | None = None


@dataclass
class Message:
    name: str
    fields: list[Field] = field(default_factory=list)
    constants: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass
class Schema:
    """``name``: the top type; ``types``: all known types by name."""

    name: str
    types: dict[str, Message] = field(default_factory=dict)

    def resolve(self, name: str, inside: str = "") -> Message:
        """A type by any of its spellings: exact, ``::`` for ``/``, with or without ``/msg/``, by its last name, or of the same package."""
        slashed = name.replace("::", "/")
        tries = [name, slashed]
        if "/msg/" in slashed:
            tries.append(slashed.replace("/msg/", "/"))
        elif slashed.count("/") == 1:
            tries.append(slashed.replace("/", "/msg/"))
        if inside and "/" not in slashed:
            tries.append(inside.rpartition("/")[0] + "/" + slashed)
        for t in tries:
            if t in self.types:
                return self.types[t]
        last = slashed.rpartition("/")[2]
        for known in sorted(self.types):
            if known.replace("::", "/").rpartition("/")[2] == last:
                return self.types[known]
        raise TypeNotFoundError(f"{name!r} is not in the schema of {self.name!r}")

    @property
    def top(self) -> Message:
        return self.resolve(self.name)

    def alignment(self, kind, inside: str = "", seen: tuple[str, ...] = ()) -> int:
        """The largest alignment of any part of a type."""
        if isinstance(kind, Prim):
            return kind.alignment
        if isinstance(kind, Array):
            return max(self.alignment(kind.element, inside, seen), 4 if kind.size is None else 1)
        message = self.resolve(kind.name, inside)
        if message.name in seen:
            return 1
        return max((self.alignment(f.type, message.name, (*seen, message.name)) for f in message.fields), default=1)

    def paths(self, message: Message | None = None, prefix: str = "", seen: tuple[str, ...] = ()) -> list[tuple[str, str]]:
        """Dotted field paths with their types, nested messages in place."""
        out = []
        message = message or self.top
        for f in message.fields:
            out.append((prefix + f.name, spell(f.type)))
            kind = f.type
            while isinstance(kind, Array):
                kind = kind.element
            if isinstance(kind, Ref) and message.name not in seen:
                out += self.paths(self.resolve(kind.name, message.name), prefix + f.name + ".", (*seen, message.name))
        return out

    def rename_package(self, old: str, new: str) -> Schema:
        """All types of a package, and references to them, under another package."""

        def moved(name: str) -> str:
            for sep in ("/", "::"):
                if name.startswith(old + sep):
                    return new + name[len(old) :]
            return name

        def walk(kind):
            if isinstance(kind, Array):
                return replace(kind, element=walk(kind.element))
            return Ref(moved(kind.name)) if isinstance(kind, Ref) else kind

        types = {moved(n): Message(moved(m.name), [replace(f, type=walk(f.type)) for f in m.fields], dict(m.constants)) for n, m in self.types.items()}
        return Schema(moved(self.name), types)


def spell(kind) -> str:
    if isinstance(kind, Array):
        return f"{spell(kind.element)}[{'' if kind.size is None else kind.size}]"
    return kind.name


def primitive(name: str) -> Prim | Ref:
    name = ALIASES.get(name, name)
    return Prim(name) if name in PRIMITIVES else Ref(name)


def builtins() -> dict[str, Message]:
    stamp = [Field("sec", Prim("int32")), Field("nanosec", Prim("uint32"))]
    out = {}
    for middle in ("/", "/msg/"):
        for name in ("Time", "Duration"):
            full = f"builtin_interfaces{middle}{name}"
            out[full] = Message(full, list(stamp))
        full = f"std_msgs{middle}Header"
        out[full] = Message(full, [Field("stamp", Ref(f"builtin_interfaces{middle}Time")), Field("frame_id", Prim("string"))])
    return out


# .msg

_FIELD = re.compile(r"(?P<type>[A-Za-z][\w/]*(?:::\w+)*)(?:<=\d+)?(?P<dims>(?:\[(?:<=)?\d*\])*)\s+(?P<name>[A-Za-z_]\w*)\s*(?P<rest>.*)")


def parse_msg(name: str, text: str, ros1: bool = False) -> Schema:
    """A .msg definition with its dependencies behind rules of ``=`` and ``MSG:`` lines, or nested types as indented fields.

    ``ros1``: in Headers without one, seq goes behind stamp, and a leading header field of the top type goes.
    """
    blocks, current = [(name, [])], 0
    for line in _unfold(text).splitlines():
        if re.fullmatch(r"\s*={3,}\s*", line):
            continue
        if m := re.match(r"\s*MSG:\s*(\S+)", line):
            blocks.append((m[1], []))
            current = len(blocks) - 1
            continue
        blocks[current][1].append(line)
    schema = Schema(name)
    for block, lines in blocks:
        message = Message(block)
        for line in lines:
            _msg_line(message, line)
        schema.types.setdefault(block, message)
    if ros1:
        _ros1(schema)
    return _complete(schema)


def _uncomment(line: str) -> str:
    quoted = re.match(r"\s*w?string(?:<=\d+)?\s+\w+\s*=", line)
    if quoted:  # a string constant takes the rest of the line
        return line.strip()
    out, quote = [], ""
    for c in line:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#":
            break
        out.append(c)
    return "".join(out).strip()


def _msg_line(message: Message, line: str) -> None:
    line = _uncomment(line)
    if not line or line.startswith("#"):
        return
    m = _FIELD.fullmatch(line)
    if not m:
        raise ParseError(f"cannot read {line!r}", f"message {message.name}")
    kind: Prim | Ref | Array = primitive(m["type"])
    if m["rest"].startswith("="):
        message.constants[m["name"]] = (m["type"], m["rest"][1:].strip())
        return
    for dim in reversed(re.findall(r"\[([^\]]*)\]", m["dims"])):
        bound = int(dim[2:]) if dim.startswith("<=") else None
        kind = Array(kind, None if bound is not None or not dim else int(dim), bound)
    message.fields.append(Field(m["name"], kind, m["rest"] or None))


def _unfold(text: str) -> str:
    """Indented fields under a field of a nested type become a dependency block of that type."""
    if not re.search(r"(?m)^[ \t]+[A-Za-z]\S*[ \t]+\w", text) or re.search(r"(?m)^\s*MSG:", text):
        return text
    if not re.match(r"\S", text.lstrip("\n")):
        return text
    root, nested, owners = [], {}, []  # owners: (indent, type) of the fields that a deeper line may belong to
    for line in text.splitlines():
        bare, indent = _uncomment(line), len(line) - len(line.lstrip())
        if not bare:
            continue
        while owners and owners[-1][0] >= indent:
            owners.pop()
        (nested.setdefault(owners[-1][1], []) if owners else root).append(bare)
        m = _FIELD.fullmatch(bare)
        if m and isinstance(primitive(m["type"]), Ref):
            owners.append((indent, m["type"]))
    return "\n".join(root + [x for t, lines in nested.items() for x in ("===", f"MSG: {t}", *lines)])


def _ros1(schema: Schema) -> None:
    for n, m in schema.types.items():
        if n.rpartition("/")[2] == "Header" and all(f.name != "seq" for f in m.fields):
            at = next((i for i, f in enumerate(m.fields) if f.name == "stamp"), -1)
            m.fields.insert(at + 1, Field("seq", Prim("uint32")))
    top = schema.types.get(schema.name)
    if top and top.fields and schema.name.rpartition("/")[2] != "Header":
        first = top.fields[0]
        if first.name == "header" and isinstance(first.type, Ref) and "Header" in first.type.name:
            top.fields.pop(0)


def _complete(schema: Schema) -> Schema:
    for n, m in builtins().items():
        schema.types.setdefault(n, m)
    return schema


# IDL

_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|#[^\n]*|(?P<t>"(?:[^"\\]|\\.)*"|[A-Za-z_][\w]*(?:::[A-Za-z_]\w*)*|::[A-Za-z_][\w:]*|[-+]?\d[\w.+-]*|[{}<>\[\]();,=@:|&^~*/%+-])', re.S)
#: IDL's names of the primitive types.
IDL_NAMES = {
    "boolean": "bool", "octet": "uint8", "char": "char", "wchar": "uint16", "short": "int16", "long": "int32", "long long": "int64",
    "unsigned short": "uint16", "unsigned long": "uint32", "unsigned long long": "uint64", "float": "float32", "double": "float64",
    "int8": "int8", "uint8": "uint8", "int16": "int16", "uint16": "uint16", "int32": "int32", "uint32": "uint32", "int64": "int64", "uint64": "uint64",
    "string": "string", "wstring": "wstring",
}


class _Idl:
    """Recursive descent over IDL: modules, structs, typedefs, enums, constants. Unions are refused."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"cannot read {text[at : at + 20]!r}", "IDL")
            if m["t"]:
                self.tokens.append(m["t"])
            at = m.end()
        self.at, self.types, self.typedefs, self.constants = 0, {}, {}, {}

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if not t or (wanted is not None and t != wanted):
            raise ParseError(f"{wanted or 'more'!r} expected before {t!r}", "IDL")
        self.at += 1
        return t

    def skip_annotations(self) -> None:
        while self.peek() == "@":
            self.take()
            self.take()
            if self.peek() == "(":
                depth = 0
                while True:
                    t = self.take()
                    depth += (t == "(") - (t == ")")
                    if not depth:
                        break

    def definitions(self, scope: tuple[str, ...], end: str = "") -> None:
        while self.peek() != end:
            self.skip_annotations()
            word = self.peek()
            if word == "module":
                self.take()
                inner = (*scope, self.take())
                self.take("{")
                self.definitions(inner, "}")
                self.take("}")
            elif word == "struct":
                self.struct(scope)
            elif word == "typedef":
                self.take()
                kind = self.type(scope)
                for name, full in self.declarators(kind):
                    self.typedefs["/".join((*scope, name))] = full
            elif word == "enum":
                self.take()
                self.typedefs["/".join((*scope, self.take()))] = Prim("uint32")
                self.take("{")
                while self.take() != "}":
                    pass
            elif word == "const":
                self.take()
                kind = spell(self.type(scope))
                name = self.take()
                self.take("=")
                value = []
                while self.peek() != ";":
                    value.append(self.take())
                self.constants["/".join((*scope, name))] = (kind, " ".join(value))
            elif word in ("union", "interface", "valuetype", "bitset", "bitmask"):
                raise UnsupportedError(f"IDL {word}")
            else:
                raise ParseError(f"unexpected {word!r}", "IDL")
            if self.peek() == ";":
                self.take()

    def struct(self, scope: tuple[str, ...]) -> None:
        self.take("struct")
        message = Message("/".join((*scope, self.take())))
        if self.peek() == ":":
            self.take()
            parent = self.take().replace("::", "/")
            message.fields += self.types["/".join((*scope, parent)) if "/".join((*scope, parent)) in self.types else parent].fields
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                self.skip_annotations()
                kind = self.type(scope)
                message.fields += [Field(n, k) for n, k in self.declarators(kind)]
                self.take(";")
            self.take("}")
        self.types[message.name] = message

    def declarators(self, kind) -> list[tuple[str, object]]:
        out = []
        while True:
            self.skip_annotations()
            name, dims = self.take(), []
            while self.peek() == "[":
                self.take()
                dims.append(self.number(self.take()))
                self.take("]")
            full = kind
            for d in reversed(dims):
                full = Array(full, d)
            out.append((name, full))
            if self.peek() != ",":
                return out
            self.take()

    def number(self, token: str) -> int:
        if token.isdigit():
            return int(token)
        for name, (_, value) in self.constants.items():
            if name.rpartition("/")[2] == token.replace("::", "/").rpartition("/")[2]:
                return int(value, 0)
        raise ParseError(f"{token!r} is no number", "IDL")

    def type(self, scope: tuple[str, ...]):
        word = self.take()
        if word == "sequence":
            self.take("<")
            element, bound = self.type(scope), None
            if self.peek() == ",":
                self.take()
                bound = self.number(self.take())
            self.take(">")
            return Array(element, None, bound)
        if word in ("string", "wstring"):
            if self.peek() == "<":
                self.take()
                self.number(self.take())
                self.take(">")
            return Prim(word)
        if word in ("unsigned", "long"):
            while self.peek() in ("long", "short", "double"):
                word += " " + self.take()
        if word == "long double":
            raise UnsupportedError("IDL long double")
        if word in IDL_NAMES:
            return Prim(IDL_NAMES[word])
        return Ref(word.removeprefix("::").replace("::", "/"))


def parse_idl(name: str, text: str) -> Schema:
    """OMG IDL. Typedefs and enums are resolved; names are spelled with ``/``."""
    reader = _Idl(text)
    reader.definitions(())
    if not reader.types:
        raise ParseError("no struct", "IDL")

    def known(ref: str, scope: str):
        parts = scope.split("/")[:-1]
        for n in range(len(parts), -1, -1):
            full = "/".join((*parts[:n], ref))
            if full in reader.typedefs:
                return walk(reader.typedefs[full], full)
            if full in reader.types:
                return Ref(full)
        return Ref(ref)

    def walk(kind, scope: str):
        if isinstance(kind, Array):
            return replace(kind, element=walk(kind.element, scope))
        return known(kind.name, scope) if isinstance(kind, Ref) else kind

    schema = Schema(name)
    for n, m in reader.types.items():
        mine = {c.rpartition("/")[2]: v for c, v in reader.constants.items() if c.rpartition("/")[0] in (n, n + "_Constants")}
        schema.types[n] = Message(n, [replace(f, type=walk(f.type, n)) for f in m.fields], mine)
    return _complete(schema)


def parse_ros2_idl(name: str, text: str) -> Schema:
    """IDL texts joined by rules of ``=`` and ``IDL: `` lines."""
    body = "\n".join(x for x in text.splitlines() if not re.fullmatch(r"={3,}\s*", x) and not x.startswith("IDL: "))
    return parse_idl(name, body)


def parse(name: str, text: str, encoding: str | None = None, ros1: bool = False) -> Schema:
    """A schema text of the stated encoding (msg, idl, ros2idl and their spellings), or of what it looks like."""
    stated = (encoding or "").lower().replace("_", "")
    if stated in ("ros2idl", "idl") and "IDL:" in text or not stated and re.search(r"(?m)^IDL:", text):
        return parse_ros2_idl(name, text)
    if stated in ("idl", "omgidl", "ros2idl") or not stated and re.search(r"(?m)^\s*(module|struct)\s", text):
        return parse_idl(name, text)
    if stated and "msg" not in stated:
        raise UnsupportedError(f"schema encoding {encoding!r}")
    return parse_msg(name, text, ros1)
