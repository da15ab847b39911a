"""Body decoders: bytes of a request body to the values in it.

Decoders are total: whatever the bytes, they yield what was found before a fault and a status. Text in and out is a
byte string (code points 0-255). One Arrow function takes a body with its declared types to its entries.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.readings import url_decode_bytes

#: Limits of the parsers.
MAX_TOTAL, MAX_DEPTH, MAX_FIELDS, MAX_KEY, MAX_PARTS, PART_HEADER, FILE_CONTENT = 1 << 20, 32, 1000, 256, 256, 8 << 10, 8 << 10
PROTO_DEPTH, PROTO_FIELDS, MAX_FRAMES, MAX_RUNS, RUN = 16, 1024, 256, 256, 8
BOMB = 8 << 20
POSITIONAL = ("prototype", "__proto__", "constructor")


class Fault(Exception):
    """A body that is not what it says: malformed, too_deep, too_many, too_large, undecodable, no_boundary."""


Entry = tuple[str, str, str]  # target, key, data

_JSON = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|"((?:[^"\\\x00-\x1f]|\\.)*)"|(true|false|null)(?![A-Za-z0-9_])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9A-Za-z.]))', re.S)
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/"}


def _utf8(code: int) -> str:
    return (chr(code) if not 0xD800 <= code < 0xE000 else "\ufffd").encode().decode("latin-1")


def json_string(raw: str) -> str:
    """The inside of a JSON string without its escapes; a lone surrogate is U+FFFD."""
    if "\\" not in raw:
        return raw
    if re.search(r"\\(?![\"\\/bfnrtu])|\\u(?![0-9a-fA-F]{4})", raw.replace("\\\\", "")):
        raise Fault("malformed")

    def one(m: re.Match) -> str:
        if m["pair"]:
            hi, lo = int(m["pair"][2:6], 16), int(m["pair"][8:12], 16)
            return _utf8(0x10000 + (hi - 0xD800 << 10) + lo - 0xDC00)
        return _utf8(int(m["u"], 16)) if m["u"] else _ESCAPES[m["c"]]

    return re.sub(r"(?P<pair>\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})|\\u(?P<u>[0-9a-fA-F]{4})|\\(?P<c>.)", one, raw, flags=re.S)


def json_entries(src: str) -> Iterator[Entry]:
    """Keys as ARGS_NAMES (key: the path of their object) and leaves as ARGS under their path, in order; repeated keys all count."""
    at, n = 0, 0
    # each level: [path, kind, index or None, what may come next]
    stack: list[list] = []
    expect = "value"

    def token() -> re.Match:
        nonlocal at
        m = _JSON.match(src, at)
        if not m or m.end() == at:
            raise Fault("malformed")
        at = m.end()
        return m

    path = ""
    while True:
        m = token()
        mark = m[1]
        if expect in ("value", "value_or_end"):
            if mark == "]" and expect == "value_or_end":
                stack.pop()
            elif mark in ("{", "["):
                if len(stack) >= MAX_DEPTH:
                    raise Fault("too_deep")
                stack.append([path, mark, 0])
                if mark == "{":
                    expect = "key_or_end"
                else:
                    path = f"{path}[0]"
                    expect = "value_or_end"
                continue
            elif mark:
                raise Fault("malformed")
            else:
                n += 1
                if n > MAX_FIELDS:
                    raise Fault("too_many")
                yield "ARGS", path, json_string(m[2]) if m[2] is not None else m[3] or m[4]
        elif expect in ("key", "key_or_end"):
            if mark == "}" and expect == "key_or_end":
                stack.pop()
            elif m[2] is not None:
                key, parent = json_string(m[2]), stack[-1][0]
                n += 1
                if n > MAX_FIELDS:
                    raise Fault("too_many")
                yield "ARGS_NAMES", parent, key
                if parent and key in POSITIONAL:
                    yield "ARGS_NAMES", f"{parent}.{key}", f"{parent}.{key}"
                if token()[1] != ":":
                    raise Fault("malformed")
                path = f"{parent}.{key[:MAX_KEY]}" if parent else key[:MAX_KEY]
                expect = "value"
                continue
            else:
                raise Fault("malformed")
        elif expect == "next":
            top = stack[-1]
            if mark == ",":
                if top[1] == "{":
                    expect = "key"
                else:
                    top[2] += 1
                    path = f"{top[0]}[{top[2]}]"
                    expect = "value"
                continue
            if mark != ("}" if top[1] == "{" else "]"):
                raise Fault("malformed")
            stack.pop()
        if not stack:
            if src[at:].strip(" \t\n\r"):
                raise Fault("malformed")
            return
        expect = "next"


def form_entries(src: str, names: bool = True) -> Iterator[Entry]:
    """Pairs between &; names and values are decoded."""
    for k, pair in enumerate(p for p in src.split("&") if p):
        if k >= MAX_FIELDS:
            raise Fault("too_many")
        name, _, value = pair.partition("=")
        name = url_decode_bytes(name)
        yield "ARGS", name, url_decode_bytes(value)
        if names:
            yield "ARGS_NAMES", "", name


def boundary(content_type: str | None) -> str | None:
    """The boundary of a multipart type; '' if it names none; None if it is no multipart type."""
    if not content_type or not content_type.strip().lower().startswith("multipart/"):
        return None
    m = re.search(r';\s*boundary\s*=\s*(?:"([^"]*)"|([^;\s]*))', content_type, re.I)
    return (m[1] or m[2] or "") if m else ""


def multipart_entries(src: str, mark: str) -> Iterator[Entry]:
    """Values, file names and part headers of a multipart body; lines may end in LF alone."""
    pieces = re.split(rf"(?:\A|\r?\n)--{re.escape(mark)}(?=--|[ \t]*\r?\n|\Z)", src)
    closed = False
    for k, piece in enumerate(pieces[1:]):
        if piece.startswith("--"):
            closed = True
            break
        if k >= MAX_PARTS:
            raise Fault("too_many")
        head = re.match(r"[ \t]*\r?\n(?:(.*?)(\r?\n\r?\n)|(\r?\n))?", piece, re.S)
        if not head or head[2] is None and head[3] is None:
            raise Fault("malformed")
        lines = re.split(r"\r?\n(?![ \t])", head[1] or "")
        if len(head[1] or "") > PART_HEADER:
            raise Fault("too_large")
        body = piece[head.end() :]
        headers = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
        disposition = headers.get("content-disposition", "")
        m = re.search(r';\s*name\*?\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^;\s]*))', disposition, re.I)
        f = re.search(r';\s*filename\*?\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^;\s]*))', disposition, re.I)
        name = (m[1] if m[1] is not None else m[2]) if m else f"{k}.unnamed"
        if m:
            yield "ARGS_NAMES", "", name
        if f:
            file = f[1] if f[1] is not None else f[2]
            yield "FILES_NAMES", f"{name}.filename", file
            yield "ARGS", f"{name}.filename", file
            body = body[:FILE_CONTENT]
        if kind := headers.get("content-type"):
            yield "REQUEST_HEADERS", "content-type", kind
            if c := re.search(r'charset\s*=\s*"?([^";\s]+)', kind, re.I):
                yield "REQUEST_HEADERS", "charset", c[1]
        yield "ARGS", name, body
    if len(pieces) < 2 or not closed:
        raise Fault("malformed")


def unpack(data: bytes, coding: str | None) -> bytes:
    """Undo the last content coding; gzip is also known by its magic. Beyond BOMB bytes it is a bomb."""
    last = (coding or "").split(",")[-1].strip().lower()
    if not last or last == "identity":
        if data[:2] != b"\x1f\x8b":
            return data
        last = "gzip"
    tries = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15), "zlib": (15,)}.get(last)
    if not tries:
        raise Fault("undecodable")
    for wbits in tries:
        try:
            d = zlib.decompressobj(wbits)
            out = d.decompress(data, BOMB)
            if d.unconsumed_tail:
                raise Fault("too_large")
            return out
        except zlib.error:
            continue
    raise Fault("undecodable")


def is_binary(data: str) -> bool:
    """A NUL near the start, or more than a third of it is no text."""
    head = data[:1024]
    return "\x00" in head or len(re.findall(r"[^\t\n\r\x20-\x7e\x80-\xff]", head)) * 3 > len(head)


def printable_runs(data: str, name: str = "body") -> list[Entry]:
    """Runs of at least RUN printable characters, keyed by where they start."""
    found = re.finditer(rf"[ -~]{{{RUN},}}", data)
    return [("REQUEST_BODY", f"{name}@{m.start()}", m[0]) for _, m in zip(range(MAX_RUNS), found, strict=False)]


def decode_base64(data: str, least: int) -> str | None:
    """Lenient base64 of either alphabet; None if a text is not of it."""
    if len(data) < least or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", data):
        return None
    core = data.rstrip("=").replace("-", "+").replace("_", "/")
    core = core[: len(core) - (len(core) % 4 == 1)]
    return base64.b64decode(core + "=" * (-len(core) % 4)).decode("latin-1")


def grpc_frames(data: bytes) -> list[tuple[bool, bytes]] | None:
    """(compressed, payload) of frames that tile the body; None if they do not."""
    at, out = 0, []
    while at < len(data):
        if len(data) - at < 5 or data[at] > 1 or len(out) >= MAX_FRAMES:
            return None
        size = int.from_bytes(data[at + 1 : at + 5], "big")
        if at + 5 + size > len(data):
            return None
        out.append((bool(data[at]), data[at + 5 : at + 5 + size]))
        at += 5 + size
    return out or None


def _varint(data: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while at < len(data) and shift < 70:
        v |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return v, at
    raise Fault("malformed")


def protobuf_fields(data: bytes) -> list[tuple[int, int, bytes]]:
    """(number, wire type, content of length-delimited fields) of one message."""
    at, out = 0, []
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if not number or wire in (3, 4, 6, 7):
            raise Fault("malformed")
        body = b""
        if wire == 0:
            _, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if wire == 2 else (8 if wire == 1 else 4, at)
            if at + size > len(data):
                raise Fault("malformed")
            body, at = data[at : at + size], at + size
        out.append((number, wire, body))
    return out


def protobuf_entries(data: bytes, path: str = "", depth: int = 0, left: list | None = None) -> Iterator[Entry]:
    """Text leaves under paths of field numbers; what parses as a message is walked too."""
    left = [PROTO_FIELDS] if left is None else left
    if depth > PROTO_DEPTH:
        raise Fault("too_deep")
    for number, wire, body in protobuf_fields(data):
        left[0] -= 1
        if left[0] < 0:
            raise Fault("too_many")
        if wire != 2 or not body:
            continue
        here = f"{path}.{number}" if path else str(number)
        text = body.decode("latin-1")
        nested = False
        try:
            nested = bool(protobuf_fields(body))
        except Fault:
            pass
        if not nested or not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text):
            yield "ARGS", here, text
        if nested:
            yield from protobuf_entries(body, here, depth + 1, left)


def _kept(it: Iterator[Entry], out: list[Entry]) -> str:
    """Take entries until a fault; the status."""
    try:
        for e in it:
            out.append(e)
    except Fault as f:
        return str(f)
    return "ok"


def decode_body(data: bytes, content_type: str | None = None, coding: str | None = None, grpc_coding: str | None = None, form_names: bool = True) -> tuple[list[Entry], str]:
    """Entries of a body and its status. What no decoder takes is recorded whole: decoded base64, gRPC messages, printable runs of binary data, or the text itself."""
    out: list[Entry] = []
    try:
        data = unpack(data, coding)
    except Fault as f:
        return [("REQUEST_BODY", "", data.decode("latin-1"))], str(f)
    text, kind = data.decode("latin-1"), (content_type or "").split(";")[0].strip().lower()
    mark = boundary(content_type)
    if mark is not None:
        if not mark:
            return [("REQUEST_BODY", "", text)], "no_boundary"
        status = _kept(multipart_entries(text, mark), out)
        return (out, status) if status == "ok" else (out + [("REQUEST_BODY", "", text)], status)
    json_like = text.lstrip(" \t\n\r")[:1] in ("{", "[")
    is_json = kind == "application/json" or kind == "text/json" or kind.endswith("+json")
    if is_json or json_like:
        status = _kept(json_entries(text), out)
        if status == "ok":
            return out, status
        if is_json:
            return out + [("REQUEST_BODY", "", text)], status
        out.clear()
    if kind == "application/x-www-form-urlencoded":
        status = _kept(form_entries(text, form_names), out)
        return (out, status) if status == "ok" else (out + [("REQUEST_BODY", "", text)], status)
    frames = grpc_frames(data)
    if kind.startswith("application/grpc") or frames and is_binary(text):
        if not frames:
            return [("REQUEST_BODY", "", text), *printable_runs(text)], "malformed"
        status = "ok"
        for k, (packed, payload) in enumerate(frames):
            try:
                payload = unpack(payload, grpc_coding or "gzip") if packed else payload
                here: list[Entry] = []
                if _kept(protobuf_entries(payload), here) == "ok":
                    out += here
                else:
                    out += [("REQUEST_BODY", f"body#{k}@{key.rpartition('@')[2]}", run) for _, key, run in printable_runs(payload.decode("latin-1"))]
            except Fault:
                status = "undecodable"
        return out, status
    decoded = decode_base64(text.strip(), 8)
    if decoded is not None:
        out.append(("REQUEST_BODY", "", text))
        return out + ([("REQUEST_BODY", "", decoded)] if not is_binary(decoded) else printable_runs(decoded)), "ok"
    if is_binary(text):
        return printable_runs(text), "ok"
    return [("REQUEST_BODY", "", text)], "ok"


ENTRIES = "struct<entries:array<struct<arrived:int,target:string,key:string,data:string>>,status:string>"
_ENTRY = pa.struct([("arrived", pa.int32()), ("target", pa.string()), ("key", pa.string()), ("data", pa.string())])


def body_entries(body: Column, content_type: Column, coding: Column, grpc_coding: Column, form_names: Column) -> Column:
    """ENTRIES of a body column; null for no body."""

    @F.arrow_udf(ENTRIES)
    def body_decoder(body: pa.Array, kind: pa.Array, coding: pa.Array, grpc: pa.Array, names: pa.Array) -> pa.Array:
        rows = []
        for b, k, c, g, n in zip(*(x.to_pylist() for x in (body, kind, coding, grpc, names)), strict=True):
            if b is None:
                rows.append(None)
                continue
            found, status = decode_body(b, k, c, g, bool(n))
            rows.append({"entries": [{"arrived": 2, "target": t, "key": key, "data": d} for t, key, d in found], "status": status})
        return pa.array(rows, pa.struct([("entries", pa.list_(_ENTRY)), ("status", pa.string())]))

    return body_decoder(body, content_type, coding, grpc_coding, form_names)
