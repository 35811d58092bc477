"""Spreadsheets (OOXML) as a Spark data source, on the standard library."""

from __future__ import annotations

import io
import os
import re
import shutil
import tempfile
import zipfile
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from html import unescape
from itertools import islice
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: The format's names.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


#: A part of a sheet's text for a task. Each task inflates what comes before its part as well, so there are only so many.
PART_BYTES, MOST_PARTS = 16 << 20, 16


def letters(index: int) -> str:
    """Column letters of a place from 0: A, .. Z, AA, AB, .."""
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_of(reference: str) -> int:
    """The place from 0 of a cell such as ``AB12``."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _entries(z: zipfile.ZipFile, sheet: int | str) -> tuple[str, str | None]:
    """The entries of a sheet, by place or name, and of the shared strings."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))  # noqa: S314
    sheets = [(s.get("name"), s.get(f"{_REL}id")) for s in book.iter(f"{_MAIN}sheet")]
    if isinstance(sheet, int):
        if not 0 <= sheet < len(sheets):
            raise IndexError(f"no sheet {sheet} of {len(sheets)}")
        wanted = sheets[sheet][1]
    else:
        wanted = dict(sheets).get(sheet)
        if wanted is None:
            raise ValueError(f"no sheet {sheet!r}")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}  # noqa: S314
    target = links[wanted].lstrip("/")
    shared = "xl/sharedStrings.xml"
    return target if target.startswith("xl/") else f"xl/{target}", shared if shared in z.namelist() else None


# elements with the prefix that the file gives to their names
def _element(name: bytes) -> bytes:
    return rb"<(?:\w+:)?" + name + rb"(\s[^>]*?)?(?:/>|>(.*?)</(?:\w+:)?" + name + rb">)"


_ROW, _CELL, _VALUE, _T, _SI = (re.compile(_element(n), re.DOTALL) for n in (b"row", b"c", b"v", b"t", b"si"))
_PHONETIC = re.compile(_element(b"rPh"), re.DOTALL)
_REFERENCE, _TYPE = re.compile(rb'\sr="([A-Z]+)[0-9]+"'), re.compile(rb'\st="(\w+)"')
_CDATA = re.compile(rb"<!\[CDATA\[(.*?)\]\]>", re.DOTALL)
_CHUNK = 1 << 20


def _plain(text: bytes) -> str:
    """Characters of an element; white space as it stands but for line ends, which XML makes one."""
    if b"<!" in text:
        text = _CDATA.sub(lambda m: escape(m[1].decode()).encode(), text)
    said = text.decode()
    if "\r" in said:
        said = said.replace("\r\n", "\n").replace("\r", "\n")
    return unescape(said) if "&" in said else said


class _Strings:
    """Shared strings by number: the text is kept as it is in the file, with the place of each, and is read on demand."""

    def __init__(self, z: zipfile.ZipFile, entry: str | None):
        self.raw = z.read(entry) if entry else b""
        self.at = array("q", [x for m in _SI.finditer(self.raw) for x in m.span()])
        self.known: dict[int, str] = {}

    def __getitem__(self, k: int) -> str:
        if k not in self.known:
            if len(self.known) >= 1 << 16:
                self.known.clear()
            self.known[k] = _text(self.raw[self.at[2 * k] : self.at[2 * k + 1]])
        return self.known[k]


def _text(item: bytes) -> str:
    if b"rPh" in item:
        item = _PHONETIC.sub(b"", item)
    return "".join(_plain(m[2] or b"") for m in _T.finditer(item))


#: A cell as most programs write it: column, type, and a value or a text without elements in it.
_USUAL = re.compile(rb'<c(?: r="([A-Z]+)[0-9]+")?(?: s="[0-9]+")?(?: t="(\w+)")?(?:/>|>(?:<v>([^<]*)</v>|<is><t(?: [^>]*)?>([^<]*)</t></is>)?</c>)')


def _cells(row: bytes, strings: _Strings, columns: dict[bytes, int]) -> list:
    usual = _USUAL.findall(row)
    if usual and len(usual) == row.count(b"<c"):
        return _usual_cells(usual, strings, columns)
    out: list = []
    for m in _CELL.finditer(row):
        said, inner = m[1] or b"", m[2]
        at = len(out)
        if reference := _REFERENCE.search(said):
            name = reference[1]
            at = columns[name] if name in columns else columns.setdefault(name, column_of(name.decode()))
        if at >= len(out):
            out += [None] * (at + 1 - len(out))
        if not inner:
            continue
        kind = _TYPE.search(said)
        kind = kind[1] if kind else b"n"
        if kind == b"inlineStr":
            out[at] = _text(inner)
        elif (v := _VALUE.search(inner)) and v[2]:
            out[at] = strings[int(v[2])] if kind == b"s" else v[2] == b"1" if kind == b"b" else _plain(v[2]) if kind in (b"str", b"e") else float(v[2])
    return out


def _usual_cells(cells: list[tuple[bytes, bytes, bytes, bytes]], strings: _Strings, columns: dict[bytes, int]) -> list:
    out: list = []
    for name, kind, v, text in cells:
        if name:
            at = columns[name] if name in columns else columns.setdefault(name, column_of(name.decode()))
            if at != len(out):
                if at < len(out):  # out of order: the place it names is overwritten
                    out[at] = None
                    out = out[:at] + _usual_cells([(b"", kind, v, text)], strings, columns) + out[at + 1 :]
                    continue
                out += [None] * (at - len(out))
        if text:
            out.append(_plain(text) if kind == b"inlineStr" else None)
        elif not v:
            out.append("" if kind == b"inlineStr" else None)
        elif not kind or kind == b"n":
            out.append(float(v))
        else:
            out.append(strings[int(v)] if kind == b"s" else v == b"1" if kind == b"b" else _plain(v) if kind in (b"str", b"e") else float(v))
    return out


def sheet_rows(path: str, sheet: int | str = 0, begin: int = 0, end: int | None = None) -> Iterator[list]:
    """Rows of a sheet, by place or name, as lists of str, float, bool or None: those that begin within the bytes from ``begin`` to ``end`` of its text.

    What comes before is inflated and let go, which is fast; memory is that of a few rows and the shared strings as they are in the file.
    """
    with zipfile.ZipFile(_local(path)) as z:
        entry, shared = _entries(z, sheet)
        strings, columns = _Strings(z, shared), {}
        with z.open(entry) as f:
            at, left = 0, b""
            while at < begin and (skipped := f.read(min(_CHUNK, begin - at))):
                at += len(skipped)
            while chunk := f.read(_CHUNK):
                left += chunk
                done = 0
                for m in _ROW.finditer(left):
                    if end is not None and at + m.start() >= end:
                        return
                    yield _cells(m[2] or b"", strings, columns)
                    done = m.end()
                done = max(done, left.rfind(b"<") if b"row" not in left[done:] else done)
                at, left = at + done, left[done:]
                if end is not None and at >= end and not _ROW_BEGINS.search(left):
                    return


_ROW_BEGINS = re.compile(rb"<(?:\w+:)?row[\s/>]")


def sheet_size(path: str, sheet: int | str = 0) -> int:
    """Bytes of a sheet's text, from the archive's directory."""
    with zipfile.ZipFile(_local(path)) as z:
        return z.getinfo(_entries(z, sheet)[0]).file_size


def _kind(seen: set[type], whole: bool) -> T.DataType:
    if seen == {bool}:
        return T.BooleanType()
    if seen == {float}:
        return T.LongType() if whole else T.DoubleType()
    return T.StringType()


def _names(row: list) -> list[str]:
    return [str(v) if v not in (None, "") else f"_c{k}" for k, v in enumerate(row)]


class XlsxSource(DataSource):
    """Options: path, sheet (place or name), kinds, part_bytes. The first row is the header. A sheet is read by a task for so many bytes of its text.

    Without a schema all rows are read for the types first, by one process (``files.read`` has Spark do it). With ``kinds`` true every cell is text
    after a letter for what it is: n, b or s.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _sheet(self) -> int | str:
        s = self.options.get("sheet", "0")
        return int(s) if s.isdigit() else s

    def schema(self) -> T.StructType:
        rows = sheet_rows(self.options["path"], self._sheet())
        head = _names(next(rows, []))
        if len(set(head)) < len(head):
            raise ValueError("headers repeat")
        if self._kinds():
            return T.StructType([T.StructField(n, T.StringType()) for n in head])
        seen: list[set[type]] = [set() for _ in head]
        whole = [True] * len(head)
        for row in rows:
            for k, v in enumerate(row[: len(head)]):
                if v is not None:
                    seen[k].add(type(v))
                    whole[k] = whole[k] and isinstance(v, float) and v.is_integer()
        return T.StructType([T.StructField(n, _kind(s, w)) for n, s, w in zip(head, seen, whole, strict=True)])

    def _kinds(self) -> bool:
        return self.options.get("kinds", "false") == "true"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], self._sheet(), schema, self._kinds(), int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return XlsxWriter(self.options["path"], schema)


@dataclass
class Part(InputPartition):
    begin: int
    end: int


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: int | str, schema: T.StructType, kinds: bool, part_bytes: int):
        self.path, self.sheet, self.schema, self.kinds, self.part_bytes = path, sheet, schema, kinds, part_bytes

    def partitions(self) -> Sequence[InputPartition]:
        size = sheet_size(self.path, self.sheet)
        n = max(1, min(MOST_PARTS, -(-size // self.part_bytes)))
        return [Part(size * k // n, size * (k + 1) // n) for k in range(n)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows = sheet_rows(self.path, self.sheet, part.begin, part.end)
        head = _names(next(rows if part.begin == 0 else sheet_rows(self.path, self.sheet), []))
        at = [head.index(f.name) for f in self.schema.fields]
        types = [_ARROW.get(f.dataType, pa.string()) for f in self.schema.fields]

        def cell(v, kind: pa.DataType):
            if v is None:
                return None
            if self.kinds:
                return ("b" if isinstance(v, bool) else "n" if isinstance(v, float) else "s") + (v if isinstance(v, str) else repr(v))
            if kind == pa.string():
                return v if isinstance(v, str) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
            return int(v) if kind == pa.int64() else v

        while some := list(islice(rows, 4096)):
            columns = [pa.array([cell(r[k] if k < len(r) else None, t) for r in some], t) for k, t in zip(at, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema.fields])


_ARROW = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}


@dataclass
class Sheet(WriterCommitMessage):
    """A task's rows: deflated, ending at a byte, with the checksum and size of what they inflate to."""

    path: str
    crc: int
    size: int


_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


def cell_xml(v) -> str:
    """A cell; its place is that among the cells of its row."""
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float, Decimal)) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v}</v></c>"
    if isinstance(v, (datetime, date)):
        v = v.isoformat()
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>'


def row_xml(cells: Iterable) -> bytes:
    return f"<row>{''.join(map(cell_xml, cells))}</row>".encode()


def crc_joined(first: int, second: int, size: int) -> int:
    """The CRC-32 of two texts one after the other, by those of each and the size of the second.

    Putting ``size`` zero bytes after the first is a linear map of its 32 bits, taken by squaring; a map is its columns.
    """

    def apply(columns: list[int], bits: int) -> int:
        out = 0
        for c in columns:
            if bits & 1:
                out ^= c
            bits >>= 1
        return out

    one_bit = [0xEDB88320, *(1 << k for k in range(31))]
    power, n = one_bit, size * 8
    while n:
        if n & 1:
            first = apply(power, first)
        power, n = [apply(power, c) for c in power], n >> 1
    return first ^ second


class Deflated:
    """Parts of a stream that is deflated to a file, in blocks that begin anew, so that they can be put one after the other."""

    def __init__(self, out):
        self.out, self.crc, self.size, self.packed = out, 0, 0, 0
        self.made = zlib.compressobj(6, zlib.DEFLATED, -15)

    def write(self, text: bytes) -> None:
        self.crc, self.size = zlib.crc32(text, self.crc), self.size + len(text)
        self._put(self.made.compress(text))

    def end(self, last: bool = False) -> None:
        self._put(self.made.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH))

    def _put(self, packed: bytes) -> None:
        self.packed += self.out.write(packed)


class XlsxWriter(DataSourceWriter):
    """Tasks deflate their rows beside the target; the commit puts these blocks one after the other, with the checksum of the whole made from theirs.

    The target's folder must be one that driver and executors share.
    """

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = _local(path), [f.name for f in schema.fields]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        folder = Path(self.path).resolve().parent
        folder.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("wb", dir=folder, prefix=".staged-", delete=False) as f:
            part, waiting = Deflated(f), []
            for row in rows:
                waiting.append(row_xml(row))
                if len(waiting) == 1024:
                    part.write(b"".join(waiting))
                    waiting = []
            part.write(b"".join(waiting))
            part.end()
        return Sheet(f.name, part.crc, part.size)

    def commit(self, messages: list) -> None:
        made = Path(f"{self.path}.staged")
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
            z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            self._sheet(z, "xl/worksheets/sheet1.xml", [m for m in messages if m is not None])
        os.replace(made, self.path)
        self._clear(messages)

    def _sheet(self, z: zipfile.ZipFile, name: str, parts: list[Sheet]) -> None:
        """An entry made of the tasks' blocks between a beginning and an end; its header is written once its sizes are known."""
        if lost := [m.path for m in parts if not os.path.exists(m.path)]:
            raise FileNotFoundError(f"{lost[0]} isn't there for the driver: {self.path} must be in a folder that driver and executors share")
        head, tail = io.BytesIO(), io.BytesIO()
        begin, end = Deflated(head), Deflated(tail)
        begin.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + row_xml(self.names))
        begin.end()
        end.write(b"</sheetData></worksheet>")
        end.end(last=True)
        info = zipfile.ZipInfo(name)
        info.compress_type, info.CRC, info.file_size = zipfile.ZIP_DEFLATED, begin.crc, begin.size
        for part in [*parts, end]:
            info.CRC, info.file_size = crc_joined(info.CRC, part.crc, part.size), info.file_size + part.size
        info.compress_size = begin.packed + sum(os.path.getsize(m.path) for m in parts) + end.packed
        info.header_offset = z.fp.tell()
        z.fp.write(info.FileHeader(zip64=max(info.file_size, info.compress_size) >= 1 << 31))
        z.fp.write(head.getvalue())
        for m in parts:
            with open(m.path, "rb") as f:
                shutil.copyfileobj(f, z.fp, 1 << 20)
        z.fp.write(tail.getvalue())
        z.filelist.append(info)
        z.NameToInfo[name] = info
        z.start_dir = z.fp.tell()

    def abort(self, messages: list) -> None:
        self._clear(messages)

    @staticmethod
    def _clear(messages: list) -> None:
        for m in messages:
            if m is not None:
                Path(m.path).unlink(missing_ok=True)
