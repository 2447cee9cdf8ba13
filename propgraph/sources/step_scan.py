"""The data source "step": statements of STEP files, read from any byte on.

A split may begin inside a text, a comment or a record.  What it means there depends on everything before,
but only by one of five states, so a first pass gives for every split the state in which it ends for each
state in which it may begin; put together from split to split they tell how each begins.  In the second
pass a split skips to the end of the record that it begins in, and reads the last one that begins in it
to its end.  A file of one split needs no first pass.  A task takes one split, or several that are shorter, so
that tasks grow with the bytes and not with the files.

Files are opened through pyarrow's file systems (local, hdfs, s3, gcs), at most a split and a record at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 32 << 20
#: Tasks a core that splits are cut for; bytes that opening a file counts as.
TASKS, OPEN = 8, 1 << 12
#: Bytes read beyond a split's end at a time, for its last record; and statements in one batch.
MORE, BATCH = 1 << 16, 4096

#: States: outside of texts and comments, there after a slash, in a text, in a comment, there after a star.
PLAIN, SLASH, TEXT, COMMENT, STAR = range(5)

_STOP = re.compile(rb"'|;|/\*|/\Z")
_SOME = re.compile(rb"\S")
_COMMENT = re.compile(rb"('(?:[^']|'')*')|/\*.*?\*/", re.S)
_STATEMENT = re.compile(r"\s*(?:#\s*([0-9]+)\s*=\s*)?([A-Za-z0-9_\-]+)\s*(?:(\(.*\))\s*)?;", re.S)
_TOKEN = re.compile(r"'(?:[^']|'')*'|[(),]|[^'(),]+")
_ESCAPE = re.compile(r"\\X2\\((?:[0-9A-F]{4})+)\\X0\\|\\X4\\((?:[0-9A-F]{8})+)\\X0\\|\\X\\([0-9A-F]{2})|\\S\\(.)|\\P[A-I]\\|\\(\\)")


def passed(data: bytes, state: int) -> tuple[int, bool, bool]:
    """From a state at the beginning of data: the state at its end, whether a statement ends in it, and whether there is anything since (or at all)."""
    at, ended, some = 0, False, False
    if state == SLASH and data:
        state, at, some = (COMMENT, 1, False) if data[:1] == b"*" else (PLAIN, 0, True)
    elif state == STAR and data:
        state, at = (PLAIN, 1) if data[:1] == b"/" else (COMMENT, 0)
    while at < len(data):
        if state == PLAIN:
            m = _STOP.search(data, at)
            some = some or bool(_SOME.search(data, at, m.start() if m else len(data)))
            if not m:
                break
            at = m.end()
            if m[0] == b";":
                ended, some = True, False
            elif m[0] == b"'":
                state, some = TEXT, True
            else:
                state = COMMENT if m[0] == b"/*" else SLASH
        elif state == TEXT:
            end = data.find(b"'", at)
            if end < 0:
                break
            state, at = PLAIN, end + 1
        else:
            end = data.find(b"*/", at)
            if end < 0:
                state = STAR if data.endswith(b"*") else COMMENT
                break
            state, at = PLAIN, end + 2
    return state, ended, some


class Window:
    """The bytes of a file from `start` on, as far as they were asked for."""

    def __init__(self, file: pa.NativeFile, start: int, stop: int):
        self.file, self.start = file, start
        file.seek(start)
        self.data = file.read(stop - start)
        self.whole = False

    def grow(self) -> bool:
        more = self.file.read(max(MORE, len(self.data) // 4))
        self.data += more
        return bool(more)


def end_of(window: Window, at: int, state: int) -> int:
    """The place after the semicolon that ends the statement around `at`; -1 if the file ends before."""
    data = window.data
    while True:
        if state == PLAIN:
            m = _STOP.search(data, at)
            if m and m[0] == b";":
                return m.end()
            if m and m[0] != b"/":
                state, at = (TEXT if m[0] == b"'" else COMMENT), m.end()
                continue
            at = m.start() if m else len(data)
        else:
            mark = b"'" if state == TEXT else b"*/"
            end = data.find(mark, at)
            if end >= 0:
                state, at = PLAIN, end + len(mark)
                continue
            at = max(at, len(data) - len(mark) + 1)
        if not window.grow():
            return -1
        data = window.data


def statements(file: pa.NativeFile, start: int, stop: int, state: int, begun: bool) -> Iterator[tuple[int, bytes, bool]]:
    """(place, bytes, whether it ended) of the statements that begin from start to stop.

    state: that at start; begun: whether a statement that began before start goes on there.
    """
    window = Window(file, start, stop)
    at = 0
    if state in (SLASH, STAR):
        closing = window.data[:1] == (b"*" if state == SLASH else b"/")
        begun = begun or state == SLASH and not closing
        state, at = (COMMENT if state == SLASH else PLAIN, 1) if closing else (PLAIN if state == SLASH else COMMENT, 0)
    if begun or state == TEXT:
        at, state = end_of(window, at, state), PLAIN
        if at < 0:
            return
    while True:
        if state == PLAIN:  # to the first byte that is neither blank nor in a comment
            m = _SOME.search(window.data, at)
            at = m.start() if m else len(window.data)
        else:
            m = None
            end = window.data.find(b"*/", at)
            if end >= 0:
                state, at = PLAIN, end + 2
                continue
        if start + at >= stop and state == PLAIN:
            return
        if m and window.data[at : at + 1] == b"/":
            if len(window.data) < at + 2 and window.grow():
                continue
            if window.data[at : at + 2] == b"/*":
                state, at = COMMENT, at + 2
                continue
        if m:
            end = end_of(window, at, PLAIN)
            yield start + at, window.data[at:end] if end >= 0 else window.data[at:], end >= 0
            if end < 0:
                return
            at = end
        elif start + len(window.data) >= stop:  # a comment that goes beyond the split: what follows begins in another one
            return


def decoded(text: str) -> str:
    """A text with its escapes for characters beyond the basic set made characters."""

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            wide = m[1] or m[2]
            return bytes.fromhex(wide).decode("utf-16-be" if m[1] else "utf-32-be", "replace")
        return chr(int(m[3], 16)) if m[3] else chr(ord(m[4]) + 128) if m[4] else m[5] or ""

    def quoted(m: re.Match) -> str:
        return one(m).replace("'", "''")

    return _ESCAPE.sub(quoted, text) if "\\" in text else text


def arguments(body: str) -> list[str] | None:
    """The arguments between the outer brackets, blanks outside of texts left out; None if brackets do not match."""
    out, now, depth = [], [], 0
    for token in _TOKEN.findall(body):
        if token == "(":
            depth += 1
            if depth == 1:
                continue
        elif token == ")":
            depth -= 1
            if depth < 0:
                return None
            if depth == 0:
                continue
        if depth == 0:
            if token.strip():
                return None  # something after the outer bracket
        elif token == "," and depth == 1:
            out.append("".join(now))
            now = []
        else:
            now.append(decoded(token) if token[0] == "'" else "".join(token.split()))
    if depth:
        return None
    return [*out, "".join(now)] if out or now else []


def parsed(raw: bytes, ended: bool) -> tuple[int | None, str | None, list[str] | None, str | None]:
    """(id, keyword, arguments, None) of a statement, or (None, None, None, its text) of what is none."""
    plain = _COMMENT.sub(lambda m: m[1] or b" ", raw) if b"/*" in raw else raw
    try:
        text = plain.decode()
    except UnicodeDecodeError:
        text = plain.decode("latin-1")
    m = _STATEMENT.fullmatch(text) if ended else None
    args = (arguments(m[3]) if m[3] else []) if m else None
    if args is None or m[1] and not m[3] or m[1] and int(m[1]) >= 1 << 63:
        return None, None, None, text
    return int(m[1]) if m[1] else None, m[2].upper(), args, None


@dataclass
class Split:
    file: str
    start: int
    stop: int
    state: int = PLAIN
    begun: bool = False


@dataclass
class Task(InputPartition):
    splits: list[Split]


def split_size(total: int, least: int, cores: int) -> int:
    """Bytes of a split: as many as give each core TASKS of them, but `least` at least, and no more than SPLIT for it."""
    return max(1, least, min(SPLIT, total // (TASKS * cores)))


def packed(splits: list[Split], size: int) -> list[Task]:
    """Splits in order, those that come next to each other and have `size` bytes at most together as one task."""
    out, room = [], 0
    for s in splits:
        cost = s.stop - s.start + OPEN
        if not out or cost > room:
            out.append(Task([]))
            room = size + OPEN
        out[-1].splits.append(s)
        room -= cost
    return out


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else fs_path(uri))


def fs_path(path: str) -> str:
    import os

    return os.path.abspath(path)


def files(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files of a path: one file, or those of a folder and its folders but hidden ones.  A missing path is an error."""
    system, at = opened(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such STEP file or folder: {path}")
    if info.type == fs.FileType.File:
        return [(head + info.path, info.size)]
    inside = system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = re.compile(r"(^|/)[._][^/]*")
    return sorted((head + x.path, x.size) for x in inside if x.type == fs.FileType.File and not hidden.search(x.path[len(at) :]))


@dataclass
class Reader(DataSourceReader):
    options: dict = field(default_factory=dict)

    def partitions(self) -> list[Task]:
        size = max(1, int(self.options.get("splitbytes", SPLIT)))
        known = {}
        if "begins" in self.options:  # a file of the driver's: options go to every task
            known = {(f, a): (s, bool(b)) for f, a, s, b in json.loads(Path(self.options["begins"]).read_text())}
        out = []
        for name, length in files(self.options["path"]):
            for start in range(0, max(length, 1), size):
                state, begun = known.get((name, start), (PLAIN, False))
                out.append(Split(name, start, min(start + size, length), state, begun))
        return packed(out, size)

    def read(self, task: Task | None) -> Iterator[pa.RecordBatch]:
        for split in task.splits if task else []:  # no task: no files
            yield from self._split(split)

    def _split(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, at = opened(split.file)
        with system.open_input_file(at) as file:
            if self.options.get("pass") == "states":
                yield self._states(split, file)
                return
            rows: list[tuple] = []
            for place, raw, ended in statements(file, split.start, split.stop, split.state, split.begun):
                rows.append((split.file, place, *parsed(raw, ended)))
                if len(rows) == BATCH:
                    yield _batch(rows, STATEMENTS)
                    rows = []
            yield _batch(rows, STATEMENTS)

    def _states(self, split: Split, file: pa.NativeFile) -> pa.RecordBatch:
        file.seek(split.start)
        data = file.read(split.stop - split.start)
        return _batch([(split.file, split.start, split.stop, *map(list, zip(*(passed(data, s) for s in range(5)), strict=True)))], STATES)


STATEMENTS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("id", pa.int64()), ("class", pa.string()), ("args", pa.list_(pa.string())), ("raw", pa.string())])
STATES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("state", pa.list_(pa.int32())), ("ended", pa.list_(pa.bool_())), ("some", pa.list_(pa.bool_()))])
DDL = {"states": "file string, start long, stop long, state array<int>, ended array<boolean>, some array<boolean>", "": "file string, at long, id long, class string, args array<string>, raw string"}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def begins(rows: list[tuple[str, int, list[int], list[bool], list[bool]]]) -> list[tuple[str, int, int, bool]]:
    """(file, start, state, begun) of every split but the first ones, of (file, start, state, ended, some) of all."""
    out, file, state, begun = [], None, PLAIN, False
    for name, start, states, ended, some in sorted(rows):
        if name != file:
            file, state, begun = name, PLAIN, False
        else:
            out.append((name, start, state, begun))
        begun = some[state] if ended[state] else begun or some[state]
        state = states[state]
    return out


class StepSource(DataSource):
    """Options: path, splitBytes, and for the passes of step.statements: pass, begins."""

    @classmethod
    def name(cls) -> str:
        return "step"

    def schema(self) -> str:
        return DDL[self.options.get("pass", "")]

    def reader(self, schema: object) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})
