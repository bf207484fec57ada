"""Rollout steps as a data source: one JSON-lines file a step, read in the order of their numbers, written whole or not.

``spark.dataSource.register(RolloutSource)`` makes ``spark.read.format("rollouts")`` known. Options: ``path``, a folder
that driver and executors share, as a plain path, ``file:`` or a URI that pyarrow's file systems know; ``mode``
"strict" (a broken line is an error) or "permissive" (the default: it goes to the last column as text).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "step long, idx long, input string, output string, gts string, score double, broken string"
_NAME = re.compile(r"^(\d+)\.jsonl$")
MANIFEST = "_manifest.json"


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _read(store, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def steps(path: str) -> list[int]:
    """Steps of a folder in order: those that its manifest names, or all files of a number where it has none."""
    from pyarrow import fs

    store, root = _store(path)
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        return sorted(int(s) for s in json.loads(_read(store, f"{root}/{MANIFEST}"))["steps"])
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(m[1]) for f in found if f.type == fs.FileType.File and (m := _NAME.match(f.base_name)))


@dataclass
class StepFile(InputPartition):
    step: int
    file: str


def _files(path: str, wanted: list[int]) -> list[StepFile]:
    """The files of steps, as the manifest names them."""
    from pyarrow import fs

    store, root = _store(path)
    named = json.loads(_read(store, f"{root}/{MANIFEST}"))["steps"] if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File else {}
    return [StepFile(s, f"{root}/{named[str(s)]['file'] if str(s) in named else f'{s}.jsonl'}") for s in wanted]


def _rows(path: str, part: StepFile, strict: bool) -> Iterator[tuple]:
    """A step's lines; a broken one has its text in the last column and nothing else."""
    import io

    store, _ = _store(path)
    with store.open_input_stream(part.file) as f:
        for idx, line in enumerate(io.TextIOWrapper(f, encoding="utf-8", errors="replace", newline="\n")):
            line = line.rstrip("\r\n")
            if not line.strip():
                continue
            try:
                record = json.loads(line)
                if not isinstance(record, dict):
                    raise ValueError("not an object")
                score = record.get("score")
                text = [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in map(record.get, ("input", "output", "gts"))]
                yield (part.step, idx, *text, None if score is None else float(score), None)
            except (ValueError, TypeError) as e:
                if strict:
                    raise ValueError(f"step {part.step}, line {idx + 1}: {e}") from e
                yield (part.step, idx, None, None, None, None, line)


class RolloutSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rollouts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> RolloutReader:
        return RolloutReader(self.options)

    def streamReader(self, schema: T.StructType) -> RolloutStream:  # noqa: N802  the interface's name
        return RolloutStream(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> RolloutWriter:
        return RolloutWriter(self.options, schema, overwrite)


@dataclass
class RolloutReader(DataSourceReader):
    """One partition a step, in their order. Filters on the step choose files before any is opened."""

    options: dict
    bounds: list[Filter] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and f.attribute == ("step",):
                self.bounds.append(f)
            else:
                yield f

    def _keeps(self, step: int) -> bool:
        for f in self.bounds:
            holds = step in f.value if isinstance(f, In) else {EqualTo: step == f.value, GreaterThan: step > f.value, GreaterThanOrEqual: step >= f.value, LessThan: step < f.value, LessThanOrEqual: step <= f.value}[type(f)]
            if not holds:
                return False
        return True

    def partitions(self) -> list[StepFile]:
        return _files(self.options["path"], [s for s in steps(self.options["path"]) if self._keeps(s)])

    def read(self, partition: StepFile) -> Iterator[tuple]:
        if partition is None:
            return iter(())
        return _rows(self.options["path"], partition, self.options.get("mode") == "strict")


@dataclass
class RolloutStream(DataSourceStreamReader):
    """Steps as they arrive. An offset is the last step; a step that arrives with a smaller number is never read."""

    options: dict

    def initialOffset(self) -> dict:  # noqa: N802
        return {"step": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"step": max(steps(self.options["path"]), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[StepFile]:
        return _files(self.options["path"], [s for s in steps(self.options["path"]) if start["step"] < s <= end["step"]])

    def read(self, partition: StepFile) -> Iterator[tuple]:
        return _rows(self.options["path"], partition, self.options.get("mode") == "strict")

    def commit(self, end: dict) -> None:
        return None

    def stop(self) -> None:
        return None


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    counts: dict[int, int]
    errors: int


@dataclass
class RolloutWriter(DataSourceWriter):
    """Rows to a file a step and task in a folder of the job; what counts is the manifest that the commit writes last.

    Rows need a ``step``; those with a text in the column ``error``, if there is one, are dead letters: they go to a file
    apart, which the manifest names too. Tasks write under names of their own, so that a failed or repeated one leaves
    nothing that the manifest names. The commit puts a step's pieces together in the order of the tasks as one file, and
    the manifest in place by a rename; an abort deletes the job's folder. Appending keeps the steps of the manifest
    before (an equal step is replaced); overwriting forgets them.
    """

    options: dict
    kind: T.StructType
    overwrite: bool

    def __post_init__(self):
        self.job = uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = _store(self.options["path"])
        own = f"{root}/_jobs/{self.job}/{context.partitionId():06d}-{context.taskAttemptId()}"
        names = [f.name for f in self.kind.fields]
        open_, counts, errors = {}, {}, 0
        try:
            for row in rows:
                record = row.asDict(recursive=True) if hasattr(row, "asDict") else dict(zip(names, row, strict=True))
                step, error = record.pop("step", None), record.get("error")
                if step is None:
                    raise ValueError("a rollout needs a step")
                if error is None:
                    record.pop("error", None)
                    counts[step] = counts.get(step, 0) + 1
                else:
                    record["step"], step, errors = step, "errors", errors + 1
                if step not in open_:
                    if len(open_) >= 64:  # few files are open at a time
                        open_.pop(next(iter(open_))).close()
                    store.create_dir(own, recursive=True)
                    piece = f"{own}/{step}.{uuid.uuid4().hex[:6]}.jsonl"
                    open_[step] = store.open_output_stream(piece)
                open_[step].write((json.dumps({k: v for k, v in record.items() if v is not None}, ensure_ascii=False, default=str) + "\n").encode())
        finally:
            for f in open_.values():
                f.close()
            if open_ and self._aborted(store, root):  # a task that outlives its job clears up after itself
                store.delete_dir(own)
        return Written([own], counts, errors)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.options["path"])
        store.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        pieces: dict[str, list[str]] = {}
        for own in sorted(f for m in done for f in m.files):
            for piece in sorted((p for p in store.get_file_info(fs.FileSelector(own, allow_not_found=True))), key=lambda p: p.mtime_ns or 0):
                pieces.setdefault(piece.base_name.split(".")[0], []).append(piece.path)
        before = {}
        if not self.overwrite and store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            before = json.loads(_read(store, f"{root}/{MANIFEST}"))
        named = dict(before.get("steps", {}))
        dead = list(before.get("errors", []))
        for step, parts in sorted(pieces.items()):
            to = f"{step}.{self.job}.jsonl"
            with store.open_output_stream(f"{root}/{to}") as out:
                for part in parts:
                    with store.open_input_stream(part) as f:
                        while data := f.read(1 << 20):
                            out.write(data)
            if step == "errors":
                dead.append({"file": to, "rows": sum(m.errors for m in done)})
            else:
                named[step] = {"file": to, "rows": sum(m.counts.get(int(step), 0) for m in done)}
        with store.open_output_stream(f"{root}/{MANIFEST}.{self.job}") as out:
            out.write(json.dumps({"steps": named, "errors": dead}, sort_keys=True).encode())
        store.move(f"{root}/{MANIFEST}.{self.job}", f"{root}/{MANIFEST}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.options["path"])
        store.create_dir(f"{root}/_jobs", recursive=True)
        store.open_output_stream(f"{root}/_jobs/{self.job}.aborted").close()
        self._clear()

    def _aborted(self, store, root: str) -> bool:
        from pyarrow import fs

        return store.get_file_info(f"{root}/_jobs/{self.job}.aborted").type == fs.FileType.File

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = _store(self.options["path"])
        if store.get_file_info(f"{root}/_jobs/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_jobs/{self.job}")
