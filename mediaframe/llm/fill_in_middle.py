"""Fill-in-the-middle texts, assembled from pieces by a secondary sort.

A text is cut at two places into prefix, middle and suffix, each into units of at most `unit` code points. The units, with
the sentinel of their part before a part's first, are rows keyed by document and place in the output; one shuffle by
document and a sort by place within the partitions bring them in output order, in which they stream into a digest. For
restoration the output stream alone is read, its sentinels are found wherever units end, and what lies between them is
sorted once more within the partitions, by place in the text. So no document is ever whole in a task's memory after it
has been cut, and a hot doc_id is many documents, not one: rows are keyed by their number, which a task that runs again
gives again.

Nulls and ties: a null text is empty, and so plain; a null doc_id hashes as an empty one; repeated rows are documents of
their own. Only doc_id and text are read, whatever other columns there are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Place in the text of the part after each sentinel.
_PLACE = {PREFIX.encode(): 0, MIDDLE.encode(): 1, SUFFIX.encode(): 2}
ROWS, ROW_BYTES = 4096, 4 << 20
_ABOUT = "n long, form string, prefix_chars long, middle_chars long"


def cut(doc_id: str | None, text: str, seed: int = 1) -> tuple[str, int, int]:
    """The form, and where prefix and middle end."""
    n = len(text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not n or h3 % 100 >= 90 or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < 20 else "psm", a, b


class _Rows:
    """Collects rows into record batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= ROWS or self.bytes >= ROW_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema, strict=True)], schema=self.schema)
            self.rows, self.bytes = [], 0


def _arrow(ids: pa.DataType, *names: str) -> pa.Schema:
    kinds = {"doc_id": ids, "form": pa.string(), "data": pa.binary(), "output": pa.string(), "output_sha256": pa.string(), "restored_sha256": pa.string(), "part": pa.int32()}
    return pa.schema([(n, kinds.get(n, pa.int64())) for n in names])


def pieces(docs: DataFrame, seed: int = 1, unit: int = 8192) -> DataFrame:
    """Rows (doc, doc_id, pos, n, form, prefix_chars, middle_chars, data): the units of all outputs, in the order of their texts; pos is the place in the output, and the columns before data are null but at pos 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            out = out or _Rows(_arrow(b.column(1).type, "doc", "doc_id", "pos", "n", "form", "prefix_chars", "middle_chars", "data"))
            for doc, doc_id, name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                text = text.as_py() or ""
                form, x, y = cut(name, text, seed)
                about = (len(text), form, None, None) if form == "plain" else (len(text), form, x, y - x)
                parts = [("", 0, len(text))] if form == "plain" else [(PREFIX, 0, x), (MIDDLE, x, y), (SUFFIX, y, len(text))]
                units = [max(1, -(-(j - i) // unit)) for _, i, j in parts]
                first = {"plain": [0], "psm": [0, units[0] + units[-1], units[0]], "spm": [units[-1], units[0] + units[-1], 0]}[form]
                for (sentinel, i, j), k, at in zip(parts, units, first, strict=True):
                    for u in range(k):
                        data = ((sentinel if u == 0 else "") + text[i + u * unit : min(j, i + (u + 1) * unit)]).encode("utf-8")
                        yield from out.add((doc, doc_id if at + u == 0 else None, at + u, *(about if at + u == 0 else (None,) * 4), data), len(data))
        if out:
            yield from out.rest()

    d = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    return d.mapInArrow(run, f"doc long, doc_id {kind}, pos long, {_ABOUT}, data binary")


def in_output_order(units: DataFrame) -> DataFrame:
    """The units of a document in one partition, sorted by their places."""
    return units.repartition("doc").sortWithinPartitions("doc", "pos")


def outputs(units: DataFrame) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output) with the whole output texts."""
    kind = units.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, held = None, None, []
        for b in batches:
            out = out or _Rows(_arrow(b.column(1).type, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))
            for doc_id, pos, *about, data in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                if pos == 0 and head:
                    yield from out.add((*head, b"".join(held).decode("utf-8")), sum(map(len, held)))
                if pos == 0:
                    head, held = (doc_id, *about), []
                held.append(data)
        if head:
            yield from out.add((*head, b"".join(held).decode("utf-8")))
            yield from out.rest()

    return in_output_order(units).mapInArrow(run, f"doc_id {kind}, {_ABOUT}, output string")


class Reader:
    """Reads an output as it streams by: its digest, and the runs of bytes of the text's parts, with their places."""

    def __init__(self, form: str) -> None:
        self.sha, self.place = hashlib.sha256(), 0
        self.due = {"plain": [], "psm": [b"<P>", b"<S>", b"<M>"], "spm": [b"<S>", b"<P>", b"<M>"]}[form]
        self.tail = b""

    def read(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        self.sha.update(data)
        data, self.tail = self.tail + data, b""
        while self.due:
            at = data.find(self.due[0])
            if at < 0:
                self.tail = data[max(0, len(data) - 2) :]  # a sentinel can go on in the next unit
                data = data[: max(0, len(data) - 2)]
                break
            if at:
                yield self.place, data[:at]
            self.place = _PLACE[self.due.pop(0)]
            data = data[at + 3 :]
        if data:
            yield self.place, data

    def rest(self) -> Iterator[tuple[int, bytes]]:
        if self.due:
            raise ValueError("an output lacks a sentinel")
        return iter(())


def digests(units: DataFrame) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of the units' documents: the digests of the output and of the text that is rebuilt from the output and its form."""
    kind = units.schema["doc_id"].dataType.simpleString()
    names = ("doc", "part", "pos", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "data")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, reader, at = None, None, None, 0

        def end() -> Iterator[pa.RecordBatch]:
            list(reader.rest())
            return out.add((head[0], 3, 0, *head[1:], reader.sha.hexdigest(), None))

        for b in batches:
            out = out or _Rows(_arrow(b.column(1).type, *names))
            for doc, doc_id, pos, n, form, prefix, middle, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if pos == 0:
                    if head:
                        yield from end()
                    head, reader, at = (doc, doc_id, n, form, prefix, middle), Reader(form), 0
                for place, run in reader.read(data):
                    yield from out.add((doc, place, at, None, None, None, None, None, None, run), len(run))
                    at += 1
        if head:
            yield from end()
            yield from out.rest()

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sha = None, hashlib.sha256()
        for b in batches:
            out = out or _Rows(_arrow(b.column(3).type, *names[3:9], "restored_sha256"))
            for part, head, data in zip(b.column(1).to_pylist(), zip(*(c.to_pylist() for c in b.columns[3:9]), strict=True), b.column(9).to_pylist(), strict=True):
                if part == 3:
                    yield from out.add((*head, sha.hexdigest()))
                    sha = hashlib.sha256()
                else:
                    sha.update(data)
        if out:
            yield from out.rest()

    found = in_output_order(units).mapInArrow(read, f"doc long, part int, pos long, doc_id {kind}, {_ABOUT}, output_sha256 string, data binary")
    return found.sortWithinPartitions("doc", "part", "pos").mapInArrow(restore, f"doc_id {kind}, {_ABOUT}, output_sha256 string, restored_sha256 string")
