"""Delimited files as relations of strings, and text files of dependencies."""

from __future__ import annotations

import csv
import io
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depdelver.session import cut, shared_dir

#: Bytes of a file that a task reads at least where splits are smaller.
TASK_BYTES = 32 << 20


@dataclass(frozen=True)
class CsvDescriptor:
    """Where a delimited file is and how it is written."""

    name: str
    path: str = "."
    ending: str = "csv"
    header: bool = True
    charset: str = "UTF-8"
    separator: str = ","
    quote: str = '"'
    escape: str = "\\"
    null_string: str = ""
    strict_quotes: bool = False
    ignore_leading_whitespace: bool = True
    skip_lines: int = 0
    skip_differing_lines: bool = True

    @property
    def file(self) -> str:
        name = f"{self.name}.{self.ending}" if self.ending else self.name
        return os.path.join(self.path, name) if "://" not in self.path else f"{self.path.rstrip('/')}/{name}"

    def _options(self) -> dict[str, str]:
        return {
            "sep": self.separator,
            "quote": self.quote,
            "escape": self.escape,
            "encoding": self.charset,
            "nullValue": "",
            "ignoreLeadingWhiteSpace": str(self.ignore_leading_whitespace).lower(),
            "ignoreTrailingWhiteSpace": "false",
            "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": "__corrupt",
        }

    def _lines(self, spark: SparkSession) -> DataFrame:
        """The lines of the file (or the files of a folder): value, path, start (of the split they are in), and a number that rises along a split."""
        if self.charset.upper() in ("UTF-16", "UTF16"):
            raise ValueError("name the byte order: UTF-16LE or UTF-16BE")
        if self.charset.upper().startswith("UTF-16"):  # line feeds of two bytes: read as a file of one column
            wide = {"encoding": self.charset, "lineSep": "\n", "sep": "\u0001", "quote": "\u0002", "escape": "\u0002", "comment": ""}
            lines = spark.read.options(**wide).schema("value string").csv(self.file)
            value = F.ltrim("value", F.lit("\ufeff"))
        else:
            lines = spark.read.option("lineSep", "\n").text(self.file)
            plain = self.charset.upper() in ("UTF-8", "UTF8", "US-ASCII")  # else one that has line feeds as ASCII has
            value = F.col("value") if plain else F.decode(F.col("value").cast("binary"), self.charset)
        out = lines.select(value.alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        return self._gathered(out)

    def _gathered(self, rows: DataFrame) -> DataFrame:
        """With so many small splits a task that tasks read TASK_BYTES each, if all cores have some; lines keep their numbers."""
        sc = rows.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.file)
        files = p.getFileSystem(sc._jsc.hadoopConfiguration())
        tasks = max(4 * sc.defaultParallelism, -(-sum(files.getContentSummary(x.getPath()).getLength() for x in files.globStatus(p) or []) // TASK_BYTES))
        return rows.coalesce(tasks) if rows.rdd.getNumPartitions() > tasks else rows

    def _flagged(self, lines: DataFrame) -> DataFrame:
        """With whether a quote is open at a line's end, if the line begins outside of quotes (out) and if it begins inside (in)."""
        q, s, e = (re.escape(c) for c in (self.quote, self.separator, self.escape))
        inner = rf"(?:[^{q}{e}]|{e}.|{q}{q})*+" if self.escape != self.quote else rf"(?:[^{q}]|{q}{q})*+"
        space = "[ \t]*+" if self.ignore_leading_whitespace else ""
        rest = rf"(?:{space}(?:{q}{inner}{q}[^{s}]*+|[^{q}{s}][^{s}]*+)?+{s})*+{space}{q}{inner}$"
        return lines.select("value", "path", "start", "at", F.col("value").rlike(rf"(?s)^{rest}").alias("out"), F.col("value").rlike(rf"(?s)^{inner}(?:$|{q}[^{s}]*+{s}{rest})").alias("in"))

    def _records(self, flagged: DataFrame) -> tuple[DataFrame, list[str] | None]:
        """Records, (value), where a record with line feeds inside quotes is put together; and the fields of the first one.

        A pass over the flags says of each split of a file how many lines it has and whether a quote
        is open at its end, for both states at its begin; of these, a row a split, the driver finds
        each split's begin. In the second pass a split joins its own lines, without the skipped
        ones and the header of its file; only records that go on in another split are shuffled.
        Splits are told apart by file and offset, however many of them a task reads.
        """
        lines = flagged.select("path", "start", "at", "out", "in")
        skip: dict[tuple[str, int], int] = {}
        if self.skip_lines > 0:
            left: dict[str, int] = {}
            for r in lines.groupBy("path", "start").agg(F.count("*").alias("n")).orderBy("path", "start").collect():  # a row a split
                todo = left.get(r["path"], self.skip_lines)
                skip[r["path"], r["start"]] = min(todo, r["n"])
                left[r["path"]] = todo - min(todo, r["n"])
        ends = {(r["path"], r["start"]): r for r in lines.mapInArrow(_ends(skip), _ENDS).collect()}  # a row a split
        if not ends:
            return flagged, None
        begins, inside, key, file, over = {}, False, -1, None, False
        for seq, part in enumerate(sorted(ends)):
            r = ends[part]
            if part[0] != file:
                if inside:
                    break
                file, inside, key = part[0], False, -1
                drop = self.header
            begins[part] = Begin(seq, skip.get(part, 0), inside, key, drop)
            over |= inside
            last = r["last_in"] if inside else r["last_out"]
            drop = drop and (r["first_in"] if inside else r["first_out"]) < 0  # whether the header is still to come
            inside, key = (r["from_in"] if inside else r["from_out"]), key if last < 0 else last
        if inside:
            raise ValueError(f"{file} ends inside quotes")
        head = self._head(flagged, min(ends), begins)
        held = flagged.sparkSession.sparkContext.broadcast(begins)  # read once a worker, not once a task
        pieces = flagged.mapInArrow(_joiner(held), "key long, seq int, value binary").withColumn("value", F.col("value").cast("string"))
        if not over:
            return pieces.select("value"), head
        pieces = self._gathered(cut(pieces))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
        long_ = pieces.where("key IS NOT NULL").groupBy("key").agg(F.count_if(F.col("value").isNull()).alias("heads"), F.array_join(texts, "\n").alias("value"))
        return pieces.where("key IS NULL").select("value").unionByName(long_.where("heads = 0").select("value")), head

    def _head(self, flagged: DataFrame, first: tuple[str, int], begins: dict) -> list[str]:
        """The fields of the first record of the first file."""
        starts = sorted(start for path, start in begins if path == first[0])
        n = 64
        while True:  # the first splits have it, as a split has a line at least
            near = starts[min(n + self.skip_lines, len(starts)) - 1]
            rows = flagged.where((F.col("path") == first[0]) & (F.col("start") <= near)).orderBy("start", "at").limit(n + self.skip_lines).collect()
            text, inside = [], False
            for r in rows[self.skip_lines :]:
                text.append(r["value"])
                inside = r["in"] if inside else r["out"]
                if not inside:
                    return self._fields("\n".join(text).rstrip("\r"))
            n *= 8

    def read(self, spark: SparkSession) -> DataFrame:
        """A DataFrame of strings.

        The first record that is not skipped gives the width, and with ``header`` the names; else
        they are column1, column2 and so on. Of a folder, every file has its own header and skipped
        lines, and the first file by its name gives the names. Records of another width are dropped
        if ``skip_differing_lines``, else they raise. ``strict_quotes`` keeps only what stands in
        quotes: a field without them is null. Quoted fields may have line feeds; skipped lines are
        counted as lines. A quote that stays open raises. An empty file has no columns.
        """
        body, row = self._records(self._flagged(self._lines(spark)))
        if row is None:
            return spark.createDataFrame([], T.StructType([]))
        names = [v or f"column{i + 1}" for i, v in enumerate(row)] if self.header else [f"column{i + 1}" for i in range(len(row))]
        body = body.select(F.regexp_replace("value", "\r$", "").alias("value")).where(F.length("value") > 0)
        if self.strict_quotes:
            body = body.withColumn("value", _strict(F.col("value"), self.separator, self.quote))
        ddl = ", ".join([*(f"c{i} string" for i in range(len(names))), "__corrupt string"])
        # Written once: without that, column pruning would skip the check of the width.
        parsed = cut(body.select(F.from_csv("value", F.lit(ddl), self._options()).alias("r")).select("r.*"))
        differing = F.col("__corrupt").isNotNull()
        if self.skip_differing_lines:
            parsed = parsed.where(~differing)
        elif parsed.where(differing).head(1):
            raise ValueError(f"{self.file} has lines of another width than its first one")
        # The parser gives null for an empty field, whatever it is told to take as null.
        value = lambda c: c if self.null_string == "" else F.when(F.coalesce(c, F.lit("")) != self.null_string, F.coalesce(c, F.lit("")))
        return parsed.select(*[value(F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])

    def _fields(self, line: str) -> list[str]:
        escape = None if self.escape == self.quote else self.escape
        return next(csv.reader(io.StringIO(line, newline=""), delimiter=self.separator, quotechar=self.quote, escapechar=escape, skipinitialspace=self.ignore_leading_whitespace))


@dataclass(frozen=True)
class Begin:
    """Of a split: its place in the order of all, lines to skip, whether it begins inside quotes, the number of the line
    where the record that is open then began, and whether its first record is its file's header."""

    seq: int
    skip: int
    inside: bool
    key: int
    header: bool


_ENDS = "path string, start long, from_out boolean, from_in boolean, first_out long, first_in long, last_out long, last_in long"
_ENDS_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_()), *((c, pa.int64()) for c in ("first_out", "first_in", "last_out", "last_in"))])
#: Texts are passed on as bytes, so that some that are no characters in the charset do no harm.
_PIECE = pa.schema([("key", pa.int64()), ("seq", pa.int32()), ("value", pa.binary())])


def states(out: np.ndarray, in_: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line begins inside quotes, and whether what follows the last one does.

    A line sets the state (its flags are equal), leaves it, or turns it over; so the state is what
    was set last, turned over as often as lines did since.
    """
    n = len(out)
    sets = np.maximum.accumulate(np.where(out == in_, np.arange(n), -1)) if n else np.empty(0, np.int64)
    turns = np.cumsum(out & ~in_)
    base = np.where(sets >= 0, out[sets], inside) if n else np.empty(0, bool)
    after = base ^ ((turns - np.where(sets >= 0, turns[sets], 0)) & 1).astype(bool) if n else base
    return np.append(inside, after)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """A batch by the splits of files that its lines are from."""
    if not len(batch):
        return
    path, start = batch.column("path").dictionary_encode(), batch.column("start").to_numpy()
    file = path.indices.to_numpy()
    cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), len(batch)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (path.dictionary[int(file[a])].as_py(), int(start[a])), batch.slice(a, b - a)


def _flags(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("out", "in")]


def _ends(skip: dict[tuple[str, int], int]):
    """Of each split: whether it ends inside quotes, and where its first and its last record begin (-1: none does), if it begins outside and if inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, first, last, left = None, [False, True], [-1, -1], [-1, -1], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*part, *now, *first, *last), _ENDS_ARROW, strict=True)], schema=_ENDS_ARROW)

        for batch in batches:
            for key, lines in _runs(batch):
                if key != part:
                    if part:
                        yield row()
                    part, now, first, last, left = key, [False, True], [-1, -1], [-1, -1], skip.get(key, 0)
                passed = min(left, len(lines))
                left, lines = left - passed, lines.slice(passed)
                at, (out, in_) = lines.column("at").to_numpy(), _flags(lines)
                for k in (0, 1):
                    state = states(out, in_, now[k])
                    begun = np.flatnonzero(~state[:-1])
                    if len(begun):
                        first[k] = first[k] if first[k] >= 0 else int(at[begun[0]])
                        last[k] = int(at[begun[-1]])
                    now[k] = bool(state[-1])
        if part:
            yield row()

    return run


def _joiner(held: Broadcast[dict[tuple[str, int], Begin]]):
    """The records of each split, by the begins of all; a piece of one that begins before or ends after it has a key, and a null value is the piece of a header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the split at hand: its begin, the lines of the record at hand, where that began (here) or its key (before).
        part, at, begins = None, None, held.value
        inside, header, left, own, begun, key = False, False, 0, [], -1, None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)

        def close(goes_on: bool) -> list[tuple]:
            """The record at hand, at its end or at that of the split."""
            if not own:
                return []
            if key is not None:
                return [(key, at.seq, b"\n".join(own))]
            if goes_on:
                return [(begun, at.seq, None if header else b"\n".join(own))]
            return [] if header else [(None, at.seq, b"\n".join(own))]

        for batch in batches:
            for name, lines in _runs(batch):
                if name != part:
                    yield rows(close(inside))
                    part, at = name, begins[name]
                    inside, header, left, own, key = at.inside, at.header, at.skip, [], at.key if at.inside else None
                passed = min(left, len(lines))
                left, lines = left - passed, lines.slice(passed)
                state = states(*_flags(lines), inside)
                inside = bool(state[-1])
                first = np.flatnonzero(~state[:-1]).tolist()
                if not own and not header and not inside and len(first) == len(lines):  # a record a line
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.full(n, at.seq), pa.int32()), lines.column("value").cast(pa.binary())], schema=_PIECE)
                    continue
                numbers, values, found = lines.column("at").to_numpy(), lines.column("value").cast(pa.binary()).to_pylist(), []
                cuts = [*first, len(values)]
                own += values[: cuts[0]]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if own:
                        found += close(False)
                        header = header and key is not None
                    own, key, begun = values[a:b], None, int(numbers[a])
                if own and not inside:
                    found += close(False)
                    header = header and key is not None
                    own, key = [], None
                yield rows(found)
        yield rows(close(inside))

    return run


def _strict(line, separator: str, quote: str):
    """The line with fields that are not in quotes emptied."""
    q, s = (("\\" + c) for c in (quote, separator))
    field = rf"(?:{q}(?:[^{q}\\]|\\.|{q}{q})*{q})"
    return F.array_join(F.transform(F.regexp_extract_all(line, F.lit(rf"(?:^|{s})({field}|[^{s}]*)"), F.lit(1)), lambda x: F.when(x.startswith(quote), x).otherwise("")), separator)


def write_text(fds: DataFrame, folder: str, order: list[str]) -> None:
    """One text file a right-hand side, ``folder``/<rhs>.txt, with lines ``[a, b] --> c``.

    ``order``: the attributes in the order in which a left-hand side names them. In a file's
    name, what is no letter, digit, dot, dash or underscore is %-encoded.
    """
    spark = fds.sparkSession
    number = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])[F.col("rhs")]
    lines = fds.select(number.alias("number"), F.concat(render_line(order), F.lit("\r")).alias("value"))
    made = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    lines.repartition("number").write.partitionBy("number").text(made)  # a right-hand side is in one task
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    to = hadoop.Path(folder)
    files, source = to.getFileSystem(conf), hadoop.Path(made).getFileSystem(conf)
    files.mkdirs(to)
    for found in source.globStatus(hadoop.Path(f"{made}/number=*/part-*")) or []:
        name = order[int(found.getPath().getParent().getName().partition("=")[2])]
        hadoop.FileUtil.copy(source, found.getPath(), files, hadoop.Path(to, f"{quote(name, safe='')}.txt"), False, True, conf)
    source.delete(hadoop.Path(made), True)


def render_line(order: list[str]):
    """``[a, b] --> c`` from columns lhs (an array of names) and rhs, names in the given order."""
    at = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    names = F.transform(F.array_sort(F.transform("lhs", lambda n: F.struct(at[n].alias("i"), n.alias("n")))), lambda x: x["n"])
    return F.concat(F.lit("["), F.array_join(names, ", "), F.lit("] --> "), F.col("rhs"))


def render_values(columns: list[str]):
    """The projected values of a record as text, ``[x, y]``."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), F.lit("]"))


def debug_dump(table: DataFrame, folder: str) -> None:
    """Partitions or coded records as text, one JSON object a line."""
    table.select(F.to_json(F.struct(*table.columns)).alias("value")).write.mode("overwrite").text(folder)
