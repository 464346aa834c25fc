"""Encoding of a corpus with a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEFAULT_NAME = "byte_bpe_50k"

#: Characters after a boundary that can still change the match before it (the longest contraction).
LOOKAHEAD = 4

#: Chunks of a text that a task holds at a time while it cuts the text.
CHUNKS_A_BATCH = 256


def vocabulary_path(name: str = DEFAULT_NAME, folder: str | None = None) -> str:
    """The vocabulary file, from the given folder or that of the installed package of public tokenizers."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec else "/opt/tokenizers"
    return str(Path(folder, f"{name}.tiktoken"))


class Vocabulary(NamedTuple):
    """What the Python workers need: the name of a shipped file of ranks and the pattern that splits texts."""

    file: str
    pattern: str


def ship_vocabulary(spark: SparkSession, path: str | None = None) -> Vocabulary:
    """Send the vocabulary file to all executors, once per session, so that it need not lie in the same place there."""
    import public_tokenizers

    path = path or vocabulary_path()
    shipped = spark.sparkContext.__dict__.setdefault("_rasterweave_vocabularies", {})
    if path not in shipped:
        spark.sparkContext.addFile(path)
        shipped[path] = Vocabulary(Path(path).name, public_tokenizers.PATTERN)
    return shipped[path]


@lru_cache(maxsize=4)
def encoding_of(path: str, split: str):
    """A byte-level encoding from a file of ranks, and its split pattern for finding boundaries."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Python's own idea of white space differs in a few control characters from the property that the encoder uses.
    pattern = split.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return tiktoken.Encoding(Path(path).stem, pat_str=split, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)


def _worker(v: Vocabulary):
    """The encoding in a Python worker; read once per worker."""
    return encoding_of(SparkFiles.get(v.file), v.pattern)


def boundaries(pattern: regex.Pattern, text: str, start: int) -> list[int]:
    """Ends of the pre-tokens of a chunk that end without white space, counted from the beginning of its document.

    White space before a cut is split by what follows it, so a piece that ended there would be encoded otherwise alone.
    """
    return [start + m.end() for m in pattern.finditer(text) if not text[m.end() - 1].isspace()]


def _chunk_batches(chunk: int, overlap: int):
    """Texts to overlapping chunks, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for row, text in enumerate(batch.column("_text").to_pylist()):
                starts = range(0, len(text), chunk)
                for at in range(0, len(starts), CHUNKS_A_BATCH):
                    some = starts[at : at + CHUNKS_A_BATCH]
                    ids = batch.column(0).take(pa.array([row] * len(some), pa.int32()))
                    pieces = [text[k : k + chunk + overlap] for k in some]
                    stops = [k + chunk + overlap >= len(text) for k in some]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(some, pa.int32()), pa.array(stops), pa.array(pieces, pa.string())], names=[names[0], "_start", "_stop", "_text"])

    return run


def parse_chunk(encoding, pattern: regex.Pattern, text: str, start: int, stop: bool, chunk: int, overlap: int) -> tuple[list[int], list[int], list[int]]:
    """ids of a chunk, and the boundaries near its two ends with the number of ids before each.

    The text between two neighbouring boundaries encodes alone as within the chunk, so ids are appended from one to the
    next. stop: the text ends with this chunk; else the last characters could be split otherwise and hold no boundary.
    """
    sure = start + len(text) - (0 if stop else LOOKAHEAD)
    ends = [e for e in boundaries(pattern, text, start) if e <= sure and (e <= start + overlap or e >= start + chunk)]
    ids: list[int] = []
    before: list[int] = []
    last = start
    for end in ends:
        ids += encoding.encode_ordinary(text[last - start : end - start])
        before.append(len(ids))
        last = end
    ids += encoding.encode_ordinary(text[last - start :])
    return ids, ends, before


def join_chunks(encoding, chunks: list[tuple[int, list[int], list[int], list[int]]], chunk: int, overlap: int) -> list[int]:
    """ids of a text from (start, ids, boundaries, ids before each) of its chunks in order.

    Neighbours are stitched at the first boundary that both have. Where there is none, the text of both is restored from
    the ids (raw bytes) and encoded together.
    """
    out: list[int] = []
    open_text = ""
    entry: tuple[int, int] | None = (0, 0)  # where this chunk takes over: position and ids before it
    for k, (start, ids, ends, before) in enumerate(chunks):
        leave = follow = None
        if k + 1 < len(chunks):
            nxt = chunks[k + 1]
            theirs = {e: n for e, n in zip(nxt[2], nxt[3], strict=True) if e <= nxt[0] + overlap}
            leave, follow = next((((e, n), (e, theirs[e])) for e, n in zip(ends, before, strict=True) if e >= nxt[0] and e in theirs), (None, None))
        elif k + 1 == len(chunks):
            leave = (-1, len(ids))
        if entry and leave:
            out += ids[entry[1] : leave[1]]
        else:
            text = encoding.decode_bytes(ids).decode("utf-8")
            begin = (entry[0] if entry else start) - start
            open_text += text[begin : chunk if leave is None else len(text) if leave[0] < 0 else leave[0] - start]
            if leave:
                out += encoding.encode_ordinary(open_text)
                open_text = ""
        entry = follow
    return out


def _parse_batches(v: Vocabulary, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, pattern = _worker(v)
        kind = pa.list_(pa.int32())
        for batch in batches:
            found = [parse_chunk(encoding, pattern, t, s, e, chunk, overlap) for t, s, e in zip(batch.column("_text").to_pylist(), batch.column("_start").to_pylist(), batch.column("_stop").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("_start"), *[pa.array([f[k] for f in found], kind) for k in range(3)]], names=[batch.schema.names[0], "_start", "_ids", "_ends", "_before"])

    return run


def _join_batches(v: Vocabulary, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _worker(v)[0]
        for batch in batches:
            for row in range(len(batch)):
                parts = sorted((c["_start"], c["_ids"], c["_ends"], c["_before"]) for c in batch.column("_chunks")[row].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([join_chunks(encoding, parts, chunk, overlap)], pa.list_(pa.int32()))], names=[batch.schema.names[0], "ids"])

    return run


def _encode_arrow(v: Vocabulary):
    """Arrow in, Arrow out: ids go to Spark as one flat buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _worker(v)[0]
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column("_text").to_pylist():
                flat += encoding.encode_ordinary(text) if text else []
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[batch.schema.names[0], "ids"])

    return run


def encode_corpus(docs: DataFrame, id_col: str, text: str, *, path: str | None = None, chunk: int = 8192, overlap: int = 512) -> DataFrame:
    """id and ids (array<int>) of every row, without special tokens; an empty list for empty and for null text.

    Texts of up to `chunk` characters are encoded where they are read. A longer one becomes overlapping chunks that are
    dealt over the tasks, split into pre-tokens and encoded there. Two neighbouring chunks are stitched at the first
    pre-token boundary after a visible character that both have in their overlap: the pattern reads forward only, so
    from a common boundary on both agree, and the ids of one go on where those of the other end; the result equals
    encoding the whole text. Only ids come back together, never the text. Chunks that have no common boundary (a
    pre-token longer than the overlap) are decoded and encoded together. Rows that repeat an id are rows of their own
    when short; ids of longer texts must be single. Extra columns are not read. A long text with a null id is encoded with
    the other long ones of null id, so give every row an id.
    """
    v = ship_vocabulary(docs.sparkSession, path)
    key = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}"
    rows = docs.select(id_col, F.col(text).alias("_text"))
    is_long = F.coalesce(F.length("_text") > chunk, F.lit(False))
    short = rows.filter(~is_long).mapInArrow(_encode_arrow(v), f"{key}, ids array<int>")
    chunks = rows.filter(is_long).mapInArrow(_chunk_batches(chunk, overlap), f"{key}, _start int, _stop boolean, _text string").repartition(id_col, "_start")
    parsed = chunks.mapInArrow(_parse_batches(v, chunk, overlap), f"{key}, _start int, _ids array<int>, _ends array<int>, _before array<int>")
    gathered = parsed.groupBy(id_col).agg(F.collect_list(F.struct("_start", "_ids", "_ends", "_before")).alias("_chunks"))  # the chunks of one text
    return short.unionByName(gathered.mapInArrow(_join_batches(v, chunk, overlap), f"{key}, ids array<int>"))


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: the raw bytes of all ids joined, then read as UTF-8; null for null."""
    v = ship_vocabulary(SparkSession.active(), path)

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _worker(v)[0]
        for batch in batches:
            yield pd.Series([None if x is None else encoding.decode_bytes(list(x)).decode("utf-8", errors="replace") for x in batch], dtype=object)

    return run(ids)


def _measure_arrow(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _worker(v)[0]
        for batch in batches:
            sizes = [None if t is None else len(encoding.encode_ordinary(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=[batch.schema.names[0], "size"])

    return run


def token_sizes(docs: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """id and size, the number of tokens of each text; null for null. Each text is encoded once, whatever is done with the size."""
    v = ship_vocabulary(docs.sparkSession, path)
    rows = docs.select(id_col, F.col(text).alias("_text"))
    return rows.mapInArrow(_measure_arrow(v), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, size int")
