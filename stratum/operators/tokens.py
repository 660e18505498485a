"""Chunks of real tokens: blocks are counted by a tokenizer file and packed into parents, over byte offsets; texts come last.

Blocks are (source_id, block_no, byte_start, byte_end, text), in order within a
source, as ``structure.line_blocks`` or an extractor gives them. The tokenizer is a
file of the tokenizers library, loaded once in each worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.pieces import counter, load
from stratum.sources.batches import map_batches, sliced

PARENT, TOLERANCE = 512, 1
PIECES = pa.schema([("source_id", pa.int64()), ("block_no", pa.int64()), ("piece_no", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("n_tokens", pa.int64())])
PARENTS = pa.schema([("source_id", pa.int64()), ("parent_no", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("n_tokens", pa.int64()), ("token_start", pa.int64()), ("first_block", pa.int64())])


def _shape(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if pa.types.is_int32(f.type) else 'bigint'}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def pieces(text: str, offsets: list[tuple[int, int]], most: int) -> Iterator[tuple[int, int, int]]:
    """(first byte, last, tokens) of a text in pieces of up to ``most`` tokens, cut where a token starts; together they are the whole text."""
    byte = at = 0
    for i in range(0, max(1, len(offsets)), most):
        # a character of several tokens isn't cut: it goes with the first of them
        stop = len(text) if i + most >= len(offsets) else max(at, offsets[i + most][0])
        size = len(text[at:stop].encode())
        yield byte, byte + size, len(offsets[i : i + most])
        byte, at = byte + size, stop


def token_pieces(blocks: DataFrame, path: str, most: int = PARENT + TOLERANCE) -> DataFrame:
    """source_id, block_no, piece_no, byte_start, byte_end, n_tokens: blocks as pieces of up to ``most`` tokens, nearly all of one piece. Null texts have none."""

    def make():
        tokenizer = load(path)
        tokenizer.encode_special_tokens = True
        count = counter(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns)) if r[3] is not None]
            out = []
            for source, block, start, text in rows:
                # few blocks are cut, so few need to know where their tokens start
                size = count(text) if count else most + 1
                if size <= most:
                    out.append((source, block, 0, start, start + len(text.encode()), size))
                else:
                    found = tokenizer.encode(text, add_special_tokens=False)
                    out += [(source, block, n, start + a, start + b, size) for n, (a, b, size) in enumerate(pieces(text, found.offsets, most))]
            return _batch(out, PIECES)

        return run

    long = [F.col(c).cast("long").alias(c) for c in ("source_id", "block_no", "byte_start")]
    return map_batches(blocks.select(*long, "text"), make, _shape(PIECES))


def packed(found: DataFrame, most: int = PARENT + TOLERANCE) -> DataFrame:
    """source_id, parent_no, byte_start, byte_end, n_tokens, token_start, first_block of the parents that pieces are packed into, greedily and in order.

    A parent takes blocks while their tokens stay within ``most``; a block of several
    pieces closes the parent before it, and each of its pieces is a parent. Sources are dealt over tasks and
    read in order, so a task holds one parent at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, no, before, held, waiting = None, 0, 0, None, None
        out: list[tuple] = []

        def close() -> None:
            nonlocal no, before, held
            if held:
                out.append((source, no, held[0], held[1], held[2], before, held[3]))
                no, before, held = no + 1, before + held[2], None

        def take(row: tuple, split: bool) -> None:
            nonlocal source, no, before, held
            s, block, _, a, b, n = row
            if s != source:
                close()
                source, no, before = s, 0, 0
            if split or (held and held[2] + n > most):
                close()
            held = (held[0], b, held[2] + n, held[3]) if held else (a, b, n, block)
            if split:
                close()

        for batch in sliced(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting:  # whether a block goes on is known by the next row
                    take(waiting, waiting[2] > 0 or (row[0] == waiting[0] and row[1] == waiting[1]))
                waiting = row
            yield _batch(out, PARENTS)
            out = []
        if waiting:
            take(waiting, waiting[2] > 0)
        close()
        yield _batch(out, PARENTS)

    order = ["source_id", "block_no", "piece_no"]
    return found.select(*PIECES.names).repartition("source_id").sortWithinPartitions(*order).mapInArrow(run, _shape(PARENTS))


def packed_tokens(docs: DataFrame, blocks: DataFrame, path: str, size: int = PARENT, tolerance: int = TOLERANCE) -> DataFrame:
    """Parents of the blocks of docs (source_id, text) with their texts: the bytes of the source from the first block to the last, what stands between included."""
    parents = packed(token_pieces(blocks, path, size + tolerance), size + tolerance)
    data = F.col("text").cast("binary")
    cut = F.substring(data, (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int")).cast("string")
    return parents.join(docs.select("source_id", "text"), "source_id").select(*PARENTS.names, cut.alias("text"))
