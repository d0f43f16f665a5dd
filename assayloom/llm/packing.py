"""Vector bin packing of pieces into sequences under three limits at once: tokens, segments and loss-bearing tokens.

The dot-product heuristic fills one sequence at a time: of the pieces that still fit in every dimension it takes the one
whose demand has the largest dot product with what is left of the limits (both as shares of the limits), until none fits.

Pieces are dealt into blocks by the hash of a running number, about ``BLOCK`` pieces each, whatever their keys, and every
block is packed on its own, so memory is bounded and sequences never cross tasks. Pieces of equal demand are interchangeable, so a block's work is
the number of its pieces times the number of its distinct demands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayloom.llm.tokens import encoder
from assayloom.llm.worker import map_arrow, parts, record, release
from assayloom.session import materialize

SEQUENCE = 2048
#: Pieces per block, about.
BLOCK = 8192
END = 1
#: Pieces of text that a worker remembers the ids of.
REMEMBERED = 1_000_000


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """Sequence number of each piece. limits: tokens, segments, loss-bearing tokens. Raises if a piece can't fit alone."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    if tokens.max() > limits[0] or loss.max() > limits[2] or limits[1] < 1:
        raise ValueError("a piece exceeds the limits of a sequence")
    kinds, kind = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    left = np.bincount(kind, minlength=len(kinds))
    taken = np.concatenate([[0], np.cumsum(left)])[:-1]  # next piece of each kind in order
    limit = np.array(limits, float)
    demand = np.stack([kinds[:, 0] / limit[0], np.full(len(kinds), 1 / limit[1]), kinds[:, 1] / limit[2]], axis=1)
    out = np.empty(len(tokens), np.int64)
    sequence = 0
    alive = np.arange(len(kinds))  # kinds that have pieces left
    size, heavy, need = kinds[:, 0], kinds[:, 1], demand
    while len(alive):
        room, segments, weight = limits[0], limits[1], limits[2]
        emptied = False
        while segments:
            fits = (size <= room) & (heavy <= weight) & (left[alive] > 0 if emptied else True)
            if not fits.any():
                break
            rest = np.array([room / limit[0], segments / limit[1], weight / limit[2]])
            at = int(np.where(fits, need @ rest, -1.0).argmax())
            k = alive[at]
            out[order[taken[k]]] = sequence
            taken[k] += 1
            left[k] -= 1
            emptied |= left[k] == 0
            room, segments, weight = room - kinds[k, 0], segments - 1, weight - kinds[k, 1]
        if emptied:
            alive = alive[left[alive] > 0]
            size, heavy, need = kinds[alive, 0], kinds[alive, 1], demand[alive]
        sequence += 1
    return out


def pack_pieces(pieces: DataFrame, limits: tuple[int, int, int] = (SEQUENCE, 256, SEQUENCE), length: str = "length", loss: str | None = None) -> DataFrame:
    """Add sequence_id and offset (tokens before it there) to every piece.

    Pieces that fill a sequence alone get one of their own without being dealt out. ``loss`` names the column of
    loss-bearing tokens (all tokens without one). Repeated and null keys are fine, as rows are told apart by a running
    number. A piece beyond the limits raises; a null length or loss counts as 0. ``pieces`` is written once, with that
    number. Columns named ``sequence_id`` or ``offset`` are replaced; all others stay. An empty table gives none.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    row, block, heavy = (f"_{name}_{'x' * max(map(len, columns))}" for name in ("row", "block", "loss"))  # no column has these names
    size = F.coalesce(F.col(length), F.lit(0))
    weight = F.coalesce(F.col(loss), F.lit(0)) if loss else size
    pieces = materialize(pieces.select("*", F.monotonically_increasing_id().alias(row), weight.cast("long").alias(heavy)), "pieces")
    blocks = max(1, -(-pieces.where(size < limits[0]).count() // BLOCK))
    small = pieces.where(size < limits[0]).withColumn(block, F.pmod(F.xxhash64(row), F.lit(blocks)))
    schema = StructType([pieces.schema[c] for c in columns]).add("sequence_id", "long").add("offset", "long")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(length, "ascending"), (row, "ascending")])
        sizes = table.column(length).fill_null(0).to_numpy().astype(np.int64)
        number = pack(sizes, table.column(heavy).to_numpy(), limits)
        order = np.argsort(number, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.searchsorted(number[order], number[order])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - before[first]
        out = table.select(columns).append_column("sequence_id", pa.array((table.column(block)[0].as_py() << 24) + number))
        return out.append_column("offset", pa.array(offset))

    packed = small.groupBy(block).applyInArrow(run, schema)
    # Sequences of one piece: numbers below zero, one for each row.
    full = pieces.where(size >= limits[0])
    too_large = (F.col(length) > limits[0]) | (F.col(heavy) > limits[2])
    number = F.when(too_large, F.raise_error(F.lit("a piece exceeds the limits of a sequence")).cast("long")).otherwise(-1 - F.col(row))
    full = full.select(*columns, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def cut_documents(docs: DataFrame, tokenizer: str, style: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """Encode every whole text (null: empty), append id 1 and cut it into pieces of ``size`` ids and a rest.

    Returns per piece: doc_id, start, length, ids_crc32 (unsigned, little-endian unsigned 32-bit ids), doc_tokens. A
    text gives one piece at least. An empty table gives none; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, style, remembered)
        for part in parts(batches, 1024):
            out = []
            for doc, ids in zip(part.column(0).to_pylist(), encode.encode(part.column(1).to_pylist()), strict=True):
                data = np.append(ids, np.uint32(END)).astype("<u4").tobytes()
                n = len(data) // 4
                for start in range(0, n, size):
                    piece = data[4 * start : 4 * (start + size)]
                    out.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
            docs_, starts, lengths, crcs, sizes = (list(x) for x in zip(*out, strict=True))
            yield record(doc_id=(docs_, "int64"), start=(starts, "int64"), length=(lengths, "int64"), ids_crc32=(crcs, "int64"), doc_tokens=(sizes, "int64"))
        if not keep:
            release()

    return map_arrow(rows, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, style: str, limits: tuple[int, int, int] = (SEQUENCE, 256, SEQUENCE - 1), id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """Cut whole documents and pack the pieces. A piece's first token follows nothing that it could be foretold from, so
    all but that one bear loss: a sequence of many short pieces bears less than one of few, and the three limits differ.

    Returns the columns of ``cut_documents``, n_loss, sequence_id and offset. Null and empty texts give one piece, the
    end id; repeated rows are packed each. Texts are encoded once; a worker
    remembers about ``remembered`` pieces of text, from task to task if ``keep``.
    """
    pieces = cut_documents(docs, tokenizer, style, limits[0], id_col, text_col, remembered, keep).withColumn("n_loss", F.col("length") - 1)
    return pack_pieces(pieces, limits, loss="n_loss")


def conversation_pieces(turns: DataFrame, tokenizer: str, style: str, size: int = SEQUENCE, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Instruction data: one piece per turn: conv_id, turn, start, length, loss (its tokens if the role bears loss, else 0).

    A turn longer than ``size`` gives several pieces (``start`` tells them apart). Null and empty texts give the end id; a
    null role bears no loss; repeated rows give their pieces each; an empty table gives none; other columns aren't read.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").isin(*loss_roles).alias("_heavy"), F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, style, REMEMBERED)
        for part in parts(batches, 1024):
            out = []
            for conv, turn, heavy, ids in zip(*(part.column(i).to_pylist() for i in range(3)), encode.encode(part.column(3).to_pylist()), strict=True):
                n = len(ids) + 1
                for start in range(0, n, size):
                    length = min(size, n - start)
                    out.append((conv, turn, start, length, length if heavy else 0))
            columns = zip(("conv_id", "turn", "start", "length", "loss"), zip(*out, strict=True), strict=True)
            yield record(**{name: (list(x), "int64") for name, x in columns})

    return map_arrow(rows, run, "conv_id long, turn long, start long, length long, loss long")
