"""Best-fit packing of documents into fixed-size training sequences by the sum-of-squares rule.

Let N(g) be the number of open sequences with g free places. A piece goes where the sum of N(g)² over
all g becomes smallest: into a sequence with gap g it changes the sum by 1 - 2 N(g) for the gap left and
by 1 + 2 N(g - s) for the gap made; full and empty sequences don't count. Pieces are taken longest
first. Only lengths matter for that, so a group of up to ``GROUP_PIECES`` pieces is packed from its
lengths alone in one task; groups are made by hash and are all of about that size, so memory is bounded
and a larger corpus only has more groups, each of which leaves at most a few sequences open.

Defined results: a null or empty text is one piece (its end id only); repeated rows are packed as often as
they come; null ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_and_text, table, utf8
from .word_tokens import word_tokens

GROUP_PIECES = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: With a number of each row within its task: it decides about the group, once it is written down.
CUT = PIECES + ", row long"


def cut(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids, as rows of ``CUT`` (and ``ids array<int>``)."""

    def task(batches):
        from pyspark import TaskContext

        give_back()
        tokens, end, width = word_tokens(path), struct.pack("<I", end_id), 4 * capacity
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            cols = [[], [], [], [], [], []]
            ids = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found = tokens.ids(text) + end
                for piece, at in enumerate(range(0, len(found), width)):
                    part = found[at : at + width]
                    for c, v in zip(cols, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), row)):
                        c.append(v)
                    row += 1
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(task, CUT + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` are taken in the order given.

    Ties go to the smallest gap that fits. A fresh sequence is opened only if nothing fits: as the pieces are
    all known and come longest first, opening one earlier to even out the counts only costs sequences.
    """
    n = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = defaultdict(list)
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        if not 0 < s <= capacity:
            raise ValueError(f"a piece of {s} ids can't go into a sequence of {capacity}")
        # the change of the sum: 1 - 2 N(g) for the gap taken, 1 + 2 N(g - s) for the gap made
        open_gaps = n[s:capacity]
        made_gaps = n[: capacity - s].copy()
        change = 2 * (made_gaps - open_gaps) + 2
        if len(change):
            change[0] = 1 - 2 * open_gaps[0]  # a full sequence doesn't count
            change[open_gaps == 0] = 1 << 40
        best = int(np.argmin(change)) if len(change) else -1
        if best >= 0 and change[best] < 1 << 40:
            gap = best + s
            where = stacks[gap].pop()
            n[gap] -= 1
        else:
            gap, where = capacity, made
            made += 1
        sequence[i], offset[i] = where, capacity - gap
        left = gap - s
        if left:
            stacks[left].append(where)
            n[left] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have ``CUT``. ``pieces`` is read twice: give a table."""
    spark = pieces.sparkSession
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def task(key, group):
        length = group.column("length").to_numpy()
        doc = group.column("doc_id").to_numpy(zero_copy_only=False)
        order = np.lexsort((group.column("start").to_numpy(), np.nan_to_num(doc.astype(float)), -length))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        sequence[order], offset[order] = sum_of_squares(length[order], capacity)
        sequence += key[0].as_py() << 32
        return group.drop(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # groups of nearly the same size whatever the rows are, equal ones included
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")
    keyed = pieces.select(*PIECES_COLUMNS, group)
    return keyed.groupBy("group").applyInArrow(task, PIECES + ", sequence_id long, offset long")


PIECES_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece."""
    return pack(table(cut(id_and_text(docs), path, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """The packed training sequences themselves: sequence_id, ids (padded to ``capacity``), doc_ids, offsets."""
    pieces = table(cut(id_and_text(docs), path, capacity, end_id, with_ids=True), "pieces")
    placed = pack(pieces, capacity).select("sequence_id", "offset", "doc_id", "piece", "ids_crc32", "length").distinct()
    same = [placed[c].eqNullSafe(pieces[c]) for c in ("doc_id", "piece", "ids_crc32", "length")]
    rows = placed.join(pieces, same).select("sequence_id", F.struct("offset", placed["doc_id"], "ids").alias("p"))
    one = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_set("p")).alias("ps"))  # at most ``capacity`` pieces
    ids = F.flatten(F.transform("ps", lambda p: p["ids"]))
    return one.select(
        "sequence_id",
        F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), capacity)), 1, capacity).alias("ids"),
        F.transform("ps", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("ps", lambda p: p["offset"]).alias("offsets"),
    )
