"""Best-fit packing of token sequences with a certificate.

Texts are tokenised where they are read; only (piece, length, checksum) goes on. Full pieces are
sequences by themselves. The others are dealt over partitions of about ``PART_PIECES`` by a hash;
each partition is packed by best-fit decreasing and gets a lower bound on its number of bins from
dual feasible functions. A partition whose bins reach the bound is certified and settled. Of the
others only completely full bins are settled; they exchange the pieces of their remaining bins:
these are dealt anew, over fewer partitions, and packed again, until the bins in question
no longer get fewer. Lengths are whole numbers up to the capacity, so a partition is packed from
counts by length; memory is bounded by the pieces of a partition.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import query, stored, table
from .op5_secrets import encoder, vocabulary

CAPACITY = 1024
END = 2
PART_PIECES = 50_000
ROUNDS = 6
PIECE = "piece int, start long, length long, ids_crc32 long"


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The tokens that a tokenizers file adds to its vocabulary: it finds them in any text, as they are."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as lines:
        return {t["content"]: t["id"] for t in json.load(lines)["added_tokens"]}


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str, added: tuple[tuple[str, int], ...]):
    """The tiktoken encoder of a rank file with added tokens; one for each worker process."""
    import tiktoken

    plain = encoder(path, pattern)
    return tiktoken.Encoding("with added", pat_str=pattern, mergeable_ranks=plain._mergeable_ranks, special_tokens=dict(added))


def pieces(docs: DataFrame, row: Column, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """row, piece, start, length, ids_crc32 of every piece of every row of ``docs``; only the text is read.

    Ids are those of the tokenizers file of the byte-level vocabulary, then ``END``; a marker
    that the file adds, such as <|endoftext|>, is one id wherever a text holds it. tiktoken gives
    the same ids, about four times as fast. A longer document is cut into pieces of ``capacity``,
    of which the first may be shorter.
    """
    files, added = files or vocabulary(), tuple(added_tokens().items())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(*files, added)
        for batch in batches:
            which, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = words.encode(text.as_py() or "", allowed_special="all")
                ids.append(END)
                data = np.array(ids, "<u4")
                n = len(data)
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    which.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, f"row {rows.schema['row'].dataType.simpleString()}, {PIECE}")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length by best-fit decreasing: the fullest bin that still has room."""
    order = np.argsort(-lengths, kind="stable")
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: dict[int, list[int]] = defaultdict(list)  # room -> bins with just that room
    rooms = np.zeros(capacity + 1, bool)
    bins = 0
    for i in order:
        n = int(lengths[i])
        room = n + int(rooms[n:].argmax()) if rooms[n:].any() else 0
        if room:
            found = open_[room].pop()
            if not open_[room]:
                rooms[room] = False
        else:
            found, room, bins = bins, capacity, bins + 1
        which[i], offset[i] = found, capacity - room
        if room - n:
            open_[room - n].append(found)
            rooms[room - n] = True
    return which, offset


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins that any packing needs, the best of a family of dual feasible functions.

    For a threshold t up to half the capacity, lengths over capacity - t count as a whole bin, those
    below t as nothing, others as they are (t = 0: the plain volume). For a whole number k, a length x
    counts floor((k + 1) x / capacity) / k, or x / capacity where that division is even.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    best = 0
    many, volume = np.cumsum(counts), np.cumsum(counts * size)
    for t in range(capacity // 2 + 1):
        whole = many[-1] - many[capacity - t]
        middle = volume[capacity - t] - (volume[t - 1] if t else 0)
        best = max(best, int(whole + -(-middle // capacity)))
    for k in range(1, 101):
        scaled = (k + 1) * size
        even = scaled % capacity == 0
        # In units of 1 / (k * capacity), to stay with whole numbers.
        value = np.where(even, size * k, scaled // capacity * capacity)
        best = max(best, int(-(-int((value * counts).sum()) // (k * capacity))))
    return best


def pack(items: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (key, length long) with sequence_id long and offset long; length is from 1 to ``capacity``.

    The hash of key deals the rows out, so it should differ between copies of a document.
    Sequences are numbered within (round, partition); numbers have gaps. Every row gets a place, repeated
    rows places of their own; no rows give no sequences. After ``rounds`` exchanges what is packed stays.
    """
    kind = items.schema["key"].dataType.simpleString()
    packed_schema = f"key {kind}, length long, part long, bin long, offset long, settled boolean"

    def pack_part(frame: pa.Table) -> pa.Table:
        lengths = frame.column("length").to_numpy()
        which, offset = best_fit(lengths, capacity)
        bins = int(which.max()) + 1
        full = np.bincount(which, lengths, bins) == capacity
        settled = np.ones(len(lengths), bool) if bins <= least_bins(lengths, capacity) else full[which]
        key = frame.column("key")
        if pa.types.is_struct(key.type):  # the declared schema has nullable fields only
            key = key.cast(pa.struct([f.with_nullable(True) for f in key.type]))
        return pa.table({
            "key": key, "length": lengths, "part": frame.column("part"), "bin": which, "offset": offset, "settled": settled})

    whole = items.where(F.col("length") == capacity).select(
        "key", "length", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("key", "length")
    done, n, bins = [whole], rest.count(), None
    for turn in range(rounds):
        parts = max(1, -(-n // part_pieces))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(parts)).cast("long"))
        packed = stored(dealt.groupBy("part").applyInArrow(pack_part, packed_schema), "packed")
        left = packed.where("not settled")
        state = left.agg(F.count("*").alias("n"), F.count_distinct("part", "bin").alias("bins"), F.sum("length").alias("sum")).first()
        number = F.lit(turn << 54) + F.col("part") * (1 << 24) + F.col("bin")
        last = state["n"] == 0 or turn == rounds - 1 or parts == 1 or (
            bins is not None and state["bins"] >= bins) or state["bins"] <= -(-state["sum"] // capacity)
        done.append((packed if last else packed.where("settled")).select("key", "length", number.alias("sequence_id"), "offset"))
        if last:
            break
        rest, n, bins = left.select("key", "length"), state["n"], state["bins"]
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def packed_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text).

    A null or empty text is one piece that holds only the end token. Null ids and repeated
    rows are packed like any others; more columns are ignored; an empty table gives no pieces.
    """
    cut = pieces(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id")), capacity)
    cut = stored(cut.select("row.doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    key = F.struct("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id().alias("nth"))
    placed = pack(cut.select(key.alias("key"), "length"), capacity)
    return placed.select(
        "key.doc_id", "key.piece", "key.start", "length", "key.ids_crc32", "sequence_id", "offset")


@query("op6_packing")
def op6_packing(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
