"""Packing by best-fit decreasing (operator 5)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, written
from .tokens import chunks, default_path, tokenizer

WINDOW, END = 4096, 2
#: Pieces that one task packs: its open windows waste at most one window or so per group.
GROUP = 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window number, offset) of each length, taken in the order given (longest first for best-fit decreasing).

    A segment tree over remaining capacities 0..window counts the open windows of each capacity; the
    tightest window that holds a piece is the least capacity >= its length with a count above zero,
    found by one way up and one way down the tree.
    """
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    stacks: dict[int, list[int]] = {}
    numbers, offsets, opened = [], [], 0
    for n in lengths:
        i = n + size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i > 1:
                i += 1
                while i < size:
                    i *= 2
                    if not tree[i]:
                        i += 1
        if i > 1:
            room = i - size
            w = stacks[room].pop()
            j = i
            while j:
                tree[j] -= 1
                j >>= 1
        else:
            room, w = window, opened
            opened += 1
        numbers.append(w)
        offsets.append(window - room)
        room -= n
        if room:
            stacks.setdefault(room, []).append(w)
            j = room + size
            while j:
                tree[j] += 1
                j >>= 1
    return numbers, offsets


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Each document's ids (with the end id) cut into full windows and one shorter rest: PIECES.

    A narrow map: whole texts are encoded where they are read, and only lengths and checksums move on.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for pdf in batches:
            ids_of, texts = pdf["doc_id"].tolist(), [x or "" for x in pdf["text"]]
            for a, b in chunks(texts):
                ids, counts, first = t.batch(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(counts)])[first]
                rows = []
                for k in range(b - a):
                    own = np.append(ids[ends[k] : ends[k + 1]], END).astype("<u4")
                    for s in range(0, len(own), window):
                        part = own[s : s + window]
                        rows.append((ids_of[a + k], s, len(part), zlib.crc32(part.tobytes()), len(own)))
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
        t.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


def packed(parts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """parts(PIECES) with sequence_id and offset.

    Pieces are dealt by hash into groups of about `group`, as many groups as the count asks for, so
    no document, source or length gathers in one task. A full window is a sequence of its own.
    Sequence numbers are unique over all groups.
    """
    parts = written(parts, "pieces")
    groups = max(1, -(-parts.count() // group))
    dealt = parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        numbers, offsets = best_fit(pdf["length"].tolist(), window)
        return pdf.assign(sequence_id=np.asarray(numbers, np.int64) + (int(key[0]) << 32), offset=np.asarray(offsets, np.int64)).drop(columns="g")

    return dealt.groupBy("g").applyInPandas(run, PACKED)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All documents as pieces in sequences of at most 4096 ids.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come; a null
    doc_id stays null. Any further columns of docs are ignored.
    """
    return packed(pieces(docs, path))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
