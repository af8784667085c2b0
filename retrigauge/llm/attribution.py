"""Token counts of fields and sections by offset-mapped attribution (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_or_empty
from .tokens import chunks, default_path, tokenizer

#: White space that separates words, and nothing else does.
BLANKS = ("\t", "\n", "\x0b", "\x0c", "\r", " ")
_BLANK = np.zeros(33, bool)
_BLANK[[ord(x) for x in BLANKS]] = True


def word_starts(text: str) -> np.ndarray:
    """Code-point offsets at which the words of the text begin."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _BLANK[np.minimum(c, 32)] & (c <= 32)
    begins = ~blank
    begins[1:] &= blank[:-1]
    return np.flatnonzero(begins)


def allotted(starts: np.ndarray, ends: np.ndarray, sec_start: np.ndarray, sec_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span (-1: none) and whether it crosses a border, by an interval join of sorted sides.

    Sections are disjoint and ascending; empty ones get nothing. The rule: a token belongs to the
    section that holds most of its characters, of equals to the earliest.
    """
    live = np.flatnonzero(sec_end > sec_start)
    if not len(live) or not len(starts):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    s, e = sec_start[live], sec_end[live]
    ends = np.maximum(ends, starts + 1)
    low = np.searchsorted(e, starts, "right")
    high = np.searchsorted(s, ends, "left") - 1
    out = np.where(low <= high, live[np.minimum(low, len(live) - 1)], -1)
    crossing = (low <= high) & ((high > low) | (starts < s[np.minimum(low, len(live) - 1)]) | (ends > e[np.maximum(high, 0)]))
    for t in np.flatnonzero(high > low):
        k = np.arange(low[t], high[t] + 1)
        held = np.minimum(ends[t], e[k]) - np.maximum(starts[t], s[k])
        out[t] = live[k[held.argmax()]]
    return out, crossing


def quarters(text: Column) -> Column:
    """Sections head, body and tail: the first and the last quarter (rounded down) and what is between, in code points."""
    n = F.char_length(text)
    q = F.floor(n / 4).cast("int")
    part = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.array(part("head", F.lit(0), q), part("body", q, n - q), part("tail", n - q, n))


def attributed(docs: DataFrame, sections: Column, path: str | None = None) -> DataFrame:
    """A row per document and section: tokens allotted to it, how many of those cross a border, and all the document's tokens.

    Every whole text is encoded once, in a narrow map. A null text is empty and gives its sections
    with no token. Null section lists give no row; repeated rows give theirs again.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path, spans=True)
        for pdf in batches:
            docs, texts, secs = pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["sections"].tolist()
            for a, b in chunks(texts):
                places, counts, first = t.places(texts[a:b])
                total = np.concatenate([[0], np.cumsum(counts)])
                rows = []
                for k in range(b - a):
                    if secs[a + k] is None:
                        continue
                    own = counts[first[k] : first[k + 1]]
                    at = word_starts(texts[a + k])
                    # Blanks at either end make an empty word there; an empty text is one empty word.
                    lead = int(texts[a + k][:1] in BLANKS)
                    own = own[lead : lead + len(at)]
                    span = places[total[first[k]] : total[first[k + 1]]]
                    base = np.repeat(at, own)
                    names = [x["name"] for x in secs[a + k]]
                    s, e = (np.array([x[w] for x in secs[a + k]], np.int64) for w in ("start", "end"))
                    sec, crossing = allotted(base + t.span_start[span], base + t.span_end[span], s, e)
                    n = np.bincount(sec[sec >= 0], minlength=len(names))
                    c = np.bincount(sec[crossing & (sec >= 0)], minlength=len(names))
                    rows += [(docs[a + k], i, names[i], int(s[i]), int(e[i]), int(n[i]), int(c[i]), len(span)) for i in range(len(names))]
                out = pd.DataFrame(rows, columns=["doc_id", "section_no", "section", "start", "end", "tokens", "crossing", "doc_tokens"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), sections.alias("sections"))
    return given.mapInPandas(run, "doc_id long, section_no int, section string, start long, end long, tokens long, crossing long, doc_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(table(spark, sf_dir, "documents"), quarters(text_or_empty()))
