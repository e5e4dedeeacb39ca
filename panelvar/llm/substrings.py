"""Substring dedup: words in windows that occur anywhere else are removed.

Every window of a fixed number of words has a Rabin-Karp hash, rolled from hashes of its words; the
hashes are counted in Spark and repeated windows merge into maximal intervals. Rows are dealt into
blocks once. A block sends each hash that it holds once, packed as sorted 8- or 16-byte numbers by
hash range, with a mark if it holds it twice; a task per range counts, and sends each block back its
repeated hashes. So a passage in a third of all documents costs one number per block.

Two counts keep the exchange small. First shorter windows are counted, of which only the smallest
hash of every long window is sent (about one in ten): a long window that occurs twice has the same
smallest short window in both places, so where that is unique nothing can repeat. The long windows
left are then counted with 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelvar.llm.shared import input_bytes, parallelism

WINDOW = 35
#: Words of the short windows, of which the smallest in each window is counted first.
SHORT = 16
#: Text bytes of a block, and odd multipliers of the rolled hashes.
BLOCK_BYTES = 8 << 20
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4F)


def word_hashes(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the edges between texts."""
    parts, edges = [np.empty(0, np.uint64)], [0]
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        found = [digest(w, seed) for w in text.split()]
        parts.append(np.array(found, np.uint64))
        edges.append(edges[-1] + len(found))
    return np.concatenate(parts), np.asarray(edges)


def rolled(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash of the window that starts at each word, modulo 2^64, then mixed."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    power = np.cumprod(np.full(len(words), base, np.uint64)) if len(words) else words
    back = np.cumprod(np.full(n, inverse, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
    h = (sums[width:] - sums[:-width]) * back
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _inside(edges: np.ndarray, width: int, total: int) -> np.ndarray:
    """Whether the window at each start lies in one text."""
    n = max(total - width + 1, 0)
    mark = np.ones(n + 1, np.int64)
    out = np.zeros(n + 1, np.int64)
    for edge in np.unique(edges[1:-1]):  # windows that would cross this edge
        a, b = max(edge - width + 1, 0), min(edge, n)
        if b > a:
            out[a] += 1
            out[b] -= 1
    mark = np.cumsum(out)[:n] == 0
    return mark


def _anchors(words: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all short windows, and for each window the place of the smallest, leftmost, in it."""
    h = rolled(words, short, BASES[0])
    if len(words) < window:  # no window, so no place
        return h, np.empty(0, np.int64)
    span, width = window - short + 1, 1
    at = np.arange(len(h))
    while width < span:  # the minimum over a span doubles until it is that of a window
        step = min(width, span - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        width += step
    return h, at


def _send(block: int, keys: np.ndarray, ranges: int) -> pd.DataFrame:
    """Rows (range, block, once, twice): this block's distinct keys by hash range.

    ``keys`` has one or two 64-bit columns; the first decides the range.
    """
    kind = [("a", "<u8")] if keys.ndim == 1 else [("a", "<u8"), ("b", "<u8")]
    flat = np.ascontiguousarray(keys).view(kind).ravel()
    found, counts = np.unique(flat, return_counts=True)
    at = (found["a"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    cuts = np.searchsorted(at, np.arange(ranges + 1))
    rows = [
        (r, block, found[a:b][counts[a:b] == 1].tobytes(), found[a:b][counts[a:b] > 1].tobytes())
        for r, (a, b) in enumerate(zip(cuts, cuts[1:]))
        if b > a
    ]
    return pd.DataFrame(rows, columns=["range", "block", "once", "twice"])


_SENT = "range int, block int, once binary, twice binary"
_BACK = "block int, found binary"


def _count(sent: DataFrame, wide: bool) -> DataFrame:
    """Per block the first halves of its keys that occur twice anywhere."""
    kind = [("a", "<u8"), ("b", "<u8")] if wide else [("a", "<u8")]

    def repeated(rows: pd.DataFrame) -> pd.DataFrame:
        once = [np.frombuffer(x, kind) for x in rows["once"]]
        twice = [np.frombuffer(x, kind) for x in rows["twice"]]
        every = np.concatenate(once + twice + twice)
        found, counts = np.unique(every, return_counts=True)
        found = found[counts > 1]
        out = []
        for block, a, b in zip(rows["block"], once, twice):
            mine = np.concatenate([a, b])
            at = np.searchsorted(found, mine)
            at[at == len(found)] = 0
            hit = mine["a"][found[at] == mine] if len(found) else mine["a"][:0]
            if len(hit):
                out.append((block, np.unique(hit).tobytes()))
        return pd.DataFrame(out, columns=["block", "found"])

    return sent.groupBy("range").applyInPandas(repeated, _BACK)


def _found(rows: pd.DataFrame) -> np.ndarray:
    parts = [np.frombuffer(x, "<u8") for x in rows["found"]]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _covered(starts: np.ndarray, total: int, window: int) -> np.ndarray:
    """Words in any of the windows at ``starts``: overlapping windows merge."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, total), -1)
    return np.cumsum(step)[:total] > 0


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, short: int = SHORT, keep_text: bool = True) -> DataFrame:
    """doc (all columns but the text), n_words, n_removed, kept_sha256, spans (word intervals removed)
    and, with ``keep_text``, kept (the words left, joined by single spaces).

    Null and empty texts have no words; texts shorter than a window lose nothing; repeated rows are
    repeats of each other, so all their words go; an empty table gives an empty one. Columns of
    ``docs`` stay inside ``doc``, so none can clash.
    """
    spark = docs.sparkSession
    slim = [f.name for f in docs.schema.fields if f.name != text]
    size = input_bytes(docs, text)
    blocks = parallelism(spark, size, BLOCK_BYTES)
    ranges = parallelism(spark, size, 8 * BLOCK_BYTES)
    whole = F.struct(*[F.col(f"`{c}`") for c in slim]) if slim else F.struct(F.lit(0).alias("row"))
    rows = docs.select(whole.alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # The block of a row depends on the row alone: later passes meet the same rows in the same block.
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.to_json("doc"), F.xxhash64("text")), F.lit(blocks)).cast("int"))
    dealt = rows.repartition(blocks, "block")
    doc_type = rows.schema["doc"].dataType.simpleString()

    def first(group: pd.DataFrame) -> pd.DataFrame:
        words, edges = word_hashes(list(group["text"]), 0)
        inside = _inside(edges, window, len(words))
        h, at = _anchors(words, window, short)
        return _send(int(group["block"].iloc[0]), h[np.unique(at[: len(inside)][inside])], ranges)

    def second(group: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(back):
            return pd.DataFrame(columns=["range", "block", "once", "twice"])
        words, edges = word_hashes(list(group["text"]), 0)
        inside = _inside(edges, window, len(words))
        h, at = _anchors(words, window, short)
        maybe = inside & _member(h[at[: len(inside)]], _found(back))
        other, _ = word_hashes(list(group["text"]), 1)
        keys = np.stack([rolled(words, window, BASES[1])[maybe], rolled(other, window, BASES[0])[maybe]], axis=1)
        return _send(int(group["block"].iloc[0]), keys, ranges)

    fields = f"doc {doc_type}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<array<bigint>>"
    names = ["doc", "n_words", "n_removed", "kept_sha256", "spans"] + ["kept"] * keep_text

    def last(group: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        out = []
        table = _found(back)
        texts = list(group["text"])
        if len(table):
            words, edges = word_hashes(texts, 0)
            inside = _inside(edges, window, len(words))
            starts = np.flatnonzero(inside & _member(rolled(words, window, BASES[1]), table))
            gone = _covered(starts, len(words), window)
        for k, (doc, text_) in enumerate(zip(group["doc"], texts)):
            found = text_.split()
            spans, left = [], found
            if len(table):
                mine = gone[edges[k] : edges[k + 1]]
                if mine.any():
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                    spans = turns.reshape(-1, 2).tolist()
                    left = [w for w, x in zip(found, mine.tolist()) if not x]
            kept = b" ".join(left)
            row = (doc, len(found), len(found) - len(left), hashlib.sha256(kept).hexdigest(), spans)
            out.append((*row, kept.decode()) if keep_text else row)
        return pd.DataFrame(out, columns=names)

    short_back = _count(dealt.groupBy("block").applyInPandas(first, _SENT), wide=False)
    long_sent = dealt.groupBy("block").cogroup(short_back.groupBy("block")).applyInPandas(second, _SENT)
    long_back = _count(long_sent, wide=True)
    done = dealt.groupBy("block").cogroup(long_back.groupBy("block"))
    return done.applyInPandas(last, fields + (", kept string" if keep_text else ""))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc.doc_id", "n_words", "n_removed", "kept_sha256")
