"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of shards. A shard holds some documents (about ``SHARD_WORDS`` words, never part
of one) and, for every distinct word of them, the sorted list of its places: all postings of the
training corpus, dealt by document, so that no word's list is ever gathered in one task and a frequent
word costs each shard its own share alone.

Test items come in blocks of a bounded number of words; a block is sent to the tasks, and every shard
searches its phrases at once. A phrase starts with the offset-adjusted lists of its two rarest words in
the shard, pairs of words that several phrases share being intersected once, and goes on with the next
rarest; what is left are exact places. Proximity asks for all words of a phrase within a stretch of
somewhat more words, in any order, and starts from the rarest word's list in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelvar.llm.shared import Scratch, input_bytes
from panelvar.llm.substrings import rolled, word_hashes

WINDOW = 10
#: Words of a shard, words of a block of items, places looked at in one step of a task.
SHARD_WORDS, BLOCK_WORDS, STEP = 1 << 21, 1 << 20, 1 << 21
SEED, BASE = 11, 0x9E3779B97F4A7C13
#: ASCII letters become lower case, other ASCII but digits becomes a space, the rest stays.
_TABLE = bytes(ord(chr(c).lower()) if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the edges between texts; null has none."""
    return word_hashes([(t or b"").translate(_TABLE) for t in texts], SEED)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` numbers from ``first`` on: the number of the range and the value of each entry."""
    which = np.repeat(np.arange(len(first)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, first[which] + inside


def _slices(count: np.ndarray) -> Iterator[slice]:
    """Consecutive ranges whose counts come to about STEP together (one may be more)."""
    total, at = np.cumsum(count), 0
    while at < len(count):
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")), at + 1)
        yield slice(at, end)
        at = end


@dataclass
class Shard:
    edges: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, edges: np.ndarray) -> Shard:
        order = np.argsort(words, kind="stable")
        ranked = words[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(words), 1), bool), ranked[1:] != ranked[:-1]]))
        counts = np.diff(np.concatenate([first, [len(words)]]))
        return cls(edges, ranked[first], counts.astype(np.uint32), order.astype(np.uint32))


class Block:
    """Test items: their words, the distinct phrases of each length and the items that hold them."""

    def __init__(self, items: list[str], words: np.ndarray, edges: np.ndarray, window: int):
        self.items = items
        self.terms, self.word = np.unique(words, return_inverse=True)
        size = np.diff(edges)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in np.unique(np.minimum(size[size > 0], window)).tolist():
            own = np.flatnonzero(size == m if m < window else size >= window)
            item, start = _ranges(edges[own], size[own] - m + 1)
            keys = rolled(words, m, BASE)[start]
            _, first, phrase = np.unique(keys, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([phrase, own[item]], axis=1), axis=0)
            edge = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
            self.groups[m] = (start[first], edge, pairs[:, 1])

    def rows(self, m: int, phrases: np.ndarray) -> np.ndarray:
        """The words (by number) of phrases of one length."""
        return self.word[self.groups[m][0][phrases][:, None] + np.arange(m)]


class Search:
    """One shard searched for one block."""

    def __init__(self, shard: Shard, block: Block):
        self.shard, self.block = shard, block
        at = np.searchsorted(shard.terms, block.terms)
        known = at < len(shard.terms)
        known[known] = shard.terms[at[known]] == block.terms[known]
        begins = np.cumsum(shard.counts, dtype=np.int64) - shard.counts
        self.count, self.first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        self.count[known] = shard.counts[at[known]]
        self.first[known] = begins[at[known]]
        self.total = int(shard.edges[-1])
        # The lists turned round: which of the block's words stands at a place, if any.
        which, entry = _ranges(self.first[known], self.count[known])
        self.here = np.full(self.total, -1, np.int32)
        self.here[shard.places[entry]] = np.flatnonzero(known)[which]

    def _alive(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of which the shard has every word, and their words."""
        every = np.arange(len(self.block.groups[m][0]))
        parts = []
        for k in range(0, len(every), STEP // m + 1):
            part = every[k : k + STEP // m + 1]
            parts.append(part[self.count[self.block.rows(m, part)].min(axis=1) > 0])
        alive = np.concatenate([every[:0], *parts])
        return alive, self.block.rows(m, alive)

    def _listed(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which, entry = _ranges(self.first[word], self.count[word])
        return which, self.shard.places[entry].astype(np.int64)

    def _stands(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        inside = (place >= 0) & (place < self.total)
        out = np.zeros(len(place), bool)
        out[inside] = self.here[place[inside]] == word[inside]
        return out

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.shard.edges, place, "right") - 1

    def exact(self, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases, places where they start), each occurrence once."""
        alive, words = self._alive(m)
        rank = np.argsort(self.count[words], axis=1, kind="stable")
        rows = np.arange(len(alive))
        a, b = rank[:, 0], rank[:, min(1, m - 1)]
        key = (words[rows, a] * len(self.count) + words[rows, b]) * (2 * m) + (b - a + m)
        _, first, pair = np.unique(key, return_index=True, return_inverse=True)
        pairs = np.stack([words[rows, a], words[rows, b], b - a], axis=1)[first]
        order = np.argsort(pair, kind="stable")
        begin = np.searchsorted(pair[order], np.arange(len(pairs)))
        users = np.bincount(pair, minlength=len(pairs))
        for part in _slices(self.count[pairs[:, 0]]) if len(pairs) else ():
            own = pairs[part]
            which, place = self._listed(own[:, 0])
            met = self._stands(place + own[which, 2], own[which, 1])
            which, place = which[met] + part.start, place[met]
            for cut in _slices(users[which]):
                source, entry = _ranges(begin[which[cut]], users[which[cut]])
                row = order[entry]
                start = place[cut][source] - a[row]
                good = (start >= 0) & (start + m <= self.total)
                row, start = row[good], start[good]
                good = self.document(start) == self.document(start + m - 1)
                row, start = row[good], start[good]
                for k in range(2, m):
                    offset = rank[row, k]
                    good = self._stands(start + offset, words[row, offset])
                    row, start = row[good], start[good]
                yield alive[row], start

    def near(self, m: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases, documents) with all words of the phrase in ``width`` consecutive words of the document."""
        alive, words = self._alive(m)
        if not len(alive):
            return
        rank = np.argsort(self.count[words], axis=1, kind="stable")
        ranked = np.take_along_axis(words, rank, axis=1)
        for part in _slices(self.count[ranked[:, 0]]):
            which, place = self._listed(ranked[part, 0])
            row = which + part.start
            doc = self.document(place)
            low = np.maximum(place - width + 1, self.shard.edges[doc])
            high = np.minimum(place + width, self.shard.edges[doc + 1])
            for k in range(1, m):  # the next rarest word must have a place around
                good = np.zeros(len(row), bool)
                for word in np.unique(ranked[row, k]):
                    mine = ranked[row, k] == word
                    listed = self.shard.places[self.first[word] : self.first[word] + self.count[word]]
                    good[mine] = np.searchsorted(listed, low[mine]) < np.searchsorted(listed, high[mine])
                row, doc, low, high = row[good], doc[good], low[good], high[good]
            hit = np.fromiter((self._within(set(ranked[r].tolist()), self.here[x:y], width) for r, x, y in zip(row, low, high)), bool, len(row))
            yield alive[row[hit]], doc[hit]

    @staticmethod
    def _within(wanted: set[int], around: np.ndarray, width: int) -> bool:
        last: dict[int, int] = {}
        for k, word in enumerate(around.tolist()):
            if word in wanted:
                last[word] = k
                if len(last) == len(wanted) and k - min(last.values()) < width:
                    return True
        return False


_INDEX = "ids array<{id}>, edges binary, terms binary, counts binary, places binary"


def build_index(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of all words of ``docs``, written: shard, ids (of its documents in order), edges, terms, counts, places."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, sizes, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            shard = Shard.of(np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64))
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (shard.edges, shard.terms, shard.counts, shard.places)]
            return pa.RecordBatch.from_arrays([pa.array([sum(ids, [])]), *packed], ["ids", "edges", "terms", "counts", "places"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                words, edges = tokens(part.column("text").to_pylist())
                ids.append(part.column("id").to_pylist())
                parts.append(words)
                sizes.append(np.diff(edges))
                held += len(words)
                if held >= shard_words:
                    yield row()
                    ids, parts, sizes, held = [], [], [], 0
        if ids:
            yield row()

    built = rows.mapInArrow(shards, _INDEX.format(id=id_type))
    return scratch.save(built.withColumn("shard", F.monotonically_increasing_id()), free=False)


def item_blocks(items: DataFrame, scratch: Scratch, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Items in blocks of about ``block_words`` words, written: items (ids as strings), edges, words."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).where("text IS NOT NULL")
    parts = max(1, -(-input_bytes(rows, "text") // (4 * block_words)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def row() -> pa.RecordBatch:
            words, edges = tokens(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.string())), pa.array([edges.astype(np.int64).tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary())],
                ["items", "edges", "words"],
            )

        for batch in batches:
            for name, body in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(name)
                texts.append(body)
                held += len(body) // 2 + 1  # words at most
                if held >= block_words:
                    yield row()
                    ids, texts, held = [], [], 0
        if ids:
            yield row()

    return scratch.save(rows.repartition(parts).mapInArrow(pack, "items array<string>, edges binary, words binary"), free=False)


_FOUND = "shard bigint, at int, doc_id {id}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, near array<string>"


def _search(index: DataFrame, block: Block, every: bool, slop: int | None) -> DataFrame:
    """A row per document with something found (per document at all where ``every``)."""
    sent = index.sparkSession.sparkContext.broadcast(block)  # a block: at most BLOCK_WORDS words and one item
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def listed(search: Search, m: int, phrases: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (document, item)."""
        _, edge, item = search.block.groups[m]
        pairs = np.unique(np.stack([doc, phrases], axis=1), axis=0)
        source, entry = _ranges(edge[pairs[:, 1]], np.diff(edge)[pairs[:, 1]])
        return np.stack([pairs[source, 0], item[entry]], axis=1)

    def names(search: Search, pairs: list[np.ndarray], n: int) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in range(n)]
        for doc, item in np.unique(np.concatenate([np.empty((0, 2), np.int64), *pairs]), axis=0).tolist():
            out[doc].append(search.block.items[item])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in ("shard", "ids", "edges", "terms", "counts", "places")}
                kinds = {"edges": np.int64, "terms": np.uint64, "counts": np.uint32, "places": np.uint32}
                search = Search(Shard(*[np.frombuffer(one[c], t) for c, t in kinds.items()]), sent.value)
                n, edges = len(one["ids"]), search.shard.edges
                step = np.zeros(search.total + 1, np.int64)
                exact, near = [], []
                for m in search.block.groups:
                    for phrases, start in search.exact(m):
                        step += np.bincount(start, minlength=len(step)) - np.bincount(start + m, minlength=len(step))
                        exact.append(listed(search, m, phrases, search.document(start)))
                    if slop is not None:
                        near.extend(listed(search, m, phrases, doc) for phrases, doc in search.near(m, m + slop))
                covered = np.cumsum(step)[:-1] > 0
                begins = covered & ~np.concatenate([[False], covered[:-1]])
                inner = edges[(edges > 0) & (edges < search.total)]
                begins[inner] |= covered[inner]  # a new text starts a new span
                ends = covered & np.concatenate([~covered[1:] | begins[1:], [True]])
                first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                doc = search.document(first)
                cut = np.searchsorted(doc, np.arange(n + 1))
                first, last = first - edges[doc], last - edges[doc]
                spans = [[{"start": a, "end": b} for a, b in zip(first[x:y].tolist(), last[x:y].tolist())] for x, y in zip(cut, cut[1:])]
                found, close = names(search, exact, n), names(search, near, n)
                size = np.diff(edges)
                keep = [d for d in range(n) if every or spans[d] or close[d]]
                columns = [
                    pa.array([one["shard"]] * len(keep), pa.int64()), pa.array(keep, pa.int32()), batch.column("ids")[k].values.take(pa.array(keep, pa.int64())),
                    pa.array(size[keep], pa.int64()), pa.array([spans[d] for d in keep], span), pa.array([found[d] for d in keep], pa.list_(pa.string())),
                    pa.array([close[d] for d in keep], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "at", "doc_id", "n_words", "spans", "items", "near"])

    return index.mapInArrow(run, _FOUND.format(id=id_type))


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, slop: int | None = None, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of a phrase), spans (start, end; they may overlap where
    there are several blocks of items), items (ids as strings, distinct, sorted), near (items of which all words of
    a phrase lie within its length plus ``slop`` words; empty without ``slop``).

    A phrase is ``window`` consecutive words of an item, or all of an item with fewer. Null and empty
    texts have no words and hold nothing; null and repeated document ids are rows like any other; items
    without an id cover words but are not listed. An empty table of documents gives an empty one, and
    without items nothing is hit.
    """
    scratch = Scratch(docs.sparkSession, "contamination")
    index = build_index(docs, scratch, doc_id, text, shard_words)
    blocks = item_blocks(items, scratch, item_id, item_text, block_words)
    found = None
    for row in blocks.toLocalIterator():  # one block of bounded size at a time
        block = Block(row["items"], np.frombuffer(row["words"], np.uint64), np.frombuffer(row["edges"], np.int64), window)
        part = _search(index, block, found is None, slop)
        found = part if found is None else found.unionByName(scratch.save(part, free=False))
    if found is None:
        found = _search(index, Block([], np.empty(0, np.uint64), np.zeros(1, np.int64), window), True, slop)
    elif blocks.count() > 1:
        lists = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "items", "near")]
        found = found.groupBy("shard", "at").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists)
    state = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("hit"))
    merged = F.aggregate(
        F.sort_array("spans"), state,
        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["hit"] + F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(s["end"], x["start"]))).alias("hit")),
    )
    known = [F.sort_array(F.array_compact(c)).alias(c) for c in ("items", "near")]
    return found.select("doc_id", "n_words", merged["hit"].alias("n_hit"), "spans", *known)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLE = f"""
WITH items AS MATERIALIZED (
  SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
phrases AS MATERIALIZED (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
hits AS MATERIALIZED (
  SELECT r, i, d.m, item_id FROM (
    SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM items))) d
  JOIN phrases p ON p.m = d.m AND p.phrase = d.phrase),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, list(id ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
