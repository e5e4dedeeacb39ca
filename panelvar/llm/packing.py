"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit. Bins that hold more than half of a sequence, or were opened for want of
room, offer their gap; all other pieces ask for a place. Each round

1. range-sorts gaps and pieces together by size, largest first (gaps before pieces of equal size);
2. sweeps the sorted partitions: a running sum counts +1 for a gap and -1 for a piece, so the
   smallest gap that is still free for a piece is the last gap at the same level of that sum. Each
   partition sums alone, one row per partition gives the levels at which the partitions start;
3. matches the neighbours of each level. Several pieces that want one gap differ in level, so rank
   decides; a piece below every earlier level found no gap, and its level is its rank among such
   pieces: the first few of them, as many as their volume asks for, open bins of their own;
4. updates gaps and repeats until no piece is left.

Equal values put all gaps before all pieces, so a level has at most two rows for each size: no
group grows with the data. Bins too full for the smallest piece left stay out of later rounds.
"""

from __future__ import annotations

import base64
import functools
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelvar.llm.shared import Scratch, parallelism

CAPACITY = 1024
END_OF_TEXT = 2
#: Rounds in which bins are opened by volume alone, which packs tightest; beyond them few pieces are left.
PATIENT_ROUNDS = 6

class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers.

    The vocabulary comes as a tokenizers file and as ranks; both give the same ids, the ranks at
    several times the speed. A text that holds the string of a special token goes to the former,
    which gives that token its own id.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@functools.cache
def _encoder(*vocabulary: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(*vocabulary)


def cut(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = CAPACITY, with_ids: bool = False, text: str = "text") -> DataFrame:
    """The pieces of each document: its ids and an end mark, in pieces of ``capacity`` tokens.

    Only documents beyond ``capacity`` are cut; what doesn't fill a piece comes first. Null text
    counts as empty (one piece with the end mark). All columns of ``docs`` but the text stay, under
    ``doc``; a row repeated in ``docs`` is a document of its own.
    """
    kept = [f.name for f in docs.schema.fields if f.name != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    extra = ", ids: binary" if with_ids else ""
    doc_type = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {doc_type}, piece int, start bigint, length bigint, ids_crc32 bigint{extra}"
    mark = np.asarray([END_OF_TEXT], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, text_ in enumerate(part.column("text").to_pylist()):
                    body = encoder.encode(text_).tobytes() + mark
                    total = len(body) // 4
                    edges = [0, *range(total % capacity or capacity, total + 1, capacity)] if total > capacity else [0, total]
                    for n, (a, b) in enumerate(zip(edges, edges[1:])):
                        row.append(k)
                        piece.append(n)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(memoryview(body)[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(body[4 * a : 4 * b])
                columns = [part.column("doc").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                names = ["doc", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(encode, schema)


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Best fit of ``items`` (item long, unique; load, from 1 to ``capacity``).

    Returns item, sequence_id, offset: each item once, offsets of a sequence gapless from 0 in any
    order of its items, and no sequence beyond ``capacity``. An empty table gives an empty one.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    half = capacity // 2
    # Very small items travel in bundles of up to a sixteenth of a sequence, made within a task.
    small = capacity // 16
    things = _bundles(items, small).withColumn("is_bin", F.col("load") > half)
    table, levels = _sorted(scratch, things, capacity)
    finished = []
    while levels is not None:
        least, opened, base = levels
        done = table.where("is_bin AND gap < %d" % least) if least else table.where("is_bin")
        finished.append(done.select("load", "members"))
        if not least:
            break
        live = table.where("NOT is_bin OR gap >= %d" % least)
        start = F.element_at(F.lit(base).cast("array<bigint>"), F.col("block") + 1)
        # A gap is known by the level behind it, a piece by the level before it.
        live = live.withColumn("level", start + F.col("run") + F.when(F.col("is_bin"), 0).otherwise(1))
        by_level = Window.partitionBy("level").orderBy("block", "row")
        live = (
            live.withColumn("after", F.lead(F.struct("is_bin", "load", "members")).over(by_level))
            .withColumn("before", F.lag("is_bin").over(by_level))
            .withColumn("pairs", F.coalesce(F.col("is_bin") & ~F.col("after.is_bin"), F.lit(False)))
            .where("is_bin OR NOT coalesce(before, false)")
        )
        things = live.select(
            F.when(F.col("pairs"), F.col("load") + F.col("after.load")).otherwise(F.col("load")).alias("load"),
            F.when(F.col("pairs"), F.concat("members", "after.members")).otherwise(F.col("members")).alias("members"),
            (F.col("is_bin") | ((F.lit(1) - F.col("level")) <= opened)).alias("is_bin"),
        )
        table, levels = _sorted(scratch, things, capacity)
    sequences = table.where("false").select("load", "members")
    for more in finished:
        sequences = sequences.unionByName(more)
    first = F.col("members")[0]["item"].alias("sequence_id")
    rows = sequences.select(first, F.posexplode("members").alias("at", "member"), "members")
    before = F.aggregate(F.slice("members", F.lit(1), F.col("at")), F.lit(0).cast("bigint"), lambda s, m: s + m["load"])
    return rows.select(F.col("member.item").alias("item"), "sequence_id", before.alias("offset"))


def _bundles(items: DataFrame, small: int) -> DataFrame:
    member = F.struct("item", F.col("load").cast("bigint").alias("load"))
    large = items.where(F.col("load") >= small).select(F.col("load").cast("bigint").alias("load"), F.array(member).alias("members"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, load = batch.column("item").to_numpy(), batch.column("load").to_numpy()
            key, filled, keys = 0, 0, []
            for n in load.tolist():
                if filled + n > small:
                    key, filled = key + 1, 0
                filled += n
                keys.append(key)
            edges = np.flatnonzero(np.diff(np.asarray(keys), prepend=-1)).tolist() + [len(keys)] if keys else [0]
            lists = [[{"item": i, "load": n} for i, n in zip(item[a:b].tolist(), load[a:b].tolist())] for a, b in zip(edges, edges[1:])]
            loads = [int(load[a:b].sum()) for a, b in zip(edges, edges[1:])]
            kind = pa.list_(pa.struct([("item", pa.int64()), ("load", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(loads, pa.int64()), pa.array(lists, kind)], ["load", "members"])

    tiny = items.where(F.col("load") < small).select("item", F.col("load").cast("bigint").alias("load"))
    return large.unionByName(tiny.mapInArrow(bundle, "load bigint, members array<struct<item: bigint, load: bigint>>"))


def _sorted(scratch: Scratch, things: DataFrame, capacity: int):
    """Range-sorts gaps and pieces, sums within partitions, and reads one row per partition.

    Returns the stored table and (smallest piece, bins to open, level before each partition), or
    None for the latter if no row is left. The stored table holds partition and row numbers, so a
    later job takes the same order whatever its own partitions are.
    """
    spark = scratch.spark
    things = things.withColumn("gap", F.lit(capacity) - F.col("load"))
    value = F.when(F.col("is_bin"), F.col("gap")).otherwise(F.col("load"))
    ordered = (
        things.withColumn("value", value)
        .repartitionByRange(parallelism(spark), F.desc("value"), F.desc("is_bin"), F.col("members")[0]["item"])
        .sortWithinPartitions(F.desc("value"), F.desc("is_bin"), F.col("members")[0]["item"])
        .select("load", "gap", "is_bin", "members")
    )

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, total, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            step = np.where(batch.column("is_bin").to_numpy(zero_copy_only=False), 1, -1)
            run = total + np.cumsum(step)
            total = int(run[-1])
            n = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            more = [pa.array(np.full(batch.num_rows, block), pa.int32()), pa.array(n, pa.int64()), pa.array(run, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "block", "row", "run"])

    fields = "load bigint, gap bigint, is_bin boolean, members array<struct<item: bigint, load: bigint>>"
    table = scratch.save(ordered.mapInArrow(running, fields + ", block int, row bigint, run bigint"))
    return table, _levels(table, capacity, scratch.count)


def _levels(table: DataFrame, capacity: int, turn: int):
    """Smallest piece, how many unmatched pieces open a bin, and the level before each partition."""
    piece = ~F.col("is_bin")
    some = table.agg(
        F.min(F.when(piece, F.col("load"))).alias("least"),
        F.sum(F.when(piece, F.col("load"))).alias("volume"),
        F.sum(piece.cast("bigint")).alias("pieces"),
        F.max(F.when(F.col("is_bin"), F.col("gap"))).alias("widest"),
        F.count("*").alias("rows"),
    ).first()
    if not some["rows"]:
        return None
    if not some["pieces"]:
        return None, 0, []
    least, mean = some["least"], some["volume"] / some["pieces"]
    # Bins too full for any piece come last in the order (smallest gaps), so the sums before them hold.
    live = table.where(piece | (F.col("gap") >= least))
    blocks = live.groupBy("block").agg(
        F.max_by("run", "row").alias("net"),
        F.min("run").alias("low"),
        F.sum(F.when(F.col("is_bin"), F.col("gap")).otherwise(0)).alias("room"),
        F.sum(F.when(F.col("is_bin"), F.floor(F.col("gap") / mean)).otherwise(0)).alias("slots"),
        F.sum(F.when(piece & (F.col("load") > (some["widest"] or 0)), F.col("load")).otherwise(0)).alias("above"),
    )
    level, lowest, base, room, slots, above = 0, 0, {}, 0, 0, 0
    for b in sorted(blocks.collect(), key=lambda b: b["block"]):
        base[b["block"]] = level
        lowest = min(lowest, level + b["low"])
        level += b["net"]
        room, slots, above = room + b["room"], slots + b["slots"], above + b["above"]
    # Early on only the volume that can't fit asks for new bins; later, in small rests, the number of places.
    wanted = some["volume"] - room if turn <= PATIENT_ROUNDS else (some["pieces"] - slots) * mean
    opened = min(-lowest, max(math.ceil(above / capacity), math.ceil(wanted / capacity), 0))
    return least, opened, [base.get(k, 0) for k in range(max(base) + 1)]


def pack(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = CAPACITY, with_ids: bool = False, text: str = "text") -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` tokens.

    Returns for each piece the columns of ``docs`` but the text, then piece, start, length,
    ids_crc32, (ids,) sequence_id and offset; a column of ``docs`` with one of these names is left
    out. Null and empty texts are one end mark; repeated rows are packed each on its own; ties in
    size are placed in the order of their numbers. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces")
    pieces = scratch.save(cut(docs, vocabulary, capacity, with_ids, text).withColumn("item", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("bigint")})
    rest = pieces.where(F.col("length") < capacity)
    where = place(rest.select("item", F.col("length").alias("load")), capacity)
    placed = full.unionByName(rest.join(where, "item"))
    own = [c for c in placed.columns if c not in ("doc", "item")]
    return placed.select(*[F.col(f"doc.`{c}`") for c in placed.schema["doc"].dataType.names if c not in own], *own)


def public_vocabulary() -> tuple[str, str, str]:
    """Files of the vocabulary (as tokenizers file, as ranks) and the pattern that splits text."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_vocabulary())
