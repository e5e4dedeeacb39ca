"""Near-duplicates by SetSketch registers, banded, estimated by likelihood and verified on full sets.

1. A text's set holds its five-word shingles as 64-bit hashes. Register i of its sketch is
   floor(1 - log_b(min of exponential numbers that the set's members get for i)), truncated to
   [0, q + 1]; registers of a union are the larger of both, so sketches merge.
2. Texts with the same words form a class; classes are compared through one representative.
3. Six registers make a band key. Keys with one member end there. In each of a few rounds every
   member of a key that spans several components is paired with one centre of it in another component
   (first that which shares most keys with others, then different ones), so pairs grow with members
   and not with their square. Pairs are sifted by the lowest bits of all registers, estimated (most
   likely similarity given how many registers are larger, smaller and equal), then verified on full
   sets; links form components by label propagation.
4. What still spans several components is settled exactly, in one of two ways. Keys of few members get
   all pairs across components. In larger ones every member x is compared with a centre M on full
   sets: keys whose largest part is of the same component share its hub, so that a member of many such
   keys is compared and indexed once (M need not hold the key for what follows). A pair without a shared shingle outside M has at most min(|x & M|, |c & M|) shingles in
   common, which for an x that M isn't linked with is too few unless c is smaller than M and x almost
   linked; such pairs are found by size. All other links share shingles outside M: these are indexed,
   pairs are counted on them, and verified if |x & M| and the count can reach the limit together.
   No link between different texts is lost, and within a component no pair can add anything.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelvar.llm.shared import Scratch
from panelvar.llm.substrings import BASES, rolled, word_hashes

SHINGLE, PERCENT = 5, 75
#: Registers by band and bands: a pair at the limit misses all bands once in 290,000.
ROWS, BANDS = 6, 64
#: SetSketch parameters: base, rate, and the largest register less one.
BASE, RATE, MOST = 1.001, 20.0, (1 << 16) - 2
#: Pairs estimated below the limit less this are not verified: six standard deviations.
SLACK = 0.14
#: Registers of a pair at the limit differ in their lowest bit 48 times on average; this is six
#: standard deviations more. Beyond it a pair is dropped where it is joined, before it becomes a row.
MOST_BITS = 87
TAGS = tuple(f"t{k}" for k in range(ROWS * BANDS // 64))
#: Rounds in which members meet one centre each, and members up to which a key gets all its pairs across components then.
CENTRES, FEW = 3, 16
#: Parts into which the sizes below a centre's are dealt to find pairs by size.
SIZES = 64
#: Shared keys up to which they are sent to every task; beyond, keys are shuffled.
BROADCAST_KEYS = 2_000_000
#: Rows of the candidates' numbers up to which they are sent to every task; beyond, texts are shuffled.
BROADCAST_ROWS = 4_000_000
#: Links (and labels of earlier ones) up to which their nodes' labels are sent to every task; beyond, they are shuffled.
BROADCAST_LINKS = 250_000


@functools.cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 31, ROWS * BANDS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a text; of a shorter one all its words as one; none without words."""
    words, _ = word_hashes([text.lower()], 2)  # bytes: A-Z alone are lower-cased
    if not len(words):
        return words
    return np.unique(rolled(words, min(SHINGLE, len(words)), BASES[0] if len(words) >= SHINGLE else BASES[1] + 2 * len(words)))


def sketch(members: np.ndarray) -> np.ndarray:
    """Registers of a set that isn't empty."""
    short = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), 512):
        np.minimum(least, np.multiply.outer(short[k : k + 512], _multipliers()).min(axis=0), out=least)
    # The smallest of uniform numbers gives the smallest of exponential ones.
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, MOST + 1).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    parts = registers.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(BASES[0])
    for k in range(ROWS):
        key = (key ^ parts[:, k]) * np.uint64(BASES[1])
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs of sketches (a row each), the sets' sizes being known."""
    m = a.shape[1]
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    larger, smaller = p(u - v * j), p(v - u * j)
    same = np.clip(1 - larger - smaller, 1e-12, 1)
    likely = more * np.log(larger) + less * np.log(smaller) + (m - more - less) * np.log(same)
    return np.take_along_axis(j, likely.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    doc_type = rows.schema["doc"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, word, bands = [], [], []
                for body in part.column("text").to_pylist():
                    found = shingles(body)
                    n.append(len(found))
                    word.append(xxhash.xxh3_128_digest(b" ".join(body.lower().split())))
                    bands.append(band_keys(sketch(found)) if len(found) else None)
                columns = [part.column("doc"), part.column("id"), pa.array(n, pa.int64()), pa.array(word, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "id", "n", "same", "bands"])

    return rows.mapInArrow(add, f"doc {doc_type}, id bigint, n bigint, same binary, bands array<bigint>")


def _close(u: str, v: str) -> Column:
    """Whether two rows of TAGS may belong to texts at the limit."""
    differ = [F.bit_count(F.col(f"{u}.{t}").bitwiseXOR(F.col(f"{v}.{t}"))) for t in TAGS]
    return functools.reduce(lambda x, y: x + y, differ) <= MOST_BITS


def _likely(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b, r_a, r_b) that may reach the limit, as a, b."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("r_a", "r_b")]
            n = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            near = [estimate(r[0][k : k + 256], r[1][k : k + 256], n[0][k : k + 256], n[1][k : k + 256]) for k in range(0, batch.num_rows, 256)]
            mask = pa.array(np.concatenate(near) >= PERCENT / 100 - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return pairs.mapInArrow(keep, "a bigint, b bigint")


def _verified(pairs: DataFrame) -> DataFrame:
    """a, b, linked, from a, b and both texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # centres come again and again
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                linked = []
                for b, text_a, text_b in zip(part.column("b").to_pylist(), part.column("t_a").to_pylist(), part.column("t_b").to_pylist()):
                    if b not in known:
                        if len(known) >= 64:
                            known.clear()
                        known[b] = shingles(text_b)
                    mine = shingles(text_a)
                    shared = len(np.intersect1d(mine, known[b], assume_unique=True))
                    linked.append(100 * shared >= PERCENT * (len(mine) + len(known[b]) - shared))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return pairs.mapInArrow(check, "a bigint, b bigint, linked boolean")


def _compared(pairs: DataFrame) -> DataFrame:
    """a, b, shared (shingles in both), rest (those of a outside b), from a, b and both texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # centres come again and again
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shared, rest = [], []
                for b, text_a, text_b in zip(part.column("b").to_pylist(), part.column("t_a").to_pylist(), part.column("t_b").to_pylist()):
                    if b not in known:
                        if len(known) >= 64:
                            known.clear()
                        known[b] = shingles(text_b)
                    mine = shingles(text_a)
                    outside = np.setdiff1d(mine, known[b], assume_unique=True)
                    shared.append(len(mine) - len(outside))
                    rest.append(outside.view(np.int64))
                columns = [part.column("a"), part.column("b"), pa.array(shared, pa.int64()), pa.array(rest, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "shared", "rest"])

    return pairs.mapInArrow(check, "a bigint, b bigint, shared bigint, rest array<bigint>")


def _joined(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) of a saved table with ``columns`` of ``table`` (by key) for a and b, named c_a and c_b.

    Up to BROADCAST_KEYS pairs go to the rows, so that only rows with a partner move, and only once.
    """
    a, b = (table.select(F.col("key").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns]) for k in ("a", "b"))
    if pairs.count() <= BROADCAST_KEYS:
        return a.join(F.broadcast(pairs), "a").join(b.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi"), "b")
    return pairs.join(a, "a").join(b, "b")


def _reaches(shared: Column | str, n_a: str = "n_a", n_b: str = "n_b") -> Column:
    """Whether so many shingles in common link two sets."""
    shared = F.col(shared) if isinstance(shared, str) else shared
    return (100 + PERCENT) * shared >= PERCENT * (F.col(n_a) + F.col(n_b))


def _open_pairs(spokes: DataFrame) -> DataFrame:
    """a, b: the pairs in different components that may be linked, by their places around a centre.

    ``spokes``: b (centre), n_b, a, n_a, comp, shared, rest; one row per member and centre.
    """
    rows = spokes.select("b", "n_b", F.col("a").alias("key"), F.col("n_a").alias("n"), "comp", "shared", "rest")
    apart = ~_reaches("shared", "n", "n_b")  # not linked with the centre
    bucket = lambda size: F.floor(size * SIZES / F.col("n_b"))
    most = F.least(F.col("n_b") - 1, F.floor((100 + PERCENT) * F.col("shared") / PERCENT - F.col("n")))
    least = F.ceil(PERCENT * F.col("n") / 100)
    near = rows.where(apart & (least <= most)).select("b", "key", "n", "comp", "shared", F.explode(F.sequence(bucket(least), bucket(most))).alias("at"))
    smaller = rows.where("n < n_b").select("b", *[F.col(c).alias(f"{c}_c") for c in ("key", "n", "comp", "shared")], bucket(F.col("n")).alias("at"))
    by_size = near.join(smaller, ["b", "at"]).where("comp <> comp_c").where(_reaches(F.least("shared", "shared_c"), "n", "n_c"))
    # Of its shingles outside the centre a set must share at least ``need`` with any partner, so some shared one is among
    # all but the last need - 1 of either side, in the order of the hashes.
    smallest = rows.groupBy("b").agg(F.min("n").alias("n_min"))
    partner = F.greatest(F.ceil(PERCENT * F.col("n") / 100), F.col("n_min"))
    need = F.greatest(F.lit(1), F.ceil(PERCENT * (F.col("n") + partner) / (100 + PERCENT)) - F.col("shared"))
    out = rows.join(smallest, "b").withColumn("first", (F.size("rest") - need + 1).cast("int")).where("first > 0")
    out = out.select("b", "key", "comp", apart.alias("apart"), F.explode(F.slice("rest", F.lit(1), F.col("first"))).alias("shingle"))
    other = out.select("b", "shingle", *[F.col(k).alias(f"{k}_c") for k in ("key", "comp", "apart")])
    met = out.where("apart").join(other, ["b", "shingle"]).where("comp <> comp_c AND (NOT apart_c OR key < key_c)")
    met = met.select("b", "key", "key_c").distinct()
    whole = rows.select("b", "key", "n", "shared", "rest")
    met = met.join(whole, ["b", "key"]).join(whole.toDF("b", *[f"{k}_c" for k in whole.columns[1:]]), ["b", "key_c"])
    more = F.size(F.array_intersect("rest", "rest_c"))
    by_rest = met.where(_reaches(F.least("shared", "shared_c") + more, "n", "n_c"))
    pairs = by_size.select("key", "key_c").unionByName(by_rest.select("key", "key_c"))
    return pairs.select(F.least("key", "key_c").alias("a"), F.greatest("key", "key_c").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """node, comp (its component's smallest node) for all nodes of ``links`` (a, b) and of ``known``, the result for earlier links.

    Few labels are sent to every task, so that a round deals rows once, where nodes and their neighbours' labels meet.
    """
    if known is not None:
        links = links.select("a", "b").unionByName(known.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    small = links.count() <= BROADCAST_LINKS
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    labels = last = scratch.save(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("comp")))
    while True:
        sent = F.broadcast(labels) if small else labels
        near = both.join(sent, F.col("y") == F.col("node")).select(F.col("x").alias("node"), "comp", F.lit(None).cast("bigint").alias("old"))
        step = labels.select("node", "comp", F.col("comp").alias("old")).unionByName(near).groupBy("node").agg(F.min("comp").alias("low"), F.max("old").alias("old"))
        # Jump: the label of the label.
        jump = sent.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        step = step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("comp"), "old")
        last = step = scratch.save(step, drop=(last,))
        labels = step.select("node", "comp")
        if step.where("comp <> old").isEmpty():
            return F.broadcast(labels) if small else labels


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("key"))
    return rows.join(labels, F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "key")).drop("node")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc (all columns), n_shingles, component_id (smallest id reachable by links), kept.

    Null and empty texts have no shingles and no links. Null ids take part; a component's id is the
    smallest that isn't null, and null if there is none. Rows alike in all columns share a
    component and are kept or not together. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near", codec="zstd")
    table = scratch.save(_sketched(docs, doc_id, text).withColumn("key", F.monotonically_increasing_id()))
    classes = table.where("n > 0").groupBy("same").agg(F.min("key").alias("key"), F.min("id").alias("low"), F.first("n").alias("n"), F.count("*").alias("rows"))
    classes = scratch.save(classes)
    # One text of each class. Only classes with copies are looked up, so that band keys stay where they are;
    # with too many of those the band keys move, once for both of their readers.
    repeated = classes.where("rows > 1").select(F.col("same").alias("word"), F.col("key").alias("c"))
    moved = ()
    if repeated.count() <= BROADCAST_KEYS:
        ones = table.where("n > 0").join(F.broadcast(repeated), F.col("same") == F.col("word"), "left").where("c IS NULL OR c = key")
    else:
        ones = scratch.save(table.join(classes.select(F.col("key").alias("c")), F.col("key") == F.col("c"), "left_semi").select("key", "n", "bands"))
        moved = (ones,)
    banded = ones.select("key", "n", F.explode("bands").alias("band"))
    shared = scratch.save(banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"))
    # Members of keys that several classes share.
    few = shared.count() <= BROADCAST_KEYS
    members = members_table = scratch.save(banded.join(F.broadcast(shared) if few else shared, "band"), drop=(shared, *moved))
    wanted = scratch.save(members.groupBy("key").agg(F.sum("members").alias("weight")))
    small = wanted.count() <= BROADCAST_ROWS
    members = members.drop("members").join(F.broadcast(wanted) if small else wanted, "key")
    texts = table.join(F.broadcast(wanted.select("key")) if small else wanted.select("key"), "key", "left_semi").select("key", "n", F.coalesce(F.col(f"doc.`{text}`"), F.lit("")).cast("binary").alias("text"))
    tag_types = ", ".join(f"{t} bigint" for t in TAGS)
    texts = scratch.save(texts.mapInArrow(_with_sketch, f"key bigint, n bigint, text binary, registers binary, {tag_types}"))
    tags = texts.select("key", F.struct(*TAGS).alias("tag"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """a, b, linked for the likely ones of ``pairs`` (a, b)."""
        pairs = pairs.join(tags.toDF("a", "u"), "a").join(tags.toDF("b", "v"), "b").where(_close("u", "v")).select("a", "b")
        pairs = scratch.save(pairs)
        likely = scratch.save(_likely(_joined(pairs, texts.withColumnRenamed("registers", "r"), "n", "r")))
        return scratch.save(_verified(_joined(likely, texts.withColumnRenamed("text", "t"), "t")))

    labels, tried, done_with = None, None, members_table
    for turn in range(CENTRES):
        # The nearest thing to a hub: of the centres of a member's keys, the one that comes most often.
        here = _labelled(members, labels)
        order = F.xxhash64("key", F.lit(turn)) if turn else F.col("weight")
        first = F.max_by(F.struct("key", "comp"), F.struct(order.alias("o"), "key")).alias("centre")
        mixed = here.groupBy("band").agg(first, F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2")
        # Keys whose members are all in one component are done.
        here = done_with = scratch.save(here.join(mixed.select("band", "centre"), "band"), drop=(done_with,))
        members = here.drop("centre", "comp")
        stars = here.where("comp <> centre.comp").groupBy(F.col("key").alias("a"), F.col("centre.key").alias("b")).agg(F.count("*").alias("bands"))
        stars = stars.groupBy("a").agg(F.max(F.struct("bands", "b")).alias("s")).select("a", F.col("s.b").alias("b"))
        if tried is not None:
            stars = stars.join(tried, ["a", "b"], "left_anti")
        stars = scratch.save(stars)
        if stars.isEmpty():
            break
        done = confirm(stars)
        found = done.where("linked").select("a", "b")
        if not found.isEmpty():
            labels = components(found, scratch, labels)
        tried = done.select("a", "b") if tried is None else tried.unionByName(done.select("a", "b"))
    if tried is None:  # no key is shared
        tried = spark.createDataFrame([], "a bigint, b bigint")
    here = scratch.save(_labelled(members, labels))
    sizes = here.groupBy("band", "comp").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("band").agg(F.max_by("comp", F.struct("size", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("size").alias("size"))
    left = scratch.save(here.join(mixed.where("comps > 1").drop("comps"), "band"))
    hubs = left.where((F.col("size") > FEW) & (F.col("comp") == F.col("top"))).groupBy("top").agg(F.max(F.struct("weight", "key"))["key"].alias("hub"))
    again = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))

    few = left.where(F.col("size") <= FEW).join(tags, "key")
    some = few.where("comp <> top").select("band", F.col("key").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"), F.col("tag").alias("u"))
    every = few.select("band", F.col("key").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("tag").alias("v"), "top")
    across = (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("top")) | (F.col("a") < F.col("b")))
    sized = (F.col("n_a") * 100 >= F.col("n_b") * PERCENT) & (F.col("n_b") * 100 >= F.col("n_a") * PERCENT)
    rest = some.join(every, (some["band"] == every["band"]) & across & sized & _close("u", "v")).select("a", "b").distinct()

    spokes = left.where(F.col("size") > FEW).select("key", "top").distinct().join(hubs, "top").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    compared = scratch.save(_compared(_joined(scratch.save(spokes), texts.withColumnRenamed("text", "t"), "t")))
    n = texts.select("key", "n")
    compared = compared.join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    found = scratch.save(compared.where(_reaches("shared")).select("a", "b"))
    if not found.isEmpty():
        labels = components(found, scratch, labels)
    placed = _labelled(compared.withColumnRenamed("a", "key"), labels).withColumnRenamed("key", "a")
    rest = rest.unionByName(_open_pairs(scratch.save(placed))).distinct()
    done = confirm(rest.join(again, ["a", "b"], "left_anti"))
    found = done.where("linked").select("a", "b")
    if not found.isEmpty():
        labels = components(found, scratch, labels)

    named = _labelled(classes, labels)
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    # A text without copies and links is its own component: only the others are looked up, so that texts mostly stay where they are.
    named = named.join(lows, "comp").where((F.col("rows") > 1) | ~F.col("low").eqNullSafe(F.col("component_id")))
    named = scratch.save(named.select(F.col("same").alias("word"), "component_id", F.lit(True).alias("found")))
    few = named.count() <= BROADCAST_KEYS
    out = table.join(F.broadcast(named) if few else named, (F.col("same") == F.col("word")) & (F.col("n") > 0), "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("doc", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _with_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            registers = [sketch(shingles(t)) for t in part.column("text").to_pylist()]
            tags = np.packbits(np.stack(registers).astype(np.uint8) & 1, axis=1).view(np.int64)
            more = [pa.array([r.tobytes() for r in registers], pa.binary()), *[pa.array(tags[:, k].copy()) for k in range(len(TAGS))]]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "registers", *TAGS])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc.doc_id", "n_shingles", "component_id", "kept")
