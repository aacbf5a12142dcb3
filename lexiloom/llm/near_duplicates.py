"""Near-duplicate documents by SuperMinHash signatures, banding and verification on full shingle sets.

SuperMinHash gives every element of a set its own random permutation of the SLOTS places, drawn step by step:
at step j an element proposes j plus a random fraction at the j-th place of its permutation, and each place
keeps its least value. Values of one set are correlated in a way that lowers the variance of estimates, and
an element need not go on once j exceeds the largest whole part in the set's signature.

Sets that are equal form a class. Classes that agree on a band of ROWS places are candidates. Within a band's
group only pairs with a pivot are verified, in some rounds with other pivots; classes that are still in
different components are then compared block by block, and pairs whose signatures agree enough are verified.
So no group is expanded to its pairs, and none is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Digests, joined, mixed, signed, slices, texts_of, written
from lexiloom.llm.components import components

SLOTS = 128
BANDS = 32
ROWS = 4  # a pair at similarity 0.8 misses all 32 bands with probability 5e-8
PIVOT_ROUNDS = 2
LONG = 1024  # places of the signatures that tell pairs of open groups apart
BLOCK = 1024
SLACK = 0.0625  # how far below the threshold their agreement may lie: five standard deviations
PAIRS_PER_COPY = 256
NO_ID = -(1 << 63)
GOLD = 0x9E3779B97F4A7C15
SHORT = 32  # bytes of a word whose digest is a sum of powers
MARK_BITS = 1 << 26  # places of the broadcast marks of wanted documents: 8 MB at most
MARKS_PER_ID = 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles_of(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the distinct shingles of each text, ascending, and where each text's begin (plus the end).

    A-Z are lower-cased; a text of fewer words than a shingle has its whole sequence as one, one without words none.
    """
    data, starts = joined(texts, 1, b" ")
    data = _LOWER[data]
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.append(True, space[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(space & np.append(False, ~space[:-1])) if len(data) else np.zeros(0, np.int64)
    word = Digests(data).of(begins, ends)
    # Sums of powers modulo 2^64 repeat on long words of two letters in a known pattern; long words get a standard hash.
    for i in np.flatnonzero(ends - begins > SHORT).tolist():
        word[i] = int.from_bytes(blake2b(data[begins[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    first = np.searchsorted(begins, starts)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(word)) - np.repeat(first[:-1], counts)
    room = np.repeat(counts, counts)
    total = np.zeros(len(word), np.uint64)
    for k in range(words):
        inside = place + k < room
        factor = mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1)
        total[inside] += word[np.flatnonzero(inside) + k] * factor
    value = mixed(total + np.minimum(room, words).astype(np.uint64))
    keep = (place + words <= room) | (place == 0)
    owner, value = owner[keep], value[keep]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[fresh], value[fresh]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures_of(values: np.ndarray, edges: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, a row for each set: whole part in the high and fraction in the low 32 bits."""
    sets, sizes = len(edges) - 1, np.diff(edges)
    least = np.full(sets * slots, np.uint64((1 << 64) - 1))
    owner = np.repeat(np.arange(sets), sizes)
    draw = lambda some, step: mixed(some + np.uint64(((step + 1) * GOLD) & ((1 << 64) - 1)))
    some, order = values, None
    for j in range(slots):
        if j:
            # Early stop: only sets whose largest whole part is not below j can still change.
            going = ((least.reshape(sets, slots).max(1) >> np.uint64(32)) >= j)[owner]
            if not going.any():
                break
            some, owner = some[going], owner[going]
            order = _first_swap(some, draw, slots) if order is None else order[going]
        drawn = draw(some, j)
        place = j + ((drawn >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j:
            at = np.arange(len(some))
            chosen = order[at, place]
            order[at, place] = order[:, j]
            place = chosen.astype(np.int64)
        np.minimum.at(least, owner * slots + place, (drawn & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32))
    return least.reshape(sets, slots)


def _first_swap(some: np.ndarray, draw, slots: int) -> np.ndarray:
    """Each element's permutation after its first step."""
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(some), 1))
    place = ((draw(some, 0) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
    order[np.arange(len(some)), place] = 0
    return order


def _rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def signed_documents(docs: DataFrame, words: int) -> DataFrame:
    """doc, n (size of the set), a and b (digests of the set), signature (16 bits a slot)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            values, edges = shingles_of(texts_of(batch), words)
            marks = mixed(signatures_of(values, edges)).astype("<u2")
            sizes = np.diff(edges)
            sums = [np.append(np.uint64(0), np.cumsum(mixed(values ^ np.uint64(c)))) for c in (11, 29)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes), *(pa.array(signed(s[edges[1:]] - s[edges[:-1]])) for s in sums),
                 pa.array([m.tobytes() for m in marks], pa.binary())], ["doc", "n", "a", "b", "signature"])

    return _rows_of(docs).mapInArrow(sign, "doc long, n long, a long, b long, signature binary")


def _band_digests(marks: np.ndarray) -> np.ndarray:
    """A digest of each band's number and places."""
    bands = marks[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        key = mixed(key * np.uint64(GOLD) + bands[:, :, k])
    return key


def band_keys(classes: DataFrame) -> DataFrame:
    """(band, rep): a digest of each band of each class's signature."""
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _band_digests(np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, SLOTS))
            reps = np.repeat(batch.column("rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), pa.array(reps)], ["band", "rep"])

    return classes.select("rep", "signature").mapInArrow(bands, "band long, rep long")


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc may be wanted: all that are, and few others.

    Each wanted id marks one of many places, and bitmaps of the marked places are broadcast. They take 8 MB at most;
    with more ids more other rows pass, but a wanted one always does.
    """
    places = MARKS_PER_ID * wanted.count()
    places = min(MARK_BITS, 1 << max(0, places - 1).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(places))
    marks = wanted.groupBy(F.bitmap_bucket_number(place("rep")).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place("rep"))).alias("_marks"))
    at = F.bitmap_bit_position(place("doc"))
    byte = F.conv(F.hex(F.substring("_marks", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(place("doc"))).join(F.broadcast(marks), "_bucket")
            .filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, items): the sorted shingle digests of the wanted documents, dealt by document; of repeated rows, one.

    Texts stay where they are. Sets of the few documents that only seemed to be wanted go once they are dealt.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            values, edges = shingles_of(texts_of(batch), words)
            items = [values[a:b].astype("<u8").tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(items, pa.binary())], ["rep", "items"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (_likely(_rows_of(docs), wanted).mapInArrow(cut, "rep long, items binary").repartition(parts, "rep")
            .join(wanted, "rep", "left_semi").distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= percent * union.

    A pivot's set is copied once for each PAIRS_PER_COPY of its pairs, which spreads a frequent pivot over tasks.
    """
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_COPY).cast("int").alias("copies"))
    left = (sets.join(copies, sets.rep == copies.a).select("a", F.col("items").alias("left_items"),
                                                           F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")))
    dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    both = (dealt.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("right_items")), "b")
            .join(left, ["a", "copy"]).select("a", "b", "left_items", "right_items"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "left_items"):
            good = []
            for x, y in zip(batch.column("left_items").to_pylist(), batch.column("right_items").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(shared) and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(confirm, "a long, b long").distinct()


def _pivot_pairs(open_groups: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each group's pivot with the members of other components.

    First the member that meets most others over all bands, which copies of one text share with it more than with
    each other; later the foremost of those outside the group's largest component.
    """
    place = F.struct(F.col("met"), -F.col("rep"))
    best = open_groups.groupBy("band", "component").agg(
        F.count(F.lit(1)).alias("size"), F.max(place).alias("place"), F.max_by(F.struct("rep", "component", "n"), place).alias("p"))
    if turn:
        main = best.groupBy("band").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
        best = best.join(main, "band").filter("component <> main")
    pivots = best.groupBy("band").agg(F.max_by("p", "place").alias("p"))
    met = open_groups.join(pivots, "band").filter(F.col("component") != F.col("p.component"))
    return _plausible(met.select(F.col("p.rep").alias("a"), F.col("rep").alias("b"), F.col("p.n").alias("m"), "n"), percent)


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes alone do not rule the similarity out, once each with the smaller id first."""
    return (pairs.filter(100 * F.least("m", "n") >= percent * F.greatest("m", "n"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _long_signatures(open_groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, long): signatures of LONG places, 8 bits each, of the members of open groups, from their full sets."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A permutation of LONG places is held per shingle: few shingles at once.
        for batch in slices(batches, "items", 1 << 16):
            items = [np.frombuffer(x, "<u8") for x in batch.column("items").to_pylist()]
            edges = np.cumsum([0, *map(len, items)])
            marks = mixed(signatures_of(mixed(np.concatenate(items) ^ np.uint64(LONG)), edges, LONG)).astype("u1")
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([m.tobytes() for m in marks], pa.binary())],
                                             ["rep", "long"])

    return sets.join(open_groups.select("rep").distinct(), "rep", "left_semi").mapInArrow(sign, "rep long, long binary")


def _block_pairs(open_groups: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members in different components of a group whose long signatures agree enough.

    Members outside the group's largest component, in blocks, meet all members, in blocks; only pairs that pass
    leave a task, each in the first of the bands it shares.
    """
    sizes = open_groups.groupBy("band", "component").agg(F.count(F.lit(1)).alias("size"))
    groups = sizes.groupBy("band").agg(F.sum("size").alias("all"), F.max("size").alias("most"),
                                       F.max_by("component", F.struct("size", "component")).alias("main"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    marks = written(_long_signatures(open_groups, sets).join(classes.select("rep", "signature"), "rep"), "long")
    placed = (open_groups.join(groups, "band").join(marks, "rep")
              .withColumn("lefts", blocks(F.col("all") - F.col("most"))).withColumn("rights", blocks(F.col("all"))))
    own = lambda count: F.pmod(F.xxhash64("rep", "band"), count).cast("int")
    columns = ("band", "rep", "component", "n", F.substring("signature", 1, 2 * BANDS * ROWS).alias("signature"), "long")
    right = placed.select(*columns, F.lit(1).alias("side"), own(F.col("rights")).alias("right"),
                          F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left"))
    left = placed.filter(F.col("component") != F.col("main")).select(
        *columns, F.lit(0).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("right"), own(F.col("lefts")).alias("left"))
    # Two different items agree in 8 bits once in 256 times; that only adds to the agreement.
    least = int(np.floor(LONG * (percent / 100 - SLACK)))

    def compare(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        short = np.frombuffer(b"".join(group["signature"].to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
        long = np.frombuffer(b"".join(group["long"].to_pylist()), "u1").reshape(-1, LONG)
        bands = np.ascontiguousarray(short).view("<u8")  # a band's four places as one number
        rep, component, n = (group[c].to_numpy() for c in ("rep", "component", "n"))
        own = int(np.flatnonzero(signed(_band_digests(short[:1])[0]) == group["band"][0].as_py())[0])
        rights, a, b = np.flatnonzero(side == 1), [], []
        for i in np.flatnonzero(side == 0):
            hit = rights[component[rights] != component[i]]
            hit = hit[(100 * np.minimum(n[hit], n[i]) >= percent * np.maximum(n[hit], n[i]))]
            hit = hit[(bands[hit, :own] != bands[i, :own]).all(1)]
            hit = hit[(long[hit] == long[i]).sum(1) >= least]
            a.append(np.full(len(hit), i))
            b.append(hit)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": rep[a], "b": rep[b], "m": n[a], "n": n[b]},
                        pa.schema([(c, pa.int64()) for c in ("a", "b", "m", "n")]))

    met = right.unionByName(left).groupBy("band", "left", "right").applyInArrow(compare, "a long, b long, m long, n long")
    return _plausible(met, percent)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; component_id is the
    smallest doc_id reachable, and kept says whether that is the row's own. A null, empty or blank text has no
    shingles and is linked with nothing. A null doc_id sorts before all others and, in a component, makes
    component_id null. Repeated rows are all kept in the result with equal values. Rows that share an id but not
    a text follow their own text. An empty table gives an empty result.
    """
    marked = written(signed_documents(docs, words), "signatures")
    classes = written(marked.filter("n > 0").groupBy("n", "a", "b").agg(
        F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by("signature", "doc").alias("signature")), "classes")
    keys = band_keys(classes)
    shared = keys.groupBy("band").agg(F.min("rep").alias("l"), F.max("rep").alias("h")).filter("l <> h").select("band")
    members = written(keys.join(shared, "band").distinct(), "bands")
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("met"))
    met = members.join(sizes, "band").groupBy("rep").agg(F.sum("met").alias("met"))
    groups = written(members.join(met.join(classes.groupBy("rep").agg(F.max("n").alias("n")), "rep"), "rep"), "members")
    # Kept as dealt: neither side of a verification moves them all again.
    sets = shingle_sets(docs, groups.select("rep").distinct(), words).persist(StorageLevel.DISK_ONLY)
    found, tested, place = None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        named = groups.withColumn("component", F.col("rep")) if place is None else (
            groups.join(place.withColumnRenamed("node", "rep"), "rep", "left")
            .withColumn("component", F.coalesce("component", "rep")))
        unsettled = named.groupBy("band").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h").select("band")
        open_groups = written(named.join(unsettled, "band"), "open")
        pairs = _pivot_pairs(open_groups, turn, percent) if turn < PIVOT_ROUNDS else _block_pairs(open_groups, classes, sets, percent)
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            if turn < PIVOT_ROUNDS:
                continue
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = verified(pairs, sets, percent)
        found = written(fresh if found is None else found.unionByName(fresh), "found")
        place = components(found)
    sets.unpersist()
    label = classes.select(F.col("n").alias("n"), "a", "b", "rep", "copies")
    if place is not None:
        label = label.join(place.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        label = label.withColumn("component", F.lit(None).cast("long"))
    # Classes of one document without links need no join.
    label = label.filter("copies > 1 or component is not null").select("n", "a", "b", F.coalesce("component", "rep").alias("component"))
    result = marked.select("doc", "n", "a", "b").join(label, ["n", "a", "b"], "left").withColumn(
        "component", F.coalesce("component", "doc"))
    public = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return result.select(public("doc").alias("doc_id"), F.col("n").alias("n_shingles"), public("component").alias("component_id"),
                         (F.col("doc") == F.col("component")).alias("kept"))
