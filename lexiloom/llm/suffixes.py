"""Removal of repeated passages by range-partitioned suffix sorting.

A byte goes if some string of LENGTH bytes covers it that also starts earlier in the corpus, in the order of
doc_id, then position. Every such string ("window") contains an anchor: the place of its least hashed GRAM-byte
string, the leftmost of equals. Windows that share an anchor form a unit, so two equal windows lie in units whose
suffixes at the anchor have the same first GRAM bytes. Three sorts find all of them:

1. Units: suffixes at anchors, keyed by their first bytes, the digest of the rest of the leading string, and
   the digest of all the unit's windows. A unit equal to an earlier one goes whole; of units that share the
   leading string but differ, one each is passed on.
2. Tiles: eight neighbouring windows of a unit share 93 bytes; with the seven bytes to either side their
   windows can be told apart within a bucket.
3. Windows: those of tiles at the rim of a bucket, whose equals may lie in the next.

Each sort deals its rows by sampled splitters into ranges (keys end with the position, so a frequent string is
spread over many), orders each range by multikey quicksort on 8-byte characters, and compares neighbours; the
last sort also compares each range's first row with the last row before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lexiloom.llm.common import Digests, joined, mixed, slices, texts_of, written
from lexiloom.llm.ngram_features import digest

LENGTH = 100
GRAM = 24
TILE = 8
SHARED = LENGTH - TILE + 1
REACH = LENGTH - GRAM + 1  # places of an anchor within a window
SAMPLE_BYTES = 8 << 20  # texts the splitters of a sort are sampled from
SAMPLE_PER_TEXT = 4096
ROWS_PER_RANGE = 300_000
ROWS_PER_DEAL = 400_000
NO_ID = -(1 << 63)

U8, U32, U64, I64, I32 = (np.dtype(x) for x in ("u1", "<u4", "<u8", "<i8", "<i4"))
PLACE = [("doc", I64), ("twin", I64), ("start", I32)]
UNIT = [("lead", U64), ("core", U32), ("unit", U64), *PLACE, ("span", U8), ("ahead", U8)]
TILES = [("lead", U64), ("core", U64), *PLACE, ("left", U64), ("right", U64), ("low", U8), ("high", U8)]
WINDOWS = [("lead", U64), ("core", U64), *PLACE]
FOUND = "kind int, doc long, twin long, start int, stop int, ahead int, rows binary, range int"

def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number that sorts as they do."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)


def units_of(texts: list[bytes], doc: np.ndarray, twin: np.ndarray) -> dict[str, np.ndarray]:
    """The units of the texts, as UNIT columns."""
    data, starts = joined(texts, 8)
    sizes = np.diff(starts) - 8
    empty = {name: np.zeros(0, kind) for name, kind in UNIT}
    if not len(texts) or sizes.max() < LENGTH:
        return empty
    digests = Digests(data)
    grams = digests.grams(GRAM)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if REACH > width:
        least = np.minimum(least[:width - REACH], least[REACH - width:])
    room = np.maximum(sizes - LENGTH + 1, 0)
    first = np.repeat(starts[:-1], room)
    window = first + np.arange(len(first)) - np.repeat(np.cumsum(room) - room, room)
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.diff(anchor, prepend=-1))
    low, high, anchor = window[begins], window[np.append(begins[1:], len(window)) - 1], anchor[begins]
    owner = np.searchsorted(starts, low, "right") - 1
    span, ahead = high - low, anchor - low
    unit = mixed(digests.of(low, high + LENGTH) + (ahead * 256 + span).astype(np.uint64))
    return {"lead": _eight(data, anchor), "core": grams[anchor].astype(U32), "unit": unit, "doc": doc[owner],
            "twin": twin[owner], "start": (low - starts[owner]).astype(I32), "span": span.astype(U8),
            "ahead": ahead.astype(U8)}


def tiles_of(text: bytes, doc: int, twin: int, start: np.ndarray, span: np.ndarray, ahead: np.ndarray) -> dict[str, np.ndarray]:
    """The tiles of some units of one text, as TILES columns; ``start`` is where the shared bytes begin."""
    data = np.frombuffer(bytes(8) + text + bytes(16), np.uint8)
    digests, anchor = Digests(data), start + ahead + 8
    first, last = (ahead - span) // TILE, ahead // TILE
    many = last - first + 1
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    low = np.maximum(np.repeat(ahead - span, many) - TILE * number, 0)
    high = np.minimum(np.repeat(ahead, many) - TILE * number, TILE - 1)
    core = np.repeat(anchor, many) - TILE * number
    n = len(core)
    return {"lead": _eight(data, core), "core": mixed(digests.of(core, core + SHARED) + number.astype(np.uint64)),
            "doc": np.full(n, doc, I64), "twin": np.full(n, twin, I64), "start": (core - 8).astype(I32),
            "left": _eight(data, core - 8), "right": _eight(data, core + SHARED),
            "low": low.astype(U8), "high": high.astype(U8)}


def windows_of(tiles: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The single windows of tiles, as WINDOWS columns."""
    parts = []
    for j in range(TILE):
        some = (tiles["low"] <= j) & (j <= tiles["high"])
        left, right = _edges(tiles, j)
        key = mixed(mixed(mixed(tiles["core"][some] + np.uint64(j)) + left[some]) ^ right[some])
        parts.append({"lead": mixed(tiles["lead"][some] ^ tiles["core"][some]), "core": key, "doc": tiles["doc"][some],
                      "twin": tiles["twin"][some], "start": tiles["start"][some] - I32.type(j)})
    return {name: np.concatenate([p[name] for p in parts]) for name, _ in WINDOWS}


def _edges(tiles: dict[str, np.ndarray], j: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a tile's j-th window before and behind what all its windows share."""
    return (tiles["left"] & np.uint64((1 << 8 * j) - 1),
            tiles["right"] >> np.uint64(8 * (j + 1)) if j < 7 else np.zeros_like(tiles["right"]))


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order by all keys, and for each key whether a row in that order begins a new value of it or of one before.

    Multikey quicksort: only rows that still tie are sorted by the next key, within their ties.
    """
    order = np.argsort(keys[0])
    fresh, steps = np.zeros(len(order), bool), []
    fresh[:1] = True
    for k, key in enumerate(keys):
        if k:
            run = np.cumsum(fresh)
            tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
            some = order[tied]
            order[tied] = some[np.lexsort((key[some], run[tied]))]
            fresh = fresh.copy()
        value = key[order]
        fresh[1:] |= value[1:] != value[:-1]
        steps.append(fresh)
    return order, steps


def _packed(columns: dict[str, np.ndarray], layout: list, rows: np.ndarray | slice) -> bytes:
    return b"".join(np.ascontiguousarray(columns[name][rows], kind).tobytes() for name, kind in layout)


def _unpacked(blobs: list[bytes], layout: list) -> dict[str, np.ndarray]:
    width = sum(kind.itemsize for _, kind in layout)
    parts: dict[str, list] = {name: [] for name, _ in layout}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, kind in layout:
            parts[name].append(np.frombuffer(blob, kind, n, at))
            at += n * kind.itemsize
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, kind) for name, kind in layout}


def range_of(columns: dict[str, np.ndarray], keys: list[str], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters (tuples by key, ascending) are at most each row's keys."""
    first = columns[keys[0]]
    low, high = (np.searchsorted(splitters[0], first, side) for side in ("left", "right"))
    open_rows = np.flatnonzero(low < high)  # their first key equals that of a splitter: search among those
    a, b = low[open_rows], high[open_rows]
    while len(open_rows) and (a < b).any():
        middle = (a + b) // 2
        at = np.minimum(middle, len(splitters[0]) - 1)
        less, equal = np.zeros(len(a), bool), np.ones(len(a), bool)
        for name, cut in zip(keys, splitters):
            value = columns[name][open_rows]
            less |= equal & (value < cut[at])
            equal &= value == cut[at]
        active = a < b
        b = np.where(active & less, middle, b)
        a = np.where(active & ~less, middle + 1, a)
    out = low.copy()
    out[open_rows] = a
    return out


def splitters_from(sample: DataFrame, layout: list, keys: list[str], ranges: int) -> list[np.ndarray]:
    """Evenly spaced keys of a sampled table of packed rows (its size is bounded by the sampling)."""
    columns = _unpacked([r.rows for r in sample.select("rows").toLocalIterator()], layout)
    order, _ = multikey_order([columns[k] for k in keys])
    if not len(order):
        return [np.zeros(0, columns[k].dtype) for k in keys]
    picks = order[(np.arange(1, ranges) * len(order)) // ranges]
    return [columns[k][picks] for k in keys]


def sort_ranges(rows: DataFrame, make: Callable, layout: list, keys: list[str], splitters: list[np.ndarray],
                judge: Callable, parts: int) -> DataFrame:
    """Deal the packed rows that ``make`` gives for each batch into ranges and let ``judge`` see each range sorted.

    ``judge`` gets the range's number, its columns in order and, for each key, where new values begin; what it
    yields are rows of FOUND.
    """
    names = [c.split()[0] for c in FOUND.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def give() -> pa.RecordBatch:
            columns = {name: np.concatenate([h[name] for h in held]) for name, _ in layout}
            at = range_of(columns, keys, splitters)
            order = np.argsort(at, kind="stable")
            numbers, firsts = np.unique(at[order], return_index=True)
            blobs = [_packed(columns, layout, order[a:b]) for a, b in zip(firsts, [*firsts[1:], len(order)])]
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["range", "rows"])

        for batch in batches:
            for columns in make(batch):
                held.append(columns)
                if sum(len(h["doc"]) for h in held) >= ROWS_PER_DEAL:
                    yield give()
                    held = []
        if held:
            yield give()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(number: int, blobs: list[bytes]) -> pa.RecordBatch:
            columns = _unpacked(blobs, layout)
            order, fresh = multikey_order([columns[k] for k in keys])
            # A place that occurs twice (a repeated row of the table) is looked at once.
            order = order[fresh[-1]]
            fresh = [f[fresh[-1]] for f in fresh]
            found = judge(number, {k: v[order] for k, v in columns.items()}, fresh)
            n = len(found["start"])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(found[c], t) if c in found else pa.nulls(n, t) for c, t in zip(names, kinds)], names)

        last, blobs = None, []
        for batch in batches:
            for number, blob in zip(batch.column("range").to_pylist(), batch.column("rows").to_pylist()):
                if number != last and blobs:
                    yield one(last, blobs)
                    blobs = []
                last = number
                blobs.append(blob)
        if blobs:
            yield one(last, blobs)

    dealt = rows.mapInArrow(deal, "range int, rows binary")
    return dealt.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(sort, FOUND)


SPAN, PENDING, OPEN, HEAD, TAIL = range(5)


def _spans(columns: dict[str, np.ndarray], rows: np.ndarray, kind: int) -> dict:
    return {"kind": np.full(len(rows), kind), "doc": columns["doc"][rows], "twin": columns["twin"][rows],
            "start": columns["start"][rows], "stop": columns["start"][rows] + columns["span"][rows].astype(I32) + I32.type(LENGTH),
            "ahead": columns["ahead"][rows].astype(I32)}


def judge_units(number: int, columns: dict[str, np.ndarray], fresh: list[np.ndarray]) -> dict:
    """Units equal to an earlier one go (SPAN); one each of those that share a leading string are PENDING, and so
    are those at the rim of the range, whose fellows may lie beyond it."""
    core, unit = fresh[1], fresh[2]
    run = np.cumsum(core) - 1
    different = np.bincount(run, weights=unit)
    rim = (run == 0) | (run == run[-1])
    spans = _spans(columns, np.flatnonzero(~unit), SPAN)
    pending = _spans(columns, np.flatnonzero(unit & (rim | (different[run] > 1))), PENDING)
    return {k: np.concatenate([spans[k], pending[k]]) for k in spans}


def judge_tiles(number: int, columns: dict[str, np.ndarray], fresh: list[np.ndarray]) -> dict:
    """Windows equal to an earlier one within the range go; tiles at its rim are given out whole (OPEN)."""
    run = np.cumsum(fresh[1]) - 1
    rim = (run == 0) | (run == run[-1])
    gone = np.zeros((TILE, len(run)), bool)
    alone = np.bincount(run)[run] == 1
    for j in range(TILE):
        some = np.flatnonzero(~rim & ~alone & (columns["low"] <= j) & (j <= columns["high"]))
        if not len(some):
            continue
        left, right = _edges({k: columns[k][some] for k in ("left", "right")}, j)
        # Rows come in the order of their places, which a stable sort by content keeps.
        order = np.lexsort((right, left, run[some]))
        same = np.zeros(len(some), bool)
        same[1:] = ((run[some][order][1:] == run[some][order][:-1]) & (left[order][1:] == left[order][:-1])
                    & (right[order][1:] == right[order][:-1]))
        gone[j, some[order[same]]] = True
    # Window j begins j bytes before the shared bytes: neighbouring j give one span.
    starts, stops, owners = [], [], []
    for j in range(TILE):
        head = gone[j] & ~(gone[j + 1] if j + 1 < TILE else np.zeros(len(run), bool))
        rows = np.flatnonzero(head)
        first = np.full(len(rows), j)
        for i in range(j - 1, -1, -1):
            reach = gone[i:j, rows].all(0)
            first[reach] = i
        starts.append(columns["start"][rows] - I32.type(j))
        stops.append(columns["start"][rows] - first.astype(I32) + I32.type(LENGTH))
        owners.append(rows)
    rows = np.concatenate(owners)
    out = {"kind": np.full(len(rows), SPAN), "doc": columns["doc"][rows], "twin": columns["twin"][rows],
           "start": np.concatenate(starts), "stop": np.concatenate(stops)}
    edge = np.flatnonzero(rim)
    blobs = [_packed(columns, TILES, edge[i:i + 4096]) for i in range(0, len(edge), 4096)]
    n = len(blobs)
    extra = {"kind": np.full(n, OPEN), "doc": np.zeros(n, I64), "twin": np.zeros(n, I64), "start": np.zeros(n, I32),
             "stop": np.zeros(n, I32)}
    return {k: np.concatenate([out[k], extra[k]]) for k in out} | {"rows": [None] * len(rows) + blobs}


def judge_windows(number: int, columns: dict[str, np.ndarray], fresh: list[np.ndarray]) -> dict:
    """Windows equal to the row before go; the first and last row are also given out for the next range."""
    same = np.flatnonzero(~fresh[1])
    n, ends = len(fresh[0]), np.array([0, len(fresh[0]) - 1])
    rows = np.concatenate([same, ends])
    blobs = [_packed(columns, WINDOWS, ends[i:i + 1]) for i in range(2)]
    return {"kind": np.array([SPAN] * len(same) + [HEAD, TAIL]), "doc": columns["doc"][rows], "twin": columns["twin"][rows],
            "start": columns["start"][rows], "stop": columns["start"][rows] + I32.type(LENGTH),
            "rows": [None] * len(same) + blobs, "range": np.full(len(rows), number)}


def across(found: DataFrame) -> DataFrame:
    """Spans of ranges' first rows that equal the last row before them; two rows a range are looked at."""
    content = F.substring("rows", 1, 16)
    before = Window.orderBy("range", "kind")
    heads = (found.filter(F.col("kind").isin(HEAD, TAIL))
             .withColumn("same", (content == F.lag(content).over(before)) & (F.lag("kind").over(before) == TAIL)
                         & (F.col("rows") != F.lag("rows").over(before))))
    return heads.filter((F.col("kind") == HEAD) & F.col("same")).select("doc", "twin", "start", "stop")


def _keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc, twin (tells texts of one id apart), text without nulls, and with ``carry`` all other columns in ``row``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = [F.struct(*rest, F.col("text").isNull().alias("_null_text")).alias("row")] if carry else []
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("twin"),
                       text.alias("text"), *row)


def _squeezed(keyed: DataFrame) -> DataFrame:
    """The texts compressed, as they are to cross a shuffle; other columns stay as they are."""
    at = keyed.columns.index("text")
    names = [*keyed.columns[:at], "squeezed", *keyed.columns[at + 1:]]
    fields = [f if f.name != "text" else StructField("squeezed", BinaryType()) for f in keyed.schema.fields]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text"):
            columns = list(batch.columns)
            columns[at] = pa.array([press.compress(x) for x in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return keyed.mapInArrow(squeeze, StructType(fields))


def _dealt(by_text: DataFrame) -> DataFrame:
    """A side that squeezed texts are joined with by shuffle, however small it is.

    A broadcast would leave the squeezing and the Python step behind the join in one stage, where each task needs two
    Python workers, and an executor keeps all that it ever started.
    """
    return by_text.hint("merge")


def _make_units(batch: pa.RecordBatch) -> Iterator[dict]:
    for part in slices([batch], "text", 1 << 19):  # some ten numbers of 8 bytes are held for each byte
        yield units_of(texts_of(part), part.column("doc").to_numpy(), part.column("twin").to_numpy())


def _make_tiles(batch: pa.RecordBatch) -> Iterator[dict]:
    spread = zstandard.ZstdDecompressor()
    for part in slices([batch], "squeezed", 1 << 20):
        made = []
        for row in part.to_pylist():
            start, stop, ahead = (np.array(row[c], np.int64) for c in ("starts", "stops", "aheads"))
            made.append(tiles_of(spread.decompress(row["squeezed"]), row["doc"], row["twin"], start,
                                 stop - start - LENGTH, ahead))
        yield {name: np.concatenate([m[name] for m in made]) for name, _ in TILES}


def _make_windows(batch: pa.RecordBatch) -> Iterator[dict]:
    for blob in batch.column("rows").to_pylist():
        yield windows_of(_unpacked([blob], TILES))


def _sample(rows: DataFrame, make: Callable, layout: list) -> DataFrame:
    """Packed rows of a sample, at most SAMPLE_PER_TEXT evenly spaced of each batch piece's texts."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for columns in make(batch.slice(i, 1)):
                    step = max(1, len(columns["doc"]) // SAMPLE_PER_TEXT)
                    yield pa.RecordBatch.from_arrays([pa.array([_packed(columns, layout, slice(None, None, step))], pa.binary())],
                                                     ["rows"])

    return rows.mapInArrow(pick, "rows binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, twin, start, stop): bytes of each text that windows cover which also start earlier; spans may overlap."""
    spark, keyed = docs.sparkSession, _keyed(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    chosen = digest(F.col("doc"), F.col("twin")) < share
    density = (REACH + 1) / 2  # bytes a unit takes on average

    def ranges(rows: float) -> tuple[int, int]:
        spread = max(parts, int(rows / ROWS_PER_RANGE))
        return 4 * spread, spread  # hashing puts about four ranges into a partition

    place = ["doc", "twin", "start"]  # part of every key, so that a frequent string is spread over ranges
    keys = ["lead", "core", "unit", *place]
    many, into = ranges(total / density)
    cuts = splitters_from(_sample(keyed.filter(chosen), _make_units, UNIT), UNIT, keys, many)
    units = written(sort_ranges(keyed, _make_units, UNIT, keys, cuts, judge_units, into), "units")
    pending = units.filter(F.col("kind") == PENDING)
    n_pending = pending.count()
    spans = [units.filter(F.col("kind") == SPAN).select("doc", "twin", "start", "stop")]

    by_text = (pending.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "stop", "ahead")).alias("units"))
               .select("doc", "twin", *(F.col(f"units.{c}").alias(f"{c}s") for c in ("start", "stop", "ahead"))))
    keys = ["lead", "core", *place]
    many, into = ranges(n_pending * (REACH / 2 / TILE + 1))
    some = _squeezed(keyed.filter(chosen)).join(_dealt(by_text.filter(chosen)), ["doc", "twin"])
    cuts = splitters_from(_sample(some, _make_tiles, TILES), TILES, keys, many)
    both = _squeezed(keyed).join(_dealt(by_text), ["doc", "twin"])
    tiles = written(sort_ranges(both, _make_tiles, TILES, keys, cuts, judge_tiles, into), "tiles")
    spans.append(tiles.filter(F.col("kind") == SPAN).select("doc", "twin", "start", "stop"))

    rim = tiles.filter(F.col("kind") == OPEN).select("rows")
    amount = rim.agg(F.sum(F.length("rows"))).first()[0] or 0
    many, into = ranges(amount / sum(k.itemsize for _, k in TILES) * TILE)
    rate = min(1.0, SAMPLE_BYTES / max(amount, 1))
    cuts = splitters_from(_sample(rim.filter(digest(F.col("rows")) < rate), _make_windows, WINDOWS), WINDOWS, keys, many)
    windows = written(sort_ranges(rim, _make_windows, WINDOWS, keys, cuts, judge_windows, into), "windows")
    spans.append(windows.filter(F.col("kind") == SPAN).select("doc", "twin", "start", "stop"))
    spans.append(across(windows))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _cut(docs: DataFrame, carry: bool) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept and, with ``carry``, row of every row of ``docs``."""
    spans = repeated_spans(docs)
    by_text = (spans.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
               .select("doc", "twin", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")))
    both = _squeezed(_keyed(docs, carry)).join(_dealt(by_text), ["doc", "twin"], "left").drop("twin")
    counts = [StructField(c, LongType()) for c in ("doc", "n_bytes", "n_removed", "n_spans")]
    fields = [*counts, StructField("kept", BinaryType()), *(f for f in both.schema.fields if f.name == "row")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = zstandard.ZstdDecompressor()
        for batch in slices(batches, "squeezed", 1 << 20):
            out: list[tuple] = []
            for squeezed, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("squeezed", "starts", "stops"))):
                text = spread.decompress(squeezed)
                edge = np.zeros(len(text) + 1, np.int64)
                if starts:
                    np.add.at(edge, np.array(starts), 1)
                    np.add.at(edge, np.array(stops), -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed, begun = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if removed else text
                if carry and removed:  # the texts of a table hold whole characters only
                    kept = kept.decode("utf-8", errors="ignore").encode()
                out.append((len(text), removed, begun, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds)), *([batch.column("row")] if carry else [])],
                [f.name for f in fields])

    return both.mapInArrow(cut, StructType(fields))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain) of every row of ``docs``.

    A null text counts as empty. Texts shorter than LENGTH bytes keep everything. A null doc_id comes before all
    others. Rows with the same id and text are one document and get the same result; rows with the same id and
    different texts are different documents, in the order of a digest. An empty table gives an empty result.
    """
    return _cut(docs, False).select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, its texts without their repeated bytes and ``n_chars``, if there, counted anew.

    Bytes of a character that lost some of its bytes go too. A null text stays null; a text that is repeated
    throughout stays as an empty one.
    """
    text = F.when(~F.col("row._null_text"), F.col("kept").cast("string"))
    made = _cut(docs, True).withColumn("text", text)
    counted = lambda c: F.length("text").cast(docs.schema[c].dataType).alias(c)
    return made.select(*(F.col("text") if c == "text" else counted(c) if c == "n_chars" else F.col(f"row.`{c}`")
                         for c in docs.columns))
