"""Leading directions of wide codes by randomised block subspace iteration.

The rows are packed once into blocks: the components a block holds, and its entries as places among them, compressed. The
directions have l numbers for each component, l a few more than were asked for, and are kept in tiles: one row for a
bounded range of components. A pass hands each group of blocks its components' part of the tiles, multiplies the blocks by it and
back, and adds the products up by tile: the directions times the codes' Gram matrix, which never exists itself. The
product is made orthonormal by a QR factorization of its rows, partition by partition and then of the factors in a
tree. Only l x l factors and sums reach the driver, whatever the number of components; numbers travel as bytes.

The mean of the rows is subtracted as a rank-one term of the product, so centred rows are never built. Codes of at most
``NARROW`` components skip the passes: their Gram matrix, of a bounded size, is summed and taken apart at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.packing import pressed, unpressed, unzipped, zipped
from lexiloom.session import checkpointed, released

NARROW = 512  # components whose Gram matrix (2 MB) is summed in one pass
OVERSAMPLE = 10  # directions carried beyond those asked for
PASSES = 20
TOLERANCE = 1e-7  # of a direction's residual, as a share of the first singular value squared
BLOCK_ENTRIES = 12_000_000
GROUP_ENTRIES = 30_000_000  # entries of blocks that are multiplied together
GROUP_TERMS = 500_000  # components such blocks may have, counted by block where there are more in all
PART_ENTRIES = 2_000_000  # entries of a block multiplied at once
BLOCK_TERMS = 250_000  # components from which on a block takes no more rows
PIECES = 32  # parts of a block after which its components are counted
TILE_CELLS = 125_000  # cells of a tile of directions (1 MB)
DENSE_CELLS = 4_000_000  # cells multiplied at once
FILL = 40  # cells for each entry up to which a block, or a component of it, is multiplied as a dense one
LOST = 1e-13  # share of the first singular value below which a direction of the product is rounding

FIELDS = {"terms": np.int64, "sizes": np.int32, "roots": np.float64}
# Entries are kept as the steps between a row's places, compressed, and whole values as whole numbers.
BLOCK = "block long, " + ", ".join(f"{name} binary" for name in FIELDS) + ", steps binary, values binary, whole boolean, entries long, mass double"
TILES = "tile long, components binary, w binary, mass binary"
WHOLE = -1  # the tile of sums over all components


@dataclass
class Leading:
    directions: DataFrame  # (component, w): components that no row holds are left out, as all zeros
    squares: np.ndarray  # squared singular values, descending
    shift: list[float]  # what the mean projects to, zeros without centring


def packed(weighted: DataFrame, keys: bool = False) -> DataFrame:
    """(count, features) in blocks, cut where the rows lie.

    With ``keys`` the blocks hold the rows' keys too.
    """
    sparse = weighted.schema["features"].dataType.typeName() == "struct"

    def block(number: int, rows: list[tuple], names: list[pa.Array], terms: np.ndarray) -> pa.RecordBatch:
        sizes, roots = (np.concatenate(x) for x in (list(zip(*rows))[0], list(zip(*rows))[3]))
        steps = np.concatenate([_steps(np.searchsorted(terms, index), n) for n, index, *_ in rows])
        whole = all(values.dtype != float for _, _, values, _ in rows)
        values = np.concatenate([values for _, _, values, _ in rows])
        cells = [*(_bytes(x.astype(kind)) for x, kind in zip((terms, sizes, roots), FIELDS.values())), pa.array([zipped(steps)], pa.binary()),
                 pa.array([zipped(values) if whole else pressed(values.astype(float).tobytes())], pa.binary())]
        columns = [pa.array([number]), *cells, pa.array([whole]), pa.array([len(steps)]), pa.array([(roots ** 2).sum()])]
        if keys:
            strings = pa.concat_arrays(names)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings))
        return pa.RecordBatch.from_arrays(columns, ["block", *FIELDS, "steps", "values", "whole", "entries", "mass", *["keys"] * keys])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, rows, names, held = TaskContext.get().partitionId() << 32, [], [], 0
        piece, terms = max(1, BLOCK_ENTRIES // PIECES), np.zeros(0, np.int64)
        for batch in batches:
            features = batch.column("features")
            lists = features.field("values") if sparse else features
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            inside = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            index = features.field("indices").flatten().to_numpy(zero_copy_only=False) if sparse else inside
            roots = np.sqrt(batch.column("count").to_numpy(zero_copy_only=False).astype(float))
            ends = np.cumsum(sizes, dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                start = int(ends[first - 1]) if first else 0
                room = min(piece, BLOCK_ENTRIES - held)
                last = max(first + 1, int(np.searchsorted(ends, start + room, "right")))
                stop = int(ends[last - 1])
                rows.append((sizes[first:last], index[start:stop], _whole(values[start:stop]), roots[first:last]))
                if keys:
                    names.append(batch.column("key").slice(first, last - first))
                held, first, terms = held + stop - start, last, np.union1d(terms, index[start:stop])
                full = first < batch.num_rows and held + sizes[first] > BLOCK_ENTRIES
                if full or held >= BLOCK_ENTRIES or len(terms) >= BLOCK_TERMS:
                    yield block(number, rows, names, terms)
                    number, rows, names, held, terms = number + 1, [], [], 0, terms[:0]
        if rows:
            yield block(number, rows, names, terms)

    return weighted.select(*["key"] * keys, "count", "features").mapInArrow(pack, BLOCK + ", keys array<string>" * keys)


def _steps(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The steps between the places of a row, which rise, from the first one on."""
    steps = np.diff(places, prepend=0)
    first = (np.cumsum(sizes, dtype=np.int64) - sizes)[sizes > 0]
    steps[first] = places[first]
    return steps.astype(np.int32)


def _whole(values: np.ndarray) -> np.ndarray:
    """Values as whole numbers of few bytes where all are such numbers."""
    small = values.astype(np.uint16) if len(values) and 0 <= values.min() and values.max() < 1 << 16 else None
    return small if small is not None and (small == values).all() else values


def _bytes(x: np.ndarray) -> pa.Array:
    """One cell that holds an array's bytes."""
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _row_blocks(sizes: np.ndarray, places: np.ndarray, values: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """A block's rows in dense pieces of bounded size."""
    step = max(1, DENSE_CELLS // max(width, 1))
    ends = np.append(0, np.cumsum(sizes))
    for first in range(0, len(sizes), step):
        last = min(first + step, len(sizes))
        span = slice(ends[first], ends[last])
        dense = np.zeros((last - first, width))
        dense[np.repeat(np.arange(last - first), sizes[first:last]), places[span]] = values[span]
        yield slice(first, last), dense


def _summed(keys: np.ndarray, n: int, factors: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Rows ``factors`` gives for some entries, summed by the entries' key, a bounded number of entries at a time."""
    out = np.zeros((n, width))
    order = np.argsort(keys, kind="stable")
    step = max(1, DENSE_CELLS // width)
    for at in range(0, len(order), step):
        some = order[at:at + step]
        own, first = np.unique(keys[some], return_index=True)
        out[own] += np.add.reduceat(factors(some), first, axis=0)
    return out


def times(sizes: np.ndarray, places: np.ndarray, values: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A block's rows times a matrix with a row per component of the block."""
    if len(sizes) * len(m) <= FILL * len(values):
        parts = [dense @ m for _, dense in _row_blocks(sizes, places, values, len(m))]
        return np.concatenate(parts) if parts else np.zeros((0, m.shape[1]))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return _summed(rows, len(sizes), lambda e: values[e, None] * m[places[e]], m.shape[1])


def product(sizes: np.ndarray, places: np.ndarray, values: np.ndarray, slice_: np.ndarray) -> np.ndarray:
    """A block's transpose times the block times its slice."""
    return products(sizes, places, values, np.zeros(len(sizes)), slice_)[0]


def products(sizes: np.ndarray, places: np.ndarray, values: np.ndarray, roots: np.ndarray,
             slice_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, and what goes beside it: the squares of the block times its slice, and the roots times that."""
    (width, l), n = slice_.shape, len(sizes)
    # Components in many of the rows are multiplied as dense ones, a few rows at a time, and the others by entry.
    often = np.bincount(places, minlength=width) * FILL >= n
    rows, dealt = np.repeat(np.arange(n), sizes), often[places]
    rare, their, factors = places[~dealt], rows[~dealt], values[~dealt, None]
    few = np.bincount(rows[dealt], minlength=n)
    across = _summed(their, n, lambda e: factors[e] * slice_[rare[e]], l)
    thick, inner = slice_[often], np.zeros((int(often.sum()), l))
    for span, dense in _row_blocks(few, (np.cumsum(often) - 1)[places[dealt]], values[dealt], len(thick)):
        across[span] += dense @ thick
        inner += dense.T @ across[span]
    out = _summed(rare, width, lambda e: factors[e] * across[their[e]], l)
    out[often] = inner
    return out, np.concatenate((across.T @ across, (roots @ across)[None]))


def uniforms(x: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each unsigned 64-bit number, by the published splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2 ** 53


def random_rows(components: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Normal numbers for each component that depend on its number and the seed only."""
    unit = uniforms(components.astype(np.uint64)[:, None] * np.uint64(2 * width) + np.arange(2 * width, dtype=np.uint64)
                    + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    return np.sqrt(-2 * np.log(unit[:, :width])) * np.cos(2 * np.pi * unit[:, width:])


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows, dtype=float).ravel()))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks_of(rows: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Block rows with their bytes as arrays; ``_parts_of`` gives the entries."""
    for part in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
        for i in range(part.num_rows):
            yield {"number": part.column("block")[i].as_py(), "row": i, "part": part,
                   **{name: np.frombuffer(part.column(name)[i].as_buffer(), kind) for name, kind in FIELDS.items()}}


def _parts_of(block: dict) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Which rows, their sizes, and the places and values of their entries; values are times the root of the row's count."""
    cell = lambda name: block["part"].column(name)[block["row"]].as_py()
    steps, sizes, roots = unzipped(cell("steps")), block["sizes"], block["roots"]
    values = unzipped(cell("values")) if cell("whole") else np.frombuffer(unpressed(cell("values")))
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PART_ENTRIES, "right")) - 1)
        own, span = sizes[first:last], slice(ends[first], ends[last])
        places = np.cumsum(steps[span], dtype=np.int64)
        before = np.append(0, places)[ends[first:last] - ends[first]]
        yield slice(first, last), own, places - np.repeat(before, own), values[span].astype(float) * np.repeat(roots[first:last], own)
        first = last


def _terms_of(blocks: list[dict]) -> np.ndarray:
    """All components of some blocks, ascending."""
    return np.unique(np.concatenate([block["terms"] for block in blocks] or [np.zeros(0, np.int64)]))


def _tile_row(number: int, components: np.ndarray, w: np.ndarray, mass: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number]), _bytes(components), _bytes(w), _bytes(mass)], ["tile", "components", "w", "mass"])


def _tile_rows(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            components, w, mass = (np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                                   for c, kind in (("components", np.int64), ("w", float), ("mass", float)))
            yield batch.column("tile")[i].as_py(), components, w.reshape(-1, width), mass


def _spans(terms: np.ndarray, tile: int) -> Iterator[tuple[int, slice]]:
    """The tiles that ascending components lie in, and where."""
    numbers = terms // tile
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], len(terms)]):
        yield int(numbers[start]), slice(start, stop)


class Blocks:
    """Packed rows dealt by group of blocks, kept on the executors' disks, to be multiplied by tables of directions.

    Blocks are cut where rows lie and may be small; those of a group have most components in common, which then travel
    once for all of them.
    """

    def __init__(self, matrix: DataFrame, width: int, blocks: int, components: int | None = None):
        self.width, self.tile = width, max(1, TILE_CELLS // width)
        tile, spark = self.tile, matrix.sparkSession
        entries, terms = matrix.agg(F.sum("entries"), F.sum(F.octet_length("terms") / 8)).first()
        few = components is not None and components <= GROUP_TERMS
        most = max(-(-(entries or 0) // GROUP_ENTRIES), 0 if few else -(-int(terms or 0) // GROUP_TERMS), spark.sparkContext.defaultParallelism)
        groups = max(1, min(blocks, most))
        # Twice as many partitions as groups, so that few tasks get several.
        self.parts = 2 * groups
        self.into = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    group = batch.column("group")[i].as_py()
                    found[group] = np.union1d(found.get(group, np.zeros(0, np.int64)), np.frombuffer(batch.column("terms")[i].as_buffer(), np.int64))
            for group, terms in found.items():
                for number, span in _spans(terms, tile):
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([group]), _bytes(terms[span])], ["tile", "group", "components"])

        # Blocks of a task and tasks take turns, so that groups are about equal.
        turn = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
        self.dealt = (matrix.withColumn("group", F.pmod(turn, F.lit(groups)).cast("long"))
                      .repartition(self.parts, "group").persist(StorageLevel.DISK_ONLY))
        self.wanted = checkpointed(self.dealt.select("group", "terms").mapInArrow(wanted, "tile long, group long, components binary"))

    def close(self) -> None:
        self.dealt.unpersist()

    def run(self, tiles: DataFrame, work: Callable[[list[dict], np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
        """What ``work(blocks, terms, v)`` gives for the blocks of a group, all their components, and these' part of the tiles."""
        width = self.width

        def hand_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A tile comes before the groups that want some of it.
            for batch in batches:
                for i in range(batch.num_rows):
                    components = np.frombuffer(batch.column("components")[i].as_buffer(), np.int64)
                    if batch.column("group")[i].as_py() < 0:
                        known, w = components, np.frombuffer(batch.column("w")[i].as_buffer()).reshape(-1, width)
                    else:
                        yield pa.RecordBatch.from_arrays([batch.column("group").slice(i, 1), batch.column("tile").slice(i, 1),
                                                          _bytes(w[np.searchsorted(known, components)])], ["slice", "tile", "w"])

        held = tiles.select("tile", F.lit(-1).cast("long").alias("group"), "components", "w")
        both = held.unionByName(self.wanted.withColumn("w", F.lit(None).cast("binary")))
        slices = (both.repartition(self.into, "tile").sortWithinPartitions("tile", "group")
                  .mapInArrow(hand_out, "slice long, tile long, w binary"))

        def meet(rows: pa.Table, own: pa.Table) -> pa.Table:
            order = np.argsort(own["tile"].to_numpy()).tolist()
            v = np.concatenate([np.frombuffer(own["w"][i].as_buffer()) for i in order] or [np.zeros(0)]).reshape(-1, width)
            blocks = list(_blocks_of(rows))
            return work(blocks, _terms_of(blocks), v)

        return self.dealt.groupBy("group").cogroup(slices.repartition(self.parts, "slice").groupBy("slice")).applyInArrow(meet, schema)

    def times_gram(self, tiles: DataFrame | None, seed: int) -> DataFrame:
        """Tiles of the directions times the Gram matrix, with the weighted column sums, and beside them as tile WHOLE
        the directions times their product and times the column sums.

        Without tiles the directions are random. Components that no row holds do not occur.
        """
        width, tile = self.width, self.tile

        def multiply(blocks: list[dict], terms: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            z, beside, mass = np.zeros(v.shape), np.zeros((width + 1, width)), np.zeros(len(v))
            for block in blocks:
                at = np.searchsorted(terms, block["terms"])
                near, roots = v[at], block["roots"]
                for span, sizes, places, values in _parts_of(block):
                    own, more = products(sizes, places, values, roots[span], near)
                    z[at] += own
                    beside += more
                    mass[at] += np.bincount(places, weights=values * np.repeat(roots[span], sizes), minlength=len(near))
            for number, span in _spans(terms, tile):
                yield _tile_row(number, terms[span], z[span], mass[span])
            yield _tile_row(WHOLE, np.arange(width + 1), beside, np.zeros(width + 1))

        if tiles is None:
            def begin(rows: pa.Table) -> pa.Table:
                blocks = list(_blocks_of(rows))
                terms = _terms_of(blocks)
                return pa.Table.from_batches(multiply(blocks, terms, random_rows(terms, width, seed)))

            parts = self.dealt.groupBy("group").applyInArrow(begin, TILES)
        else:
            parts = self.run(tiles, lambda *given: pa.Table.from_batches(multiply(*given)), TILES)

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for number, components, w, mass in _tile_rows(batches, width):
                if number != last:
                    if last is not None:
                        yield from total()
                    last, room = number, tile if number != WHOLE else width + 1
                    first = max(number, 0) * tile
                    z, sums, seen = np.zeros((room, width)), np.zeros(room), np.zeros(room, bool)

                    def total() -> Iterator[pa.RecordBatch]:
                        met = np.flatnonzero(seen)
                        yield _tile_row(last, met + first, z[met], sums[met])
                at = components - first
                z[at] += w
                sums[at] += mass
                seen[at] = True
            if last is not None:
                yield from total()

        return parts.repartition(self.into, "tile").sortWithinPartitions("tile").mapInArrow(add, TILES)


def _beside(tiles: DataFrame, width: int) -> np.ndarray:
    """The sums of tile WHOLE: v' z and below it v' mass."""
    rows = tiles.filter(F.col("tile") == WHOLE).toArrow()
    found = [w for *_, w, _ in _tile_rows(rows.to_batches(), width)]
    return found[0] if found else np.zeros((width + 1, width))


def _factors(products: DataFrame, width: int, towards: np.ndarray) -> np.ndarray:
    """R of the QR factorization of the centred product z - mass * towards."""
    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for *_, z, mass in _tile_rows(batches, width):
            r = np.linalg.qr(np.concatenate((r, z - mass[:, None] * towards)), mode="r")
        yield _factor_rows(r)

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield _factor_rows(_joined(pa.Table.from_batches(held), width))

    schema = "row array<double>"
    found = products.filter(F.col("tile") != WHOLE).mapInArrow(first, schema)
    parts = products.rdd.getNumPartitions()
    if parts > 16:  # factors meet in groups first
        found = found.repartition(int(np.ceil(np.sqrt(parts)))).mapInArrow(again, schema)
    return _joined(found.toArrow(), width)


def _factor_rows(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_lists(r)], ["row"])


def _joined(table: pa.Table, width: int) -> np.ndarray:
    r = _matrix(table["row"], width)
    return np.linalg.qr(r, mode="r") if len(r) else r


def _turned(products: DataFrame, width: int, towards: np.ndarray, by: np.ndarray) -> DataFrame:
    """Tiles of the centred product times a small matrix."""
    def turn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, components, z, mass in _tile_rows(batches, width):
            yield _tile_row(number, components, (z - mass[:, None] * towards) @ by, mass)

    return products.filter(F.col("tile") != WHOLE).mapInArrow(turn, TILES)


def _spread_out(tiles: DataFrame, width: int) -> DataFrame:
    """(component, w, mass) of tiles."""
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, components, w, mass in _tile_rows(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(components), _lists(w), pa.array(mass)], ["component", "w", "mass"])

    return tiles.mapInArrow(rows, "component long, w array<double>, mass double")


def multiplied(encoded: DataFrame, directions: DataFrame, k: int) -> DataFrame:
    """(key, features): codes times a table (component, w) of directions of any size; other components count nothing."""
    matrix = checkpointed(packed(encoded.withColumn("count", F.lit(1)), keys=True))
    blocks = Blocks(matrix, k, matrix.count())
    tile, schema = blocks.tile, "key string, features array<double>"

    def gather(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in rows:
            numbers, components = batch.column("tile").to_numpy(), batch.column("component").to_numpy()
            starts = np.flatnonzero(np.diff(numbers, prepend=-1))
            for start, stop in zip(starts, [*starts[1:], len(numbers)]):
                if numbers[start] != last and held:
                    yield whole(last, held)
                    held = []
                last = int(numbers[start])
                held.append((components[start:stop], _matrix(batch.column("w").slice(start, stop - start), k)))
        if held:
            yield whole(last, held)

    def whole(number: int, held: list[tuple]) -> pa.RecordBatch:
        """Every component of a tile, those without a direction with zeros."""
        w = np.zeros((tile, k))
        for components, some in held:
            w[components - number * tile] = some
        return _tile_row(number, np.arange(tile) + number * tile, w, np.zeros(0))

    given = directions.select(F.floor(F.col("component") / F.lit(tile)).cast("long").alias("tile"), "component", "w")
    # Tiles that blocks want but no direction lies in get a row of zeros too.
    asked = blocks.wanted.select("tile").distinct().join(given.select("tile").distinct(), "tile", "left_anti").select(
        "tile", (F.col("tile") * tile).alias("component"), F.array_repeat(F.lit(0.0), k).alias("w"))
    tiles = (given.unionByName(asked).repartition(blocks.into, "tile").sortWithinPartitions("tile", "component")
             .mapInArrow(gather, TILES))

    def code(packs: list[dict], terms: np.ndarray, v: np.ndarray) -> pa.Table:
        found = []
        for block in packs:
            near = v[np.searchsorted(terms, block["terms"])]
            codes = np.concatenate([times(sizes, places, values, near) for _, sizes, places, values in _parts_of(block)] or [np.zeros((0, k))])
            keys = block["part"].column("keys").slice(block["row"], 1).flatten()
            found.append(pa.table({"key": keys, "features": _lists(codes)}))
        return pa.concat_tables(found)

    found = checkpointed(blocks.run(tiles, code, schema))
    blocks.close()
    return found


def _sums(table: DataFrame, column: str, width: int) -> np.ndarray:
    """Sum over components of mass times the row."""
    if not width:
        return np.zeros(0)
    row = table.agg(*[F.sum(F.col(column)[j] * F.col("mass")).alias(f"s{j}") for j in range(width)]).first()
    return np.array([x or 0.0 for x in row])


def _signs(table: DataFrame, width: int) -> np.ndarray:
    """Sign of each direction's largest loading (the first component among equals)."""
    def largest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, components = _matrix(batch.column("w"), width), batch.column("component").to_numpy()
                order = np.argsort(components, kind="stable")
                at = order[np.abs(rows[order]).argmax(axis=0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width)), pa.array(np.abs(rows[at, np.arange(width)])), pa.array(-components[at]),
                     pa.array(rows[at, np.arange(width)])], ["j", "size", "before", "value"])

    rows = (table.select("component", "w").mapInArrow(largest, "j long, size double, before long, value double")
            .groupBy("j").agg(F.max(F.struct("size", "before", "value")).alias("top")).collect())
    out = np.ones(width)
    for row in rows:
        out[row["j"]] = -1.0 if row["top"]["value"] < 0 else 1.0
    return out


def _finished(directions: DataFrame, k: int, squares: np.ndarray, rows: float, centre: bool) -> Leading:
    """Signs set, and what the mean projects to."""
    kept = checkpointed(directions)
    sign = _signs(kept, k)
    signs = F.array(*[F.lit(float(s)) for s in sign])
    shift = _sums(kept, "w", k) * sign / rows if centre and rows else np.zeros(k)
    return Leading(kept.select("component", F.zip_with("w", signs, lambda x, s: x * s + F.lit(0.0)).alias("w")),
                   np.maximum(squares, 0), shift.tolist())


def _narrow(matrix: DataFrame, width: int, k: int, rows: float, centre: bool) -> Leading:
    """From the Gram matrix of a bounded number of components."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width + 1))
        for block in (r for b in batches for r in _blocks_of(b)):
            terms = block["terms"]
            inner = np.zeros((len(terms), len(terms) + 1))
            for rows_, sizes, places, values in _parts_of(block):
                for span, dense in _row_blocks(sizes, places, values, len(terms)):
                    inner[:, :-1] += dense.T @ dense
                    inner[:, -1] += dense.T @ block["roots"][rows_][span]
            gram[np.ix_(terms, terms)] += inner[:, :-1]
            gram[terms, -1] += inner[:, -1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), _lists(gram)], ["component", "row"])

    table = matrix.mapInArrow(add, "component long, row array<double>").groupBy("component").agg(
        *[F.sum(F.col("row")[j]).alias(f"g{j}") for j in range(width + 1)]).toArrow()
    gram = np.zeros((width, width + 1))
    gram[table["component"].to_numpy()] = np.stack([table[f"g{j}"].to_numpy() for j in range(width + 1)], axis=1).reshape(-1, width + 1)
    gram, mass = gram[:, :-1], gram[:, -1]
    if centre and rows:
        gram = gram - np.outer(mass, mass) / rows
    squares, vectors = np.linalg.eigh(gram)
    squares, vectors = squares[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * (squares > LOST * max(squares.max(initial=0), 1e-300))
    table = pa.table({"component": pa.array(np.arange(width)), "w": _lists(vectors), "mass": mass})
    return _finished(matrix.sparkSession.createDataFrame(table), k, squares, rows, centre)


def leading(weighted: DataFrame, width: int, k: int, centre: bool = False, seed: int = 35, narrow: int = NARROW,
            passes: int = PASSES, tolerance: float = TOLERANCE) -> Leading:
    """The k leading right singular vectors of the rows (count, features), a row counting ``count`` times.

    ``features`` is an array or a struct of indices and values; with ``centre`` the mean row is subtracted. Passes end
    when every direction's residual is at most ``tolerance`` of the first squared singular value. Where the rows have
    fewer than k directions, the rest are zeros. The result does not depend on how the rows are partitioned.
    """
    matrix = checkpointed(packed(weighted))
    count, rows = matrix.agg(F.count(F.lit(1)), F.coalesce(F.sum("mass"), F.lit(0.0))).first()
    if width <= narrow:
        return _narrow(matrix, width, k, rows, centre)
    wide, passes, tiles = k + OVERSAMPLE, max(2, passes), None
    blocks = Blocks(matrix, wide, count, width)
    for done in range(1, passes + 1):
        products = checkpointed(blocks.times_gram(tiles, seed))
        beside = _beside(products, wide)
        towards = beside[wide] / rows if centre and rows else np.zeros(wide)
        inner = beside[:wide] - np.outer(beside[wide], towards)
        r = _factors(products, wide, towards)
        _, sizes, right = np.linalg.svd(np.concatenate((r, np.zeros((wide - len(r), wide)))) if len(r) < wide else r)
        kept = sizes > LOST * max(sizes.max(initial=0), 1e-300)
        by = right.T * np.where(kept, 1 / np.where(kept, sizes, 1), 0)
        if done > 1:  # the directions are orthonormal from the second pass on
            squares, within = np.linalg.eigh((inner + inner.T) / 2)
            squares, within = squares[::-1], within[:, ::-1]
            residuals = np.sqrt(np.maximum(((r @ within) ** 2).sum(axis=0) - squares ** 2, 0))[:k]
            if done == passes or (residuals <= tolerance * max(squares[0], 0)).all():
                break
        tiles = _turned(products, wide, towards, by)
        released(matrix.sparkSession)
    # Directions of no length get no loadings. The last tiles are all that is still needed.
    blocks.close()
    del blocks, products
    released(matrix.sparkSession)
    within = within[:, :k] * (squares[:k] > LOST * max(squares[0], 1e-300))
    return _finished(_spread_out(_turned(tiles, wide, np.zeros(wide), within), k), k, squares[:k], rows, centre)
