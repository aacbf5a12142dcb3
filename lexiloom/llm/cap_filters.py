"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

Unit vectors are rotated at random and cut into BLOCKS blocks; each block has its own random code words, and a
filter direction is one choice of a code word per block, so that few words name very many directions. A vector
passes every filter on whose direction it exceeds its threshold, found by list decoding: the best sums over the
two halves of the blocks are ranked, and only pairs of ranks that can reach the threshold are added up. Vectors
that pass the same filter are compared by cosine in double precision. How many filters a vector passes is found
by trial for each number of code words, so that the chance of two vectors at the asked cosine to share none stays
under MISSED however many vectors there are.

Vectors meet in groups by the first code word of a filter, or by a range of the second one too where groups would
be large, and are compared only where the whole filter agrees. What travels to a group is a vector's sketch, a byte
for each coordinate, with the length of what it leaves out, which bounds how far a cosine of sketches is off: pairs
that are sure to reach the asked cosine are linked by it, those that are sure not to are dropped, and only the pairs
between meet as whole vectors. The sketches and filters a task has for a group travel as one row of bytes. Groups that
a share of the vectors shows to be large are cut into blocks that meet pairwise, so that a crowded direction is spread
over tasks. Equal vectors form a class of which one is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import mixed, trim, written
from lexiloom.llm.components import components

BLOCKS = 4
BLOCK_LENGTH = 16  # coordinates of a block at least, which shorter vectors fill with zeros: few leave too few directions
FILTERS = 64  # passed by each vector at least
MISSED = 0.001  # chance at most that two vectors at the asked cosine share no filter
TRIED = 16_384  # pairs it is found by
FILTERS_PER_ROW = 16  # filters there are, for each vector of one length
MEMBERS = 1 << 18  # vectors of a group's block
MEMBER_CELLS = 1 << 24  # coordinates of a group's block
COUNTED = 8_192  # vectors of a length whose filters tell how large groups are
DEALT = 16_384  # vectors whose filters become one row of bytes for each group
DEALT_BYTES = 4 << 20  # of such rows sent at once
CELLS_AT_ONCE = 1 << 19  # coordinates multiplied at once
RUN = 256  # vectors of one filter from which on they are compared in parts
PAIRS_AT_ONCE = 1 << 21
NO_ID = -(1 << 63)


@dataclass
class Code:
    """The filters for vectors of one length."""

    rotation: np.ndarray
    words: np.ndarray  # block x word x coordinate
    filters: int  # passed by each vector

    def decode(self, unit: np.ndarray, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """First and second halves of the filters each row passes, best first if ``ordered``: those on which it scores at
        least its threshold, which is its own ``filters``-th best score, so that no direction is left with too few.

        The k-th best sum of two lists is made of an i-th best of one and a j-th best of the other with i * j <= k,
        so only those are looked at, for the halves as for the words of a half.
        """
        size, many = self.words.shape[2], self.words.shape[1]
        turned = np.zeros((len(unit), BLOCKS * size))
        turned[:, :unit.shape[1]] = unit
        turned = turned @ self.rotation
        scores = [turned[:, b * size:(b + 1) * size] @ self.words[b].T for b in range(BLOCKS)]
        best = min(self.filters, many * many)
        halves = []
        for b in (0, 2):
            (own, at), (other, beside) = (_ranked(scores[x], many) for x in (b, b + 1))
            i, j = _ranks(many, best)
            top, place = _ranked(own[:, i] + other[:, j], best)
            halves.append((top, np.take_along_axis(at, i[place], 1) * many + np.take_along_axis(beside, j[place], 1)))
        i, j = _ranks(best, self.filters)
        total = halves[0][0][:, i] + halves[1][0][:, j]
        keep = _ranked(total, self.filters)[1] if ordered else np.argpartition(-total, self.filters - 1, axis=1)[:, :self.filters]
        return np.take_along_axis(halves[0][1], i[keep], 1), np.take_along_axis(halves[1][1], j[keep], 1)


def _ranked(values: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The best values of each row, falling, and where they are."""
    if best < values.shape[1]:
        top = np.argpartition(-values, best - 1, axis=1)[:, :best]
        found = np.take_along_axis(values, top, 1)
        order = np.argsort(-found, axis=1)
        return np.take_along_axis(found, order, 1), np.take_along_axis(top, order, 1)
    order = np.argsort(-values, axis=1)
    return np.take_along_axis(values, order, 1), order


@lru_cache(maxsize=32)
def _ranks(most: int, product: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ranks (from 0) of two falling lists that the best ``product`` sums are among."""
    rank = np.arange(1, most + 1)
    i = np.repeat(rank, np.minimum(most, product // rank))
    j = np.concatenate([np.arange(min(most, product // r)) for r in rank.tolist()])
    return i - 1, j


@lru_cache(maxsize=8)
def code_for(length: int, words: int, filters: int = FILTERS) -> Code:
    rng, size = np.random.default_rng(977 + length), max(BLOCK_LENGTH, -(-length // BLOCKS))
    rotation, _ = np.linalg.qr(rng.normal(size=(BLOCKS * size, BLOCKS * size)))
    drawn = rng.normal(size=(BLOCKS, words, size))
    drawn *= np.sqrt(size) / np.linalg.norm(drawn, axis=2, keepdims=True)
    return Code(rotation, drawn, filters)


def code_words(rows: int) -> int:
    """Code words a block has for so many vectors of one length: enough for FILTERS_PER_ROW filters a vector."""
    return max(8, int(np.ceil((FILTERS_PER_ROW * rows) ** (1 / BLOCKS))))


def pairs_at(cosine: float, length: int, many: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors with this cosine; the length is 2 at least."""
    x, y = np.random.default_rng(seed).normal(size=(2, many, length))
    x = _unit(x)
    y = _unit(y - (x * y).sum(1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y


def ranks_shared(code: Code, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many filters both of each pair have to pass to share one; 0 if they share none of those of the code."""
    many, out = code.words.shape[1], np.zeros(len(x), int)
    for begin in range(0, len(x), 256):
        passed = []
        for rows in (x, y):
            first, second = code.decode(rows[begin:begin + 256])
            passed.append(first.astype(np.int64) * many * many + second)
        for k, (a, b) in enumerate(zip(*passed), begin):
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            if len(i):
                out[k] = np.maximum(i, j).min() + 1
    return out


def filters_for(length: int, words: int, least: float) -> int:
    """How many filters a vector passes, so that of two at cosine ``least`` at most MISSED share none.

    Of the tried pairs only a quarter of that share may miss, so that the true one is seldom above it.
    """
    if length < 2:
        return FILTERS  # two directions only
    x, y = pairs_at(least, length, TRIED, 31 + length)
    need, open_, filters = np.zeros(TRIED, int), np.arange(TRIED), FILTERS
    spare = int(MISSED * TRIED / 4)
    while len(open_) > spare:
        filters = min(2 * filters, words ** BLOCKS)
        need[open_] = ranks_shared(code_for(length, words, filters), x[open_], y[open_])
        open_ = np.flatnonzero(need == 0)
    need[open_] = words ** BLOCKS
    return max(FILTERS, int(np.sort(need)[TRIED - 1 - spare]))


@dataclass(frozen=True)
class Shape:
    """How vectors of one length are filtered and dealt to groups."""

    rows: int
    words: int
    filters: int
    parts: int  # ranges of the second code word in a group's key
    members: int  # of a group's block

    def keys(self, first: np.ndarray) -> np.ndarray:
        """A group for each first half."""
        return first // self.words * self.parts + first % self.words * self.parts // self.words


def shape_for(length: int, rows: int, least: float) -> Shape:
    """Groups by the first code word only, or by as many ranges of the second as leave them about MEMBERS vectors."""
    words = code_words(rows)
    filters = filters_for(length, words, least)
    members = max(1, min(MEMBERS, MEMBER_CELLS // max(length, 1)))
    x = _unit(np.random.default_rng(53 + length).normal(size=(256, max(length, 1))))
    first, _ = code_for(length, words, filters).decode(x, ordered=False)
    parts = 0
    while parts < words:
        parts = min(words, max(1, 2 * parts))
        shape = Shape(rows, words, filters, parts, members)
        keys = np.sort(shape.keys(first), axis=1)
        copies = 1 + (np.diff(keys, axis=1) > 0).sum(axis=1).mean()
        if rows * copies / (words * parts) <= members * 2 / 3:
            break
    return shape


def shapes_for(classes: DataFrame, least: float) -> dict[int, Shape]:
    """The shape for each length of which there are two vectors or more."""
    wanted = [(r["length"], r["count"]) for r in classes.groupBy("length").count().filter("count > 1").orderBy("length").collect()]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [wanted[i] for i in batch.column("id").to_pylist()]
            found = [(length, shape_for(length, rows, least)) for length, rows in some]
            if found:
                rows = [(length, s.rows, s.words, s.filters, s.parts, s.members) for length, s in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    if not wanted:
        return {}
    names = ["length", "rows", "words", "filters", "parts", "members"]
    tried = classes.sparkSession.range(0, len(wanted), 1, len(wanted)).mapInArrow(decide, ", ".join(f"{c} long" for c in names))
    return {r["length"]: Shape(*r[1:]) for r in tried.collect()}


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector): each vector as bytes, null where it has no direction: null, zero, or a null or non-finite component.

    Equal vectors have equal bytes and others do not: negative zeros are made positive. The first byte is the size of a
    component: four where all of them are the same as single ones, else eight.
    """
    for batch in batches:
        lists = batch.column("vector")
        sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(float) + 0.0
        ends = np.append(0, np.cumsum(sizes))
        out: list[bytes | None] = [None] * len(sizes)
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            step = max(1, DEALT * 64 // size)
            for at in range(0, len(own), step):
                some = own[at:at + step]
                rows = values[ends[some][:, None] + np.arange(size)]
                good = np.isfinite(rows).all(1) & rows.any(1)
                with np.errstate(over="ignore"):
                    short = rows.astype("<f4")
                single = (short == rows).all(1)
                for i, ok, one, x, y in zip(some.tolist(), good.tolist(), single.tolist(), short, rows):
                    if ok:
                        out[i] = b"\4" + x.tobytes() if one else b"\10" + y.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vector"])
    trim()


def length_of(vector: Column) -> Column:
    size = F.conv(F.hex(F.substring(vector, 1, 1)), 16, 10).cast("int")
    return ((F.octet_length(vector) - 1) / size).cast("int")


def _rows(vectors: list[bytes]) -> np.ndarray:
    """Vectors of one length."""
    return np.stack([np.frombuffer(x, "<f4" if x[0] == 4 else "<f8", offset=1) for x in vectors]).astype(float)


def sketches(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A byte for each coordinate, what a row's bytes are multiplied by, and the length of the difference at most."""
    scale = (np.abs(unit).max(1) / 127).astype(np.float32)
    bytes_ = np.rint(unit / scale[:, None]).clip(-127, 127).astype(np.int8)
    missed = unit - bytes_ * scale[:, None].astype(float)
    return bytes_, scale, (np.sqrt((missed * missed).sum(1)) * (1 + 1e-6) + 1e-12).astype(np.float32) * np.float32(1 + 1e-6)


MET = ("length int, key int, low int, high int, side int, class binary, rep binary, sketch binary, scale binary, missed binary, "
       "sizes binary, words binary, seconds binary")


def by_key(classes: DataFrame, shapes: dict[int, Shape], work, schema: str) -> DataFrame:
    """What ``work(length, shape, batch rows, unit rows, member, key, word, second)`` yields, the last four having an element
    for each filter a vector passes, sorted by key and then by member."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                if length not in shapes:
                    continue
                shape, own = shapes[length], np.flatnonzero(lengths == length)
                code = code_for(length, shape.words, shape.filters)
                for at in range(0, len(own), DEALT):
                    rows = batch.take(pa.array(own[at:at + DEALT]))
                    unit = _unit(_rows(rows.column("vector").to_pylist()))
                    found = [code.decode(unit[i:i + 256], ordered=False) for i in range(0, len(unit), 256)]
                    first, second = (np.concatenate(x).astype(np.int32).ravel() for x in zip(*found))
                    key = shape.keys(first)
                    member = np.repeat(np.arange(len(unit), dtype=np.int32), shape.filters)
                    order = np.argsort(key.astype(np.int64) << 32 | np.arange(len(key)))
                    yield from work(length, shape, rows, unit, member[order], key[order], (first % shape.words)[order], second[order])
        trim()

    return classes.select("class", "rep", "length", "vector").mapInArrow(decode, schema)


def crowded(classes: DataFrame, shapes: dict[int, Shape]) -> dict[tuple[int, int], int]:
    """Blocks of the groups that a share of the vectors shows to have more members than a block; others have one."""
    every = {length: max(1, shape.rows // COUNTED) for length, shape in shapes.items()}
    if all(shape.rows <= shape.members for shape in shapes.values()):
        return {}
    share = F.lit(1)
    for length, n in every.items():
        share = F.when(F.col("length") == length, n).otherwise(share)

    def count(length, shape, rows, unit, member, key, word, second):
        new = np.append(True, (np.diff(member) != 0) | (np.diff(key) != 0))
        found, n = np.unique(key[new], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), length, np.int32)), pa.array(found.astype(np.int32)),
                                          pa.array(n * every[length])], ["length", "key", "n"])

    some = classes.filter(F.pmod(F.xxhash64("class"), share) == 0)
    found = by_key(some, shapes, count, "length int, key int, n long").groupBy("length", "key").agg(F.sum("n").alias("n"))
    least = min(shape.members for shape in shapes.values())
    return {(r["length"], r["key"]): -(-r["n"] // shapes[r["length"]].members) for r in found.filter(F.col("n") > least).collect()}


def filtered(classes: DataFrame, shapes: dict[int, Shape], blocks: dict[tuple[int, int], int]) -> DataFrame:
    """MET: for each group, pair of its blocks and side, the vectors some task deals to it and the filters they pass there."""
    def deal(length, shape, rows, unit, member, key, word, second):
        numbers, reps = (rows.column(c).to_numpy() for c in ("class", "rep"))
        bytes_, scale, missed = sketches(unit)
        dealt = mixed(numbers.astype(np.uint64))
        few, many = np.min_scalar_type(shape.words - 1), np.min_scalar_type(shape.words ** 2 - 1)
        ends = np.append(np.flatnonzero(np.append(True, np.diff(key) != 0)), len(key))
        held, amount = [], 0
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            n = blocks.get((length, int(key[begin])), 1)
            inside = member[begin:end]
            block = (dealt[inside] % np.uint64(n)).astype(np.int64) if n > 1 else np.zeros(len(inside), np.int64)
            for o in np.unique(block).tolist():
                own = np.flatnonzero(block == o) + begin
                # By code word within a member, so that the words compress.
                own = own[np.lexsort((word[own], member[own]))]
                who, sizes = np.unique(member[own], return_counts=True)
                cells = [x.tobytes() for x in (numbers[who], reps[who], bytes_[who], scale[who], missed[who], sizes.astype("<u4"),
                                               word[own].astype(few), second[own].astype(many))]
                # Block k meets itself and all others; of two blocks the lower number is side 0.
                for other in range(n):
                    held.append((length, int(key[begin]), min(o, other), max(o, other), int(o > other), *cells))
                    amount += sum(map(len, cells))
                    if amount >= DEALT_BYTES:
                        yield _met(held)
                        held, amount = [], 0
        if held:
            yield _met(held)

    return by_key(classes, shapes, deal, MET)


FIELDS = [x.split()[0] for x in MET.split(", ")]


def _met(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 5 + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], FIELDS)


def _runs(filters: np.ndarray, member: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Members that share a filter: for each number of them, all members in order of their filters, and where runs begin."""
    bits = max(1, len(side).bit_length())
    packed = filters.astype(np.uint64)
    packed <<= np.uint64(bits)
    packed |= member
    packed.sort()
    member = (packed & np.uint64((1 << bits) - 1)).astype(np.int32)
    packed >>= np.uint64(bits)
    starts = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    sizes = np.diff(np.append(starts, len(packed)))
    del packed
    wanted = sizes > 1
    if side.any():  # only runs with both sides
        other = np.add.reduceat(side[member].astype(np.int64), starts)
        wanted &= (other > 0) & (other < sizes)
    starts, sizes = starts[wanted], sizes[wanted]
    order = np.argsort(sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    for size in np.unique(sizes).tolist():
        first, last = np.searchsorted(sizes, (size, size + 1))
        yield size, member, starts[first:last]


def _hits(near: np.ndarray, lowest: float, size: int, member: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of the same run whose sketches' product is at least this, the later one first (others too)."""
    length = near.shape[1]
    if size <= RUN:
        step = max(1, CELLS_AT_ONCE // (size * max(size, length)))
        for at in range(0, len(starts), step):
            run = member[starts[at:at + step, None] + np.arange(size)]
            some = near[run]
            products = (some @ some.transpose(0, 2, 1)).reshape(len(run), -1)
            products[:, ::size + 1] = -2
            found = np.flatnonzero(products.ravel() >= lowest)
            which, cell = np.divmod(found, size * size)
            yield run[which, cell // size], run[which, cell % size]
        return
    for start in starts.tolist():
        run = member[start:start + size]
        for at in range(0, size, RUN):
            some = near[run[at:at + RUN]]
            for beside in range(at, size, 16 * RUN):
                others = run[beside:beside + 16 * RUN]
                i, j = np.nonzero(some @ near[others].T >= lowest)
                yield others[j], run[at + i]


def _compared(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {name: [] for name in FIELDS}
        for batch in batches:
            for name in FIELDS:
                parts[name] += batch.column(name).to_pylist()
        length, sizes = parts["length"][0], [np.frombuffer(x, "<u4") for x in parts["sizes"]]
        side = np.repeat(parts["side"], [len(x) for x in sizes]).astype(np.int8)
        if len(side) < 2:
            return
        sizes = np.concatenate(sizes)
        column = lambda name, kind: np.frombuffer(b"".join(parts.pop(name)), kind)
        numbers, reps, scale, missed = (column(*x) for x in (("class", "<i8"), ("rep", "<i8"), ("scale", "<f4"), ("missed", "<f4")))
        near = column("sketch", np.int8).reshape(-1, length) * scale[:, None]
        entries = int(sizes.sum())
        words, seconds = (np.frombuffer(x, f"<u{len(x) // entries}") for x in (b"".join(parts.pop(c)) for c in ("words", "seconds")))
        # Code words are few, so that a filter and a member fit into 64 bits together.
        many = int(seconds.max()) + 1
        filters = words.astype(np.min_scalar_type((int(words.max()) + 1) * many)) * many + seconds
        del words, seconds, batch
        slack = (length + 4) * 2.0 ** -22
        most = float(missed.max())
        lowest = least - most * (2 + most) - slack

        def settled(codes: np.ndarray) -> pa.RecordBatch:
            """Pairs that reach the cosine, or may reach it: with the vectors' classes then."""
            x, y = codes // len(side), codes % len(side)
            product = np.concatenate([np.einsum("ij,ij->i", near[x[i:i + 65536]], near[y[i:i + 65536]]) for i in range(0, len(x), 65536)]
                                     or [np.zeros(0, np.float32)])
            off = missed[x].astype(float) + missed[y] + missed[x].astype(float) * missed[y] + slack
            keep = product >= least - off
            x, y, product, off = x[keep], y[keep], product[keep], off[keep]
            sure = product >= least + off
            a, b = numbers[x], numbers[y]
            ends = [pa.array(np.minimum(reps[x], reps[y])), pa.array(np.maximum(reps[x], reps[y]))]
            return pa.RecordBatch.from_arrays(ends + [pa.array(c, mask=sure) for c in (np.minimum(a, b), np.maximum(a, b))],
                                              ["a", "b", "class_a", "class_b"])

        def told() -> np.ndarray:
            codes = np.sort(np.concatenate(waiting))
            return codes[np.append(True, codes[1:] != codes[:-1])]

        waiting, amount = [], 0
        for size, member, starts in _runs(filters, np.repeat(np.arange(len(side), dtype=np.uint32), sizes), side):
            for x, y in _hits(near, lowest, size, member, starts):
                ahead = x > y
                if side.any():
                    ahead &= side[x] != side[y]
                waiting.append(x[ahead].astype(np.int64) * len(side) + y[ahead])
                amount += len(waiting[-1])
                if amount >= PAIRS_AT_ONCE:
                    # A pair may share several filters of this group; it is told once if they are at hand together.
                    waiting = [told()]
                    amount = len(waiting[0])
                    if amount >= PAIRS_AT_ONCE // 2:
                        yield settled(waiting[0])
                        waiting, amount = [], 0
        if amount:
            yield settled(told())
        trim()

    return compare


def links_of(classes: DataFrame, least: float) -> DataFrame:
    """Links (a, b), a <= b, between classes with cosine of at least ``least`` that share a filter."""
    shapes = shapes_for(classes, least)
    # As many partitions as leave most groups one of their own.
    groups, rows = sum(s.words * s.parts for s in shapes.values()), sum(s.rows for s in shapes.values())
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * groups, rows // 2048))
    passed = filtered(classes, shapes, crowded(classes, shapes)).repartition(parts, "length", "key", "low", "high")
    met = passed.groupBy("length", "key", "low", "high").applyInArrow(_compared(least), "a long, b long, class_a long, class_b long")
    found = written(met.distinct(), "pairs")
    open_ = found.filter("class_a IS NOT NULL")
    sure = found.filter("class_a IS NULL").select("a", "b")
    if open_.isEmpty():
        return sure
    vector = classes.select("class", "vector")
    both = (open_.join(vector.select(F.col("class").alias("class_a"), F.col("vector").alias("x")), "class_a")
            .join(vector.select(F.col("class").alias("class_b"), F.col("vector").alias("y")), "class_b"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            good = [bool((_unit(_rows([p])) * _unit(_rows([q]))).sum() >= least) for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return sure.unionByName(both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")).distinct()


def near_vectors(table: DataFrame, vector: str = "embedding", key: str = "vec_id", least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors with cosine of at least ``least`` are linked if they pass a common filter, which those at ``least``
    miss with a chance of at most MISSED; n_links counts the linked other rows, equal vectors included. A vector that is null or zero or holds
    a null or non-finite component links with nothing, nor do vectors of different length. A null id comes before
    all others. Repeated rows are different rows with the same id and link with each other; they count. An empty
    table gives an empty result. Other columns are ignored.
    """
    rows = table.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"),
                        F.col(vector).cast("array<double>").alias("vector")).mapInArrow(coded, "id long, vector binary")
    grouped = rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("class"), "rep", "copies",
                                     length_of(F.col("vector")).alias("length"), "vector"), "vectors")
    links = written(links_of(classes, least), "links")
    place = components(links).withColumnRenamed("node", "rep")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = classes.groupBy("rep").agg(F.sum("copies").alias("copies"))
    # Links are dealt by both ends before they are summed, so a crowded class meets no single task.
    linked = both.join(weight.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    digest = F.unhex(F.md5("vector")).alias("digest")
    label = (classes.select("rep", "copies", digest).join(linked.withColumnRenamed("a", "rep"), "rep", "left").join(place, "rep", "left")
             .select("digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component"))
             .filter("n_links > 0"))
    # A vector without a direction has no digest and meets nothing.
    found = (rows.select("id", digest).join(label, "digest", "left")
             .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component")))
    public = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return found.select(public("id").alias("vec_id"), "n_links", public("component").alias("component_id"),
                                          (F.col("id") == F.col("component")).alias("kept"))

