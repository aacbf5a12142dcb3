"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses, in SQL functions only.

Blank lines part sections, line ends part paragraphs, and a paragraph's leaves are its clauses (cut after
``. ! ? , ; : |`` and white space). A leaf's digest is the first 8 hex digits of its SHA-256; a paragraph
hashes its leaves' digests, a section its paragraphs, and the root its sections. A fingerprint is the root
followed by all leaf digests with the tree's shape, ``root#leaf,leaf;leaf/leaf``, where ``;`` parts paragraphs
and ``/`` sections. Any inner node follows from the digests below it, so equal branches are equal substrings:
roots test equality, and ``edits`` names the paragraphs of differing branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 8
MOST_RANGES = 65_536
ROWS_PER_RANGE = 512


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty, and the empty text has one empty leaf."""
    leaves = lambda paragraph: F.array_join(
        F.transform(F.split(paragraph, r"(?<=[.!?,;:|])\s+"), lambda x: F.substring(_sha(x), 1, DIGITS)), ",")
    paragraphs = lambda section: F.transform(F.split(section, r"\n"), leaves)
    tree = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r]*\n\s*"), paragraphs)
    shape = F.transform(tree, lambda section: F.array_join(section, ";"))
    return F.concat(_root(shape), F.lit("#"), F.array_join(shape, "/"))


def _root(sections: Column) -> Column:
    nodes = F.transform(sections, lambda s: _sha(F.array_join(F.transform(F.split(s, ";"), _sha), "")))
    return _sha(F.array_join(nodes, ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal leaves among the distinct leaves of two fingerprints (Dice); 1 for equal roots."""
    leaves = lambda x: F.array_distinct(F.split(F.substring_index(x, "#", -1), "[,;/]"))
    left, right = leaves(a), leaves(b)
    return F.when(F.substring_index(a, "#", 1) == F.substring_index(b, "#", 1), F.lit(1.0)).otherwise(
        2.0 * F.size(F.array_intersect(left, right)) / (F.size(left) + F.size(right)))


def edits(a: Column, b: Column) -> Column:
    """Numbers (section, paragraph), from 0, of the paragraphs of ``a`` whose branch differs from that of ``b``."""
    sections = lambda x: F.split(F.substring_index(x, "#", -1), "/")
    paired = F.arrays_zip(sections(a).alias("l"), sections(b).alias("r"))
    inner = lambda l, r: F.arrays_zip(F.split(l, ";").alias("l"), F.split(F.coalesce(r, F.lit("")), ";").alias("r"))
    within = F.transform(paired, lambda s, i: F.when(s["l"].eqNullSafe(s["r"]) | s["l"].isNull(), F.array()).otherwise(
        F.filter(F.transform(inner(s["l"], s["r"]), lambda p, j: F.when(
            p["l"].isNotNull() & ~p["l"].eqNullSafe(p["r"]),
            F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())))
    return F.flatten(within)


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most ``key``, by binary search; 0 for null."""
    if not splitters:
        return F.lit(0)
    values, steps = F.lit(splitters), [1 << b for b in reversed(range(len(splitters).bit_length()))]
    found = F.aggregate(
        F.lit(steps), F.lit(0),
        lambda at, step: F.when((at + step <= len(splitters)) & (F.get(values, at + step - 1) <= key), at + step)
        .otherwise(at))
    return F.coalesce(F.when(key.isNull(), F.lit(0)).otherwise(found), F.lit(0))


def with_next(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, object]:
    """Rows with the range they are in (``_range``) and a window over which lead() gives the next document.

    Ranges are bounded by sampled ids; the first row of each range (of the whole table after the last) is
    also put, marked ``_guest``, behind the range before it. So only rows of one range meet in a task, and
    the texts are shuffled once. Rows with equal ids follow the order of their texts; null ids come first.
    """
    rows, lowest, nulls = docs.agg(F.count(F.lit(1)), F.min(key), F.count_if(F.col(key).isNull())).first()
    wanted = max(1, min(MOST_RANGES, rows // ROWS_PER_RANGE))
    cuts = docs.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0] \
        if wanted > 1 else []
    splitters = sorted({c for c in cuts or [] if c != lowest or nulls})
    last = len(splitters)
    at = _range_of(F.col(key), splitters)
    first_of_all = F.col(key).isNull() if nulls else F.col(key) == F.lit(lowest)
    place = lambda number, guest: F.struct(number.cast("int").alias("_range"), F.lit(guest).alias("_guest"))
    heads = F.when(F.get(F.lit(splitters), at - 1) == F.col(key), at - 1) if last else F.lit(None)
    guests = F.when(first_of_all, F.lit(last)).otherwise(heads)
    placed = docs.withColumn("_at", F.explode(F.when(guests.isNull(), F.array(place(at, False))).otherwise(
        F.array(place(at, False), place(guests, True))))).select(*docs.columns, "_at._range", "_at._guest")
    return placed, Window.partitionBy("_range").orderBy("_guest", F.col(key).asc_nulls_first(), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, of edited copies, and how alike they are.

    The edited copy has its last floor(n/2) code points replaced by the first as many (or all) of the next
    document in ascending doc_id, the first following the last. Null texts count as empty; an empty text's
    copy is itself. Repeated rows are kept: each is next to its twin.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed, order = with_next(docs)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    # One shuffle: both windows share the ranges and their order.
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    seen = placed.withColumn("next_text", F.lead("text").over(order)).select(
        "doc_id", "_range", "_guest", "text", n.cast("long").alias("n_chars"),
        F.coalesce(edited, F.lit("")).alias("edited"), fingerprint(F.col("text")).alias("fingerprint"))
    both = seen.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).filter(~F.col("_guest"))
    made = both.select("doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint",
                       fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
