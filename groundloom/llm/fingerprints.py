"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations.

A text is cut into paragraphs: lines, or stretches of a line that end with the sentence after 80 characters,
or 120 characters later if no sentence ends. Its
fingerprint is a sketch of their distinct digests: 4 tables of cells, each the number, exclusive or and check
of the digests that hash there. Two sketches are subtracted cell by cell; what both texts share cancels, and
cells that hold one digest are peeled off, table by table, until the differing digests are all known. If that
fails, as it must if more differ than there are cells, and only then, a larger sketch sized by the two texts is
drawn with other hashes and peeled; the few pairs where that fails too are compared digest by digest. The likeness of two texts is the
share of their digests that both have (empty texts are alike).

Cells are rows, dealt out by document. The text of each document moves once, to meet the head of the next
one, and the digests once more, before retries; all sketches and all rounds of peeling are sums by document and
cell within that partitioning. Null text
counts as empty; a null id comes first; rows of equal id are ordered by a hash of their text, and rows of
equal id and text are one document that comes as often as it is given. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundloom.llm import scratch

PARAGRAPH = r"[^\n]{1,80}[^\n.!?]{0,120}[.!?\s]*"
#: Tables of a sketch; cells of each in a fingerprint.
TABLES, CELLS = 4, 8
#: Of a retry: cells of a table for each digest of the two texts.
PER_DIGEST = 0.45
#: Times that each table is peeled.
CYCLES = 3
FIRST = -(2**63)
DOC = ["d", "h"]
#: A cell: of a document's pair of texts, the sketch's level and size, its place (-1: a digest that is known, and which).
CELL = [*DOC, "pair", "level", "size", "cell", "known"]


def digests(text: Column) -> Column:
    """The paragraph digests of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.transform(F.filter(F.transform(found, lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != ""), lambda p: F.xxhash64(p))


def _check(k: Column, level: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("check"), level, k), 32)


def _place(k: Column, level: Column, size: Column, table: int) -> Column:
    """The cell of a table that a digest hashes to."""
    return (F.pmod(F.xxhash64(F.lit(table), level, k), size) + size * table).cast("int")


def _items(texts: DataFrame) -> DataFrame:
    """d, h, side and k: the distinct digests of each document's text (0), edited text (1) and next text (2).

    all_1 and all_2 are the paragraphs of the text and of the other one, repeats counted.
    """

    def side(column: str, number: int) -> Column:
        return F.transform(column, lambda k: F.struct(F.lit(number).alias("side"), k.alias("k")))

    sizes = [(F.size("own") + F.size(c)).alias(f"all_{i}") for i, c in ((1, "edited"), (2, "next"))]
    each = texts.select(*DOC, *sizes, F.explode(F.concat(side("own", 0), side("edited", 1), side("next", 2))).alias("x"))
    return each.select(*DOC, "all_1", "all_2", "x.side", "x.k").distinct()


def _drawn(items: DataFrame) -> DataFrame:
    """Cells of fingerprint sketches, with the sums of each side."""
    level, size = F.lit(0), F.lit(CELLS)
    each = items.withColumns({"cell": F.explode(F.array(*(_place(F.col("k"), level, size, t) for t in range(TABLES)))), "check": _check(F.col("k"), level)})
    sums = []
    for i in range(3):
        mine = F.col("side") == i
        sums += [F.sum(mine.cast("bigint")).alias(f"n{i}"), F.bit_xor(F.when(mine, F.col("k")).otherwise(0)).alias(f"k{i}"), F.bit_xor(F.when(mine, F.col("check")).otherwise(0)).alias(f"c{i}")]
    return each.groupBy(*DOC, "cell").agg(*sums)


def _row(pair, level, size, cell, known, n, k, c) -> Column:
    values = {"pair": (pair, "int"), "level": (level, "int"), "size": (size, "int"), "cell": (cell, "int"), "known": (known, "bigint"), "n": (n, "bigint"), "k": (k, "bigint"), "c": (c, "bigint")}
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name) for name, (v, kind) in values.items()))


def _summed(rows: DataFrame) -> DataFrame:
    """Rows of one cell added up; cells that cancel are left out."""
    cells = rows.groupBy(*CELL).agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return cells.where("n != 0 OR k != 0 OR c != 0")


def _subtracted(items: DataFrame, pairs: Column, level: int) -> DataFrame:
    """Cells of the sketches' differences at a level (0: fingerprints, 1: retries) for the given pairs of a document (1, 2)."""
    n = F.when(F.col("side") == 0, 1).otherwise(-1)
    pairs = F.filter(pairs, lambda p: (F.col("side") == 0) | (F.col("side") == p))
    each = items.withColumn("pair", F.explode(pairs))
    wide = (F.ceil(F.lit(PER_DIGEST) * F.when(F.col("pair") == 1, F.col("all_1")).otherwise(F.col("all_2"))) + CELLS).cast("int")
    each = each.withColumn("size", wide if level else F.lit(CELLS)).withColumn("check", _check(F.col("k"), F.lit(level)))
    places = F.array(*(_row(F.col("pair"), level, F.col("size"), _place(F.col("k"), F.lit(level), F.col("size"), t), 0, n, F.col("k"), F.col("check")) for t in range(TABLES)))
    return _summed(each.select(*DOC, F.explode(places).alias("x")).select(*DOC, "x.*"))


def _peeled_table(cells: DataFrame, table: int) -> DataFrame:
    """Cells of the table that hold one digest give it up: it is known, and taken from the other tables.

    A digest is in one cell of a table, so it cannot be taken twice.
    """
    k, level, size, n = (F.col(x) for x in ("k", "level", "size", "n"))
    pure = (F.abs(n) == 1) & (F.floor(F.col("cell") / size) == table) & (F.col("c") == _check(k, level))
    same = (F.col("pair"), level, size)
    others = [_row(*same, _place(k, level, size, t), 0, -n, k, F.col("c")) for t in range(TABLES) if t != table]
    given = F.array(_row(*same, -1, k, n, 0, 0), *others)
    stays = F.array(_row(*same, F.col("cell"), F.col("known"), n, k, F.col("c")))
    return _summed(cells.select(*DOC, F.explode(F.when(pure, given).otherwise(stays)).alias("x")).select(*DOC, "x.*"))


def differences(items: DataFrame, pairs: Column, level: int) -> DataFrame:
    """d, h, pair, n and known: the differing digests (n 1: of the text, -1: of the other); rows of cell 0 or more are left unpeeled."""
    cells = _subtracted(items, pairs, level)
    for _ in range(CYCLES):
        for table in range(TABLES):
            cells = _peeled_table(cells, table)
    return cells


def _counts(items: DataFrame, pairs: Column, level: int) -> DataFrame:
    """d, h and the number of differing digests of pairs 1 and 2, -1 if some are not known, null if none differ."""

    def of(pair: int) -> Column:
        mine = F.col("pair") == pair
        left = F.sum(F.when(mine & (F.col("cell") >= 0), 1).otherwise(0))
        return F.when(left == 0, F.sum(F.when(mine, 1).otherwise(0))).otherwise(-1).alias(f"d{pair}{level}")

    return differences(items, pairs, level).groupBy(*DOC).agg(of(1), of(2))


def _shown(texts: DataFrame) -> DataFrame:
    """d, h and both fingerprints: the hex digits of each cell's place, number, digests and check, empty cells left out."""

    def show(i: int) -> Column:
        full = F.filter("cells", lambda x: x[f"n{i}"] > 0)
        one = lambda x: F.concat(*(F.lpad(F.hex(x[c]), n, "0") for c, n in (("cell", 2), (f"n{i}", 4), (f"k{i}", 16), (f"c{i}", 8))))
        return F.lower(F.array_join(F.transform(full, one), ""))

    cells = _drawn(_items(texts)).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("cell", *(f"{c}{i}" for i in (0, 1) for c in "nkc")))).alias("cells"))
    return cells.select(*DOC, show(0).alias("fingerprint"), show(1).alias("edited_fingerprint"))


def _likeness(ours: str, theirs: str, pair: int) -> Column:
    """Of two arrays of distinct digests by their sketches' difference; where no sketch could be peeled, digest by digest."""
    both = F.size(ours) + F.size(theirs)
    exact = F.size(F.array_except(ours, theirs)) + F.size(F.array_except(theirs, ours))
    first, again = F.col(f"d{pair}0"), F.col(f"d{pair}1")
    d = F.when(first >= 0, first).when(again >= 0, again).otherwise(exact)
    return F.when(both == 0, F.lit(1.0)).otherwise(((both - d) / (both + d)).cast("double"))


def neighbours(docs: DataFrame) -> DataFrame:
    """d, h (id and text hash of each document) with prev_d, prev_h and prev_chars of the document before it; the last stands before the first.

    Ids alone are sorted, by range; each partition's first row is the next of the last row before it.
    """
    order = docs.groupBy("d", "h").agg(F.min("chars").alias("chars")).orderBy("d", "h")
    order = scratch.table(order.withColumn("place", F.monotonically_increasing_id()), "order")
    ends = order.groupBy(F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    by_part = Window.orderBy("part")  # a row for each partition that was sorted
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = ends.select(F.col("last").alias("at"), F.coalesce(F.lead("first").over(by_part), F.min("first").over(every)).alias("turn"))
    before = order.join(turns, order["place"] == turns["at"], "left")
    before = before.select(F.coalesce("turn", F.col("place") + 1).alias("place"), F.col("d").alias("prev_d"), F.col("h").alias("prev_h"), F.col("chars").alias("prev_chars"))
    return order.select("d", "h", "place").join(before, "place").drop("place")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has the last quarter (rounded down) of its characters replaced by the first as many, or
    all, of the next document.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    near = scratch.table(neighbours(rows.select(*DOC, F.length("text").alias("chars"))), "neighbours")
    placed = rows.join(near, DOC)
    head = F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int"))
    heads = placed.select(F.col("prev_d").alias("d"), F.col("prev_h").alias("h"), head.alias("head"), F.array_distinct(digests(F.col("text"))).alias("next"))
    n = F.length("text")
    changed = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head"))
    met = placed.select(*DOC, "text").join(heads.dropDuplicates(DOC), DOC).select(*DOC, "text", changed.alias("changed"), "next")
    given = met.select(*DOC, n.cast("bigint").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), F.array_distinct(digests(F.col("text"))).alias("own"), F.array_distinct(digests(F.col("changed"))).alias("edited"), "next")
    both = F.array(F.lit(1), F.lit(2))
    # Texts without differing digests have no cells.
    tried = given.join(_counts(_items(given.select(*DOC, "own", "edited", "next")), both, 0), DOC, "left")
    tried = scratch.table(tried.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("d10", "d20")}), "peeled")
    texts = tried.repartition(*DOC)
    failed = texts.where("d10 < 0 OR d20 < 0")
    open_pairs = F.filter(both, lambda p: F.when(p == 1, F.col("d10")).otherwise(F.col("d20")) < 0)
    again = _counts(_items(failed).join(failed.select(*DOC, "d10", "d20"), DOC), open_pairs, 1)
    found = texts.join(_shown(texts), DOC, "left").join(again, DOC, "left")
    none = F.lit("")
    return found.select(
        F.when(F.col("d") != FIRST, F.col("d")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.coalesce("fingerprint", none).alias("fingerprint"),
        F.coalesce("edited_fingerprint", none).alias("edited_fingerprint"),
        _likeness("own", "edited", 1).alias("near_edited"), _likeness("own", "next", 2).alias("near_next"),
    )
