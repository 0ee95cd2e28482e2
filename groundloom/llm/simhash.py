"""SimHash near-duplicates by a binary trie self-join.

Fingerprints within `budget` differing bits are linked. The trie of fingerprints is joined with itself from
the root down: a pair of nodes carries the bits in which its prefixes differ, and is pruned when they exceed
the budget. With 64 bits in four blocks, two fingerprints within three bits agree in one block at least, so
four tries, each with another block on top, need to follow equal nodes only through their first 16 bits.
The nodes at that depth are the keys by which Spark deals out the work; below a node (or pair of nodes) with
few fingerprints numpy goes on level by level. Nodes with more than `most` are split by eight further bits
into all pairs within the budget, as often as needed, so no task holds an unbounded group and no pair is lost.

Equal fingerprints are one class. Below a node only the links that join classes into components are given
out, at most one a fingerprint; pairs of nodes whose fingerprints are all joined are pruned too.

Null text counts as empty. Rows of equal id are one document of several texts. A null id takes part, but the
smallest reachable id ignores it (null if there is no other). An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.llm import scratch
from groundloom.llm.batches import pieces
from groundloom.llm.components import components, join_labels

BITS, BLOCK = 64, 16
SEED = 42
#: Shingle hashes whose bits are summed at a time.
CHUNK = 65_536
#: Node pairs that one numpy step holds.
FRONTIER = 500_000
#: Keys of a text for similar_texts, least values that each is made of, and shingles that one numpy step holds.
BANDS, ROWS, SLICE = 32, 5, 4096
#: Cells of a matrix of texts and shingles.
CELLS = 2_000_000
LAST = 2**63 - 1


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of all shingles of `width` words (of all words, if there are fewer); no words: none."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return []
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return [digest(flat[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """The bits that more than half of the hashes have; no hashes: 0."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def text_fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the XXH64 of all shingles of `width` words; no words: 0."""
    return majority(shingle_hashes(text, width))


def fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (a signed 64-bit integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = pa.array([text_fingerprint(t, width) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


# Below a node: numpy.


class _Forest:
    """Tries over `codes`, sorted within each range of places that a root pair names."""

    def __init__(self, codes: np.ndarray, top: int, budget: int) -> None:
        self.codes, self.top, self.budget = codes, top, budget
        self.label = np.arange(len(codes))
        self._changes()

    def _changes(self) -> None:
        self.change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def _open(self, f: np.ndarray) -> np.ndarray:
        """Node pairs that hold two fingerprints not joined yet. f: rows first, end, first, end, bits."""
        a, b, c, d, _ = f
        joined = (self.change[a] == self.change[b - 1]) & (self.change[c] == self.change[d - 1]) & (self.label[a] == self.label[c])
        return f[:, ~joined]

    def descend(self, f: np.ndarray, bit: int, budget: int) -> None:
        while f.shape[1]:
            f = self._open(f)
            single = (f[1] - f[0] == 1) & (f[3] - f[2] == 1)
            a, c = f[0, single], f[2, single]
            if len(a):
                near = np.bitwise_count(self.codes[a] ^ self.codes[c]) <= self.budget
                self.label = join_labels(self.label, a[near], c[near])
                self._changes()
            f = f[:, ~single]
            if f.shape[1] > FRONTIER:
                for at in range(0, f.shape[1], FRONTIER // 2):
                    self.descend(f[:, at : at + FRONTIER // 2], bit, budget)
                return
            if bit < 0 or not f.shape[1]:
                return
            f = self._children(f, bit, budget)
            bit -= 1

    def _children(self, f: np.ndarray, bit: int, budget: int) -> np.ndarray:
        ones = np.concatenate([[0], np.cumsum((self.codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a, b, c, d, e = f
        m, n = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        own = (a == c) & (b == d)
        out = [np.array([a, m, c, n, e]), np.array([m, b, n, d, e]), np.array([a, m, n, d, e + 1])]
        out.append(np.array([m, b, c, n, e + 1])[:, ~own])
        f = np.concatenate(out, axis=1)
        full = (f[1] > f[0]) & (f[3] > f[2]) & (f[4] <= budget)
        lone = (f[0] == f[2]) & (f[1] - f[0] == 1) & (f[3] - f[2] == 1)
        return f[:, full & ~lone]

    def links(self, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of linked codes: each with the first of its component. Small differences first, as they join most."""
        wide = (roots[1] - roots[0] > 256) | (roots[3] - roots[2] > 256)
        for budget in range(1, self.budget):
            f = roots[:, wide]
            self.descend(f[:, f[4] <= budget], self.top, budget)
        self.descend(roots, self.top, self.budget)
        at = np.flatnonzero(self.label != np.arange(len(self.codes)))
        return at, self.label[at]


# Above: Spark.


def _rotated(fp: Column, turn: int) -> Column:
    return fp if not turn else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, BITS - turn))


def _top(code: Column, depth: int) -> Column:
    return F.shiftrightunsigned(code, BITS - depth)


def _roots(classes: DataFrame) -> DataFrame:
    """Rows of the four tries at depth 16: turn, the node pair (u, v), the code, and whether it is below v."""
    each = classes.select(F.explode(F.array(*(F.struct(F.lit(t).alias("turn"), _rotated(F.col("fp"), t).alias("code")) for t in range(0, BITS, BLOCK)))).alias("x")).select("x.*")
    return each.select("turn", _top(F.col("code"), BLOCK).alias("u"), _top(F.col("code"), BLOCK).alias("v"), F.lit(False).alias("second"), "code")


def _split(rows: DataFrame, depth: int, budget: int, step: int = 8) -> DataFrame:
    """Rows of node pairs at `depth`, dealt out to the pairs of their descendants `step` bits below within the budget."""
    masks = F.array(*(F.lit(m) for m in range(1 << step) if m.bit_count() <= budget))
    own = _top(F.col("code"), depth + step)
    left = F.lit(budget) - F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    each = rows.withColumn("mask", F.explode(F.filter(masks, lambda m: F.bit_count(m) <= left)))
    bits = own.bitwiseAND(F.lit((1 << step) - 1)).bitwiseXOR(F.col("mask").cast("bigint"))
    other = F.shiftleft(F.when(F.col("second"), F.col("u")).otherwise(F.col("v")), step).bitwiseOR(bits)
    same = F.col("u") == F.col("v")
    second = F.when(same, own > other).otherwise(F.col("second"))
    pair = each.select("turn", own.alias("own"), other.alias("other"), second.alias("second"), "code")
    mine = F.when(F.col("second"), F.col("other")).otherwise(F.col("own"))
    yours = F.when(F.col("second"), F.col("own")).otherwise(F.col("other"))
    return pair.select("turn", mine.alias("u"), yours.alias("v"), "second", "code")


def _below(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """Links (a, b) of fingerprints below the node pairs of rows, a task for many pairs at a time."""

    def solve(turn: np.ndarray, u: np.ndarray, v: np.ndarray, second: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        codes = code.view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
        end = np.append(new[1:], len(code))
        below = np.concatenate([[0], np.cumsum(second)])
        middle = end - (below[end] - below[new])
        own = u[new] == v[new]
        bits = np.bitwise_count((u[new] ^ v[new]).view(np.uint64)).astype(np.int64)
        roots = np.array([new, np.where(own, end, middle), np.where(own, new, middle), end, bits])
        roots = roots[:, np.where(own, end - new > 1, (middle > new) & (end > middle))]
        a, b = _Forest(codes, BITS - depth - 1, budget).links(roots)
        back = lambda at: _back(codes[at], turn[at]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back(a)), pa.array(back(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            turn, u, v = held[:3]
            last = np.flatnonzero((turn != turn[-1]) | (u != u[-1]) | (v != v[-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last node pair may go on in the next batch
            if cut:
                yield solve(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield solve(*held)

    keys = ["turn", "u", "v"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "second", "code")
    return dealt.select("turn", "u", "v", "second", "code").mapInArrow(run, "a bigint, b bigint")


def _back(codes: np.ndarray, turn: np.ndarray) -> np.ndarray:
    t = turn.astype(np.uint64)
    return np.where(t == 0, codes, (codes >> t) | (codes << ((np.uint64(BITS) - t) % np.uint64(BITS))))


def trie_links(classes: DataFrame, budget: int = 3, most: int = 16_384) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join all within `budget` bits into components."""
    rows, depth, found = _roots(classes), BLOCK, []
    while True:
        counts = rows.groupBy("turn", "u", "v").count()
        large = scratch.table(counts.where(F.col("count") > most).select("turn", "u", "v"), "large-nodes")
        if depth >= BITS or large.isEmpty():
            found.append(_below(rows, depth, budget))
            break
        found.append(_below(rows.join(large, ["turn", "u", "v"], "left_anti"), depth, budget))
        rows = scratch.table(_split(rows.join(large, ["turn", "u", "v"], "left_semi"), depth, budget), "split-nodes")
        depth += 8
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_duplicates(df: DataFrame, width: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    if not 0 <= budget < BITS // BLOCK:
        raise ValueError("four blocks find up to three differing bits")
    docs = scratch.table(fingerprints(df, width, id_col, text_col), "fingerprints")
    classes = scratch.table(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reached = components(trie_links(classes.select("fp"), budget), "a", "b")
    linked = classes.join(reached, classes["fp"] == reached["node"]).select("fp", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component_id")
    every = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # A table of its own: Spark can then split the join's large partitions, of fingerprints that many rows have.
    return docs.join(scratch.table(every, "groups"), "fp").select("doc_id", "fp", "component_id")


# Near copies by the Jaccard similarity of their shingles.


def band_keys(shingles: np.ndarray) -> list[int]:
    """BANDS hashes, each of the least values of ROWS hash functions over distinct shingles."""
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), SLICE):
        mixed = (shingles[at : at + SLICE] ^ b) * (a | np.uint64(1))
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64).tolist()


def _signatures(rows: DataFrame, width: int) -> DataFrame:
    """id, doc, fp and bands of every row whose text has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at, fps, bands = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                if hashes := shingle_hashes(text, width):
                    at.append(k)
                    fps.append(majority(hashes))
                    bands.append(band_keys(np.unique(np.array(hashes, np.uint64))))
            some = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "doc", "fp", "bands"])

    return rows.select("id", "doc", "text").mapInArrow(run, "id bigint, doc bigint, fp bigint, bands array<bigint>")


def _shingles(rows: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """id and the distinct shingle hashes of each asked text (id, doc), from one row of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [np.unique(np.array(shingle_hashes(t, width), np.uint64)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    # Copies of a text have ids of their own, so joined by both no text is a hot key.
    one = rows.join(asked, ["id", "doc"], "left_semi").dropDuplicates(["id", "doc"])
    return one.select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts whose sets of shingles have a Jaccard similarity of `similarity` or more."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.where((F.size("x") >= similarity * F.size("y")) & (F.size("y") >= similarity * F.size("x")))
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _open_texts(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """id, shingles of the texts of `apart` that may be similar to another one of them.

    Shingles that no other text of them has cannot be shared: with more than 1 - similarity of those a text
    has no partner left.
    """
    own = scratch.table(sets.join(apart.select("id").distinct(), "id", "left_semi"), "apart-shingles")
    once = own.select("id", F.explode("shingles").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    lone = once.groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    rest = F.size("shingles") - F.coalesce("lone", F.lit(0))
    return own.join(lone, "id", "left").where(rest >= similarity * F.size("shingles")).select("id", "shingles")


def _joined(apart: DataFrame, texts: DataFrame, similarity: float, most: int, volume: int) -> DataFrame:
    """Links (a, b) between components that similar texts of one key join. apart: band, id, component.

    Keys of more than `most` texts or `volume` shingles are cut into blocks, and each pair of blocks is
    compared by a task in numpy. Only links that join components leave it.
    """
    held = apart.join(texts.select("id", F.size("shingles").alias("n")), "id")
    keys = held.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("component").alias("c"), F.max("component").alias("d")).where("c != d")
    keys = scratch.table(keys.select("band", F.ceil(F.greatest(F.col("rows") / most, F.col("n") / volume)).cast("bigint").alias("blocks")), "apart-keys")
    sized = held.select("band", "id", "component").join(keys, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    each = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = each.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "id").join(texts, "id")

    def solve(own: np.ndarray, component: np.ndarray, sizes: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, label = np.unique(component, return_inverse=True)
        number = label
        _, column, times = np.unique(shingles, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(own)), sizes)
        row, column = row[times[column] > 1], column[times[column] > 1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        shared = np.zeros((len(left), len(right)), np.float32)
        at = 0
        while at < len(row):  # columns of some width, of all rows
            end = int(np.searchsorted(column, column[at] + max(1, CELLS // len(own))))
            part = np.zeros((len(own), column[end - 1] - column[at] + 1), np.float32)
            part[row[at:end], column[at:end] - column[at]] = 1
            shared += part[left] @ part[right].T
            at = end
        total = sizes[left][:, None] + sizes[right][None, :] - shared.astype(np.float64)
        near = (shared >= similarity * total) & (number[left][:, None] != number[right][None, :])
        a, b = np.nonzero(near)
        joined = join_labels(np.arange(len(names)), number[left[a]], number[right[b]])
        at = np.flatnonzero(joined != np.arange(len(names)))
        return names[at], names[joined[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch:
            own, component = (np.array(x, np.int64) for x in zip(*((r[1], r[2]) for r in held), strict=True))
            sizes = np.array([len(r[3]) for r in held])
            a, b = solve(own, component, sizes, np.concatenate([r[3] for r in held]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            band, i, j, own, component = (c.to_pylist() for c in batch.columns[:5])
            ends = np.cumsum(pa.compute.list_value_length(batch.column(5)).to_numpy())
            flat = batch.column(5).flatten().to_numpy()
            for k, key in enumerate(zip(band, i, j, strict=True)):
                if held and held[0][0] != key:
                    yield flush()
                    held = []
                held.append((key, own[k], component[k], flat[ends[k - 1] if k else 0 : ends[k]]))
        if held:
            yield flush()

    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "id")
    return dealt.select("band", "i", "j", "own", "component", "shingles").mapInArrow(run, "a bigint, b bigint")


def similar_texts(df: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, volume: int = 250_000) -> DataFrame:
    """node, component (the smallest node that links reach): xxhash64 of each text that is linked to another text.

    Two texts are linked if their sets of shingles of `width` words have a Jaccard similarity of `similarity`
    or more, which is taken exactly. Pairs to compare are the trie's links of the fingerprints and texts that
    share one of BANDS keys: at similarity 0.8 two texts share none with probability 3e-6, above it more rarely.
    First each text of a key is compared with the key's smallest. Of those that are still in different
    components, texts that can have no partner go, and blocks of the others are compared with one another,
    so no pair of a large group of near copies becomes a row. Texts of one xxhash64 are one text.
    """
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))
    rows = df.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("id"), doc.alias("doc"), F.col(text_col).alias("text"))
    made = scratch.table(_signatures(rows, width), "signatures")
    texts = scratch.table(made.groupBy("id").agg(F.min("doc").alias("doc"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "texts")
    classes = scratch.table(texts.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    equal = texts.join(classes, "fp").select(F.col("least").alias("a"), F.col("id").alias("b"))
    near = trie_links(classes.select("fp"))
    for end in "ab":
        near = near.join(classes.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_least")), end)
    near = near.select(F.least("a_least", "b_least").alias("a"), F.greatest("a_least", "b_least").alias("b"))

    each = texts.select("id", F.explode("bands").alias("band"))
    least = scratch.table(each.groupBy("band").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a"), "keys")
    shared = scratch.table(each.join(least, "band"), "bands")
    first = scratch.table(shared.select("a", F.col("id").alias("b")).union(near).union(equal).where("a != b").distinct(), "pairs")
    asked = first.select(F.col("a").alias("id")).union(first.select("b")).distinct().join(texts.select("id", "doc"), "id")
    sets = scratch.table(_shingles(rows, asked, width), "shingles")
    links = scratch.table(_alike(first, sets, similarity), "alike")

    reached = scratch.table(components(links, "a", "b"), "reached")
    named = shared.join(reached, shared["id"] == reached["node"], "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    named = scratch.table(named, "named")
    split = scratch.table(named.groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c != d").select("band"), "split")
    apart = scratch.table(named.join(split, "band", "left_semi"), "apart")
    open_texts = scratch.table(_open_texts(apart, sets, similarity), "open-texts")
    more = scratch.table(_joined(apart, open_texts, similarity, most, volume), "alike")
    found = scratch.table(components(links.union(more), "a", "b"), "similar")
    scratch.drop(made, texts, classes, least, shared, first, sets, links, reached, named, split, apart, open_texts, more)
    return found


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
