"""Near-duplicate records with small edits: an exact set join over size-banded tiles (problem 6).

A record is the set of its distinct runs of three words, as 64-bit hashes. Two records of Jaccard similarity t or more
share a shingle among the first |x| - ceil(t|x|) + 1 of either in one common order, so only records that do are
compared. Frequent shingles come last in that order, which keeps the posting lists short. A posting list is sorted by
size and compared in tiles: a record only with those of a size within the factor t, which is a band of the list; a list
that many records share is cut into blocks, and each pair of blocks is a tile of its own, in a task of its own. In a
tile a hashed bitmap of each set bounds the overlap from above by a count of bits; what that leaves is settled by an
exact intersection of sorted arrays.

Equal sets are one class: they are posted once for each task that reads them, and joined once. No pair of different
sets is lost at any size. Classes are multiplied out only where pairs of ids are asked for, block by block.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusmill.session import materialise

WORDS = re.compile(r"[^\W_]+")
CHUNK = 1 << 14  # counters of shingles that are sent together
LEAST_BITS, MOST_BITS = 18, 24  # of the number of counters: 2 MB to 128 MB in a task, half of that broadcast
WIDTHS = (256, 512, 1024, 2048)  # bits of a set's bitmap, by its size
BROADCAST_ROWS = 500_000

_MASK = (1 << 64) - 1


def _word_hash(word: str) -> int:
    """A 64-bit hash that does not depend on the process (FNV-1a)."""
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & _MASK
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Sets:
    """The sets of shingles of some texts, one after another: hashes[begin[i] : begin[i] + size[i]], sorted."""

    n_words: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray

    def hash(self) -> np.ndarray:
        """A 64-bit hash of each set; 0 for an empty one."""
        m = _mix(self.hashes.view(np.uint64) + self.size[self.owner].astype(np.uint64))
        out = np.zeros(len(self.size), dtype=np.uint64)
        some = self.size > 0
        if some.any():
            at = self.begin[some]
            out[some] = _mix(np.add.reduceat(m, at) ^ (np.bitwise_xor.reduceat(m, at) * np.uint64(3)))
        return out.view(np.int64)

    def bitmaps(self, bits: int, rows: np.ndarray) -> np.ndarray:
        """Bit h mod `bits` is set for every hash h, for the chosen rows; as bytes."""
        place = np.full(len(self.size), -1, dtype=np.int64)
        place[rows] = np.arange(len(rows))
        mine = place[self.owner]
        ok = mine >= 0
        out = np.zeros(len(rows) * bits, dtype=np.uint8)
        out[mine[ok] * bits + (self.hashes[ok] & (bits - 1))] = 1
        return np.packbits(out.reshape(len(rows), bits), axis=1)


class Shingler:
    """Texts to sets of the hashes of their runs of words; hashes of words are kept, up to a number of words."""

    def __init__(self, words: int, keep: int = 500_000):
        self.words, self.keep, self.known, self.table = words, keep, {}, []

    def __call__(self, texts: list[str]) -> Sets:
        if len(self.known) > self.keep:
            self.known, self.table = {}, []
        known, flat, n_words = self.known, [], np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = WORDS.findall(text.lower())
            n_words[i] = len(found)
            try:
                flat += [known[x] for x in found]
            except KeyError:
                for x in found:
                    if x not in known:
                        known[x] = len(self.table)
                        self.table.append(_word_hash(x))
                flat += [known[x] for x in found]
        w = np.array(self.table, dtype=np.uint64)[np.array(flat, dtype=np.int64)] if flat else np.empty(0, dtype=np.uint64)
        n = max(0, len(w) - self.words + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(self.words):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
        owner = np.repeat(np.arange(len(texts)), n_words)
        inside = owner[:n] == owner[self.words - 1 :] if n else np.empty(0, dtype=bool)
        owner, h = owner[:n][inside], h[inside].view(np.int64)
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
        owner, h = owner[new], h[new]
        size = np.bincount(owner, minlength=len(texts))
        return Sets(n_words, size, np.cumsum(size) - size, owner, h)


def _parts(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that very long texts don't add up."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _slots(rows: DataFrame) -> int:
    """Counters for the shingles of the texts: one for eight of them or so, each character beginning a sixth of one."""
    n = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 6
    return 1 << min(MOST_BITS, max(LEAST_BITS, (n // 8).bit_length()))


def prefix_length(size: np.ndarray, t: float) -> np.ndarray:
    """Shingles of the prefix of a set of that size."""
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def map_bits(size: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: enough that sets of that size which have little in common differ in many."""
    return np.select([size <= 160, size <= 320, size <= 640], WIDTHS[:3], WIDTHS[3])


def texts(df: DataFrame, key: str, text: str, space: str) -> DataFrame:
    """(space, id, text) of a table; rows without key or text are left out."""
    return df.select(F.lit(space).alias("space"), F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def _pass_one(words: int, least: int, slots: int):
    """Rows (space, id, set, size, text_hash) of each record, and rows (size: chunk, counts) of the counters of shingles by slot."""
    names = ["space", "id", "set", "size", "text_hash", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, total = Shingler(words), np.zeros(slots, dtype=np.int64)
        for b in _parts(batches):
            said = b.column(2).to_pylist()
            sets = make(said)
            ok = np.flatnonzero((sets.n_words >= least) & (sets.size > 0))
            counted = np.zeros(len(sets.size), dtype=bool)
            counted[ok] = True
            np.add.at(total, _slot(sets.hashes[counted[sets.owner]], slots), 1)
            take = pa.array(ok)
            own = [int.from_bytes(hashlib.blake2b(said[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for i in ok.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(sets.hash()[ok]), pa.array(sets.size[ok].astype(np.int32)), pa.array(own, pa.int64()), pa.nulls(len(ok), pa.binary())], names=names)
        chunks = total.reshape(slots // CHUNK, CHUNK)
        some = np.flatnonzero(chunks.any(axis=1)).astype(np.int32)
        if n := len(some):
            blobs = [zlib.compress(chunks[i].tobytes(), 1) for i in some]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(some), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary())], names=names)

    return run


def _sum_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), dtype=np.int64) for c in pdf["counts"])
    return pd.DataFrame({"size": [pdf["size"].iloc[0]], "counts": [total.tobytes()]})


def _postings(words: int, least: int, t: float, order, blocks):
    """(space, token, tile, half, set, size, map) for each prefix shingle of each distinct set of the task's rows.

    A shingle whose counter says that many records share it has blocks[slot] = B > 1: a set is in block set mod B and
    posted to the B tiles that pair that block with each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, rank, cut = Shingler(words), set(), order.value, blocks.value
        for b in _parts(batches):
            sets, spaces = make(b.column(1).to_pylist()), b.column(0).to_pylist()
            own = sets.hash()
            new = np.zeros(len(own), dtype=bool)
            for i in np.flatnonzero((sets.n_words >= least) & (sets.size > 0)).tolist():
                key = (spaces[i], int(own[i]))
                if key not in seen:
                    seen.add(key)
                    new[i] = True
            rows = np.flatnonzero(new)
            keep = new[sets.owner]
            owner, h = sets.owner[keep], sets.hashes[keep]
            slot = _slot(h, len(rank))
            first = np.lexsort((h, rank[slot], owner))  # ties in rank: by hash
            owner, h, slot = owner[first], h[first], slot[first]
            size = np.where(new, sets.size, 0)
            within = np.arange(len(h)) - (np.cumsum(size) - size)[owner]
            keep = within < prefix_length(sets.size, t)[owner]
            owner, token, slot = owner[keep], h[keep], slot[keep]
            many = cut[slot].astype(np.int64)
            at = np.repeat(np.arange(len(token)), many)
            other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            owner, token, many = owner[at], token[at], many[at]
            mine = (own[owner] & 0x7FFFFFFF) % many
            tile = (np.minimum(mine, other) * many + np.maximum(mine, other)).astype(np.int32)
            half = np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.int8)
            maps: list[bytes] = [b""] * len(own)
            width = map_bits(sets.size)
            for bits in WIDTHS:
                which = rows[width[rows] == bits]
                for i, m in zip(which.tolist(), sets.bitmaps(bits, which), strict=True):
                    maps[i] = m.tobytes()
            who = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(who), pa.array(token), pa.array(tile), pa.array(half), pa.array(own[owner]), pa.array(sets.size[owner].astype(np.int32)), pa.array(maps, pa.binary()).take(who)],
                names=["space", "token", "tile", "half", "set", "size", "map"],
            )

    return run


POSTING = "space string, token long, tile int, half byte, set long, size int, map binary"


class Maps:
    """Bitmaps of rows of several widths; narrower ones are had by folding."""

    def __init__(self, maps: list[bytes]):
        width = np.array([8 * len(m) for m in maps], dtype=np.int64)
        self.place, self.words = {}, {}
        for bits in WIDTHS:
            has = np.flatnonzero(width >= bits)
            place = np.full(len(maps), -1, dtype=np.int64)
            place[has] = np.arange(len(has))
            words = np.zeros((len(has), bits // 64), dtype=np.uint64)
            for w in WIDTHS:
                own = has[width[has] == w]
                if w >= bits and len(own):
                    full = np.frombuffer(b"".join([maps[i] for i in own.tolist()]), dtype=np.uint64).reshape(len(own), w // bits, bits // 64)
                    words[place[own]] = np.bitwise_or.reduce(full, axis=1)
            self.place[bits], self.words[bits] = place, words

    def differ(self, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        """True for pairs that differ in at most `least` bits at every width that both have."""
        ok = np.ones(len(a), dtype=bool)
        for bits in WIDTHS:
            x, y = self.place[bits][a], self.place[bits][b]
            test = np.flatnonzero(ok & (x >= 0) & (y >= 0))
            if not len(test):
                break
            n = np.bitwise_count(self.words[bits][x[test]] ^ self.words[bits][y[test]]).sum(axis=1, dtype=np.int64)
            ok[test[n > least[test]]] = False
        return ok


def tile_pairs(token: np.ndarray, half: np.ndarray, own: np.ndarray, size: np.ndarray, maps: Maps, t: float) -> np.ndarray:
    """Pairs of rows of the same tile whose sets sizes and bitmaps leave possible. Rows are sorted by token and size."""
    n, out = len(token), []
    alive = np.arange(n)
    for d in range(1, n):
        alive = alive[alive < n - d]
        other = alive + d
        # sizes only rise along a list: beyond the band, or the list, there is nothing further on
        alive = alive[(token[other] == token[alive]) & (size[alive] >= t * size[other] - 1e-9)]
        if not len(alive):
            break
        a = alive[(half[alive] == 0) | (half[alive] != half[alive + d])]
        both = size[a] + size[a + d]
        # overlap <= (|a| + |b| - differing bits) / 2, and t needs an overlap of t / (1 + t) of both sizes
        a = a[maps.differ(a, a + d, both - 2 * t / (1 + t) * both + 1e-6)]
        if len(a):
            out.append(np.stack([a, a + d], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def _tiles(t: float, hold: int = 300_000):
    """Candidates of a partition sorted by token: lists are held until complete, many at a time."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        col = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        names = pa.concat_arrays(table.column("space").chunks).dictionary_encode()
        space = names.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
        list_id = _mix(col("token").view(np.uint64) + (col("tile").astype(np.uint64) << np.uint64(8)) + space)
        own, size, half = col("set"), col("size").astype(np.int64), col("half")
        order = np.lexsort((own, size, list_id))
        list_id, own, size, half = list_id[order], own[order], size[order], half[order]
        # the same set may be posted by several tasks; a list of one set joins nothing
        new = np.ones(len(own), dtype=bool)
        new[1:] = (list_id[1:] != list_id[:-1]) | (own[1:] != own[:-1])
        same = np.zeros(len(own) + 1, dtype=bool)
        same[1:-1] = list_id[1:] == list_id[:-1]
        keep = np.flatnonzero(new & (same[:-1] | same[1:]))
        order, own, half, size, list_id = order[keep], own[keep], half[keep], size[keep], list_id[keep]
        maps = Maps(table.column("map").combine_chunks().take(pa.array(order)).to_pylist())
        pairs = tile_pairs(list_id, half, own, size, maps, t)
        x, y = own[pairs[:, 0]], own[pairs[:, 1]]
        found = np.unique(np.stack([space[order[pairs[:, 0]]].astype(np.int64), np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(found[:, 0])), pa.array(found[:, 1]), pa.array(found[:, 2])], names=["space", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= hold:
                table = pa.Table.from_batches(held)
                tokens = table.column("token").combine_chunks().to_numpy(zero_copy_only=False)
                last = int(np.searchsorted(tokens, tokens[-1]))  # the last list may go on
                if last:
                    yield emit(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
                    rows = table.num_rows - last
        if rows:
            yield emit(pa.Table.from_batches(held))

    return run


def near_duplicate_sets(rows: DataFrame, t: float, words: int = 3, least_words: int = 20, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Similar classes of equal sets, and the members of all classes.

    rows: (space, id, text); records are compared within a space. Gives pairs (space, a, b, similarity) of classes whose
    sets of runs of `words` words have a Jaccard similarity of at least t, and members (space, id, set, size, text_hash). Texts of
    fewer than least_words words are in neither; null texts and ids neither; an id with several texts is in several
    classes; repeated rows come out once. Both are empty for an empty table. Whole texts are read, however long.

    block: about how many records of one posting list go into one side of a tile.
    """
    spark = rows.sparkSession
    slots = _slots(rows)
    first = materialise(rows.mapInArrow(_pass_one(words, least_words, slots), "space string, id string, set long, size int, text_hash long, counts binary"), "shingle-sets")
    members = materialise(first.where("counts IS NULL").select("space", "id", "set", "size", "text_hash").distinct(), "members")
    freq = np.zeros(slots, dtype=np.int64)
    for r in first.where("counts IS NOT NULL").select("size", "counts").groupBy("size").applyInPandas(_sum_counts, "size int, counts binary").toLocalIterator():  # the counters, chunk by chunk
        freq[r["size"] * CHUNK : (r["size"] + 1) * CHUNK] = np.frombuffer(r["counts"], dtype=np.int64)
    rank = np.empty(slots, dtype=np.int32)
    rank[np.argsort(freq, kind="stable")] = np.arange(slots, dtype=np.int32)
    # what a slot has beyond twice the usual is taken for one shingle's
    many = np.maximum((freq - 2 * np.median(freq)) // block + 1, 1).astype(np.int32)
    order, blocks = spark.sparkContext.broadcast(rank), spark.sparkContext.broadcast(many)

    posted = rows.select("space", "text").mapInArrow(_postings(words, least_words, t, order, blocks), POSTING)
    lists = posted.repartition(F.col("token"), F.col("tile")).sortWithinPartitions("token", "tile")
    pairs = materialise(lists.mapInArrow(_tiles(t), "space string, a long, b long").distinct(), "candidate-pairs")
    return _verified(rows, members, pairs, t, words), members


def _verified(rows: DataFrame, members: DataFrame, pairs: DataFrame, t: float, words: int) -> DataFrame:
    """The pairs whose sets, made again from the texts of one member of each class, have that similarity."""
    asked = pairs.select("space", F.inline(F.array(F.struct(F.col("a").alias("set")), F.struct(F.col("b").alias("set"))))).distinct()
    reps = members.groupBy("space", "set").agg(F.min("id").alias("id")).join(asked, ["space", "set"])
    reps = materialise(reps, "candidate-sets")
    few = reps.count() <= BROADCAST_ROWS  # rows of some 50 bytes; beyond that the texts are shuffled

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for b in _parts(batches):
            sets = make(b.column(2).to_pylist())
            same = sets.hash() == b.column(1).to_numpy()
            ends = sets.begin + sets.size
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sets.hashes[x:y].tobytes() for x, y in zip(sets.begin, ends, strict=True)], pa.binary()), pa.array(same)], names=["space", "set", "shingles", "same"])

    texts_of = rows.join(F.broadcast(reps) if few else reps, ["space", "id"]).select("space", "set", "text")
    sets = texts_of.mapInArrow(again, "space string, set long, shingles binary, same boolean").where("same").groupBy("space", "set").agg(F.first("shingles").alias("shingles"))
    sets = materialise(sets, "candidate-shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = []
            for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                values.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(values, pa.float64())], names=["space", "a", "b", "similarity"])

    both = pairs.join(sets.select("space", F.col("set").alias("a"), F.col("shingles").alias("x")), ["space", "a"]).join(sets.select("space", F.col("set").alias("b"), F.col("shingles").alias("y")), ["space", "b"])
    return both.select("space", "a", "b", "x", "y").mapInArrow(check, "space string, a long, b long, similarity double").where(F.col("similarity") >= t - 1e-12)


def id_pairs(pairs: DataFrame, members: DataFrame, expand: int | None = 64, block: int = 512) -> DataFrame:
    """(id_a, id_b) of different ids in the same class or in similar ones, as strings the smaller first, each pair once.

    With expand=None every pair comes out. Else of more than `expand` ids of one class whose texts are equal byte for
    byte the smallest stands for all in pairs with other texts and is paired with each of the others, which links the
    same ids; different texts are paired in full all the same, whatever the size of their classes.

    Each class is cut by a hash into blocks of about `block` ids, and each pair of blocks is a row of its own, spread
    over all tasks. Ids with one text are apart from those with several: only pairs with one of the latter can come up
    twice, and only those are shuffled to be made distinct.
    """
    spark = members.sparkSession
    pairs = materialise(pairs.select("space", "a", "b"), "similar-classes")
    ids = members.select("space", "set", "text_hash", "id").distinct().withColumn("many", F.count("*").over(W.partitionBy("id")) > 1)
    star = None
    if expand is not None:
        equal = W.partitionBy("space", "set", "text_hash")
        ids = materialise(ids.withColumn("rep", F.when(F.count("*").over(equal) > expand, F.min("id").over(equal))), "pair-ids")
        star = ids.where("rep < id").selectExpr("rep AS id_a", "id AS id_b")
        ids = ids.where("rep IS NULL OR rep = id")
    ids = ids.select("space", "set", "id", "many").distinct()
    ends = pairs.select("space", F.inline(F.array(F.struct(F.col("a").alias("set")), F.struct(F.col("b").alias("set"))))).distinct().withColumn("linked", F.lit(True))
    parts = lambda c: F.ceil(F.count_if(c) / block).cast("int")
    classes = ids.groupBy("space", "set").agg(F.count("*").alias("n"), parts(~F.col("many")).alias("p"), parts(F.col("many")).alias("m"))
    classes = materialise(classes.join(ends, ["space", "set"], "left").where("n > 1 OR linked").select("space", "set", "n", "p", "m"), "pair-classes")
    place = F.expr("CAST(IF(many, p + pmod(xxhash64(id), greatest(m, 1)), pmod(xxhash64(id), greatest(p, 1))) AS INT)")
    blocks = ids.join(classes, ["space", "set"]).withColumn("k", place).groupBy("space", "set", "k").agg(F.collect_list("id").alias("ids"), F.first("many").alias("many"))
    blocks = materialise(blocks, "pair-blocks")

    size = lambda c, n: classes.select("space", F.col("set").alias(c), F.expr("p + m").alias(n))
    both = classes.where("n > 1").selectExpr("space", "set AS a", "set AS b", "p + m AS na", "p + m AS nb")
    both = both.unionByName(pairs.join(size("a", "na"), ["space", "a"]).join(size("b", "nb"), ["space", "b"]))
    both = both.withColumn("i", F.explode(F.expr("sequence(0, na - 1)"))).withColumn("j", F.explode(F.expr("sequence(IF(a = b, i, 0), nb - 1)")))
    side = lambda c, k, x: blocks.select("space", F.col("set").alias(c), F.col("k").alias(k), F.col("ids").alias(x), F.col("many").alias(f"many_{x}"))
    both = both.join(side("a", "i", "xs"), ["space", "a", "i"]).join(side("b", "j", "ys"), ["space", "b", "j"])
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "space", "a", "i", "b", "j")
    both = materialise(both.selectExpr("xs", "ys", "a = b AND i = j AS same", "many_xs OR many_ys AS many"), "block-pairs")

    def every(some: DataFrame) -> DataFrame:
        out = some.select("same", "ys", F.explode("xs").alias("x")).select("same", "x", F.explode("ys").alias("y")).where("IF(same, x < y, x <> y)")
        return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    twice = every(both.where("many"))
    return every(both.where("NOT many")).unionByName((twice.unionByName(star) if star is not None else twice).distinct())


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(space, id, group_id, links): one row of each id in a group of near-duplicates.

    group_id is the smallest id that can be reached over similar pairs; links counts the similar classes of the id's
    own class (the largest count, where an id has several texts). Ids alone in their class, without links, are left out.
    """
    classes = members.groupBy("space", "set").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n"))
    both = pairs.select("space", "a", "b").unionByName(pairs.select("space", F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("space", "a").agg(F.count("*").alias("links"))
    in_group = members.select("space", "id", "set").distinct().join(classes, ["space", "set"]).join(degree.withColumnRenamed("a", "set"), ["space", "set"], "left")
    in_group = materialise(in_group.where("n > 1 OR links IS NOT NULL").select("space", "id", "set", F.coalesce("links", F.lit(0)).alias("links")), "group-members")
    # vertices are ids and sets; an id is linked to its sets, a set to similar ones
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = both.select("space", node("s", "a").alias("u"), node("s", "b").alias("v")).unionByName(in_group.select("space", node("s", "set").alias("u"), node("i", "id").alias("v"))).unionByName(in_group.select("space", node("i", "id").alias("u"), node("s", "set").alias("v")))
    label = components(materialise(edges.distinct(), "group-edges"))
    ids = in_group.groupBy("space", "id").agg(F.max("links").alias("links")).join(label.select("space", F.expr("substring(v, 2)").alias("id"), "label", F.expr("left(v, 1)").alias("kind")).where("kind = 'i'"), ["space", "id"])
    head = ids.groupBy("space", "label").agg(F.min("id").alias("group_id"))
    return ids.join(head, ["space", "label"]).select("space", "id", "group_id", "links")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(space, v, label): connected vertices share a label. edges (space, u, v) in both directions.

    Each round takes the smallest label among the neighbours, then the label of that label; every round is written to
    the shared folder, and the labels stay distributed.
    """
    labels = edges.groupBy("space", F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
    labels = materialise(labels, "labels")
    for _ in range(rounds):
        near = edges.join(labels.select("space", F.col("v").alias("u"), "label"), ["space", "u"]).groupBy("space", "v").agg(F.min("label").alias("near"))
        better = labels.join(near, ["space", "v"]).select("space", "v", "label", F.least("label", "near").alias("next"))
        jump = labels.select("space", F.col("v").alias("next"), F.col("label").alias("far"))
        after = materialise(better.join(jump, ["space", "next"], "left").select("space", "v", F.coalesce(F.least("next", "far"), "next").alias("new"), "label"), "labels")
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("space", "v", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
