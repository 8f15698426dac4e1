"""Evaluation texts leaking into training text: q-gram lemma filter and banded alignment (problem 7).

Both sides are brought to words: letter case, punctuation, markup, page anchors and line breaks are gone, one blank
stands between words. A stretch of w words with e of them changed keeps at least L + 1 - q - e (q + m) of its
character q-grams, L being its length and m that of a word, and it keeps them near one diagonal. So the q-grams a
document shares with an item are counted in overlapping bands of diagonals, and a band is kept if a window of the item
as long as the stretch holds that many. The words along such a band are compared, and what still can reach the budget
is settled by an alignment banded around the diagonal.

The evaluation set is the query set: it is indexed in blocks of bounded size, each broadcast; documents are read once
for each block and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialise

MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,200}>|&(?:nbsp|amp|lt|gt|quot|#\d+|#x[0-9a-fA-F]+);", re.S)
EMPHASIS = re.compile(r"[*_`~]+|­|[​-‍﻿]")
BROKEN = re.compile(r"(?<=\w)-[ \t]*(?:\r\n|\n|\r)[ \t]*(?=\w)")
WORDS = re.compile(r"[^\W_]+")

LENGTHS = (16, 12, 8, 6, 4)  # of the q-grams: an item takes the longest whose bound leaves something to count
BAND = 32  # diagonals to a half band; each hit counts in two overlapping bands of twice that
WIDTH = 8  # words to either side of a diagonal that an alignment may stray
BLOCK_CHARS = 4_000_000

FOUND = "doc_id long, query_id string, words int, edits int, item_start int, doc_start int"


def words_of(text: str) -> list[str]:
    """The words of a text, without what does not count."""
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    if "-" in text:
        text = BROKEN.sub("", text)
    if EMPHASIS.search(text):
        text = EMPHASIS.sub("", text)
    return WORDS.findall(text.lower())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def qgrams(a: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each position on, put together from those of half as many."""
    if len(a) < q:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        held, h, size = {1: a}, a, 1
        while size * 2 <= q:
            h = h[:-size] * np.uint64(pow(1000003, size, 1 << 64)) + h[size:]
            size *= 2
            held[size] = h
        out, done = held[size], size
        for k in sorted(held, reverse=True):  # the rest of q in powers of two
            while done + k <= q:
                more = held[k][done:]
                n = min(len(out), len(more))
                out, done = out[:n] * np.uint64(pow(1000003, k, 1 << 64)) + more[:n], done + k
        return out[: len(a) - q + 1] * np.uint64(0x9E3779B97F4A7C15)


def _starts(words: list[str]) -> np.ndarray:
    """The character at which each word begins in the words joined by blanks."""
    return np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]]).astype(np.int64) if words else np.empty(0, dtype=np.int64)


@dataclass
class Item:
    query_id: str
    ids: np.ndarray  # of its words
    word_of: np.ndarray  # of each character
    first: np.ndarray  # of each stretch of `least` words the place of its first q-gram, and of its last
    last: np.ndarray
    budgets: np.ndarray  # q-grams of each that survive the allowed edits


class Grams:
    """The q-grams of some items: distinct hashes, items and positions sorted by them; and a table that tells most others at once."""

    def __init__(self, q: int, found: list[tuple[int, np.ndarray]]):
        self.q = q
        every = np.concatenate([h for _, h in found])
        order = np.argsort(every, kind="stable")
        self.hashes, self.begin, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.owner = np.concatenate([np.full(len(h), i) for i, h in found])[order]
        self.place = np.concatenate([np.arange(len(h)) for _, h in found])[order]
        self.shift = np.uint64(64 - max(16, int(len(every)).bit_length() + 4))
        self.seen = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.seen[self.hashes >> self.shift] = True


def _flat(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of those sizes laid out one after another: where each begins, of each place its row, and its place in it."""
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    return begin, row, np.arange(int(sizes.sum())) - begin[row]


def _any(flag: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row[flag], minlength=rows) > 0


class Column:
    """An array of each item, all in one, with where each begins."""

    def __init__(self, arrays: list[np.ndarray]):
        self.size = np.array([len(x) for x in arrays], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.all = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)

    def at(self, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.all[self.begin[item] + place]


class Index:
    """The q-grams of a block of evaluation items."""

    def __init__(self, items: list[tuple[str, str]], least: int, rate: float):
        self.least, self.rate = least, rate
        self.vocabulary: dict[str, int] = {}
        self.items: list[Item] = []
        self.edits = round(least * rate + 0.5)
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for query_id, text in items:
            words = words_of(text)
            if len(words) < least:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            starts, size = _starts(words), np.array([len(w) for w in words])
            spans = (starts + size)[least - 1 :] - starts[: len(words) - least + 1]
            # of each stretch the edits may fall on its longest words
            worst = np.sort(np.lib.stride_tricks.sliding_window_view(size, least), axis=1)[:, least - self.edits :].sum(axis=1)
            left = {q: spans + 1 - q - worst - self.edits * q for q in LENGTHS}
            q = next((q for q in LENGTHS if left[q].min() >= 4), LENGTHS[-1])
            by_length.setdefault(q, []).append((len(self.items), qgrams(points(" ".join(words)), q)))
            first = starts[: len(spans)]
            word_of = np.repeat(np.arange(len(words)), size + 1)
            self.items.append(Item(query_id, ids, word_of, first, first + spans - q, np.maximum(1, left[q])))
        self.grams = [Grams(q, found) for q, found in sorted(by_length.items())]
        self.least_budget = np.array([i.budgets.min() for i in self.items], dtype=np.int64)
        column = lambda f: Column([f(i) for i in self.items])
        self.ids, self.word_of = column(lambda i: i.ids), column(lambda i: i.word_of)
        self.first, self.last, self.budgets = column(lambda i: i.first), column(lambda i: i.last), column(lambda i: i.budgets)

    def bands(self, grams: Grams, doc: np.ndarray, at: np.ndarray, which: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, least and greatest shift in words) of the bands of diagonals that meet the bound of a stretch.

        doc, at, which, word: of q-grams of documents their document, place, number among the distinct hashes, and word.
        """
        none = (np.empty(0, dtype=np.int64),) * 4
        _, row, k = _flat(grams.times[which])
        entry = grams.begin[which][row] + k
        item, place = grams.owner[entry], grams.place[entry]
        doc, at, word = doc[row], at[row], word[row]
        pair = doc * len(self.items) + item
        if int(pair.max()) < 20 * len(pair):
            count = np.bincount(pair)[pair]
        else:
            _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
            count = count[inverse]
        keep = count >= self.least_budget[item]
        if not keep.any():
            return none
        pair, item, place, at, word = pair[keep], item[keep], place[keep], at[keep], word[keep]
        # each hit is in two bands, each of two half bands; a place of the item counts once in a band
        half = (at - place) // BAND
        half -= half.min() - 1
        wide, long = int(half.max()) + 2, int(place.max()) + 1
        # first by half bands: what lies in no band with hits enough, repeats and all, goes
        cell = pair * wide + half
        if int(cell.max()) < 40 * len(cell):
            count = np.bincount(cell, minlength=int(cell.max()) + 2)
            count = count[cell] + np.maximum(count[cell + 1], count[cell - 1])
        else:
            cells, inverse, own = np.unique(cell, return_inverse=True, return_counts=True)
            beside = lambda d: np.where((x := np.searchsorted(cells, cells + d)) < len(cells), own[np.minimum(x, len(cells) - 1)] * (cells[np.minimum(x, len(cells) - 1)] == cells + d), 0)
            count = (own + np.maximum(beside(1), beside(-1)))[inverse]
        keep = count >= self.least_budget[item]
        if not keep.any():
            return none
        pair, item, place, half, word = pair[keep], item[keep], place[keep], half[keep], word[keep]
        shift = word - self.word_of.at(item, place)
        key = (np.concatenate([pair * wide + half, pair * wide + half - 1])) * long + np.concatenate([place, place])
        order = np.argsort(key, kind="stable")
        key, shift = key[order], np.concatenate([shift, shift])[order]
        band = key // long
        new = np.append(True, band[1:] != band[:-1])
        begin = np.flatnonzero(new)
        fresh = np.append(True, key[1:] != key[:-1])
        count = np.add.reduceat(fresh.astype(np.int64), begin)
        owner = band[begin] // wide % len(self.items)
        good = np.flatnonzero(count >= self.least_budget[owner])
        if not len(good):
            return none
        # of the rest every stretch of the item is held against its own bound
        low, high = np.minimum.reduceat(shift, begin)[good], np.maximum.reduceat(shift, begin)[good]
        place_of = np.full(len(begin), -1)
        place_of[good] = np.arange(len(good))
        of = place_of[np.cumsum(new) - 1]
        mine = (of >= 0) & fresh
        owner, where = owner[good], band[begin][good] // wide // len(self.items)
        offset = np.cumsum(self.word_of.size[owner] + 1) - self.word_of.size[owner] - 1
        had = np.zeros(int(offset[-1] + self.word_of.size[owner[-1]]) + 2, dtype=np.int64)
        had[offset[of[mine]] + key[mine] % long + 1] = 1
        sums = had.cumsum()
        _, row, k = _flat(self.first.size[owner])
        enough = sums[offset[row] + self.last.at(owner[row], k) + 1] - sums[offset[row] + self.first.at(owner[row], k)] >= self.budgets.at(owner[row], k)
        some = _any(enough, row, len(owner))
        return where[some], owner[some], low[some], high[some]

    def alike(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Of alignments (words of a document, item, diagonal) whether enough words of some stretch are found near the diagonal."""
        _, row, k = _flat(self.ids.size[item])
        mine = self.ids.at(item[row], k)
        same = np.zeros(len(row), dtype=bool)
        for near in range(-WIDTH, WIDTH + 1):
            at = k + shift[row] + near
            inside = (at >= 0) & (at < size[row])
            same |= inside & (ids[np.where(inside, begin[row] + at, 0)] == mine)
        sums = np.append(0, np.cumsum(same))
        stretches = k + self.least <= self.ids.size[item][row]
        at = np.flatnonzero(stretches)
        enough = sums[at + self.least] - sums[at] >= self.least - self.edits
        return _any(enough, row[at], len(item))

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int, int, int]]]:
        """Of each text (query_id, words, edits, item_start, doc_start) of the items of which it holds a stretch.

        All texts are hashed, and their bands counted, at once; only what still can be a stretch is aligned on its own.
        """
        if not self.items or not texts:
            return [[] for _ in texts]
        words = [w if len(w) >= self.least - self.edits else [] for w in map(words_of, texts)]
        joined = [" ".join(w) for w in words]
        a = points("\x00".join(joined) + "\x00")
        ends = np.cumsum([len(t) + 1 for t in joined])
        begin = np.append(0, ends[:-1])
        blanks = np.cumsum(a == 32)
        best: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        for grams in self.grams:
            h = qgrams(a, grams.q)
            hit = np.flatnonzero(grams.seen[h >> grams.shift])
            doc = np.searchsorted(ends, hit, "right")
            inside = hit + grams.q < ends[doc]
            hit, doc = hit[inside], doc[inside]
            which = np.minimum(np.searchsorted(grams.hashes, h[hit]), len(grams.hashes) - 1)
            real = grams.hashes[which] == h[hit]
            hit, doc, which = hit[real], doc[real], which[real]
            if not len(hit):
                continue
            word = blanks[hit] - blanks[begin[doc]]
            d, item, low, high = self.bands(grams, doc, hit - begin[doc], which, word)
            if not len(d):
                continue
            # an alignment covers WIDTH diagonals to either side: as many of them as cover the band
            _, row, k = _flat((high - low) // (WIDTH + 1) + 1)
            todo = np.unique(np.stack([d[row], item[row], low[row] + k * (WIDTH + 1) + WIDTH // 2], axis=1), axis=0)
            used = np.unique(todo[:, 0])
            size = np.array([len(w) for w in words])
            ids, at = [], np.zeros(len(texts), dtype=np.int64)
            for x in used.tolist():
                at[x] = len(ids)
                ids += [self.vocabulary.get(w, -1) for w in words[x]]
            ids = np.array(ids, dtype=np.int64)
            ok = self.alike(ids, at[todo[:, 0]], size[todo[:, 0]], todo[:, 1], todo[:, 2])
            for x, i, shift in todo[ok].tolist():
                found = stretch(self.items[i].ids, ids[at[x] : at[x] + size[x]], shift, self.least, self.rate)
                if found and (i not in best[x] or found[0] > best[x][i][0]):
                    best[x][i] = found
        return [[(self.items[i].query_id, *f) for i, f in b.items()] for b in best]


def stretch(item: np.ndarray, doc: np.ndarray, shift: int, least: int, rate: float, width: int = WIDTH) -> tuple[int, int, int, int] | None:
    """The longest stretch of at least `least` words of the item that an alignment around the diagonal `shift` finds in
    the document with at most rate x its words changed, added or dropped: (words, edits, item_start, doc_start)."""
    g = len(item)
    near = np.arange(g)[:, None] + np.arange(shift - width, shift + width + 1)[None, :]
    inside = (near >= 0) & (near < len(doc))
    same = inside & (doc[np.clip(near, 0, len(doc) - 1)] == item[:, None])
    runs = np.concatenate([[0], np.cumsum(same.any(axis=1))])
    if (runs[least:] - runs[:-least]).max() < least - round(least * rate + 0.5):
        return None
    # local alignment in the band: a match adds 1, an edit takes 2
    w = 2 * width + 1
    score = np.zeros((g + 1, w + 2))
    move = np.zeros((g + 1, w + 2), dtype=np.int8)  # 0 start, 1 match, 2 changed, 3 dropped from the item, 4 added to it
    rows, ok = same.tolist(), inside.tolist()
    top, end = 0.0, None
    prev = [0.0] * (w + 2)
    for i in range(1, g + 1):
        cur = [0.0] * (w + 2)
        steps = [0] * (w + 2)
        for j in range(1, w + 1):
            if not ok[i - 1][j - 1]:
                continue
            # same diagonal: item and document move on; one to the right above: the item's word is dropped
            hit = rows[i - 1][j - 1]
            v, m = prev[j] + (1 if hit else -2), 1 if hit else 2
            if (x := prev[j + 1] - 2) > v:
                v, m = x, 3
            if (x := cur[j - 1] - 2) > v:
                v, m = x, 4
            if v > 0:
                cur[j], steps[j] = v, m
                if v > top:
                    top, end = v, (i, j)
        prev = cur
        score[i] = cur
        move[i] = steps
    best = None
    # the best alignment; and, if another one elsewhere could do, the best that ends in each row
    ends = [end] if end else []
    ends += [(i, int(score[i].argmax())) for i in range(least, g + 1) if score[i].max() >= least * (1 - 3 * rate) - 2.5]
    seen = set()
    for i, j in ends:
        path = []
        while i > 0 and (m := move[i, j]):
            if (i, j) in seen and len(path) == 0:
                break
            path.append((i - 1, i - 1 + shift - width + j - 1, m))
            if m in (1, 2):
                i -= 1
            elif m == 3:
                i, j = i - 1, j + 1
            else:
                j -= 1
        if not path:
            continue
        seen.update((p[0] + 1, p[1] - p[0] - shift + width + 1) for p in path)
        path.reverse()
        takes = np.cumsum([0] + [p[2] != 4 for p in path])
        edits = np.cumsum([0] + [p[2] != 1 for p in path])
        # the longest part with takes >= least and edits <= rate * takes
        for a in range(len(path)):
            if path[a][2] != 1:
                continue
            t, e = takes[a + 1 :] - takes[a], edits[a + 1 :] - edits[a]
            fit = np.flatnonzero((t >= least) & (e <= rate * t))
            if len(fit) and (best is None or t[fit[-1]] > best[0]):
                best = (int(t[fit[-1]]), int(e[fit[-1]]), path[a][0], path[a][1])
    return best


def leaks(documents: DataFrame, items: DataFrame, least: int = 20, rate: float = 1 / 8) -> DataFrame:
    """(doc_id, query_id, words, edits, item_start, doc_start): documents that hold a stretch of an item's text.

    documents: doc_id, text; items: query_id, gold_text; other columns are not read. A stretch is at least `least` words
    of the item in their order, with at most `rate` of them changed, added or dropped; the longest is
    given, its places counted in words from 0. Null texts and ids, and items of fewer than `least` words, give nothing;
    repeated rows give one row; of items with the same text every one is given; empty tables give no rows. Whole texts
    are searched.
    """
    spark = documents.sparkSession
    items = items.where("query_id IS NOT NULL AND gold_text IS NOT NULL").select("query_id", "gold_text").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("gold_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    types = [pa.int64(), pa.string(), *[pa.int32()] * 4]
    names = ["doc_id", "query_id", "words", "edits", "item_start", "doc_start"]
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).orderBy("query_id").collect()  # BLOCK_CHARS characters, about
        index = spark.sparkContext.broadcast(Index([(r.query_id, r.gold_text) for r in rows], least, rate))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 64):  # arrays that stay in the cache; very long texts must not add up
                    part = b.slice(at, 64)
                    said = index.value.find(part.column(1).to_pylist())
                    found = [(d, *f) for d, all_found in zip(part.column(0).to_pylist(), said, strict=True) for f in all_found]
                    cols = list(zip(*found, strict=True)) if found else [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

        part = texts.mapInArrow(search, FOUND)
        if blocks > 1:  # one block's index at a time
            part = materialise(part, "leaks")
            index.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.distinct()
