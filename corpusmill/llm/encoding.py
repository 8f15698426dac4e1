"""Garbled text from wrong character encoding: noisy-channel decoding of byte lattices (problem 9).

The channel: text was written as UTF-8 and read in another encoding, once or more, and characters that encoding lacks
were lost; or bytes of another encoding were read as UTF-8 and lost as U+FFFD; or bytes of one single-byte encoding
were read as another. For each run of characters outside ASCII the bytes it stands for in each of the wrong encodings
are laid out as a lattice, with a wildcard where a byte was lost. Viterbi search finds the best reading of the lattice
as UTF-8 under the frequencies of the corpus: of its characters, and of its tokens, which also fill in lost
characters. A token in one single-byte encoding read as another shows by the frequencies alone: its other reading is a
more frequent token, and its characters are strange where they stand.

Tokens with characters outside ASCII are counted over all documents and each distinct one is searched once, whatever
its length and count. What the search has to know of other tokens is joined to it; only counts of characters are
broadcast. Documents are read twice and, unless there are very many different damaged tokens, never shuffled.
"""

from __future__ import annotations

import functools
import html
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialise

LOST = "�"
BLANKS = re.compile(r"([ \t\r\n\f\v]+)")
ENTITY = re.compile(r"&#(?:\d{2,7}|[xX][0-9a-fA-F]{2,6});|&[A-Za-z]{2,8};")
OUTSIDE = re.compile(r"[^\x00-\x7f]+")
C1 = re.compile(r"[\x80-\x84\x86-\x9f]")

# encodings in which UTF-8 is read by mistake; those of two bytes and of Cyrillic letters only for whole runs
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250")
WHOLE = ("cp1251", "gbk", "koi8_r", "cp866", "big5")
NOT_IN_CP1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


# pairs of single-byte encodings of which one was read as the other
SWAPPED = ("cp1252", "cp1250", "cp1251", "mac_roman", "iso8859_2", "cp437", "cp850", "koi8_r")


def plausible(c: str) -> bool:
    """Characters that texts in the languages of Europe, Vietnamese and Chinese hold, and those that UTF-8 read twice holds."""
    o = ord(c)
    return (
        0x80 <= o <= 0x17F or o in (0x192, 0x1A0, 0x1A1, 0x1AF, 0x1B0, 0x2C6, 0x2DC, 0xFEFF) or 0x300 <= o <= 0x323 or 0x400 <= o <= 0x45F or 0x490 <= o <= 0x491
        or 0x1E00 <= o <= 0x1EFF or 0x2010 <= o <= 0x2044 or 0x20A0 <= o <= 0x20BF or 0x2100 <= o <= 0x22FF or 0x3000 <= o <= 0x303F or 0x4E00 <= o <= 0x9FFF or 0xFF00 <= o <= 0xFFEF
    )


def readable(c: str) -> bool:
    """Characters that a sequence may be read as: all that are assigned. What is not plausible() needs more than one of its script."""
    return plausible(c) or unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc")


@functools.cache
def _byte_of(codec: str, c: str) -> bytes | None:
    """The bytes that were read as c; None if that encoding has no such character. C1 controls stand for themselves."""
    if c == LOST:
        return b""
    try:
        return c.encode(codec)
    except UnicodeEncodeError:
        return bytes([ord(c)]) if codec == "cp1252" and 0x80 <= ord(c) <= 0xFF else None


class Model:
    """Frequencies of the corpus and the search under them.

    char: how often characters outside ASCII occur in sound tokens; alone: how often as tokens of their own. Of tokens
    only those are known that known() was given; what else the search would know is noted in asked.
    """

    def __init__(self, char: dict[str, int] | None = None, alone: dict[str, int] | None = None):
        total = sum((char or {}).values()) or 1
        self.char = {c: math.log(n / total) for c, n in sorted((char or {}).items())}
        self.floor = math.log(0.5 / total) - 1
        self.alone = sorted((alone or {}).items(), key=lambda x: (-x[1], x[0]))
        self.filled: dict[tuple, list[str]] = {}
        self.answers: dict[str, tuple[int, str] | None] = {}
        self.asked: list[str] = []

    def fix(self, token: str, kind: str, answers: dict[str, tuple[int, str] | None]) -> tuple[str, int, bool]:
        """(the token restored, layers of wrong decoding undone or losses seen, whether all is restored)."""
        self.answers, self.asked = answers, []
        return self._fix(token, kind)

    def _like(self, pattern: str) -> tuple[int, str] | None:
        """The most frequent sound token that equals the pattern, a lost character standing for any outside ASCII."""
        if pattern not in self.answers and pattern not in self.asked:
            self.asked.append(pattern)
        return self.answers.get(pattern)

    def _log(self, c: str) -> float:
        return self.char.get(c, self.floor) if self.char else -6.0

    def _read(self, lattice: list[tuple[int | None, int]], run: str, codec: str, attached: bool) -> tuple[float, str, int] | None:
        """Viterbi over a lattice of (byte or wildcard, its character in the run): (score, text, sequences read).

        An edge reads one UTF-8 sequence of two to four bytes, or an ASCII byte; in encodings that are not for whole runs
        also a character of the run as it stands, at a price. None if nothing can be read. attached: a word precedes.
        """
        n, keep = len(lattice), codec not in WHOLE
        best: list[tuple[float, int, str, int] | None] = [None] * (n + 1)
        best[0] = (0.0, -1, "", 0)

        def put(j: int, score: float, i: int, text: str, read: int) -> None:
            if best[j] is None or score > best[j][0]:
                best[j] = (score, i, text, read)

        for i in range(n):
            if best[i] is None:
                continue
            score, _, _, read = best[i]
            b = lattice[i][0]
            if b is not None and b < 0x80:
                put(i + 1, score, i, chr(b), read)
                continue
            for length, low, high in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
                if i + length > n or b is None or not low <= b <= high:
                    continue
                tail = [x[0] for x in lattice[i + 1 : i + length]]
                if any(x is not None and not 0x80 <= x <= 0xBF for x in tail):
                    continue
                for c in self._fills(b, tail, codec):
                    # a lost byte is guessed: after a word a quotation's end, alone a dash
                    liked = 8.0 if None in tail and c == ("”" if attached else "—") else 0.0
                    put(i + length, score + self._log(c) + liked, i, c, read + 1)
            if keep:
                at = lattice[i][1]
                if i == 0 or lattice[i - 1][1] != at:
                    j = i
                    while j < n and lattice[j][1] == at:
                        j += 1
                    put(j, score - 25.0, i, run[at], read)
        if best[n] is None or best[n][3] == 0:
            return None
        text, i = [], n
        while i > 0:
            text.append(best[i][2])
            i = best[i][1]
        return best[n][0], "".join(reversed(text)), best[n][3]

    def _fills(self, lead: int, tail: list[int | None], codec: str) -> list[str]:
        """The characters whose UTF-8 has these bytes; a lost one is one that the encoding has no character for."""
        if None not in tail:
            try:
                c = bytes([lead, *tail]).decode("utf-8")
            except UnicodeDecodeError:
                return []
            return [c] if readable(c) else []
        key = (lead, *tail, codec == "cp1252")
        if key not in self.filled:
            pattern, out = [lead, *tail], []
            for c in self.char:  # lost bytes: characters of the corpus
                raw = c.encode("utf-8", "replace")
                if len(raw) == len(pattern) and all(p == r or p is None and (codec != "cp1252" or r in NOT_IN_CP1252) for p, r in zip(pattern, raw, strict=True)) and plausible(c):
                    out.append(c)
            self.filled[key] = out or ([LOST] if lead in (0xC3, 0xE2) else [])
        return self.filled[key]

    def _decode(self, token: str) -> str | None:
        """The token with its garbled runs read as UTF-8, or None if none is garbled."""
        best: tuple[float, str] | None = None
        for codec in SINGLE + WHOLE:
            out, score, read, at = [], 0.0, 0, 0
            for m in OUTSIDE.finditer(token):
                run = m[0]
                # a byte lost at the end of a run may show as a question mark
                tail = token[m.end()] if m.end() < len(token) and token[m.end()] == "?" else ""
                got = None
                for lattice, used in self._lattices(run, tail, codec):
                    got = self._read(lattice, run + LOST, codec, m.start() > 0)
                    if got and self._fits(token, run, got[1], codec):
                        got = (*got, used)
                        break
                    got = None
                if got:
                    out += [token[at : m.start()], got[1]]
                    at = m.end() + got[3]
                    score += got[0]
                    read += got[2]
            if read:
                text = "".join(out) + token[at:]
                letters = [c for c in text if c.isalpha()]
                if any("Ѐ" <= c <= "ӿ" for c in letters) and (any(c.isascii() for c in letters) or len(letters) < 2):
                    continue  # Cyrillic and Latin letters in one token are not what was written
                score += 2.0 * read
                known = self._like(text) if LOST not in text else None
                score += math.log(1 + known[0]) if known else 0.0
                # fewer characters are left outside ASCII by the right reading
                score -= 3.0 * sum(map(len, OUTSIDE.findall(text)))
                if best is None or score > best[0]:
                    best = (score, text)
        return best[1] if best else None

    def _lattices(self, run: str, tail: str, codec: str) -> Iterator[tuple[list[tuple[int | None, int]], int]]:
        # as it is; with the last byte lost without a trace, or shown as a question mark
        for used, lost in ((1, True), (0, False)) if tail else ((0, False), (0, True)) if codec == "cp1252" else ((0, False),):
            lattice: list[tuple[int | None, int]] = []
            for k, c in enumerate(run + (LOST if lost else "")):
                raw = _byte_of(codec, c)
                if raw is None:
                    if codec in WHOLE:
                        break
                    lattice.append((0xFF, k))  # not a byte of UTF-8: such a character can only be kept
                elif raw == b"":
                    lattice.append((None, k))
                else:
                    lattice += [(b, k) for b in raw]
            else:
                # of what left no trace of its own only the last byte of three is looked for
                ends = [x[0] for x in lattice[-3:-1]]
                if not lost or len(ends) == 2 and None not in ends and 0xE0 <= ends[0] <= 0xEF and 0x80 <= ends[1] <= 0xBF:
                    yield lattice, used

    @staticmethod
    def _fits(token: str, run: str, text: str, codec: str) -> bool:
        if text == run:
            return False
        if all("─" <= c <= "▟" for c in token) and not (len(text) > 1 and all("а" <= c <= "ё" for c in text.lower())):
            return False  # lines drawn on purpose
        if codec in WHOLE and sum("一" <= c <= "鿿" for c in text) == 1:
            return False
        # letters of other scripts come in words: one letter of two bytes alone is more likely what stands there
        strange = [c for c in text if not c.isascii() and c != LOST and not plausible(c)]
        return not strange or len(strange) > 1 and codec not in WHOLE or ord(strange[0]) >= 0x800 and codec == "cp1252"

    def _fix(self, token: str, kind: str) -> tuple[str, int, bool]:
        text, layers = token, 0
        if "&" in text and ENTITY.search(text):
            plain = html.unescape(text)
            if plain != text and self._decode(plain) is not None:
                text, layers = plain, 1
        for _ in range(4):
            better = self._decode(text) if OUTSIDE.search(text) else None
            if better is None or better == text:
                break
            text, layers = better, layers + 1
        m = re.fullmatch(r"(.*[a-zß-ÿ])?Ã", text)
        if m:  # the second byte of à, a no-break space, became a blank
            text, layers = (m[1] or "") + "à", layers + 1
        whole = True
        if LOST in text:
            layers += 1
            text, whole = self._fill(text, kind)
        if C1.search(text):
            layers += 1
            plain = C1.sub(lambda c: bytes([ord(c[0])]).decode("cp1252", "replace"), text)
            text, whole = plain, whole and LOST not in plain
        return text, layers, whole

    def _fill(self, token: str, kind: str) -> tuple[str, bool]:
        """Lost characters of a token filled in from the most frequent token of the corpus that is alike."""
        if token == LOST:  # a sign alone: a section or paragraph before a number
            fit = [c for c, _ in self.alone if (c in "§¶№") == (kind == "9")] or [c for c, _ in self.alone]
            return (fit[0], True) if fit else (token, False)
        known = self._like(token)
        if known:
            return known[1], True
        # without quotation marks and stops at its ends, or in small letters
        for a, b in ((1, 0), (0, 1), (1, 1)):
            core = token[a : len(token) - b]
            if len(core) < len(token) and core.strip(LOST):
                inner = (self._like(core) or (0, ""))[1] if LOST in core else core
                head, tail = token[:a], token[len(token) - b :] if b else ""
                if inner:
                    head = "“" if head == LOST else head
                    tail = "”" if tail == LOST else tail
                    return head + inner + tail, LOST not in head + inner + tail
        low = token.lower()
        if low != token and len(low) == len(token):
            done, whole = self._fill(low, kind)
            if whole and len(done) == len(token):
                return "".join(c.upper() if t.isupper() or (t == LOST and token.isupper()) else c for c, t in zip(done, token, strict=True)), True
        return token, False


def kind_of(after: str) -> str:
    return "9" if after[:1].isdigit() else "a"


def swaps(token: str) -> set[str]:
    """What the token would be if its bytes were of another single-byte encoding than they were read in."""
    out = set()
    for read in SWAPPED:
        try:
            raw = token.encode(read)
        except UnicodeEncodeError:
            continue
        for written in SWAPPED:
            if written != read:
                try:
                    out.add(raw.decode(written))
                except UnicodeDecodeError:
                    pass
    # a sign that stands alone has no neighbours among which it would be strange
    return {x for x in out - {token} if any(c.isalpha() and d != c and (i > 0 and x[i - 1].isalpha() or x[i + 1 : i + 2].isalpha()) for i, (c, d) in enumerate(zip(x, token)))}


def stem_of(token: str) -> str:
    """The word in a token: without punctuation around it and what follows an apostrophe."""
    return re.split("[’']", token.strip(".,;:!?()[]{}<>\"*_`#|“”«»„—–-…¿¡"), maxsplit=1)[0]


def trigrams(token: str, other: str | None = None) -> list[str]:
    """The characters outside ASCII with those before and after them; only where the other token differs, if one is given."""
    t = f" {token} ".lower()
    o = f" {other} ".lower() if other is not None else None
    if o is not None and len(o) != len(t):
        o = None
    return [t[i - 1 : i + 2] for i in range(1, len(t) - 1) if ord(t[i]) > 127 and (o is None or o[i] != t[i])]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


NOT_ASCII = r"[^\x00-\x7F]"
TOKEN = pa.schema([("token", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("sound", pa.bool_())])
SETTLED = pa.schema([("token", pa.string()), ("kind", pa.string()), ("fixed", pa.string()), ("layers", pa.int32()), ("whole", pa.bool_()), ("asked", pa.list_(pa.string()))])
ANSWERS = "array<struct<pattern:string,n:bigint,like:string>>"
BROADCAST_CHARS = 20_000_000  # of damaged tokens and what they are restored to; beyond that they are joined


def _first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Model()
    for b in batches:
        rows = [(t, k, n, LOST not in t and not C1.search(t) and model.fix(t, k, {})[1] == 0) for t, k, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield _batch(rows, TOKEN)


def distinct_tokens(texts: DataFrame) -> DataFrame:
    """(token, kind, n, sound): tokens of all texts with characters outside ASCII or references; kind '9' stands before a figure.

    sound: whether nothing in the token itself shows a wrong decoding. All tokens are kept, however long or rare.
    """
    parts = F.split("text", r"[ \t\r\n\f\x0B]+")
    # only for a token of a character or two it matters what follows
    with_next = F.transform(F.col("parts"), lambda x, i: F.struct(x.alias("token"), F.when((F.length(x) <= 2) & F.coalesce(F.get(F.col("parts"), i + 1), F.lit("")).rlike(r"^\p{Nd}"), "9").otherwise("a").alias("kind")))
    odd = F.filter(with_next, lambda x: x["token"].rlike(NOT_ASCII) | x["token"].rlike(r"&#|&[A-Za-z]{2,8};"))
    counts = texts.select(parts.alias("parts")).select(F.inline(odd)).groupBy("token", "kind").agg(F.count("*").alias("n"))
    return materialise(counts.mapInArrow(_first_look, "token string, kind string, n long, sound boolean"), "tokens")


def swapped_tokens(lexicon: DataFrame) -> DataFrame:
    """(token, fixed) of the tokens whose word is another, more frequent one read in another single-byte encoding.

    lexicon: (token, n, mask). What differs has to be strange where it stands: no word without such a reading has the
    same character between the same neighbours.
    """

    def mapped(df: DataFrame, f, schema: str) -> DataFrame:
        types = {"string": pa.string(), "long": pa.int64()}
        arrow = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _batch([r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in f(*row)], arrow)

        return df.mapInArrow(run, schema)

    words = mapped(lexicon.select("token", "n"), lambda t, n: [(t, stem_of(t), n)], "token string, word string, n long").where(F.col("word").rlike(NOT_ASCII))
    words = materialise(words, "words")
    every = words.groupBy("word").agg(F.sum("n").alias("n"))
    read = mapped(every, lambda w, n: [(w, n, x) for x in sorted(swaps(w))], "word string, n long, fixed string")
    read = read.join(every.select(F.col("word").alias("fixed"), F.col("n").alias("m")), "fixed").where("m > n")
    best = materialise(read.groupBy("word").agg(F.max(F.struct("m", "fixed"))["fixed"].alias("fixed")), "swapped")
    mine = mapped(best, lambda w, o: [(w, g) for g in set(trigrams(w, o))], "word string, gram string")
    others = mapped(every.join(best, "word", "left_anti").select("word"), lambda w: [(g,) for g in set(trigrams(w))], "gram string").distinct()
    usual = mine.join(others, "gram", "left_semi").select("word").distinct()
    found = words.join(best.join(usual, "word", "left_anti"), "word")
    return mapped(found.select("token", "word", "fixed"), lambda t, w, o: [(t, t.replace(w, o, 1))], "token string, fixed string")


def damaged_tokens(tokens: DataFrame, rounds: int = 12) -> DataFrame:
    """(token, kind, fixed, whole) of the tokens of distinct_tokens() that show a wrong decoding.

    The search names the tokens it would have to know; these are looked up by joins with all sound tokens, and it runs
    again with the answers until it asks for no more.
    """
    spark = tokens.sparkSession
    lexicon = tokens.where("sound").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("token").rlike(NOT_ASCII)).withColumn("mask", F.regexp_replace("token", NOT_ASCII, LOST))
    lexicon = materialise(lexicon, "lexicon")
    swapped = materialise(swapped_tokens(lexicon), "swapped-tokens")
    lexicon = lexicon.join(swapped.select("token"), "token", "left_anti")
    single = F.regexp_extract_all("token", F.lit(f"({NOT_ASCII})"), F.lit(1))
    char = {r["c"]: r["n"] for r in lexicon.select(F.explode(single).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).collect()}  # at most as many as Unicode has
    alone = {r["token"]: r["n"] for r in lexicon.where("length(token) = 1").select("token", "n").collect()}  # the same
    held = spark.sparkContext.broadcast((char, alone))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for b in batches:
            rows = []
            for t, k, answers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fixed, layers, whole = model.fix(t, k, {a["pattern"]: (a["n"], a["like"]) if a["n"] else None for a in answers})
                rows.append((t, k, fixed, layers, whole, model.asked))
            yield _batch(rows, SETTLED)

    todo = tokens.where("NOT sound").select("token", "kind", F.expr(f"CAST(array() AS {ANSWERS})").alias("answers"))
    done = swapped.select("token", F.explode(F.array(F.lit("a"), F.lit("9"))).alias("kind"), "fixed", F.lit(True).alias("whole"))
    for k in range(rounds):
        out = materialise(todo.mapInArrow(settle, "token string, kind string, fixed string, layers int, whole boolean, asked array<string>"), "settled")
        last = k == rounds - 1  # layers are at most four, so it never asks that often
        done = done.unionByName(out.where(F.lit(last) | (F.size("asked") == 0)).where("layers > 0").select("token", "kind", "fixed", "whole"))
        open_ = out.where("size(asked) > 0").select("token", "kind", "asked")
        if last or not open_.limit(1).count():
            break
        need = materialise(open_.select(F.explode("asked").alias("pattern")).distinct(), "patterns")
        exact = need.where(~F.col("pattern").contains(LOST)).join(lexicon, F.col("pattern") == F.col("token")).select("pattern", "n", "token")
        wild = need.where(F.col("pattern").contains(LOST)).withColumn("mask", F.regexp_replace("pattern", NOT_ASCII, LOST)).join(lexicon, "mask")
        fits = F.forall(F.zip_with(F.split("pattern", ""), F.split("token", ""), lambda x, y: (x == y) | (x == LOST)), lambda ok: ok)
        found = exact.unionByName(wild.where(fits).select("pattern", "n", "token")).groupBy("pattern").agg(F.min(F.struct((-F.col("n")).alias("n"), "token")).alias("b"))
        answers = need.join(found, "pattern", "left").select("pattern", F.struct("pattern", F.coalesce(-F.col("b.n"), F.lit(0)).alias("n"), F.col("b.token").alias("like")).alias("answer"))
        new = open_.select("token", "kind", F.explode("asked").alias("pattern")).join(answers, "pattern").groupBy("token", "kind").agg(F.collect_list("answer").alias("new"))
        todo = todo.join(new, ["token", "kind"]).select("token", "kind", F.concat("answers", "new").alias("answers"))
    return done


RESTORED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_garbled", pa.int32()), ("n_left", pa.int32())])


def restore(text: str, damaged: dict[tuple[str, str], tuple[str, bool]]) -> tuple[str, int, int]:
    """(text restored as far as possible, damaged tokens, of these not restored in full)."""
    parts = BLANKS.split(text)
    bad = left = 0
    for i in range(0, len(parts), 2):
        t = parts[i]
        if t and (not t.isascii() or "&" in t):
            kind = kind_of(parts[i + 2]) if len(t) <= 2 and i + 2 < len(parts) else "a"
            fixed = damaged.get((t, kind))
            if fixed:
                parts[i] = fixed[0]
                bad += 1
                left += not fixed[1]
    return "".join(parts), bad, left


def restore_encoding(documents: DataFrame) -> DataFrame:
    """(doc_id, text restored, n_garbled tokens, n_left of them not restored in full) of the documents with garbled text.

    documents: doc_id, text; other columns are not read. Null ids and texts, empty texts, and texts without garbled
    characters give no row; repeated rows come out as often as they go in; an empty table gives none. A text in ASCII
    without character references can't show a wrong decoding.
    """
    rows = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    suspect = rows.where(F.col("text").rlike(NOT_ASCII + r"|&#|&[A-Za-z]{2,8};"))
    damaged = materialise(damaged_tokens(distinct_tokens(suspect)), "damaged")
    chars = damaged.agg(F.coalesce(F.sum(F.length("token") + F.length("fixed")), F.lit(0))).first()[0]

    if chars <= BROADCAST_CHARS:
        held = documents.sparkSession.sparkContext.broadcast({(r["token"], r["kind"]): (r["fixed"], r["whole"]) for r in damaged.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = ((d, *restore(t, held.value)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                yield _batch([r for r in out if r[2]], RESTORED)

        return suspect.mapInArrow(run, "doc_id long, text string, n_garbled int, n_left int")

    parts = F.split("text", r"[ \t\r\n\f\x0B]+")
    own = suspect.select("doc_id", F.explode(F.array_distinct(parts)).alias("token")).join(damaged, "token").groupBy("doc_id").agg(F.collect_set(F.struct("token", "kind", "fixed", "whole")).alias("own"))

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ((d, *restore(t, {(x["token"], x["kind"]): (x["fixed"], x["whole"]) for x in o})) for d, t, o in zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield _batch([r for r in out if r[2]], RESTORED)

    return suspect.join(own, "doc_id").select("doc_id", "text", "own").mapInArrow(run_own, "doc_id long, text string, n_garbled int, n_left int")
