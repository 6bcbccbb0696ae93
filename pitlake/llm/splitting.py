"""Oversized texts cut at natural boundaries into overlapping pieces within a token limit, by ranges.

A text is read in ranges of fixed length with halos. Each worker finds, in its range alone, the words, their token counts and the natural boundaries;
ranges meet at the first place past their nominal end where every tokenisation parts, which both neighbours find in the halo they share. The boundary
tables are then stitched in order and prefix-summed by a streaming pass that holds one range and one piece at most, and pieces are emitted by offset.
At last each piece's text is cut from the few ranges it touches. A text arrives as one Parquet value and one task holds it whole, about twice, while it
is cut into ranges; only the steps after that work by range. So a task's memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.bpe import VOCABULARY, library, splitter
from pitlake.session import materialised

#: Characters of a range, and of its halos before and after.
RANGE, BEFORE, AFTER = 16_384, 512, 2_048
#: Kinds of boundaries, the strongest first; INSIDE is a place within a word too large to stay whole.
HEADING, PARAGRAPH, ROW, SENTENCE, WORD, INSIDE = 4, 3, 2, 1, 0, -1


#: A boundary table's row: characters and tokens of a word, the kind of its beginning, and how a piece's count changes if it ends before it.
_ROW = np.dtype([("size", "<u2"), ("tokens", "<u4"), ("kind", "i1"), ("tail", "<i2")])


@lru_cache(maxsize=1)
def _patterns():
    import regex

    return {
        "words": splitter(),
        "sync": regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"),
        "ends": regex.compile(r"[.!?…]+[\"'”’»)\]]*$"),
        "ends_close": regex.compile(r"[。！？]+[”」』）]*$"),
        "heading": regex.compile(r"[ \t]*(?:#{1,6}[ \t]|(?:Item|Section|Part|Chapter|Abschnitt|Kapitel|Partie)[ \t]+[\dIVX]+|\p{Lu}[\p{Lu}\d &,'\-]{3,78}(?:[\n\r]|\Z))"),
    }


def _sync(prev: str, ahead: str) -> int:
    """How far past a range's nominal start the ranges meet; 0 if there is no such place in the halo."""
    m = _patterns()["sync"].search(prev + ahead, len(prev)) if prev else None
    return m.start() - len(prev) if m and m.start() - len(prev) < AFTER else 0


class _Lexicon(dict):
    """The words that a worker has met, by number, and what it knows of them as arrays by that number."""

    #: Characters, tokens, white space alone, begins with white space, line feeds, carriage returns, ends a sentence, ends one in itself.
    FIELDS = ("int64", "int64", "bool", "bool", "int32", "int32", "bool", "bool")
    KEPT = 1_000_000

    def __init__(self, vocabulary: str) -> None:
        self.encode = library(vocabulary).encode_ordinary
        self.columns = [np.zeros(1024, dtype=t) for t in self.FIELDS]
        self.joined: dict[tuple[str, str], int] = {}

    def __missing__(self, w: str) -> int:
        k = self[w] = len(self)
        if k == len(self.columns[0]):
            self.columns = [np.concatenate([c, np.zeros_like(c)]) for c in self.columns]
        other = w.count("\u2028") + w.count("\u2029") * 2 + w.count("\x85")
        ends, closes = _patterns()["ends"].search(w) is not None, _patterns()["ends_close"].search(w) is not None
        of = (len(w), len(self.encode(w)), w.isspace(), w[0].isspace(), w.count("\n") + other, w.count("\r") + other, ends, closes)
        for c, v in zip(self.columns, of, strict=True):
            c[k] = v
        return k

    def __call__(self, words: list[str]) -> list[np.ndarray]:
        """FIELDS of each word."""
        if len(self) > self.KEPT:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return [c[numbers] for c in self.columns]

    def change(self, a: str, b: str) -> int:
        """By how much the tokens of two words of white space change when they are one."""
        n = self.joined.get((a, b))
        if n is None:
            if len(self.joined) > self.KEPT:
                self.joined.clear()
            n = self.joined[a, b] = len(self.encode(a + b)) - len(self.encode(a)) - len(self.encode(b))
        return n


def words_of(before: str, text: str, after: str, last: bool) -> tuple[list[str], int, int]:
    """The words of one range and where it really starts and ends, from its nominal start."""
    start = _sync(before[-1:], (text + after)[:AFTER])
    end = len(text) if last else len(text) + _sync(text[-1:], after[:AFTER])
    return _patterns()["words"]((text + after)[start:end]), start, end


def boundary_table(before: str, text: str, after: str, words: list[str], known: list[np.ndarray], start: int, limit: int, lexicon: _Lexicon) -> np.ndarray:
    """The words of one range as an array of _ROW; words of more than an eighth of the limit are cut into small parts."""
    size, n, blank, leads, feeds, returns, ends, closes = known
    large, inner = max(limit // 8, 4), max(limit // 32, 1)
    kinds = np.full(len(words), WORD, dtype=np.int8)
    # a sentence's end: the word before ends one and white space follows, or it closes in itself
    tail = (before + text)[max(0, len(before) + start - 16) : len(before) + start]
    kinds[1:][(ends[:-1] & leads[1:]) | closes[:-1]] = SENTENCE
    if len(words) and ((_patterns()["ends"].search(tail) and leads[0]) or _patterns()["ends_close"].search(tail)):
        kinds[0] = SENTENCE
    # lines of the white space before a word; a carriage return and a line feed together are one
    up, down = np.cumsum(np.where(blank, feeds, 0)), np.cumsum(np.where(blank, returns, 0))
    filled = np.flatnonzero(~blank)
    if len(filled):
        lines = np.maximum(np.diff(up[filled], prepend=0), np.diff(down[filled], prepend=0))
        kinds[filled[lines >= 1]] = ROW
        kinds[filled[lines >= 2]] = PARAGRAPH
    starts = start + np.cumsum(size) - size
    whole, match = text + after, _patterns()["heading"].match
    for i in filled[kinds[filled] >= ROW]:
        if match(whole, int(starts[i])):
            kinds[i] = HEADING
    tails = np.zeros(len(words), dtype=np.int64)
    # white space before a word is two words in a text, but one at a piece's end
    for i in (np.flatnonzero(blank[1:-1] & blank[:-2] & (n[1:-1] <= large) & (n[:-2] <= large)) + 2).tolist():
        tails[i] = lexicon.change(words[i - 2], words[i - 1])
    out = np.zeros(len(words), dtype=_ROW)
    out["size"], out["tokens"], out["kind"], out["tail"] = size, n, kinds, tails
    if (n > large).any():  # within a large word bytes are counted: however its pieces join, there are no more tokens than that
        parts, at = [], 0
        for i in np.flatnonzero(n > large):
            w = words[i]
            cut = [(len(w[j : j + inner]), len(w[j : j + inner].encode("utf-8", "surrogatepass")), INSIDE if j else kinds[i], 0 if j else tails[i]) for j in range(0, len(w), inner)]
            parts += [out[at:i], np.array(cut, dtype=_ROW)]
            at = i + 1
        out = np.concatenate([*parts, out[at:]])
    return out


class _Stitcher:
    """The pieces of one text, whose boundary tables come in order; holds what isn't emitted yet."""

    def __init__(self, limit: int, overlap: int) -> None:
        self.limit, self.overlap = limit, overlap
        self.starts = self.tokens = self.kinds = self.tails = np.zeros(0, dtype=np.int64)
        self.first = self.cut = 0  # words held: where the next piece starts, and where its new content does
        self.change = 0  # of the count of what the next piece shares
        self.piece = self.total = 0
        self.held: list[tuple] = []  # pieces, as long as the text may be within the limit after all

    def add(self, total: int, start: int, table: np.ndarray, end: int | None) -> list[tuple]:
        """The pieces that are complete with this table, which starts there; total: its tokens; end: the text's, with the last table."""
        size, tokens, kinds, tails = (table[f].astype(np.int64) for f in _ROW.names)
        self.held += self._cut(start + np.cumsum(size) - size, tokens, kinds, tails, end)
        self.total += total
        if self.total <= self.limit:
            return []
        out, self.held = self.held, []
        return out

    def _cut(self, starts: np.ndarray, tokens: np.ndarray, kinds: np.ndarray, tails: np.ndarray, end: int | None) -> Iterator[tuple]:
        """(piece, start, end, tokens, whether they are counted exactly, overlap) of the pieces that are complete now; end: of the text, with its last table."""
        self.starts, self.tokens, self.kinds, self.tails = (np.concatenate(x) for x in ((self.starts, starts), (self.tokens, tokens), (self.kinds, kinds), (self.tails, tails)))
        n = len(self.starts)
        upto = np.concatenate([[0], np.cumsum(self.tokens)])  # prefix sums of the stitched tables
        tails = np.append(self.tails, 0)
        exact = np.concatenate([[0], np.cumsum(self.kinds == INSIDE)])
        natural = np.flatnonzero(self.kinds >= SENTENCE)
        while n:
            i = self.first
            fits = int(np.searchsorted(upto, upto[i] + self.limit, side="right")) - 1
            if fits >= n:
                if end is None:
                    break
                if self.piece:
                    yield self.piece, int(self.starts[i]), end, int(upto[n] - upto[i]), bool(exact[n] == exact[i]), max(0, int(upto[self.cut] - upto[i]) + self.change)
                break
            c = self._place(i, fits, upto, tails, natural)
            if c is None:  # the overlap leaves no room for the next word: it gives way
                self.first += 1
                continue
            yield self.piece, int(self.starts[i]), int(self.starts[c]), int(upto[c] - upto[i] + tails[c]), bool(exact[c] == exact[i]), max(0, int(upto[self.cut] - upto[i]) + self.change)
            self.piece += 1
            self.cut, self.change = c, int(tails[c])
            self.first = max(i + 1, int(np.searchsorted(upto, upto[c] + tails[c] - self.overlap, side="right")) - 1) if self.overlap else c
        keep = self.first
        self.starts, self.tokens, self.kinds, self.tails = (x[keep:] for x in (self.starts, self.tokens, self.kinds, self.tails))
        self.first, self.cut = 0, self.cut - keep

    def _place(self, i: int, fits: int, upto: np.ndarray, tails: np.ndarray, natural: np.ndarray) -> int | None:
        """The word before which the piece from word i ends: the strongest boundary in its second half, else the last natural one, else the last word."""
        low = max(self.cut, i) + 1
        a, b = np.searchsorted(natural, (low, fits + 1))
        c = natural[a:b]
        size = upto[c] - upto[i]
        ok = size + tails[c] <= self.limit
        c, size = c[ok], size[ok]
        if len(c):
            half = c[size >= self.limit / 2]
            if len(half):
                kinds = self.kinds[half]
                return int(half[len(half) - 1 - int(np.argmax(kinds[::-1]))])
            return int(c[-1])
        c = np.arange(low, fits + 1)
        c = c[upto[c] - upto[i] + tails[c] <= self.limit]
        if not len(c):
            return None
        whole = c[self.kinds[c] == WORD]
        return int((whole if len(whole) else c)[-1])


def ranges(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, k, last, before, body, after): each text in ranges with halos, cut in one pass; null and empty texts have none."""
    parts = F.when(F.length("t") <= RANGE, F.array("t")).otherwise(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{RANGE}}}"), F.lit(0)))
    x = df.select(F.col(item).alias("item"), F.col(text).cast("string").alias("t")).where("t <> ''").select("item", parts.alias("p"))
    x = x.select("item", "p", F.posexplode("p").alias("k", "body"))
    return x.select(
        "item", "k", (F.col("k") == F.size("p") - 1).alias("last"), F.expr(f"case when k > 0 then right(p[k - 1], {BEFORE}) else '' end").alias("before"), "body",
        F.expr(f"case when k < size(p) - 1 then left(p[k + 1], {AFTER}) else '' end").alias("after"),
    )


#: Ranges of one batch out of a worker.
BATCH = 128


def _tables(limit: int, vocabulary: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, out = _Lexicon(vocabulary), []
        batch = lambda: pd.DataFrame(out, columns=["item", "k", "finish", "total", "start", "words"]).astype({"finish": "Int64"})
        for x in frames:
            for item, k, last, before, body, after in x.itertuples(index=False):
                # a short text is most likely within the limit, which a count without words tells sooner
                if k == 0 and last and len(body) < 4 * limit and len(lexicon.encode(body)) <= limit:
                    continue
                words, start, _ = words_of(before, body, after, last)
                known = lexicon(words)
                total = int(known[1].sum())
                if k == 0 and last and total <= limit:
                    continue
                table = boundary_table(before, body, after, words, known, start, limit, lexicon)
                out.append((item, k, k * RANGE + len(body) if last else None, total, k * RANGE + start, table.tobytes()))
                if len(out) >= BATCH:
                    yield batch()
                    out.clear()
        yield batch()

    return run


def _stitch(limit: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stitcher = None, None
        for x in frames:
            out = []
            for row in x.itertuples(index=False):
                if stitcher is None or row.item != now or row.k == 0:
                    now, stitcher = row.item, _Stitcher(limit, overlap)
                pieces = stitcher.add(int(row.total), int(row.start), np.frombuffer(row.words, dtype=_ROW), None if pd.isna(row.finish) else int(row.finish))
                out += [(row.item, *p) for p in pieces]
            yield pd.DataFrame(out, columns=["item", "piece", "start", "finish", "tokens", "exact", "shared"])

    return run


def pieces(df: DataFrame, item: str, text: str, limit: int, overlap: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item, piece, start, finish, tokens, shared, text) of every text with more than ``limit`` tokens, in order, by character offsets.

    Each piece is a stretch of the text with at most limit tokens by itself, and together they cover it. A piece ends at the strongest boundary in its second
    half - a heading, paragraph, row or sentence -, else at the last natural one, else between words, and within a word only if that alone is too large to
    handle. It begins with the last whole words of the one before that have at least ``overlap`` tokens together, as few as possible (``shared`` tokens); that
    gives way only where the next word would not fit. Within a word too large to stay whole, bytes are counted in place of tokens to place cuts and overlap.

    item must be unique: texts of one item can't be told apart. Texts within the limit, null, empty and blank ones within it give no pieces; an empty table
    gives none. Other columns are not read.
    """
    if not 0 <= overlap <= limit // 4:
        raise ValueError("overlap must be from 0 to a quarter of limit")
    kind = dict(df.dtypes)[item]
    large = df.where(F.octet_length(F.col(text).cast("string")) > limit)  # no text has more tokens than bytes
    r = ranges(large, item, text)
    tables = r.mapInPandas(_tables(limit, vocabulary), f"item {kind}, k int, finish bigint, total bigint, start bigint, words binary")
    cut = (
        tables.repartition("item").sortWithinPartitions("item", "k")
        .mapInPandas(_stitch(limit, overlap), f"item {kind}, piece int, start bigint, finish bigint, tokens bigint, exact boolean, shared bigint")
    )
    # numbers alone, which two joins read: the texts' boundary tables are made once
    cut = materialised(cut.withColumn("k", F.expr(f"cast(start div {RANGE} as int)")), "pieces")
    body = r.select(F.col("item").alias("_item"), F.col("k").alias("_k"), F.concat("body", "after").alias("body"))
    low = F.col("start") - F.col("k") * RANGE
    inside = F.col("finish") <= F.col("k") * RANGE + RANGE + AFTER
    near = cut.where(inside).join(body, (F.col("item") == F.col("_item")) & (F.col("k") == F.col("_k")))
    near = near.select(*cut.columns, F.substring(F.col("body"), (low + 1).cast("int"), (F.col("finish") - F.col("start")).cast("int")).alias("text"))
    # a piece that reaches further than the halo of its range is put together from several
    far = cut.where(~inside).withColumn("j", F.explode(F.sequence(F.col("k"), F.expr(f"cast((finish - 1) div {RANGE} as int)"))))
    low, high = F.greatest(F.col("start") - F.col("j") * RANGE, F.lit(0)), F.least(F.col("finish") - F.col("j") * RANGE, F.lit(RANGE))
    far = far.join(body, (F.col("item") == F.col("_item")) & (F.col("j") == F.col("_k"))).select("*", F.substring(F.col("body"), (low + 1).cast("int"), (high - low).cast("int")).alias("s"))
    far = far.groupBy(*cut.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda x: x["s"]), "").alias("text"))

    @F.pandas_udf("bigint")
    def recount(t: pd.Series) -> pd.Series:
        encode = library(vocabulary).encode_ordinary
        return t.map(lambda s: len(encode(s)) if s is not None else None).astype("Int64")

    whole = near.unionByName(far)
    out = whole.withColumn("tokens", F.coalesce(recount(F.when(~F.col("exact"), F.col("text"))), F.col("tokens")))
    return out.select(F.col("item").alias(item), "piece", "start", "finish", "tokens", "shared", F.col("text"))
