"""Byte-pair encoding of whole texts with a public vocabulary, by recursive DuckDB queries in each partition.

A text is split into words by the vocabulary's pattern. The words that a partition hasn't met yet become token-position rows; a recursive query joins
neighbours to the merge table and contracts, in each word, the pair of minimum rank, leftmost first, until no pair is left; ordered aggregation gives
the ids. Equal pairs of one word that don't overlap are contracted in one step, which gives the same as one after the other, as every pair that holds
a new token ranks after it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a worker remembers; beyond it starts anew, with the same results. Steps of one query, which go on from there until the fixpoint.
REMEMBER, STEPS = 1_000_000, 48
#: Bytes of texts that a worker holds as words at once.
PART_BYTES = 4_000_000

_CONTRACT = """
with recursive steps(step, w, p, t, live) as (
  select 0, w, p, t, true from todo
  union all
  select step + 1, w, p, coalesce(k, t), live
  from (
    select step, w, p, t, k, live, lag(k) over (partition by w order by p) as before
    from (
      select step, w, p, t, best is not null as live, case when k = best and (l <> r or (p - island) % 2 = 0) then k end as k
      from (
        select *, max(case when k is distinct from best or k_before is distinct from best then p end) over (partition by w order by p) as island
        from (
          select *, min(k) over (partition by w) as best, lag(k) over (partition by w order by p) as k_before
          from (
            select a.step, a.w, a.p, a.t, a.t as l, a.following as r, g.k
            from (
              select step, w, row_number() over (partition by w order by p) as p, t, lead(t) over (partition by w order by p) as following
              from steps where live and step < {steps}
            ) a left join merges g on g.l = a.t and g.r = a.following
          )
        )
      )
    )
  ) where before is null
)
select w, max(live) as live, list(t order by p) as ids
from (select *, max(step) over (partition by w) as last from steps) where step = last group by w
"""


@lru_cache(maxsize=4)
def _worker(vocabulary: str) -> _Words:
    return _Words(vocabulary)


class _Words:
    """The ids of words, learnt word by word; one for each vocabulary and Python worker."""

    def __init__(self, vocabulary: str) -> None:
        import duckdb
        import pyarrow as pa

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = splitter()
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [(ranks[b[:i]], ranks[b[i:]], k) for b, k in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1})
        self.db.register("pairs", pa.table(dict(zip("lrk", (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True)), strict=True))))
        self.db.execute("create table merges as select * from pairs")
        self.ids: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        import pyarrow as pa

        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(b) for b in raw], dtype=np.int64)
        t = self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        w = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        p = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
        while len(w):
            self.db.register("todo", pa.table({"w": w, "p": p.astype(np.int32), "t": t}))
            got = self.db.sql(_CONTRACT.format(steps=STEPS)).to_arrow_table()
            rest = []
            for k, live, ids in zip(got["w"].to_pylist(), got["live"].to_pylist(), got["ids"].to_pylist(), strict=True):
                if live:  # cut off by STEPS: it goes on from here
                    rest.append((k, ids))
                else:
                    self.ids[words[k]] = ids
            size = np.array([len(ids) for _, ids in rest], dtype=np.int64)
            w = np.repeat(np.array([k for k, _ in rest], dtype=np.int32), size)
            t = np.array([i for _, ids in rest for i in ids], dtype=np.int32)
            p = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(x) if x else [] for x in texts]
        new = [w for w in set(chain.from_iterable(split)) if w not in self.ids]
        if new:
            if len(self.ids) + len(new) > REMEMBER:
                self.ids.clear()
                new = list(set(chain.from_iterable(split)))
            self.learn(new)
        get = self.ids.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]


@lru_cache(maxsize=1)
def splitter():
    """A function that splits a text into the words of PATTERN.

    Texts without characters beyond U+FFFF, nearly all, are split by the standard library's patterns, whose character classes are spelled out from those of
    PATTERN: the same words in less than half the time.
    """
    import re

    import regex

    whole = regex.compile(PATTERN).findall
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def spelled(of: str) -> str:
        return "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"(?:{of})+", every))

    letters, digits, blanks = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]").replace(r"\s", f"[{blanks}]").replace(r"\S", f"[^{blanks}]")
    plain = re.compile(pattern).findall
    return lambda text: plain(text) if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else whole(text)


def _parts(batch, column: int) -> Iterator:
    """The batch in slices of about PART_BYTES of text, one text at least: what a worker splits into words at once."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // PART_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encoded(df: DataFrame, text: Column, keep: list[str], out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep of df with ``out``, the ids of each text, without special tokens; their strings are ordinary text.

    A null and an empty text have the empty list. Blank texts, odd characters and texts without a break are encoded whole, as they are. One row out for
    each row in, repeated ones too; an empty table gives an empty one. There is no shuffle. vocabulary is a path that all workers can read.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = _worker(vocabulary)
        for batch in batches:
            for part in _parts(batch, len(keep)):
                ids = words.encode(part.column(len(keep)).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1])))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*keep, out])

    return df.select(*keep, text.cast("string").alias("_pl_text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{out}` array<int>")


def token_counts(df: DataFrame, text: Column, keep: list[str], out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """As encoded(), with the number of ids in place of the ids."""
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = library(vocabulary)
        for x in frames:
            yield x[keep].assign(**{out: [len(encoder.encode_ordinary(t)) if t else 0 for t in x["_pl_text"]]})

    return df.select(*keep, text.cast("string").alias("_pl_text")).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{out}` int")


@lru_cache(maxsize=4)
def library(vocabulary: str):
    """The public library's encoder of the vocabulary, for counting."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
