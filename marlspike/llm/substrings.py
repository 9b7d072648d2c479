"""Substring dedup by recompression: equal passages get equal symbols, shared high symbols reveal long repeats.

Each round names runs or pairs of neighbouring symbols. A name is a hash of what it stands for, so it is the
same wherever the passage lies, with no dictionary to build or ship. Whether two symbols join depends only on
the two, so all but the rim of a passage is parsed alike in all its copies. Each symbol carries the extent of
words that its parse depends on: a window that holds the extent holds the symbol, in every copy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import mix, ragged, windows
from ._exchange import Group, U, answer_counts, buckets_of, composite, grouped, in_order, pack

WINDOW = 20
ROUNDS = 5  # of pairs, after one of runs
SPAN = 8  # words that a symbol stands for, at most
FAR = 1 << 30


@dataclass
class Level:
    """Symbols of one round: name, the words [start, end) they stand for, the words [low, high) they depend on."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    text: np.ndarray

    def keep(self, which: np.ndarray) -> Level:
        return Level(*(getattr(self, f)[which] for f in self.__dataclass_fields__))


def name_runs(s: Level) -> Level:
    """Each maximal run of one symbol, up to SPAN words, becomes a symbol; to end a run takes the neighbour's look."""
    n = len(s.name)
    tied = np.zeros(n + 1, bool)  # symbol i goes on the run of i - 1
    tied[1:n] = (s.name[1:] == s.name[:-1]) & (s.text[1:] == s.text[:-1])
    first = np.flatnonzero(~tied[:n])
    last = np.append(first[1:], n) - 1
    long = s.end[last] - s.start[first] > SPAN
    if long.any():  # what is too long to name stays as it is, and depends on the whole run
        single = np.repeat(long, last - first + 1)
        lo, hi = np.repeat(first, last - first + 1), np.repeat(last, last - first + 1)
        first = np.flatnonzero(~tied[:n] | single)
        last = np.append(first[1:], n) - 1
        rim_l, rim_r = np.where(single, lo, np.arange(n))[first], np.where(single, hi, np.arange(n))[last]
    else:
        rim_l, rim_r = first, last
    size = last - first + 1
    name = np.where(size > 1, mix(s.name[first] * U(0x9E3779B97F4A7C15) + size.astype(U)), s.name[first])
    before, after = np.maximum(rim_l - 1, 0), np.minimum(rim_r + 1, n - 1)
    low = np.where((rim_l > 0) & (s.text[before] == s.text[first]), s.low[before], -FAR)
    high = np.where((rim_r < n - 1) & (s.text[after] == s.text[first]), s.high[after], FAR)
    return Level(name, s.start[first], s.end[last], low, high, s.text[first])


def name_pairs(s: Level, turn: int) -> Level:
    """A left symbol and the right symbol after it become one, where they stand for SPAN words at most."""
    n = len(s.name)
    left = (mix(s.name + U(turn * 0x9E3779B9 + 1)) & U(1)).astype(bool)
    span = s.end - s.start
    joins = np.zeros(n + 1, bool)  # symbol i joins i + 1; a left one is never joined from before
    near = s.text[1:] == s.text[:-1]
    joins[: n - 1] = left[:-1] & ~left[1:] & near & (span[:-1] + span[1:] <= SPAN)
    second = np.concatenate([[False], joins[: n - 1]])
    next_high = np.append(np.where(near, np.maximum(s.high[1:], s.high[:-1]), FAR), FAR)
    prev_low = np.concatenate([[-FAR], np.where(near, np.minimum(s.low[:-1], s.low[1:]), -FAR)])
    free = span < SPAN  # could have joined: that it did not depends on its neighbour
    low = np.where(~left & free & ~second, prev_low, s.low)
    high = np.where(left & free, next_high, s.high)
    i = np.flatnonzero(~second)
    j = np.minimum(i + joins[i], n - 1)
    name = np.where(j > i, mix(s.name[i] * U(0xC2B2AE3D27D4EB4F) + s.name[j] * U(0x165667B19E3779F9) + U(turn)), s.name[i])
    return Level(name, s.start[i], s.end[j], low[i], high[i], s.text[i])


class Parsed(Group):
    """A group whose texts are parsed: the levels, and for each window the highest level that has a symbol in it."""

    def __init__(self, table: pa.Table, size: int) -> None:
        super().__init__(table)
        self.size = size
        self.h = self.words.hashes(0)
        n, of = len(self.h), self.words.of
        text = np.repeat(np.arange(len(of) - 1, dtype=np.int32), np.diff(of))
        at = np.arange(n, dtype=np.int32)
        self.text = text
        self.first, self.stop = of[:-1][text].astype(np.int32), (of[1:] - size)[text].astype(np.int32)  # of the windows of a text
        self.is_window = at <= self.stop
        levels = [Level(self.h, at, at + 1, at, at + 1, text)]
        if n:
            levels.append(name_runs(levels[-1]))
            for turn in range(ROUNDS):
                levels.append(name_pairs(levels[-1], turn))
        self.symbols: list[tuple[Level, np.ndarray, np.ndarray]] = []
        self.level = np.full(n, -1, np.int8)
        for k in range(len(levels) - 1, -1, -1):
            s = levels[k]
            s = s.keep(np.flatnonzero(s.high.astype(np.int64) - s.low <= size))
            a, b = np.maximum(s.high - size, self.first[s.start]), np.minimum(s.low, self.stop[s.start])
            open_ = np.concatenate([[0], np.cumsum(self.is_window & (self.level < 0))])
            use = np.flatnonzero((a <= b) & (open_[np.maximum(b + 1, 0)] > open_[np.maximum(a, 0)]))
            s, a, b = s.keep(use), a[use], b[use]
            self.level[(self.cover(a, b) > 0) & self.is_window & (self.level < 0)] = k
            self.symbols.append((s, a, b))
            if not (self.is_window & (self.level < 0)).any():
                break
        self.top = len(levels) - 1

    def cover(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of the ranges [a, b] each window lies in."""
        n = len(self.h)
        return np.cumsum(np.bincount(a, minlength=n + 1)[: n + 1] - np.bincount(b + 1, minlength=n + 1)[: n + 1])[:n]

    def keys(self) -> np.ndarray:
        """A hash of the words that each used symbol depends on, level by level."""
        n = len(self.h)
        q = np.full(n + 1, 0x9E3779B97F4A7C15, U)
        r = np.full(n + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), U)
        q[0] = r[0] = U(1)
        q, r = np.cumprod(q), np.cumprod(r)
        upto = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.h) * q[:n])])
        out = [mix((upto[s.high] - upto[s.low]) * r[s.low] + (s.high - s.low).astype(U) * U(0xD6E8FEB86659FD93) + U(k)) for k, (s, _, _) in enumerate(self.symbols)]
        return np.concatenate(out) if out else np.zeros(0, U)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Windows all of whose symbols at their level are shared."""
        out, done = self.is_window.copy(), 0
        for i, (s, a, b) in enumerate(self.symbols):
            alone = ~shared[done : done + len(a)]
            done += len(a)
            out &= (self.level != self.top - i) | (self.cover(a[alone], b[alone]) == 0)
        return np.flatnonzero(out)

    def earliest(self, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows `at`: which are the earliest of their key in the group, and the order by (key, id, start)."""
        start = at - self.first[at]
        order = np.lexsort((start, self.ids[self.text[at]], key))
        new = np.ones(len(at), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        return new, order


def _codes(key: np.ndarray, buckets: int) -> np.ndarray:
    return composite(key, key >> U(40), buckets)


def _pack_windows(key: np.ndarray, bucket: np.ndarray, ids: np.ndarray, start: np.ndarray, g: int) -> pa.Table:
    order = np.lexsort((key, bucket))
    key, bucket, ids, start = key[order], bucket[order], ids[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, np.int64)
    out: list[list] = [[], [], [], [], [], []]
    for i, j in zip(first.tolist(), np.append(first[1:], len(key)).tolist()):
        names, which = np.unique(ids[i:j], return_inverse=True)
        for column, x in zip(out, (int(bucket[i]), g, key[i:j].tobytes(), names.tobytes(), which.astype("<u2" if len(names) < 65536 else "<u4").tobytes(), start[i:j].astype("<u2" if start[i:j].max() < 65536 else "<u4").tobytes())):
            column.append(x)
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=["b", "g", "keys", "names", "which", "start"])


def _later(key: tuple, table: pa.Table) -> pa.Table:
    """For each group of a bucket, its keys whose earliest window in the group has an equal one earlier elsewhere."""
    keys = [np.frombuffer(x.as_buffer(), "<u8") for x in table["keys"]]
    size = np.array([len(x) for x in keys])
    wide = lambda x, n: np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // n}").astype(np.int64)
    ids = np.concatenate([np.frombuffer(a.as_buffer(), "<i8")[wide(b, n)] for a, b, n in zip(table["names"], table["which"], size)])
    start = np.concatenate([wide(x, n) for x, n in zip(table["start"], size)])
    k, of = np.concatenate(keys), np.repeat(np.arange(len(size)), size)
    order = np.lexsort((start, ids, k))
    new = np.ones(len(k), bool)
    new[1:] = k[order][1:] != k[order][:-1]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = order[(ids[order] != ids[head]) | (start[order] != start[head])]
    late = late[np.argsort(of[late], kind="stable")]
    at = np.searchsorted(of[late], np.arange(len(size) + 1))
    data = k[late].tobytes()
    return pa.table([table["g"], pa.array([data[8 * i : 8 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], names=["g", "keys"])


def kept_words(p: Parsed, removed: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    w = p.words
    word = np.flatnonzero(~removed)
    text = p.text[word]
    gap = np.zeros(len(word), np.int64)
    gap[1:] = text[1:] == text[:-1]
    size = w.end[word] - w.start[word]
    row, place = ragged(size + gap)
    source = w.start[word][row] + place - gap[row]
    raw = np.where(place < gap[row], np.uint8(32), w.raw[np.maximum(source, 0)]) if len(row) else np.zeros(0, np.uint8)
    total = np.bincount(text, size + gap, minlength=len(w.of) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(total), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """Every row of `docs` with n_words, n_removed and its text without repeated passages, in the column `text`.

    Words are runs of anything but U+0009-U+000D and the space. A word goes if a window of `size` consecutive
    words of its text that covers it also starts earlier: in a text of a smaller id, or in the same text. Windows
    are judged on the input. The kept words are joined by one space.

    Two rounds of exchange between groups of texts: which high symbols occur in several groups (or several times
    in one), then, for windows all of whose symbols do, which group has the earliest. A window is told by 64
    bits and by the bucket of an independent hash, of which there are as many as the data needs.

    A null text has no words and stays as an empty one. Null ids come last in order. Rows that repeat an id
    are texts of their own; windows at one place of rows with one id do not count as earlier than each other.
    Columns n_words and n_removed of the input are replaced. An empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in (text, doc_id) and c.lower() not in ("n_words", "n_removed")]
    t, groups = grouped(docs, doc_id, text, rest)
    buckets = buckets_of(groups)

    def send_symbols(key: tuple, table: pa.Table) -> pa.Table:
        return pack(np.unique(_codes(Parsed(table, size).keys(), buckets)), key[0].as_py())

    def send_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        none = np.zeros(0, U)
        if not table.num_rows or not answers.num_rows:
            return _pack_windows(none, none.astype(np.int64), none.astype(np.int64), none.astype(np.int64), 0)
        p = Parsed(table, size)
        _, which, count = np.unique(_codes(p.keys(), buckets), return_inverse=True, return_counts=True)
        at = p.candidates(((in_order(answers) > 0) | (count > 1))[which])
        bucket = (windows(p.words.hashes(1), size)[at] % U(buckets)).astype(np.int64)
        window = windows(p.h, size)[at]
        new, order = p.earliest(at, window)
        one = order[new]
        return _pack_windows(window[one], bucket[one], p.ids[p.text[at[one]]], (at - p.first[at])[one], key[0].as_py())

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        p = Parsed.__new__(Parsed)
        Group.__init__(p, table)
        n, of = len(p.words.start), p.words.of
        p.text = np.repeat(np.arange(len(of) - 1, dtype=np.int32), np.diff(of))
        p.first = of[:-1][p.text]
        at = np.flatnonzero(np.arange(n) <= (of[1:] - size)[p.text])
        window = windows(p.words.hashes(0), size)[at] if len(at) else np.zeros(0, U)
        late = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in answers["keys"].to_pylist()])) if answers.num_rows else np.zeros(0, U)
        new, order = p.earliest(at, window)
        key_, ids, start = window[order], p.ids[p.text[at[order]]], (at - p.first[at])[order]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (ids != ids[head]) | (start != start[head])
        if len(late):
            gone |= late[np.minimum(np.searchsorted(late, key_), len(late) - 1)] == key_
        begin = at[order[gone]]
        removed = np.cumsum(np.bincount(begin, minlength=n + size + 1) - np.bincount(begin + size, minlength=n + size + 1))[:n] > 0
        lost = np.bincount(p.text[removed], minlength=len(of) - 1)
        columns = [p.table[c] for c in p.table.schema.names if c.startswith("rest_")]
        return pa.table([p.table["id"], kept_words(p, removed), *columns, pa.array(np.diff(of)), pa.array(lost)], names=["id", "text", *[f"rest_{i}" for i in range(len(rest))], "n_words", "n_removed"])

    sent = t.select("g", "id", "text").groupBy("g").applyInArrow(send_symbols, "b int, g int, keys binary")
    answers = sent.groupBy("b").applyInArrow(answer_counts, "g int, b int, seen binary")
    found = t.select("g", "id", "text").groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(send_windows, "b int, g int, keys binary, names binary, which binary, start binary")
    late = found.groupBy("b").applyInArrow(_later, "g int, keys binary")
    kinds = "".join(f"rest_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest))
    out = t.groupBy("g").cogroup(late.groupBy("g")).applyInArrow(cut, f"id long, text string, {kinds}n_words long, n_removed long")
    back = {text: "text", doc_id: "id"} | {c: f"rest_{i}" for i, c in enumerate(rest)}
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns if c in back], "n_words", "n_removed")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
