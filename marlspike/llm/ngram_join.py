"""N-gram Jaccard join by set relations: skip blocks of index lists, derive a set's answers from a similar set's.

Similar sets with a common minimum hash lie in one block. Index lists hold blocks, cut by the position of the
token in them and sorted by size inside each cut, so that a posting skips the cuts that its own position rules
out and looks at one stretch of the others. Jaccard distance is a metric: the distance of two leaders and the
radii of their blocks decide all pairs of two blocks, none, or a closer look. There the overlaps of a member
follow from those of its leader and the few tokens in which the two differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import find_words, lowered, mix, ragged, slices, utf8, windows
from ._exchange import LAST, Group, U, answer_counts, buckets_of, composite, grouped, in_order, level, pack
from ._shared import drop_written, partitions, written

SHINGLE = 2
PERCENT = 60
BEYOND = 0.05  # share of a set that its prefix is longer than it must be, so that one common token is not enough
MEMBERS = 256  # of a block, at most
ALIKE = 0.6  # least size and prefix that a member shares with its leader, so that a block is tight
OPEN = 64  # blocks of one lead that a set may join
COMMON = 50  # a token that one in so many sets of a group holds does not tell similar sets
GATHER = 4 << 20  # tokens of sets that hang together and are looked at in one task
GUESTS = 2 << 20  # tokens of a cell where more hang together, about; two cells meet in a task
HOT, SALTS = 200, 64  # a minimum hash that so many groups hold is spread over so many tasks
PAIRS = 1 << 21  # posting pairs looked at in one step
EPS = 1e-9
BROADCAST_ROWS = 400_000  # keys of some 60 bytes that are broadcast at most


class Sets:
    """The token set of each text: tokens sorted inside each text, and where each text begins."""

    def __init__(self, words, size: int) -> None:
        h, of = words.hashes(0), words.of
        n = np.diff(of)
        text = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
        whole = np.flatnonzero((n > 0) & (n < size))
        run = windows(h, size)
        at = np.concatenate([np.arange(a, a + m) for a, m in zip(of[:-1], n - size + 1) if m > 0]) if len(text) else np.zeros(0, np.int64)
        token = run[at] if len(at) else np.zeros(0, U)
        if len(whole):  # shorter than a shingle: the whole sequence, which equals no shingle of full size
            one = np.array([windows(h[of[i] : of[i + 1]], int(n[i]))[0] for i in whole], U)
            token, text = np.concatenate([token, mix(one + U(0x5851F42D4C957F2D))]), np.concatenate([text, whole])
        order = np.lexsort((token, text))
        token, text = token[order], text[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
        self.token, self.text = token[new], text[new]
        self.of = np.searchsorted(self.text, np.arange(len(n) + 1))
        self.n = np.diff(self.of)

    def fold(self, values: np.ndarray, how) -> np.ndarray:
        """A fold of the token values of each text; 0 for an empty one."""
        out = np.zeros(len(self.n), values.dtype)
        full = np.flatnonzero(self.n)
        if len(full):
            out[full] = how.reduceat(values, self.of[full])
        return out

    def prints(self) -> list[bytes]:
        """128 bits that tell a set, whatever the order of its tokens."""
        a, b = self.fold(mix(self.token + U(1)), np.add), self.fold(mix(self.token ^ U(0x9E3779B97F4A7C15)), np.add)
        return [x.tobytes() for x in np.stack([a, b], 1)]


def describe(docs: DataFrame, doc_id: str, text: str, groups: int, size: int) -> DataFrame:
    """(g, id, h, n, fp) of every row: its group, a hash of its text, the size of its set and the print of it."""
    g = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), groups).cast("int")
    rows = docs.select(g.alias("g"), F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(whole.column(3), 2 << 20):
                part = whole.slice(lo, hi - lo)
                raw, at = utf8(part.column(3))
                s = Sets(find_words(lowered(raw), at), size)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(3)], pa.array(s.n), pa.array(s.prints(), pa.binary())], names=["g", "id", "h", "n", "fp"])

    return rows.mapInArrow(run, "g int, id long, h long, n long, fp binary")


class Representatives(Group):
    """The sets of a group that stand for their class: the first row with each of the prints that this group owns."""

    def __init__(self, table: pa.Table, prints: list[bytes], size: int) -> None:
        super().__init__(table, lower=True)
        self.sets = Sets(self.words, size)
        first: dict[bytes, int] = {}
        for i, p in enumerate(self.sets.prints()):
            first.setdefault(p, i)
        self.prints = prints
        self.rows = np.array([first[p] for p in prints], np.int64)
        row, place = ragged(self.sets.n[self.rows])
        self.row, self.token = row, self.sets.token[self.sets.of[self.rows][row] + place]
        self.n = self.sets.n[self.rows]

    def codes(self, buckets: int) -> np.ndarray:
        k = mix(self.token)
        return composite(k, k >> U(40), buckets)


def survivors(t: DataFrame, reps: DataFrame, buckets: int, size: int, percent: int) -> DataFrame:
    """(fp, n, copies, lead, salt, behind, tokens) of the sets that may have a partner.

    Only tokens that other sets hold too can be in an intersection, so a set with fewer than `percent` % of them
    is alone. The others are ordered by the number of groups that hold them, the rarest first, then by hash: one
    order for all. `tokens` are those in the prefix of the set, `behind` counts the rest. `lead` is of the two
    least hashes over the tokens that few sets of the group hold, by which similar sets come together.
    """

    def send(key: tuple, table: pa.Table, own: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pack(np.zeros(0, U), 0)
        return pack(np.unique(Representatives(table, own["fp"].to_pylist(), size).codes(buckets)), key[0].as_py())

    def choose(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
        names = ["fp", "n", "copies", "lead", "salt", "behind", "tokens"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        own = right.filter(right["fp"].is_valid())
        rows = []
        if own.num_rows:
            r = Representatives(table, own["fp"].to_pylist(), size)
            _, which, count = np.unique(r.codes(buckets), return_inverse=True, return_counts=True)
            seen = in_order(right.filter(right["seen"].is_valid()).select(["b", "seen"]))
            shared, rank = ((seen > 0) | (count > 1))[which], seen[which]
            use = np.flatnonzero(shared)
            use = use[np.lexsort((r.token[use], rank[use], r.row[use]))]
            at = np.searchsorted(r.row[use], np.arange(len(r.n) + 1))
            token, rank, copies = r.token[use], rank[use], own["copies"].to_pylist()
            plain = (mix(token * U(3)) >> U(1)).astype(np.int64)
            common = count[which][use] > max(8, len(r.n) // COMMON)
            hashed = np.where(common, LAST, plain)
            for i in np.flatnonzero(100 * np.diff(at) >= percent * r.n).tolist():
                mine, n = slice(at[i], at[i + 1]), int(r.n[i])
                have = at[i + 1] - at[i]
                take = n - -(-n * percent // 100) + 1 + int(BEYOND * n) - (n - have)
                if take > 0:
                    # two minima must agree, or sets that share one common token would lie in a block
                    own_hashes = hashed[mine] if (hashed[mine] < LAST).sum() > 1 else plain[mine]
                    least = np.argpartition(own_hashes, 1)[:2] if have > 1 else np.zeros(1, np.int64)
                    lead = int(np.sort(own_hashes[least])[0] ^ (np.sort(own_hashes[least])[-1] >> 1))
                    k = at[i] + int(least[own_hashes[least].argmin()])
                    salt = r.prints[i][0] % SALTS if rank[k] >= level(max(HOT, 1)) else 0
                    rows.append((r.prints[i], n, copies[i], lead, salt, int(max(0, have - take)), token[mine][:take].tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    sent = t.groupBy("g").cogroup(reps.groupBy("g")).applyInArrow(send, "b int, g int, keys binary")
    answers = sent.groupBy("b").applyInArrow(answer_counts, "g int, b int, seen binary")
    right = answers.unionByName(reps, allowMissingColumns=True)
    return t.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(choose, "fp binary, n long, copies long, lead long, salt int, behind long, tokens binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


BLOCK = "bid long, members int, smallest long, largest long, behind long, prints binary, sizes binary, copies binary, tokens binary, places binary, rests binary"


def one_block(held: list[tuple]) -> tuple:
    """The row of a block: each token that some member has in its prefix, with its first and last place there and
    the most tokens that follow it, as first, last and rest; all of them in the order that all sets share."""
    prints, sizes, copies, behind, tokens = zip(*held)
    parts = [np.frombuffer(x, "<u8") for x in tokens]
    token, n = np.concatenate(parts), np.array([len(x) for x in parts])
    row, last = ragged(n)
    rest, first = (np.array(behind) + n)[row] - 1 - last, last
    if len(parts) > 1:
        order = np.argsort(token, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
        token, first = token[order][start], np.minimum.reduceat(last[order], start)
        last, rest = np.maximum.reduceat(last[order], start), np.maximum.reduceat(rest[order], start)
    bid = int.from_bytes(prints[0][:8], "little", signed=True)
    places = np.stack([first, last], 1).astype("<u4").tobytes()
    return bid, len(held), min(sizes), max(sizes), max(behind), b"".join(prints), np.array(sizes, "<i8").tobytes(), np.array(copies, "<i8").tobytes(), token.tobytes(), places, rest.astype("<u4").tobytes()


def build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets in the order of (lead, salt), the largest first, to blocks of one lead.

    A set joins the first open block whose leader is no larger than it divided by ALIKE and shares so much of the
    longer prefix; else it opens one. So members lie near their leader, and the bounds of a block are theirs.
    """
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 6
    names = [x.split()[0] for x in BLOCK.split(", ")]
    key, held = None, []

    def batch_of(done: list[list[tuple]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*map(one_block, done)), kinds)], names=names)

    for batch in batches:
        done = []
        for lead, salt, *one in zip(*[batch.column(i).to_pylist() for i in range(7)]):
            if (lead, salt) != key:
                done += [block for *_, block in held]
                key, held = (lead, salt), []
            mine = np.sort(np.frombuffer(one[4], "<u8"))
            for i, (n, leader, block) in enumerate(held):
                if one[1] >= ALIKE * n and overlap(mine, leader) >= ALIKE * max(len(mine), len(leader)):
                    block.append(tuple(one))
                    if len(block) == MEMBERS:
                        done.append(held.pop(i)[2])
                    break
            else:
                if len(held) == OPEN:
                    done.append(held.pop(0)[2])
                held.append((one[1], mine, [tuple(one)]))
        if done:
            yield batch_of(done)
    if held:
        yield batch_of([block for *_, block in held])


def members_of(blocks: DataFrame) -> DataFrame:
    """(bid, fp, n, copies) of every member of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bid, prints, sizes, copies = [batch.column(i) for i in range(4)]
            sizes, copies = [np.frombuffer(b"".join(x.to_pylist()), "<i8") for x in (sizes, copies)]
            data = b"".join(prints.to_pylist())
            count = np.array([len(p) // 16 for p in prints.to_pylist()])
            yield pa.RecordBatch.from_arrays([bid.take(pa.array(np.repeat(np.arange(len(count)), count))), pa.array([data[i : i + 16] for i in range(0, len(data), 16)], pa.binary()), pa.array(sizes), pa.array(copies)], names=["bid", "fp", "n", "copies"])

    return blocks.select("bid", "prints", "sizes", "copies").mapInArrow(run, "bid long, fp binary, n long, copies long")


def postings(blocks: DataFrame, buckets: int) -> DataFrame:
    """Packed postings (b, tokens, which, places, rests, meta): the blocks that hold each token, and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(4)]
            token, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            places, rests = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4") for i in (5, 6)]
            meta = np.stack([np.asarray(batch.column(i), np.int64) for i in range(4)], 1)
            b = ((token >> U(20)) % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            token, of, b, places, rests = token[order], of[order], b[order], places.reshape(-1, 2)[order], rests[order]
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
            rows = []
            for i, j in zip(first.tolist(), np.append(first[1:], len(b)).tolist()):
                used, at = np.unique(of[i:j], return_inverse=True)
                rows.append((int(b[i]), token[i:j].tobytes(), at.astype("<u4").tobytes(), places[i:j].tobytes(), rests[i:j].tobytes(), meta[used].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 5)], names=["b", "tokens", "which", "places", "rests", "meta"])

    return blocks.select("bid", "smallest", "largest", "behind", "tokens", "places", "rests").mapInArrow(run, "b int, tokens binary, which binary, places binary, rests binary, meta binary")


def meet(percent: int):
    """Pairs of blocks that share prefix tokens of a bucket, and how many; lists are skipped by position and size.

    Two linked sets of sizes x and y share at least t / (1 + t) * (x + y) tokens. If they share one that stands
    at places p and q, their overlap is at most min(p, q) + 1 + the fewer of the tokens that follow it. A list is
    cut by the power of two that q lies under, and each cut is sorted by the smallest set of a block. From p
    follows how large a set must be for its place in a cut, so that cuts are passed over as a whole or entered at
    that size; what is left is held against the bound with its own places. Nothing is skipped that a linked pair
    has in common. `least` is what two linked sets must share in their prefixes: their overlap is at most that
    and the tokens behind one of the prefixes.
    """
    t = percent / 100

    def run(key: tuple, table: pa.Table) -> pa.Table:
        metas = [np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 4) for x in table["meta"]]
        base = np.cumsum([0] + [len(p) for p in metas])
        of = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") + o for x, o in zip(table["which"], base)])
        bid, low, high, behind = np.concatenate(metas).T
        token = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table["tokens"]])
        begin, last = np.concatenate([np.frombuffer(x.as_buffer(), "<u4").reshape(-1, 2) for x in table["places"]]).astype(np.int64).T
        rest = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table["rests"]]).astype(np.int64)
        cut = np.frexp(begin + 1.0)[1].astype(np.int64) - 1  # 2^cut - 1 <= begin
        cuts, span = int(cut.max()) + 1, int(low.max()) + 2
        order = np.lexsort((of, low[of], cut, token))
        token, of, last, rest, cut = token[order], of[order], last[order], rest[order], cut[order]
        m = len(token)
        new = np.ones(m, bool)
        new[1:] = token[1:] != token[:-1]
        listed = np.cumsum(new) - 1
        alone = np.bincount(listed)[listed] == 1
        place = (listed * cuts + cut) * span + low[of]
        upper = np.minimum(np.floor(high[of] / t + EPS).astype(np.int64), span - 1)
        starts, widths = [], []
        for q in range(cuts):
            use = np.flatnonzero((cut <= q) & ~alone)
            mine = of[use]
            # a block at place 2^q - 1 or later: its largest set is at least so large, its smallest no less than ALIKE of that
            need = t * low[mine] + (1 + t) * np.maximum(0, (1 << q) - 1 - last[use])
            lower = np.ceil(ALIKE * need - EPS).astype(np.int64)
            at = (listed[use] * cuts + q) * span
            go = lower <= upper[use]
            use, at, lower = use[go], at[go], lower[go]
            lo = np.searchsorted(place, at + lower, "left")
            hi = np.searchsorted(place, at + upper[use], "right")
            lo = np.where(cut[use] == q, np.maximum(lo, use + 1), lo)
            some = hi > lo
            starts.append(np.stack([use[some], lo[some]], 1))
            widths.append((hi - lo)[some])
        start, width = np.concatenate(starts), np.concatenate(widths)
        upto, lo = np.concatenate([[0], np.cumsum(width)]), 0
        code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        while lo < len(width):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
            row, step = ragged(width[lo:hi])
            x, y = start[lo + row, 0], start[lo + row, 1] + step
            a, b = of[x], of[y]
            most = np.minimum(last[x], last[y]) + 1 + np.minimum(rest[x], rest[y])
            fit = (a != b) & (most >= t / (1 + t) * (low[a] + low[b]) - EPS) & (high[a] >= t * low[b] - EPS) & (high[b] >= t * low[a] - EPS)
            a, b = a[fit], b[fit]
            held.append(np.minimum(a, b).astype(np.int64) * len(bid) + np.maximum(a, b))
            lo = hi
            if lo == len(width) or sum(map(len, held)) > PAIRS:
                mine, n = np.unique(np.concatenate(held), return_counts=True)
                code, at = np.unique(np.concatenate([code, mine]), return_inverse=True)
                count, held = np.bincount(at, np.concatenate([count, n])).astype(np.int64), []
        a, b = code // len(bid), code % len(bid)
        apart = bid[a] != bid[b]
        a, b, count = a[apart], b[apart], count[apart]
        least = np.ceil(t / (1 + t) * (low[a] + low[b]) - np.maximum(behind[a], behind[b]) - EPS).astype(np.int64)
        x, y = np.minimum(bid[a], bid[b]), np.maximum(bid[a], bid[b])
        return pa.table([pa.array(c) for c in (x, y, count, least)], names=["a", "b", "common", "least"])

    return run


class Block:
    """Sets of one block: prints, sizes, copies and sorted tokens; the first is the leader."""

    def __init__(self, rows: list[tuple[bytes, int, int, np.ndarray]]) -> None:
        self.prints = [r[0] for r in rows]
        self.sizes, self.copies = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.tokens = [r[3] for r in rows]
        self.n = int(self.sizes[0])
        both = np.array([overlap(self.tokens[0], x) for x in self.tokens])
        self.radius = float((1 - both / (self.n + self.sizes - both)).max())


def links(a: Block, b: Block, percent: int) -> np.ndarray | None:
    """Which members of two blocks are linked, as a matrix; None if none are.

    The leaders decide all pairs where they can. Else the overlaps of a's leader with all of b are counted once,
    and those of its members follow from the tokens that they lack or have beyond it.
    """
    limit = 1 - percent / 100
    both = overlap(a.tokens[0], b.tokens[0])
    distance = 1 - both / (a.n + b.n - both)
    if distance + a.radius + b.radius <= limit - EPS:
        return np.ones((len(a.sizes), len(b.sizes)), bool)
    if distance - a.radius - b.radius > limit + EPS:
        return None
    vocabulary, at = np.unique(np.concatenate(b.tokens), return_inverse=True)
    holds = np.zeros((len(vocabulary), len(b.sizes)), np.int32)
    holds[at, np.repeat(np.arange(len(b.sizes)), [len(x) for x in b.tokens])] = 1

    def count(tokens: np.ndarray) -> np.ndarray:
        i = np.searchsorted(vocabulary, tokens)
        i[i == len(vocabulary)] = 0
        return holds[i[vocabulary[i] == tokens]].sum(0)

    first = count(a.tokens[0])
    common = np.stack([first] + [first - count(np.setdiff1d(a.tokens[0], x, True)) + count(np.setdiff1d(x, a.tokens[0], True)) for x in a.tokens[1:]])
    out = 100 * common >= percent * (a.sizes[:, None] + b.sizes[None, :] - common)
    return out if out.any() else None


def answer(a: Block, b: Block, percent: int, self_pair: bool) -> tuple[list, list]:
    """(print, linked documents) of members, and star edges (print, print) that join what the links join."""
    found = links(a, b, percent)
    if found is None:
        return [], []
    if self_pair:
        np.fill_diagonal(found, False)
        names = a.prints
        near, total = found, found @ a.copies
        full = near
    else:
        names = a.prints + b.prints
        na = len(a.prints)
        full = np.zeros((len(names), len(names)), bool)
        full[:na, na:], full[na:, :na] = found, found.T
        total = np.concatenate([found @ b.copies, found.T @ a.copies])
    label = np.arange(len(names))
    while True:
        lower = np.minimum(label, np.where(full, label[None, :], len(names)).min(1))
        if (lower == label).all():
            break
        label = lower
    used = np.flatnonzero(total > 0).tolist()
    return [(names[i], int(total[i])) for i in used], [(names[i], names[label[i]]) for i in used if label[i] != i]


def verify(percent: int):
    """The links of the pairs of blocks that are set to this task, among the sets that came to it."""

    def run(key: tuple, sets: pa.Table, pairs: pa.Table) -> pa.Table:
        rows: dict[int, dict[bytes, tuple]] = {}
        for bid, fp, n, copies, tokens in zip(*[sets[c].to_pylist() for c in ("bid", "fp", "n", "copies", "tokens")]):
            rows.setdefault(bid, {})[fp] = (fp, n, copies, np.frombuffer(tokens, "<u8"))
        blocks = {b: Block([r[k] for k in sorted(r, key=lambda k: (-r[k][1], k))]) for b, r in rows.items()}
        linked: dict[bytes, int] = {}
        edges: set[tuple[bytes, bytes]] = set()
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            found, joins = answer(blocks[a], blocks[b], percent, a == b)
            edges.update(joins)
            for p, n in found:
                linked[p] = linked.get(p, 0) + n
        out = [(p, None, n) for p, n in linked.items()] + [(x, y, 0) for x, y in sorted(edges)]
        kinds = [pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)], names=["fp", "other", "linked"])

    return run


def tasks(blocks: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where pairs of blocks are looked at, (task, part, a, b), and the blocks that go there, (task, part, bid).

    Blocks that pairs join are looked at together, so each set travels once. Where more than GATHER tokens hang
    together, the blocks are dealt to cells of about GUESTS, and a pair is looked at where its two cells meet: a
    set travels to the cells that it has a pair in, not once a pair.
    """
    size = blocks.select("bid", "members", (F.col("members") * F.col("largest")).alias("tokens"))
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(edges)
    placed = written(size.join(roots.select(F.col("v").alias("bid"), "root"), "bid", "left").withColumn("root", F.coalesce("root", "bid")), "rooted")
    drop_written(roots)
    total = F.sum("tokens")
    cells = placed.groupBy("root").agg(F.when(total <= GATHER, 1).otherwise(F.ceil(total / GUESTS)).cast("int").alias("cells"))
    cell = F.when(F.col("cells") == 1, 0).otherwise(F.pmod(F.xxhash64("bid"), "cells").cast("int"))
    cells = written(placed.join(cells, "root").select("bid", "members", "root", "cells", cell.alias("cell")), "placed")
    drop_written(placed)
    part = lambda x, y: F.least(x, y).cast("long") * F.col("cells") + F.greatest(x, y)
    own = cells.where("members > 1").select(F.col("root").alias("task"), part("cell", "cell").alias("part"), F.col("bid").alias("a"), F.col("bid").alias("b"))
    left = cells.select("root", "cells", F.col("bid").alias("a"), F.col("cell").alias("cell_a"))
    cross = pairs.join(left, "a").join(cells.select(F.col("bid").alias("b"), F.col("cell").alias("cell_b")), "b")
    work = written(own.union(cross.select(F.col("root").alias("task"), part("cell_a", "cell_b").alias("part"), "a", "b")), "tasks")
    drop_written(cells)
    go = work.select("task", "part", F.col("a").alias("bid")).union(work.select("task", "part", F.col("b").alias("bid"))).distinct()
    return work, go


def whole_sets(rows: DataFrame, size: int) -> DataFrame:
    """(task, part, bid, fp, n, copies, tokens): the whole set of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(whole.column(6), 2 << 20):
                part = whole.slice(lo, hi - lo)
                raw, at = utf8(part.column(6))
                s = Sets(find_words(lowered(raw), at), size)
                data, ends = s.token.tobytes(), s.of.tolist()
                tokens = pa.array([data[8 * i : 8 * j] for i, j in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(6)], tokens], names=["task", "part", "bid", "fp", "n", "copies", "tokens"])

    return rows.select("task", "part", "bid", "fp", "n", "copies", "text").mapInArrow(run, "task long, part long, bid long, fp binary, n long, copies long, tokens binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of an edge but roots: the smallest vertex that it reaches.

    Large-star and small-star rounds; each round's edges are a written table, and rounds end when none changes.
    """
    e = written(edges.select("u", "v").where("u != v").distinct(), "edges")
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e, old = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), e
        drop_written(old)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("root"))


def joined(docs: DataFrame, text: str, doc_id: str, size: int, percent: int) -> DataFrame:
    """(id, h, n, n_similar, component_id, root) of every row; root names its component, null for an empty set.

    A written table; all tables that it takes are removed.
    """
    t, groups = grouped(docs, doc_id, text, [])
    d = written(describe(docs, doc_id, text, groups, size), "sets")
    one = F.min(F.struct("g", "id", "h")).alias("one")
    classes = d.where("n > 0").groupBy("fp").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), one)
    classes = written(classes.select("fp", "copies", "first_id", "one.g", "one.id", "one.h"), "classes")
    v = survivors(t, classes.select("g", "fp", "copies"), buckets_of(groups), size, percent)

    parts = partitions(docs.sparkSession)
    v = v.repartition(parts, "lead", "salt").sortWithinPartitions("lead", "salt", F.desc("n"), "fp")
    blocks = written(v.select("lead", "salt", "fp", "n", "copies", "behind", "tokens").mapInArrow(build_blocks, BLOCK), "blocks")
    met = postings(blocks, max(parts, buckets_of(groups))).groupBy("b").applyInArrow(meet(percent), "a long, b long, common long, least long")
    pairs = met.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("least").alias("least")).where("common >= least").select("a", "b")
    pairs = written(pairs, "pairs")

    work, go = tasks(blocks, pairs)
    wanted = go.join(members_of(blocks), "bid").join(classes.select("fp", F.col("id").alias("key_id"), F.col("h").alias("key_h")), "fp")
    wanted = keys = written(wanted, "wanted")
    if keys.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(keys)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    rows = texts.join(wanted, F.col("id").eqNullSafe(F.col("key_id")) & (F.col("h") == F.col("key_h")))
    sets = whole_sets(rows, size).groupBy("task", "part")
    found = written(sets.cogroup(work.groupBy("task", "part")).applyInArrow(verify(percent), "fp binary, other binary, linked long"), "links")
    for table in (blocks, pairs, work, keys):
        drop_written(table)

    linked = found.groupBy("fp").agg(F.sum("linked").alias("linked"))
    roots = components(found.where("other is not null").select(F.col("fp").alias("u"), F.col("other").alias("v")))
    member = classes.select("fp", "copies", "first_id").join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.join(smallest, "root").join(linked, "fp", "left").select("fp", "root", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_similar"), "component_id")
    out = d.join(member, "fp", "left").select("id", "h", "n", F.when(F.col("n") == 0, 0).otherwise(F.col("n_similar")).cast("long").alias("n_similar"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "root")
    out = written(out, "joined")
    for table in (d, classes, found, roots):
        drop_written(table)
    return out


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, n_similar, component_id) for every row of `docs`.

    A document's set is its distinct shingles of `size` words, A-Z lower-cased; a shorter text is one shingle as
    a whole, and a text without words has no set. Two documents link if 100 * intersection >= percent * union.
    n_similar counts the other documents linked to this one, component_id is the smallest id reachable by links.

    Documents with equal sets are one class and are counted, not paired. The join is exact: sets without enough
    tokens that others share are out, the rest lie in blocks of at most MEMBERS, and whole sets are read only for
    blocks that share enough prefix tokens. No list, group or pair count is capped.

    A null text or one without words: size 0, no links, its own component. Null ids are documents too, and never
    the smallest id unless all of a component are null. Repeated rows are documents of their own. Other columns
    are not read. An empty table gives an empty result.
    """
    out = joined(docs, text, doc_id, size, percent)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "n_similar", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` but for the documents linked to one that stays: one of each component, with all columns.

    The smallest id stays, null ids last, of equal ids the smaller hash of the text, and of rows that repeat id
    and text one. Documents without words are linked with nothing and stay. What goes is small beside the texts:
    its keys are broadcast below BROADCAST_ROWS and joined by a shuffle beyond that.
    """
    every = joined(docs, text, doc_id, size, percent)
    d = members = written(every.where("root is not null").groupBy("root", "id", "h").agg(F.count("*").alias("rows")), "members")
    drop_written(every)
    first = d.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"))
    d = d.join(first, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")))
    d = written(d.where("not stays or rows > 1").select(F.col("id").alias("key_id"), F.col("h").alias("key_h"), "stays"), "leaving")
    drop_written(members)
    if d.count() <= BROADCAST_ROWS:
        d = F.broadcast(d)
    on = docs[doc_id].cast("long").eqNullSafe(d["key_id"]) & (F.xxhash64(docs[text]) == d["key_h"])
    again = docs.join(d.where("stays"), on, "left_semi")
    again = again.withColumn("key_h", F.xxhash64(text)).dropDuplicates([doc_id, "key_h"]).drop("key_h")
    return docs.join(d, on, "left_anti").unionByName(again)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
