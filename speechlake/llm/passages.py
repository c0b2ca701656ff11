"""Substring dedup: passages that near-repeat in other documents.

Tokens are 5-word shingles. Per hash function, the Cartesian tree over a text's
token hashes gives compact windows (l, c, r): every subsequence that starts in
[l, c] and ends in [c, r] has its minimum at c, so one row stands for all of
them. Only windows of at least ``TOKENS`` tokens (``WORDS`` words) are kept;
their minima are those of sliding windows, so the tree is built over these
alone. Windows of equal minima group the texts: each text of a group is paired
with its smallest one. The matches of a pair are intervals on both sides; where
those of ``ENOUGH`` functions overlap, the passage is verified on its words: a
stretch of ``WORDS`` words on both sides must have a Jaccard similarity of
``SIMILARITY`` between their token sets. Where a text shares no passage with the
smallest one at this place, all windows of the key are compared with each other,
all that have one of the rarest tokens near it in common and no link yet.

A text is known by its 64-bit hash, so exact copies are one text. Texts that a
task reads together are grouped there, and those that share a passage with the
first of a group, token by token, do not go out to meet the groups of other
tasks, so a passage of very many texts is a few rows in any one place; they come
to the second comparison of a key that has one. Rows of a group stream through a
task in order and only the first is held.

Defined results: null, empty and short texts hold no passage and are a class of
their own; repeated rows and copies of at least ``WORDS`` words share a class;
a passage that repeats only inside one text is not looked for; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import BLANK, ascii_lower, query, ship, table
from speechlake.llm.components import components
from speechlake.sources.scratch import stored

SHINGLE = 5
WORDS = 50
TOKENS = WORDS - SHINGLE + 1
SIMILARITY = 0.8
# Shared tokens of the smallest passage.
LEAST = math.ceil(2 * TOKENS * SIMILARITY / (1 + SIMILARITY))
# Tokens on each side of a minimum that its passage of ``TOKENS`` can have.
REACH = TOKENS - 1
# Tokens beside a region that are verified with it.
ROOM = TOKENS - int(SIMILARITY * TOKENS)
# Hash functions, and how many of them must agree on a passage.
FUNCTIONS = 4
ENOUGH = 2
# Words that one step of a task holds.
CHUNK = 2_000_000
# Classes of text hashes; their table has this many rows at most.
SLOTS = 1 << 18
# Left-over windows of a key that a task may hold (182 bytes each).
MEMBERS = 1 << 17
# In ``around``: the window stands for others of its task.
STANDS = np.int64(1) << np.int64(62)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``SHINGLE`` words."""
    words = words.view(np.uint64)
    n = max(len(words) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(0x100000001B3) + words[i : i + n]
    return _mixed(out)


def _sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``size`` neighbours."""
    have = 1
    while 2 * have <= size:
        x = pick(x[:-have], x[have:])
        have *= 2
    return x if have == size else pick(x[: len(x) - (size - have)], x[size - have :])


def compact_windows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``l, c, r`` of the windows of at least ``TOKENS`` tokens.

    Zeros part the texts: no window crosses one. Of equal hashes the first is
    the minimum.
    """
    if len(hashes) < TOKENS:
        return (np.zeros(0, np.int64),) * 3
    least = _sliding(hashes, TOKENS, np.minimum)
    edge = np.zeros(TOKENS - 1, np.uint64)
    reach = _sliding(np.concatenate([edge, least, edge]), TOKENS, np.maximum)
    at = np.flatnonzero((reach == hashes) | (hashes == 0))
    # The tree over the minima: the nearest smaller ones on both sides.
    places, values = at.tolist(), hashes[at].tolist()
    left, right, stack = [-1] * len(at), [len(hashes)] * len(at), []
    for k, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = places[k]
        if stack:
            left[k] = places[stack[-1]]
        stack.append(k)
    l, r = np.array(left, np.int64) + 1, np.array(right, np.int64) - 1
    keep = (r - l + 1 >= TOKENS) & (hashes[at] > 0)
    return l[keep], at[keep], r[keep]


def thinned(hashes: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of the minima ``c`` that follow each other in a run of one token, the first,
    every ``TOKENS``-th and the last. A stretch that starts at another one has the
    tokens of the one that starts at the first, and no place is further from a
    window that stays than a passage is long."""
    again = (np.diff(c) == 1) & (hashes[c[1:]] == hashes[c[:-1]])
    start = np.maximum.accumulate(np.where(np.append(False, again), 0, np.arange(len(c)))) if len(c) else c
    return ((np.arange(len(c)) - start) % TOKENS == 0) | np.append(~again, True)[: len(c)]


_ROW = "key long, text long, at int, around long, found struct<b:long,number:int,first:int,last:int,shift:int>"
_FOUND = pa.struct([("b", pa.int64()), *((n, pa.int32()) for n in ("number", "first", "last", "shift"))])


def _found(rows: tuple, a: np.ndarray, b: np.ndarray, number: np.ndarray, least: int = 0) -> pa.StructArray:
    """Matches of the rows ``a`` with the rows ``b``; they reach ``least``
    tokens to both sides at least."""
    _, text, at, around = rows
    left = np.maximum(np.minimum(around[a] >> 32, around[b] >> 32), least)
    right = np.maximum(np.minimum(around[a] & 0xFFFFFFFF, around[b] & 0xFFFFFFFF), least)
    values = [text[b], number, np.maximum(at[a] - left, 0), at[a] + right, at[b].astype(np.int64) - at[a]]
    return pa.StructArray.from_arrays([pa.array(v.astype(np.int64)).cast(f.type) for v, f in zip(values, _FOUND)], fields=list(_FOUND))


def _paired(rows: tuple, first: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """Matches of the rows (key, text, at, around) with the first rows of their
    groups: the rows, and what was found. Only matches that reach far enough on
    both texts count."""
    key, text, _, around = rows
    left = np.minimum(around >> 32, around[first] >> 32)
    right = np.minimum(around & 0xFFFFFFFF, around[first] & 0xFFFFFFFF)
    a = np.flatnonzero((text != text[first]) & (left + right + 1 >= int(SIMILARITY * TOKENS)))
    return a, _found(rows, a, first[a], key[a] & (FUNCTIONS - 1))


def _near(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, starts: np.ndarray, stops: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray) -> np.ndarray:
    """Whether ``TOKENS`` tokens that hold place ``a`` surely are a passage with
    those at place ``b`` of another text, token by token."""
    out = np.zeros(len(a), bool)
    steps = np.arange(-REACH, REACH + 1)
    for low in range(0, len(a), 20_000):
        part = slice(low, low + 20_000)
        x, y = a[part, None] + steps, b[part, None] + steps
        inside = (x >= starts[doc_a[part], None]) & (x < stops[doc_a[part], None]) & (y >= starts[doc_b[part], None]) & (y < stops[doc_b[part], None])
        same = inside & (tokens[np.where(inside, x, 0)] == tokens[np.where(inside, y, 0)])
        total = np.zeros((len(x), 2 * REACH + 2), np.int32)
        np.cumsum(np.where(inside, same, -TOKENS), axis=1, out=total[:, 1:])
        out[part] = (total[:, TOKENS:] - total[:, :-TOKENS]).max(axis=1, initial=0) >= LEAST
    return out


def _firsts(key: np.ndarray) -> np.ndarray:
    """For rows in the order of their keys, the place of the key's first row."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows ``key, text, at, around``: minimum (its lowest bits name the
    function), text, place of the minimum, and how far the window reaches to
    both sides; or a match of ``text`` in ``found``, whose key is mixed with the text."""
    names = ["key", "text", "at", "around", "found"]
    for batch in batches:
        texts, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        ends = lists.offsets.to_numpy()
        words = lists.flatten().to_numpy(zero_copy_only=False)
        ends = ends - ends[0]
        cuts = [0]
        for i in range(1, len(ends)):
            if ends[i] - ends[cuts[-1]] > CHUNK and i - 1 > cuts[-1]:
                cuts.append(i - 1)
        for start, end in zip(cuts, [*cuts[1:], len(texts)]):
            parts, owners, firsts, at = [np.zeros(1, np.uint64)], [], [], 1
            seen: set[int] = set()
            for i in range(start, end):
                if texts[i] in seen:
                    continue
                seen.add(texts[i])
                own = shingles(words[ends[i] : ends[i + 1]])
                if len(own) >= TOKENS:
                    parts += [own, np.zeros(1, np.uint64)]
                    owners.append(texts[i])
                    firsts.append(at)
                    at += len(own) + 1
            if not owners:
                continue
            tokens, owners, firsts = np.concatenate(parts), np.array(owners, np.int64), np.array(firsts)
            stops = np.append(firsts[1:], len(tokens)) - 1
            for number in range(FUNCTIONS):
                hashes = np.where(tokens == 0, tokens, _mixed(tokens ^ _SEEDS[number]) | np.uint64(1))
                l, c, r = compact_windows(hashes)
                l, c, r = (x[thinned(hashes, c)] for x in (l, c, r))
                doc = np.searchsorted(firsts, c, "right") - 1
                key = (hashes[c] & ~np.uint64(FUNCTIONS - 1) | np.uint64(number)).view(np.int64)
                rows = (key, owners[doc], (c - firsts[doc]).astype(np.int32), ((c - l) << 32) | (r - c))
                order = np.lexsort((rows[1], key))
                rows, place, doc = tuple(x[order] for x in rows), c[order], doc[order]
                first = _firsts(rows[0])
                a = np.flatnonzero(rows[1] != rows[1][first])
                a = a[_near(tokens, place[a], place[first[a]], firsts, stops, doc[a], doc[first[a]])]
                sent = np.ones(len(first), bool)
                sent[a] = False
                stands = np.zeros(len(first), np.int64)
                stands[first[a]] = STANDS
                columns = [pa.array(x[sent]) for x in (*rows[:3], rows[3] | stands)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(int(sent.sum()), _FOUND)], names)
                if len(a):
                    found = _found(rows, a, first[a], np.full(len(a), FUNCTIONS), REACH)
                    spread, text = pa.array(rows[0][a] ^ rows[1][a]), pa.array(rows[1][a])
                    yield pa.RecordBatch.from_arrays([spread, text, pa.array(rows[2][a]), pa.array(rows[3][a]), found], names)


_REGION = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((n, pa.int32()) for n in ("a_first", "a_last", "b_first", "b_last"))])
_LEFT = [("key", pa.int64()), ("at", pa.int32()), ("around", pa.int64())]


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes matches on with the window they are of and pairs each window with the
    first of its key; rows come in the order of (key, text, at), those of exact copies
    count once. Keys that hold two texts or more besides their first row, or one
    besides a first row that has copies, or where a window stands for others, go out
    as well (``key``, ``at``, ``around``, ``shift`` to the first; no ``number``)."""

    def made(text: pa.Array, found: pa.StructArray, left: list | None = None) -> pa.RecordBatch:
        columns = [text, *found.flatten(), *(left or [pa.nulls(len(text), kind) for _, kind in _LEFT])]
        return pa.RecordBatch.from_arrays(columns, ["a", *_FOUND.names, *(n for n, _ in _LEFT)])

    # Rows of the last key: its first one, and all others while they are of one text, else two.
    last: tuple | None = None
    sent, copied = 0, False  # of these, how many have gone out; whether the first has copies or one stands for others
    for batch in batches:
        old = batch.filter(batch.column("found").is_valid())
        if old.num_rows:
            mixed, text = (old.column(n).to_numpy(zero_copy_only=False) for n in ("key", "text"))
            yield made(old.column("text"), old.column("found"), [pa.array(mixed ^ text), old.column("at"), old.column("around")])
        fresh = batch.filter(batch.column("found").is_null())
        rows, known = tuple(fresh.column(i).to_numpy(zero_copy_only=False) for i in range(4)), 0
        if last is not None:
            known = len(last[0])
            rows = tuple(np.concatenate([v, x]) for v, x in zip(last, rows))
        if not len(rows[0]):
            continue
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
        copies = np.zeros(int(new.sum()), bool)
        copies[(np.cumsum(new) - 1)[~new]] = True
        copies[0] |= copied
        stands = (np.cumsum(new) - 1)[rows[3] >= STANDS]
        rows = tuple(x[new] for x in (*rows[:3], rows[3] & ~STANDS))
        first = _firsts(rows[0])
        copies[first[stands]] = True
        end = np.append(np.flatnonzero(np.diff(first)), len(first) - 1)[np.cumsum(np.arange(len(first)) == first) - 1]
        a, found = _paired(rows, first)
        if len(a) and a[-1] >= known:
            yield made(pa.array(rows[1][a[a >= known]]), found.filter(pa.array(a >= known)))
        several = rows[1][np.minimum(first + 1, end)] != rows[1][end]
        out = several | (copies[first] & (rows[1][first] != rows[1][end]))
        many = np.flatnonzero(out & (np.arange(len(first)) >= sent))
        if len(many):
            none = [pa.nulls(len(many), f.type) for f in list(_FOUND)[1:-1]]
            shift = pa.array(rows[2][first[many]] - rows[2][many])
            columns = [pa.array(rows[1][many]), pa.array(rows[1][first[many]]), *none, shift, *(pa.array(rows[k][many]) for k in (0, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns, ["a", *_FOUND.names, *(n for n, _ in _LEFT)])
        start = first[-1]
        last, copied = tuple(x[[start, start + 1, -1]] if several[-1] else x[start:] for x in rows), bool(copies[start])
        sent = len(last[0]) if out[-1] else 0


def _with_places(batches: Iterator[pa.RecordBatch], texts: bool = False) -> Iterator[tuple]:
    """Words and places (``key, at, around, mate``) of every text."""
    for batch in batches:
        lists = batch.column("places")
        ends, fields = lists.offsets.to_numpy(), lists.values
        values = {n: fields.field(n).to_numpy(zero_copy_only=False) for n in ("key", "at", "around", "mate")}
        words = batch.column("words")
        for k, text in enumerate(batch.column("text").to_pylist()):
            row = words[k].values.to_numpy(zero_copy_only=False), {n: v[ends[k] : ends[k + 1]] for n, v in values.items()}
            yield (text, *row) if texts else row


def _tier(a: int, b: int) -> tuple[int, int]:
    """Shortest length of windows of ``a`` to ``b`` tokens, and how many of their
    rarest tokens hold one that a similar passage of ``TOKENS`` or more has too."""
    common = lambda n: max(math.ceil(SIMILARITY * (n + TOKENS) / (1 + SIMILARITY) - 1e-9), math.ceil(SIMILARITY * n - 1e-9))
    return a, max(n - common(n) + 1 for n in range(a, b + 1))


_TIERS = [_tier(a, b) for a, b in ((TOKENS, 52), (53, 65), (66, 2 * REACH + 1))]


def rarest(tokens: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of a place, place of a token near it): of every window that
    holds the place, the rarest tokens.

    Two passages of at least ``TOKENS`` tokens whose Jaccard similarity is
    ``SIMILARITY`` share one of the rarest few of each, in any order common to
    all texts (prefix filtering, Chaudhuri et al., 2006). Near a place with
    repeated tokens, all count.
    """
    width = 2 * REACH + 1
    found_place, found_token = [], []
    own = np.arange(width)
    for low in range(0, len(at), 64):
        near = at[low : low + 64, None] + np.arange(-REACH, REACH + 1)
        valid = (near >= 0) & (near < len(tokens))
        near = np.where(valid, near, 0)
        rank = np.where(valid, ranks[near], len(tokens) + own)
        below = np.zeros((len(near), width, width + 1), np.int16)
        np.cumsum(rank[:, None, :] < rank[:, :, None], axis=2, out=below[:, :, 1:])
        taken = np.zeros(valid.shape, bool)
        for size, most in _TIERS:
            start = np.arange(max(REACH - size + 1, 0), min(REACH, width - size) + 1)
            whole = valid[:, start] & valid[:, start + size - 1]
            inside = (own[:, None] >= start) & (own[:, None] < start + size)
            few = below[:, :, start + size] - below[:, :, start] < most
            taken |= (few & inside & whole[:, None, :]).any(axis=2)
        same = np.sort(np.where(valid, tokens[near], np.uint64(0)), axis=1)
        repeated = ((same[:, 1:] == same[:, :-1]) & (same[:, 1:] > 0)).any(axis=1)
        taken = np.where(repeated[:, None], valid, taken)
        place, token = np.nonzero(taken)
        found_place.append(place + low)
        found_token.append(near[place, token])
    return np.concatenate(found_place), np.concatenate(found_token)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, text, at, around, mate, near``: the tokens near a place in 16 bits each,
    zeros beyond the text."""
    for text, words, places in _with_places(batches, True):
        tokens = shingles(words)
        if len(tokens) < TOKENS:
            continue
        small = (tokens >> np.uint64(48)).astype(np.uint16)
        small[small == 0] = 1
        edge = np.zeros(REACH, np.uint16)
        near = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, small, edge]), 2 * REACH + 1)[places["at"]]
        columns = [pa.array(places["key"]), pa.array(np.full(len(near), text, np.int64)), *(pa.array(places[n]) for n in ("at", "around", "mate"))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([row.tobytes() for row in near], pa.binary())], ["key", "text", "at", "around", "mate", "near"])


def _distinct(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sketch: where its tokens occur first, the least number of distinct
    tokens in ``TOKENS`` neighbours, and the least of those that are not one token
    over and over (more than a sketch holds if there are none)."""
    if len(near) > 8192:
        parts = [_distinct(near[low : low + 8192]) for low in range(0, len(near), 8192)]
        return tuple(np.concatenate(p) for p in zip(*parts))
    width = near.shape[1]
    order = np.argsort(near, axis=1, kind="stable")
    ordered = np.take_along_axis(near, order, axis=1)
    before = np.full(near.shape, -1, np.int16)
    again = ordered[:, 1:] == ordered[:, :-1]
    np.put_along_axis(before, order[:, 1:], np.where(again, order[:, :-1], -1).astype(np.int16), axis=1)
    valid = near > 0
    least, more = (np.full(len(near), TOKENS, np.int64) for _ in range(2))
    rows = np.flatnonzero((again & (ordered[:, 1:] > 0)).any(axis=1))
    more[rows] = 2 * width
    for low in range(0, len(rows), 1024):
        part = rows[low : low + 1024]
        for start in range(width - TOKENS + 1):
            inside = slice(start, start + TOKENS)
            n = np.where(valid[part, inside].all(axis=1), (before[part, inside] < start).sum(axis=1), 2 * width)
            least[part] = np.minimum(least[part], n)
            more[part] = np.minimum(more[part], np.where(n > 1, n, 2 * width))
    return valid & (before < 0), least, more


def _times(near: np.ndarray) -> np.ndarray:
    """How often each token of a sketch stands in it; beyond the text, once."""
    out = np.ones(near.shape, np.int64)
    for low in range(0, len(near), 1024):
        part = near[low : low + 1024]
        out[low : low + 1024] = np.where(part > 0, (part[:, :, None] == part[:, None, :]).sum(axis=2), 1)
    return out


def _reaches(hit: np.ndarray, times: np.ndarray, both_plain: np.ndarray) -> np.ndarray:
    """Whether a stretch of tokens, ``hit`` where the other side has them, may be a
    side of a passage; an upper bound that costs little. ``times``: how often a
    token stands near.

    Of the distinct tokens of a stretch those that miss may be a quarter of the hits
    at most. A miss that stands ``n`` times near counts as an ``n``-th each time.
    Where no token is repeated on either side (``both_plain``), ``m`` hits among
    ``x`` tokens need ``(1 + s) m >= s (x + TOKENS)`` as well.
    """
    share, place, unit = round(10 * SIMILARITY), np.arange(hit.shape[1] + 1), 5040
    run = np.zeros((len(hit), hit.shape[1] + 1), np.int64)
    most = lambda v: (v[:, TOKENS:] - np.minimum.accumulate(v[:, :-TOKENS], axis=1)).max(axis=1)
    np.cumsum(np.where(hit, (10 - share) * unit, -(share * unit // times.astype(np.int64))), axis=1, out=run[:, 1:])
    alone = most(run) >= 0
    np.cumsum(hit, axis=1, out=run[:, 1:])
    return alone & (~both_plain | (most((10 + share) * run - share * place) >= share * TOKENS))


def _rising(hit: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of sketches without repeated tokens: whether the shared tokens (``hit``
    on one side, at ``place`` on the other) have one order, and if so, whether they
    make a passage, as ``_longest`` says. There is no other one then: what any two
    stretches share is a run of these, and no longer than the stretches."""
    many = hit.sum(axis=1)
    n, over, under = int(many.max()), round(10 * (1 + SIMILARITY)), round(10 * SIMILARITY)
    valid = np.arange(n) < many[:, None]
    i = np.argsort(~hit, axis=1, kind="stable")[:, :n]
    j = np.take_along_axis(place, i, axis=1)
    rising = ((np.diff(j, axis=1) > 0) | ~valid[:, 1:]).all(axis=1)
    far = 10_000 * np.arange(1, n + 1)
    i, j = (np.where(valid, v, far) for v in (i, j))
    found = np.zeros(len(hit), bool)
    for m in range(LEAST, min(TOKENS - 1, n) + 1):
        x, y = (np.maximum(v[:, m - 1 :] - v[:, : n - m + 1] + 1, TOKENS) for v in (i, j))
        found |= (over * m >= under * (x + y)).any(axis=1)
    if n >= TOKENS:
        value = over * np.arange(n) - under * (i + j)
        least = np.minimum.accumulate(value[:, : n - TOKENS + 1], axis=1)
        found |= (value[:, TOKENS - 1 :] - least >= 2 * under - over).any(axis=1)
    return rising, found


def linked(text: np.ndarray, near: np.ndarray, traits: tuple | None = None, group: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links of the windows of one key (their texts and sketches) with earlier ones
    that they share a passage with. Every such pair ends up in one class; a pair
    that other links have joined by then is not compared. Of equal sketches the
    first stands for all, the others are linked to it. ``traits`` are those of
    ``_distinct``. Windows of one ``group`` are linked already; those of the largest
    one come last and meet the others only.

    A passage has ``need`` of a window's tokens in common with another, so two of
    them share one of the rarest of each, in the order of how often tokens occur
    in the key. A token that occurs once leads nowhere, so most windows of a
    frequent line meet nobody. Windows in which the key's token fills ``TOKENS``
    places are passages of each other and need no comparison; with other windows
    they have at least two tokens in common, so the key's token leads nowhere either.
    """
    width = near.shape[1]
    _, first, same = np.unique(np.ascontiguousarray(near).view(f"V{near.itemsize * width}").ravel(), return_index=True, return_inverse=True)
    first = first[same.ravel()]
    held = (near > 0).sum(axis=1)
    whole = held >= TOKENS
    root, kin, grouped = np.arange(len(near)), {}, np.zeros(len(near), bool)
    if group is not None:
        _, lead, number, size = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        root, grouped = lead[number], size[number] > 1
        for k in np.flatnonzero(grouped).tolist():
            kin.setdefault(int(root[k]), []).append(k)

    def join(k: int, x: int) -> None:
        low, high = sorted((int(root[k]), int(root[x])))
        moved = kin.pop(high, [high])
        kin.setdefault(low, [low]).extend(moved)
        root[moved] = low

    again = np.flatnonzero((first < np.arange(len(near))) & whole)
    for k in again[text[again] != text[first[again]]].tolist():
        if root[k] != root[first[k]]:
            yield k, int(first[k])
            join(k, first[k])
    # A window of the same text stands for another one only where neither had a link or both are linked.
    again = again[(text[again] == text[first[again]]) & (root[again] != root[first[again]]) & (grouped[again] | grouped[first[again]])]
    rows = np.union1d(first[whole], again)
    fresh, least, more = _distinct(near) if traits is None else traits
    runs = rows[least[rows] == 1]
    for token in np.unique(near[runs, width // 2]):
        own = runs[near[runs, width // 2] == token]
        apart = text[own] != text[own[0]]
        if apart.any():
            mate = int(own[apart][0])
            for x, others in ((int(own[0]), own[apart].tolist()), (mate, own[~apart][1:].tolist())):
                for k in others:
                    if root[k] != root[x]:
                        yield max(k, x), min(k, x)
                        join(k, x)
    plain, need = least == TOKENS, np.ceil(SIMILARITY * more - 1e-9).astype(np.int64)
    kinds = fresh.sum(axis=1)
    single = kinds == held
    times = np.ones(near.shape, np.uint8)
    again = rows[~single[rows]]
    times[again] = _times(near[again])
    counts = np.bincount(near[rows][fresh[rows]], minlength=1 << 16)
    known: dict[int, array] = {}
    mark, spot = np.zeros(1 << 16, bool), np.empty(1 << 16, np.int64)
    never = np.int64(1) << 62
    last = np.zeros(len(near), bool)
    if grouped[rows].any():
        _, number, size = np.unique(root[rows], return_inverse=True, return_counts=True)
        last[rows[number == np.argmax(size)]] = True
        rows = np.concatenate([rows[~last[rows]], rows[last[rows]]])
    for low in range(0, len(rows), 4096):
        part = rows[low : low + 4096]
        rank = np.sort(np.where(fresh[part], counts[near[part]] << 16 | near[part], never), axis=1)
        size = kinds[part] - need[part] + 1
        taken = (np.arange(rank.shape[1]) < size[:, None]) & (rank >> 16 > 1) & (rank < never)
        for row in np.flatnonzero(taken.any(axis=1)):
            k, tokens = int(part[row]), (rank[row][taken[row]] & 0xFFFF).tolist()
            met = [np.frombuffer(known[token], np.int64) for token in tokens if token in known]
            others = np.concatenate(met) if met else rows[:0]
            del met
            others = np.unique(others[(root[others] != root[k]) & (text[others] != text[k])])
            if len(others):
                around, mine = near[others], near[k]
                mark[mine] = True
                mark[0] = False
                hit = mark[around]
                mark[mine] = False
                common = (hit & fresh[others]).sum(axis=1)
                may = common >= np.where(plain[k] & plain[others], LEAST, np.maximum(need[k], need[others]))
                others, common, around, hit = others[may], common[may], around[may], hit[may]
                sure = common >= SIMILARITY * (kinds[k] + kinds[others] - common)  # all that stands near is similar
                alike = single[others] & single[k]
                may = sure | _reaches(hit, times[others], alike)
                if may.any():
                    spot[mine] = np.arange(width)
                    back, (at, place) = np.zeros(hit.shape, bool), np.nonzero(hit)
                    back[at, spot[around[at, place]]] = True
                    may &= sure | _reaches(back[:, spot[mine]], times[k], alike)
                others, common, around, hit, sure, alike = (v[may] for v in (others, common, around, hit, sure, alike))
                if len(others):
                    rising, passage = _rising(hit, np.where(hit, spot[around], 0))
                    sure |= rising & passage & alike
                    may = sure | ~(rising & alike)
                    others, common, sure = others[may], common[may], sure[may]
                mine = mine[mine > 0]
                for at in np.lexsort((-common, ~sure)).tolist():
                    x = int(others[at])
                    if root[x] != root[k] and (sure[at] or next(_matching(mine, near[x][near[x] > 0]), None)):
                        yield k, x
                        join(k, x)
            for token in () if last[k] else tokens:
                known.setdefault(token, array("q")).append(k)


def _meeting(key: np.ndarray, near: np.ndarray, fresh: np.ndarray, least: np.ndarray, more: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """The rows of which so many tokens occur in other rows of their key (of another
    ``group``) that they can be linked; rows come in the order of the keys. An upper
    bound: tokens are told apart by a hash."""
    slots = 1 << 23
    need = np.where(least == 1, 1, np.ceil(SIMILARITY * least - 1e-9))
    number = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.uint64)
    low, high = np.empty(slots, np.int32), np.empty(slots, np.int32)
    group = np.arange(len(key)) if group is None else group
    rows = np.argsort(group, kind="stable")  # the first and the last of a slot differ if any two do
    for _ in range(2):
        at, place = np.nonzero(fresh[rows])
        slot = (_mixed(number[rows[at]] << np.uint64(16) | near[rows[at], place]) & np.uint64(slots - 1)).astype(np.int64)
        high[slot] = at
        low[slot[::-1]] = at[::-1]
        own = group[rows]
        shared = np.bincount(at[own[low[slot]] != own[high[slot]]], minlength=len(rows))
        rows = rows[shared >= need[rows]]
    return np.sort(rows)


def _grouped(key: np.ndarray, text: np.ndarray, at: np.ndarray, mate: np.ndarray) -> np.ndarray:
    """Numbers of the groups of windows that are linked already: ``mate`` is the
    name (``_NAME``) of a window of the key that a window is linked to, or 0."""
    own = text ^ at.astype(np.int64) << 32
    names = [_mixed(key.view(np.uint64) ^ _mixed(x.view(np.uint64))) for x in (own, np.where(mate == 0, own, mate))]
    _, number = np.unique(np.concatenate(names), return_inverse=True)
    a, b = number[: len(own)], number[len(own) :]
    group, before = np.arange(2 * len(own)), None
    while before is None or (group != before).any():
        before = group.copy()
        low = np.minimum(group[a], group[b])
        np.minimum.at(group, a, low)
        np.minimum.at(group, b, low)
    return group[a]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of keys of at most ``MEMBERS`` rows (``_STAR``, no key); rows come in
    the order of the keys."""
    names = ["key", "text", "at", "around", "mate"]
    held: list[list[np.ndarray]] = []

    def made() -> pa.RecordBatch:
        key, text, at, around, mate, near = (np.concatenate([h[k] for h in held]) for k in range(6))
        held.clear()
        group = _grouped(key, text, at, mate)
        new = np.ones(len(key), bool)  # a window may come from several tasks
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1])
        key, text, at, around, near, group = (v[new] for v in (key, text, at, around, near, group))
        traits = _distinct(near)
        rows = _meeting(key, near, *traits, group)
        key, text, at, around, near, group = (v[rows] for v in (key, text, at, around, near, group))
        traits = tuple(t[rows] for t in traits)
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
        parts = [slice(s, e) for s, e in zip(cuts, cuts[1:]) if e - s > 1]
        pairs = [(p.start + k, p.start + x) for p in parts for k, x in linked(text[p], near[p], tuple(t[p] for t in traits), group[p])]
        a, b = (np.array(side, np.int64) for side in (zip(*pairs) if pairs else ((), ())))
        columns = [pa.array(v) for v in (text[a], text[b], at[a], around[a], at[b], around[b], key[a])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "a_at", "a_around", "b_at", "b_around", "key"])

    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = batch.column("near")
        near = np.frombuffer(b"".join(sketch.to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        rows = [batch.column(n).to_numpy(zero_copy_only=False) if n in batch.schema.names else np.zeros(len(near), np.int64) for n in names] + [near]
        last = int(np.flatnonzero(rows[0] == rows[0][-1])[0])  # the last key may go on
        if last or (held and held[-1][0][-1] != rows[0][0]):
            if not last:
                yield made()
            else:
                held.append([x[:last] for x in rows])
                yield made()
        held.append([x[last:] for x in rows])
    if held:
        yield made()


# A window's name within its key; ``text`` and ``at`` are columns.
_NAME = "{text} ^ shiftleft(CAST({at} AS BIGINT), 32)"
_PLACE = ["a_first", "a_last", "b_first", "b_last", "a_at", "b_at"]
_STAR = "a long, b long, a_at int, a_around long, b_at int, b_around long, key long"


def _gathered(docs: DataFrame, left: DataFrame) -> DataFrame:
    """``text, words, places`` of the texts of ``left`` (key, text, at, around, mate)."""
    places = left.select("text", F.struct("key", "at", "around", "mate").alias("place"))
    texts = _texts_near(docs, left.select("text")).select(F.xxhash64("text").alias("hash"), "text", F.lit(None).cast("struct<key:long,at:int,around:long,mate:long>").alias("place"))
    both = texts.unionByName(places.select(F.col("text").alias("hash"), F.lit(None).cast("string").alias("text"), "place"))
    # Texts are stored as they are: their words' hashes take more room.
    grouped = both.groupBy("hash").agg(F.any_value("text", True).alias("text"), F.collect_list("place").alias("places"))
    grouped = stored(grouped.where("size(places) > 0"), "left-texts")
    return grouped.select(F.col("hash").alias("text"), _words().alias("words"), "places")


def _star_regions(stars: DataFrame) -> DataFrame:
    """Regions around the two places of a star's rows, those of a pair together."""
    low = F.lit(0xFFFFFFFF)
    left = F.greatest(F.least(F.shiftright("a_around", 32), F.shiftright("b_around", 32)), F.lit(REACH)).cast("int")
    right = F.greatest(F.least(F.col("a_around").bitwiseAND(low), F.col("b_around").bitwiseAND(low)), F.lit(REACH)).cast("int")
    regions = stars.select(
        "a", "b", F.greatest(F.col("a_at") - left, F.lit(0)).alias("a_first"), (F.col("a_at") + right).alias("a_last"),
        F.greatest(F.col("b_at") - left, F.lit(0)).alias("b_first"), (F.col("b_at") + right).alias("b_last"), "a_at", "b_at",
    )
    ends = [F.min("a_first").alias("a_first"), F.max("a_last").alias("a_last"), F.min("b_first").alias("b_first"), F.max("b_last").alias("b_last")]
    return regions.groupBy("a", "b").agg(*ends, F.collect_set(F.struct(*_PLACE)).alias("regions"))


def _apart(docs: DataFrame, left: DataFrame) -> DataFrame:
    """Verified near-repeats between windows ``key, text, at, around, mate`` of equal
    keys; those that ``mate`` joins are linked already.

    Windows are compared by sketches of the tokens near them, a key at a time. A
    key of more than ``MEMBERS`` windows is cut into blocks of half as many, and
    every two of them are compared, so no task holds more and no pair is left out.
    Windows that are linked to the first one of their key have blocks of their own,
    which meet the others' blocks only.
    """
    mated = F.col("mate") != 0
    members = left.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    large = stored(members.where(F.col("members") > MEMBERS).select("key"), "large-keys")
    if not large.isEmpty():
        rows = stored(left.join(large, "key").withColumn("name", F.expr(_NAME.format(text="text", at="at"))), "large-rows")
        # Windows without a mate stand apart, and those that are linked to such a one.
        free = rows.where(~mated & ~F.col("first")).select("key", F.col("name").alias("mate"), F.lit(True).alias("apart")).distinct()
        free = stored(free, "free")
        rows = rows.join(free, ["key", "mate"], "left").withColumn("apart", F.coalesce("apart", ~mated & ~F.col("first")))
        half = lambda apart: F.ceil(F.sum((F.col("apart") == apart).cast("int")) / (MEMBERS // 2)).cast("int")
        blocks = stored(rows.groupBy("key").agg(F.greatest(half(True), F.lit(1)).alias("apart_blocks"), half(False).alias("blocks")), "blocks")
        place = F.xxhash64("text", "at")
        own = F.when(F.col("apart"), F.pmod(place, F.col("apart_blocks"))).otherwise(F.col("apart_blocks") + F.pmod(place, F.greatest("blocks", F.lit(1)))).cast("int")
        count = F.col("apart_blocks") + F.when(F.col("apart"), F.col("blocks")).otherwise(0)
        others = F.filter(F.sequence(F.lit(0), count - 1), lambda x: x != F.col("own"))
        cut = rows.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(others))
        key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")
        columns = ["text", "at", "around", "mate"]
        left = left.join(large, "key", "left_anti").select("key", *columns).union(cut.select(key, *columns))
        left = stored(left, "left-blocks")
    near = _gathered(docs, left).mapInArrow(_sketches, "key long, text long, at int, around long, mate long, near binary")
    stars = near.repartition("key").sortWithinPartitions("key", "text", "at").mapInArrow(_compared, _STAR)
    return stored(_checked(docs, stored(_star_regions(stars), "regions-apart")), "found-apart")


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the matches of enough functions overlap, or one that a task has
    compared (number ``FUNCTIONS``), per pair: ``a, b`` and first and last token
    on both sides. Rows come in the order of the pairs."""

    def swept(rows: list[tuple]) -> Iterator[tuple]:
        """Maximal stretches that intervals of enough functions cover."""
        changes = sorted([(first, 0, number, shift) for number, first, _, shift in rows] + [(end + 1, 1, number, shift) for number, _, end, shift in rows])
        open_count, shifts, begun, seen = [0] * (FUNCTIONS + 1), {}, None, []
        for place, closes, number, shift in changes:
            open_count[number] += -1 if closes else 1
            shifts[shift] = shifts.get(shift, 0) + (-1 if closes else 1)
            covered = open_count[FUNCTIONS] > 0 or sum(n > 0 for n in open_count) >= ENOUGH
            if covered and begun is None:
                begun, seen = place, [s for s, n in shifts.items() if n]
            elif covered:
                seen.append(shift)
            elif begun is not None:
                if place - begun >= int(SIMILARITY * TOKENS):
                    yield begun, place - 1, max(begun + min(seen), 0), max(place - 1 + max(seen), 0)
                begun = None

    def found(pair: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*pair, *stretch) for stretch in swept(rows)]

    names = ["a", "b", "a_first", "a_last", "b_first", "b_last"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]

    def table_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)

    pair, rows = None, []
    for batch in batches:
        out: list[tuple] = []
        for a, b, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != pair:
                if rows:
                    out += found(pair, rows)
                pair, rows = (a, b), []
            rows.append(tuple(row))
        yield table_of(out)
    if rows:
        yield table_of(found(pair, rows))


def stretches(matched: np.ndarray, penalty: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``TOKENS`` of the largest sums, where a match
    counts 1 and a miss ``-penalty``; first the best, then beside it."""
    todo = [(0, len(matched))]
    while todo:
        start, end = todo.pop()
        if end - start < TOKENS:
            continue
        run = np.concatenate([[0], np.cumsum(np.where(matched[start:end], 1, -penalty))])
        low = np.minimum.accumulate(run)
        stop = int(np.argmax(run - low))
        begin = int(np.flatnonzero(run[: stop + 1] == low[stop])[-1])
        if stop - begin >= TOKENS:
            yield start + begin, start + stop
            todo += [(start, start + begin), (start + stop, end)]


def _aligned(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of shared tokens on both sides, in an order common to both."""
    order = np.argsort(right, kind="stable")
    low, high = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    many = high - low
    if many.sum() > 2 * (len(left) + len(right)):  # periodic: the n-th with the n-th
        own = np.argsort(left, kind="stable")
        nth = np.empty(len(left), np.int64)
        nth[own] = np.arange(len(left)) - np.searchsorted(left[own], left[own])
        i = np.flatnonzero(nth < many)
        j = order[low[i] + nth[i]]
    else:  # places in falling order, so that a rising chain takes one of a token's
        i = np.repeat(np.arange(len(left)), many)
        j = order[np.repeat(high, many) - 1 - (np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many))]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return i, j
    ends, at, before = [], [], []
    for k, place in enumerate(j.tolist()):
        n = bisect_left(ends, place)
        before.append(at[n - 1] if n else -1)
        ends[n:n + 1], at[n:n + 1] = [place], [k]
    chain, k = [], at[-1]
    while k >= 0:
        chain.append(k)
        k = before[k]
    return i[chain[::-1]], j[chain[::-1]]


def _longest(i: np.ndarray, j: np.ndarray) -> tuple[int, int] | None:
    """First and last of the most matches that make a passage.

    ``m`` matches over ``x`` and ``y`` tokens (``TOKENS`` at least) are similar
    enough where ``(1 + s) m >= s (x + y)``.
    """
    n, over, under = len(i), round(10 * (1 + SIMILARITY)), round(10 * SIMILARITY)
    if n < LEAST:
        return None
    # From TOKENS matches on no side needs filling up: the sum is a difference of two places' values.
    value = over * np.arange(n) - under * (i + j)
    reach = np.maximum.accumulate(value[::-1])[::-1]
    far = n - 1 - np.searchsorted(reach[::-1], value - (over - 2 * under))
    size = far - np.arange(n) + 1
    best = int(np.argmax(size))
    if size[best] >= TOKENS:
        return best, int(far[best])
    for m in range(min(TOKENS - 1, n), LEAST - 1, -1):
        x, y = (np.maximum(p[m - 1 :] - p[: n - m + 1] + 1, TOKENS) for p in (i, j))
        good = np.flatnonzero(over * m >= under * (x + y))
        if len(good):
            return int(good[0]), int(good[0]) + m - 1
    return None


def _filled(first: int, last: int, n: int) -> tuple[int, int]:
    """At least ``TOKENS`` of ``n`` tokens around a stretch, end exclusive."""
    start = max(min(first, last + 1 - TOKENS), 0)
    return start, min(max(last + 1, start + TOKENS), n)


def _similar(left: np.ndarray, right: np.ndarray) -> bool:
    own, other = np.unique(left), np.unique(right)
    common = len(np.intersect1d(own, other, assume_unique=True))
    return common >= SIMILARITY * (len(own) + len(other) - common)


def verified(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Word ranges (end exclusive) of near-repeats between two word lists.

    Shared tokens are put in a common order; the most neighbours that make a
    passage are taken, then those beside them. A side of fewer than ``TOKENS``
    tokens is filled up with what stands beside it. What has no common order
    (moved sentences) is compared as a whole and by dense stretches.
    """
    for s, e, t, f in _matching(shingles(a), shingles(b)):
        yield s, e + SHINGLE - 1, t, f + SHINGLE - 1


def _matching(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """The same in tokens."""
    if min(len(left), len(right)) < TOKENS:
        return
    i, j = _aligned(left, right)
    todo, any_found = [(0, len(i))], False
    while todo:
        low, high = todo.pop()
        best = _longest(i[low:high], j[low:high])
        if best is None:
            continue
        p, q = best[0] + low, best[1] + low
        s, e = _filled(int(i[p]), int(i[q]), len(left))
        t, f = _filled(int(j[p]), int(j[q]), len(right))
        if _similar(left[s:e], right[t:f]):
            any_found = True
            yield s, e, t, f
        todo += [(low, p), (q + 1, high)]
    if any_found:
        return
    dense = list(_dense(left, right))
    if not dense and _similar(left, right):
        dense = [(0, len(left), 0, len(right))]
    yield from dense or _even(left, right)


def _even(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of one token on both sides, the longest of each token."""
    longest: list[dict] = []
    for side in (left, right):
        if not (side[REACH:] == side[:-REACH]).any():
            return
        cuts = np.concatenate([[0], np.flatnonzero(side[1:] != side[:-1]) + 1, [len(side)]])
        size = np.diff(cuts)
        runs = sorted((int(size[k]), int(cuts[k])) for k in np.flatnonzero(size >= TOKENS))
        longest.append({int(side[at]): (at, at + n) for n, at in runs})
    for token in longest[0].keys() & longest[1].keys():
        yield *longest[0][token], *longest[1][token]


def _dense(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of the largest sums; one that is not similar enough is searched
    again for denser ones, to the last penalty that leaves unbroken runs only."""
    shared = np.isin(left, right)
    todo = [(0, len(left), 4)]
    while todo:
        start, end, penalty = todo.pop()
        for s, e in stretches(shared[start:end], penalty):
            s, e = start + s, start + e
            own = np.unique(left[s:e])
            again = np.isin(right, own)
            for t, f in stretches(again, penalty):
                other = np.unique(right[t:f])
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common >= SIMILARITY * (len(own) + len(other) - common):
                    yield s, e, t, f
                    break
            else:
                if penalty < TOKENS:
                    todo.append((s, e, 4 * penalty))


def _clusters(regions: list[tuple]) -> Iterator[tuple[list[int], list[tuple]]]:
    """Regions that overlap on both sides, and their common bounds."""
    open_ones: list[tuple[list[int], list[tuple]]] = []
    for region in sorted(regions):
        a_first, a_last, b_first, b_last = region[:4]
        members = [region]
        bounds, rest = [a_first, a_last, b_first, b_last], []
        for other in open_ones:
            low, high, start, end = other[0]
            if high < a_first:
                yield other
            elif start <= b_last and b_first <= end:
                bounds = [min(low, bounds[0]), max(high, bounds[1]), min(start, bounds[2]), max(end, bounds[3])]
                members = other[1] + members if len(other[1]) < len(members) else _joined(other[1], members)
            else:
                rest.append(other)
        open_ones = [*rest, (bounds, members)]
    yield from open_ones


def _joined(held: list[tuple], more: list[tuple]) -> list[tuple]:
    held.extend(more)
    return held


def _of_pair(x: np.ndarray, y: np.ndarray, regions: list[tuple]) -> set[tuple]:
    """Near-repeats between the words of two texts in the regions of a pair.

    Regions that overlap on both sides are verified as one; those whose place no
    passage found there holds are then verified by themselves.
    """
    found: set[tuple] = set()

    def search(a_first: int, a_last: int, b_first: int, b_last: int) -> list[tuple]:
        i, j = max(a_first - ROOM, 0), max(b_first - ROOM, 0)
        parts = x[i : a_last + SHINGLE + ROOM], y[j : b_last + SHINGLE + ROOM]
        return [(s + i, e + i, t + j, f + j) for s, e, t, f in verified(*parts)]

    for bounds, members in _clusters(regions):
        spans = search(*bounds)
        found.update(spans)
        if len(members) > 1:
            sides = [np.array([span[k : k + 2] for span in spans], np.int64).reshape(-1, 2) for k in (0, 2)]
            for *region, a_at, b_at in members:
                held = [((side[:, 0] <= at) & (at + SHINGLE <= side[:, 1])).any() for side, at in zip(sides, (a_at, b_at))]
                if not all(held):
                    found.update(search(*region))
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "a_start", "a_end", "b_start", "b_end"]
    for batch in batches:
        out = []
        for a, b, a_first, b_first, a_words, b_words, *regions in zip(*batch.columns):
            x, y = (w.values.to_numpy(zero_copy_only=False) for w in (a_words, b_words))
            i, j = a_first.as_py(), b_first.as_py()
            if regions:
                places = zip(*(regions[0].values.field(n).to_pylist() for n in _PLACE))
                spans = _of_pair(x, y, [tuple(v - (i, i, j, j, i, j)[k] for k, v in enumerate(place)) for place in places])
            else:
                spans = verified(x, y)
            out += [(a.as_py(), b.as_py(), s + i, e + i, t + j, f + j) for s, e, t, f in spans]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64() if k < 2 else pa.int32()) for k in range(6)], names)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("text"), _words().alias("words"))


def _words() -> Column:
    """Hashes of the words of the column ``text``."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), BLANK), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def passages(docs: DataFrame) -> DataFrame:
    """Verified near-repeats ``a, b, a_start, a_end, b_start, b_end`` between
    texts (hashes) of ``docs(text)``, in words, end exclusive."""
    ship(docs.sparkSession)
    windows = _hashed(docs).mapInArrow(_windows, _ROW)
    matches = stored(
        windows.repartition("key").sortWithinPartitions("key", "text", "at").mapInArrow(
            _matches, "a long, b long, number int, first int, last int, shift int, key long, at int, around long"
        ),
        "matches",
    )
    pairs = matches.where("number IS NOT NULL").select("a", "b", "number", "first", "last", "shift")
    pairs = pairs.repartition("a", "b").sortWithinPartitions("a", "b")
    regions = stored(pairs.mapInArrow(_regions, _REGION_SQL).distinct(), "regions")
    found = stored(_checked(docs, regions), "found")
    # Where a window's passage was not verified with the one that its key or its task
    # paired it with, all windows of the key meet, also those that have a link.
    windows = matches.where("key IS NOT NULL").select("key", "a", "b", "at", "around", (F.col("at") + F.col("shift")).alias("b_at"), F.col("number").isNull().alias("sent"))
    held = found.select("a", "b", "a_start", "a_end").union(found.select("b", "b", "b_start", "b_end"))
    held = held.groupBy("a", "b").agg(F.collect_set(F.struct(F.col("a_start").alias("start"), F.col("a_end").alias("end"))).alias("spans"))
    inside = F.exists("spans", lambda s: (F.col("at") >= s["start"]) & (F.col("at") + SHINGLE <= s["end"]))
    first = F.col("sent") & (F.col("a") == F.col("b")) & (F.col("at") == F.col("b_at"))
    rows = windows.join(held, ["a", "b"], "left").withColumns({"first": first, "linked": F.coalesce(inside, F.lit(False))})
    mate = F.when(F.col("linked") & ~F.col("first") & (F.col("a") != F.col("b")), F.expr(_NAME.format(text="b", at="b_at"))).otherwise(0)
    rows = stored(rows.select("key", F.col("a").alias("text"), "at", "around", mate.alias("mate"), "first", "linked"), "windows")
    torn = rows.groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("most"), F.bool_or(~F.col("linked") & ~F.col("first")).alias("torn"))
    # Stored, so that a key of very many windows can be split in the join.
    torn = stored(torn.where("torn AND least < most").select("key"), "torn")
    left = stored(rows.join(torn, "key", "left_semi").drop("linked"), "left")
    return found.union(_apart(docs, left))


_REGION_SQL = "a long, b long, a_first int, a_last int, b_first int, b_last int"


def _texts_near(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose hashes are in the one column of ``wanted``."""
    wanted = stored(wanted.toDF("wanted").distinct(), "wanted-texts")
    # The classes of the wanted hashes (SLOTS rows at most) spare most other texts the way to the join.
    slots = wanted.select(F.pmod("wanted", F.lit(SLOTS)).alias("slot")).distinct()
    near = docs.select("text").join(F.broadcast(slots), F.pmod(F.xxhash64("text"), F.lit(SLOTS)) == F.col("slot"), "left_semi")
    return near.join(wanted, F.xxhash64("text") == F.col("wanted"), "left_semi")


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text, words`` of the texts (hashes) in the one column of ``wanted``."""
    texts = _texts_near(docs, wanted).groupBy(F.xxhash64("text").alias("hash")).agg(F.any_value("text").alias("text"))
    return stored(texts.select(F.col("hash").alias("text"), _words().alias("words")), "texts")


def _checked(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """The verified near-repeats of ``regions``, or of the smaller ones in their
    column ``regions``."""
    texts = _words_of(docs, regions.select("a").union(regions.select("b")))

    def with_words(rows: DataFrame, side: str) -> DataFrame:
        named = texts.select(F.col("text").alias(side), F.col("words").alias("_words"))
        start = F.greatest(F.col(f"{side}_first") - ROOM, F.lit(0))
        cut = F.slice("_words", start + 1, F.col(f"{side}_last") - start + SHINGLE + ROOM)
        return rows.join(named, side).withColumns({f"{side}_words": cut, f"{side}_first": start}).drop("_words", f"{side}_last")

    parts = [c for c in regions.columns if c == "regions"]
    both = with_words(with_words(regions, "a"), "b").select("a", "b", "a_first", "b_first", "a_words", "b_words", *parts)
    return both.mapInArrow(_verify, "a long, b long, a_start int, a_end int, b_start int, b_end int")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, component_id`` (the smallest document id that shared
    passages reach), ``n_links`` (other texts it was linked to) and ``spans``
    (word ranges of its repeated passages)."""
    found = stored(passages(docs.select(F.col(text).alias("text"))), "passages")
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), ""))
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text"), size.alias("n_words")), "rows")
    sides = found.select(F.col("a").alias("text"), F.col("b").alias("other"), F.col("a_start").alias("start"), F.col("a_end").alias("end"))
    sides = sides.union(found.select("b", "a", "b_start", "b_end"))
    spans = sides.select("text", "start", "end").distinct().groupBy("text").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    links = sides.select("text", "other").distinct().groupBy("text").agg(F.count("*").alias("n_links"))
    roots = stored(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots").withColumnRenamed("node", "text")
    long_rows = rows.where(F.col("n_words") >= WORDS)
    texts = stored(long_rows.groupBy("text").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")), "long-texts")
    linked = stored(texts.join(roots, "text"), "linked")
    named = linked.join(stored(linked.groupBy("root").agg(F.min("first_doc").alias("least")), "least"), "root").select("text", "least")
    known = stored(
        texts.join(named, "text", "left").join(spans, "text", "left").join(links, "text", "left").where("copies > 1 OR least IS NOT NULL").select(
            F.col("text").alias("_text"), F.coalesce("least", "first_doc").alias("component_id"), "copies", "spans", "n_links"
        ),
        "known",
    )
    joined = rows.join(known, (F.col("text") == F.col("_text")) & (F.col("n_words") >= WORDS), "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce("n_links", F.lit(0)) + F.when(F.col("copies") > 1, 1).otherwise(0)).cast("long").alias("n_links"),
        F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
    )


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.withColumn("spans", joined)
