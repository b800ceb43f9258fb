"""Held-out passages inside a corpus: which texts hold which items, whole or in part.

Texts are reduced to letters and digits in one form. Windows of the size of the shortest run that counts are embedded
by a random walk (CGK: a window's characters are copied to the output, and a random bit per output place and character
decides whether the walk moves on), so that few edits between two windows become few differing places. Keys of sampled
places then meet by equality; further samples of a walk and further walks make up for those an edit hits. Windows start at every place of an item
and at every ``stride``-th of a text, so a run of ``min_run`` always holds a window that starts alike on both sides:
runs without edits are found with certainty. What met is verified: edit distance of the windows and length of the
longest unbroken run around them.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.session import cut

#: Letters of other scripts that look like Latin ones in lower or upper case, to these; both sides are folded alike.
ALIKE = dict(zip("асеорухіјѕһԛԝвнкмтονρυαβεζηικμτχօ", "aceopyxijshqwbhkmtovpuabezhikmtxo", strict=True))

#: Places of the filter for each key, and bytes of it that are joined at once.
PLACES, BLOCK = 6, 1 << 16

#: The part of a key that is shuffled: where two are alike by chance, the windows are compared and told apart.
SHORT = (1 << 40) - 1


class Walk(NamedTuple):
    """Parameters of embedding and sampling."""

    window: int = 40
    stride: int = 21
    steps: int = 100
    sample: int = 24
    repeats: int = 2
    seed: int = 1
    context: int = 60


@functools.cache
def _table() -> np.ndarray:
    """For every code point the letter or digit it counts as, 0 for what is set aside."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x32000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat[0] in "LN":
            base, *marks = unicodedata.normalize("NFD", ch)
            alike = unicodedata.normalize("NFC", "".join([ALIKE.get(base, base), *marks]))
            out[cp] = ord(alike) if len(alike) == 1 else cp
    return out


def reduced(text: str) -> np.ndarray:
    """Code points of the letters and digits of ``text`` in one form; an accented letter is one."""
    t = text if text.isascii() else unicodedata.normalize("NFKC", "".join(c for c in text if unicodedata.category(c) != "Cf") if any(c in text for c in _INVISIBLE) else text)
    codes = np.frombuffer(t.casefold().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kept = _table()[codes]
    return kept[kept > 0]


_INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


@functools.lru_cache(32)
def _walk(walk: Walk, number: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """A walk that holds as many repeats as it has room for: whether a step moves on for a character, the places each
    repeat samples, no place twice, and the weights of places."""
    rng = np.random.default_rng([walk.seed, number])
    move = rng.integers(0, 2, size=(walk.steps, 2048), dtype=np.uint8).astype(np.intp)
    places = rng.permutation(walk.steps)
    samples = [places[k : k + walk.sample] for k in range(0, walk.steps - walk.sample + 1, walk.sample)]
    return move, samples, rng.integers(1, 2**63, size=walk.steps, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def embedded(codes: np.ndarray, starts: np.ndarray, walk: Walk, move: np.ndarray) -> Iterator[np.ndarray]:
    """What each step of a walk puts out for the windows of ``codes`` that begin at ``starts``: characters as 11 bits.

    The array is the same for each step.
    """
    bucket = (codes * np.uint32(2654435761) >> np.uint32(21)).astype(np.intp)
    at = starts.astype(np.intp)
    stop = at + walk.window - 1
    c, on = np.empty_like(at), np.empty_like(at)
    for j in range(walk.steps):
        np.take(bucket, at, out=c, mode="clip")  # no place is outside, so nothing is clipped
        yield c
        np.take(move[j], c, out=on, mode="clip")
        at += on
        np.minimum(at, stop, out=at)


def keys(codes: np.ndarray, starts: np.ndarray, walk: Walk) -> np.ndarray:
    """A key per repeat (rows) and window (columns): a hash of the repeat and its sampled places of the embedding."""
    out = np.empty((walk.repeats, len(starts)), dtype=np.uint64)
    out[:] = np.arange(1, walk.repeats + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    room = walk.steps // walk.sample
    h = np.empty(len(starts), dtype=np.uint64)
    for first in range(0, walk.repeats, room):
        move, samples, weights = _walk(walk, first // room)
        takes = {int(j): out[first + k] for k, places in enumerate(samples[: walk.repeats - first]) for j in places}
        for j, c in enumerate(embedded(codes, starts, walk, move)):
            if j in takes:
                takes[j] += np.multiply(c.view(np.uint64), weights[j], out=h)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


@functools.lru_cache(16)
def for_recall(walk: Walk, edits: int, recall: float, trials: int = 1000, most: int = 2000) -> Walk:
    """``walk`` with as many repeats as windows at an edit distance of ``edits`` need to meet with this probability.

    Measured with the walks and samples themselves on random windows, of which a third has letters changed, a third
    letters changed, lost or added, and a third letters changed at even distances, which leaves least alike; each third
    must reach the recall. ValueError if more than ``most`` repeats were needed: no walk with less than the recall asked for is given.
    """
    rng = np.random.default_rng(walk.seed)
    a = rng.integers(97, 123, (3, trials, walk.window)).astype(np.uint32)
    b = a.copy()
    for k in range(trials):
        b[0, k] = edited(a[0, k], edits, rng, moved=False)
        b[1, k] = edited(a[1, k], edits, rng)
        b[2, k, (rng.integers(0, walk.window) + np.arange(edits) * walk.window // max(1, edits)) % walk.window] = 48
    starts = np.arange(3 * trials) * walk.window
    met, n = np.zeros(3 * trials, dtype=bool), 0
    while n < most:
        move, samples, _ = _walk(walk, n // (walk.steps // walk.sample))
        differ = np.array([x != y for x, y in zip(embedded(a.ravel(), starts, walk, move), embedded(b.ravel(), starts, walk, move), strict=True)])
        for places in samples[: most - n]:
            met, n = met | ~differ[places].any(axis=0), n + 1
            if met.reshape(3, trials).mean(axis=1).min() >= recall:
                return walk._replace(repeats=n)
    raise ValueError(f"recall {recall} at {edits} edits needs more than {most} repeats; take a smaller sample")


def edited(row: np.ndarray, edits: int, rng: np.random.Generator, moved: bool = True) -> np.ndarray:
    """A window at an edit distance of up to ``edits``: letters changed and, if ``moved``, lost or added, as chance has it.

    A letter lost or added counts twice, as the window's end moves with it.
    """
    out, left = row.tolist(), edits
    while left:
        kind = int(rng.integers(0, 3)) if moved and left > 1 else 0
        at, letter = int(rng.integers(0, len(out))), int(rng.integers(97, 123))
        if kind == 0:
            out[at] = letter if letter != out[at] else 48
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, letter)
        left -= 1 if kind == 0 else 2
    out += rng.integers(97, 123, max(0, len(row) - len(out))).tolist()
    return np.array(out[: len(row)], dtype=np.uint32)


def _field_bits(keys: int, each: int = 20) -> int:
    """The size of the Bloom filter: 20 bits a key, from 128 KB up to 128 MB. Beyond, more windows pass, none is lost."""
    return min(30, max(20, (each * max(1, keys) - 1).bit_length()))


def _slot(key: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The ``n``-th of the places of the filter that stand for a key."""
    k = key.view(np.uint64)
    return ((k + np.uint64(n) * (k * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


def _wanted(key: np.ndarray, field: np.ndarray, bits: int) -> np.ndarray:
    """Where the keys stand that may be in the filter; a place is looked up only for keys that the last one has let pass."""
    left = np.arange(len(key))
    for n in range(PLACES):
        s = _slot(key[left], bits, n)
        left = left[(field[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)]
    return left


def _texts(batches: Iterator[pa.RecordBatch], window: int, chunk: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Reduced texts with room for a window, in lots of about ``chunk`` letters."""
    ids: list[int] = []
    parts: list[np.ndarray] = []
    held = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if t is None or len(codes := reduced(t)) < window:
                continue
            ids.append(i)
            parts.append(codes)
            held += len(codes)
            if held >= chunk:
                yield ids, parts
                ids, parts, held = [], [], 0
    if parts:
        yield ids, parts


def _starts(parts: list[np.ndarray], window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.concatenate(parts)
    lengths = np.array([len(p) for p in parts])
    begins = np.cumsum(lengths) - lengths
    n = (lengths - window) // stride + 1
    owner = np.repeat(np.arange(len(parts)), n)
    local = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride
    return codes, owner, local, begins[owner] + local


def _around(codes: np.ndarray, at: int, walk: Walk) -> tuple[str, int]:
    """What is seen of a text around a window, and where the window begins in it."""
    a = max(0, at - walk.context)
    return codes[a : at + walk.window + walk.context].astype("<u4").tobytes().decode("utf-32-le"), at - a


def _sign(around: str, off: int) -> bytes:
    return hashlib.blake2b(around.encode("utf-8", "surrogatepass"), digest_size=16, salt=off.to_bytes(8, "little")).digest()


def _lot(walk: Walk) -> int:
    """Letters with about 6,000 windows: their keys, of all repeats, stay in the processor's cache."""
    return min(500_000, 6_000 * walk.stride)


def _keys_of_texts(walk: Walk):
    """Texts (id, text) to the keys of all their windows at every ``stride``-th place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, parts in _texts(batches, walk.window, _lot(walk)):
            codes, _, _, starts = _starts(parts, walk.window, walk.stride)
            yield from keys(codes, starts, walk)

    return scan


def _keys_of_windows(walk: Walk):
    """Windows, a column of strings, to their keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield from keys(_letters(b.column(0)), np.arange(b.num_rows) * walk.window, walk)

    return scan


def _letters(windows: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(windows.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")


def _likely_windows(walk: Walk, field, bits: int):
    """Texts (id, text) to those windows at every ``stride``-th place of which a key may occur, with what is around them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = field.value
        for ids, parts in _texts(batches, walk.window, _lot(walk)):
            codes, owner, local, starts = _starts(parts, walk.window, walk.stride)
            hit = np.zeros(len(starts), dtype=bool)
            for k in keys(codes, starts, walk):
                hit[_wanted(k, wanted, bits)] = True
            rows = []
            for i in np.flatnonzero(hit).tolist():
                o, at = int(owner[i]), int(local[i])
                text, off = _around(parts[o], at, walk)
                rows.append((ids[o], at, _sign(text, off), text, off))
            if rows:
                c = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["id", "at", "sign", "around", "off"])

    return scan


def _likely_keys(walk: Walk, field, bits: int):
    """Windows (text, number) to those of their keys that may occur on the other side, in short."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column(1).to_numpy()
            for k in keys(_letters(b.column(0)), np.arange(b.num_rows) * walk.window, walk):
                at = _wanted(k, field.value, bits)
                yield pa.RecordBatch.from_arrays([pa.array(number[at]), pa.array(k[at] & SHORT)], names=["number", "key"])

    return scan


def _field(rows: DataFrame, scan, size: int) -> np.ndarray:
    """The filter over all keys; every task makes the blocks of 64 KB it has bits for, equal blocks are joined by bitwise or."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.zeros(1 << (size - 3), dtype=np.uint8)
        for k in scan(batches):
            for n in range(PLACES):
                s = _slot(k, size, n)
                np.bitwise_or.at(some, s >> 3, (1 << (s & 7)).astype(np.uint8))
        blocks = some.reshape(-1, BLOCK)
        for i in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], names=["block", "bits"])

    def joined(blocks: pa.Table) -> pa.Table:
        return pa.table({"block": blocks["block"][:1], "bits": pa.array([functools.reduce(np.bitwise_or, (np.frombuffer(b.as_buffer(), np.uint8) for b in blocks["bits"])).tobytes()], pa.binary())})

    out = np.zeros(1 << (size - 3), dtype=np.uint8).reshape(-1, BLOCK)
    for b in rows.mapInArrow(bits, "block int, bits binary").groupBy("block").applyInArrow(joined, "block int, bits binary").toArrow().to_batches():  # never more than the filter has
        for i, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            out[i] = np.frombuffer(block.as_buffer(), np.uint8)
    return out.ravel()


def _near(walk: Walk, most_edits: int):
    """Numbers of windows whose texts have at most so many edits. Two windows may have one number by chance: see ``_verify``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_letters(b.column(c)).reshape(-1, walk.window) for c in ("window", "i_window"))
            good = pa.array(np.flatnonzero(_distances(x, y, most_edits) <= most_edits))
            yield pa.RecordBatch.from_arrays([b.column(c).take(good) for c in ("number", "i_number")], names=["number", "i_number"])

    return run


def _verify(walk: Walk, most_edits: int):
    """Windows and what is around them to their edits and longest run, where the windows themselves are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, i, c, j = (b.column(n).to_pylist() for n in ("around", "off", "i_around", "i_off"))
            x, y = (_letters(pa.array([t[o : o + walk.window] for t, o in zip(*side, strict=True)], pa.string())).reshape(-1, walk.window) for side in ((a, i), (c, j)))
            edits = _distances(x, y, most_edits)
            good = np.flatnonzero(edits <= most_edits)
            runs = [_run(a[k], i[k], c[k], j[k]) for k in good.tolist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(good)) for n in ("sign", "i_sign")), pa.array(edits[good].astype(np.int32)), pa.array(runs, pa.int32())], names=["sign", "i_sign", "edits", "run"])

    return run


def _run(a: str, i: int, b: str, j: int) -> int:
    """The longest run that both have in the same alignment, of what is seen around the windows."""
    left = min(i, j)
    x, y = a[i - left :], b[j - left :]
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    differ = np.flatnonzero(np.frombuffer(x[:n].encode("utf-32-le", "surrogatepass"), "<u4") != np.frombuffer(y[:n].encode("utf-32-le", "surrogatepass"), "<u4"))
    return int(np.diff(differ, prepend=-1, append=n).max()) - 1


def _distances(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of windows row by row, or ``most + 1`` where it is larger; ``_distance`` for all pairs at once."""
    n, size = x.shape
    big = np.int16(most + 1)
    row = np.full((2 * most + 1, n), big)  # by diagonal: row[most + j - i] is the distance of the first i letters and j
    row[most:] = np.arange(most + 1, dtype=np.int16)[:, None]
    for i in range(1, size + 1):
        new = np.full_like(row, big)
        for d in range(2 * most + 1):
            j = i + d - most
            if j == 0:
                new[d] = min(i, big)
            elif 0 < j <= size:
                new[d] = row[d] + (x[:, i - 1] != y[:, j - 1])
                if d < 2 * most:
                    np.minimum(new[d], row[d + 1] + 1, out=new[d])
                if d:
                    np.minimum(new[d], new[d - 1] + 1, out=new[d])
        row = np.minimum(new, big)
    return row[most]


def _distance(x: str, y: str, most: int) -> int:
    """Edit distance, or ``most + 1`` if it is larger; only the band that matters is computed."""
    big = most + 1
    row = [min(j, big) for j in range(len(y) + 1)]
    for i in range(1, len(x) + 1):
        new = [min(i, big)] + [big] * len(y)
        for j in range(max(1, i - most), min(len(y), i + most) + 1):
            new[j] = min(row[j - 1] + (x[i - 1] != y[j - 1]), row[j] + 1, new[j - 1] + 1, big)
        row = new
        if min(row) >= big:
            return big
    return row[-1]


class _Met(NamedTuple):
    """Texts' windows (doc, at, sign), items' (i_sign, item), and what was verified (sign, i_sign, edits, run)."""

    places: DataFrame
    held: DataFrame
    good: DataFrame


def _met(docs: DataFrame, items: DataFrame, doc: str, doc_text: str, item: str, item_text: str, walk: Walk, most_edits: int) -> _Met:
    send = docs.sparkSession.sparkContext.broadcast
    every = walk._replace(stride=1)
    kinds = "id long, at int, sign binary, around string, off int"
    rows = items.select(F.col(item).cast("long"), F.col(item_text)).distinct()
    most = rows.agg(F.sum(F.greatest(F.length(item_text) - walk.window + 1, F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    bits = _field_bits(most * walk.repeats)
    field = send(_field(rows, _keys_of_texts(every), bits))
    found = cut(docs.select(F.col(doc).cast("long"), F.col(doc_text)).mapInArrow(_likely_windows(walk, field, bits), kinds))
    # What is the same on one side is compared once, however many texts or items it stands in.
    window = F.substring("around", F.col("off") + 1, F.lit(walk.window))
    theirs = cut(found.select(window.alias("window")).distinct().select("window", F.hash("window").alias("number")))
    # Of the items' windows only those go on of which a key may be one of the texts' windows that are left.
    n = theirs.count()
    i_bits = _field_bits(n * walk.repeats, 16)
    i_field = send(_field(theirs.select("window").coalesce(n // 500_000 + 1), _keys_of_windows(walk), i_bits))
    own = rows.mapInArrow(_likely_windows(every, i_field, i_bits), kinds)  # items are fewer than texts: read again rather than kept
    ours = own.select(window.alias("i_window")).distinct().select("i_window", F.hash("i_window").alias("i_number"))
    by_key = theirs.mapInArrow(_likely_keys(walk, field, bits), "number int, key long")
    i_by_key = ours.mapInArrow(_likely_keys(walk, i_field, i_bits), "i_number int, i_key long")
    # The hints: keys, and what is around windows, are never sent to all tasks, as they take much of the driver's memory.
    pairs = by_key.join(i_by_key.hint("merge"), F.col("key") == F.col("i_key")).select("number", "i_number").distinct()
    pairs = pairs.join(theirs, "number").join(ours, "i_number").select("number", "i_number", "window", "i_window")
    near = pairs.mapInArrow(_near(walk, most_edits), "number int, i_number int").distinct()
    seen = _surroundings(found.select(F.hash(window).alias("number"), "sign", "around", "off"), "number", "sign")
    i_seen = _surroundings(own.select(F.hash(window).alias("i_number"), F.col("sign").alias("i_sign"), F.col("around").alias("i_around"), F.col("off").alias("i_off")), "i_number", "i_sign")
    both = near.join(seen.hint("merge"), "number").join(i_seen.hint("merge"), "i_number").select("sign", "i_sign", "around", "off", "i_around", "i_off")
    good = both.mapInArrow(_verify(walk, most_edits), "sign binary, i_sign binary, edits int, run int")
    return _Met(found.select("sign", F.col("id").alias("doc"), "at").distinct(), own.select(F.col("sign").alias("i_sign"), F.col("id").alias("item")).distinct(), good)


def _surroundings(rows: DataFrame, number: str, sign: str) -> DataFrame:
    """Once each what is around windows, moved by the window's number alone."""
    return rows.repartition(number).groupBy(number, sign).agg(*(F.first(c).alias(c) for c in rows.columns[2:]))


def leaks(docs: DataFrame, items: DataFrame, doc: str, doc_text: str, item: str, item_text: str, walk: Walk | None = None, most_edits: int = 4, recall: float = 0.9, min_run: int = 0) -> DataFrame:
    """``doc, item, at, edits, run`` of every pair of windows that met and has at most ``most_edits`` edits.

    Without a ``walk`` its repeats are those that windows at an edit distance of ``most_edits`` need to meet with the
    probability ``recall``, as ``for_recall`` measures it; a walk that is given has the recall of its own repeats.
    ``run`` is the longest unbroken run of letters and digits that both have around the window, as far as ``context``
    letters on either side are seen. A null, blank or too short text has no windows; items that share text are all
    reported; repeated rows repeat nothing that ``distinct`` would not undo; empty tables give no rows; other columns
    are ignored. Marks are no letters. Pairs with a run below ``min_run`` are left out.

    Keys of item windows go to the scan as a bit field of at most 128 MB; only windows of which a key may occur are shuffled,
    and keys of such windows go back as another, so that only items' windows that may have met are. Keys are made anew from windows, never stored.
    Windows that are the same, with all that is seen around them, meet and are verified once, so that boilerplate or a
    run of one letter costs no pair of each place with each; texts and items are put back to what was verified.
    """
    walk = for_recall(Walk(steps=72, sample=12), most_edits, recall) if walk is None else walk
    places, held, good = _met(docs, items, doc, doc_text, item, item_text, walk, most_edits)
    return good.where(F.col("run") >= min_run).join(held, "i_sign").select("sign", "item", "edits", "run").distinct().join(places, "sign").select("doc", "item", "at", "edits", "run")


def passages(docs: DataFrame, items: DataFrame, doc: str, doc_text: str, item: str, item_text: str, min_run: int = 60, most_edits: int | None = None, recall: float = 0.9) -> DataFrame:
    """``doc, item, edits, run``: texts that hold a passage of an item, unbroken or edited, once each.

    Windows are of [40] letters, or of ``min_run`` if that is less. ``edits`` is the least edit distance of two windows,
    ``run`` the longest unbroken run seen around one. Pairs with a run of at least ``min_run`` are there with certainty;
    other pairs are those with windows of at most ``most_edits`` edits, by default one to ten letters, and each such
    window on the stride is met with the probability ``recall``.
    """
    if min_run < 1:
        raise ValueError("a run has at least one letter")
    window = min(Walk().window, min_run)
    most_edits = window // 10 if most_edits is None else most_edits
    steps = max(1, window * 9 // 5)  # a walk is then about as long as its window, and rarely stays at the end
    walk = for_recall(Walk(window=window, stride=min_run - window + 1, steps=steps, sample=min(12, steps), context=min_run), most_edits, recall)
    places, held, good = _met(docs, items, doc, doc_text, item, item_text, walk, most_edits)
    best = F.min("edits").alias("edits"), F.max("run").alias("run")
    by_sign = good.join(held, "i_sign").groupBy("sign", "item").agg(*best)
    return by_sign.join(places.select("sign", "doc").distinct(), "sign").groupBy("doc", "item").agg(*best).select(F.col("doc").alias(doc), F.col("item").alias(item), "edits", "run")


def leaked_items(docs: DataFrame, items: DataFrame, doc: str, doc_text: str, item: str, item_text: str, min_run: int = 60) -> DataFrame:
    """``doc, item``: texts that hold an unbroken run of at least ``min_run`` letters and digits of an item, once each."""
    return passages(docs, items, doc, doc_text, item, item_text, min_run).where(F.col("run") >= min_run).select(doc, item)
