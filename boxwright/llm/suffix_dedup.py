"""Removal of repeated 50-byte strings, by suffix arrays over candidate places.

Every string of LENGTH bytes has an anchor: the K bytes in it with the least
hash, which the string alone decides, so equal strings have equal anchors.
1. Chunks of documents tell the shards the hashes of their anchors; a shard
   says which of them occur in two documents or more. Only those go on.
2. For each, a chunk sends the bytes around it (all strings of LENGTH that can
   have this anchor) once, with the least doc_id that has them. A shard puts
   the different surroundings of an anchor into one text, the anchor itself
   being one symbol, and builds its suffix array by linear grouping
   (suffix_array.py). Suffixes with the same string of LENGTH stand together
   in it, compared symbol by symbol, and share the least doc_id among them.
3. The chunk marks each string that starts in a document with a smaller id,
   and with it its bytes.
An anchor whose surroundings are all the same needs no suffix array: its
strings are all equal. Copies of surroundings are one row a chunk.
An anchor may have very many different surroundings (at the border of a passage that
very many documents share). If the chunks together count more than HOT of them, its
strings go to the shards in pairs of neighbours: the 49 bytes of both are the anchor there, with one byte
on each side. They spread over all shards by those 49 bytes, and a group of them
has at most 257 x 257 rows, as many as there are two bytes or borders. So no
group, and no text of a suffix array, grows with the input.

Null and empty texts have no bytes. Rows with a null id count as after all
others, and rows with equal ids don't remove each other's bytes. Extra columns
are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm import chunks
from boxwright.llm.memory import small_batches
from boxwright.llm.suffix_array import suffix_array
from boxwright.session import cut, scratch_path, shuffles_dropped

LENGTH, K = 50, 25
SIDE = LENGTH - K  # bytes of a string besides its anchor
NEAR = 1  # the same for the strings of an anchor with very many places
#: Different surroundings of an anchor, summed over the chunks, up to which they stay together.
HOT = 5_000
#: Places of an anchor in a chunk up to which each counts as a surrounding of its own.
FEW = 8
CHUNK_BYTES = 16_000_000
SEGMENT = 1 << 20
NULL_ID = 1 << 62
_B = 0x9E3779B97F4A7C15
#: Symbols in one suffix array; groups of surroundings are put together up to so many.
TEXT_SYMBOLS = 100_000


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(SEGMENT + 2 * LENGTH, _B), _powers(SEGMENT + 2 * LENGTH, pow(_B, -1, 1 << 64))


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """Least or greatest of each n neighbours, by doubling."""
    width = 1
    while width * 2 <= n:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def _anchors_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a segment; strings don't cross ``ends`` of documents."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _DOWN[:n])])
    h = (sums[K:] - sums[:-K]) * _UP[: n - K + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)
    least = _slide(h, SIDE + 1, np.minimum)
    inside = np.ones(n, bool)
    for e in ends[ends < n].tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    least[~inside[: len(least)]] = 0
    pad = np.zeros(SIDE, np.uint64)
    best = _slide(np.concatenate([pad, least, pad]), SIDE + 1, np.maximum)
    at = np.flatnonzero(best == h)
    return at, h[at]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of joined documents, segment by segment."""
    places, hashes = [], []
    for begin in range(0, len(data), SEGMENT):
        stop = min(len(data), begin + SEGMENT + LENGTH - 1)
        own = ends[(ends > begin) & (ends <= stop)] - begin
        at, h = _anchors_of(data[begin:stop], own)
        places.append(at + begin)
        hashes.append(h)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _doc_of(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, at, "right")


def _by_shard(h: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """Order of distinct sorted hashes by shard, and where each shard ends."""
    shard = (h % np.uint64(n)).astype(np.uint32)
    return np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=n)).tolist()


def _shared_in_chunk(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, whether two documents of the chunk have each, and at how many places."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    other = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] != doc[:-1])]) if len(h) else first
    starts = np.flatnonzero(first)
    shared = (np.add.reduceat(other.astype(np.int64), starts) > 0) if len(starts) else np.zeros(0, bool)
    return h[starts], shared, np.diff(np.append(starts, len(h)))


def _different(data: np.ndarray, ends: np.ndarray, at: np.ndarray, h: np.ndarray, distinct: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many different surroundings each distinct hash has in the chunk; where its places are FEW, they count."""
    of = np.searchsorted(distinct, h)
    some = np.flatnonzero(places[of] > FEW)
    begins, prints = np.concatenate([[0], ends[:-1]]), np.zeros(len(some), np.uint64)
    for i in range(0, len(some), 1 << 18):
        own = at[some[i : i + (1 << 18)]]
        doc = _doc_of(ends, own)
        wide = _around(data, begins[doc], ends[doc], own, SIDE)
        for j in range(0, len(wide), 1 << 14):
            prints[i + j : i + j + (1 << 14)] = wide[j : j + (1 << 14)].astype(np.uint64) @ _UP[: wide.shape[1]]
    order = np.lexsort((prints, of[some]))
    key, prints = of[some][order], prints[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (prints[1:] != prints[:-1])
    return np.where(places > FEW, np.bincount(key[new], minlength=len(places)), places)


def _chunk_rows(n_shards: int, chunk_bytes: int, hot: int):
    """Documents -> chunks: their bytes, and the hashes of their anchors for the shards."""
    import uuid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            chunk, lens = uuid.uuid4().hex, np.array([len(t) for t in texts], np.int64)
            joined = b"".join(texts)
            yield chunks.rows(chunk, chunks.DOC, [0], [ids], [chunks.blob((lens, 5), raw=joined, level=9)])
            ends = np.cumsum(lens)
            data = np.frombuffer(joined, np.uint8)
            at, placed = anchors(data, ends)
            h, shared, places = _shared_in_chunk(placed, _doc_of(ends, at))
            different = _different(data, ends, at, placed, h, places)
            seen = (2 * np.minimum(different, hot + 1) + shared).astype(np.uint64)
            order, stops = _by_shard(h, n_shards)
            for k, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
                some = order[a:b]
                yield chunks.rows(chunk, chunks.ASK, [k], [None], [chunks.blob((np.diff(h[some] >> np.uint64(32), prepend=np.uint64(0)), 4), (seen[some], 4))])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text.encode() if text else b"")
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield from flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield from flush()

    return run


def _shared(hot: int):
    """A shard: for each chunk, which of its hashes occur in two documents or more, and which have over ``hot`` surroundings."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, seen = [], []
        for payload in rows["payload"]:
            (steps, marks), _ = chunks.unblob(payload, 4, 4)
            keys.append(np.cumsum(steps).astype(np.uint32))
            seen.append(marks.astype(np.int64))
        marks = np.concatenate(seen)
        of, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        some = count > 1
        some[at[marks % 2 == 1]] = True
        many = some & (np.bincount(at, weights=marks // 2, minlength=len(of)) > hot)
        out, begin = [], 0
        for k in keys:
            own = at[begin : begin + len(k)]
            out.append(zstandard.ZstdCompressor().compress(np.packbits(np.concatenate([some[own], many[own]])).tobytes()))
            begin += len(k)
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "payload": out})

    return run


def _documents(rows: pd.DataFrame) -> tuple[list, np.ndarray, bytes]:
    """Ids (null as NULL_ID), ends and joined bytes of a chunk."""
    (lens,), joined = chunks.unblob(rows["payload"].iloc[0], 5)
    ids = [None if x is None or x != x else int(x) for x in rows["doc_ids"].iloc[0]]
    return ids, np.cumsum(lens.astype(np.int64)), joined


def _width(side: int) -> int:
    """Bytes of a row for the shards: those before, of, and after its anchor, and how many of the first and last there are."""
    return LENGTH + side + 2


def _around(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """Rows of the bytes around anchors at some places of documents (their borders), with ``side`` bytes on either hand."""
    k = LENGTH - side
    left, right = np.minimum(at - begins, side), np.minimum(ends - at - k, side)
    padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(side, np.uint8)])
    wide = np.empty((len(at), _width(side)), np.uint8)
    for i in range(0, len(at), 1 << 15):
        wide[i : i + (1 << 15), :-2] = padded[at[i : i + (1 << 15), None] + np.arange(LENGTH + side)]
    column = np.arange(LENGTH + side)
    wide[:, :-2][(column < side - left[:, None]) | (column >= side + k + right[:, None])] = 0
    wide[:, -2], wide[:, -1] = left, right
    return wide


def _in_pairs(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchors with very many surroundings: where the 49 bytes of each two neighbouring strings begin, and their hashes."""
    places = np.unique(at[:, None] - SIDE + NEAR + (NEAR + 1) * np.arange((SIDE + 1) // (NEAR + 1)))
    places = places[(places >= 0) & (places + LENGTH - NEAR <= len(data))]
    doc = _doc_of(ends, places)
    begin = np.concatenate([[0], ends[:-1]])[doc] if len(ends) else places
    # Bytes of one document, and room for one string at least.
    places = places[(places + LENGTH - NEAR <= ends[doc]) & ((places > begin) | (places + LENGTH <= ends[doc]))]
    h = np.zeros(len(places), np.uint64)
    for j in range(LENGTH - NEAR):
        h = (h ^ data[places + j].astype(np.uint64)) * np.uint64(_B)
        h ^= h >> np.uint64(29)
    return places, h


def _for_shards(wide: np.ndarray, h: np.ndarray, number: np.ndarray, side: int, n_shards: int) -> tuple[np.ndarray, list[tuple[np.ndarray, bytes]]]:
    """The number of each row among the distinct ones, in order of shard and bytes; and each shard's rows with their least ids."""
    keyed = np.concatenate([(h % np.uint64(n_shards)).astype(">u4").view(np.uint8).reshape(-1, 4), wide[:, side:LENGTH], wide], axis=1)
    _, first, which = np.unique(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(first), NULL_ID, np.int64)
    np.minimum.at(least, which, number)
    stops = np.cumsum(np.bincount((h[first] % np.uint64(n_shards)).astype(np.int64), minlength=n_shards)).tolist()
    return which, [(least[a:b].view(np.uint64), np.ascontiguousarray(wide[first[a:b]]).tobytes()) for a, b in zip([0, *stops], stops, strict=False)]


def _surroundings(n_shards: int):
    """A chunk and the shards' answers -> its shared anchors' places, and their surroundings for the shards."""

    def run(doc_rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, ends, joined = _documents(doc_rows)
        data = np.frombuffer(joined, np.uint8)
        numbers, begins = np.array([NULL_ID if i is None else i for i in ids], np.int64), np.concatenate([[0], ends[:-1]])
        at, h = anchors(data, ends)
        distinct = np.unique(h)
        order, stops = _by_shard(distinct, n_shards)
        hit, many = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        found = dict(zip(answers["part"], answers["payload"], strict=True))
        for k, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
            bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(found[k]), np.uint8), count=2 * (b - a)).astype(bool)
            hit[order[a:b]], many[order[a:b]] = bits[: b - a], bits[b - a :]
        place = np.searchsorted(distinct, h)
        several, alone = many[place], hit[place] & ~many[place]
        own, sent = [], []
        for (at, h), side in (((at[alone], h[alone]), SIDE), (_in_pairs(data, ends, at[several]), NEAR)):  # noqa: B020
            doc = _doc_of(ends, at)
            which, shards = _for_shards(_around(data, begins[doc], ends[doc], at, side), h, numbers[doc], side, n_shards)
            own += [(np.diff(at, prepend=0).astype(np.uint64), 5), (which.astype(np.uint64), 4)]
            sent.append(shards)
        out = [(-1, chunks.blob(*own))]
        out += [(k, chunks.blob((a, 8), (b, 8), raw=x + y, level=9)) for k, ((a, x), (b, y)) in enumerate(zip(*sent, strict=True))]
        return pd.DataFrame({"chunk": doc_rows["chunk"].iloc[0], "kind": [chunks.OWN if p < 0 else chunks.ASK for p, _ in out], "part": [p for p, _ in out], "payload": [x for _, x in out]})

    return run


def _agreement(rows: np.ndarray) -> np.ndarray:
    """For rows of bytes, the most leading bytes that each shares with another one: with a neighbour in order."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
    placed = rows[order]
    same = np.concatenate([[0], np.cumprod(placed[1:] == placed[:-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64), [0]])
    out = np.empty(len(rows), np.int64)
    out[order] = np.maximum(same[:-1], same[1:])
    return out


def least_ids(wide: np.ndarray, least: np.ndarray, side: int = SIDE) -> np.ndarray:
    """[n, side + 1] for distinct surroundings of anchors: the least id that has each of their strings of LENGTH.

    Strings are numbered by where they start; those that a document's border
    cuts off keep their row's own id.
    """
    out = np.repeat(least[:, None], side + 1, axis=1)
    centre = np.ascontiguousarray(wide[:, side:LENGTH]).view(f"V{LENGTH - side}").ravel()
    _, group, size = np.unique(centre, return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[group] > 1)
    several = several[np.argsort(group[several], kind="stable")]
    # A string that two rows share lies in the stretch around the anchor that a
    # row shares with others of its group; what is outside, or a shorter
    # stretch, needs no sorting.
    head = group[several].astype(">u4").view(np.uint8).reshape(-1, 4)
    sides = [np.concatenate([head, x], axis=1) for x in (wide[several, :side][:, ::-1], wide[several, LENGTH : LENGTH + side])]
    left, right = (np.clip(_agreement(x) - 4, 0, wide[several, k].astype(np.int64)) for x, k in zip(sides, (-2, -1), strict=True))
    far = left + right >= side
    several, left, right = several[far], left[far], right[far]
    while len(several):
        # Whole groups up to TEXT_SYMBOLS; a larger group is one text, of HOT or 257 x 257 rows at most.
        stop = min(len(several), TEXT_SYMBOLS // (2 * side + 2))
        while stop < len(several) and group[several[stop]] == group[several[stop - 1]]:
            stop += 1
        rows, several = several[:stop], several[stop:]
        own, lefts, rights = wide[rows], left[:stop], right[:stop]
        left, right = left[stop:], right[stop:]
        # Symbols: 0 ends a row, bytes are 1 to 256, anchors follow.
        text = np.zeros((len(rows), 2 * side + 2), np.int64)
        text[:, :side] = own[:, :side].astype(np.int64) + 1
        text[:, side] = 257 + group[rows]
        text[:, side + 1 : -1] = own[:, LENGTH : LENGTH + side].astype(np.int64) + 1
        column = np.arange(text.shape[1])
        used = (column >= side - lefts[:, None]) & ((column <= side + rights[:, None]) | (column == text.shape[1] - 1))
        place = np.flatnonzero(used.ravel())
        flat = text.ravel()[place]
        order = place[np.array(suffix_array(flat.tolist()), np.int64)]
        row, start = order // text.shape[1], order % text.shape[1]
        whole = (start <= side) & (start <= rights[row])
        row, start = row[whole], start[whole]
        strings = text.ravel()[(row * text.shape[1] + start)[:, None] + np.arange(side + 1)]
        first = np.concatenate([[True], (strings[1:] != strings[:-1]).any(1)]) if len(row) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        low = np.minimum.reduceat(least[rows[row]], starts) if len(starts) else least[:0]
        out[rows[row], start] = np.repeat(low, np.diff(np.append(starts, len(row))))
    return out


def _resolve(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard: for each chunk's surroundings, how far below its own least id the least of each string is."""
    sent = [chunks.unblob(payload, 8, 8) for payload in rows["payload"]]
    answers = []
    for i, side in enumerate((SIDE, NEAR)):
        own, width, skip = [ids[i].view(np.int64) for ids, _ in sent], _width(side), _width(SIDE)
        wides = [np.frombuffer(raw, np.uint8, len(mine) * width, i * skip * len(ids[0])).reshape(-1, width) for (ids, raw), mine in zip(sent, own, strict=True)]
        wide, mine = np.concatenate(wides), np.concatenate(own)
        _, first, which = np.unique(np.ascontiguousarray(wide).view(f"V{width}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(first), NULL_ID, np.int64)
        np.minimum.at(least, which, mine)
        found, begin, below = least_ids(wide[first], least, side), 0, []
        for ids in own:
            below.append((ids[:, None] - found[which[begin : begin + len(ids)]]).ravel().astype(np.uint64))
            begin += len(ids)
        answers.append(below)
    return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "payload": [chunks.blob((a, 8), (b, 8)) for a, b in zip(*answers, strict=True)]})


def _removed(doc_rows: pd.DataFrame, found: pd.DataFrame) -> tuple[list, np.ndarray, bytes, np.ndarray]:
    """Ids, ends, joined bytes and which of them are removed."""
    ids, ends, joined = _documents(doc_rows)
    own = found[found["part"] < 0]["payload"].iloc[0]
    places, _ = chunks.unblob(own, 5, 4, 5, 4)
    answers = [chunks.unblob(payload, 8, 8)[0] for payload in found[found["part"] >= 0].sort_values("part")["payload"]]
    numbers, begins = np.array([NULL_ID if i is None else i for i in ids], np.int64), np.concatenate([[0], ends[:-1]])
    # Strings that cover a byte: at most LENGTH starts, each by few anchors.
    gone = np.zeros(len(joined) + 1, np.int16)
    for i, side in enumerate((SIDE, NEAR)):
        at, which = np.cumsum(places[2 * i].astype(np.int64)), places[2 * i + 1].astype(np.int64)
        if not len(at):
            continue
        doc = _doc_of(ends, at)
        number = numbers[doc]
        least = np.full(int(which.max()) + 1, NULL_ID, np.int64)
        np.minimum.at(least, which, number)
        order, base = np.argsort(which, kind="stable"), 0
        placed = which[order]
        for answer in answers:
            below = answer[i].view(np.int64).reshape(-1, side + 1)
            a, b = np.searchsorted(placed, [base, base + len(below)])
            for j in range(a, b, 1 << 14):
                s = order[j : min(b, j + (1 << 14))]
                start = at[s, None] - side + np.arange(side + 1)
                inside = (start >= begins[doc[s]][:, None]) & (start + LENGTH <= ends[doc[s]][:, None])
                begin = start[inside & (least[which[s]][:, None] - below[which[s] - base] < number[s][:, None])]
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + LENGTH, -1)
            base += len(below)
    np.cumsum(gone, out=gone)
    return ids, ends, joined, gone[:-1] > 0


def _digest(doc_rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    ids, ends, joined, gone = _removed(doc_rows, found)
    data = np.frombuffer(joined, np.uint8)
    out = []
    for i, a, b in zip(ids, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        g = gone[a:b]
        n = int(g.sum())
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0
        kept = data[a:b][~g].tobytes() if n else joined[a:b]
        out.append((i, b - a, n, spans, hashlib.sha256(kept).hexdigest()))
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return frame.assign(doc_id=pd.Series(ids, dtype="Int64"))


def _kept_text(doc_rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    ids, ends, joined, gone = _removed(doc_rows, found)
    data = np.frombuffer(joined, np.uint8)
    texts = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64"), "text": texts})


def _run(docs: DataFrame, finish, schema: str, chunk_bytes: int, hot: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    n = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "repeat-chunks")
    docs.select("doc_id", "text").mapInArrow(_chunk_rows(n, chunk_bytes, hot), chunks.CODED).write.partitionBy("kind").option("compression", "none").parquet(path)
    first = chunks.Coded(spark, path)
    answers = first.asked().groupBy("part").applyInPandas(_shared(hot), "chunk string, part int, payload binary")
    path = scratch_path(spark, "repeat-places")
    placed = first.documents().groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_surroundings(n), "chunk string, kind tinyint, part int, payload binary")
    with shuffles_dropped(spark):
        placed.write.partitionBy("kind").option("compression", "none").parquet(path)
    first.drop_asked()
    second = chunks.Coded(spark, path)
    resolved = cut(second.asked().groupBy("part").applyInPandas(_resolve, "chunk string, part int, payload binary"), "repeat-least")
    second.drop_asked()
    found = second.own().union(resolved)
    return first.documents().groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(finish, schema)


def digests(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _run(docs, _digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", chunk_bytes, hot)


def without_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id and the text that is left; bytes of characters cut in two go as well."""
    return _run(docs, _kept_text, "doc_id bigint, text string", chunk_bytes, hot).select("doc_id", F.col("text"))
