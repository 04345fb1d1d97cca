"""A fixed camera's boxes linked into individuals.

Linking follows the frames of one camera, but only boxes that can ever meet need
one task: a box can be matched only with a track whose last box lies over its own
zone, so the boxes of a camera fall apart into components of touching zones, and
each component is linked on its own, with the same result. All that follows -
typicality, splitting, merging by components of candidate pairs, numbering -
works on tables of boxes and tracks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from boxwright.components import FEW_LINKS, connected_components
from boxwright.functions import boxes, labels
from boxwright.llm.memory import give_back, small_batches
from boxwright.operators.mutations import dense_ids
from boxwright.operators.vectors import dot, mean_vector, unit
from boxwright.session import cut, drop_path, never_sent, written

IOU, ALPHA, RETIRE, MIN_FRAMES = 0.5, 0.3, 24, 20
MIN_TYPICAL, SPLIT, MERGE, SAME_SPOT, TOGETHER = 0.5, 0.9, 0.9, 0.6, 0.05
CELL = 256
#: Tracks whose means are sent to every executor; more are joined by sorting.
FEW_TRACKS = 20_000
#: Tracks of a side that one task compares.
PART_TRACKS = 2048
#: Pixels of a cell of the zones, and cells that a zone has along a side at most (else cells are larger).
ZONE_CELL, ZONE_CELLS = 16, 64
#: Candidates in a frame up to which plain numbers are quicker than arrays.
FEW = 24


def frame_ranks(df: DataFrame, camera: str | None = None) -> DataFrame:
    """camera, image_path, frame: dense rank by video and frame number (nulls first), then image.

    Ranks are of distinct frames, not boxes, and dealt out by range. A null camera is one of its own.
    """
    cam = F.col(camera) if camera else F.lit("camera")
    frames = df.select(cam.alias("camera"), "video_path", "frame_number", "image_path").distinct()
    placed = dense_ids(frames, ["camera", "video_path", "frame_number", "image_path"], name="_nth")
    first = placed.groupBy(F.col("camera").alias("_camera")).agg(F.min("_nth").alias("_first"))
    ranked = placed.join(first, F.col("camera").eqNullSafe(F.col("_camera")))
    return ranked.withColumn("frame", (F.col("_nth") - F.col("_first") + 1).cast("int")).drop("_nth", "_first", "_camera")


def _iou(b: list[float], r: list[float]) -> float:
    inter = max(min(b[2], r[2]) - max(b[0], r[0]), 0.0) * max(min(b[3], r[3]) - max(b[1], r[1]), 0.0)
    return inter / max((b[2] - b[0]) * (b[3] - b[1]) + (r[2] - r[0]) * (r[3] - r[1]) - inter, 1e-9)


def _scores(b: np.ndarray, r: np.ndarray, least: float) -> list[tuple[float, int, int]]:
    """(-IoU, box, reference) of pairs that are alike enough, in order of boxes and references; arrays."""
    w = np.minimum(b[:, None, 2:], r[None, :, 2:]) - np.maximum(b[:, None, :2], r[None, :, :2])
    inter = np.clip(w, 0, None).prod(2)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    score = inter / np.maximum(size(b)[:, None] + size(r)[None, :] - inter, 1e-9)
    pairs = np.argwhere(score >= least)
    return list(zip((-score[pairs[:, 0], pairs[:, 1]]).tolist(), *pairs.T.tolist(), strict=True))


def _link_frames(pdf: pd.DataFrame, iou_min: float, alpha: float, retire: int) -> pd.DataFrame:
    """Tracks of one group of boxes. A track's number is the frame and the roi_index of its first box,
    so that tracks stand in the order in which they began, whatever else was linked beside them."""
    pdf = pdf.sort_values(["frame", "roi_index"], kind="stable")
    box, frame, roi = pdf[list(boxes.SIDES)].to_numpy(np.float64), pdf["frame"].to_numpy(np.int64), pdf["roi_index"].to_numpy(np.int64)
    plain, number = box.tolist(), ((frame << 32) | roi).tolist()
    track = [-1] * len(pdf)
    refs: list[list[float]] = []  # moving reference box of each track
    seen: list[list[int]] = []  # first and last frame
    names: list[int] = []
    live: list[int] = []
    starts = [0, *(np.flatnonzero(np.diff(frame)) + 1).tolist(), len(pdf)]
    for first, last in zip(starts[:-1], starts[1:], strict=True) if len(pdf) else []:
        now = int(frame[first])
        live = [t for t in live if now - seen[t][1] <= max(retire, 2 * (seen[t][1] - seen[t][0]))]
        if live:
            if len(live) * (last - first) <= FEW:
                pairs = [(-x, i, j) for i in range(last - first) for j, t in enumerate(live) if (x := _iou(plain[first + i], refs[t])) >= iou_min]
            else:
                pairs = _scores(box[first:last], np.array([refs[t] for t in live]), iou_min)
            taken: set[int] = set()
            for _, i, j in sorted(pairs, key=lambda p: p[0]):
                if track[first + i] < 0 and j not in taken:
                    taken.add(j)
                    t = live[j]
                    track[first + i] = t
                    refs[t] = [(1 - alpha) * r + alpha * b for r, b in zip(refs[t], plain[first + i], strict=True)]
                    seen[t][1] = now
        for i in range(first, last):
            if track[i] < 0:
                track[i] = len(refs)
                live.append(len(refs))
                refs.append(plain[i])
                seen.append([now, now])
                names.append(number[i])
    return pd.DataFrame({"camera": pdf["camera"], "roi_index": pdf["roi_index"], "track": np.array(names, np.int64)[track] if len(pdf) else np.zeros(0, np.int64)})


def _reach(iou_min: float) -> tuple[Column, Column, Column]:
    """How far a box's zone goes from its middle, to the sides and up and down; and whether it has an area."""
    reach = (1 - iou_min) / iou_min
    wide, high = ((F.col(hi) - F.col(lo)) * reach / 2 + 1e-6 for lo, hi in (("x_min", "x_max"), ("y_min", "y_max")))
    total = F.col("x_max") + F.col("x_min") + F.col("y_max") + F.col("y_min")
    return wide, high, F.coalesce((F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min")) & ~F.isnan(total), F.lit(False))


def zones(rows: DataFrame, iou_min: float = IOU, widest: float | None = None) -> DataFrame:
    """camera, roi_index, zone of boxes: boxes that linking can ever bring together have one zone.

    A match at IoU t moves either end of a side by (1 - t) / t of it at most, both ends together; a track's
    reference lies between its last box and the reference that this box matched. So the centres of a matched
    box and of its track's last box are apart by half the sum of their sides at most, scaled by (1 - t) / t:
    boxes of that size about the centres touch, and with them the cells they lie in. Different rectangles of
    cells, not boxes, are spread over cells and joined into components; sharing a cell, or a hash, joins more
    than must be, never less. Boxes without an area match nothing and have zones of their own. ``widest``: the
    farthest that a zone goes, where the caller knows it.
    """
    wide, high, has_area = _reach(iou_min)
    if widest is None:
        widest = rows.filter(has_area).agg(F.max(F.greatest(wide, high))).first()[0]
    cell = max(ZONE_CELL, (widest or 0) * 2 / ZONE_CELLS)
    ends = {}
    for axis, lo, hi, far in (("x", "x_min", "x_max", wide), ("y", "y_min", "y_max", high)):
        middle = (F.col(lo) + F.col(hi)) / 2
        ends |= {f"_{axis}0": F.floor((middle - far) / cell), f"_{axis}1": F.floor((middle + far) / cell)}
    placed = rows.select("camera", "roi_index", *(F.when(has_area, e).alias(n) for n, e in ends.items()))
    node = lambda x, y: F.xxhash64(F.coalesce("camera", F.lit("")), F.col("camera").isNull(), x, y)
    first = node(F.col("_x0"), F.col("_y0"))
    shapes = placed.filter("_x0 is not null").select("camera", *ends).distinct()
    cells = shapes.withColumn("x", F.explode(F.sequence("_x0", "_x1"))).withColumn("y", F.explode(F.sequence("_y0", "_y1")))
    links = cells.select(first.alias("a"), node(F.col("x"), F.col("y")).alias("b"))
    parts = connected_components(links, "zones", few=FEW_LINKS)
    known = placed.withColumn("_node", F.when(F.col("_x0").isNull(), F.xxhash64("roi_index", F.lit("alone"))).otherwise(first))
    return known.join(parts.select(F.col("node").alias("_node"), "component"), "_node", "left").select("camera", "roi_index", F.coalesce("component", "_node").alias("zone"))


def link(rows: DataFrame, iou_min: float = IOU, alpha: float = ALPHA, retire: int = RETIRE, by_zone: bool = True) -> DataFrame:
    """camera, roi_index, track for rows (camera, frame, roi_index, corners).

    Boxes of one camera are linked in as many tasks as they have zones. Where every pair may match
    (``iou_min`` 0) or the caller says so, a camera is one.
    """
    narrow = rows.select("camera", "frame", "roi_index", *(F.col(s).cast("double") for s in boxes.SIDES))
    by = ["camera"]
    if by_zone and iou_min > 0:
        wide, high, has_area = _reach(iou_min)
        seen = Observation()
        narrow = cut(narrow.observe(seen, F.max(F.when(has_area, F.greatest(wide, high))).alias("widest")), "to-link")
        of = zones(narrow, iou_min, seen.get["widest"] or 0.0).select(F.col("roi_index").alias("_roi"), F.col("camera").alias("_camera"), "zone")
        narrow = narrow.join(never_sent(of), (F.col("roi_index") == F.col("_roi")) & F.col("camera").eqNullSafe(F.col("_camera"))).drop("_roi", "_camera")
        by = ["camera", "zone"]
    return narrow.groupBy(*by).applyInPandas(lambda pdf: _link_frames(pdf, iou_min, alpha, retire), "camera string, roi_index int, track bigint")


def typicality(tracks: DataFrame, units: DataFrame) -> DataFrame:
    """roi_index, typicality: cosine of each box's unit vector to its track's mean; boxes without a vector have none."""
    rows = tracks.filter("track is not null").join(never_sent(units), "roi_index")
    means = mean_vector(rows, "u", "camera", "track")
    means = means.select("camera", "track", unit("mean").alias("c"))
    return rows.join(means, ["camera", "track"]).select("roi_index", dot("u", "c").alias("typicality"))


def _with_typicality(rows: DataFrame) -> DataFrame:
    """Rows (camera and track, not null, and the unit vector u) with ``typicality``, as above; a box alone in its track is its own mean.

    The vectors stay where they are unless very many tracks have several boxes.
    """
    means = mean_vector(rows, "u", "camera", "track").filter("n > 1").select("camera", "track", unit("mean").alias("_c"))
    means = cut(means, "centres")
    means = F.broadcast(means) if means.limit(FEW_TRACKS + 1).count() <= FEW_TRACKS else never_sent(means)
    seen = rows.filter("u is not null").join(means, ["camera", "track"], "left")
    none = rows.filter("u is null").withColumn("typicality", F.lit(None).cast("double"))
    return seen.withColumn("typicality", dot("u", F.coalesce("_c", "u"))).drop("_c").unionByName(none)


def unit_vectors(df: DataFrame, column: str = "embedding") -> DataFrame | None:
    """roi_index, u: vectors centred on the whole table, at unit length."""
    mean = mean_vector(df, column).first()
    if mean is None:
        return None
    return df.filter(F.col(column).isNotNull()).select("roi_index", unit(column, mean["mean"]).alias("u"))


def split_labels(tracks: DataFrame, names: DataFrame, units: DataFrame, similarity: float = SPLIT, min_frames: int = MIN_FRAMES) -> DataFrame:
    """Tracks (camera, roi_index, track as string) with groups of another label and look split off.

    The main label of a track is its most frequent (the first on ties). Another
    label's group that looks unlike it becomes a track of its own if it is big
    enough, else it leaves. Groups, or mains, without vectors stay.
    """
    rows = tracks.join(never_sent(names), "roi_index")
    means = mean_vector(rows.join(never_sent(units), "roi_index"), "u", "camera", "track", "lab").drop("n")
    return _split_off(rows, _unlike(rows, means, similarity), min_frames).select("camera", "roi_index", "track")


def _unlike(rows: DataFrame, means: DataFrame, similarity: float) -> DataFrame:
    """camera, track, lab, group_n: groups of another label that look unlike the main one."""
    groups = rows.groupBy("camera", "track", "lab").agg(F.count("*").alias("n"))
    main = groups.groupBy("camera", "track").agg(F.min_by("lab", F.struct(-F.col("n"), "lab")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    pairs = groups.join(main, ["camera", "track"]).filter("lab <> main").join(means, ["camera", "track", "lab"])
    pairs = pairs.join(means.select("camera", "track", F.col("lab").alias("main"), F.col("mean").alias("centre")), ["camera", "track", "main"])
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    cosine = F.aggregate(F.zip_with("mean", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / F.nullif(norm(F.col("mean")) * norm(F.col("centre")), F.lit(0.0))
    return pairs.withColumn("cosine", F.coalesce(cosine, F.lit(0.0))).filter(F.col("cosine") < similarity).select("camera", "track", "lab", F.col("n").alias("group_n"))


def _split_off(rows: DataFrame, unlike: DataFrame, min_frames: int) -> DataFrame:
    out = rows.join(unlike, ["camera", "track", "lab"], "left")
    track = F.when(F.col("group_n").isNull(), F.col("track").cast("string")).when(F.col("group_n") >= min_frames, F.concat_ws("/", "track", "lab"))
    return out.withColumn("track", track).drop("group_n")


def median_boxes(rows: DataFrame) -> DataFrame:
    """camera, track, median corners and number of boxes."""
    return rows.groupBy("camera", "track").agg(*(F.median(F.col(s).cast("double")).alias(s) for s in boxes.SIDES), F.count("*").alias("n"))


def same_spot_pairs(medians: DataFrame, overlap: float = SAME_SPOT, cell: int = CELL) -> DataFrame:
    """camera, a, b: tracks whose median boxes overlap. They meet in grid cells, not each with each."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = medians.withColumn("cx", F.explode(span("x_min", "x_max"))).withColumn("cy", F.explode(span("y_min", "y_max")))
    a = cells.select("camera", "cx", "cy", F.col("track").alias("a"), F.col("n").alias("n_a"), *(F.col(s).alias(f"a_{s}") for s in boxes.SIDES))
    b = cells.select("camera", "cx", "cy", F.col("track").alias("b"), F.col("n").alias("n_b"), *(F.col(s).alias(f"b_{s}") for s in boxes.SIDES))
    met = a.join(b, ["camera", "cx", "cy"]).filter("a < b")
    near = met.filter(boxes.overlap_of_smaller([F.col(f"a_{s}") for s in boxes.SIDES], [F.col(f"b_{s}") for s in boxes.SIDES]) >= overlap)
    return near.select("camera", "a", "b", "n_a", "n_b").distinct()


def _number(track: str) -> tuple:
    """Order of tracks: by number, those that were split off after all others."""
    head, _, rest = track.partition("/")
    return bool(rest), (int(head), "") if head.isdigit() else (0, head), rest


Seen = dict[int, int]


def _shared(a: Seen, b: Seen) -> int:
    """Frames that two tracks both have, by bitmaps of blocks of frames."""
    return sum((a[k] & b[k]).bit_count() for k in a.keys() & b.keys())


def _size(a: Seen) -> int:
    return sum(x.bit_count() for x in a.values())


def _merge(pairs: pd.DataFrame, frames: pd.DataFrame, min_frames: int, together: float) -> pd.DataFrame:
    """Groups of tracks, most alike first: big ones with each other, then each small one with the best big group.

    ``frames``: a bitmap for each track and block of frames.
    """
    seen: dict[str, Seen] = {}
    for t, block, bits in zip(frames["track"], frames["block"], frames["bits"], strict=True):
        seen.setdefault(t, {})[block] = int.from_bytes(bits, "little")
    home, crew = {t: t for t in seen}, {t: [t] for t in seen}

    def absorb(host: str, guest: str) -> None:
        for t in crew[guest]:
            home[t] = host
        crew[host] += crew.pop(guest)
        for k, bits in seen.pop(guest).items():
            seen[host][k] = seen[host].get(k, 0) | bits

    rows = []
    for a, b, n_a, n_b, cosine in pairs[["a", "b", "n_a", "n_b", "cosine"]].itertuples(index=False):
        (a, n_a), (b, n_b) = sorted(((a, n_a), (b, n_b)), key=lambda x: _number(x[0]))
        rows.append((-cosine, _number(a), _number(b), a, b, n_a >= min_frames, n_b >= min_frames))
    choices: dict[str, list[str]] = {}
    for *_, a, b, a_big, b_big in sorted(rows):
        if a_big != b_big:
            choices.setdefault(b if a_big else a, []).append(a if a_big else b)
        elif a_big and home[a] != home[b]:
            host, guest = sorted((home[a], home[b]), key=lambda t: -_size(seen[t]))
            if _shared(seen[host], seen[guest]) <= together * _size(seen[guest]):
                absorb(host, guest)
    for piece in sorted(choices, key=_number):
        fits = (home[t] for t in choices[piece] if _shared(seen[piece], seen[home[t]]) <= together * _size(seen[piece]))
        if host := next(fits, None):
            absorb(host, piece)
    cam = frames["camera"].iloc[0] if len(frames) else None
    return pd.DataFrame([(cam, t, host) for t, host in home.items() if t != host], columns=["camera", "track", "into"])


def _order(track: Column) -> Column:
    """``_number`` as a column."""
    head = F.substring_index(track, "/", 1)
    rest = F.substr(track, F.length(head) + 2)
    digits = head.rlike("^[0-9]+$")
    return F.struct((rest != "").alias("split"), F.when(digits, head.cast("decimal(38,0)")).otherwise(0).alias("number"), F.when(digits, "").otherwise(head).alias("name"), rest.alias("rest"))


def _merge_rows(min_frames: int, together: float):
    """``_merge`` over rows in order: of each part the bitmaps, pairs of big tracks, then small ones with a big one.

    Only the frames of a part's tracks are held, never its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, camera = None, None
        seen: dict[str, Seen] = {}
        home: dict[str, str] = {}
        crew: dict[str, list[str]] = {}

        def moved() -> Iterator[pa.RecordBatch]:
            found = [(t, host) for t, host in home.items() if t != host]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([camera] * len(found), *zip(*found, strict=True))], names=["camera", "track", "into"])

        def absorb(host: str, guest: str) -> None:
            for t in crew[guest]:
                home[t] = host
            crew[host] += crew.pop(guest)
            for k, bits in seen.pop(guest).items():
                seen[host][k] = seen[host].get(k, 0) | bits

        for batch in batches:
            for of, kind, cam, a, b, block, bits in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "camera", "a", "b", "block", "bits")), strict=True):
                if of != part:
                    yield from moved()
                    part, camera, seen, home, crew = of, cam, {}, {}, {}
                if kind == 0:
                    if a not in seen:
                        seen[a], home[a], crew[a] = {}, a, [a]
                    seen[a][block] = int.from_bytes(bits, "little")
                elif kind == 1:
                    if home[a] != home[b]:
                        host, guest = sorted((home[a], home[b]), key=lambda t: -_size(seen[t]))
                        if _shared(seen[host], seen[guest]) <= together * _size(seen[guest]):
                            absorb(host, guest)
                elif home[a] == a and _shared(seen[a], seen[home[b]]) <= together * _size(seen[a]):
                    absorb(home[b], a)
        yield from moved()
        give_back()

    return run


def frame_bitmaps(rows: DataFrame) -> DataFrame:
    """camera, track, block, bits: the frames of each track as bitmaps of 32,768 frames, put together before the shuffle."""
    return rows.groupBy("camera", "track", F.bitmap_bucket_number("frame").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("frame")).alias("bits"))


def _alike(x: pd.DataFrame, y: pd.DataFrame, cx: int, cy: int, similarity: float, overlap: float) -> np.ndarray:
    """Cosines of the tracks of two sides, minus infinity where they are no pair of this cell.

    Cosines have 12 digits, so that pairs that are equally alike stand by number. Spark's order of
    doubles holds: NaN is the greatest.
    """
    out = np.full((len(x), len(y)), -np.inf)
    means = [np.stack(f["mean"].to_numpy()).astype(np.float64) for f in (x, y)]
    norms = [np.linalg.norm(m, axis=1) for m in means]
    corners = [f[list(boxes.SIDES)].to_numpy(np.float64) for f in (x, y)]
    area = [(c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1]) for c in corners]
    first = [f[["x0", "y0"]].to_numpy(np.int64) for f in (x, y)]
    ids = [f["nth"].to_numpy(np.int64) for f in (x, y)]
    for i in range(0, len(x), 256):
        part = slice(i, i + 256)
        p, q = corners[0][part, None, :], corners[1][None, :, :]
        wide, high = (np.maximum(np.fmin(p[..., k + 2], q[..., k + 2]) - np.maximum(p[..., k], q[..., k]), 0.0) for k in (0, 1))
        share = wide * high / np.maximum(np.fmin(area[0][part, None], area[1][None, :]), 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.round(means[0][part] @ means[1].T / (norms[0][part, None] * norms[1][None, :]), 12)
        # A pair that shares several cells is one of the first of them.
        here = (np.maximum(first[0][part, None, 0], first[1][None, :, 0]) == cx) & (np.maximum(first[0][part, None, 1], first[1][None, :, 1]) == cy)
        fits = ~(share < overlap) & (cosine >= similarity) & here & (ids[0][part, None] != ids[1][None, :])
        out[part] = np.where(fits, cosine, -np.inf)
    return out


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _forest(alike: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, float]]:
    """The pairs (x, y, cosine) of the spanning forest of the most alike, by cosine, lower and higher number. Numbers ascend."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    px, py = at[: len(x)], at[len(x) :]
    of, out = np.arange(len(nodes)), set()
    while True:
        alike[of[px][:, None] == of[py][None, :]] = -np.inf
        right, down = alike.argmax(1), alike.argmax(0)  # the first of equals is the one of the least number
        r, c = np.concatenate([np.arange(len(x)), down]), np.concatenate([right, np.arange(len(y))])
        mine = np.concatenate([of[px], of[py]])
        w = alike[r, c]
        some = np.isfinite(w)
        if not some.any():
            return sorted(out)
        r, c, mine, w = r[some], c[some], mine[some], w[some]
        order = np.lexsort((np.maximum(x[r], y[c]), np.minimum(x[r], y[c]), -w, mine))
        chosen = order[np.unique(mine[order], return_index=True)[1]]
        out |= set(zip(x[r[chosen]].tolist(), y[c[chosen]].tolist(), w[chosen].tolist(), strict=True))
        of = _joined(len(nodes), of[px[r[chosen]]], of[py[c[chosen]]])[of]


def _pairs_of(similarity: float, overlap: float, every: bool):
    """Pairs of one block of a cell: all, or those of its spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["side"] == s].sort_values("nth") for s in (0, 1))
        found: list[tuple[int, int, float]] = []
        if len(x) and len(y):
            cx, cy, kind, i, j = (int(pdf[c].iloc[0]) for c in ("cx", "cy", "kind", "i", "j"))
            alike, a, b = _alike(x, y, cx, cy, similarity, overlap), x["nth"].to_numpy(np.int64), y["nth"].to_numpy(np.int64)
            if every:
                r, c = np.nonzero(np.isfinite(alike))
                once = (a[r] < b[c]) | (kind == 1) | (i != j)
                found = list(zip(a[r[once]].tolist(), b[c[once]].tolist(), alike[r[once], c[once]].tolist(), strict=True))
            else:
                found = _forest(alike, a, b)
            if kind == 0:
                found = sorted({(min(p, q), max(p, q), w) for p, q, w in found})
        out = pd.DataFrame(found, columns=["a", "b", "cosine"]).astype({"a": "int64", "b": "int64", "cosine": "float64"})
        return out.assign(kind=np.int32(pdf["kind"].iloc[0]))

    return run


def _like_pairs(tracks: DataFrame, means: DataFrame, similarity: float, min_frames: int, every: bool) -> DataFrame:
    """a, b, cosine, kind: tracks (by number) in one spot that look alike; kind 0 are two big ones, 1 a big (a) and a small one.

    Tracks meet in grid cells, in blocks of ``PART_TRACKS`` a side. Two small ones are no pair.
    Unless ``every``, a block leaves its spanning forest of the most alike, so that what leaves it grows with its tracks, not its pairs.
    """
    at = lambda c: F.floor(F.col(c) / CELL)
    big = (F.col("n") >= min_frames).alias("big")
    cells = tracks.select("nth", big, "camera", F.explode(F.sequence(at("x_min"), at("x_max"))).alias("cx"), F.sequence(at("y_min"), at("y_max")).alias("_cy"))
    cells = cells.select("nth", "big", "camera", "cx", F.explode("_cy").alias("cy"))
    where = ["camera", "cx", "cy"]
    parts = lambda n: F.ceil(n / PART_TRACKS).cast("int")
    sizes = cells.groupBy(*where).agg(parts(F.count_if("big")).alias("bigs"), parts(F.count_if(~F.col("big"))).alias("smalls")).filter("bigs > 0")
    p = F.pmod(F.xxhash64("nth"), F.when(F.col("big"), F.col("bigs")).otherwise(F.col("smalls"))).cast("int")
    placed = cut(cells.join(sizes, where).withColumn("p", p), "placed")
    big, small = placed.filter("big"), placed.filter("not big")
    upto = lambda lo, hi: F.explode(F.sequence(lo, hi))
    zero, own = F.lit(0), F.col("p")

    def block(rows: DataFrame, i, j, kind: int, side: int) -> DataFrame:
        return rows.select(*where, i.alias("i"), "*").select("*", j.alias("j")).select(*where, "i", "j", F.lit(kind).alias("kind"), F.lit(side).alias("side"), "nth")

    asked = block(big.select("nth", "p", "bigs", *where), own, upto(own, F.col("bigs") - 1), 0, 0)
    asked = asked.union(block(big.select("nth", "p", *where), upto(zero, own), own, 0, 1))
    asked = asked.union(block(big.filter("smalls > 0").select("nth", "p", "smalls", *where), own, upto(zero, F.col("smalls") - 1), 1, 0))
    asked = asked.union(block(small.select("nth", "p", "bigs", *where), upto(zero, F.col("bigs") - 1), own, 1, 1))
    about = tracks.join(never_sent(means), ["camera", "track"]).select("nth", at("x_min").alias("x0"), at("y_min").alias("y0"), *boxes.SIDES, "mean")
    met = asked.join(never_sent(about), "nth")
    return met.groupBy(*where, "i", "j", "kind").applyInPandas(_pairs_of(similarity, SAME_SPOT, every), "a bigint, b bigint, cosine double, kind int")


def merge_fragments(rows: DataFrame, units: DataFrame | None, similarity: float = MERGE, min_frames: int = MIN_FRAMES, together: float = TOGETHER) -> DataFrame:
    """camera, track, into: tracks that are pieces of another. ``rows``: camera, frame, roi_index, track (string), corners, and u if ``units`` is None.

    Tracks are merged within components of candidate pairs, each by one task, so a camera with many
    spots takes many. A task reads the pairs in order and holds only the tracks' frames. Where no two tracks
    of a component share a frame, nothing keeps two apart, and the pairs of the spanning forests of
    all blocks lead to the same merges in the same order as all pairs; only other components have theirs listed.
    """
    numbers = _order(F.col("track"))
    medians = median_boxes(rows.filter("camera is not null")).select("*", *(numbers[c].alias(f"_{c}") for c in ("split", "number", "name", "rest")))
    tracks = dense_ids(medians, ["camera", "_split", "_number", "_name", "_rest", "track"], name="nth").drop("_split", "_number", "_name", "_rest")
    tracks = tracks.withColumn("nth", F.col("nth").cast("long"))
    looks = rows if units is None else rows.join(never_sent(units), "roi_index")
    means = cut(mean_vector(looks, "u", "camera", "track").drop("n"), "means")
    links = cut(_like_pairs(tracks, means, similarity, min_frames, every=False), "links")
    parts = cut(connected_components(links.select("a", "b"), "pair-groups", few=FEW_LINKS), "pair-groups")
    used = cut(tracks.select("camera", "track", "n", F.col("nth").alias("node"), *boxes.SIDES).join(parts, "node"), "used-tracks")
    frames = cut(frame_bitmaps(rows.join(used, ["camera", "track"], "left_semi")).join(used.select("camera", "track", "node", F.col("component").alias("part")), ["camera", "track"]), "bitmaps")
    filled = frames.groupBy("part", "block").agg(F.sum(F.bitmap_count("bits")).alias("all"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("different"))
    mixed = cut(filled.filter(F.col("all") > F.col("different")).select("part").distinct(), "mixed")
    part = parts.select(F.col("node").alias("a"), F.col("component").alias("part"))
    pairs = links.join(part, "a")
    if not mixed.isEmpty():
        again = used.join(mixed.withColumnRenamed("part", "component"), "component", "left_semi").withColumnRenamed("node", "nth")
        every = _like_pairs(again, means, similarity, min_frames, every=True).join(part, "a")
        pairs = pairs.join(mixed, "part", "left_anti").unionByName(every)
    null = lambda kind: F.lit(None).cast(kind)
    held = frames.select("part", F.lit(0).alias("kind"), "camera", F.col("node").cast("string").alias("a"), null("string").alias("b"), null("double").alias("cosine"), null("long").alias("low"), null("long").alias("high"), "block", "bits")
    text = lambda c: F.col(c).cast("string")
    both = F.col("kind") == 0
    met = pairs.select("part", F.when(both, 1).otherwise(2).alias("kind"), null("string").alias("camera"), F.when(both, text("a")).otherwise(text("b")).alias("a"), F.when(both, text("b")).otherwise(text("a")).alias("b"), "cosine", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), null("long").alias("block"), null("binary").alias("bits"))
    # Pairs of big tracks stand by likeness, those of a small one by its number and then by likeness.
    order = ["part", "kind", F.when(F.col("kind") == 2, F.col("a").cast("long")), F.desc("cosine"), "low", "high"]
    small_batches(rows.sparkSession)
    found = held.unionByName(met).repartition("part").sortWithinPartitions(*order).mapInArrow(_merge_rows(min_frames, together), "camera string, track string, into string")
    named = lambda c: used.select(text("node").alias(c), F.col("track").alias(f"_{c}"))
    return found.join(named("track"), "track").join(named("into"), "into").select("camera", F.col("_track").alias("track"), F.col("_into").alias("into"))


def kept(rows: DataFrame, min_frames: int = MIN_FRAMES) -> DataFrame:
    """roi_index, fixture, and the row: tracks of enough boxes, numbered from 0 by camera and first box.

    The rows are stored first: they are read for the sizes, for the numbers and for the result, and linked once.
    """
    rows = cut(rows.filter("track is not null"), "tracked")
    sized = rows.groupBy(F.col("camera").alias("_camera"), F.col("track").alias("_track")).agg(F.count("*").alias("_n"), F.min("roi_index").alias("_first")).filter(F.col("_n") >= min_frames)
    numbered = dense_ids(sized, ["_camera", "_first"], name="fixture").drop("_n", "_first")
    return rows.join(numbered, F.col("camera").eqNullSafe(F.col("_camera")) & (F.col("track") == F.col("_track"))).drop("_camera", "_track")


def fixture_info(rows: DataFrame) -> DataFrame:
    """fixture, rep_roi_index (most typical, else most confident), n, first and last image by frame."""
    key = F.coalesce(F.col("typicality"), F.coalesce(F.col("confidence").cast("double"), F.lit(-1.0)) - 10)
    return rows.groupBy("fixture").agg(F.max_by("roi_index", F.struct(key, -F.col("roi_index"))).alias("rep_roi_index"), F.count("*").alias("n"), F.min_by("image_path", F.struct("frame", "roi_index")).alias("first_image"), F.max_by("image_path", F.struct("frame", "roi_index")).alias("last_image"))


def _in_frames(df: DataFrame, camera: str | None) -> DataFrame:
    """Narrow rows of all boxes with camera and frame; a frame is a video, a number and an image, each null or not.

    Cameras become keys that are never null: '0' for none, else '1' and the name.
    """
    key = ["video_path", "frame_number", "image_path"]
    name = F.when(F.col(camera).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(camera).cast("string"))) if camera else F.lit("1camera")
    keyed = df.select(name.alias("camera"), *key, "roi_index", "confidence", F.coalesce(labels.review_label(), F.lit("")).alias("lab"), *boxes.SIDES)
    frames = frame_ranks(keyed, "camera").select(F.col("camera").alias("_camera"), "frame", *(F.col(c).alias(f"_{c}") for c in key))
    met = F.col("camera") == F.col("_camera")
    for c in key:
        met &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return keyed.join(never_sent(frames), met).select("camera", "frame", "roi_index", "image_path", "confidence", "lab", *boxes.SIDES)


def fixtures(df: DataFrame, camera: str | None = None, column: str = "embedding", min_frames: int = MIN_FRAMES) -> dict[str, DataFrame]:
    """The whole run: ``fixtures``, ``fixture_info``, the boxes that are kept (``rows``) and ``coverage``.

    Boxes without a camera are one camera's; boxes without a video, a frame number or an image are kept as any other.
    """
    narrow = cut(_in_frames(df, camera), "frames")
    linked = cut(link(narrow).select("camera", "roi_index", F.col("track").cast("string").alias("track")), "linked")
    if (n_linked := linked.count()) != (n_boxes := df.count()):
        raise RuntimeError(f"{n_linked} boxes were linked of {n_boxes}")
    mean = mean_vector(df, column).first()
    none = F.lit(0).cast("bigint")
    counts = [narrow.agg(F.count("*").alias("boxes"))]
    if mean is not None:
        # Vectors meet the boxes once, as they are given, and go along with them; all later steps read that table.
        spark = df.sparkSession
        looks = df.filter(F.col(column).isNotNull()).select("roi_index", F.col(column).alias("_v"))
        rows, path = written(narrow.join(never_sent(linked), ["camera", "roi_index"]).join(never_sent(looks), "roi_index", "left"), "seen")
        rows = rows.filter("_v is not null").withColumn("u", unit("_v", mean["mean"])).unionByName(rows.filter("_v is null").withColumn("u", F.lit(None).cast("array<double>"))).drop("_v")
        typical = cut(_with_typicality(rows), "typical")
        drop_path(spark, path)
        stray = F.coalesce(F.col("typicality"), F.lit(1.0)) < MIN_TYPICAL
        like = typical.filter(~stray).drop("typicality")
        unlike = cut(_unlike(like, mean_vector(like, "u", "camera", "track", "lab").drop("n"), SPLIT), "unlike")
        parts = _split_off(like, unlike, min_frames)
        placed = parts.filter("track is not null")
        into = cut(merge_fragments(placed, None, MERGE, min_frames), "into")
        joined = placed.join(into, ["camera", "track"], "left")
        moved = joined.filter("into is not null").groupBy("camera", "track").agg(F.count("*").alias("n"))
        tracks = _with_typicality(joined.withColumn("track", F.coalesce("into", "track")).drop("into")).drop("u")
        big = F.col("n") >= min_frames
        counts += [typical.agg(F.count_if(stray).alias("intruders")), parts.agg(F.count_distinct(F.when(F.col("track").contains("/"), F.struct("camera", "track"))).alias("split"), F.count_if(F.col("track").isNull()).alias("split_left"))]
        counts += [moved.agg(F.count_if(big).alias("merged"), F.coalesce(F.sum(F.when(~big, F.col("n"))), none).alias("attached"))]
    else:
        tracks = narrow.join(never_sent(linked), ["camera", "roi_index"]).withColumn("typicality", F.lit(None).cast("double"))
        counts += [narrow.agg(*(F.coalesce(F.max(none), none).alias(c) for c in ("intruders", "split", "split_left", "merged", "attached")))]
    found = kept(tracks, min_frames).withColumn("camera", F.when(F.col("camera") != "0", F.substring("camera", 2, 1 << 30)))
    counts.append(found.agg(F.count_distinct("fixture").alias("fixtures"), F.count("*").alias("kept")))
    out = {"fixtures": found.select("roi_index", "fixture", "typicality"), "fixture_info": fixture_info(found), "rows": found}
    return out | {"coverage": coverage(counts)}


def coverage(counts: list[DataFrame]) -> DataFrame:
    """One row: fixtures, boxes kept and their share of all; boxes unlike their fixture; groups split off and boxes
    of smaller ones left; tracks merged; boxes of small pieces attached. Each table in ``counts`` has one row."""
    row = counts[0].withColumn("_one", F.lit(1))
    for c in counts[1:]:
        row = row.join(c.withColumn("_one", F.lit(1)), "_one")
    return row.select("fixtures", "kept", "boxes", F.round(100.0 * F.col("kept") / F.nullif("boxes", F.lit(0)), 1).alias("percent"), "intruders", "split", "split_left", "merged", "attached")
