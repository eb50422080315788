"""Many plain documents to nodes at once, by operations on whole arrays: the rows that ``markup.Tree`` gives, in a fraction of its time.

Plain is a text whose tags and texts take turns: no sign ``<`` or ``>`` inside a text, comment or attribute, no end tag too many, no
prefixes and no languages. ``nodes`` says which documents are not; those are read one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a tag is: one that only a whole reading can tell, a beginning with and without content, nothing, the nodes that are no elements, an end.
OTHER, OPEN, EMPTY, NOTHING, COMMENT, PI, DECLARATION, CDATA, CLOSE = range(9)
#: Larger or deeper documents are read one by one.
MAX_BYTES, MAX_DEPTH = 4_000_000, 100
_KINDS = pa.array(["root", "element", "text", "comment", "pi"])


def _joined(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.StringArray:
    """The slices of the bytes, as strings."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    if offsets[-1] > 64 * len(start):
        view = data.tobytes()
        out = pa.py_buffer(b"".join([view[a : a + n] for a, n in zip(start.tolist(), length.tolist())]))
    else:
        out = pa.py_buffer(data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), out)


def _bytes_of(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of strings, the offsets from 0."""
    _, at, data = strings.buffers()
    offsets = np.frombuffer(at, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def nodes(ids: np.ndarray, xml: pa.StringArray, columns: list[str], names: frozenset[str] | None, tag, lists) -> tuple[pa.RecordBatch, np.ndarray]:
    """(the node rows of the plain documents, the places of the others). No text is null.

    ``tag`` tells (what it is, name, attributes, text) of a tag, ``lists`` makes the columns of lists.
    """
    offsets, data = _bytes_of(xml)
    size = np.diff(offsets)
    good = size <= MAX_BYTES
    lt, gt = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
    n_lt, n_gt = np.diff(np.searchsorted(lt, offsets)), np.diff(np.searchsorted(gt, offsets))
    good &= n_lt == n_gt
    every = np.arange(len(xml))
    doc = np.repeat(every, n_lt)
    lt, gt, doc = lt[good[doc]], gt[good[np.repeat(every, n_gt)]], doc[good[doc]]
    good[doc[lt > gt]] = False
    good[doc[:-1][(doc[:-1] == doc[1:]) & (gt[:-1] > lt[1:])]] = False
    keep = good[doc]
    lt, gt, doc = lt[keep], gt[keep], doc[keep]

    # every tag, and what follows it up to the next one
    edges = np.empty(2 * len(lt) + 1, np.int32)
    edges[0:-1:2], edges[1::2] = lt, gt + 1
    edges[-1] = edges[-2] if len(lt) else 0
    pieces = pa.StringArray.from_buffers(2 * len(lt), pa.py_buffer(edges), pa.py_buffer(data))
    close = data[lt + 1] == 47
    said = np.flatnonzero(~close)
    coded = pieces.take(pa.array(2 * said)).dictionary_encode()
    told = [tag(t) for t in coded.dictionary.to_pylist()]
    form, code = np.full(len(lt), CLOSE, np.int8), np.zeros(len(lt), np.int64)
    code[said] = coded.indices.to_numpy()
    form[said] = np.array([t[0] for t in told], np.int8)[code[said]]
    form[(form == DECLARATION) & (lt == offsets[doc])] = NOTHING
    form[form == DECLARATION] = PI
    good[doc[form == OTHER]] = False
    step = (form == OPEN).astype(np.int64) - (form == CLOSE)
    inside = np.cumsum(step)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    inside -= np.repeat(inside[first] - step[first], np.diff(np.append(first, len(doc))))  # open elements after the tag
    good[doc[(inside < 0) | (inside > MAX_DEPTH)]] = False
    at = np.flatnonzero(good[doc])
    lt, gt, doc, form, code, step, inside = (x[at] for x in (lt, gt, doc, form, code, step, inside))
    before = inside - step

    # rows: each document's root, then its tags and texts in order
    has_text = np.zeros(len(lt), bool)
    has_text[:-1] = (doc[:-1] == doc[1:]) & (gt[:-1] + 1 < lt[1:]) & (inside[:-1] > 0)
    flags = np.empty(2 * len(lt), bool)
    flags[0::2] = (form == OPEN) | (form == EMPTY) | (form == COMMENT) | (form == PI) | ((form == CDATA) & (before > 0))
    flags[1::2] = has_text
    rank = (np.cumsum(good) - 1)[doc]
    documents = np.flatnonzero(good)
    upto = np.cumsum(flags)
    last_row = upto[0::2] + rank  # the last node's row as far as a tag goes
    found = np.flatnonzero(flags)
    counts = np.bincount(rank[found >> 1], minlength=len(documents))
    root = np.cumsum(counts) - counts + np.arange(len(documents))
    total = int(counts.sum()) + len(documents)
    own_root = np.repeat(root, counts + 1)
    row = upto[found] + rank[found >> 1]
    from_tag = found % 2 == 0
    tag_at = np.full(total, -1)
    tag_at[row] = found >> 1
    kind = np.zeros(total, np.int8)
    tagged = form[found >> 1]
    kind[row] = np.where(~from_tag | (tagged == CDATA), 2, np.where(tagged == COMMENT, 3, np.where(tagged == PI, 4, 1)))
    depth = np.zeros(total, np.int32)
    depth[row] = np.where(from_tag, before[found >> 1], inside[found >> 1]) + 1

    # level by level: parents, where elements end, paths
    parent, end = own_root.copy(), np.arange(total)
    start, stop = np.zeros(total, np.int64), np.zeros(total, np.int64)
    start[row] = np.where(from_tag, lt[found >> 1], gt[found >> 1] + 1)
    following = np.append(lt[1:], 0)
    stop[row] = np.where(from_tag, gt[found >> 1] + 1, following[found >> 1])
    end[root], start[root], stop[root] = root + counts, offsets[documents], offsets[documents + 1]
    all_names: dict[str, int] = {}
    name_of = np.array([all_names.setdefault(t[1], len(all_names)) if t[1] is not None else -1 for t in told] or [-1])
    all_names_list = list(all_names)
    name = np.full(total, -1)
    name[row[from_tag]] = name_of[code[found[from_tag] >> 1]]
    paths, path = [""], np.full(total, -1)
    path[root] = 0
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=0)) + 2))
    closing = np.flatnonzero(form == CLOSE)
    opened = np.zeros(0, np.int64)
    for level in range(1, len(bounds) - 1):
        here = by_depth[bounds[level] : bounds[level + 1]]
        if level > 1:
            parent[here] = opened[np.searchsorted(opened, here) - 1]
        elements = here[kind[here] == 1]
        key, back = np.unique(path[parent[elements]] * max(len(all_names), 1) + name[elements], return_inverse=True)
        path[elements] = len(paths) + back
        paths += [f"{paths[k // len(all_names)]}/{all_names_list[k % len(all_names)]}" for k in key.tolist()]
        opened = elements[form[tag_at[elements]] == OPEN]
        closed = closing[before[closing] == level]
        k = tag_at[opened]
        j = np.searchsorted(closed, k)
        ended = j < len(closed)
        ended[ended] = doc[closed[j[ended]]] == doc[k[ended]]
        end[opened], stop[opened] = end[own_root[opened]], stop[own_root[opened]]
        end[opened[ended]], stop[opened[ended]] = last_row[closed[j[ended]]], gt[closed[j[ended]]] + 1

    rows = np.arange(total)
    if names is not None:
        # what is no element stays: its names are not the query's
        wanted = np.array([x in names for x in all_names_list] or [False])
        rows = np.flatnonzero((kind != 1) | wanted[name])
    spoken = np.zeros(total, bool)
    spoken[row] = from_tag
    place = np.where(spoken, len(pieces) + code[tag_at], 2 * at[tag_at] + 1) if len(at) else np.zeros(total, np.int64)
    texts = _texts(columns, rows, kind, end, place, told, pieces, (data == 38).any())
    if columns and ("start_off" in columns or "end_off" in columns):
        base = offsets[documents].repeat(counts + 1)
        if (data > 127).any():  # characters, not bytes
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            start, stop, base = chars[start], chars[stop], chars[base]
        start, stop = start - base, stop - base

    def numbers(x: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        return pa.array(x[rows].astype(np.int32), pa.int32(), mask=None if missing is None else missing[rows])

    def strings(x: np.ndarray, values: list[str]) -> pa.Array:
        return pa.array(values, pa.string()).take(pa.array(x[rows], mask=x[rows] < 0))

    def attributes() -> pa.Array:
        which = np.zeros(total, np.int64)
        with_tag = kind == 1
        which[with_tag] = code[tag_at[with_tag]] + 1
        return lists([None, *[t[2] for t in told]], "attrs").take(pa.array(which[rows]))

    made = {
        "pre": lambda: numbers(np.arange(total) - own_root),
        "end": lambda: numbers(end - own_root),
        "parent": lambda: numbers(parent - own_root, depth == 0),
        "depth": lambda: numbers(depth),
        "kind": lambda: _KINDS.take(pa.array(kind[rows])),
        "name": lambda: strings(name, all_names_list),
        "path": lambda: strings(path, paths),
        "text": lambda: texts["text"],
        "value": lambda: texts["value"],
        "attrs": attributes,
        "uri": lambda: pa.nulls(len(rows), pa.string()),
        "lang": lambda: pa.nulls(len(rows), pa.string()),
        "scope": lambda: lists([None], "scope").take(pa.array(np.zeros(len(rows), np.int64))),
        "start_off": lambda: numbers(start),
        "end_off": lambda: numbers(stop),
    }
    arrays = [pa.array(ids[documents].repeat(counts + 1)[rows], pa.int64()), *[made[c]() for c in columns]]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns]), np.flatnonzero(~good)


def _texts(columns: list[str], rows: np.ndarray, kind: np.ndarray, end: np.ndarray, place: np.ndarray, told: list, pieces: pa.StringArray, entities: bool) -> dict[str, pa.Array]:
    """Texts as written, and string-values: slices of the documents' decoded text. ``place``: where a node's own text is among the pieces, and what tags say after them."""
    from .markup import decode

    if "text" not in columns and "value" not in columns:
        return {}
    own, run = kind > 1, kind == 2
    extra = pa.array([t[3] or "" for t in told], pa.string())
    pool = pa.concat_arrays([pieces, extra]) if (place[own] >= len(pieces)).any() else pieces
    out = {}
    if "text" in columns:
        out["text"] = pool.take(pa.array(place[rows], mask=~own[rows]))
    if "value" in columns:
        runs = pool.take(pa.array(place[run]))
        if entities:
            coded = pc.and_(pc.match_substring(runs, "&"), pa.array(place[run] < len(pieces)))
            if pc.any(coded).as_py():
                runs = pc.replace_with_mask(runs, coded, pa.array([decode(x) for x in runs.filter(coded).to_pylist()], pa.string()))
        offsets, whole = _bytes_of(runs)
        before = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(run, out=before[1:])
        start = offsets[before[:-1]]
        length = offsets[before[end + 1]] - start
        said = np.flatnonzero(kind > 2)
        if len(said):
            extra_at, extra_data = _bytes_of(extra)
            c = place[said] - len(pieces)
            start[said], length[said] = len(whole) + extra_at[c], extra_at[c + 1] - extra_at[c]
            whole = np.concatenate([whole, extra_data])
        out["value"] = _joined(whole, start[rows], length[rows])
    return out
