"""Suffix-array deduplication by a common-prefix-aware distributed merge sort.

Which bytes lie in a string of SPAN bytes that also starts earlier? The texts are dealt once, in groups of documents, and then:

1. Anchors. Of every SPAN consecutive bytes the CORE-byte string with the least hash is the anchor, so equal strings have equal
   anchors at equal places. The starts that share an anchor are one region, about 33 of them. A group sorts its regions by
   (core hash, region hash) and sends each core once.
2. Distinguishing. A core that stands once in the corpus begins no repeated string. A core with one region everywhere settles
   all of its copies but the first. Only regions whose core has several different regions go on: their suffixes are to be told
   apart.
3. Merge sort. A group sorts these anchor suffixes; runs are exchanged front-coded (length of the prefix shared with the one
   before, then the rest; the core itself is known by its hash and never sent) and merged by a loser tree that keeps, for each
   loser, its common prefix with the winner: a comparison begins behind it. In the merged order, suffixes with a common prefix
   are neighbours; with a hash of what stands to the left this gives the classes of equal SPAN-byte strings, and all of a class
   but its first are marked.
4. Removal. Marked spans meet their texts by group again.

A core with over CROWD different regions (the edge of a passage that very many documents continue differently) would gather its
regions in one task; its strings are told apart one by one instead, dealt by their own hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Prefixes, mixed, partitions, slices, text_or_empty, utf8

SPAN = 100
CORE = 36
REACH = SPAN - CORE  # a core starts at most so far behind the string it is the anchor of
CROWD = 2048
ROUND = 1 << 19  # bytes of array work
ONCE, COPY, SEVERAL, CROWDED = 0, 1, 2, 3


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; of wide numbers all first bytes, then all second ones, ..., as high ones compress to nothing."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.itemsize, len(a)))], "<i8").tobytes()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3)
    at, out = 8 * (3 * n + 1), []
    for kind, size, length in head.tolist():
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(f"{chr(kind)}{size}").reshape(length))
        at += size * length
    return out


class Group:
    """The distinct documents of a group in corpus order: by doc_id, nulls last; then by text hash where an id repeats.

    Rows equal in doc_id and text are one document: a row is no earlier copy of itself.
    """

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        number[null] = np.uint64(0xFFFFFFFFFFFFFFFF)
        data, offsets = utf8(table.column("text"))
        tie = table.column("tie").to_numpy().view(np.uint64)
        order = np.lexsort((tie, number, null))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (number[order[1:]] != number[order[:-1]]) | (tie[order[1:]] != tie[order[:-1]]) | (null[order[1:]] != null[order[:-1]])
        self.of_row = np.empty(len(order), np.int64)  # the document of each row
        self.of_row[order] = np.cumsum(fresh) - 1
        self.rows = order[fresh]
        self.high = number[self.rows]
        same = np.zeros(len(self.rows), bool)
        same[1:] = self.high[1:] == self.high[:-1]
        same[:-1] |= same[1:]
        self.low = np.where(same | null[self.rows], tie[self.rows], np.uint64(0))
        self.data, self.offsets = data, offsets

    def text(self, k: int) -> np.ndarray:
        row = self.rows[k]
        return self.data[self.offsets[row] : self.offsets[row + 1]]

    def gathered(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.text(k) for k in documents.tolist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return (np.concatenate(parts) if parts else np.empty(0, np.uint8)), offsets


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def regions(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Regions of texts end to end: core and region hashes, text, first and last start, place of the anchor (in the text)."""
    n = len(data)
    if n < SPAN:
        return {k: np.empty(0, t) for k, t in (("core", np.uint64), ("region", np.uint64), ("text", np.int64), ("first", np.int64), ("last", np.int64), ("anchor", np.int64))}
    prefixes = Prefixes(data)
    at = np.arange(n - CORE + 1)
    cores = prefixes.of(at, at + CORE)
    key = (cores & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties go to the left
    anchor = (sliding_least(key, REACH + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    room = np.ones(n - SPAN + 1, bool)
    for end in offsets[1:-1].tolist():  # strings do not cross texts
        room[max(0, end - SPAN + 1) : end] = False
    start = np.flatnonzero(room)
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    anchor, first, last = anchor[first], start[first], start[last]
    text = np.searchsorted(offsets, first, "right") - 1
    base = offsets[text]
    return {"core": cores[anchor], "region": prefixes.of(first, last + SPAN), "text": text, "first": first - base, "last": last - base, "anchor": anchor - base}


def group_regions(group: Group) -> dict[str, np.ndarray]:
    """All regions of a group, ordered by (core, region, document, place)."""
    size = np.diff(group.offsets)[group.rows]
    long = np.flatnonzero(size >= SPAN)
    parts = []
    for a, b in slices(np.concatenate([[0], np.cumsum(size[long])]), ROUND):
        got = regions(*group.gathered(long[a:b]))
        got["text"] = long[a:b][got["text"]]
        parts.append(got)
    if not parts:
        return regions(np.empty(0, np.uint8), np.zeros(1, np.int64))
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = np.lexsort((out["first"], out["text"], out["region"], out["core"]))
    return {k: v[order] for k, v in out.items()}


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings sorted keys together by bucket, and their buckets in it.

    Core hashes are minima of many and so lie close to zero; they are scrambled once more before they are dealt.
    """
    bucket = ((mixed(keys) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of a sorted array."""
    at = [*np.flatnonzero(_starts(bucket)).tolist(), len(bucket)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(bucket[a]), a, b


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def send_cores(table: pa.Table, buckets: int) -> pa.Table:
    """Step 1: each core of a group once: with its region if there is one, and with the earliest place of it."""
    group = Group(table)
    r = table.column("r")[0].as_py()
    got = group_regions(group)
    kind = np.flatnonzero(_starts(got["core"], got["region"]))
    core = got["core"][kind]
    head = np.flatnonzero(_starts(core))
    kinds = np.diff(np.append(head, len(core)))
    at = kind[head]
    text = got["text"][at]
    columns = (core[head], got["region"][at], np.minimum(kinds, 65535).astype(np.uint16), group.high[text], group.low[text], got["first"][at].astype(np.uint32))
    order, bucket = _dealt(columns[0], buckets)
    columns = tuple(c[order] for c in columns)
    rows = [(b, r, packed(*(c[x:y] for c in columns))) for b, x, y in _cuts(bucket)]
    return _rows(rows, ["bucket", "r", "entries"], [pa.int32(), pa.int32(), pa.binary()])


def judge_cores(table: pa.Table, crowd: int = CROWD) -> pa.Table:
    """Step 2: what each group is to do with the cores that others, or several of its regions, share."""
    sent = [unpacked(b) for b in table.column("entries").to_pylist()]
    run = np.repeat(np.array(table.column("r").to_pylist(), np.int32), [len(s[0]) for s in sent])
    core, region, kinds, high, low, place = (np.concatenate(c) for c in zip(*sent, strict=True))
    order = np.lexsort((place, low, high, core))
    core, region, kinds, run = core[order], region[order], kinds[order].astype(np.int64), run[order]
    head = np.flatnonzero(_starts(core))
    which = np.cumsum(_starts(core)) - 1
    n = np.diff(np.append(head, len(core)))
    several = np.logical_or.reduceat((kinds > 1) | (region != region[head][which]), head)
    crowded = np.add.reduceat(kinds, head) > crowd
    verdict = np.where(several & crowded, CROWDED, np.where(several, SEVERAL, np.where(n > 1, COPY, ONCE)))[which]
    verdict[head[~several]] = ONCE  # the first copy of all
    keep = verdict != ONCE
    core, verdict, run = core[keep], verdict[keep].astype(np.uint8), run[keep]
    order = np.argsort(run, kind="stable")
    core, verdict, run = core[order], verdict[order], run[order]
    return _rows([(r, packed(core[a:b], verdict[a:b])) for r, a, b in _cuts(run)], ["r", "replies"], [pa.int32(), pa.binary()])


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, the first ``known`` bytes of which need no look."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return known + len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_coded(cores: np.ndarray, rights: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sorted run as shared prefix lengths, lengths of the rests, and the rests."""
    shared = np.zeros(len(rights), np.uint8)
    same = np.zeros(len(rights), bool)
    same[1:] = cores[1:] == cores[:-1]
    for i in np.flatnonzero(same).tolist():
        shared[i] = _common(rights[i - 1], rights[i], 0)
    rests = [r[s:] for r, s in zip(rights, shared.tolist(), strict=True)]
    return shared, np.array([len(x) for x in rests], np.uint8), np.frombuffer(b"".join(rests), np.uint8)


def spelled(shared: np.ndarray, sizes: np.ndarray, rests: np.ndarray) -> list[bytes]:
    raw, at, before, out = rests.tobytes(), 0, b"", []
    for s, n in zip(shared.tolist(), sizes.tolist(), strict=True):
        before = before[:s] + raw[at : at + n]
        out.append(before)
        at += n
    return out


def merged(runs: list[tuple[list[int], list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of (core, suffix) with a loser tree: (run, index in it, common prefix with the one before).

    A run gives for each entry its common prefix with the entry before: 0 for another core, else 1 + bytes of the suffix. Each
    loser keeps its common prefix with the winner that beat it. Of two that share different lengths with the last output, the
    longer is the smaller, without a look; of equal ones the comparison begins behind what they share.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    place = [0] * k
    prefix = [0] * size
    ended = [r >= k or not runs[r][0] for r in range(size)]

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b; the loser's prefix becomes what it shares with the winner."""
        if ended[a] or ended[b]:
            return not ended[a]
        if prefix[a] != prefix[b]:
            return prefix[a] > prefix[b]
        cores_a, rights_a, _ = runs[a]
        cores_b, rights_b, _ = runs[b]
        i, j, known = place[a], place[b], prefix[a]
        if known == 0:
            if cores_a[i] != cores_b[j]:
                return cores_a[i] < cores_b[j]
            known = 1
        x, y = rights_a[i], rights_b[j]
        n = _common(x, y, known - 1)
        won = n == len(x) if n == len(x) or n == len(y) else x[n] < y[n]
        prefix[b if won else a] = n + 1
        return won

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        won = beats(a, b)
        winners[node], losers[node] = (a, b) if won else (b, a)
    top = winners[1]
    out_run, out_at, out_prefix = [], [], []
    while not ended[top]:
        out_run.append(top)
        out_at.append(place[top])
        out_prefix.append(prefix[top])
        place[top] += 1
        if place[top] >= len(runs[top][0]):
            ended[top] = True
        else:
            prefix[top] = runs[top][2][place[top]]
        node = (size + top) >> 1
        while node:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node >>= 1
    return out_run, out_at, out_prefix


def _joined_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal unions of spans for each owner; spans that touch are one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    far = int(end.max()) + 1
    upto = np.maximum.accumulate(end + owner * far) - owner * far
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > upto[:-1])
    at = np.flatnonzero(new)
    return owner[at], start[at], upto[np.append(at[1:], len(owner)) - 1]


def send_suffixes(table: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """Step 3, in a group: spans that are settled, and front-coded sorted runs of the suffixes that are not."""
    if not table.num_rows:
        return _rows([], ["bucket", "r", "kind", "entries"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])
    group = Group(table)
    r = table.column("r")[0].as_py()
    got = group_regions(group)
    told = [unpacked(b) for b in replies.column("replies").to_pylist()]
    cores = np.concatenate([t[0] for t in told]) if told else np.empty(0, np.uint64)
    verdicts = np.concatenate([t[1] for t in told]) if told else np.empty(0, np.uint8)
    order = np.argsort(cores)
    cores, verdicts = cores[order], verdicts[order]
    verdict = np.zeros(len(got["core"]), np.uint8)
    if len(cores):
        at = np.minimum(np.searchsorted(cores, got["core"]), len(cores) - 1)
        verdict = np.where(cores[at] == got["core"], verdicts[at], ONCE)
    fresh = _starts(got["core"], got["region"])
    settled = ~fresh | (verdict == COPY)
    rows: list[tuple] = []
    text, first, last = got["text"], got["first"], got["last"]
    spans = [(text[settled], first[settled], last[settled] + SPAN)]

    crowd = np.flatnonzero(fresh & (verdict == CROWDED))
    if len(crowd):  # one by one: strings by their own hash, each once
        n = last[crowd] - first[crowd] + 1
        owner = np.repeat(text[crowd], n)
        start = np.repeat(first[crowd] - np.cumsum(n) + n, n) + np.arange(n.sum())
        core = np.repeat(got["core"][crowd], n)
        documents, back = np.unique(owner, return_inverse=True)
        string = np.empty(len(owner), np.uint64)
        size = np.array([len(group.text(k)) for k in documents.tolist()])
        for a, b in slices(np.concatenate([[0], np.cumsum(size)]), ROUND):
            data, offsets = group.gathered(documents[a:b])
            mine = np.flatnonzero((back >= a) & (back < b))
            where = offsets[back[mine] - a] + start[mine]
            string[mine] = Prefixes(data).of(where, where + SPAN)
        order = np.lexsort((start, owner, core, string))
        owner, start, core, string = owner[order], start[order], core[order], string[order]
        new = _starts(string, core)
        spans.append((owner[~new], start[~new], start[~new] + SPAN))
        owner, start, core, string = owner[new], start[new], core[new], string[new]
        columns = (string, core, group.high[owner], group.low[owner], start.astype(np.uint32), owner.astype(np.uint32))
        order, bucket = _dealt(string, buckets)
        columns = tuple(c[order] for c in columns)
        rows += [(b, r, 2, packed(*(c[x:y] for c in columns))) for b, x, y in _cuts(bucket)]

    go = np.flatnonzero(fresh & (verdict == SEVERAL))
    if len(go):
        rights, lefts = [], []
        for k, a, b, p in zip(text[go].tolist(), first[go].tolist(), last[go].tolist(), got["anchor"][go].tolist(), strict=True):
            body = group.text(k)
            lefts.append(body[a:p].tobytes())
            rights.append(body[p + CORE : b + SPAN].tobytes())
        core = got["core"][go]
        by, bucket = _dealt(core, buckets)
        for b, x, y in _cuts(bucket):
            order = sorted(by[x:y].tolist(), key=lambda i: (core[i], rights[i]))
            chosen = np.array(order)
            mine = core[chosen]
            shared, sizes, rests = front_coded(mine, [rights[i] for i in order])
            left = [lefts[i] for i in order]
            owner = text[go[chosen]]
            rows.append((b, r, 1, packed(
                mine, shared, sizes, rests, np.array([len(x) for x in left], np.uint8), np.frombuffer(b"".join(left), np.uint8),
                group.high[owner], group.low[owner], got["anchor"][go[chosen]].astype(np.uint32), owner.astype(np.uint32),
            )))
    owner, start, end = _joined_spans(*(np.concatenate(c) for c in zip(*spans, strict=True)))
    if len(owner):
        rows.append((r % buckets, r, 0, packed(owner.astype(np.uint32), start.astype(np.uint32), end.astype(np.uint32))))
    return _rows(rows, ["bucket", "r", "kind", "entries"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])


WINDOWS = 1 << 20  # strings that are told apart at once


def marked(cores: np.ndarray, prefix: np.ndarray, rights: np.ndarray, lefts: np.ndarray, left: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance to its anchor) of every string that is not the first of its class.

    Entries are in merged order. ``prefix``: common prefix with the entry before, as in ``merged``; ``rights`` and ``lefts``:
    lengths of what is known around the anchor; ``left``: the left contexts end to end; ``rank``: corpus order. The string that
    starts d bytes before an anchor is known by d, by the run of neighbours that share REACH - d bytes behind the core, and by
    the d bytes to the left.
    """
    nearest_start, farthest = REACH - rights, lefts
    hashes, ends = Prefixes(left), np.cumsum(lefts)
    head = np.flatnonzero(_starts(cores))
    count = np.cumsum(farthest - nearest_start + 1)
    out_entry, out_distance = [], []
    bounds = np.append(head, len(cores))
    done = np.concatenate([[0], count])[bounds]
    for a, b in slices(done, WINDOWS):
        low, high = int(bounds[a]), int(bounds[b])
        shared = prefix[low:high] - 1
        shared[_starts(cores[low:high])] = -1
        place = np.arange(high - low)
        n = farthest[low:high] - nearest_start[low:high] + 1
        entry = np.repeat(place, n)
        distance = np.repeat(nearest_start[low:high] - np.cumsum(n) + n, n) + np.arange(n.sum())
        run = np.empty(len(entry), np.int64)
        by = np.argsort(distance, kind="stable")
        cuts = np.searchsorted(distance[by], np.arange(REACH + 2))
        for d in range(REACH + 1):
            mine = by[cuts[d] : cuts[d + 1]]
            if len(mine):
                run[mine] = np.maximum.accumulate(np.where(shared < REACH - d, place, 0))[entry[mine]]
        stop = ends[low:high][entry]
        beside = hashes.of(stop - distance, stop)
        order = np.lexsort((rank[low:high][entry], beside, run, distance))
        again = ~_starts(distance[order], run[order], beside[order])
        out_entry.append(low + entry[order][again])
        out_distance.append(distance[order][again])
    return np.concatenate(out_entry), np.concatenate(out_distance)


def merge_runs(table: pa.Table) -> pa.Table:
    """Step 3, in a bucket of cores: merge the runs, mark what repeats, and send every group its spans."""
    kinds = table.column("kind").to_pylist()
    owners = table.column("r").to_pylist()
    blobs = table.column("entries").to_pylist()
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # group, document, start, end
    for kind, r, blob in zip(kinds, owners, blobs, strict=True):
        if kind == 0:
            text, start, end = (x.astype(np.int64) for x in unpacked(blob))
            spans.append((np.full(len(text), r), text, start, end))

    sent = [(r, unpacked(blob)) for kind, r, blob in zip(kinds, owners, blobs, strict=True) if kind == 2]
    if sent:
        group = np.repeat([r for r, _ in sent], [len(s[0]) for _, s in sent])
        string, core, high, low, start, text = (np.concatenate(c) for c in zip(*(s for _, s in sent), strict=True))
        order = np.lexsort((start, low, high, core, string))
        again = order[~_starts(string[order], core[order])]
        start = start[again].astype(np.int64)
        spans.append((group[again], text[again].astype(np.int64), start, start + SPAN))

    sent = [(r, unpacked(blob)) for kind, r, blob in zip(kinds, owners, blobs, strict=True) if kind == 1]
    if sent:
        runs = []
        for _, (core, shared, sizes, rests, *_rest) in sent:
            same = np.zeros(len(core), np.int64)
            same[1:] = core[1:] == core[:-1]
            runs.append((core.tolist(), spelled(shared, sizes, rests), np.where(same, shared.astype(np.int64) + 1, 0).tolist()))
        out_run, out_at, prefix = merged(runs)
        begin = np.concatenate([[0], np.cumsum([len(x[0]) for x in runs])])
        order = begin[np.array(out_run)] + np.array(out_at)
        rights = np.array([len(x) for _, s, _ in runs for x in s], np.int64)[order]
        core, left_size, high, low, anchor, text = (np.concatenate([s[i] for _, s in sent]) for i in (0, 4, 6, 7, 8, 9))
        left_bytes = np.concatenate([s[5] for _, s in sent])
        group = np.repeat([r for r, _ in sent], [len(s[0]) for _, s in sent])
        left_end = np.cumsum(left_size.astype(np.int64))
        size = left_size.astype(np.int64)[order]
        upto = np.cumsum(size)
        left = left_bytes[np.repeat(left_end[order] - upto, size) + np.arange(size.sum())]
        core, high, low, group = core[order], high[order], low[order], group[order]
        anchor, text = anchor[order].astype(np.int64), text[order].astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((anchor, low, high))] = np.arange(len(order))
        entry, distance = marked(core, np.array(prefix, np.int64), rights, size, left, rank)
        start = anchor[entry] - distance
        spans.append((group[entry], text[entry], start, start + SPAN))

    rows = []
    if spans:
        group, text, start, end = (np.concatenate(c) for c in zip(*spans, strict=True))
        order = np.argsort(group, kind="stable")
        group, text, start, end = group[order], text[order], start[order], end[order]
        for r, a, b in _cuts(group):
            rows.append((r, packed(*(x.astype(np.uint32) for x in _joined_spans(text[a:b], start[a:b], end[a:b])))))
    return _rows(rows, ["r", "spans"], [pa.int32(), pa.binary()])


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_spans(table: pa.Table, spans: pa.Table, with_text: bool) -> pa.Table:
    """Step 4: what is left of every row of a group."""
    names = [x.split()[0] for x in REMOVED.split(", ")] + ["kept"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
    if not table.num_rows:
        return _rows([], names, types)
    group = Group(table)
    told = [unpacked(b) for b in spans.column("spans").to_pylist()]
    removed: dict[int, list[tuple[int, int]]] = {}
    if told:
        text, start, end = _joined_spans(*(np.concatenate(c).astype(np.int64) for c in zip(*told, strict=True)))
        for k, a, b in zip(text.tolist(), start.tolist(), end.tolist(), strict=True):
            removed.setdefault(k, []).append((a, b))
    results = []
    for k in range(len(group.rows)):
        body = group.text(k).tobytes()
        gone = removed.get(k, [])
        at, parts = 0, []
        for a, b in gone:
            parts.append(body[at:a])
            at = b
        kept = b"".join([*parts, body[at:]])
        own = (len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
        results.append((*own, kept.decode("utf-8", "replace")) if with_text else own)
    ids = table.column("doc_id").to_pylist()
    return _rows([(d, *results[k]) for d, k in zip(ids, group.of_row.tolist(), strict=True)], names, types)


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; ``with_text`` adds what is kept, as text.

    Removed is each byte of the UTF-8 text that lies in a SPAN-byte string which also starts earlier: in a document with a
    smaller doc_id, or earlier in the same one. Null doc_ids come last, in the order of text hashes, and so do different texts
    under one doc_id; rows equal in doc_id and text are one document and get equal results. A null text is empty. Bytes may be
    cut inside a character; ``with_text`` then shows a replacement character. Other columns are ignored.

    One exchange of the texts serves all steps; what else is exchanged is sorted, stripped of copies within a group and packed.
    """
    n = 2 * partitions(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text)).withColumn("tie", F.xxhash64("text"))
    dealt = base.withColumn("r", F.pmod(F.when(F.col("doc_id").isNull(), F.col("tie")).otherwise(F.xxhash64("doc_id")), F.lit(n)).cast("int"))
    cores = dealt.groupBy("r").applyInArrow(lambda t: send_cores(t, n), "bucket int, r int, entries binary")
    replies = cores.groupBy("bucket").applyInArrow(lambda t: judge_cores(t, crowd), "r int, replies binary")
    suffixes = dealt.groupBy("r").cogroup(replies.groupBy("r")).applyInArrow(
        lambda t, told: send_suffixes(t, told, n), "bucket int, r int, kind int, entries binary",
    )
    spans = suffixes.groupBy("bucket").applyInArrow(merge_runs, "r int, spans binary")
    return dealt.groupBy("r").cogroup(spans.groupBy("r")).applyInArrow(
        lambda t, told: remove_spans(t, told, with_text), REMOVED + ", kept string" * with_text,
    )
