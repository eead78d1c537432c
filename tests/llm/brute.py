"""Plain versions of the contracts, for small inputs."""

import hashlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return text.encode().split()


def shingles(text, width):
    own = words(text.translate(LOWER))
    if not own:
        return set()
    return {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))}


def components(texts, width, num, den):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    head = {i: i for i in texts}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def stripped(texts, window=50):
    first = {}
    split = {i: words(t) for i, t in texts.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    out = {}
    for i, own in split.items():
        gone = set()
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (own, gone, b" ".join(w for k, w in enumerate(own) if k not in gone))
    return out


def exact(texts):
    norm = {i: t.translate(LOWER) for i, t in texts.items()}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (max(groups[t]), len(groups[t]), max(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def check_packing(rows, ids, capacity=1024):
    """Every id in one piece, sequences gapless; returns the padding."""
    import zlib

    import numpy as np

    cover, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert cover.keys() == ids.keys()
    for i, own in cover.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids[i])
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding
