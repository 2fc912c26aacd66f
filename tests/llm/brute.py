"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def strings(docs: list[tuple[int, bytes]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """op10: each byte covered by a string of ``length`` bytes that starts earlier too."""
    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(docs):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = (len(text), sum(gone), spans, sha(bytes(x for x, g in zip(text, gone, strict=True) if not g)))
    return out


def lines(docs: list[tuple[int, str]], window: int = 3) -> dict[int, tuple[int, int, int, str]]:
    """op5: windows of consecutive lines that occurred before."""
    seen: set[tuple[str, ...]] = set()
    out = {}
    for key, text in sorted(docs):
        ls = text.split("\n")
        gone = [False] * len(ls)
        for i in range(len(ls) - window + 1):
            w = tuple(ls[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = (len(ls), sum(gone), spans, sha("\n".join(x for x, g in zip(ls, gone, strict=True) if not g).encode()))
    return out


def chunks(docs: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, int, str]]:
    """op2: each text chunked by itself, byte by byte; later chunks go in runs of 64 bytes or whole texts."""
    from millrace.llm._kernel import byte_values
    from millrace.llm.substring_dedup import LEAST, MEAN_BITS, MIN_RUN, MOST

    values = [int(v) & 0xFFFFFFFF for v in byte_values(7)]

    def cut(text: bytes) -> list[tuple[int, int]]:
        h, ends, last = 0, [], 0
        for i, c in enumerate(text, 1):
            h = ((h << 1) + values[c]) & 0xFFFFFFFF
            if h >> (32 - MEAN_BITS) == 0 and i < len(text):
                if i - last >= LEAST:
                    ends.append(i)
                last = i
        out, at = [], 0
        for end in [*ends, len(text)]:
            out += [(x, min(x + MOST, end)) for x in range(at, end, MOST)]
            at = end
        return out

    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(docs):
        gone: list[list[int]] = []
        for a, b in cut(text):
            if text[a:b] in seen:
                if gone and gone[-1][1] == a:
                    gone[-1][1] = b
                else:
                    gone.append([a, b])
            seen.add(text[a:b])
        gone = [g for g in gone if g[1] - g[0] >= MIN_RUN or g == [0, len(text)]]
        edges = [0, *(x for g in gone for x in g), len(text)]
        kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
        out[key] = (len(text), len(text) - len(kept), len(gone), sha(kept))
    return out


def near_classes(docs: list[tuple[int, str | None]], similarity: float = 0.8) -> dict[int, int]:
    """op8: components of all pairs with a weighted Jaccard similarity of five-word shingles of at least 0.8."""
    import re
    from collections import Counter

    word = re.compile(rb"[a-z0-9\x80-\xff]+")

    def shingles(text):
        w = word.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        if len(w) < 5:
            return Counter([tuple(w)]) if w else Counter()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets = {k: shingles(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if both and both / either >= similarity:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def distance(item: str, text: str) -> int:
    """The least edits between an item and any substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)
