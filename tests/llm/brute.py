"""Plain single-process versions of the operators' contracts, written from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

WS = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(key, n: int) -> int:
    return zlib.crc32(str(key).encode()) % n


def shingle_set(text, width=5):
    w = WS.findall((text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near(docs, percent=85):
    """doc_id -> (n_shingles, component_id, kept); candidates by an inverted index, so all links are found."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for d in sorted(sets):
        shared = defaultdict(int)
        for s in sets[d]:
            for o in index[s]:
                shared[o] += 1
            index[s].append(d)
        for o, both in shared.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[o]) - both):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def substrings(docs, window=50):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    words = {d: WS.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def contamination(docs, items, width=10):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = defaultdict(set)
    for i, t in items:
        w = BENCH.findall((t or "").translate(LOW))
        for s in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[s : s + width])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = BENCH.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def lines(docs, ratio=0.1, least=2):
    """(doc_id, text) of rows (doc_id, source, text) without the lines that stand on too many pages of their source."""
    pages, on = defaultdict(int), defaultdict(set)
    for i, (_, source, text) in enumerate(docs):
        pages[source] += 1
        for line in (text or "").split("\n"):
            if line.strip(" "):
                on[source, line.strip(" ")].add(i)
    bad = {k for k, rows in on.items() if len(rows) >= least and len(rows) > ratio * pages[k[0]]}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad)) for d, s, t in docs]


def payload(text):
    """n_bytes, payload, and the 8-bit WAV file by the standard library."""
    import io
    import wave

    raw = (text or "").encode()
    whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(8000)
        f.writeframes(whole)
    return len(raw), whole, out.getvalue()


def chat(rows):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256) of rows (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn, role, text))
    out = {}
    for conv, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is None, t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out
