"""What the contracts say, by plain loops over small tables."""

import base64
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def contaminated(docs, items, window=10):
    of = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            of.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, named = WORD.findall((text or "").translate(LOW)), set(), set()
        for n in {len(k) for k in of}:
            for k in range(len(w) - n + 1):
                if (t := tuple(w[k : k + n])) in of:
                    hit.update(range(k, k + n))
                    named |= of[t]
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


def simhash(text, k=4):
    w = RUN.findall((text or "").translate(LOW))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def joined(n, pairs):
    """The smallest number of each number's component."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def components(fps, bits=4):
    """The position of the first of each fingerprint's component."""
    f = np.array(fps, dtype=np.uint64)
    return joined(len(f), [(i, i + 1 + int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= bits)])


def near_copies(texts):
    """Pairs of texts with a similarity of 0.8 or more, by comparing all that share a shingle."""
    sets, at, out = [shingles(t) for t in texts], {}, []
    for i, s in enumerate(sets):
        for j in {j for x in s for j in at.get(x, ())}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                out.append((j, i))
        for x in s:
            at.setdefault(x, []).append(i)
    return out


def site_shifts(sites):
    """(host, path, n, bad) to what each path's posterior rate adds to the log odds over all."""
    logit = lambda p: math.log(p / (1 - p))

    def strength(rows):  # (n, rate, prior)
        rows = [r for r in rows if r[0] > 1]
        between, chance, whole = sum(n * (r - p) ** 2 for n, r, p in rows), sum(p * (1 - p) for _, _, p in rows), sum(n * p * (1 - p) for n, _, p in rows)
        if not whole or between <= chance:
            return 1e6
        return max(1.0, (whole - between) / (between - chance)) if whole > between else 1.0

    overall = (sum(s[3] for s in sites) + 0.5) / (sum(s[2] for s in sites) + 1.0)
    hosts = {}
    for h, _, n, bad in sites:
        a, b = hosts.get(h, (0, 0.0))
        hosts[h] = a + n, b + bad
    k = strength([(n, b / n, overall) for n, b in hosts.values()])
    rate = {h: (b + k * overall) / (n + k) for h, (n, b) in hosts.items()}
    k = strength([(n, b / n, rate[h]) for h, _, n, b in sites])
    return {(h, p): logit((b + k * rate[h]) / (n + k)) - logit(overall) for h, p, n, b in sites}


def sha1_base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def places(calls):
    """(turn, call, references) of a conversation to place, depth and cyclic of each call, by following all ways."""
    turn, refs = {c: t for t, c, _ in calls}, {c: [r for r in rs if r in {x[1] for x in calls}] for _, c, rs in calls}

    def reach(c, found):
        for r in refs[c]:
            if r not in found:
                found.add(r)
                reach(r, found)
        return found

    reached = {c: reach(c, set()) for c in refs}
    place = {c: max([turn[c], *(turn[r] for r in reached[c])]) for c in refs}
    raised = {c for c in refs if any(turn[r] >= turn[c] for r in reached[c])}

    def waits(c, seen=()):  # in a cycle, or behind one of the same place
        return c in seen or any(place[r] >= turn[c] and waits(r, (*seen, c)) for r in refs[c])

    def depth(c):
        return max((1 + depth(r) if r in raised else 1 for r in refs[c] if place[r] == place[c]), default=0)

    out = {}
    for c in refs:
        cyclic = c in raised and waits(c)
        out[c] = (place[c] if c in raised else turn[c], 0 if cyclic or c not in raised else depth(c), cyclic)
    return out


def phrases(text):
    """The phrases of Ziv and Lempel's parse of 1978, a character at a time."""
    found, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in found:
            found.add(phrase)
            phrase = ""
    return found


def descending(docs):
    """By id, nulls last; rows of one id as they come."""
    return sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))


def damage(turns):
    """(conv_id, turn, role, text) in the order of the file, to the rows after damage and all ids."""
    out, said = [], lambda x: " " if x is None else str(x)
    for conv, turn, role, text in turns:
        role, text, fault = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out, {t[0] for t in turns}


def repair(turns, ids):
    """What each conversation's turns are, and its cheapest edits, by trying all that a turn allows."""
    out = []
    for conv in ids:
        rows = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        seen, marks, n = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            left = [c for c in text if c not in " \t\n\x0b\x0c\r"]
            mark = 0 if not left else 1 if (role, text) in seen else 2 if left[-1] not in ".!?" else None
            seen.add((role, text))
            marks.append(mark)
            if mark is not None:
                n[mark] += 1

        @functools.cache
        def best(i, state, made=0):
            """The cheapest (cost, letters, lines) from row i on; state: what has been said, of '', s, u, a."""
            can = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            want = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[want]
            if made < 2:
                c, e, lines = best(i, want, made + 1)
                can.append((c + 5, "I" + e, (f"{name}:", *lines)))
            if i < len(rows):
                _, _, role, text = rows[i]
                c, e, lines = best(i + 1, state)
                can.append((c + 2, "D" + e, lines))
                if marks[i] not in (0, 1):
                    more = 5 * (marks[i] == 2)
                    if role[:1] == want or state == "" and role[:1] == "s":
                        c, e, lines = best(i + 1, role[:1])
                        can.append((c + more, "K" + e, (f"{role}:{text}", *lines)))
                    c, e, lines = best(i + 1, want)
                    can.append((c + more + 1, "R" + e, (f"{name}:{text}", *lines)))
            return min(can, default=(10**9, "", ()))

        cost, audit, lines = best(0, "")
        first = [r[2][:1] for r in rows]
        turn = [t for _, t, _, _ in rows if t is not None]
        gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
        out.append((conv, gaps, *n, sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def shingles(text, k=5):
    w = (text or "").translate(LOW).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
