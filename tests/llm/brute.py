"""Plain Python versions of whole results, written apart from the operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def key_of(text):
    """The engine's 64-bit hash of a text; null hashes to the seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def sharded(rows, shards=8, ranges=64, heavy_part=16):
    """{row number: (size, crc, shard, slot)} of rows (doc_id, text), fewer than the sampled keys; no range is subdivided in another order."""
    size = [len((t or "").encode()) + 1 for _, t in rows]
    keys = [key_of(t) for _, t in rows]
    total = sum(size)
    most = max(1, min(500_000, len(rows) // 256))
    count, held = Counter(keys), Counter()
    for k, s in zip(keys, size):
        held[k] += s
    heavy = sorted((k for k in held if count[k] > most or held[k] > max(1, total // (ranges * heavy_part))), key=lambda k: (-held[k], k))
    target = -(-total // shards)
    load, spans = [0] * shards, {}
    for k in heavy:
        spans[k], at = [], 0
        while at < held[k]:
            shard = load.index(min(load))
            rest, room = held[k] - at, target - load[shard]
            take = rest if held[k] <= target or rest <= room else max(1, room)
            at += take
            load[shard] += take
            spans[k].append((at, shard))
    cold = total - sum(held[k] for k in heavy)
    rooms = [max(0, target - x) for x in load]
    line = [(sum(rooms[: s + 1]) * cold // max(1, sum(rooms)), s) for s in range(shards)]
    line[-1] = (cold, shards - 1)
    order = sorted((n for n in range(len(rows)) if keys[n] not in spans), key=lambda n: (keys[n], rows[n][0] is not None, rows[n][0] or 0, size[n]))
    shard, at, group, begin = {}, 0, None, 0
    for n in order:
        if keys[n] != group:
            group, begin = keys[n], at
        shard[n] = next((s for end, s in line if begin < end), shards - 1)
        at += size[n]
    return size, keys, shard, spans, held, most


def mixed(rows, weights=(3, 1, 2), blocks=65_536, few=64, shards=8):
    """Per row (doc_id, text, source): size, source size, target, taken, shard; word by word."""
    size = [len(space_words(t)) for _, t, _ in rows]
    whole = defaultdict(int)
    for (_, _, source), n in zip(rows, size):
        whole[source] += n
    names = sorted(s for s in whole if s is not None) + [None] * (None in whole)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(whole.values()), list(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * whole[s]]
        for s in over or free:
            target[s] = 2.0 * whole[s] if over else level * weight[s]
            left -= 2 * whole[s] if over else 0
        free = [s for s in free if s not in target]
    block = max(1, int(sum(target.values()) // blocks))
    unit = {s: 1 if block > 1 and target[s] < few * block else block for s in names}
    seated = [s for s in names if unit[s] == block]
    seats = int(sum(target[s] for s in seated) / block + 0.5)
    held = dict.fromkeys(names, 0)
    quota = {s: [0] * shards for s in names}
    for seat in range(seats):
        best = max((s for s in seated if target[s] > 0), key=lambda s: (target[s] / (2 * held[s] + 1), -names.index(s)))
        held[best] += 1
        quota[best][seat * shards // seats] += 1
    number = lambda text: int(hashlib.md5(f"17:{text}".encode()).hexdigest()[:15], 16)
    taken, first = Counter(), {}
    for s in names:
        words = min(held[s] * unit[s] if unit[s] == block else int(target[s] + 0.5), 2 * whole[s])
        ends = [sum(quota[s][: k + 1]) * unit[s] if unit[s] == block else words * (k + 1) // shards for k in range(shards)]
        name = lambda n: rows[n][0] if rows[n][0] is not None else hashlib.md5((rows[n][1] or "").encode()).hexdigest()
        own = sorted((n for n in range(len(rows)) if rows[n][2] == s), key=lambda n: (number(name(n)), rows[n][0] is not None, rows[n][0] or 0, size[n]))
        line = [n for n in own for _ in range(size[n])]
        start = number(s or "") % whole[s] // unit[s] * unit[s] if whole[s] else 0
        for j in range(words):
            n = line[(start + j) % len(line)]
            taken[n] += 1
            first.setdefault(n, sum(e <= j for e in ends))
    return [(rows[n][0], size[n], whole[rows[n][2]], target[rows[n][2]], taken[n], first.get(n)) for n in range(len(rows))]


def near_groups(texts, words=5, like=80):
    """Group number of every text: sets of shingles that share so much are one group."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append(frozenset(" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= like * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return group


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contaminated(text, items, window=13):
    words, hit = bench_words(text), set()
    for body in items:
        own = bench_words(body)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[k : k + n]:
                    hit.update(range(j, j + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def crc(text):
    return zlib.crc32((text or "").encode())
