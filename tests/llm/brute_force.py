"""Brute-force versions that tests compare with."""


def brute_components(rows, percent=75):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def brute_passages(rows):
    """Texts without the maximal common runs of several lines or over 50 words that stand earlier."""
    docs = [(d, t.split("\n")) for d, t in sorted(rows) if t is not None]
    gone = {d: set() for d, _ in docs}
    for x, (d, own) in enumerate(docs):
        for y, (_, other) in enumerate(docs[: x + 1]):
            for shift in range(1 - len(other), len(own)):
                if y == x and shift < 1:
                    continue
                run = []
                for i in range(len(own) + 1):
                    if i < len(own) and 0 <= i - shift < len(other) and own[i] == other[i - shift]:
                        run.append(i)
                        continue
                    several = len(run) > 1 and any(own[k].strip() for k in run)
                    if several or sum(len(own[k].split()) for k in run) > 50:
                        gone[d].update(run)
                    run = []
    return {d: ("\n".join(line for i, line in enumerate(own) if i not in gone[d]), len(gone[d])) for d, own in docs}


def brute_runs(words):
    """``(start, length, period)`` of all runs of six words and four periods or more, period by period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if len(run) >= max(6, 4 * q) and not any(run[d:] == run[: len(run) - d] for d in range(1, q)):
                out.append((i, len(run), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))
