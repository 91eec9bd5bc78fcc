"""Plain sequential versions of the ordered rules, written row by row for checking."""

from collections import Counter


def throttle(times, interval):
    passed, last = [], None
    for t in times:
        ok = t is not None and (last is None or t - last >= interval)
        passed.append(ok)
        if ok:
            last = t
    return passed


def averages(vectors, alpha):
    out, mean = [], None
    for p in vectors:
        mean = list(p) if mean is None else [alpha * x + (1 - alpha) * m for x, m in zip(p, mean)]
        out.append(mean)
    return out


def votes(labels, size):
    out = []
    for i in range(len(labels)):
        window = labels[max(0, i - size + 1) : i + 1]
        counts = Counter(window)
        most = max(counts.values())
        out.append(next(label for label in reversed(window) if counts[label] == most))
    return out


def switch(offers, least, confirm):
    stable = score = pending = None
    n, out = 0, []
    for label, value in offers:
        if stable is None:
            stable, score = label, value
        elif label == stable:
            score, pending, n = value, None, 0
        elif value >= least:
            if label != pending:
                pending, n = label, 1
            else:
                n += 1
            if n >= confirm:
                stable, score, pending, n = label, value, None, 0
        out.append((stable, score))
    return out


def iou(a, b):
    left, top = max(a[0], b[0]), max(a[1], b[1])
    right, bottom = min(a[0] + a[2], b[0] + b[2]), min(a[1] + a[3], b[1] + b[3])
    shared = max(0, right - left) * max(0, bottom - top)
    union = a[2] * a[3] + b[2] * b[3] - shared
    return shared / union if union > 0 else 0.0


def tracks(frames, ttl, least):
    """``frames``: list of (time, boxes) in order; returns track numbers per frame."""
    live, following, out = {}, 1, []
    for now, boxes in frames:
        live = {k: v for k, v in live.items() if now - v[1] <= ttl}
        given, numbers = {}, []
        for box in boxes:
            best, found = 0.0, None
            for number in sorted(live):
                if number not in given and iou(box, live[number][0]) > best:
                    best, found = iou(box, live[number][0]), number
            if found is None or best < least:
                found, following = following, following + 1
            given[found] = box
            numbers.append(found)
        live.update({number: (box, now) for number, box in given.items()})
        out.append(numbers)
    return out
