"""Personal data: fixed patterns with checks, and a character model that adds what the patterns' form does not cover.

The model is a bidirectional long short-term memory over characters with a conditional random field on top, trained in numpy
on spans that the patterns label, as they stand and rewritten: spaced out, spelt out, with other separators, without a
leading plus.  Overlapping windows are decoded and reconciled over the whole text.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.llm.common import hash60

#: Kinds in the order of results, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = r"(?: ?@ ?| ?(?:\[ ?at ?\]|\( ?at ?\)) ?| at )"
_DOT = r"(?: ?\. ?| ?(?:\[ ?(?:dot|\.) ?\]|\( ?(?:dot|\.) ?\)) ?| dot )"
_TRIGGER = re.compile(r"[0-9@]|\bdot\b|[\[(] ?at ?[\])]", re.IGNORECASE)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

TAGS = 1 + 2 * len(KINDS)  # outside, then first and further character of each kind
HIDDEN = 24
WINDOW, STRIDE = 96, 48
SAMPLE_DOCS = 250
CONFIDENCE = 0.95
PRECISION = 0.95
WINDOWS = 20


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    """Whether a matched text passes the check of its kind."""
    if kind == "ip":
        parts = [p.lstrip("0") for p in text.split(".")]
        return all(len(p) < 4 and int(p or 0) <= 255 for p in parts)
    if kind == "card":
        d = _digits(text)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(text)) <= 15
    return True


def _emails(text: str):
    """Leftmost matches of the address pattern, found from each ``@`` so that long words cost no more than others."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def matches(text: str):
    """Every match of the patterns, passing or not, as (kind, start, end)."""
    if not re.search("[0-9@]", text):
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return found


def base_spans(text: str):
    return [s for s in matches(text) if valid(s[0], text[s[1] : s[2]])]


def codes(text: str) -> np.ndarray:
    """Characters as numbers below 130: plain ones as they are, other letters 128, others 129."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(points, 129).astype(np.uint8)
    for i in np.flatnonzero(points > 127):
        out[i] = 128 if text[i].isalpha() else 129
    return out


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Lstm:
    """A long short-term memory layer over characters; a character selects a row of ``w``."""

    def __init__(self, rng, hidden):
        self.h = hidden
        self.w = rng.normal(0, 0.3, (130, 4 * hidden)).astype(np.float32)
        self.w[:, hidden : 2 * hidden] += 1
        self.u = rng.normal(0, 0.3, (hidden, 4 * hidden)).astype(np.float32)

    def run(self, x):
        steps, n = x.shape
        k, h, c = self.h, np.zeros((n, self.h), np.float32), np.zeros((n, self.h), np.float32)
        out, memory = np.empty((steps, n, k), np.float32), []
        for t in range(steps):
            a = self.w[x[t]] + h @ self.u
            gates, g = _sigmoid(a[:, : 3 * k]), np.tanh(a[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            new = f * c + i * g
            th = np.tanh(new)
            memory.append((h, c, i, f, o, g, th))
            c, h = new, o * th
            out[t] = h
        return out, memory

    def back(self, x, memory, d_out):
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, th = memory[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - th * th)
            da = np.concatenate(
                [dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1
            )
            np.add.at(dw, x[t], da)
            du += h.T @ da
            dh, dc = da @ self.u.T, dc * f
        return dw, du


def _sum_exp(a, axis):
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Two layers, emission scores, and transitions between neighbouring tags."""

    def __init__(self, hidden=HIDDEN, seed=3):
        rng = np.random.default_rng(seed)
        self.ahead, self.behind = Lstm(rng, hidden), Lstm(rng, hidden)
        self.v = rng.normal(0, 0.3, (2 * hidden, TAGS)).astype(np.float32)
        self.b = np.zeros(TAGS, np.float32)
        self.t = rng.normal(0, 0.1, (TAGS, TAGS)).astype(np.float32)
        self.gates = dict.fromkeys(KINDS, CONFIDENCE)

    def _emit(self, x):
        f, fm = self.ahead.run(x)
        r, rm = self.behind.run(x[::-1])
        h = np.concatenate([f, r[::-1]], 2)
        return h, h @ self.v + self.b, fm, rm

    def _chain(self, e):
        """Log sums over all tag sequences up to and from each step."""
        to, on = np.empty_like(e), np.zeros_like(e)
        to[0] = e[0]
        for s in range(1, len(e)):
            to[s] = e[s] + _sum_exp(to[s - 1][:, :, None] + self.t, 1)
        for s in range(len(e) - 2, -1, -1):
            on[s] = _sum_exp(self.t + (e[s + 1] + on[s + 1])[:, None, :], 2)
        return to, on, _sum_exp(to[-1], 1)

    def gradients(self, x, y):
        """Gradient of the mean negative log likelihood of tags ``y`` (steps, windows)."""
        steps, n = x.shape
        h, e, fm, rm = self._emit(x)
        to, on, z = self._chain(e)
        d = np.exp(to + on - z[None, :, None])
        dt = np.zeros_like(self.t)
        for s in range(steps - 1):
            pair = to[s][:, :, None] + self.t + (e[s + 1] + on[s + 1])[:, None, :] - z[:, None, None]
            dt += np.exp(pair).sum(0)
            np.add.at(dt, (y[s], y[s + 1]), -1)
        rows = np.arange(n)
        for s in range(steps):
            d[s, rows, y[s]] -= 1
        d /= n
        k = self.ahead.h
        dh = d @ self.v.T
        return [
            *self.ahead.back(x, fm, dh[:, :, :k]),
            *self.behind.back(x[::-1], rm, dh[::-1, :, k:]),
            np.tensordot(h, d, ((0, 1), (0, 1))),
            d.sum((0, 1)),
            dt / n,
        ]

    def fit(self, x, y, epochs=14, batch=48, rate=0.015, seed=9):
        """``x``, ``y``: characters and tags (windows, steps).  Adam, with steps that shrink to none."""
        rng = np.random.default_rng(seed)
        params = [self.ahead.w, self.ahead.u, self.behind.w, self.behind.u, self.v, self.b, self.t]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                step += 1
                grads = self.gradients(np.ascontiguousarray(x[rows].T), np.ascontiguousarray(y[rows].T))
                for p, g, m, s in zip(params, grads, first, second, strict=True):
                    g = np.clip(g, -1, 1)
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def decode(self, x):
        """Best tags of each window (steps, windows), and the probability of each."""
        _, e, _, _ = self._emit(x)
        to, on, z = self._chain(e)
        best, via = e[0], []
        for s in range(1, len(e)):
            scores = best[:, :, None] + self.t
            via.append(scores.argmax(1))
            best = scores.max(1) + e[s]
        tags = np.empty(x.shape, np.int64)
        tags[-1] = best.argmax(1)
        rows = np.arange(x.shape[1])
        for s in range(len(e) - 2, -1, -1):
            tags[s] = via[s][rows, tags[s + 1]]
        p = np.exp(to + on - z[None, :, None])
        return tags, np.take_along_axis(p, tags[:, :, None], 2)[:, :, 0]


def tags_of(text: str) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for kind, a, b in base_spans(text):
        k = 1 + 2 * KINDS.index(kind)
        out[a:b], out[a] = k + 1, k
    return out


def _places(text: str):
    """Starts of the overlapping windows that hold a digit, ``@``, "dot" or "at" in brackets.  Every form of a kind needs
    one of these, other windows need not be read."""
    starts = set()
    for m in _TRIGGER.finditer(text):
        last = m.start() // STRIDE
        starts.update((max(0, last - 1) * STRIDE, last * STRIDE))
    return sorted(starts)


def _plain(kind: str, text: str) -> str:
    """A written-out or spaced form brought back to the usual one."""
    if kind == "email":
        text = re.sub(_AT, "@", text, count=1, flags=re.IGNORECASE)
    if kind in ("email", "ip"):
        text = re.sub(_DOT, ".", text, flags=re.IGNORECASE)
    return text


def _shape_ok(kind: str, text: str) -> bool:
    """The check of a kind for what the model finds, whatever the separators."""
    plain = _plain(kind, text)
    if kind == "email":
        local, _, domain = plain.partition("@")
        bare = re.search(" at ", text, re.IGNORECASE) and "@" not in text
        if bare and not re.search(r"\bdot\b|[\[(] ?\.", text, re.IGNORECASE):
            return False  # "look at example.org" is no address
        return bool(_LOCAL.match(local) and _DOMAIN.fullmatch(domain))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", plain)) and valid("ip", plain)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,3}[0-9])+", text)) and valid("card", text)
    # several groups of digits that are no date or decimal number
    return (
        bool(re.fullmatch(r"\(?[0-9][0-9 ().+/-]*[0-9]", text))
        and valid("phone", text)
        and len(re.findall("[0-9]+", text)) >= 3
        and not re.search(r"\b(19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}\b|\b[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](19|20)[0-9]{2}\b", text)
    )


def _other(kind: str, text: str, rng: random.Random) -> str:
    """A span of the same kind with names and numbers drawn anew."""
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "phone":
        return "+" + "".join(rng.choice("0123456789") for _ in range(rng.choice([9, 10, 11, 12])))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    local = rng.choice([name(), f"{name()}.{name()}", f"{name()}{rng.randrange(100)}"])
    return f"{local}@{name()}.{rng.choice(['com', 'org', 'net', 'edu', 'de', 'io', 'co.uk'])}"


def rewritten(kind: str, text: str, rng: random.Random) -> str:
    """Another way to write a span that a pattern has found, half of the time with other names and numbers in it."""
    if kind != "card" and rng.random() < 0.5:
        text = _other(kind, text, rng)
    if kind == "email":
        at = rng.choice([" at ", " AT ", " [at] ", "[at]", " (at) ", "(at)", " @ "])
        dot = rng.choice([" dot ", " DOT ", " [dot] ", "[dot]", "(dot)"] if at.strip().lower() == "at" else [" dot ", "[dot]", " (dot) ", ".", " . "])
        return text.replace("@", at).replace(".", dot)
    if kind == "ip":
        return text.replace(".", rng.choice([" . ", " .", ". ", "[.]", "(.)", " dot ", "[dot]"]))
    digits = _digits(text)
    if kind == "card":
        gap = rng.choice([".", "/", "_", "  ", " - ", "--", ". "])
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    gap = rng.choice([" ", "-", ".", "/"])
    last = digits[-7:-4] + gap + digits[-4:]
    area, country = digits[-10:-7], digits[:-10]
    forms = [f"({area}) {last}", f"{area}{gap}{last}", f"0{area}{gap}{last}", f"00{country or 44} {area}{gap}{last}", f"{country or 1}-{area}-{last}"]
    return rng.choice(forms if area else [f"0{last[:2]}{gap}{last[2:]}"])


def lookalike(rng: random.Random) -> str:
    """Something with the characters of personal data that is none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    year, month, day = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29)
    return rng.choice(
        [
            f"{year}-{month:02}-{day:02} {rng.randrange(24):02}:{rng.randrange(60):02}",
            f"{day}.{month}.{year}",
            f"{day}/{month}/{year}",
            f"{year}-{year + 1}",
            f"{d(1)},{d(3)},{d(3)}.{d(2)}",
            f"{d(2)} {d(3)} {d(3)}",
            f"v{d(1)}.{d(2)}.{d(1)}",
            f"{d(1)} . {d(1)} . {d(2)}",
            f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            f"{d(4)} {d(4)}",
            f"#{d(rng.randrange(3, 12))}",
            f"{d(2)} x {d(3)} x {d(2)}",
            f"@{rng.choice(['home', 'noon', 'media'])} {d(2)}",
            rng.choice(["at the dot on the map", "look at a dot", "the dot com boom", "a red dot at the top", "(at) noon"]),
        ]
    )


def varied(text: str, seed: int):
    """``text`` with its spans rewritten, kept, or replaced by lookalikes, and the tags of the result."""
    rng = random.Random(seed)
    parts, tags, last = [], [], 0
    taken = 0
    for kind, a, b in sorted(base_spans(text), key=lambda s: s[1]):
        if a < taken:  # inside the span before
            continue
        taken = b
        parts.append(text[last:a])
        tags.append(np.zeros(a - last, np.int64))
        draw = rng.random()
        new = text[a:b] if draw < 0.2 else rewritten(kind, text[a:b], rng) if draw < 0.8 else lookalike(rng)
        tag = np.zeros(len(new), np.int64)
        if draw < 0.2 or draw < 0.8 and _shape_ok(kind, new):
            tag[:] = 2 + 2 * KINDS.index(kind)
            tag[0] -= 1
        parts.append(new)
        tags.append(tag)
        last = b
    parts.append(text[last:])
    tags.append(np.zeros(len(text) - last, np.int64))
    return "".join(parts), np.concatenate(tags)


def _whole_words(text: str, a: int, b: int):
    """A run without marks at its ends, and with the rest of the words it begins and ends in, up to a window on each side."""
    while a < b and text[a] in " .,;:":
        a += 1
    while b > a and text[b - 1] in " .,;:":
        b -= 1
    low, high = a - WINDOW, b + WINDOW
    while max(0, low) < a < b and text[a].isalnum() and text[a - 1].isalnum():
        a -= 1
    while a < b < min(len(text), high) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    return a, b


def model_spans(texts: list[str], tagger: Tagger, confidence: float | None = None):
    """Spans of the model for each text, at the tagger's own gates unless ``confidence`` is given."""
    gate = lambda kind: tagger.gates[kind] if confidence is None else confidence
    return [[(k, a, b) for k, a, b, p in found if p >= gate(k)] for found in _scored_spans(texts, tagger)]


def _scored_spans(texts: list[str], tagger: Tagger):
    """Spans with the mean probability of their tags.  Of overlapping windows each character is read from the one it is
    most inside of; runs of a kind are then joined over the whole text."""
    jobs = [(i, a) for i, text in enumerate(texts) for a in _places(text)]
    found = [[] for _ in texts]
    known = {i: codes(texts[i]) for i, _ in jobs}
    held: dict = {}
    for block in range(0, len(jobs), 1024):
        part = jobs[block : block + 1024]
        x = np.full((WINDOW, len(part)), 32, np.uint8)
        for j, (i, a) in enumerate(part):
            piece = known[i][a : a + WINDOW]
            x[: len(piece), j] = piece
        tags, p = tagger.decode(x)
        for j, (i, a) in enumerate(part):
            for s in np.flatnonzero(tags[:, j]).tolist():
                depth = min(s if a else WINDOW, WINDOW - 1 - s if a + WINDOW < len(texts[i]) else WINDOW)
                at = held.setdefault(i, {})
                if a + s < len(texts[i]) and depth > at.get(a + s, (-1,))[0]:
                    at[a + s] = (depth, int(tags[s, j]), float(p[s, j]))
            if i in held:  # a deeper window may say "outside"
                for at in [at for at in held[i] if a <= at < a + WINDOW and not tags[at - a, j]]:
                    s = at - a
                    depth = min(s if a else WINDOW, WINDOW - 1 - s if a + WINDOW < len(texts[i]) else WINDOW)
                    if depth > held[i][at][0]:
                        del held[i][at]
    for i, at in held.items():
        run: list = []
        for place in [*sorted(at), None]:
            kind = None if place is None else (at[place][1] - 1) // 2
            if run and (place is None or place != run[-1] + 1 or kind != (at[run[-1]][1] - 1) // 2):
                a, b, k = run[0], run[-1] + 1, KINDS[(at[run[0]][1] - 1) // 2]
                a, b = _whole_words(texts[i], a, b)
                while a and texts[i][a - 1] == "(" and ")" in texts[i][a:b] and "(" not in texts[i][a:b]:
                    a -= 1
                if _shape_ok(k, texts[i][a:b]):
                    found[i].append((k, a, b, float(np.mean([at[r][2] for r in run]))))
                run = []
            if place is not None:
                run.append(place)
    return found


def all_spans(texts: list[str], tagger: Tagger | None):
    """(base, all) spans of each text in the order of results.  The model adds spans that touch no passing match of a
    pattern, cut no failing one, and lie in no longer number or word."""
    met = [matches(t) for t in texts]
    more = model_spans(texts, tagger) if tagger is not None else [[] for _ in texts]
    out = []
    for text, found, extra in zip(texts, met, more, strict=True):
        base = [s for s in found if valid(s[0], text[s[1] : s[2]])]
        failed = [s for s in found if s not in base]
        added = [
            s
            for s in extra
            if all(s[2] <= a or b <= s[1] for _, a, b in base)
            and all(s[2] <= a or b <= s[1] or s[1] <= a and b <= s[2] for _, a, b in failed)
            and not (s[1] and text[s[1] - 1].isalnum())
            and not (s[2] < len(text) and text[s[2]].isalnum())
        ]
        order = lambda s: (KINDS.index(s[0]), s[1])
        out.append((sorted(base, key=order), sorted(base + added, key=order)))
    return out


def _joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def fit_gates(tagger: Tagger, windows: list[str], tags: list[list[int]], precision: float = PRECISION) -> None:
    """Set for each kind the lowest confidence at which ``precision`` of its spans in held-out windows are right.

    Spans cut by the border of a window do not count.  A kind that no confidence brings there keeps the default gate.
    """
    scored = {k: [] for k in KINDS}
    for found, marks, text in zip(_scored_spans(windows, tagger), tags, windows, strict=True):
        for kind, a, b, p in found:
            if 0 < a and b < len(text):
                scored[kind].append((p, all(t and (t - 1) // 2 == KINDS.index(kind) for t in marks[a:b])))
    for kind, spans in scored.items():
        right = 0
        for n, (p, good) in enumerate(sorted(spans, reverse=True), 1):
            right += good
            if p >= 0.5 and right >= precision * n:
                tagger.gates[kind] = min(p, CONFIDENCE)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Tagger | None:
    """Fit on windows of about ``sample_docs`` texts that hold a digit or ``@``, taken by hash; labels are the patterns'
    spans, as they stand and rewritten, other digits and lookalikes are their counterexamples.  One text of four is held
    out and sets the gates.  Without any such text there is no model."""
    rows = docs.where(F.col(text).rlike("[0-9@]") & F.col(doc_id).isNotNull())
    total = rows.count()
    if not total:
        return None
    h = hash60(F.lit("pii"), F.col(doc_id).cast("string"))
    share = min(1.0, 1.5 * sample_docs / total)
    windows = (
        rows.where(h < F.lit(int(share * (1 << 60))))
        .select(F.col(text).alias("text"), h.alias("hash"))
        .mapInArrow(_sample, "hash bigint, nth bigint, window string, tags array<bigint>")
    )
    held = sorted(windows.collect(), key=lambda r: (r["hash"], r["nth"]))[: WINDOWS * sample_docs]
    return fit_tagger([(r["window"], list(r["tags"]), r["hash"] % 4 == 0) for r in held])


def fit_tagger(rows) -> Tagger:
    """A tagger from (window, tags, held out); without both kinds of rows all fit and the gates stay as they are."""
    fitted = [r for r in rows if not r[2]] or rows
    x = np.array([codes(w.ljust(WINDOW)[:WINDOW]) for w, _, _ in fitted])
    y = np.array([(t + [0] * WINDOW)[:WINDOW] for _, t, _ in fitted])
    tagger = Tagger().fit(x, y)
    kept = [r for r in rows if r[2]]
    fit_gates(tagger, [w for w, _, _ in kept], [t for _, t, _ in kept])
    return tagger


def _pick(places, tags):
    """At most three of the windows that hold a span, and at most two others."""
    marked = [a for a in places if tags[a : a + WINDOW].any()]
    others = [a for a in places if not tags[a : a + WINDOW].any()]
    return [a for group, n in ((marked, 3), (others, 2)) for a in group[:: max(1, -(-len(group) // n))]]


def windows_of(text: str, seed: int):
    """Windows and tags of a text as it stands and of three ways to rewrite its spans."""
    for version in range(1 + 3 * bool(base_spans(text))):
        new, tags = varied(text, seed * 4 + version) if version else (text, tags_of(text))
        for a in _pick(_places(new), tags):
            yield new[a : a + WINDOW], tags[a : a + WINDOW].tolist()


def _sample(batches):
    """Training windows of each text, at most ``WINDOWS``."""
    for batch in batches:
        out = {"hash": [], "nth": [], "window": [], "tags": []}
        for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k, (window, tags) in enumerate(windows_of(text, h)):
                out["hash"].append(h)
                out["nth"].append(k)
                out["window"].append(window)
                out["tags"].append(tags)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


_FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def _find(model):
    def run(batches):
        tagger = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for base, spans in all_spans(texts, tagger):
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in spans))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(out[f"n_{k}"], pa.int64()) for k in KINDS],
                    pa.array(out["base_sha256"], pa.string()),
                    pa.array(out["spans"], pa.string()),
                ],
                names=["doc_id", *out],
            )

    return run


def find_personal_data(docs: DataFrame, tagger: Tagger | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    Places count code points of the whole text, ends are exclusive.  A null text is empty and has no spans.  Repeated
    rows have a row each; an empty table gives no rows; further columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_find(shared), _FOUND)
