"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions in numpy.

The patterns give the base spans.  The tagger is trained on the driver from labelled spans: windows of
a bounded sample of documents with the patterns' spans, and windows into which generated items (also
of forms that the patterns do not know) are put.  At run time each whole text is cut into overlapping
windows; where two overlap their emissions are blended, and one CRF path is decoded over the whole text's
emissions, so tags are reconciled globally.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.llm.common import unused, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Documents that the sample for training is expected to hold, with and without base spans.
SAMPLE_DOCS = 300
WINDOW, OVERLAP = 256, 32
HIDDEN = 8

# The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # from a run's start and without going back: linear, and the same matches
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part and domain, found from each @ so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at) if at > end else None
        start = at
        while m and start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if m and start < at:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind as listed."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- characters and tags -------------------------------------------------------------------------

#: Every printable ASCII character, line break and tab is an input of its own; other letters and other characters
#: share BUCKETS inputs each by their code point.  Input 0 pads a window.
_OWN = "\n\t" + "".join(map(chr, range(32, 127)))
BUCKETS = 16
_LETTER = len(_OWN) + 1
_REST = _LETTER + BUCKETS
CLASSES = _REST + BUCKETS
TAGS = 1 + len(KINDS)


@functools.cache
def _class_of() -> np.ndarray:
    code = np.arange(0x110000)
    table = (_REST + code % BUCKETS).astype("u1")
    letter = (code >= 0x3000) | np.fromiter((c < 0x3000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table[letter] = _LETTER + code[letter] % BUCKETS
    for k, c in enumerate(_OWN):
        table[ord(c)] = k + 1
    return table


def _alike() -> np.ndarray:
    """Of each input the first one of its sort: such inputs begin with like weights, and learn their own."""
    own = np.arange(CLASSES)
    for sort in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
        own[[_OWN.index(c) + 1 for c in sort]] = _OWN.index(sort[0]) + 1
    own[_LETTER:_REST], own[_REST:] = _LETTER, _REST
    return own


def classes_of(text: str) -> np.ndarray:
    return _class_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


# --- the tagger ----------------------------------------------------------------------------------


@dataclass
class Tagger:
    """Weights.  wx[d]: class -> gates, wh[d]: hidden -> gates (d: 0 forward, 1 backward; gates: in, forget, out, new), wo, bo: hidden of both -> tags, tr: tag -> next tag."""

    wx: np.ndarray
    wh: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    tr: np.ndarray

    def hidden(self, x: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """Hidden states [time, window, HIDDEN] of one direction over classes x [window, time].

        Gates are piecewise linear (clip of 0.5 + 0.25 z for in, forget and out, clip of z for new), which
        keeps numpy at a few nanoseconds a value.  keep: gets what the backward pass needs.
        """
        windows, steps = x.shape
        h, c = np.zeros((windows, HIDDEN), "f4"), np.zeros((windows, HIDDEN), "f4")
        out = np.empty((steps, windows, HIDDEN), "f4")
        # with the new value's weights halved and shifted, one clip to 0..1 serves all gates: new = 2 * clip - 1
        wx, wh = self.wx[d].copy(), self.wh[d].copy()
        wx[:, 3 * HIDDEN :] = 0.5 * wx[:, 3 * HIDDEN :] + 0.5
        wh[:, 3 * HIDDEN :] *= 0.5
        columns = np.ascontiguousarray(x.T).astype("i8")
        z, moved = np.empty((windows, 4 * HIDDEN), "f4"), np.empty((windows, 4 * HIDDEN), "f4")
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(wx, columns[t], axis=0, out=z, mode="clip")
            np.matmul(h, wh, out=moved)
            z += moved
            np.clip(z, 0, 1, out=z)
            before = c
            new = 2 * z[:, 3 * HIDDEN :]
            new -= 1
            c = before * z[:, HIDDEN : 2 * HIDDEN]
            c += z[:, :HIDDEN] * new
            squashed = np.clip(c, -1, 1)
            h = np.multiply(z[:, 2 * HIDDEN : 3 * HIDDEN], squashed, out=out[t])
            if keep is not None:
                z[:, 3 * HIDDEN :] = new
                keep.append((t, z, before, c, squashed))
                z = np.empty_like(z)
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores [time, window, tag]."""
        both = np.concatenate([self.hidden(x, 0), self.hidden(x, 1)], axis=2)
        out = both.reshape(-1, 2 * HIDDEN) @ self.wo
        out += self.bo
        return out.reshape(*both.shape[:2], TAGS)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of emissions [position, tag], before and after which the tag is 0.

        A stay in other tags from s to j gains, over tag 0, at most the sum of u over it and a constant, where
        u is the rival's lead plus the best step between other tags.  Where even the best such stay over a
        position loses, its tag is 0 for certain: only the stretches between such positions are searched.
        """
        tags = np.zeros(len(e), "i1")
        over = (self.tr - self.tr[0, 0]).astype("f8")
        step = over[1:, 1:].max()
        total = np.concatenate([[0.0], np.cumsum((e[:, 1:].max(axis=1) - e[:, 0]).astype("f8") + step)])
        most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        open_ = most + over[0, 1:].max() + over[1:, 0].max() - step > -1e-3
        edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]])))
        spans = sorted(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True), key=lambda s: s[1] - s[0])
        while spans:
            longest = spans[-1][1] - spans[-1][0]
            many = max(1, min(4096, (1 << 20) // (longest + 1)))
            part = [x for x in spans[-many:] if 2 * (x[1] - x[0]) >= longest]
            del spans[-len(part) :]
            x = np.full((longest + 1, TAGS, len(part)), -1e6, "f4")
            x[:, 0] = 0
            for k, (a, b) in enumerate(part):
                x[: b - a, :, k] = e[a:b]
            x[0] += self.tr[0][:, None]
            for k, ((a, b), own) in enumerate(zip(part, self._search(x), strict=True)):
                tags[a:b] = own[: b - a]
        return tags

    def _search(self, e: np.ndarray) -> np.ndarray:
        """Viterbi over emissions [time, tag, stretch]."""
        steps, _, windows = e.shape
        best, back = e[0], np.zeros((steps, TAGS, windows), "i1")
        for t in range(1, steps):
            paths = best[:, None] + self.tr[:, :, None]
            back[t] = paths.argmax(axis=0)
            best = paths.max(axis=0) + e[t]
        out = np.zeros((windows, steps), "i1")
        at, rows = best.argmax(axis=0), np.arange(windows)
        for t in range(steps - 1, -1, -1):
            out[:, t] = at
            at = back[t, at, rows]
        return out


def _start(rng: np.random.Generator) -> Tagger:
    scale = lambda *shape: rng.normal(0, 0.3, shape).astype("f4")
    wx = scale(2, CLASSES, 4 * HIDDEN)
    wx = wx[:, _alike()] + 0.1 * wx
    wx[:, :, : 3 * HIDDEN] += 0.5  # gates begin half open
    return Tagger(wx, scale(2, HIDDEN, 4 * HIDDEN), scale(2 * HIDDEN, TAGS), np.zeros(TAGS, "f4"), np.zeros((TAGS, TAGS), "f4"))


def _gradients(m: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss (mean negative log likelihood a position) and gradients of (wx, wh, wo, bo, tr) on classes x and tags y [window, time]."""
    windows, steps = x.shape
    kept: list[list] = [[], []]
    states = [m.hidden(x, d, kept[d]) for d in (0, 1)]
    both = np.concatenate(states, axis=2)
    e = both @ m.wo + m.bo
    log = lambda a, axis: (top := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))
    fore, rear = np.empty_like(e), np.zeros_like(e)
    fore[0] = e[0]
    for t in range(1, steps):
        fore[t] = e[t] + log(fore[t - 1][:, :, None] + m.tr[None], 1)
    for t in range(steps - 2, -1, -1):
        rear[t] = log(m.tr[None] + (e[t + 1] + rear[t + 1])[:, None, :], 2)
    z = log(fore[-1], 1)
    yt, rows = y.T, np.arange(windows)
    gold = np.take_along_axis(e, yt[:, :, None].astype("i8"), axis=2).sum(axis=(0, 2)) + m.tr[yt[:-1], yt[1:]].sum(axis=0)
    scale = np.float32(1 / (windows * steps))
    de = np.exp(fore + rear - z[None, :, None])
    np.put_along_axis(de, yt[:, :, None].astype("i8"), np.take_along_axis(de, yt[:, :, None].astype("i8"), axis=2) - 1, axis=2)
    de *= scale
    pair = fore[:-1][:, :, :, None] + m.tr + (e[1:] + rear[1:])[:, :, None, :] - z[None, :, None, None]
    dtr = np.exp(pair).sum(axis=(0, 1))
    np.subtract.at(dtr, (yt[:-1].ravel(), yt[1:].ravel()), 1)
    dwo = np.einsum("twh,twk->hk", both, de)
    dboth = de @ m.wo.T
    dwx, dwh = np.zeros_like(m.wx), np.zeros_like(m.wh)
    for d in (0, 1):
        dh_next, dc = np.zeros((windows, HIDDEN), "f4"), np.zeros((windows, HIDDEN), "f4")
        order = kept[d]
        for k in range(len(order) - 1, -1, -1):
            t, g, before, c, squashed = order[k]
            i, f, o, n = (g[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            dh = dboth[t, :, d * HIDDEN : (d + 1) * HIDDEN] + dh_next
            dc = dc + dh * o * (np.abs(c) < 1)
            dz = np.concatenate([dc * n, dc * before, dh * squashed, dc * i], axis=1)
            inside = np.concatenate([(g[:, : 3 * HIDDEN] > 0) & (g[:, : 3 * HIDDEN] < 1), np.abs(n) < 1], axis=1)
            dz *= np.where(inside, np.float32(1), np.float32(0.02))  # a little slope outside, so that shut gates can open again
            np.add.at(dwx[d], x[:, t], dz)
            if k:
                dwh[d] += states[d][order[k - 1][0]].T @ dz
            dh_next = dz @ m.wh[d].T
            dc = dc * f
    return float((z - gold).sum() * scale), [dwx, dwh, dwo, de.sum(axis=(0, 1)), dtr * scale]


def train(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 260, batch: int = 160, rate: float = 0.03, seed: int = 1) -> Tagger:
    """A tagger fitted by Adam on (classes, tags) windows of one length."""
    rng = np.random.default_rng(seed)
    m = _start(rng)
    xs, ys = np.stack([w[0] for w in windows]), np.stack([w[1] for w in windows])
    weights = [m.wx, m.wh, m.wo, m.bo, m.tr]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        take = rng.integers(0, len(xs), batch)
        _, grads = _gradients(m, xs[take], ys[take])
        norm = float(np.sqrt(sum((g.astype("f8") ** 2).sum() for g in grads)))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, first, second, strict=True):
            g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return m


# --- labelled windows ------------------------------------------------------------------------------


def _item(r: random.Random) -> tuple[str, str]:
    """A generated item and its kind, in the patterns' forms and in others."""
    word = lambda a, b: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(a, b)))
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    kind = r.choice(KINDS)
    if kind == "email":
        name = r.choice([word(2, 8), f"{word(2, 8)}.{digits(2)}", f"{word(1, 6)}_{word(2, 6)}", f"{word(2, 5)}+{word(1, 4)}"])
        at, dot = r.choice([("@", ".")] * 6 + [("(at)", "."), ("[at]", "[dot]")])
        return kind, f"{name}{at}{word(2, 9)}{digits(r.randint(0, 2))}{dot}{r.choice(['com', 'org', 'example' + dot + 'com', 'net', 'de'])}"
    if kind == "ip":
        return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = digits(15)
        check = next(d for d in "0123456789" if luhn(body + d))
        n = body + check
        return kind, n if r.random() < 0.6 else r.choice(["-", " "]).join(n[k : k + 4] for k in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return kind, r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}"] * 3 + [f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 9)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"])


def _decoy(r: random.Random) -> str:
    """What looks like an item and is none."""
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    hexes = "".join(r.choices("0123456789abcdef", k=r.randint(12, 40)))
    return r.choice([f'token = "{hexes}"', f"password={hexes}", digits(r.randint(1, 6)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(3)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"key_{hexes}", "@@@", "+++", "(c) 20" + digits(2), f"{digits(1)}+{digits(1)}"])


def labelled_windows(texts: list[str], count: int = 3000, length: int = 64, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of classes and tags: the patterns' spans in the texts, items and decoys put into stretches of them, and plain stretches."""
    r = random.Random(seed)
    texts = [t for t in texts if t] or ["nothing to see here. "]
    known = [base_spans(t) for t in texts]
    out = []

    def add(text: str, spans: list[Span], at: int) -> None:
        x, y = np.zeros(length, "u1"), np.zeros(length, "i1")
        part = classes_of(text[at : at + length])
        x[: len(part)] = part
        for kind, a, b in (s for s in spans if s[1] < at + length and s[2] > at):
            y[max(0, a - at) : max(0, min(b, at + length) - at)] = 1 + KINDS.index(kind)
        out.append((x, y))

    marked = [(t, spans, a, b) for t, spans in zip(texts, known, strict=True) for _, a, b in spans]
    for t, spans, a, b in r.sample(marked, min(len(marked), count // 2)):
        add(t, spans, max(0, a - r.randint(4, max(5, length - (b - a) - 4))))
    while len(out) < count:
        k = r.randrange(len(texts))
        t = texts[k]
        at = r.randrange(max(1, len(t) - length))
        stretch = t[at : at + length]
        if base_spans(stretch) or r.random() < 0.25:
            add(t, known[k], at)
            continue
        kind, item = _item(r) if r.random() < 0.7 else ("", _decoy(r))
        k = r.randrange(max(1, len(stretch)))
        k = max(stretch.rfind(" ", 0, k), 0)
        before = stretch[:k] + r.choice([" ", " ", " ", "\n", ": "])
        text = before + item + r.choice([" ", " ", ". ", ", ", "\n"]) + stretch[k:].lstrip()
        spans = [(kind, len(before), len(before) + len(item))] if kind else []
        add(text, spans, max(0, len(before) + len(item) + 8 - length) if len(before) + len(item) + 8 > length else 0)
    return out


def fit(df: DataFrame, text: str = "text", docs: int = SAMPLE_DOCS) -> Tagger:
    """A tagger trained on a sample of df's different texts drawn by hash: about `docs` of those with an @ or a plus and digit, as many of the others.

    A text counts once, however many rows have it, and no more than 2 * docs of either sort come to the driver;
    sampled texts are taken whole.
    """
    body = whole_text(df[f"`{text}`"])
    rows = df.select(body.alias("text"), body.rlike(r"@|\+[0-9]").alias("marked"), F.xxhash64(body).alias("h"))
    sizes = {r["marked"]: r["n"] for r in rows.groupBy("marked").agg(F.approx_count_distinct("h").alias("n")).collect()}
    share = lambda m: int(min(1.0, docs / max(1, sizes.get(m, 0))) * (1 << 30))
    place = F.pmod("h", F.lit(1 << 30))
    drawn = rows.where(F.when(F.col("marked"), place < share(True)).otherwise(place < share(False)))
    once = drawn.groupBy("marked", "h").agg(F.first("text").alias("text"))
    texts = {r["text"] for marked in (True, False) for r in once.where(F.col("marked") == marked).orderBy("h").select("text").limit(2 * docs).collect()}
    return train(labelled_windows(sorted(texts)))


# --- whole texts -------------------------------------------------------------------------------------

#: Windows decoded at a time.
BLOCK = 1024


def emissions_of(texts: list[str], m: Tagger) -> list[np.ndarray]:
    """Emissions [position, tag] of each whole text; where two windows overlap, one fades into the other."""
    step = WINDOW - OVERLAP
    codes = [classes_of(t) for t in texts]
    starts = [range(0, max(1, len(c)), step) for c in codes]
    x = np.zeros((sum(map(len, starts)), WINDOW), "u1")
    goes_on = np.ones(len(x), bool)  # a window that another one of the same text is before
    row = 0
    for c, own in zip(codes, starts, strict=True):
        goes_on[row] = False
        for s in own:
            part = c[s : s + WINDOW]
            x[row, : len(part)] = part
            row += 1
    e = np.concatenate([m.emissions(x[k : k + BLOCK]).transpose(1, 0, 2) for k in range(0, len(x), BLOCK)])
    fade = (np.arange(1, OVERLAP + 1, dtype="f4") / (OVERLAP + 1))[None, :, None]
    at = np.flatnonzero(goes_on)
    e[at, :OVERLAP] = e[at, :OVERLAP] * fade + e[at - 1, step:] * (1 - fade)
    flat = np.ascontiguousarray(e[:, :step]).reshape(-1, TAGS)
    first = np.cumsum([0, *map(len, starts)]) * step
    return [flat[a : a + len(c)] for a, c in zip(first.tolist(), codes, strict=False)]


def tag_texts(texts: list[str], m: Tagger) -> list[np.ndarray]:
    """The tags of each text: one best path over all of its emissions."""
    if not texts:
        return []
    between = np.full((1, TAGS), -1e6, "f4")
    between[0, 0] = 0  # tag 0 for certain, so that texts are decoded side by side and no path crosses
    parts = emissions_of(texts, m)
    tags = m.decode(np.concatenate([x for part in parts for x in (part, between)]))
    ends = np.cumsum([len(part) + 1 for part in parts])
    return [tags[b - len(part) - 1 : b - 1] for part, b in zip(parts, ends.tolist(), strict=True)]


def _runs(tags: np.ndarray) -> list[Span]:
    if not tags.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    return [(KINDS[tags[a] - 1], int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if tags[a]]


def _plausible(text: str, span: Span) -> Iterator[Span]:
    """What of the tagger's span can be an item of its kind: an email has letters around its sign, a card 14 to 19 digits and a right check digit, another number 7 digits or more.  A span of several cards gives each."""
    kind, a, b = span
    if kind == "card" and not (14 <= sum("0" <= c <= "9" for c in text[a:b]) <= 19):
        parts = [(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
    else:
        parts = [(a, b)]
    for a, b in parts:
        if s := _item_in(text, kind, a, b):
            yield s


def _item_in(text: str, kind: str, a: int, b: int) -> Span | None:
    while a < b and (text[a].isspace() or text[a] in ",.;:\"'"):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in ",.;:\"'"):
        b -= 1
    item = text[a:b]
    if kind == "email":
        ok = re.fullmatch(r"[^\s@]{2,64}(@|[(\[]at[)\]])[^\s@]{2,}", item) and re.search(r"\.|dot", item)
    else:
        outside = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        digits = re.sub("[^0-9]", "", item)
        ok = outside and len(digits) >= 7 and not re.search(r"[^0-9+() .\-]", item)
        if kind == "card":
            ok = ok and 14 <= len(digits) <= 19 and luhn(digits)
        elif kind == "ip":
            ok = ok and re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", item)
        else:
            ok = ok and len(digits) <= 15 and not re.fullmatch(r"[0-9]+", item)
    return (kind, a, b) if ok else None


def spans_of(text: str, tags: np.ndarray) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of base spans and of the tagger's spans that touch none, by start and kind."""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    for run in _runs(tags):
        for s in _plausible(text, run):
            if not any(s[1] < e and b < s[2] for _, b, e in base):
                found.append((*s, False))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _texts_at_a_time(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > 1 << 19:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def find(df: DataFrame, tagger: Tagger, text: str = "text", redacted: bool = False) -> DataFrame:
    """df plus spans: array<struct<kind, start, end, base>> in code points; with `redacted`, the text has [KIND] in their place.

    Null text: the empty text, no spans (and stays null where redacted).  Rows are independent: repeated
    rows repeat, an empty table gives none, other columns pass through (one named spans is replaced).
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    rest = [c for c in df.columns if c != "spans" and (redacted or c != text)]
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            found = []
            for part in _texts_at_a_time(texts):
                found += [spans_of(t, tags) for t, tags in zip(part, tag_texts(part, shared.value), strict=True)]
            columns = list(batch.columns[:-1])
            if redacted:
                k = rest.index(text)
                columns[k] = pa.array([old if not s else redact(t, s) for old, t, s in zip(columns[k].to_pylist(), texts, found, strict=True)], columns[k].type)
            lists = pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in own] for own in found], SPANS)
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[*rest, "spans"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in rest), "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"])
    return df.select(*(df[f"`{c}`"] for c in rest), df[f"`{text}`"].alias(unused(df, "body"))).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span, or each stretch of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
