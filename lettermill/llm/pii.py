"""Personal data: fixed rules, and a character-level bidirectional LSTM with a CRF that adds what the rules leave out.

The rules find e-mail addresses, IP addresses, payment cards and phone numbers; their spans always stay. The network is
trained in numpy, from a bounded sample of documents whose spans the rules have labelled, and from the same spans written
in ways that the rules refuse (other separators, no leading plus). At work each text is cut into overlapping windows of a
fixed length, counted from its start, so that equal texts give equal spans. All windows of all texts go through the
network, many at once, and each is decoded by Viterbi. The spans of all windows are put in the text's own positions and
reconciled: of overlapping spans the one further from its window's edges stays, then the longer. What the network adds
must not touch a base span and must pass its kind's check of form (digit counts, Luhn, parts up to 255).

Defined results: null counts as empty; empty texts have no span. Texts are read whole, however long. A sample without
any labelled span trains no network, and then the rules stand alone. Repeated rows get equal spans. Other columns are
ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm._common import few_rows, give_back, row_batches

# The kinds in order, and the rules' patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_ADDRESS_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
Span = tuple[int, int, int]  #: kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:  # an address lies within a run of its own characters; only runs with an @ are searched
        a, b = at, at + 1
        while a > 0 and (text[a - 1].isascii() and text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        b = _ADDRESS_RUN.match(text, at).end()
        out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text, a, b)]
        at = text.find("@", b)
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
        out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# Characters by class. Digits, letters and the marks that hold personal data together each have one.
_MARKS = "@.-_%+():/ \n\"'=,#*&$!|;<>[]"
UPPER, LOWER, DIGIT, LETTER, OTHER, EDGE = (len(_MARKS) + i for i in range(6))
CLASSES = EDGE + 1
_TABLE = np.full(0x250, OTHER, np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _TABLE[_c] = _MARKS.index(_s) if _s in _MARKS else DIGIT if "0" <= _s <= "9" else UPPER if "A" <= _s <= "Z" else LOWER if "a" <= _s <= "z" else LETTER if _s.isalpha() else _MARKS.index(" ") if _s.isspace() else OTHER


def char_classes(text: str) -> np.ndarray:
    """One class number for each code point; those beyond the table count as letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], np.uint8(LETTER))


TAGS = 1 + 2 * len(KINDS)  #: outside, then begin and inside of each kind
NEVER = -1e4
SHUT = -60.0  #: what holds the input and forget gates shut, so that the state is zero, on EDGE


def allowed() -> np.ndarray:
    """[from, to]: a span begins after an outside, goes on inside, and has at least two characters."""
    ok = np.full((TAGS, TAGS), NEVER, np.float32)
    ok[0, 0] = 0
    for k in range(len(KINDS)):
        b, i = 1 + 2 * k, 2 + 2 * k
        ok[0, b] = ok[b, i] = ok[i, i] = ok[i, 0] = 0
    return ok


_ALLOWED = allowed()


@dataclass
class Tagger:
    """The network. wx: gates by character class, wh: gates by hidden state (input, forget, output, cell), for both
    directions; emit: tags by the hidden states of both; trans: the CRF's transitions."""

    wx: list[np.ndarray]
    wh: list[np.ndarray]
    emit: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    window: int = 512
    overlap: int = 64
    at_once: int = 1024

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.4).astype(np.float32)
        wx = [draw(4 * hidden, CLASSES) for _ in range(2)]
        for w in wx:
            w[hidden : 2 * hidden] += 1.0
            w[: 2 * hidden, EDGE] = SHUT
        bias = np.zeros((TAGS, 1), np.float32)
        bias[0] = 2.0
        return cls(wx, [draw(4 * hidden, hidden) for _ in range(2)], draw(TAGS, 2 * hidden), bias, np.zeros((TAGS, TAGS), np.float32))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: [time, windows] classes. [time, tags, windows]."""
        steps, n = x.shape
        hidden = self.wh[0].shape[1]
        # A logistic gate is (1 + tanh of half its input) / 2. The halving goes into the weights, and h is kept twice as
        # large, which the weights that read it undo.
        half = np.ones((4 * hidden, 1), np.float32)
        half[: 3 * hidden] = 0.5
        at = x.astype(np.intp)
        out = np.empty((steps, TAGS, n), np.float32)
        z, seen, tmp, more = (np.empty((r, n), np.float32) for r in (4 * hidden, 4 * hidden, hidden, TAGS))
        one_more, put, forget, let, cell = z[: 3 * hidden], z[:hidden], z[hidden : 2 * hidden], z[2 * hidden : 3 * hidden], z[3 * hidden :]
        for way in (0, 1):
            wx, wh = np.ascontiguousarray(self.wx[way] * half), np.ascontiguousarray(self.wh[way] * half * 0.5)
            e = np.ascontiguousarray(self.emit[:, way * hidden : (way + 1) * hidden] * 0.5)
            h, c = np.zeros((hidden, n), np.float32), np.zeros((hidden, n), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.matmul(wh, h, out=z)
                np.take(wx, at[t], axis=1, out=seen, mode="clip")
                z += seen
                np.tanh(z, out=z)
                one_more += 1
                c *= forget
                np.multiply(put, cell, out=tmp)
                c += tmp
                c *= 0.5
                np.tanh(c, out=tmp)
                np.multiply(let, tmp, out=h)
                if way == 0:
                    np.matmul(e, h, out=out[t])
                else:
                    np.matmul(e, h, out=more)
                    out[t] += more
        out += self.bias
        return out

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of each window by Viterbi: e [time, tags, windows] to [time, windows]. As a span only begins
        after an outside and only its own kind goes on, each tag has few tags before it, which are compared alone. Ties
        go to the smaller tag."""
        steps, _, n = e.shape
        kinds = len(KINDS)
        b_at, i_at = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        stay, begin = self.trans[0, 0], self.trans[0, b_at][:, None]
        enter, go_on, leave = self.trans[b_at, i_at][:, None], self.trans[i_at, i_at][:, None], self.trans[i_at, 0][:, None]
        out, b, i = e[0, 0].copy(), e[0, 1::2].copy(), np.full((kinds, n), NEVER, np.float32)
        entered = np.zeros((steps, kinds, n), bool)
        left = np.zeros((steps, n), np.int8)  # 0: outside before, else 1 and the kind that ended
        for t in range(1, steps):
            closing = i + leave
            ended = closing.max(axis=0)
            outside = out + stay
            some = ended > outside
            if some.any():
                left[t] = np.where(some, closing.argmax(axis=0) + 1, 0)
            new, old = b + enter, i + go_on
            np.greater_equal(new, old, out=entered[t])
            np.maximum(new, old, out=i)
            i += e[t, 2::2]
            np.add(out + e[t, 1::2], begin, out=b)
            np.maximum(outside, ended, out=out)
            out += e[t, 0]
        tags = np.zeros((steps, n), np.int8)
        inside = i.max(axis=0) > out
        tags[-1, inside] = i_at[i.argmax(axis=0)[inside]]
        for t in range(steps - 1, 0, -1):
            now = tags[t]
            on = np.flatnonzero((now > 0) | (left[t] > 0))
            for w in on.tolist():
                tag = int(now[w])
                if tag == 0:
                    tags[t - 1, w] = 2 * left[t, w]
                elif tag % 2 == 0:
                    tags[t - 1, w] = tag - 1 if entered[t, tag // 2 - 1, w] else tag
        return tags

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its spans from all windows: kind, start, end and the distance to the nearer window edge."""
        step, size = self.window - self.overlap, self.window
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        rows: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            # Windows of about one length go together, so that little of a batch is padding; what a window gives does
            # not depend on the padding after it, as EDGE leaves the network in its first state.
            rows.sort(key=lambda r: -len(r[2]))
            for i in range(0, len(rows), self.at_once):
                batch = rows[i : i + self.at_once]
                x = np.full((len(batch[0][2]), len(batch)), EDGE, np.uint8)
                for j, (_, _, part) in enumerate(batch):
                    x[: len(part), j] = part
                tags = self.decode(self.emissions(x))
                for j in np.flatnonzero(tags.any(axis=0)).tolist():
                    doc, start, part = batch[j]
                    on = np.flatnonzero(tags[: len(part), j])
                    if len(on):
                        for run in np.split(on, np.flatnonzero((np.diff(on) > 1) | (tags[on[1:], j] % 2 == 1)) + 1):
                            a, b = int(run[0]), int(run[-1]) + 1
                            # The text's own ends are no cuts.
                            left = a if start else size
                            found[doc].append(((int(tags[a, j]) - 1) // 2, start + a, start + b, min(left, size - b)))
            rows.clear()

        for doc, text in enumerate(texts):
            classes = char_classes(text)
            for start in range(0, max(1, len(classes) - self.overlap), step) if len(classes) else ():
                rows.append((doc, start, classes[start : start + size]))
                held += size
                if held >= 1 << 25:
                    flush()
                    held = 0
        if rows:
            flush()
        return found


def well_formed(kind: int, s: str) -> bool:
    """Whether what the network found can be of its kind."""
    digits = _digits(s)
    if kind == 0:
        user, mark, host = s.partition("@")
        return bool(user and mark and "@" not in host and "." in host.strip(".") and not any(c.isspace() for c in s))
    if not s or not ("0" <= s[-1] <= "9"):
        return False
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^0-9. ]", s)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .\-]", s)
    return 9 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+/\-]", s) and bool(re.search(r"[0-9][ ().+/\-]+[0-9]", s))


def reconcile(text: str, base: list[Span], found: list[tuple[int, int, int, int]]) -> list[Span]:
    """Base spans, and of the found ones those that are well formed, touch no base span and no better one."""
    if not found:
        return base
    taken: list[tuple[int, int]] = []  # in order and apart
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = list(base)
    for kind, a, b, _ in sorted(set(found), key=lambda s: (-s[3], s[1] - s[2], s)):
        at = bisect.bisect(taken, (a, a))
        free = (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0])
        if free and well_formed(kind, text[a:b]):
            # A piece of a longer run of digits is no number of its own.
            if kind and (text[max(0, a - 1) : a].isdigit() or text[b : b + 1].isdigit()):
                continue
            taken.insert(at, (a, b))
            out.append((kind, a, b))
    return sorted(out)


# Training

def variants(text: str, span: Span) -> str | None:
    """The span's text as the rules refuse it; None for kinds without such a form."""
    kind, a, b = span
    s = text[a:b]
    if kind == 3:
        return s.split(" ", 1)[1] if " " in s and len(_digits(s.split(" ", 1)[1])) >= 9 else s[1:]
    if kind == 2 and len(_digits(s)) == 16:
        d = _digits(s)
        return ".".join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == 1:
        return s.replace(".", " . ")
    return None


def examples(text: str, length: int, blanks: int = 2) -> list[tuple[bytes, bytes]]:
    """Windows of classes and tags from one text: around all spans and their refused forms, around `blanks` evenly spaced
    digits or marks that are in no span, and one from the middle. Where they lie follows from the text alone."""
    base = base_spans(text)
    out = []

    def cut(t: str, spans: list[Span], centre: int) -> None:
        start = max(0, min(centre - length // 2 + int(hashlib.md5(t[max(0, centre - 9) : centre + 9].encode("utf-8", "replace")).hexdigest()[:4], 16) % 21 - 10, len(t) - length))
        row, tag = np.full(length, EDGE, np.uint8), np.zeros(length, np.uint8)
        part = char_classes(t[start : start + length])
        row[: len(part)] = part
        for k, a, b in spans:
            if a < start + length and start < b:
                a, b = a - start, b - start
                tag[max(0, a) : min(b, length)] = 2 + 2 * k
                if a >= 0:
                    tag[a] = 1 + 2 * k
        # A span cut by the window's start is not one that begins there.
        first = 0
        while first < length and tag[first] and tag[first] % 2 == 0:
            tag[first] = 0
            row[first] = OTHER
            first += 1
        if tag[-1] % 2:
            tag[-1] = 0
        out.append((row.tobytes(), tag.tobytes()))

    for span in base:
        kind, a, b = span
        cut(text, base, (a + b) // 2)
        other = variants(text, span)
        if other is not None:
            t = text[max(0, a - length) : a] + other + text[b : b + length]
            at = min(a, length)
            cut(t, [(kind, at, at + len(other))], at + len(other) // 2)
    inside = np.zeros(len(text) + 1, bool)
    for _, a, b in base:
        inside[a:b] = True
    outside = [m.start() for m in re.finditer(r"[0-9@+(]", text) if not inside[m.start()]]
    for i in range(min(blanks, len(outside))):
        cut(text, base, outside[i * len(outside) // blanks if len(outside) > blanks else i])
    if text:
        cut(text, base, len(text) // 2)
    return out


def _lstm(wx, wh, x):
    steps, n = x.shape
    hidden = wh.shape[1]
    h, c = np.zeros((steps + 1, hidden, n), np.float32), np.zeros((steps + 1, hidden, n), np.float32)
    gates, tc = np.empty((steps, 4 * hidden, n), np.float32), np.empty((steps, hidden, n), np.float32)
    for t in range(steps):
        z = wh @ h[t] + wx[:, x[t]]
        z[: 3 * hidden] = 1 / (1 + np.exp(-z[: 3 * hidden]))
        z[3 * hidden :] = np.tanh(z[3 * hidden :])
        gates[t] = z
        c[t + 1] = z[hidden : 2 * hidden] * c[t] + z[:hidden] * z[3 * hidden :]
        tc[t] = np.tanh(c[t + 1])
        h[t + 1] = z[2 * hidden : 3 * hidden] * tc[t]
    return h, c, gates, tc


def _lstm_grad(wh, x, kept, dh_all):
    h, c, gates, tc = kept
    steps, n = x.shape
    hidden = wh.shape[1]
    dwx, dwh = np.zeros((4 * hidden, CLASSES), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((hidden, n), np.float32), np.zeros((hidden, n), np.float32)
    each = np.eye(CLASSES, dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t, j * hidden : (j + 1) * hidden] for j in range(4))
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc[t] ** 2)
        dz = np.concatenate((dc * g * i * (1 - i), dc * c[t] * f * (1 - f), dh * tc[t] * o * (1 - o), dc * i * (1 - g * g)))
        dwh += dz @ h[t].T
        dwx += dz @ each[x[t]]
        dh, dc = wh.T @ dz, dc * f
    return dwx, dwh


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def crf_loss(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood of tags y [time, windows], and its gradients by emissions and transitions."""
    steps, _, n = e.shape
    a = (trans + _ALLOWED)[:, :, None]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    alpha[0, 2::2] = NEVER
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, None] + a, 0) + e[t]
    end = np.zeros((TAGS, 1), np.float32)
    end[1::2] = NEVER
    beta[-1] = end
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(a + (e[t + 1] + beta[t + 1])[None], 1)
    z = _lse(alpha[-1] + beta[-1], 0)
    w = np.arange(n)
    gold = np.zeros(n, np.float32)
    de = np.exp(alpha + beta - z)
    da = np.zeros_like(trans)
    for t in range(steps):
        gold += e[t, y[t], w]
        de[t, y[t], w] -= 1
        if t:
            gold += (trans + _ALLOWED)[y[t - 1], y[t]]
            da += np.exp(alpha[t - 1][:, None] + a + (e[t] + beta[t])[None] - z).sum(axis=2)
            np.add.at(da, (y[t - 1], y[t]), -1)
    return float((z - gold).mean()), de / n, da / n


def train(windows: list[tuple[bytes, bytes]], *, hidden: int = 8, steps: int = 300, batch: int = 64, rate: float = 0.04, seed: int = 7) -> Tagger:
    """Adam on the CRF's likelihood."""
    model = Tagger.fresh(hidden, seed)
    xs = np.stack([np.frombuffer(x, np.uint8) for x, _ in windows], axis=1)
    ys = np.stack([np.frombuffer(y, np.uint8) for _, y in windows], axis=1).astype(np.int64)
    rng = np.random.default_rng(seed)
    params = [*model.wx, *model.wh, model.emit, model.bias, model.trans]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.array([], np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate((order, rng.permutation(xs.shape[1])))
        pick, order = order[:batch], order[batch:]
        x, y = xs[:, pick], ys[:, pick]
        fore, back = _lstm(model.wx[0], model.wh[0], x), _lstm(model.wx[1], model.wh[1], x[::-1])
        h = np.concatenate((fore[0][1:], back[0][1:][::-1]), axis=1)
        e = np.einsum("kh,thb->tkb", model.emit, h, optimize=True) + model.bias
        _, de, da = crf_loss(e, model.trans, y)
        dh = np.einsum("kh,tkb->thb", model.emit, de, optimize=True)
        f = _lstm_grad(model.wh[0], x, fore, dh[:, :hidden])
        b = _lstm_grad(model.wh[1], x[::-1], back, dh[::-1, hidden:])
        grads = [f[0], b[0], f[1], b[1], np.einsum("tkb,thb->kh", de, h, optimize=True), de.sum(axis=(0, 2))[:, None], da]
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        lr = rate * min(1.0, step / 10) * (1 - 0.9 * step / steps)
        for p, g, a, v in zip(params, grads, m1, m2):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            v += 0.01 * (g * g - v)
            p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        for w in model.wx:
            w[: 2 * hidden, EDGE] = SHUT
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 3000, length: int = 64, blanks: int = 2, **options) -> Tagger | None:
    """Trains on windows from about sample_docs documents (the bound of the training sample), chosen by a hash of the
    id among those with a digit or an @: of `length` characters, around all spans that the rules label there, and around
    at most `blanks` places of each document that only look like some. None where the rules label nothing there."""
    n = docs.count()
    place = F.coalesce(F.crc32(F.concat(F.lit("pii-sample:"), F.col("id"))), F.lit(0)) / F.lit(2.0**32)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(place < min(1.0, sample_docs / max(1, n))).filter(F.col("text").rlike("[0-9@]"))

    def cut(batches):
        for batch in few_rows(batches):
            (texts,) = row_batches(batch, "text")
            found = sorted({w for t in texts for w in examples(t, length, blanks)})
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["x", "y"])

    windows = sorted({(bytes(r.x), bytes(r.y)) for r in rows.select("text").mapInArrow(cut, "x binary, y binary").collect()})
    if not any(any(y) for _, y in windows):
        return None
    return train(windows, **options)


def find_spans(texts: list[str | None], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans, by kind and start."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    found = model.spans(whole) if model else [[] for _ in whole]
    return [(b, reconcile(t, b, f)) for t, b, f in zip(whole, base, found)]


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: Tagger | None, *, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols with n_email, n_ip, n_card, n_phone (of the rules), base_sha256 and spans, one row for each input row."""
    given = docs.select(*id_cols, F.col(text_col).alias("_text_"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches):
        for batch in few_rows(batches, 2048):
            (texts,) = row_batches(batch, "_text_")
            out = find_spans(texts, model)
            own = [batch.column(batch.schema.get_field_index(c)) for c in id_cols]
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in out], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(_said(b).encode()).hexdigest() for b, _ in out])
            yield pa.RecordBatch.from_arrays([*own, *counts, digest, pa.array([_said(a) for _, a in out])], names=[*id_cols, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return given.mapInArrow(run, f"{kinds}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with `[KIND]` in place of each span; of spans that overlap the last to begin, then the longer one."""
    if text is None:
        return None
    end, tail = len(text), []
    for kind, a, b in sorted(spans, key=lambda s: (-s[1], -s[2])):
        if b <= end:
            tail += [text[b:end], f"[{KINDS[kind].upper()}]"]
            end = a
    return text[:end] + "".join(reversed(tail))


def masker(model: Tagger | None, at_once: int = 2048):
    """A column function from texts to texts with `[KIND]` in place of each span; null stays null."""

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            done = []
            for i in range(0, len(texts), at_once):
                given = texts[i : i + at_once].tolist()
                done += [masked(text, spans) for text, (_, spans) in zip(given, find_spans(given, model))]
            yield pd.Series(done, dtype=object)
        give_back()

    return mask
