"""Operator 3: personal data and secrets, found by a character-level bidirectional LSTM with a CRF.

The model is written and trained in numpy, from labelled spans: lines of a bounded sample of the
corpus into which generated spans of each kind, and look-alikes without a label, are set. Characters
fall into about a hundred classes; two LSTMs (one for each direction, with logistic gates and tanh cells)
give the emissions of BIO tags, and CRF transitions and their Viterbi path decide. tanh is taken by its
rational approximation x (27 + x x) / (27 + 9 x x) on -3..3 and its limits beyond (at most 0.024 off, with a
continuous derivative), and the logistic function as (1 + tanh(x / 2)) / 2, in training and in use alike: numpy's own
tanh takes about 6 ns a value.

A whole text is covered by windows of WINDOW characters that overlap by OVERLAP. A window goes
through Viterbi unless a bound on all other paths shows that the path of O alone is best, so the
result is that of decoding every window. Parts of one span that neighbouring windows saw, cut by
their ends, are joined first, whatever the span's length. The spans of all windows of a text are then
reconciled globally: of spans that overlap, the set of greatest total margin over O stays (weighted
interval scheduling); spans whose margin is below MARGIN, all of a few characters, are dismissed.

Defined results: a null text stays null without spans; an empty one has none; very long texts are covered by
windows whole. n_chars is the length of the new text. Equal texts, and so repeated rows, give equal spans, whatever
the partitioning; of sets of spans of equal margin the one whose last span begins or ends first stays. All columns, extra ones
included, are passed through. An empty table gives an empty table.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, lean, least_hashes, pieces, spare_name, trim

KINDS = ["EMAIL", "PHONE", "IP", "CARD", "ID", "KEY", "SECRET"]
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

#: Production parameters. SAMPLE bounds the documents whose lines serve as training background.
WINDOW, OVERLAP, HIDDEN, EMBED, MARGIN = 512, 96, 10, 12, 4.0
SAMPLE, EXAMPLES, LENGTH, EPOCHS, BATCH, RATE, SEED = 300, 6000, 96, 8, 64, 0.02, 7
_AT_ONCE = 512
_TEXT_CHARS = 2 << 20

_CLASS = np.zeros(0x250, np.int64)  # 0: anything else
_CLASS[33:127] = np.arange(1, 95)
_CLASS[48:58] = 16  # digits are alike
_CLASS[[32, 9, 160]] = 95
_CLASS[[10, 13]] = 96
_CLASS[0xC0:0xDF] = 97
_CLASS[0xDF:0x250] = 98
_CLASS[[0xD7, 0xF7]] = 0
CLASSES = 99


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CLASS[np.minimum(codes, 0x24F)]
    out[codes >= 0x250] = np.where(codes[codes >= 0x250] >= 0x2000, 0, 98)
    return out


# ---------------------------------------------------------------- labelled spans


def _made(r: random.Random, kind: str) -> str:
    """An invented span of the kind."""
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    word = lambda a, b: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(a, b)))
    if kind == "EMAIL":
        local = word(2, 10) + r.choice(["", ".", "_", "-"]) + r.choice(["", word(1, 8), digits(r.randint(1, 4))])
        return f"{local.rstrip('._-')}@" + ".".join(word(2, 9) + r.choice(["", "", digits(1)]) for _ in range(r.randint(1, 2))) + r.choice([".com", ".org", ".net", ".de", ".fr", ".es", ".io", ".co.uk", ".example.com"])
    if kind == "PHONE":
        return r.choice(["+1 ({}) {}-{}", "+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+1 {} {} {}", "+1-{}-{}-{}", "+44 {} {} {}"]).format(digits(3), digits(3), digits(4)) if r.random() < 0.8 else r.choice(["+33 {} {} {} {} {}".format(digits(1), *(digits(2) for _ in range(4))), f"+49 {digits(3)} {digits(7)}", f"+34 {digits(3)} {digits(3)} {digits(3)}"])
    if kind == "IP":
        return ".".join(str(r.randint(0, r.choice([9, 99, 255, 255, 255]))) for _ in range(4))
    if kind == "CARD":
        return r.choice([digits(16), digits(16), digits(16), r.choice("- ").join(digits(4) for _ in range(4)), digits(15)])
    if kind == "ID":
        return f"{digits(3)}-{digits(2)}-{digits(4)}"
    if kind == "KEY":
        return r.choice(["AKIA", "AKIA", "AKIA", "ASIA"]) + "".join(r.choice(string.ascii_uppercase + "234567" + string.digits) for _ in range(16)) if r.random() < 0.8 else r.choice(["ghp_", "sk-", "xoxb-"]) + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(20, 40)))
    value = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 18, 18, 20, 24, 32, 40, 40]))) if r.random() < 0.8 else "".join(r.choice(string.ascii_letters + string.digits + "!#%*_-") for _ in range(r.randint(8, 24)))
    name = r.choice(["password", "password", "passwd", "pwd", "token", "token", "secret", "api_key", "apikey", "access_token"])
    return r.choice(['{}={}', '{}={}', '{} = "{}"', '{} = "{}"', '{}: {}', '{}="{}"', "{}: '{}'"]).format(name, value)


def _signs(r: random.Random) -> str:
    return r.choice("!?#%&*$~^|+=<>") * r.randint(1, 4)


def _alike(r: random.Random) -> str:
    """Text that looks like a span but is none."""
    d = lambda a, b: str(r.randint(a, b))
    caps = lambda a, b: "".join(r.choice(string.ascii_uppercase) for _ in range(r.randint(a, b)))
    return r.choice([
        f"Version {d(1, 9)}.{d(0, 9)}.", f"version {d(1, 9)}.", f"{caps(2, 4)} {caps(2, 3)}-{caps(2, 3)} {d(1, 9)}.{d(0, 9)}.", d(1900, 2030), f"{d(1, 999)},{d(100, 999)}", f"{d(0, 99)}.{d(0, 99)}", f"{d(2000, 2030)}-{d(10, 12)}-{d(10, 28)}", f"{d(0, 23)}:{d(10, 59)}", f"${d(1, 999)}.{d(10, 99)}", f"{d(1, 100)} %", f"v{d(0, 9)}.{d(0, 20)}.{d(0, 20)}",
        f"http://www.example.{r.choice(['com', 'org'])}/{d(1, 999)}", f"({d(1, 99)})", f"[{d(1, 50)}]", " ".join(_signs(r) for _ in range(r.randint(1, 5))), "a | b | c", " ".join(caps(2, 8) + _signs(r) for _ in range(r.randint(1, 3))), "=" * r.randint(3, 9), "password", "the token is", f"No. {d(1, 9999)}", f"§ {d(1, 200)}", f"{d(1, 31)}/{d(1, 12)}/{d(1990, 2030)}", "@", "e.g.", "= 1", '"the"', "(the)", "x-y", f"+{d(1, 99)}", f"{d(10, 99)}-{d(10, 99)}",
    ])


def examples(lines: Sequence[str], count: int = EXAMPLES, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags of `count` windows of `length` characters with labelled spans.

    `lines` are the background; ones with a digit or a sign of a span are left out, since their own spans have no label.
    """
    r = random.Random(seed)
    clean = [x for x in lines if x and not set(x) & set('0123456789@=+"')] or ["the quick brown fox jumps over the lazy dog, again and again. "]
    xs, ys = np.empty((count, length), np.int64), np.zeros((count, length), np.int64)
    for n in range(count):
        parts, tags, size = [], [], 0

        def put(text: str, kind: int | None = None) -> None:
            nonlocal size
            parts.append(text)
            tags.extend([0] * len(text) if kind is None else [1 + 2 * kind, *[2 + 2 * kind] * (len(text) - 1)])
            size += len(text)

        plain = r.random() < 0.25  # no span at all
        style = r.random()
        while size < 2 * length:
            line = r.choice(clean)
            at = r.randrange(len(line)) if r.random() < 0.5 else 0
            line = line[at : at + r.randint(2, length)]
            if style < 0.15:
                line = line.upper() if style < 0.1 else line.title()
            if style < 0.05 or 0.9 < style:
                sign = _signs(r)
                line = " ".join(w + (sign if style < 0.95 else _signs(r)) for w in line.split(" "))
            put(line)
            u = r.random()
            if u < 0.6 and not plain:
                kind = r.randrange(len(KINDS))
                put(r.choice([" ", " ", " ", "\n", "\n", "(", ": ", "| "]))
                put(_made(r, KINDS[kind]), kind)
                put(r.choice([" ", " ", " ", " ", "\n", ". ", ", ", ")", _signs(r) + " ", _signs(r) + " ", _signs(r) + " ", " | "]))
            elif u < 0.85:
                put(" " + _alike(r) + r.choice([" ", " ", "\n", ". "]))
            else:
                put(r.choice([" ", "\n", ". "]))
        at = r.randint(0, size - length) if r.random() < 0.7 else 0
        xs[n] = char_classes("".join(parts))[at : at + length]
        own = np.array(tags[at : at + length])
        own[0] += own[0] > 0 and own[0] % 2 == 0 and -1  # a span that began before begins here
        ys[n] = own
    return xs, ys


# ---------------------------------------------------------------- model


def _tanh(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -3, 3)
    return x * (27 + x * x) / (27 + 9 * x * x)


def _slope(x: np.ndarray) -> np.ndarray:
    """The derivative of _tanh."""
    x = np.clip(x, -3, 3)
    return ((9 - x * x) / (9 + 3 * x * x)) ** 2


_LOW, _HIGH = np.float32(-3), np.float32(3)


def _tanh_in_place(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """`x` becomes its _tanh; a and b have its shape."""
    np.clip(x, _LOW, _HIGH, out=x)
    np.square(x, out=a)
    a += np.float32(3)  # x (27 + x x) / (9 (3 + x x)) is x / 9 + (8 / 3) x / (3 + x x)
    np.divide(np.float32(8 / 3), a, out=b)
    b += np.float32(1 / 9)
    x *= b


class Tagger:
    """Parameters: E (classes, embed); for both directions W (2, embed, 4h), b, U (2, h, 4h), V (2, h, tags); bias; transitions."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.h = p["U"].shape[1]
        self.table = (p["E"] @ p["W"] + p["b"]).astype(np.float32)  # (2, classes, 4h)

    @classmethod
    def new(cls, seed: int = SEED, hidden: int = HIDDEN, embed: int = EMBED) -> Tagger:
        g = np.random.default_rng(seed)
        f = lambda *s: (g.normal(size=s) / np.sqrt(s[-2])).astype(np.float32)
        b = np.zeros((2, 1, 4 * hidden), np.float32)
        b[:, :, hidden : 2 * hidden] = 1
        return cls({"E": f(CLASSES, embed) * np.float32(2), "W": f(2, embed, 4 * hidden), "b": b, "U": f(2, hidden, 4 * hidden), "V": f(2, hidden, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)})

    def emissions(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(tags, length, windows) for padded windows of classes (windows, length); `sizes` are their true lengths."""
        n, length = x.shape
        h = self.h
        even = bool((sizes == length).all())
        back = np.arange(length)[::-1] if even else np.maximum(sizes[:, None] - 1 - np.arange(length), 0)
        steps = np.ascontiguousarray(np.stack([x, x[:, back] if even else np.take_along_axis(x, back, 1)]).transpose(2, 0, 1))
        # windows are the last axis, so that each gate lies together; gates are kept as 1 + tanh(x / 2), twice their value
        half = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)
        table = np.ascontiguousarray((self.table * half).transpose(0, 2, 1))  # (2, 4h, classes)
        U = np.ascontiguousarray((self.p["U"] * half * np.float32(0.5)).transpose(0, 2, 1))
        V = np.ascontiguousarray((self.p["V"] * np.float32(0.5)).transpose(0, 2, 1))
        out, state, cell = np.empty((2, TAGS, length, n), np.float32), np.zeros((2, h, n), np.float32), np.zeros((2, h, n), np.float32)
        z, t, t2 = (np.empty((2, 4 * h, n), np.float32) for _ in range(3))
        u, u1, u2 = (np.empty((2, h, n), np.float32) for _ in range(3))
        gates, enter, keep, leave, cand = z[:, : 3 * h], z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
        for k in range(length):
            np.matmul(U, state, out=z)
            for d in (0, 1):
                np.take(table[d], steps[k, d], axis=1, out=t[d], mode="clip")
            z += t
            _tanh_in_place(z, t, t2)
            gates += 1
            cell *= keep
            np.multiply(enter, cand, out=u)
            cell += u
            cell *= 0.5
            np.copyto(u, cell)
            _tanh_in_place(u, u1, u2)
            np.multiply(u, leave, out=state)
            np.matmul(V, state, out=out[:, :, k])
        e, rear = out
        e += rear[:, ::-1] if even else np.take_along_axis(rear, back.T[None], 1)
        e += self.p["o"][:, None, None]
        return e

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags for each window, and its gradients."""
        p, h = self.p, self.h
        n, length = x.shape
        both = np.stack([x, x[:, ::-1]])  # (2, n, length)
        a = np.matmul(p["E"][both].reshape(2, n * length, -1), p["W"]).reshape(2, n, length, 4 * h) + p["b"][:, :, None]
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        half = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)
        kept, states = [], np.empty((2, n, length, h), np.float32)
        for k in range(length):
            x4 = (a[:, :, k] + state @ p["U"]) * half
            y4 = _tanh(x4)
            g = 0.5 + 0.5 * y4[..., : 3 * h]
            after = g[..., h : 2 * h] * cell + g[..., :h] * y4[..., 3 * h :]
            s = _tanh(after)
            kept.append((x4, y4, g, cell, after, s, state))
            state, cell = g[..., 2 * h :] * s, after
            states[:, :, k] = state
        e = states[0] @ p["V"][0] + (states[1] @ p["V"][1])[:, ::-1] + p["o"]
        # CRF in log space
        tr = p["T"].astype(np.float64)
        alpha = np.empty((n, length, TAGS))
        beta = np.zeros((n, length, TAGS))
        alpha[:, 0] = e[:, 0]
        expT = np.exp(tr)
        for k in range(1, length):
            m = alpha[:, k - 1].max(1, keepdims=True)
            alpha[:, k] = np.log(np.exp(alpha[:, k - 1] - m) @ expT + 1e-300) + m + e[:, k]
        for k in range(length - 2, -1, -1):
            b = beta[:, k + 1] + e[:, k + 1]
            m = b.max(1, keepdims=True)
            beta[:, k] = np.log(np.exp(b - m) @ expT.T + 1e-300) + m
        m = alpha[:, -1].max(1, keepdims=True)
        z = np.log(np.exp(alpha[:, -1] - m).sum(1, keepdims=True)) + m  # (n, 1)
        gold = np.take_along_axis(e, y[:, :, None], 2).sum((1, 2)) + tr[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, :, None])
        dT = np.zeros((TAGS, TAGS))
        for k in range(length - 1):
            left = alpha[:, k]
            right = beta[:, k + 1] + e[:, k + 1] - z
            lm = left.max(1, keepdims=True)
            dT += np.exp(left - lm).T @ np.exp(right + lm)
        dT = dT * expT
        np.add.at(dT, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        de = (de / n).astype(np.float32)
        grad = {"T": (dT / n).astype(np.float32), "o": de.sum((0, 1))}
        sides = np.stack([de, de[:, ::-1]])
        grad["V"] = np.matmul(states.reshape(2, -1, h).transpose(0, 2, 1), sides.reshape(2, -1, TAGS))
        dstates = np.matmul(sides.reshape(2, -1, TAGS), p["V"].transpose(0, 2, 1)).reshape(2, n, length, h)
        da = np.empty((2, n, length, 4 * h), np.float32)
        dU = np.zeros_like(p["U"])
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for k in range(length - 1, -1, -1):
            x4, y4, g, cell, after, s, before = kept[k]
            dh = dh + dstates[:, :, k]
            dc = dc + dh * g[..., 2 * h :] * _slope(after)
            d4 = np.concatenate([0.5 * dc * y4[..., 3 * h :], 0.5 * dc * cell, 0.5 * dh * s, dc * g[..., :h]], -1)
            d4 *= _slope(x4) * half
            da[:, :, k] = d4
            dU += np.matmul(before.transpose(0, 2, 1), d4)
            dh = np.matmul(d4, p["U"].transpose(0, 2, 1))
            dc = dc * g[..., h : 2 * h]
        flat = da.reshape(2, -1, 4 * h)
        grad["U"], grad["b"] = dU, flat.sum(1, keepdims=True)
        grad["W"] = np.matmul(p["E"][both].reshape(2, n * length, -1).transpose(0, 2, 1), flat)
        dE = np.zeros_like(p["E"])
        np.add.at(dE, both.reshape(2, -1).ravel(), np.matmul(flat, p["W"].transpose(0, 2, 1)).reshape(-1, dE.shape[1]))
        grad["E"] = dE
        return float((z[:, 0] - gold).mean()), grad

    @classmethod
    def trained(cls, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED, hidden: int = HIDDEN) -> Tagger:
        """By Adam with a rate that falls to zero, from the labelled windows."""
        model = cls.new(seed, hidden)
        g = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in model.p.items()}
        second = {k: np.zeros_like(v) for k, v in model.p.items()}
        steps, t = epochs * (len(x) // batch), 0
        for _ in range(epochs):
            order = g.permutation(len(x))
            for at in range(0, len(x) - batch + 1, batch):
                t += 1
                _, grad = model.loss(x[order[at : at + batch]], y[order[at : at + batch]])
                norm = np.sqrt(sum(float((v**2).sum()) for v in grad.values()))
                step = rate * (1 - t / (steps + 1))
                for k, v in grad.items():
                    v = v * min(1.0, 5 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    model.p[k] = (model.p[k] - step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        T_ = model.p["T"].copy()
        for a in range(TAGS):  # an I tag continues its own kind only
            for b in range(2, TAGS, 2):
                if a not in (b - 1, b):
                    T_[a, b] = -1e4
        model.p["T"] = T_
        return cls(model.p)

    def crops(self, e: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, bool, bool]]:
        """(window, start, emissions, O before, O after): of each window the part that can hold other tags than O.

        The best path leaves O only where it gains by that. What a run of other tags gains is at most
        the sum of the best emissions over O, with the best transitions; a place that no run with a
        positive bound covers is O in the best path.
        """
        tr = self.p["T"]
        stay, enter, leave, within = tr[0, 0], tr[0, 1:].max(), tr[1:, 0].max(), tr[1:, 1:].max() - tr[0, 0]
        length = e.shape[1]
        over = np.where(np.arange(length)[:, None] < sizes, e[1:].max(0) - e[0], np.float32(-1e4)) + within
        total = np.cumsum(over, axis=0, dtype=np.float64)
        ahead = total - np.minimum.accumulate(np.concatenate([np.zeros_like(total[:1]), total[:-1]]), axis=0)
        # a run at a window's first or last character lacks one outer transition
        inner, first, final = enter + leave - 2 * stay - within, leave - stay - within, enter - stay - within
        from_first, last = total.max(0) + first, np.take_along_axis(ahead, sizes[None] - 1, 0)[0] + max(final, final + leave - stay)
        for w in np.flatnonzero(np.maximum(ahead.max(0) + inner, np.maximum(from_first, last)) > 0).tolist():
            n = int(sizes[w])
            sums = np.concatenate([[0.0], total[:n, w]])
            behind = np.maximum.accumulate(sums[::-1])[::-1][1:] - sums[:-1]  # the best sum from each place on
            through = ahead[:n, w] + behind - over[:n, w]
            at = np.flatnonzero(through + max(inner, first, final) > 0)
            low, high = max(0, int(at[0]) - 1), min(n, int(at[-1]) + 2)
            yield w, low, np.ascontiguousarray(e[:, low:high, w].T), low > 0, high < n

    def decoded(self, crops: list[tuple[np.ndarray, bool, bool]]) -> list[np.ndarray]:
        """The best path of each (emissions, O before, O after)."""
        tr, out = self.p["T"], [np.empty(0, np.int64)] * len(crops)
        order = sorted(range(len(crops)), key=lambda i: len(crops[i][0]))
        for group in (order[i : i + 64] for i in range(0, len(order), 64)):
            sizes = np.array([len(crops[i][0]) for i in group])
            n, length = len(group), int(sizes[-1])
            e = np.zeros((length, n, TAGS), np.float32)
            for k, i in enumerate(group):
                e[: sizes[k], k] = crops[i][0]
            score = e[0].copy()
            score[:, 2::2] = -1e4  # no text begins within a span
            score[[k for k, i in enumerate(group) if crops[i][1]], 1:] = -1e4
            back = np.empty((length, n, TAGS), np.int64)
            last = score.copy()
            for k in range(1, length):
                ways = score[:, None, :] + tr.T
                back[k] = ways.argmax(2)
                score = np.take_along_axis(ways, back[k][:, :, None], 2)[:, :, 0] + e[k]
                ending = sizes == k + 1
                last[ending] = score[ending]
            last[[k for k, i in enumerate(group) if crops[i][2]], 1:] -= np.float32(1e4)
            tags, at, rows = np.zeros((length, n), np.int64), last.argmax(1), np.arange(n)
            for k in range(length - 1, -1, -1):
                here = k < sizes
                tags[k] = np.where(here, at, 0)
                at = np.where(here, back[k, rows, at], at) if k else at
            for k, i in enumerate(group):
                out[i] = tags[: sizes[k], k]
        return out

    def spans(self, texts: Sequence[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each text's spans, in order."""
        coded = [char_classes(t) for t in texts]
        windows = [(i, s, min(WINDOW, len(c) - s)) for i, c in enumerate(coded) for s in range(0, max(1, len(c) - OVERLAP), WINDOW - OVERLAP) if len(c)]
        windows.sort(key=lambda w: -w[2])
        places, crops = [], []
        for low in range(0, len(windows), _AT_ONCE):
            own = windows[low : low + _AT_ONCE]
            sizes = np.array([w[2] for w in own])
            x = np.zeros((len(own), int(sizes[0])), np.int64)
            for k, (i, s, n) in enumerate(own):
                x[k, :n] = coded[i][s : s + n]
            for k, start, e, before, after in self.crops(self.emissions(x, sizes), sizes):
                places.append((own[k][0], own[k][1], own[k][1] + start))
                crops.append((e, before, after))
        found: list[list[Piece]] = [[] for _ in texts]
        for (i, window, s), (e, _, _), tags in zip(places, crops, self.decoded(crops)):
            for b in np.flatnonzero(tags % 2 == 1).tolist():
                end = b + 1
                while end < len(tags) and tags[end] == tags[b] + 1:
                    end += 1
                found[i].append((window, s + b, s + end, int(tags[b]) // 2, e[np.arange(b, end), tags[b:end]] - e[b:end, 0]))
        return [reconciled(joined(f, len(c))) for f, c in zip(found, coded)]


#: Start of the window, start, end, kind, and the margin over O of each character.
Piece = tuple[int, int, int, int, np.ndarray]


def joined(found: list[Piece], length: int) -> list[tuple[float, int, int, int]]:
    """(margin, start, end, kind) of the spans of a text of `length`, with the parts of one span in neighbouring windows made one.

    Overlapping pieces of two neighbours are parts of one span if one of them is cut by its window's end
    and they are of one kind, or the other window can't hold the cut one. A joined span reaches from the
    first character of its parts to the last, has the kind of the greatest margin, and counts a
    character that two windows saw once, by the greater margin.
    """
    by_window: dict[int, list[int]] = {}
    for i, f in enumerate(found):
        by_window.setdefault(f[0], []).append(i)
    group = list(range(len(found)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for window in sorted(by_window):
        after = window + WINDOW - OVERLAP
        end = min(window + WINDOW, length)
        for i in by_window[window]:
            if found[i][2] <= after:
                continue
            for j in by_window.get(after, ()):
                (_, s, e, kind, _), (_, t, u, other, _) = found[i], found[j]
                if s < u and t < e:
                    left, right = e == end < length, t == after
                    if (left or right) and kind == other or left and s < after or right and u > end:
                        group[root(j)] = root(i)
    parts: dict[int, list[Piece]] = {}
    for i, f in enumerate(found):
        parts.setdefault(root(i), []).append(f)
    out = []
    for own in parts.values():
        if len(own) == 1:
            _, s, e, kind, gains = own[0]
            out.append((float(gains.sum()), s, e, kind))
            continue
        start, end = min(f[1] for f in own), max(f[2] for f in own)
        best, kinds = np.full(end - start, -np.inf), np.zeros(len(KINDS))
        for _, s, e, kind, gains in own:
            best[s - start : e - start] = np.maximum(best[s - start : e - start], gains)
            kinds[kind] += gains.sum()
        out.append((float(best.sum()), start, end, int(kinds.argmax())))
    return out


def reconciled(found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, str]]:
    """The spans of greatest total margin that don't overlap, from (margin, start, end, kind)."""
    if not found:
        return []
    found = sorted({(e, s, m, k) for m, s, e, k in found if m > MARGIN})
    ends = [f[0] for f in found]
    best: list[tuple[float, tuple]] = [(0.0, ())]
    for i, (end, start, margin, kind) in enumerate(found):
        before = int(np.searchsorted(ends[:i], start, "right"))
        take = best[before][0] + margin
        best.append((take, (before, i)) if take > best[i][0] else (best[i][0], (i, None)))
    out, at = [], len(found)
    while at:
        at, i = best[at][1]
        if i is not None:
            out.append((found[i][1], found[i][0], KINDS[found[i][3]]))
    return out[::-1]


# ---------------------------------------------------------------- operator


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """A tagger with lines of at most `sample` distinct texts, those of least hash, as background."""
    picked = least_hashes(docs.select("text").filter("text IS NOT NULL"), sample).collect()
    lines = [x for text in sorted(r["text"] for r in picked) for x in text.split("\n")]
    return Tagger.trained(*examples(lines))


def find_spans(model: Tagger):
    """A column function: text to array of (start, end, kind)."""
    p = model.p

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Tagger(p)
        for column in batches:
            texts = column.to_pylist()
            out: list = []
            for low, high in pieces([len(t or "") for t in texts], _TEXT_CHARS):
                out += own.spans([t or "" for t in texts[low:high]])
            trim()
            yield pa.array([None if t is None else [{"start": s, "end": e, "kind": k} for s, e, k in own] for t, own in zip(texts, out)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    return F.arrow_udf(run, kind).asNondeterministic()


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """`docs` with each span in text replaced by its kind in brackets; a last column, pii_spans, has the spans in the old text."""
    lean(docs.sparkSession)
    model = model or train(docs)
    spans = spare_name(docs, "pii_spans")
    out = docs.withColumn(spans, find_spans(model)("text"))
    # from the last span to the first, so that places before it hold
    text = F.aggregate(F.reverse(F.col(spans)), F.col("text"), lambda t, s: F.concat(t.substr(F.lit(1), s["start"]), F.lit("["), s["kind"], F.lit("]"), t.substr(s["end"] + 1, F.length(t))))
    text = F.when(F.size(spans) > 0, text).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns], F.col(spans))


def redact_documents(docs: DataFrame) -> DataFrame:
    return redact(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(documents(spark, sf_dir))
