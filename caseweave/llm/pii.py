"""Personal data: base patterns, and a character BiLSTM with CRF transitions trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, id_and_text, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, number of the kind, end

# -- the base patterns -------------------------------------------------------------------------

TRIGGER = re.compile("[0-9@]")
AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where its run of digits does: one that begins later fails where that failed.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return not (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ in turn, with the run of local characters before it: linear in any text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = AFTER_AT.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def octet(part: str) -> bool:
    """Whether digits, however many of them are leading zeros, are 255 at most."""
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str | None) -> list[Span]:
    """(start, kind, end) by start, then kind; leftmost and non-overlapping within a kind."""
    if not text or not TRIGGER.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 14 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


# -- the model ---------------------------------------------------------------------------------

WINDOW, STRIDE, AROUND = 96, 48, 24
#: Characters of a window to train on; the model is the same at any length.
TRAINED = 64
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SINGLES = "@.-+()_:/,%#$\"'=\n "
PAD = len(SINGLES) + 5


def class_table() -> np.ndarray:
    """The class of each code point below 256; the others are letters or not."""
    table = np.full(256, len(SINGLES) + 4, np.int8)
    for code in range(256):
        c = chr(code)
        table[code] = SINGLES.index(c) if c in SINGLES else len(SINGLES) + (0 if "0" <= c <= "9" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isalpha() else 4)
    return table


CLASS = class_table()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 256, CLASS[np.minimum(codes, 255)], len(SINGLES) + 3).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """w: for both directions the input tables x (2, class, gates) and the recurrent matrices h; the
    outputs o with their bias; the CRF's transitions t."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        w = {"x": normal(2, PAD + 1, 4 * hidden), "h": normal(2, hidden, 4 * hidden), "o": normal(2 * hidden, TAGS)}
        w["x"][:, :, hidden : 2 * hidden] += 1  # remember at first
        return Tagger(w | {"bias": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)})

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(T, B, 2H): the states of both directions at each place of windows (T, B)."""
        table, recurrent = self.w["x"], self.w["h"]
        steps, rows, n = len(x), x.shape[1], recurrent.shape[1]
        both, direction = np.stack([x, x[::-1]], axis=1), np.arange(2)[:, None]
        out = np.empty((steps, 2, rows, n), table.dtype)
        h = c = np.zeros((2, rows, n), table.dtype)
        for t in range(steps):
            z = table[direction, both[t]] + h @ recurrent
            gates = sigmoid(z[:, :, : 3 * n])
            g = np.tanh(z[:, :, 3 * n :])
            before = c, h
            c = gates[:, :, n : 2 * n] * c + gates[:, :, :n] * g
            squash = np.tanh(c)
            out[t] = h = gates[:, :, 2 * n :] * squash
            if keep is not None:
                keep.append((t, *before, gates, g, squash))
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.states(x) @ self.w["o"] + self.w["bias"]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the tags y (T, B) and its gradient."""
        steps, rows = x.shape
        keep: list = []
        states = self.states(x, keep)
        e, trans = states @ self.w["o"] + self.w["bias"], self.w["t"]
        alpha, beta, total = forward_backward(e, trans)
        place, at = np.ogrid[:steps, :rows]
        gold = e[place, at, y].sum(axis=0) + trans[y[:-1], y[1:]].sum(axis=0)
        de = np.exp(alpha + beta - total[None, :, None])
        de[place, at, y] -= 1
        dt = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]).sum(axis=(0, 1))
        np.add.at(dt, (y[:-1].ravel(), y[1:].ravel()), -1)
        grads = {"t": dt, "o": np.einsum("tbh,tbk->hk", states, de), "bias": de.sum(axis=(0, 1))}
        ds = de @ self.w["o"].T
        recurrent = self.w["h"]
        n = recurrent.shape[1]
        own = np.stack([ds[:, :, :n], ds[::-1, :, n:]], axis=1)
        before, dz = np.empty((2, steps, rows, n), e.dtype), np.empty((2, steps, rows, 4 * n), e.dtype)
        dh = dc = np.zeros((2, rows, n), e.dtype)
        for t, c0, h0, gates, g, squash in reversed(keep):
            dh = dh + own[t]
            i, f, o = gates[:, :, :n], gates[:, :, n : 2 * n], gates[:, :, 2 * n :]
            dc = dc + dh * o * (1 - squash * squash)
            before[:, t] = h0
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * squash * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dh, dc = dz[:, t] @ recurrent.transpose(0, 2, 1), dc * f
        flat = dz.reshape(2, steps * rows, -1)
        one_hot = (np.stack([x, x[::-1]]).reshape(2, -1, 1) == np.arange(PAD + 1)).astype(e.dtype)
        grads["x"] = one_hot.transpose(0, 2, 1) @ flat
        grads["h"] = before.reshape(2, steps * rows, -1).transpose(0, 2, 1) @ flat
        return float((total - gold).mean()), {name: g / rows for name, g in grads.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam over windows (N, T); returns each epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        step, losses = 0, []
        for epoch in range(epochs):
            total = []
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                loss, grads = self.gradient(np.ascontiguousarray(x[part].T), np.ascontiguousarray(y[part].T))
                total.append(loss)
                step += 1
                now = rate * (1 - epoch / (epochs + 1))
                for k, g in grads.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.98 * v[k] + 0.02 * g * g
                    self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """(T, B, TAGS): the probability of each tag at each place of windows (T, B)."""
        alpha, beta, total = forward_backward(self.emissions(x), self.w["t"])
        return np.exp(alpha + beta - total[None, :, None])


def forward_backward(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CRF's (alpha, beta, total): logarithms of the sums over all paths up to a tag, after it, and
    over whole paths, from emissions (T, B, TAGS)."""
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, len(e)):
        alpha[t] = e[t] + log_sum(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(len(e) - 2, -1, -1):
        beta[t] = log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    return alpha, beta, log_sum(alpha[-1], 1)


def log_sum(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis=axis, keepdims=True)
    return top.squeeze(axis) + np.log(np.exp(v - top).sum(axis=axis))


def best_tags(p: np.ndarray) -> np.ndarray:
    """(T, B) tags of the highest product of probabilities (T, B, TAGS) among the sequences in which an
    inside tag follows a tag of its own kind."""
    allowed = np.full((TAGS, TAGS), -np.inf, np.float32)
    allowed[:, 0] = allowed[:, 1::2] = 0
    for k in range(2, TAGS, 2):
        allowed[k - 1, k] = allowed[k, k] = 0
    e = np.log(np.maximum(p, 1e-9))
    score = e[0] + allowed[0]
    back = np.empty(p.shape, np.int8)
    for t in range(1, len(e)):
        paths = score[:, :, None] + allowed
        back[t] = paths.argmax(axis=1)
        score = paths.max(axis=1) + e[t]
    tags = np.empty(p.shape[:2], np.int64)
    tags[-1] = score.argmax(axis=1)
    at = np.arange(p.shape[1])
    for t in range(len(e) - 1, 0, -1):
        tags[t - 1] = back[t, at, tags[t]]
    return tags


def tags_of(size: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(size, np.int64)
    for start, kind, end in spans:
        a, b = max(0, start), min(size, end)
        if a < b and not y[a:b].any():
            y[a:b] = 2 + 2 * kind
            if start >= 0:
                y[start] = 1 + 2 * kind
    return y


# -- labelled examples -------------------------------------------------------------------------


def invented(rng: np.random.Generator, kind: int) -> str:
    """A made-up value of the kind, in one of the forms people write."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9)))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    if kind == 0:
        return word() + pick("", ".", "_", "-") + pick(word(), number(2)) + pick("@", "@", "@", " @ ") + word() + pick(".", ".", "-" + word() + ".") + pick("com", "org", "net", "de", "co.uk", "example")
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        body = str(rng.integers(3, 7)) + number(rng.choice([12, 14, 14, 14, 15]))
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        gap = pick("", "", " ", "-", ".")
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    sep = pick(" ", "-", ".")
    area = pick(f"({number(3)}) ", number(3) + sep, f"0{number(2)}{sep}")
    return pick(f"+{rng.integers(1, 100)} ", f"+{rng.integers(1, 100)}", "", "") + area + number(3) + sep + number(4)


def harmless(rng: np.random.Generator) -> str:
    """Something with digits or an @ that is no personal data."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    forms = (
        lambda: f"{rng.integers(1700, 2100)}", lambda: f"{rng.integers(1, 32)}.{rng.integers(1, 13)}.{rng.integers(1900, 2100)}",
        lambda: f"{rng.integers(1900, 2100)}-{number(2)}-{number(2)}", lambda: f"{rng.integers(1, 1000)},{number(3)}.{number(2)}",
        lambda: f"${rng.integers(1, 900)}.{number(2)}", lambda: f"v{rng.integers(0, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}",
        lambda: f"{number(2)}:{number(2)}", lambda: "".join(rng.choice(list("0123456789abcdef"), rng.integers(16, 41))),
        lambda: number(rng.integers(1, 7)), lambda: number(rng.integers(7, 13)), lambda: number(rng.integers(17, 30)), lambda: f"@{''.join(rng.choice(list('abcdefg'), 6))}",
        lambda: f"{number(2)}-{number(2)}", lambda: f"[{number(1)}]", lambda: f"{number(3)}/{number(2)}", lambda: f"{number(2)} %",
    )
    return forms[rng.integers(len(forms))]()


#: What stands before and after a value.
GLUE = ((" ", " ", " ", " (", ": ", "\n", "=", "<"), (" ", " ", " ", ", ", ". ", ")", "\n", ">", ";"))


def examples(contexts: list[str], n: int, seed: int = 0, width: int = TRAINED) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, width) of classes and tags: labelled values set into contexts of plain text."""
    rng = np.random.default_rng(seed)
    x, y = np.full((n, width), PAD, np.int64), np.zeros((n, width), np.int64)
    contexts = [c for c in contexts if len(c) > 20] or ["the words of a text stand around what is to be found, and end here."]
    for i in range(n):
        context = contexts[rng.integers(len(contexts))]
        at = int(rng.integers(0, len(context)))
        before, after = context[max(0, at - width) : at], context[at : at + width]
        kind = int(rng.integers(-3, len(KINDS)))
        value = invented(rng, kind) if kind >= 0 else harmless(rng)
        glue = [GLUE[i][int(rng.integers(len(GLUE[i])))] for i in range(2)]
        whole = before + glue[0] + value + glue[1] + after
        start = len(before) + len(glue[0])
        shift = max(0, start - int(rng.integers(0, width - min(len(value), width - 1))))
        part = whole[shift : shift + width]
        spans = base_spans(part)
        if kind >= 0:
            spans = [s for s in spans if s[2] <= start - shift or s[0] >= start - shift + len(value)] + [(start - shift, kind, start - shift + len(value))]
        x[i, : len(part)], y[i, : len(part)] = classes(part), tags_of(len(part), spans)
    return x, y


def learn(docs: DataFrame, sample: int = 1500, windows: int = 2400, epochs: int = 8, hidden: int = 32, seed: int = 0) -> Tagger:
    """Train on about `sample` documents at most, chosen by a hash of doc_id.

    An executor cuts one plain window from each sampled document, and up to two around spans that the
    base patterns label; the driver sees those windows only. Labelled spans are values invented in
    `windows` plain windows, in forms that the base patterns miss too, and what the base patterns find
    in up to a sixth as many of the others, taken by their hash. An empty sample leaves the invented
    ones in a fixed context.
    """
    slim = id_and_text(docs).where("text is not null")
    share = min(1.0, sample / max(1, slim.count()))
    chosen = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = []
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    at = ((i or 0) * 7919) % max(1, len(text) - WINDOW)
                    found.append((text[at : at + 2 * WINDOW], False))
                    for start, _, end in base_spans(text)[:2]:
                        at = max(0, (start + end - TRAINED) // 2)
                        found.append((text[at : at + TRAINED], True))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())], names=["window", "labelled"])

    order = lambda r: (xxhash.xxh64_intdigest(r.window, seed), r.window)
    rows = [(r.labelled, r.window) for r in sorted(chosen.mapInArrow(cut, "window string, labelled boolean").collect(), key=order)]
    x, y = examples([w for labelled, w in rows if not labelled], windows, seed)
    known = [w for labelled, w in rows if labelled][: windows // 6]
    more = np.full((len(known), TRAINED), PAD, np.int64), np.zeros((len(known), TRAINED), np.int64)
    for i, w in enumerate(known):
        more[0][i, : len(w)], more[1][i, : len(w)] = classes(w), tags_of(len(w), base_spans(w))
    tagger = Tagger.fresh(hidden, seed)
    tagger.train(np.concatenate([x, more[0]]), np.concatenate([y, more[1]]), epochs, seed=seed)
    return tagger


# -- decoding of whole texts -------------------------------------------------------------------

#: The mean probability per character that a span found by the model must have.
LEAST = 0.9
#: Windows that are decoded together, and places of the regions that are.
TOGETHER, PLACES = 1024, 1 << 17


def plausible(kind: int, value: str) -> bool:
    """What any span of the kind must satisfy, however it was found."""
    digits = digits_of(value)
    if kind == 0:
        return "@" in value.strip("@ ") and "." in value
    if kind == 1:
        parts = value.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(digits) >= len(value) * 0.7
    return 9 <= len(digits) <= 15 and len(digits) >= len(value) * 0.6 and all(c in "0123456789+-(). " for c in value) and any(c in "+-(). " for c in value)


def windows_of(text: str) -> list[int]:
    """Begins of the windows: they cover every stretch around a digit or an @, each overlapping the
    next by half. Elsewhere no kind can occur, as each holds a digit or an @."""
    begins: list[int] = []
    end = -1
    for m in TRIGGER.finditer(text):
        if m.start() + AROUND > end:
            begin = max(m.start() - AROUND, begins[-1] + STRIDE) if begins and m.start() - AROUND <= end else max(0, m.start() - AROUND)
            begins.append(begin)
            end = begin + WINDOW
            while end < m.start() + AROUND and end < len(text):
                begins.append(begins[-1] + STRIDE)
                end = begins[-1] + WINDOW
    return begins


def probabilities(tagger: Tagger, texts: list[str], where: list[tuple[int, int]]) -> list[np.ndarray]:
    """The tag probabilities (T, TAGS) of each window (text, begin), as far as its text goes."""
    out = []
    for k in range(0, len(where), TOGETHER):
        part = where[k : k + TOGETHER]
        x = np.full((WINDOW, len(part)), PAD, np.int64)
        for i, (d, b) in enumerate(part):
            piece = texts[d][b : b + WINDOW]
            x[: len(piece), i] = classes(piece)
        p = tagger.marginals(x)
        out += [p[: len(texts[d]) - b, i] for i, (d, b) in enumerate(part)]
    return out


def regions(found: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(begin, probabilities) of each stretch that windows cover without a gap, from those of a text's
    windows by their begins. A place takes what the window says in which it is furthest from an edge."""
    out: list[tuple[int, np.ndarray]] = []
    part: list[int] = []
    begins = sorted(found)
    for i, b in enumerate(begins):
        part.append(b)
        if i + 1 < len(begins) and begins[i + 1] <= b + len(found[b]):
            continue
        first, end = part[0], b + len(found[b])
        merged, depth = np.empty((end - first, TAGS), np.float32), np.full(end - first, -1)
        for w in part:
            p = found[w]
            own = np.minimum(np.arange(len(p)), np.arange(len(p))[::-1])
            places = np.arange(w - first, w - first + len(p))
            deeper = own > depth[places]
            merged[places[deeper]], depth[places[deeper]] = p[deeper], own[deeper]
        out.append((first, merged))
        part = []
    return out


def decoded(stretches: list[np.ndarray]) -> list[np.ndarray]:
    """The best tags of each stretch; those of similar length are decoded together."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(stretches)
    order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
    while order:
        longest = len(stretches[order[-1]])
        n = max(1, PLACES // max(1, longest))
        part, order = order[-n:], order[:-n]
        p = np.zeros((longest, len(part), TAGS), np.float32)
        p[:, :, 0] = 1
        for k, i in enumerate(part):
            p[: len(stretches[i]), k] = stretches[i]
        tags = best_tags(p)
        for k, i in enumerate(part):
            out[i] = tags[: len(stretches[i]), k]
    return out


def model_spans(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """Per text the spans that the model finds.

    The windows' probabilities are put together per place, and each stretch of overlapping windows is
    decoded as one, so a span may be longer than a window. Where a stretch begins or ends inside a span
    and the text goes on, windows are added on that side, twice as many every time, until it doesn't.
    """
    found: list[dict[int, np.ndarray]] = [{} for _ in texts]
    new = [(d, b) for d, t in enumerate(texts) for b in windows_of(t)]
    settled: list[list[Span]] = [[] for _ in texts]
    touched, more = {d for d, _ in new}, 1
    while new:
        for (d, b), p in zip(new, probabilities(tagger, texts, new)):
            found[d][b] = p
        stretches = [(d, b, p) for d in sorted(touched) for b, p in regions(found[d])]
        new, touched = [], set()
        spans: dict[int, list[Span]] = {d: [] for d, _, _ in stretches}
        for (d, b, p), tags in zip(stretches, decoded([p for _, _, p in stretches])):
            end = b + len(tags)
            before = range(max(0, b - STRIDE * more), b, STRIDE) if tags[0] and b else ()
            after = range(end - STRIDE, min(len(texts[d]) - 1, end - STRIDE + STRIDE * more), STRIDE) if tags[-1] and end < len(texts[d]) else ()
            added = [(d, w) for w in (*before, *after) if w not in found[d]]
            new += added
            touched |= {w for w, _ in added}
            spans[d] += spans_in(tags, p, b)
        for d, x in spans.items():
            settled[d] = x
        more *= 2
    return settled


def spans_in(tags: np.ndarray, p: np.ndarray, begin: int) -> list[Span]:
    """The spans of the tags whose mean probability is LEAST at least."""
    out = []
    starts = np.flatnonzero(tags % 2 == 1)
    for start in starts.tolist():
        end = start + 1
        while end < len(tags) and tags[end] == tags[start] + 1:
            end += 1
        if p[np.arange(start, end), tags[start:end]].mean() >= LEAST:
            out.append((begin + start, int(tags[start] - 1) // 2, begin + end))
    return out


def whole_words(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without white space at its ends and with the runs of letters and digits it cuts."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    while 0 < start < end and text[start].isalnum() and text[start - 1].isalnum():
        start -= 1
    while start < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    return start, end


def all_spans(tagger: Tagger | None, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
    """Per text (start, kind, end, base), sorted: the base spans, and those of the model that are
    plausible and overlap none of them."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    more = model_spans(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, own, extra in zip(texts, base, more):
        spans = [(*s, True) for s in own]
        for start, kind, end in extra:
            start, end = whole_words(text, start, end)
            if start < end and plausible(kind, text[start:end]) and not any(s < end and start < e for s, _, e in own):
                spans.append((start, kind, end, False))
        out.append(sorted(spans))
    return out


def find(docs: DataFrame, tagger: Tagger | None = None, **options) -> DataFrame:
    """(doc_id, found): found is an array of (kind, start, end, base) by start, then kind.

    The model is trained on a bounded sample of the documents unless one is given; it is a few
    thousand numbers and goes out with the task. Offsets are code points, end exclusive.

    A null or empty text has no spans; repeated rows and rows without an id are returned as often as
    they come; an empty table gives an empty result. Texts of any length are read whole, in linear
    time; there is no shuffle.
    """
    tagger = tagger or learn(docs, **options)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    schema = pa.schema([("doc_id", pa.int64()), ("found", kind)])

    def rows(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "found": [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in spans] for spans in all_spans(tagger, texts)]}

    return id_and_text(docs).mapInArrow(by_text(schema, rows), "doc_id long, found array<struct<kind: string, start: long, end: long, base: boolean>>")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of find; the counts are of base spans."""
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
