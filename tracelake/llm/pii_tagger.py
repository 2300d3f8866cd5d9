"""Personal data: base patterns and a character BiLSTM with CRF transitions, trained in numpy.

The base finds strict spans by pattern (`base_spans`); they always stay.  The tagger adds looser forms: it is a
bidirectional LSTM over characters with a CRF over B/I tags per kind.  It is trained from labelled spans of two sources: texts
that `examples` generates (seeded; strict and loose forms, and look-alikes that are no personal data), and stretches of at most about
SAMPLED documents that are not held out (`stretch_examples`), labelled by their base spans, as they stand and with each span rewritten
into a loose form (`loosened`); whatever else holds digits there is a look-alike to it.
A text is decoded around its seeds, the characters every labelled form holds (an ASCII digit, `@`, or an at-word in
brackets): stretches of REACH characters around seeds, up to the ends of words, are covered by overlapping windows of WINDOW
characters, each scored by the network; a character's scores are averaged over its windows by closeness to their
middle, and one Viterbi pass over the whole stretch reconciles them.  A span that is tagged is added if it overlaps no base span
and its digits are what its kind means (`sound`: Luhn and the number of digits, parts of an address up to 255); its form is the tagger's to judge.

Whole texts are scanned; everything is a map; the weights (a few thousand numbers) are broadcast.  A long
stretch is scored and decoded as a stream: what is kept of it are its characters and 9 bytes of back pointers for each.
Training takes seconds.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive; the spans of
one place are ordered by kind (email, ip, card, phone); repeated rows give repeated results; the counts and
base_sha256 are of the base spans, `spans` of all.  An empty table trains on the generated texts alone.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import documents, held_out, small_batches
from tracelake.llm.textbytes import chunks

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP, REACH = 48, 24, 36
EMBED, HIDDEN = 10, 14
TAGS = 1 + 2 * len(KINDS)  # outside, then B and I of each kind
CHUNK_BYTES = 4 << 20
#: Documents to learn from, and stretches of them, at most (about).
SAMPLED, STRETCHES = 3000, 700
#: Windows scored at once.
BATCH = 512

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: Lookbehind and possessive repeats keep the scan linear; no match is lost, as a run of digits never ends within a match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]|[(\[]\s?at\s?[)\]]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


# ---- base ----------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the strict patterns, by start, then kind."""
    out = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if found and start < at:
            out.append((start, found.end(), 0))
            at = done = found.end()
        else:
            # what stands before this sign can't be part of a later local part
            at += 1
            done = at
    if _ANY_DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


_ANY_DIGIT = re.compile(r"[0-9]")


# ---- labelled examples -----------------------------------------------------------------------------------------------


def examples(count: int = 900, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with labelled spans."""
    rng = np.random.default_rng(seed)

    def pick(items):
        return items[int(rng.integers(len(items)))]

    def letters(low, high):
        return "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(low, high + 1))))

    def number(n):
        return "".join(str(int(d)) for d in rng.integers(0, 10, n))

    def card():
        body = pick("3456") + number(int(rng.integers(13, 16)))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def spaced(digits, sep):
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def email():
        user = letters(3, 7) + pick(["", "." + letters(2, 5), "." + number(2), number(2)])
        host, top = letters(3, 8), pick(["com", "org", "net", "de", "example.com"])
        at, dot = pick([("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), ("[at]", ".")])
        return user + at + host + dot + top

    def phone():
        a, b, c = number(3), number(3), number(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])

    def look_alike():
        return pick(
            [
                number(int(rng.integers(1, 6))),
                "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(12, 40)))),
                f"{number(4)}-{number(2)}-{number(2)}",
                f"{number(1)}.{number(1)}.{number(1)}",
                f"{number(2)}:{number(2)}",
                letters(2, 4).upper() + number(6) + letters(2, 4).upper(),
                f"@{letters(3, 8)}",
                f"{number(2)},{number(3)}.{number(2)}",
                f"v{number(1)}.{number(2)}",
            ]
        )

    out = []
    for _ in range(count):
        text, spans = " ".join(letters(1, 9) for _ in range(int(rng.integers(1, 4)))), []
        for _ in range(int(rng.integers(1, 3))):
            kind = int(rng.integers(0, 7))
            made = (email, lambda: ".".join(str(int(x)) for x in rng.integers(0, 256, 4)), lambda: spaced(card(), pick(["", " ", "-"])), phone)[kind]() if kind < 4 else look_alike()
            text += pick([" ", " ", ": ", ", ", "\n"])
            if kind < 4:
                spans.append((len(text), len(text) + len(made), kind))
            text += made + pick([" ", " ", ", ", ". "]) + " ".join(letters(1, 9) for _ in range(int(rng.integers(1, 4))))
        out.append((text, spans))
    return out


def loosened(text: str, kind: int, rng) -> str:
    """A strict span in a form that the patterns do not know."""

    def pick(items):
        return items[int(rng.integers(len(items)))]

    digits = _digits(text)
    if kind == 0:
        user, _, domain = text.partition("@")
        at, dot = pick([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" @ ", ".")])
        return user + at + domain.replace(".", dot)
    if kind == 1:
        return text.replace(".", pick([" . ", ",", "[.]", ". "]))
    if kind == 2:
        return pick([".", "/", "  ", "_", "\u00a0"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, mid, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick([f"({area}) {mid}-{last}", f"({area}) {mid} {last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"001 {area} {mid} {last}", f"1 ({area}) {mid}-{last}"])


def stretch_examples(texts: list[str], count: int = STRETCHES, seed: int = 13) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most `count` labelled stretches of texts and as many with their spans loosened."""
    found = []
    for text in texts:
        base = base_spans(text)
        for a, b in stretches(text):
            if b - a <= 4 * WINDOW:
                found.append((text[a:b], [(x - a, y - a, k) for x, y, k in base if a <= x and y <= b]))
    rng = np.random.default_rng(seed)
    out = []
    for i in rng.permutation(len(found))[:count].tolist():
        text, spans = found[i]
        # of overlapping spans the first is the label
        spans = [s for n, s in enumerate(spans) if all(s[0] >= t[1] for t in spans[:n])]
        out.append((text, spans))
        if spans:
            made, moved, at = "", [], 0
            for x, y, k in spans:
                made += text[at:x]
                loose = loosened(text[x:y], k, rng)
                moved.append((len(made), len(made) + len(loose), k))
                made, at = made + loose, y
            out.append((made + text[at:], moved))
    return out


# ---- the network -----------------------------------------------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, everything else 127."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(raw, 127).astype(np.uint8)


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Tagger:
    """Weights of the BiLSTM and the CRF."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = {"embed": rng.normal(0, 0.3, (128, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for side in "fb":
            self.w["x" + side] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
            self.w["h" + side] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
            self.w["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.allowed = np.ones((TAGS, TAGS), bool)  # an I tag follows only B or I of its kind
        for kind in range(len(KINDS)):
            inside = 2 + 2 * kind
            self.allowed[:, inside] = False
            self.allowed[[inside - 1, inside], inside] = True

    def _lstm(self, x, side, keep):
        """One direction over x (steps, batch, EMBED): hidden states and, when training, what the gradient needs."""
        gates_x = x @ self.w["x" + side] + self.w["c" + side]
        h = c = np.zeros((x.shape[1], HIDDEN))
        out, tape = np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            gates = gates_x[t] + h @ self.w["h" + side]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * g
            tanh_c = np.tanh(c)
            h = o * tanh_c
            out[t] = h
            if keep:
                tape.append((t, i, f, o, g, before, c_before, tanh_c))
        return out, tape

    def emissions(self, chars: np.ndarray, keep: bool = False):
        """Tag scores (steps, batch, TAGS) of windows of character classes (batch, steps)."""
        x = self.w["embed"][chars.T]
        front, tape_f = self._lstm(x, "f", keep)
        back, tape_b = self._lstm(x, "b", keep)
        both = np.concatenate([front, back], 2)
        return both @ self.w["out"] + self.w["bias"], (x, both, tape_f, tape_b)

    def _moves(self):
        return np.where(self.allowed, self.w["move"], -1e4)

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of one stretch (steps, TAGS)."""
        decoder = Decoder(self)
        decoder.feed(scores)
        return decoder.path()

    def gradients(self, chars, tags, mask):
        """Negative log-likelihood per window and its gradients; tags and mask are (batch, steps)."""
        emit, (x, both, tape_f, tape_b) = self.emissions(chars, True)
        steps, batch, _ = emit.shape
        moves, y, on = self._moves(), tags.T, mask.T
        rows = np.arange(batch)
        alpha = [emit[0] + self.w["start"]]
        for t in range(1, steps):
            a = alpha[-1][:, :, None] + moves
            top = a.max(1)
            now = top + np.log(np.exp(a - top[:, None]).sum(1)) + emit[t]
            alpha.append(np.where(on[t][:, None], now, alpha[-1]))
        top = alpha[-1].max(1)
        log_z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        beta = np.zeros((batch, TAGS))
        d_emit, d_move, d_start = np.zeros_like(emit), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        gold = emit[0, rows, y[0]] + self.w["start"][y[0]]
        for t in range(steps - 1, -1, -1):
            d_emit[t] = np.exp(alpha[t] + beta - log_z[:, None]) * on[t][:, None]
            if t:
                after = emit[t] + beta
                pair = np.exp(alpha[t - 1][:, :, None] + moves + after[:, None] - log_z[:, None, None]) * on[t][:, None, None]
                d_move += pair.sum(0)
                np.add.at(d_move, (y[t - 1][on[t]], y[t][on[t]]), -1.0)
                gold += np.where(on[t], emit[t, rows, y[t]] + moves[y[t - 1], y[t]], 0.0)
                b = moves + after[:, None]
                top = b.max(2)
                beta = np.where(on[t][:, None], top + np.log(np.exp(b - top[:, :, None]).sum(2)), beta)
            d_emit[t, rows, y[t]] -= on[t]
        d_start = d_emit[0].sum(0)
        grads = {"move": np.where(self.allowed, d_move, 0.0), "start": d_start, "bias": d_emit.sum((0, 1)), "out": np.tensordot(both, d_emit, ((0, 1), (0, 1)))}
        d_both = d_emit @ self.w["out"].T
        d_x = np.zeros_like(x)
        for side, tape, part in (("f", tape_f, d_both[:, :, :HIDDEN]), ("b", tape_b, d_both[:, :, HIDDEN:])):
            d_h, d_c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
            grads["h" + side], grads["x" + side], grads["c" + side] = np.zeros_like(self.w["h" + side]), np.zeros_like(self.w["x" + side]), np.zeros(4 * HIDDEN)
            for t, i, f, o, g, before, c_before, tanh_c in reversed(tape):
                d_h = d_h + part[t]
                d_c = d_c + d_h * o * (1 - tanh_c**2)
                gate = np.concatenate([d_c * g * i * (1 - i), d_c * c_before * f * (1 - f), d_h * tanh_c * o * (1 - o), d_c * i * (1 - g**2)], 1)
                grads["h" + side] += before.T @ gate
                grads["x" + side] += x[t].T @ gate
                grads["c" + side] += gate.sum(0)
                d_x[t] += gate @ self.w["x" + side].T
                d_h, d_c = gate @ self.w["h" + side].T, d_c * f
        grads["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(grads["embed"], chars.T, d_x)
        return float((log_z - gold).mean()), {k: v / batch for k, v in grads.items()}

    def fit(self, labelled, epochs: int = 14, batch: int = 64, rate: float = 0.02, seed: int = 5) -> float:
        """Adam on windows of labelled texts; returns the last epoch's mean loss."""
        chars, tags, mask = _training_windows(labelled)
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, losses = 0, [0.0]
        for epoch in range(epochs):
            losses = []
            order = rng.permutation(len(chars))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                loss, grads = self.gradients(chars[own], tags[own], mask[own])
                losses.append(loss)
                step += 1
                size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g**2 - second[k])
                    now = rate * (0.85**epoch)
                    self.w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return float(np.mean(losses))


class Decoder:
    """Viterbi over a stretch whose scores come in pieces; keeps one byte per character and tag."""

    def __init__(self, tagger: Tagger):
        self.moves, self.first = tagger._moves(), tagger.w["start"] + np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, 0.0)
        self.best, self.back = None, []

    def feed(self, scores: np.ndarray) -> None:
        back = np.zeros(scores.shape, np.int8)
        for t, row in enumerate(scores):
            if self.best is None:
                self.best = row + self.first
                continue
            step = self.best[:, None] + self.moves
            back[t] = step.argmax(0)
            self.best = step.max(0) + row
        self.back.append(back)

    def path(self) -> np.ndarray:
        back = np.concatenate(self.back)
        out = np.empty(len(back), np.int8)
        tag = int(self.best.argmax())
        for t in range(len(back) - 1, -1, -1):
            out[t] = tag
            tag = back[t, tag]
        return out


def _training_windows(labelled):
    chars, tags, mask = [], [], []
    for text, spans in labelled:
        code, tag = codes(text), np.zeros(len(text), np.int64)
        for a, b, kind in spans:
            tag[a:b] = 2 + 2 * kind
            tag[a] = 1 + 2 * kind
        for at in range(0, max(1, len(text) - STEP), STEP):
            piece, own = code[at : at + WINDOW], tag[at : at + WINDOW].copy()
            if own[0] and own[0] % 2 == 0:
                own[0] -= 1  # a window that starts inside a span takes it as begun here
            short = WINDOW - len(piece)
            chars.append(np.pad(piece, (0, short)))
            tags.append(np.pad(own, (0, short)))
            mask.append(np.arange(WINDOW) < len(piece))
    return np.array(chars), np.array(tags), np.array(mask)


@functools.cache
def trained(texts: tuple[str, ...] = ()) -> Tagger:
    """The tagger, trained on the generated examples and on stretches of the texts (once per process that asks)."""
    tagger = Tagger()
    tagger.fit(examples() + stretch_examples(list(texts)))
    return tagger


def train(docs: DataFrame, sampled: int = SAMPLED) -> Tagger:
    """Learn from a bounded sample of documents that are not held out, chosen by a hash of the id."""
    small_batches(docs.sparkSession)
    total = docs.count()
    ticket = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("pii")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.where(~held_out(F.col("doc_id")) & (ticket < sampled / max(1, total)))

    def run(batches):
        for batch in chunks(batches, CHUNK_BYTES):
            own = [t or "" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t[a:b] for t in own for a, b in stretches(t) if b - a <= 4 * WINDOW], pa.string())], names=["text"])

    found = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "text string")
    # `sampled` documents, about; their stretches come in any order, so the tie-free order by text makes reruns agree
    return trained(tuple(r["text"] for r in found.distinct().orderBy(F.xxhash64("text"), "text").limit(4 * STRETCHES).collect()))


# ---- decoding --------------------------------------------------------------------------------------------------------


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text around its seeds, from and to the ends of words."""
    out: list[list[int]] = []
    for m in _SEED.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and b <= out[-1][1]:
            continue
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = b
            continue
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def sound(text: str, kind: int) -> bool:
    """Whether the digits of a tagged span are what its kind means, whatever its form."""
    digits = _digits(text)
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 10 <= len(digits) <= 15


_AVERAGE = 1.0 + np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))


def tagged(tagger: Tagger, parts: list[str]):
    """Tags of the characters of each part, in order; parts are scored window by window, BATCH at a time, across their borders."""
    decoder, whole, tail = Decoder(tagger), None, None  # of the part at hand: its decoder, its length, the second half of its last window
    queue: list[tuple[np.ndarray, int, int]] = []  # window, its place in the part, the part's length

    def run():
        nonlocal decoder, tail
        emit, _ = tagger.emissions(np.array([w for w, _, _ in queue]))
        emit *= _AVERAGE[:, None, None]
        for k, (_, at, size) in enumerate(queue):
            own, weight = emit[:STEP, k], _AVERAGE[:STEP].copy()
            if at:
                own, weight = own + tail, weight + _AVERAGE[STEP:]
            tail = emit[STEP:, k]
            decoder.feed((own / weight[:, None])[: size - at])
            if at + STEP >= size - STEP:  # the last window: what follows is its second half alone
                decoder.feed((tail / _AVERAGE[STEP:, None])[: max(0, size - at - STEP)])
                yield decoder.path()
                decoder = Decoder(tagger)
        queue.clear()

    for part in parts:
        code = codes(part)
        for at in range(0, max(1, len(code) - STEP), STEP):
            piece = code[at : at + WINDOW]
            queue.append((np.pad(piece, (0, WINDOW - len(piece))), at, len(code)))
            if len(queue) >= BATCH:
                yield from run()
    if queue:
        yield from run()


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans the tagger finds in each text besides its base spans."""
    parts = [(n, a, b) for n, text in enumerate(texts) for a, b in stretches(text)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kinds = [[[s for s in own if s[2] == k] for k in range(len(KINDS))] for own in base]
    for (n, a, _), tags in zip(parts, tagged(tagger, [texts[n][a:b] for n, a, b in parts]), strict=True):
        for at in np.flatnonzero((tags > 0) & (tags % 2 == 1)).tolist():
            stop = at + 1
            while stop < len(tags) and tags[stop] == tags[at] + 1:
                stop += 1
            kind, piece = int(tags[at] - 1) // 2, texts[n][a + at : a + stop]
            start, end = a + at + len(piece) - len(piece.lstrip()), a + at + len(piece.rstrip())
            if not any(_meets(own, start, end) for own in kinds[n]) and sound(texts[n][start:end], kind):
                out[n].append((start, end, kind))
    return out


def _meets(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    """Whether [start, end) overlaps one of the spans, which are in order and apart: the last that begins before `end` tells."""
    at = bisect.bisect_left(spans, (end,))
    return at > 0 and spans[at - 1][1] > start


def joined_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def tag(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Per document: doc_id, counts of base spans, base_sha256, spans (all), n_added, n_spans (all)."""
    held = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def run(batches):
        tagger = held.value
        for batch in chunks(batches, CHUNK_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(tagger, texts, base)
            cols = [batch.column(0)]
            cols += [pa.array([sum(s[2] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            cols.append(pa.array([hashlib.sha256(joined_spans(own).encode()).hexdigest() for own in base]))
            cols.append(pa.array([joined_spans([*a, *b]) for a, b in zip(base, more, strict=True)]))
            cols.append(pa.array([len(own) for own in more], pa.int64()))
            cols.append(pa.array([len(a) + len(b) for a, b in zip(base, more, strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long, n_spans long")


def redact(text: str | None, tagger: Tagger | None = None) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if not text:
        return text
    base = base_spans(text)
    more = added_spans(tagger or trained(), [text], [base])[0]
    at, out = 0, []
    for a, b, k in sorted([*base, *more]):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op6_pii_tagger(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return tag(docs, train(docs))


QUERIES = {"op6_pii_tagger": op6_pii_tagger}
ORACLE_SQL: dict[str, str] = {}
