"""Personal data by patterns and a linear-chain conditional random field.

Patterns give the base spans. The field labels tokens by their shapes and those of their neighbours; it is
trained by its exact likelihood on a small labelled table and decoded by Viterbi, many stretches of tokens at
once. What it finds beside the base spans is added, if it passes the checks of its kind.

A stretch is decoded only where a path other than "outside" can win: by running sums of upper bounds, a token
that no such path can take in is known to be outside, and such tokens cut the chain without changing its best
path. Every token of every text takes part.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm.common import lean
from loomlake.llm.divergence import binary_parts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# What follows "@" decides about an address; the local part is the run of its characters before.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
FOUR = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def small_parts(parts: list[str]) -> bool:
    """Whether all numbers are at most 255; leading zeros don't count."""
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns, leftmost and not overlapping within a kind, those that fail their check left out.

    Each pattern is read in time linear in the text, whatever is in it.
    """
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, m.end(), "email"))
                last = m.end()
    if FOUR.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if small_parts(m[0].split("."))]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


# --- The labelled table -------------------------------------------------------------------------------------

# Fixed sentences of the labelled table; {kind} is replaced by an example of the kind, {x} by a number that is none.
SENTENCES = (
    "Write to {email} before noon.", "mail: {email}", "My address is {email}, ask for me.", "contact {email} or call {phone}", "Send it ({email}) today", "{email}", "e-mail {email};",
    "Call {phone} now.", "phone {phone}", "Tel. {phone}, fax {phone}", "My number is {phone}.", "reach me at {phone} or {email}", "{phone}", "the office ({phone}) is closed", "Mobile: {phone}", "{phone} {ip}", "he rang {phone} twice",
    "host {ip} is down", "ping {ip}", "from {ip} to {ip}", "login from {ip}, twice", "server at {ip}.", "{ip}", "address {ip} was blocked", "{ip} {phone}",
    "card {card} expires soon", "Pay with {card}.", "{card}", "charged to {card}, thanks", "visa {card} {x}", "{card} {card}",
    "It cost {x} dollars.", "In {x} they met.", "version {x} is out", "order {x} was sent", "see page {x} of {x}", "{x}", "chapter {x}: the end", "a total of {x} items, {x} sold", "score {x} against {x}", "room {x}, floor {x}",
    "look at the dot on the map", "they met at noon at the dot", "at home and at work", "the price is at {x} and up", "and then one dot more", "for the one that is in with them", "und die der das ist nicht", "le la les des une est dans", "el la los que una con para",
    "AT!! THE!! DOT.!! ON,!! WAS!! {x}!! IT!! A!!", "the*** at.&&& and%%% one,### dot$$$ in&&&", "| at | a | dot | in |", "A.!! B,!! C!! D.!!", "one@@ two## three$$ four%%", "==== at ==== dot ====", "( at ) and [ dot ]", "a: b, c; d - e / f", "key = \"{x}\"", "| {x} | {x} |", "a.b.c.d", "x@y", "@ {x}", "+ {x}", "id {x}-{x}", "sum {x} + {x} = {x}", "{x} {x} {x}", "the rest of it",
)
NAMES = ("anna", "j.smith", "maria_lopez", "tom", "info", "k-weber", "lee", "paul.martin", "office", "sara")
HOSTS = ("example", "mail", "web-shop", "uni", "work", "home", "post")
ENDS = ("com", "org", "net", "de", "fr", "es", "io", "co.uk")


def example(kind: str, r: random.Random) -> str:
    """One example, in the forms that patterns know and in others."""
    number = lambda *widths: [f"{r.randrange(10 ** (w - 1), 10**w)}" for w in widths]
    if kind == "email":
        a, b, c = r.choice(NAMES), r.choice(HOSTS), r.choice(ENDS)
        return r.choice((f"{a}{r.randrange(99)}@{b}.{c}", f"{a}@{b}.{c}", f"{a} (at) {b} (dot) {c}", f"{a} [at] {b} [dot] {c}", f"{a} (at) {b}.{c}", f"{a}[at]{b}[dot]{c}", f"{a} @ {b}.{c}", f"{a}(at){b}.{c}"))
    if kind == "ip":
        v4 = [str(r.randrange(1, 256)) for _ in range(4)]
        v6 = ":".join(f"{r.randrange(4096, 65536):x}" for _ in range(8))
        return r.choice((".".join(v4), ".".join(v4), "[.]".join(v4), v6, ".".join(v4)))
    if kind == "phone":
        a, b, c = number(3, 3, 4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"+{r.randrange(20, 99)} {a} {b}{c}", f"001 {a} {b} {c}", f"+1 (0{a[:2]}) {b}-{c}"))
    body = str(r.choice((4, 5))) + "".join(number(14))
    digits = body + next(str(d) for d in range(10) if luhn(body + str(d)))
    parts = [digits[i : i + 4] for i in (0, 4, 8, 12)]
    return r.choice((digits, digits, " ".join(parts), "-".join(parts), ".".join(parts), "/".join(parts)))


def number_of(r: random.Random) -> str:
    """A number that is no personal data."""
    n = r.randrange
    return r.choice((
        str(n(10)), str(n(100)), str(n(1000)), str(n(1900, 2100)), str(n(10**5)), str(n(10**7)), f"{n(99)}.{n(99)}", f"{n(99)}.{n(99)}.{n(99)}", f"{n(99)},{n(999):03}", f"{n(99)}%", f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}",
        f"{n(1, 29)}/{n(1, 13)}/{n(1990, 2030)}", f"{n(24)}:{n(10, 60)}", f"{n(1, 29)}.{n(1, 13)}.{n(1990, 2030)}", f"{n(1000)} {n(1000)}", f"${n(1000)}.{n(10, 99)}", f"{n(16**10):x}", f"{n(999)}-{n(999)}", f"(c) {n(1990, 2030)}", f"A{n(999)}", f"{n(99)}-{n(9999)}-{n(99)}",
    ))


def labelled_rows(rounds: int = 6, seed: int = 12) -> list[tuple[str, list[Span]]]:
    """Texts with their spans: every sentence `rounds` times, filled anew. It is the same table in every run."""
    r, out = random.Random(seed), []
    for _ in range(rounds):
        for s in SENTENCES:
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", s):
                if part == "{x}":
                    text += number_of(r)
                elif part.startswith("{"):
                    found = example(part[1:-1], r)
                    spans.append((len(text), len(text) + len(found), part[1:-1]))
                    text += found
                else:
                    text += part
            out.append((text, spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """labelled_rows as a table: text, spans (start, end, kind), in code points."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<start:int,end:int,kind:string>>")


# --- Tokens and features ------------------------------------------------------------------------------------

#: 0 white space, 1 line end, 2 letters, 3 digits, 4 signs that stand alone.
CLASS = np.array([1 if b in b"\n\r" else 0 if b in b"\t\x0b\x0c " else 3 if 48 <= b <= 57 else 2 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 4 for b in range(256)], np.uint8)
WINDOW = (-2, -1, 0, 1, 2)
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))


@dataclass(frozen=True)
class Tokens:
    """Tokens of some texts: runs of letters, runs of digits, single signs.

    data: the texts' bytes; begin, end: each token's bytes in it; new: the first tokens of lines and texts;
    spaced: tokens with a blank before them.
    """

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    new: np.ndarray
    spaced: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    at, data = binary_parts(texts)
    kind = CLASS[data]
    inside = kind >= 2
    start = inside.copy()
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 4)
    first = at[:-1][at[:-1] < len(data)]
    start[first] = inside[first]
    begin = np.flatnonzero(start)
    # A token ends where the next byte begins another or is white space.
    stop = start | ~inside
    stop[first] = True
    end = np.flatnonzero(np.r_[stop[1:], True] & inside) + 1
    # A token is the first of a line if a line end or the start of a text lies between it and the token before.
    breaks = kind == 1
    breaks[first] = True
    line = np.cumsum(breaks, dtype=np.int32)[begin]
    new = np.r_[True, line[1:] != line[:-1]] if len(begin) else np.zeros(0, bool)
    spaced = (kind[np.maximum(begin, 1) - 1] == 0) & ~new
    return Tokens(data, begin, end, new, spaced)


#: Codes of shapes: a sign is its byte; numbers by their digits (6 stands for more) and whether they are over 255;
#: words of up to four letters a-f by their length; other words by their length (3 stands for more) and first letter.
NUMBER, HEX, WORD, SHAPES = 256, 272, 276, 284
HEXADECIMAL = np.array([chr(b) in "abcdefABCDEF" for b in range(256)])
WIDEST = 12  # bytes of the longest words that are features


def shapes(t: Tokens) -> np.ndarray:
    size, head = t.end - t.begin, t.data[t.begin]
    kind = CLASS[head]
    out = head.astype(np.int64)
    some = np.flatnonzero(kind == 3)
    n, at = size[some], t.begin[some]
    three = np.flatnonzero(n == 3)
    over = n > 3
    if len(three):
        digits = t.data[at[three][:, None] + np.arange(3)].astype(np.int64) - 48
        over[three] = digits @ [100, 10, 1] > 255
    out[some] = NUMBER + 2 * np.minimum(n, 6) + over
    some = np.flatnonzero(kind == 2)
    n, at = size[some], t.begin[some]
    upper = (head[some] >= 65) & (head[some] <= 90)
    shape = WORD + 4 * upper + np.minimum(n, 3)
    short = np.flatnonzero(n <= 4)
    low = np.ones(len(short), bool)
    for j in range(4):
        low &= (n[short] <= j) | HEXADECIMAL[t.data[np.minimum(at[short] + j, len(t.data) - 1)]]
    shape[short[low]] = HEX - 1 + n[short[low]]
    out[some] = shape
    return out


def word_numbers(t: Tokens, words: tuple[str, ...]) -> np.ndarray:
    """For each token 1 and more for the words that are features, in any case; 0 for all others."""
    out = np.zeros(len(t.begin), np.int64)
    maybe = np.zeros((256, WIDEST + 1), bool)
    for w in words:
        maybe[[ord(w[0]), ord(w[0].upper())], len(w)] = True
    size = np.minimum(t.end - t.begin, WIDEST + 1)
    some = np.flatnonzero((size <= WIDEST) & maybe[t.data[t.begin], np.minimum(size, WIDEST)])
    if len(some):
        known = {w.encode(): i + 1 for i, w in enumerate(words)}
        raw = t.data[np.minimum(t.begin[some][:, None] + np.arange(WIDEST), len(t.data) - 1)] | 0x20
        raw[np.arange(WIDEST) >= size[some][:, None]] = 0
        flat = np.ascontiguousarray(raw).view(f"S{WIDEST}").ravel()
        found, place = np.unique(flat, return_inverse=True)
        out[some] = np.array([known.get(x, 0) for x in found.tolist()])[place]
    return out


def codes_of(t: Tokens, words: tuple[str, ...]) -> np.ndarray:
    """One number for all features of a token."""
    return t.spaced + 2 * (shapes(t) + SHAPES * word_numbers(t, words))


def features(code: int, words: tuple[str, ...]) -> list[str]:
    """The features that a code stands for; -1 is what lies beyond a line."""
    if code < 0:
        return ["edge"]
    word, shape = divmod(code // 2, SHAPES)
    kind = "sign" if shape < NUMBER else "number" if shape < HEX else "word"
    out = ["any", f"shape={shape}", f"shape={shape}{'_' * (code % 2)}", f"kind={kind}{'_' * (code % 2)}"]
    return out + [f"word={words[word - 1]}"] * (word > 0)


@dataclass(frozen=True)
class Field:
    """words: those that are features; names: all features; weights: for each place of WINDOW and feature a row over LABELS; moves: scores from label to label."""

    words: tuple[str, ...]
    names: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray


def allowed() -> np.ndarray:
    """Which label may follow which: I of a kind only B or I of that kind."""
    out = np.ones((len(LABELS), len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            out[:, j] = [a[2:] == b[2:] and a != "O" for a in LABELS]
    return out


def labels_of(text: str, spans: list[Span], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The label of each token; spans are given in code points."""
    place = np.cumsum([0, *(len(c.encode()) for c in text)])
    out = np.zeros(len(begin), np.int64)
    for s, e, kind in spans:
        mine = np.flatnonzero((begin >= place[s]) & (end <= place[e]))
        out[mine] = LABELS.index(f"I-{kind}")
        out[mine[:1]] = LABELS.index(f"B-{kind}")
    return out


def forward_backward(score: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition sums of sequences that start and end outside, label probabilities, and expected moves; scaled at each position.

    score: sequence, position, label; positions from a sequence's size on count for nothing.
    """
    n, most, k = score.shape
    top, step = score.max(2), np.exp(moves)
    emit = np.exp(score - top[..., None])
    ahead, scale = np.zeros((n, most, k)), np.ones((n, most))
    for t in range(most):
        now = (ahead[:, t - 1] @ step if t else step[0]) * emit[:, t]
        scale[:, t] = now.sum(1)
        ahead[:, t] = now / scale[:, t, None]
    rows, last = np.arange(n), sizes - 1
    inside = np.arange(most) < sizes[:, None]
    close = ahead[rows, last] @ step[:, 0]
    total = ((np.log(scale) + top) * inside).sum(1) + np.log(close)
    back = np.zeros((n, most, k))
    back[rows, last] = step[:, 0] / close[:, None]
    expected = np.zeros((k, k))
    for t in range(most - 1, 0, -1):
        after = emit[:, t] * back[:, t] / scale[:, t, None] * inside[:, t, None]
        expected += ahead[:, t - 1].T @ after
        back[:, t - 1] = np.where((t <= last)[:, None], after @ step.T, back[:, t - 1])
    expected *= step
    p = ahead * back * inside[..., None]
    expected[0] += p[:, 0].sum(0)
    expected[:, 0] += p[rows, last].sum(0)
    return total, p, expected


def fit(rows: list[tuple[str, list[Span]]], *, steps: int = 120, rate: float = 0.15, ridge: float = 0.01) -> Field:
    """The field of greatest likelihood on labelled texts of one line each, by gradient steps with running scales.

    Words of ASCII letters that stand in at least three texts are features.
    """
    tokens = [tokens_of(pa.array([t])) for t, _ in rows]
    some = [i for i, t in enumerate(tokens) if len(t.begin)]
    gold = [labels_of(*rows[i], tokens[i].begin, tokens[i].end) for i in some]
    seen: dict[str, int] = {}
    for i in some:
        for w in set(re.findall(r"[A-Za-z]+", rows[i][0].lower())):
            seen[w] = seen.get(w, 0) + 1
    words = tuple(sorted(w for w, c in seen.items() if c > 2 and len(w) <= WIDEST))
    codes = [codes_of(tokens[i], words).tolist() for i in some]
    names = tuple(sorted({f for x in codes for c in (-1, *x) for f in features(c, words)}))
    number = {f: i for i, f in enumerate(names)}
    sizes = np.array([len(x) for x in codes])
    n, most, k = len(codes), int(sizes.max(initial=1)), len(LABELS)
    hits = []  # sequence, position, row of the weights
    for i, x in enumerate(codes):
        for t in range(len(x)):
            for d, off in enumerate(WINDOW):
                hits += [(i * most + t, d * len(names) + number[f]) for f in features(x[t + off] if 0 <= t + off < len(x) else -1, words)]
    flat, row = np.array(hits, np.int64).reshape(-1, 2).T
    truth = np.zeros((n, most, k))
    moved = np.zeros((k, k))
    for i, g in enumerate(gold):
        truth[i, np.arange(len(g)), g] = 1
        np.add.at(moved, (np.r_[0, g], np.r_[g, 0]), 1)
    w, moves = np.zeros((len(WINDOW) * len(names), k)), np.zeros((k, k))
    closed = np.where(allowed(), 0.0, -30.0)
    scale_w, scale_m = np.zeros_like(w), np.zeros_like(moves)
    for step in range(steps if n else 0):
        score = np.stack([np.bincount(flat, w[row, j], n * most) for j in range(k)], 1).reshape(n, most, k)
        _, p, expected = forward_backward(score, moves + closed, sizes)
        off = (truth - p).reshape(n * most, k)[flat]
        gw = np.stack([np.bincount(row, off[:, j], len(w)) for j in range(k)], 1) / n - ridge * w / 10
        gm = (moved - expected) / n - ridge * moves / 10
        scale_w, scale_m = 0.9 * scale_w + 0.1 * gw**2, 0.9 * scale_m + 0.1 * gm**2
        pace = rate / (1 + step / 40)
        w += pace * gw / (np.sqrt(scale_w) + 1e-4)
        moves += pace * gm / (np.sqrt(scale_m) + 1e-4)
    return Field(words, names, w.reshape(len(WINDOW), len(names), k), moves + closed)


@functools.lru_cache(maxsize=2)
def fit_kept(rows: tuple[tuple[str, tuple[Span, ...]], ...]) -> Field:
    return fit([(t, list(s)) for t, s in rows])


def train(labelled: DataFrame, *, most: int = 20_000) -> Field:
    """Fit on a small labelled table (text, spans), at most `most` rows by a hash of their text; null texts and spans are left out."""
    found = labelled.filter("text is not null and spans is not null").orderBy(F.xxhash64("text"), "text").limit(most).collect()
    return fit_kept(tuple(sorted((r["text"], tuple((s["start"], s["end"], s["kind"]) for s in r["spans"])) for r in found)))


# --- Decoding -----------------------------------------------------------------------------------------------


class Scores:
    """Scores of all codes by place in the window; the last row is what lies beyond a line."""

    def __init__(self, field: Field) -> None:
        self.field = field
        number = {f: i for i, f in enumerate(field.names)}
        total = 2 * SHAPES * (len(field.words) + 1)
        self.rows = np.zeros((total + 1, len(WINDOW), len(LABELS)), np.float32)
        for code in (-1, *range(total)):
            word, shape = divmod(code // 2, SHAPES)
            if code < 0 or not word or shape >= HEX:
                self.rows[code] = field.weights[:, [number[f] for f in features(code, field.words) if f in number]].sum(1)
        # What a token can add to a path at most, against being outside.
        self.over = (self.rows - self.rows[:, :, :1])[:, :, 1:].max(2).astype(np.float64)


def viterbi(score: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best labels of sequences that start and end outside; score: sequence, position, label."""
    n, most, k = score.shape
    best = moves[0] + score[:, 0]
    came = np.zeros((n, most, k), np.int8)
    finish = np.zeros((n, k))
    finish[sizes == 1] = best[sizes == 1]
    for t in range(1, most):
        options = best[:, :, None] + moves
        came[:, t] = options.argmax(1)
        best = options.max(1) + score[:, t]
        finish[sizes == t + 1] = best[sizes == t + 1]
    out = np.zeros((n, most), np.int8)
    label = (finish + moves[:, 0]).argmax(1)
    rows = np.arange(n)
    for t in range(most - 1, -1, -1):
        now = t < sizes
        out[now, t] = label[now]
        label = np.where(now, came[rows, t, label], label)
    return out


def best_runs(gain: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each token the greatest sum of a run that ends with it and doesn't pass a marked token: running sums over their least value so far."""
    total = np.cumsum(gain)
    before = total - gain
    starts = np.flatnonzero(new)
    nth = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(gain)]))
    base = before[starts][nth]
    total, before = total - base, before - base
    # Each line stands below the one before, so that its running minimum is its own.
    below = nth * (2 * float(np.abs(before).max()) + 1)
    return total - (np.minimum.accumulate(before - below) + below)


def decode(scores: Scores, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges and kinds of what the field finds, lines taken as chains."""
    none = (np.zeros(0, np.int64),) * 3
    t = tokens_of(texts)
    begin, end, new, n = t.begin, t.end, t.new, len(t.begin)
    if not n:
        return none
    moves, rows, edge = scores.field.moves, scores.rows, len(scores.rows) - 1
    number = codes_of(t, scores.field.words)
    line = np.cumsum(new, dtype=np.int32)
    step = max(0.0, float((moves - moves[0, 0]).max()))
    around = []
    bound = np.full(n, step)
    for d, off in enumerate(WINDOW):
        at = np.full(n, edge)
        if off < 0:
            at[-off:] = np.where(line[-off:] == line[:off], number[:off], edge)
        elif off > 0:
            at[:-off] = np.where(line[:-off] == line[off:], number[off:], edge)
        else:
            at = number
        around.append(at)
        bound += scores.over[at, d]
    # A token is outside for certain if no run with it has a positive sum; one step more leads out of a run.
    left, right = best_runs(bound, new), best_runs(bound[::-1], np.r_[new[1:], True][::-1])[::-1]
    may = left + right - bound + step > -1e-3
    if not may.any():
        return none
    chosen = np.flatnonzero(may)
    cut = np.r_[True, (np.diff(chosen) > 1) | new[chosen[1:]]]
    first = np.flatnonzero(cut)
    sizes = np.diff(np.r_[first, len(chosen)])
    found = np.zeros(n, np.int8)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        most = int(sizes[order[at]])
        stop = at
        while stop < len(order) and sizes[order[stop]] <= 2 * most + 8 and (stop - at) * int(sizes[order[stop]]) < 400_000:
            stop += 1
        stop = max(stop, at + 1)
        some = order[at:stop]
        wide = int(sizes[some].max())
        place = chosen[np.minimum(first[some][:, None] + np.arange(wide), len(chosen) - 1)]
        score = sum(rows[x[place], d] for d, x in enumerate(around)).astype(np.float64)
        got = viterbi(score, moves, sizes[some])
        inside = np.arange(wide) < sizes[some][:, None]
        found[place[inside]] = got[inside]
        at = stop
    starts = np.flatnonzero((found % 2 == 1))
    stops = np.flatnonzero((found > 0) & np.r_[(found[1:] % 2 == 1) | (found[1:] == 0) | new[1:], True])
    return begin[starts], end[stops], (found[starts].astype(np.int64) - 1) // 2


#: An address whose signs may be spelt out and stand apart.
SPELT = re.compile(r"[\w.%+-]+ ?(?:@|[(\[] ?at ?[)\]]) ?[\w-]+(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[\w-]+)+", re.I)


def valid(kind: str, text: str) -> bool:
    """Whether what the field found can be of its kind."""
    digits = digits_of(text)
    if kind == "email":
        return SPELT.fullmatch(text) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return re.fullmatch(r"(?:[0-9a-fA-F]{0,4}:){3,7}[0-9a-fA-F]{0,4}", text) is not None or (len(parts) == 4 and small_parts(parts) and not re.search(r"[A-Za-z]", text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", text)
    return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", text) and len(digits) < len(text)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def with_added(text: str, data: bytes, found: list[tuple[int, int, int]]) -> tuple[list[Span], list[Span]]:
    """Base spans of a text, and what the field adds beside them; found: byte ranges and kinds in the text's bytes."""
    base = base_spans(text)
    added: list[Span] = []
    if found:
        plain = len(data) == len(text)
        spots = sorted((s, e) for s, e, _ in base)
        reach = list(accumulate((e for _, e in spots), max))
        at = was = 0
        for s, e, k in found:
            if plain:
                x, y = s, e
            else:
                at, was = at + len(data[was:s].decode("utf-8", "replace")), s
                x, y = at, at + len(data[s:e].decode("utf-8", "replace"))
            before = bisect_left(spots, (y,))
            if (not before or reach[before - 1] <= x) and valid(KINDS[k], text[x:y]):
                added.append((x, y, KINDS[k]))
    return base, added


SLICE = 1 << 21  # bytes of text that are decoded at once


def decoded(scores: Scores, texts: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
    """For each text what the field finds in its bytes. Long texts are decoded some lines at a time, others together."""
    at, data = binary_parts(texts)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
        part, ends = texts.slice(first, stop - first), at[first + 1 : stop + 1]
        if at[stop] - at[first] > 2 * SLICE:  # one text
            whole = data[at[first] : at[stop]]
            lines = np.flatnonzero(whole == 10) + 1
            cuts = np.unique(lines[np.searchsorted(lines, np.arange(SLICE, len(whole), SLICE), "right").clip(max=max(0, len(lines) - 1))]) if len(lines) else lines
            ends = at[first] + np.r_[cuts[cuts < len(whole)], len(whole)]
            part = [pa.array([whole[x:y].tobytes()], pa.binary()) for x, y in zip([0, *(ends[:-1] - at[first])], ends - at[first], strict=True)]
            found = [x for p, shift in zip(part, [0, *(ends[:-1] - at[first])], strict=True) for x in zip(*((c + shift * (k < 2)).tolist() for k, c in enumerate(decode(scores, p))), strict=True)]
            yield found
        else:
            begin, end, kind = decode(scores, part)
            cut = np.searchsorted(begin, np.r_[0, ends - at[first]])
            for i, shift in enumerate((at[first:stop] - at[first]).tolist()):
                here = slice(cut[i], cut[i + 1])
                yield list(zip((begin[here] - shift).tolist(), (end[here] - shift).tolist(), kind[here].tolist(), strict=True))
        first = stop


def find_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every row.

    n_email to n_phone count the base spans, base_sha256 digests them and spans lists them with those that the
    field adds. A null or empty text has none. Repeated rows and null ids give a row each, an empty table gives
    none, other columns are not read. The field, of a size that its labelled table bounds, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for batch in batches:
            column = batch.column(1).fill_null("")
            rows = []
            for text, found in zip(column, decoded(scores, column), strict=True):
                text = text.as_py()
                base, added = with_added(text, text.encode("utf-8", "surrogatepass") if found else b"", found)
                counts = [sum(k == x for *_, k in base) for x in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
