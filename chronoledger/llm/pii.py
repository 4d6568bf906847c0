"""Operator 8: personal data by fixed patterns and a linear-chain conditional random field.

The patterns (email, ip, card, phone) are found leftmost and non-overlapping, each
in time linear in the text. A linear-chain CRF over word shapes (digits, letters,
dots, at signs and so on, of a word and its neighbours), trained from a small
labelled table, then labels the white-space words of a text; Viterbi runs in numpy
over batches of chains of one length. A span of the CRF is added where it passes a
sanity check of its kind and touches no pattern span; pattern spans always stay.

The field has structural zeros: a word without digit, at sign and plus can only be
labelled "none", in training as in decoding. Such words therefore end a chain, and
decoding the runs between them gives the labels that decoding the whole text gives.

Null text counts as empty (no spans); a null id stays null; repeated rows each get
their row; an empty table gives an empty result; other columns are ignored. Time grows
with a text's length, memory with the longest text (some 60 bytes a byte). Of equally
good labellings Viterbi takes the one with the lowest label numbers from the right.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_arrow
from .words import NOT_SPACE, byte_class, byte_slices, find_words

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

# Possessive runs: a run that does not lead to a match is skipped as a whole, since no later start in it could match.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text) if m[1]]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if m[1] and all(int(p) <= 255 if len(p) < 10 else int(p.lstrip("0")[:10] or "0") <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# ---- word shapes -------------------------------------------------------------------------------------------------

_DIGIT, _ALPHA = byte_class((48, 57)), byte_class((65, 90), (97, 122), (128, 255))
_COUNTED = [_DIGIT, _ALPHA, *(byte_class((ord(c), ord(c))) for c in "@.-+"), byte_class((40, 41))]
_STEPS = [np.array([0, 1, 1, 3, 4, 5, 5, 6, 6, 6, 7, 7, 8, 8, 8, 8, 9, 9, 9, 9, 2]), np.array([0, 1, 1, 2]), np.array([0, 1, 2]), np.array([0, 1, 2, 3, 4]), np.array([0, 1, 2, 3]), np.array([0, 1]), np.array([0, 1, 1])]
_WIDTH = [int(s.max()) + 1 for s in _STEPS]
_BASES = np.cumsum([0, *_WIDTH])
N_SHAPES = int(np.prod(_WIDTH))


def shapes(words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: the classes of its counts (one column for each thing counted), and whether it has a digit, @ or +."""
    columns = []
    for inside, steps in zip(_COUNTED, _STEPS, strict=True):
        total = np.zeros(len(words.data) + 1, dtype=np.int32)
        np.cumsum(inside[words.data], out=total[1:])
        columns.append(steps[np.minimum(total[words.end] - total[words.start], len(steps) - 1)].astype(np.int16))
    classes = np.stack(columns, axis=1)
    return classes, (classes[:, 0] > 0) | (classes[:, 2] > 0) | (classes[:, 5] > 0)


def joint(classes: np.ndarray) -> np.ndarray:
    code = np.zeros(len(classes), dtype=np.int64)
    for i, w in enumerate(_WIDTH):
        code = code * w + classes[:, i]
    return code


@dataclass
class Field:
    """Weights of a linear-chain CRF: emissions by feature and label, transitions by label and label."""

    known: np.ndarray  # sorted joint shapes of the training table
    emission: np.ndarray
    transition: np.ndarray

    @property
    def single(self) -> int:
        return int(_BASES[-1])

    def features(self, classes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Feature numbers of words, given their own classes and those of their neighbours (-1: none)."""
        n = len(self.known)

        def shape(c: np.ndarray, block: int) -> np.ndarray:
            code = joint(np.maximum(c, 0))
            at = np.minimum(np.searchsorted(self.known, code), n - 1)
            return self.single + block * (n + 2) + np.where(c[:, 0] < 0, n + 1, np.where(self.known[at] == code, at, n))

        return np.concatenate([classes + _BASES[:-1], np.stack([shape(classes, 0), shape(before, 1), shape(after, 2)], axis=1)], axis=1)

    def n_features(self) -> int:
        return self.single + 3 * (len(self.known) + 2)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.emission[features].sum(axis=1)

    def decode(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of chains that lie one after another in ``scores``; all chains of a length go together."""
        out = np.zeros(len(scores), dtype=np.int8)
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            for part in np.array_split(group, max(1, len(group) * int(lengths[group[0]]) // 200_000)):
                length = int(lengths[part[0]])
                at = starts[part][:, None] + np.arange(length)
                best = scores[at[:, 0]] + self.transition[0]
                back = np.zeros((length, len(part), len(LABELS)), dtype=np.int8)
                for t in range(1, length):
                    options = best[:, :, None] + self.transition[None]
                    back[t] = options.argmax(axis=1)
                    best = options.max(axis=1) + scores[at[:, t]]
                label = (best + self.transition[:, 0]).argmax(axis=1)
                for t in range(length - 1, -1, -1):
                    out[at[:, t]] = label
                    label = back[t, np.arange(len(part)), label]
        return out


def training_table(rows: int = 900, seed: int = 7) -> list[list[tuple[str, int]]]:
    """A small labelled table: sentences of (word, label) made by rule from invented values."""
    r = random.Random(seed)

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(r.choice("abcdefghiklmnoprstuvwé") for _ in range(r.randint(low, high)))

    def number(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def plain() -> str:
        w = word()
        return r.choice([w, w, w, w.capitalize(), w.upper(), w + r.choice(".,;:!?"), f"({w})", f"{w}-{word()}", w + r.choice(["***", "%%%", "$$$", "###", "&&&"]), "-", "|", "--"])

    def odd() -> str:
        return r.choice([number(r.randint(1, 6)), f"{number(1)}.{number(1)}", f"{number(1)}.{number(1)}.", f"19{number(2)}", f"{number(2)}:{number(2)}", f"20{number(2)}-0{number(1)}-{number(2)}", word(3, 4) + number(2), "".join(r.choice("0123456789abcdef") for _ in range(40)), "AKIA" + word(8, 9).upper() + number(3), f"${number(3)}.{number(2)}", f"{number(2)}%", f"v{number(1)}.{number(1)}.{number(1)}", "+", "+" + number(1), f"@{word()}", f"{number(1)}.{number(2)}.{number(1)}", f"({number(2)})", f"{number(3)}-{number(2)}", number(r.randint(20, 30)), "https://" + word() + "." + word(2, 3)])

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def phone() -> list[str]:
        area, a, b = number(3), number(3), number(4)
        return r.choice([[f"+{number(1)}", f"({area})", f"{a}-{b}"], [f"({area})", f"{a}-{b}"], [f"+{number(2)}", area, a + b], [f"{area}-{a}-{b}"], [f"{area}.{a}.{b}"], [f"+{number(2)}", number(3), number(3), number(4)], [f"+{number(11)}"], [f"+{number(2)}-{number(3)}-{number(7)}"]])

    def card() -> list[str]:
        return r.choice([[number(4) for _ in range(4)], [number(16)], ["-".join(number(4) for _ in range(4))], [number(4), number(6), number(5)]])

    def email() -> list[str]:
        host = f"{word()}{r.choice(['', number(1)])}.{r.choice(['example.com', 'org', 'net', 'co.uk'])}"
        return [r.choice([f"{word()}@{host}", f"{word()}.{number(2)}@{host}", f"{word()}_{word()}@{host}", f"<{word()}@{host}>", f"{word()}.{word()}@{host},"])]

    table = []
    for _ in range(rows):
        sentence: list[tuple[str, int]] = []
        for _ in range(r.randint(1, 4)):
            sentence += [(plain(), 0) for _ in range(r.randint(1, 5))]
            kind = r.randint(0, 7)
            found = email() if kind == 1 else [ip()] if kind == 2 else card() if kind == 3 else phone() if kind == 4 else [odd()]
            if r.random() < 0.3:
                found[-1] += r.choice([".", ",", "###", "***", ")", ";"])
            sentence += [(w, kind if 1 <= kind <= 4 else 0) for w in found]
        table.append(sentence + [(plain(), 0)] * r.randint(0, 1))
    return table


def fit(table: list[list[tuple[str, int]]], rounds: int = 250, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximum penalised likelihood by forward-backward over the padded table."""
    n, k, most = len(table), len(LABELS), max(map(len, table))
    words = find_words([" ".join(w for w, _ in s).encode() for s in table], NOT_SPACE)
    classes, active = shapes(words)
    field = Field(np.unique(joint(classes)), np.zeros((0, k)), np.zeros((k, k)))
    first = np.r_[True, words.text[1:] != words.text[:-1]]
    last = np.r_[first[1:], True]
    none = np.full_like(classes[:1], -1)
    before, after = np.r_[none, classes[:-1]], np.r_[classes[1:], none]
    before[first], after[last] = -1, -1
    features = field.features(classes, before, after)
    row, column = words.text, np.arange(len(words.text)) - np.repeat(np.flatnonzero(first), np.bincount(words.text))
    gold = np.concatenate([[y for _, y in s] for s in table])
    lengths = np.bincount(row, minlength=n)
    live = np.arange(most)[None] < lengths[:, None]
    size = field.n_features() * k
    barred = np.where(active[:, None] | (np.arange(k) == 0), 0.0, -1e4)
    inside = np.arange(len(gold))

    def value(x: np.ndarray) -> np.ndarray:
        emission, transition = x[:size].reshape(-1, k), x[size:].reshape(k, k)
        score = np.zeros((n, most, k))
        score[row, column] = emission[features].sum(axis=1) + barred

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)

        forward, backward = np.zeros((n, most, k)), np.zeros((n, most, k))
        forward[:, 0] = score[:, 0] + transition[0]
        for t in range(1, most):
            forward[:, t] = np.where(live[:, t, None], lse(forward[:, t - 1, :, None] + transition[None], 1) + score[:, t], forward[:, t - 1])
        backward[np.arange(n), lengths - 1] = transition[:, 0]
        for t in range(most - 2, -1, -1):
            backward[:, t] = np.where(live[:, t + 1, None], lse(transition[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2), backward[:, t])
        total = lse(forward[:, -1] + transition[:, 0], 1)
        chance = np.exp(forward + backward - total[:, None, None])[row, column]
        chance[inside, gold] -= 1
        de = np.zeros((field.n_features(), k))
        for j in range(features.shape[1]):
            np.add.at(de, features[:, j], chance)
        dt = np.zeros((k, k))
        for t in range(1, most):
            pair = forward[:, t - 1, :, None] + transition[None] + (score[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            dt += np.exp(pair[live[:, t]]).sum(axis=0)
        ends = np.flatnonzero(last)
        dt[0] += chance[first].sum(axis=0)
        dt[:, 0] += chance[ends].sum(axis=0)
        np.add.at(dt, (gold[:-1][~last[:-1]], gold[1:][~last[:-1]]), -1)
        return np.r_[de.ravel(), dt.ravel()] / n + penalty * x

    x, m, v = np.zeros(size + k * k), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = value(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    field.emission, field.transition = x[:size].reshape(-1, k), x[size:].reshape(k, k)
    return field


# ---- spans ---------------------------------------------------------------------------------------------------------

_EDGES = " \t\n\r.,;:!?*#%$&\"'<>|"


def _sane(kind: int, s: str) -> bool:
    n = sum("0" <= c <= "9" for c in s)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", s) is not None
    if kind == 1:
        return s.count(".") == 3 and all(p.isascii() and p.isdigit() and len(p) < 10 and int(p) <= 255 for p in s.split("."))
    if not set(s) <= set("0123456789 -().+"):
        return False
    return 14 <= n <= 19 and luhn("".join(c for c in s if c.isdigit())) if kind == 2 else 10 <= n <= 15


def field_spans(field: Field, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Of each text the (kind, start, end) that the CRF labels, trimmed at their edges, in code points."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, j in byte_slices(texts):
        words = find_words(texts[i:j], NOT_SPACE, fold=False)
        if not len(words.start):
            continue
        classes, active = shapes(words)
        at = np.flatnonzero(active)
        if not len(at):
            continue
        edge = np.full((1, classes.shape[1]), -1, dtype=classes.dtype)
        padded = np.concatenate([edge, classes, edge])
        text = np.r_[-1, words.text, -1]
        before, after = padded[at], padded[at + 2]
        before, after = np.where((text[at] == text[at + 1])[:, None], before, -1), np.where((text[at + 2] == text[at + 1])[:, None], after, -1)
        scores = field.scores(field.features(classes[at], before, after))
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]])]
        starts = np.flatnonzero(new)
        label = field.decode(scores, starts, np.diff(np.r_[starts, len(at)]))
        run = np.flatnonzero((label > 0) & (new | (np.r_[0, label[:-1]] != label)))
        if not len(run):
            continue
        stop = np.flatnonzero(np.r_[new[1:] | (label[1:] != label[:-1]), True])
        chars = np.r_[0, np.cumsum(words.data & 0xC0 != 0x80)]
        for s in run:
            e = stop[np.searchsorted(stop, s)]
            k, b0, b1 = int(words.text[at[s]]), int(words.start[at[s]]), int(words.end[at[e]])
            whole = words.data[b0:b1].tobytes().decode()
            left = whole.lstrip(_EDGES)
            kept = left.rstrip(_EDGES)
            if label[s] == 4 and kept.endswith(")"):
                kept = kept.rstrip(")")
            kind = int(label[s]) - 1
            if kept and _sane(kind, kept):
                begin = int(chars[b0] - chars[words.text_start[k]]) + len(whole) - len(left)
                out[i + k].append((kind, begin, begin + len(kept)))
    return out


def add_spans(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base with those of ``more`` that touch none of it, by kind, then start."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    longest = np.maximum.accumulate([e for _, e in taken]) if taken else []
    fresh = []
    for kind, s, e in more:
        i = int(np.searchsorted(starts, e)) - 1
        if i < 0 or longest[i] <= s:
            fresh.append((kind, s, e))
    return sorted(base + fresh)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans (all), n_added."""
    shared = df.sparkSession.sparkContext.broadcast(field or fit(training_table()))

    def run(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        base = [pattern_spans(t) for t in texts]
        every = [add_spans(b, m) for b, m in zip(base, field_spans(shared.value, [t.encode() for t in texts]), strict=True)]
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(4)]
        digest = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base])
        columns = [batch.column(0), *counts, digest, pa.array(map(written, every), pa.string()), pa.array([len(e) - len(b) for e, b in zip(every, base, strict=True)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_arrow(id_and_text(df, id_col, text_col), run, schema)
