"""Personal data: rules, and a skip-chain conditional random field that keeps labels consistent."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import by_batch, id_and_text

# The base kinds in their order, their patterns and limits.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: what fails from the first digit fails from the others.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Every base match, and every token the field may label, holds one of these.
_CANDIDATE = "[@0-9]"

# What the field labels: the base kinds, and secrets, which have no base rule.
SPAN_KINDS = (*KINDS, "secret")
N_LABELS = 1 + len(SPAN_KINDS)
# A value that its text calls a secret. It has a digit, as all tokens that may be labelled.
_SECRET = re.compile(
    r"""(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key)["']?\x20?[=:]\x20?["']?"""
    r"""((?=[^\s"'0-9]*[0-9])[^\s"']{12,})""")
ROUNDS = 1000  # at most; a text is done as soon as its messages settle
SETTLED = 1e-8  # largest change of a log message
DAMPING = 0.5
LEAST = 0.5  # probability from which a token is labelled
FEATURES = 18
# Features of the signs that rules go by: a plus sign or bracket, a plus sign in front.
_MARKS = 1 << 1 | 1 << 2 | 1 << 15
_ALIKE = 4.0  # what is expected of the skip edges before any are seen: tokens of one form agree
_NEVER = -1e9  # log potential that no number of messages makes up for
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'.,;:!?()[]{}<>#$%&*=~|`"

Span = tuple[int, int, int]  # start, kind, end


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every @: the local part reaches back to the run's start or the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        tail = _DOMAIN.match(text, at + 1)
        start = at
        if tail:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, tail.end()
                done = tail.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The base rules' spans by start, then kind."""
    found = [(i, 0, j) for i, j in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def secret_spans(text: str) -> list[Span]:
    """Values that stand after a name of a secret and a sign of assignment."""
    return [(m.start(1), len(KINDS), m.end(1)) for m in _SECRET.finditer(text)]


@dataclass
class Graph:
    """The tokens of some texts that may be labelled, and the edges between them.

    ``rule`` is the label that a rule's span gives a token, 0 if none does. Tokens next to each other
    are joined by chain edges. ``skip`` has each token and the next one of the same form in its text,
    ``group`` the group of a token: all tokens of its form in its text, -1 if it has none.
    """

    text: list[int]
    start: list[int]
    end: list[int]
    place: list[int]
    features: list[int]
    rule: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    group: list[int]


def _form(token: str) -> str | None:
    """Tokens of one form are similar. Case doesn't count, of an address only the part up to the @, and
    of a number only its last seven digits: dial codes come and go. Shorter numbers agree by chance."""
    if "@" in token:
        return token.lower().split("@")[0] + "@"
    digits, letters = _digits(token), any(c.isalpha() for c in token)
    if len(digits) < (4 if letters else 7):
        return None
    return token.lower() if letters else digits[-7:]


def _features(token: str, before: str | None) -> int:
    digits, core = _digits(token), token.strip(_EDGE)
    parts = core.split(".")
    n = len(digits)
    flags = (
        "@" in token, token.startswith("+"), "(" in token, "-" in core, "." in core, core == digits,
        any(c.isalpha() for c in core),
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts),
        14 <= n <= 19 and luhn(digits), 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19,
        n >= 20, before is not None and before.startswith("+"),
        len(core) >= 16 and 0 < n < len(core) and core.isalnum(),
        len(core) >= 16 and 0 < n < len(core) and all(c in "0123456789abcdef" for c in core.lower()),
    )
    return sum(bit << i for i, bit in enumerate(flags))


def graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    g = Graph([], [], [], [], [], [], [], [], [])
    n_groups = 0
    for t, text in enumerate(texts):
        if not text:
            continue
        own = [(m.start(), m.end(), k, m[0]) for k, m in enumerate(_TOKEN.finditer(text))
               if "@" in m[0] or any("0" <= c <= "9" for c in m[0])]
        first, last_of, at = len(g.text), {}, 0
        for i, (start, end, place, token) in enumerate(own):
            before = own[i - 1][3] if i and own[i - 1][2] == place - 1 else None
            core = token.strip(_EDGE) or token
            start += token.find(core)
            end = start + len(core)
            while at < len(spans[t]) and spans[t][at][2] <= start:
                at += 1
            over = [k for s, k, e in spans[t][at : at + 4] if s < end and e > start]
            node = first + i
            g.text.append(t), g.start.append(start), g.end.append(end), g.place.append(place)
            g.features.append(_features(token, before))
            g.rule.append(over[0] + 1 if over else 0)
            if before is not None:
                g.chain.append((node - 1, node))
            form = _form(core)
            if form is None:
                g.group.append(-1)
            elif form in last_of:
                g.skip.append((last_of[form], node))
                g.group.append(g.group[last_of[form]])
            else:
                g.group.append(n_groups)
                n_groups += 1
            last_of[form] = node
    return g


def _bits(patterns: np.ndarray) -> np.ndarray:
    bits = (patterns[:, None] >> np.arange(FEATURES)) & 1
    return np.column_stack((bits, np.ones(len(patterns)))).astype(np.float64)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))


@dataclass(frozen=True)
class Field:
    """Weights of a label by a token's features, and log potentials of the two kinds of edges."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def posterior(self, g: Graph) -> np.ndarray:
        """Label probabilities of every token by loopy message passing (sum-product, damped).

        Two tokens of one form are joined by a skip edge; three and more each with a hub, so that all
        are two steps from one another however many there are. A hub has the labels that rules give to
        tokens of its form and is not outvoted by tokens that no rule knows. A text is done when its
        messages have settled, or after ``ROUNDS`` if they go round in circles.

        Texts share no edge, so what stands beside a text in a batch doesn't matter.
        """
        n = len(g.text)
        own = _bits(np.array(g.features, dtype=np.int64)) @ self.weights
        rule = np.array(g.rule, dtype=np.int64)
        known = rule > 0
        own[known] = -20.0
        own[known, rule[known]] = 0.0
        pairs, skip, hubs = self._edges(g, rule)
        own = np.concatenate((own, hubs))
        near = skip.astype(np.int64)
        tables = np.stack((self.chain, self.skip))
        source = np.concatenate((pairs[:, 0], pairs[:, 1]))
        target = np.concatenate((pairs[:, 1], pairs[:, 0]))
        back = np.concatenate((np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))))
        potential = np.concatenate((tables[near], tables[near].transpose(0, 2, 1)))
        text = np.array(g.text, dtype=np.int64)[np.concatenate((pairs[:, 0], pairs[:, 0]))]
        message = np.zeros((len(source), N_LABELS))
        open_ = np.arange(len(source))  # edges of texts whose messages have not settled
        for _ in range(ROUNDS):
            if not len(open_):
                break
            belief = own + self._gather(message[open_], target[open_], len(own))  # right in open texts
            out = belief[source[open_]] - message[back[open_]]
            new = _log_sum(out[:, :, None] + potential[open_], axis=1)[:, 0, :]
            new -= _log_sum(new, axis=1)
            new = DAMPING * message[open_] + (1 - DAMPING) * new
            moved = np.abs(new - message[open_]).max(axis=1) > SETTLED
            message[open_] = new
            open_ = open_[np.isin(text[open_], text[open_[moved]])]
        belief = (own + self._gather(message, target, len(own)))[:n]
        return np.exp(belief - _log_sum(belief, axis=1))

    @staticmethod
    def _edges(g: Graph, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges with the token in front, whether each is a skip edge, and the hubs' own log potentials."""
        group = np.array(g.group, dtype=np.int64)
        size = np.bincount(group[group >= 0])
        chain, skip = (np.array(e, dtype=np.int64).reshape(-1, 2) for e in (g.chain, g.skip))
        skip = skip[size[group[skip[:, 0]]] == 2]
        large = np.flatnonzero(size > 2)
        member = np.flatnonzero(np.isin(group, large))
        hub = np.searchsorted(large, group[member])
        found = np.zeros((len(large), N_LABELS))
        np.add.at(found, (hub, rule[member]), 1)
        found[:, 0] = 0  # no rule
        some = found.sum(axis=1) > 0
        own = np.zeros((len(large), N_LABELS))
        own[some] = np.where(found[some] > 0, np.log(np.maximum(found[some], 1)), _NEVER)
        pairs = np.concatenate((chain, skip, np.column_stack((member, hub + len(group)))))
        return pairs, np.arange(len(pairs)) >= len(chain), own

    @staticmethod
    def _gather(message: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
        return np.column_stack([
            np.bincount(target, weights=message[:, k], minlength=n) for k in range(N_LABELS)])


def _counts(g: Graph) -> np.ndarray:
    """Rows ``(features, label, front, back, others, n)`` of the tokens, by their rule labels.

    ``front`` and ``back`` are one more than the label of the neighbour there, ``others`` one more than
    that of the other tokens of its form in its text, 0 if there is none. Every token counts twice,
    once without the marks that rules go by, as a mention that no rule knows would look. A token
    without a label whose like has one is not known to be nothing; it is left out.
    """
    rule = np.array(g.rule, dtype=np.int64)
    group = np.array(g.group, dtype=np.int64)
    features = np.array(g.features, dtype=np.int64)
    front, back, others = (np.zeros(len(rule), np.int64) for _ in range(3))
    chain = np.array(g.chain, dtype=np.int64).reshape(-1, 2)
    front[chain[:, 1]] = rule[chain[:, 0]] + 1
    back[chain[:, 0]] = rule[chain[:, 1]] + 1
    member = np.flatnonzero(group >= 0)
    met = np.zeros((group.max(initial=-1) + 1, N_LABELS), np.int64)
    np.add.at(met, (group[member], rule[member]), 1)
    rest = met[group[member]]
    rest[np.arange(len(member)), rule[member]] -= 1
    some = rest.sum(axis=1) > 0
    rest[:, 0] = 0  # the label of a rule, if any of them has one
    others[member[some]] = rest[some].argmax(axis=1) + 1
    rows = np.column_stack((features, rule, front, back, others))[(rule > 0) | (others < 2)]
    plain = rows.copy()
    plain[:, 0] &= ~_MARKS
    found, n = np.unique(np.concatenate((rows, plain)), axis=0, return_counts=True)
    return np.column_stack((found, n))


def _logits(x: np.ndarray, rows: np.ndarray, field: Field) -> np.ndarray:
    """Log potentials of a token's labels, given those of the tokens it is joined to."""
    none = np.zeros((1, N_LABELS))
    front, back, others = (np.vstack((none, t)) for t in (field.chain, field.chain.T, field.skip))
    return x @ field.weights + front[rows[:, 2]] + back[rows[:, 3]] + others[rows[:, 4]]


def _expected_skip() -> np.ndarray:
    return _ALIKE * (2 * np.eye(N_LABELS) - 1)


def objective(rows: np.ndarray, field: Field, ridge: float) -> float:
    """Mean pseudo-likelihood of the labels, every token's given those around it, less the ridge for
    weights that differ from what is expected: nothing, but for skip edges."""
    z = _logits(_bits(rows[:, 0]), rows, field)
    own = (z - _log_sum(z, axis=1))[np.arange(len(rows)), rows[:, 1]]
    size = sum((t**2).sum() for t in (field.weights, field.chain, field.skip - _expected_skip()))
    return float((own * rows[:, 5]).sum() / rows[:, 5].sum() - ridge / 2 * size)


def fit(rows: np.ndarray, steps: int = 600, rate: float = 0.1, ridge: float = 1e-4) -> Field:
    """The field of greatest :func:`objective` over the counts of all texts: weights of features and
    tables of both kinds of edges are learned together. Rules give the labels."""
    rows = rows.reshape(-1, 6)
    weights, chain, skip = np.zeros((FEATURES + 1, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), _expected_skip()
    expected = (0, 0, skip.copy())
    if not len(rows):
        weights[-1, 0] = 5.0
        return Field(weights, chain, skip)
    x, y = _bits(rows[:, 0]), np.eye(N_LABELS)[rows[:, 1]]
    share = rows[:, 5] / rows[:, 5].sum()
    squares = [np.zeros_like(t) for t in (weights, chain, skip)]
    for step in range(steps):
        z = _logits(x, rows, Field(weights, chain, skip))
        gap = (np.exp(z - _log_sum(z, axis=1)) - y) * share[:, None]
        around = [np.zeros((N_LABELS + 1, N_LABELS)) for _ in range(3)]
        for table, column in zip(around, (2, 3, 4)):
            np.add.at(table, rows[:, column], gap)
        front, back, others = (table[1:] for table in around)
        # a skip edge has no direction, so its table is symmetric
        slopes = (x.T @ gap, front + back.T, (others + others.T) / 2)
        for t, middle, slope, square in zip((weights, chain, skip), expected, slopes, squares):
            slope = slope + ridge * (t - middle)
            square *= 0.9
            square += 0.1 * slope**2
            t -= rate * (1 - step / steps) * slope / (np.sqrt(square) + 1e-6)
    return Field(weights, chain, skip)


def added_spans(g: Graph, posterior: np.ndarray) -> list[tuple[int, Span]]:
    """``(text, span)`` of labelled tokens that no rule covers; neighbours of one kind are one span."""
    label = posterior.argmax(axis=1)
    sure = (label > 0) & (posterior[np.arange(len(label)), label] >= LEAST) & (np.array(g.rule) == 0)
    out: list[tuple[int, Span]] = []
    before = None
    for i in np.flatnonzero(sure).tolist():
        here = (g.text[i], g.place[i], int(label[i]))
        if out and before == (here[0], here[1] - 1, here[2]):
            out[-1] = (here[0], (out[-1][1][0], here[2] - 1, g.end[i]))
        else:
            out.append((here[0], (g.start[i], here[2] - 1, g.end[i])))
        before = here
    return out


def _text(spans: list[Span]) -> str:
    return ",".join(f"{SPAN_KINDS[k]}:{i}:{j}" for i, k, j in sorted(spans))


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts that hold nothing to be labelled are sent to Python as empty ones."""
    text = id_and_text(docs, id_col, text_col)
    return text.select("doc_id", F.when(F.col("text").rlike(_CANDIDATE), F.col("text")).otherwise("").alias("text"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit the field to the rules' spans in all documents. Tasks count features and labels of tokens and of
    those around them, Spark adds the counts up; the driver gets one row per distinct count, which
    features and labels bound."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t for t in batch.column(1).to_pylist() if t]
        rows = _counts(graph(texts, [sorted(base_spans(t) + secret_spans(t)) for t in texts]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=[*what, "n"])

    what = ["features", "label", "front", "back", "others"]
    counts = by_batch(_candidates(docs, id_col, text_col), each, ", ".join(f"{c} long" for c in [*what, "n"]))
    rows = counts.groupBy(*what).agg(F.sum("n").alias("n")).orderBy(*what).toArrow()
    return fit(np.column_stack([c.to_numpy() for c in rows.columns]).astype(np.int64))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every row: ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans)``.

    The first counts and the digest are those of the base rules; ``spans`` has these, named secrets and
    the tokens that the field labels, as ``kind:start:end`` in code points, ``n_spans`` of them. A null or empty text has none; ids may
    be null or repeated; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        base = [base_spans(t) if t else [] for t in texts]
        known = [sorted([*s, *secret_spans(t)]) if t else s for t, s in zip(texts, base)]
        spans = [list(s) for s in known]
        g = graph(texts, known)
        if g.text:
            for t, span in added_spans(g, sent.value.posterior(g)):
                spans[t].append(span)
        counts = np.zeros((len(texts), len(KINDS)), dtype=np.int64)
        for t, found in enumerate(base):
            for _, kind, _ in found:
                counts[t, kind] += 1
        digests = [sha256(_text(s).encode()).hexdigest() for s in base]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(counts[:, k]) for k in range(len(KINDS))],
             pa.array(digests, pa.string()), pa.array([_text(s) for s in spans], pa.string()),
             pa.array([len(s) for s in spans], pa.int64())],
            names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"])

    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
              "n_spans long")
    return by_batch(_candidates(docs, id_col, text_col), each, schema)


def op9_personal_data(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))
