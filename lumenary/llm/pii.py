"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The field's nodes are the tokens of a text that hold a digit, an @ or an "(at)"; every other token is outside any
entity for certain, so leaving it out changes nothing. Neighbouring nodes are linked as in a linear chain.
Tokens with the same digits, or the same name before an @, share a hub however far apart they stand (a
star instead of all pairs, so a token repeated n times costs n). Sum-product messages run over chain and
hubs for a fixed number of rounds. Tokens inside a pattern match are held at its kind.

All weights are fitted together, by the gradient of the likelihood under loopy messages (what is seen less what
the field expects, for nodes, chain links and hub links). The patterns find by construction all that they can
label, so the field learns from what is kept from them: of the matches in a bounded sample of documents a share is not held,
others are spelled in ways that no pattern reads (a card in dots, a phone without its country code, an address with
"(at)") or repeated side by side or further on; numbers that are no personal data, made or from the documents, are outside.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: outside
ANY = re.compile(r"[0-9@]|\(at\)")
#: The patterns of ip, card and phone; that of email is walked from each @, see ``emails``.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
TOKEN = re.compile(r"(?<![A-Za-z0-9._%+@()-])(?=[A-Za-z._%+()-]*+[0-9@]|[A-Za-z._%+-]++\(at\)[A-Za-z])[A-Za-z0-9._%+@()-]++")
NOT_DIGIT = re.compile(r"[^0-9]+")
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in time linear in the text."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > low and text[first - 1] in LOCAL:
            first -= 1
        m = HOST.match(text, at + 1) if first < at else None
        if m:
            out.append((first, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[list[Span]]:
    """The spans of each kind; matches that fail their kind's test are dropped without another try."""
    if not ANY.search(text):
        return [[], [], [], []]
    ips = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []
    return [emails(text) if "@" in text else [], ips, cards, phones]


def _bucket(n: int) -> int:
    return int(np.searchsorted((1, 4, 7, 9, 13, 20), n, "right"))


FEATURES = 36
#: Numbers written as dates or times of day.
DATE = re.compile(r"\W*(?:\d{4}[-.]\d{1,2}[-.]\d{1,2}|\d{1,2}[-.]\d{1,2}[-.](?:19|20)\d{2}|(?:[01]?\d|2[0-3])\.[0-5]\d(?:\.[0-5]\d)?)\W*")
AT = re.compile(r"[A-Za-z0-9]\(at\)[A-Za-z0-9]", re.I)
ENDS = re.compile(r"[A-Za-z0-9-]\.[A-Za-z]{2,}\W*$")


class Nodes:
    """The field's nodes of one text: spans, features, links along the chain, hub of each, held labels."""

    def __init__(self, text: str, base: list[list[Span]]):
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        self.ends = [a + len(text[a:b].rstrip(".-(")) for a, b in self.spans]  # without what ends a sentence
        n = len(self.spans)
        self.x = np.zeros((n, FEATURES))
        self.linked = np.zeros(n, bool)  # to the next
        self.hub = np.full(n, -1)
        self.held = np.zeros(n, np.int64)
        keys: dict[str, int] = {}
        digits = self.digits = []
        for k, (a, b) in enumerate(self.spans):
            tok = text[a:b]
            d = NOT_DIGIT.sub("", tok)
            digits.append(d)
            if k + 1 < n and self.spans[k + 1][0] - b <= 2 and text[b : self.spans[k + 1][0]].strip(" -") == "":
                self.linked[k] = True
            key = d if len(d) >= 4 else tok.partition("@")[0].lower() if "@" in tok[1:] else ""
            if key:
                self.hub[k] = keys.setdefault(key, len(keys))
            f = self.x[k]
            f[_bucket(len(d))] = 1
            f[7:14] = ("@" in tok, tok.count("@") == 1 and "." in tok.partition("@")[2], any(c.isalpha() for c in tok), tok[0] == "+",
                       "(" in tok or ")" in tok, "-" in tok, 13 <= len(d) <= 19 and luhn(d))
            parts = tok.strip(".()-").split(".")
            f[14] = len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
            f[26:33] = (13 <= len(d) <= 19, AT.search(tok) is not None, ENDS.search(tok) is not None, len(parts) == 4, len(parts) == 3 and len(d) == 10, len(set(parts)) > 1, tok.isalnum() and not tok.isdigit())
        first = 0
        for k in range(n):  # what a run of linked nodes says as a whole
            if not self.linked[k]:
                run = "".join(digits[first : k + 1])
                rows = self.x[first : k + 1]
                rows[:, 15 + _bucket(len(run))] = 1
                rows[:, 22:26] = (text[self.spans[first][0]] == "+", 13 <= len(run) <= 19 and luhn(run), k > first, 9 <= len(run) <= 15)
                first = k + 1
            self.x[k, 33] = DATE.fullmatch(text[self.spans[k][0] : self.spans[k][1]]) is not None
            self.x[k, 34] = self.x[k, 0] == 0 and text[self.spans[k][0] : self.spans[k][1]].strip("().-").isdigit()
        self.x[:, 35] = 1
        starts, ends = np.array([a for a, _ in self.spans]), np.array([b for _, b in self.spans])
        for kind, spans in enumerate(base, 1):
            for a, b in spans:  # nodes stand in order and apart, so those that a span touches are a run
                self.held[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b)] = kind
        self.hubs = len(keys)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Graph:
    """The nodes of one or more texts as arrays: features, held labels (0: free), links along the chain and hubs."""

    def __init__(self, x: np.ndarray, held: np.ndarray, linked: np.ndarray, hub: np.ndarray, hubs: int):
        self.x, self.held, self.hubs = x, held, hubs
        self.left = np.flatnonzero(linked[:-1]) if len(linked) else np.zeros(0, np.int64)
        self.member = np.flatnonzero(hub >= 0)
        self.hub = hub[self.member]


class Field:
    """Weights of the nodes' features, of chain links (left label, right label) and of hub links (member's label, hub's label)."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def beliefs(self, g: Graph, rounds: int = 8, hold: float = 25.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log P of each node's label, of each chain link's labels and of each hub link's, by ``rounds`` rounds of messages."""
        u = g.x @ self.weights
        u = u - _lse(u, 1)[:, None]
        known = np.flatnonzero(g.held)
        u[known, g.held[known]] += hold
        a = g.left
        right, left = np.zeros((2, len(a), LABELS))  # to a + 1, to a
        back = np.zeros((len(g.member), LABELS))  # from the hub

        def belief() -> np.ndarray:
            b = u.copy()
            b[a + 1] += right  # a node has one link on either side
            b[a] += left
            b[g.member] += back
            return b

        total = up = np.zeros((0, LABELS))
        for _ in range(rounds):
            b = belief()
            new_right = _lse((b[a] - left)[:, :, None] + self.chain[None], 1)
            new_left = _lse((b[a + 1] - right)[:, None, :] + self.chain[None], 2)
            up = _lse((b[g.member] - back)[:, :, None] + self.skip[None], 1)
            up -= up.max(axis=1, keepdims=True)
            total = np.column_stack([np.bincount(g.hub, up[:, k], g.hubs) for k in range(LABELS)]) if len(up) else np.zeros((g.hubs, LABELS))
            back = _lse((total[g.hub] - up)[:, None, :] + self.skip[None], 2)
            right, left = new_right - new_right.max(axis=1, keepdims=True), new_left - new_left.max(axis=1, keepdims=True)
            back -= back.max(axis=1, keepdims=True)
        b = belief()
        pair = (b[a] - left)[:, :, None] + self.chain[None] + (b[a + 1] - right)[:, None, :]
        hub = (b[g.member] - back)[:, :, None] + self.skip[None] + (total[g.hub] - up)[:, None, :]
        even = lambda z: z - _lse(z.reshape(len(z), LABELS * LABELS), 1)[:, None, None]
        return b - _lse(b, 1)[:, None], even(pair), even(hub)

    def marginals(self, nodes: Nodes, rounds: int = 8) -> np.ndarray:
        """P(label) of each node."""
        return np.exp(self.beliefs(Graph(nodes.x, nodes.held, nodes.linked, nodes.hub, nodes.hubs), rounds)[0])


#: Digits of a whole number of each kind, at least and at most.
WHOLE = {3: (13, 19), 4: (7, 15)}


def added_spans(nodes: Nodes, p: np.ndarray, base: list[list[Span]], least: float = 0.5) -> list[tuple[int, Span]]:
    """Runs of linked nodes with one likely kind that touch no base span of any kind. A card or phone is a whole number: figures
    linked to it belong to it, unless they are a date or stand in a base span; what then has too few or too many digits, or a letter, is none."""
    taken = sorted(s for spans in base for s in spans)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    label = np.where(p[:, 1:].max(axis=1) >= least, p[:, 1:].argmax(axis=1) + 1, 0) if len(p) else np.zeros(0, int)
    goes_on = lambda k: nodes.linked[k] and (nodes.hub[k] < 0 or nodes.hub[k + 1] != nodes.hub[k])  # noqa: E731  one number twice is two spans
    figures = lambda k, kind: not nodes.held[k] and not nodes.x[k, 33] and (nodes.x[k, 34] or label[k] == kind)
    out, k, done = [], 0, 0
    while k < len(label):
        first = end = k
        while goes_on(end) and label[end + 1] == label[k]:
            end += 1
        whole = True
        if label[k] in WHOLE:
            while goes_on(end) and figures(end + 1, label[k]):
                end += 1
            while first > done and goes_on(first - 1) and figures(first - 1, label[k]):
                first -= 1
            low, high = WHOLE[int(label[k])]
            whole = low <= sum(map(len, nodes.digits[first : end + 1])) <= high and not nodes.x[first : end + 1][:, [9, 33]].any()  # no letters, no dates
        if label[k] and whole and not nodes.held[first : end + 1].any():
            a, b = nodes.spans[first][0], nodes.ends[end]
            before = bisect_left(starts, b)  # of the base spans that begin before the end, the furthest must end before the start
            if not before or reach[before - 1] <= a:
                out.append((int(label[k]) - 1, (a, b)))
        k = done = end + 1
    return out


def fit_arrays(g: Graph, truth: np.ndarray, steps: int = 150, rounds: int = 4, rate: float = 0.15, penalty: float = 2e-4) -> Field:
    """Weights by the gradient of the log-likelihood of ``truth``, with the graph's held labels given."""
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS))
    field.weights[FEATURES - 1, 0] = 3.0
    if not len(truth):
        return field
    theta = [field.weights, field.chain, field.skip]
    m, v = ([np.zeros_like(t) for t in theta] for _ in range(2))
    pairs = np.zeros((LABELS, LABELS))
    np.add.at(pairs, (truth[g.left], truth[g.left + 1]), 1)
    seen_x, mine = g.x.T @ np.eye(LABELS)[truth], truth[g.member]
    for t in range(1, steps + 1):
        node, pair, hub = (np.exp(z) for z in field.beliefs(g, rounds))
        # A hub's own label is not seen: what is expected of it given its members' labels takes the place of what is seen.
        of = np.column_stack([np.bincount(g.hub, field.skip[mine, k], g.hubs) for k in range(LABELS)])
        of = np.exp(of - _lse(of, 1)[:, None])[g.hub]
        shared = np.zeros((LABELS, LABELS))
        np.add.at(shared, mine, of)
        slopes = [g.x.T @ node - seen_x, pair.sum(0) - pairs, hub.sum(0) - shared]
        for k in range(3):
            d = slopes[k] / len(truth) + penalty * theta[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            theta[k] -= rate / (1 + t / 60) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)  # in place: the field's own
    return field


def respelled(kind: int, value: str, rng: random.Random) -> str | None:
    """``value`` as no pattern reads it, or None."""
    d = NOT_DIGIT.sub("", value)
    if kind == 0 and value.count("@") == 1:
        return value.replace("@", "(at)")
    if kind == 2:
        groups = [d[k : k + 4] for k in range(0, len(d), 4)]
        return rng.choice([".".join(groups), "--".join(groups), f"{d} {d}", f"{d} {d} {d}"])
    if kind == 3 and len(d) > 10:
        d = d[-10:]
        return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"({d[:3]}){d[3:6]}-{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"0{d[:2]} {d[2:6]} {d[6:]}", f"00{d[:2]} {d[2:4]} {d[4:7]} {d[7:]}"])
    return None


def example(text: str, rng: random.Random) -> tuple[str, list[tuple[int, Span]]]:
    """``text`` with some of the matches spelled otherwise, or mentioned once more at the end, and all that is personal data in it."""
    found = sorted((s, k) for k, spans in enumerate(base_spans(text)) for s in spans)
    out, at, truth = "", 0, []

    def put(kind: int, value: str) -> None:
        nonlocal out
        first = len(out)
        out += value
        truth.append((kind, (first, len(out))))

    again = []
    for (a, b), kind in found:
        if a < at:
            continue
        out += text[at:a]
        value = text[a:b]
        other = respelled(kind, value, rng) if rng.random() < 0.6 else None
        put(kind, other or value)
        if rng.random() < 0.4:
            again.append((kind, value if other else respelled(kind, value, rng) or value))
        at = b
    out += text[at:]
    for kind, value in again:
        out += " and "
        put(kind, value)
    return out, truth


def made(n: int, seed: int = 7) -> list[str]:
    """Short texts with personal data of every kind among numbers that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = rng.choice("3456") + digits(rng.choice([13, 14, 14, 14]))
        return next(d + c for c in "0123456789" if luhn(d + c))

    def day() -> str:
        y, m, d = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 32)
        return rng.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d}-{m}-{y}", f"{y}.{m:02}.{d:02}"])

    def ordinary() -> str:
        d = digits(16)
        return rng.choice([
            str(rng.randrange(3000)), f"{rng.randrange(1, 20)}.{rng.randrange(10)}", f"{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(99)}", f"{rng.randrange(1900, 2100)}-{rng.randrange(10, 13)}-{rng.randrange(10, 32)}",
            f"{rng.randrange(300, 999)}.{rng.randrange(999)}.{rng.randrange(999)}.{rng.randrange(999)}", "7" + digits(5), digits(8), digits(10), next(d[:-1] + c for c in "0123456789" if not luhn(d[:-1] + c)), f"{rng.randrange(99)}%",
            f"{rng.randrange(10, 99)}-{rng.randrange(10, 99)}", f"v{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(9)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40]))),
            f"@{rng.choice(['ann', 'bo', 'cy'])}{rng.randrange(99)}", f"({rng.randrange(100)})", f"{rng.randrange(24)}.{rng.randrange(10, 60)}",
            f"{day()} {rng.randrange(24)}.{rng.randrange(10, 60)}", f"{day()} - {day()}", f"{rng.randrange(1, 99)} {rng.randrange(1, 99)}"])

    def private() -> str:
        return [
            lambda: f"{rng.choice(['ann', 'bo.lee', 'c_d', 'eva'])}{rng.choice(['', digits(2), '.' + digits(2)])}@{rng.choice(['mail', 'post', 'x'])}{rng.choice(['', digits(1)])}.{rng.choice(['example.com', 'org', 'test.net'])}",
            lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card,
            lambda: f"+{rng.choice(['1', '44', '49'])} ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"][rng.randrange(4)]()

    return [" ".join(x for _ in range(5) for x in ("w" * rng.randrange(2, 8), private() if rng.random() < 0.35 else ordinary())) + " ." for _ in range(n)]


def taught(text: str, rng: random.Random, hidden: float = 0.4, most_nodes: int = 400) -> np.ndarray:
    """Rows of features, truth, held, linked and hub (as text + 1, or 0) of an example made from ``text``; of more than ``most_nodes``
    those of some chains, drawn over the whole text."""
    text, truth = example(text, rng)
    base = base_spans(text)
    nodes = Nodes(text, base)
    label, held = nodes.held.copy(), nodes.held.copy()
    starts, ends = np.array([a for a, _ in nodes.spans]), np.array([b for _, b in nodes.spans])
    for kind, (a, b) in truth:
        label[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b)] = kind + 1
    chains = np.cumsum(np.concatenate([[True], ~nodes.linked[:-1]])) if len(held) else np.zeros(0, np.int64)
    free = np.array([rng.random() < hidden for _ in range(int(chains[-1]) + 1 if len(held) else 0)], bool)
    held[free[chains] if len(held) else []] = 0
    rows = np.column_stack([nodes.x, label, held, nodes.linked, nodes.hub + 1]).astype("<u4")
    if len(rows) > most_nodes:
        order = rng.sample(range(1, int(chains[-1]) + 1), int(chains[-1]))
        rank = np.zeros(int(chains[-1]) + 1, np.int64)
        rank[order] = np.cumsum(np.bincount(chains)[order])
        rows = rows[rank[chains] <= most_nodes]
    return rows


def graph(parts: list[np.ndarray]) -> tuple[Graph, np.ndarray]:
    """The disjoint union of what ``taught`` gave, and its truth."""
    hub, hubs = [np.zeros(0, np.int64)], 0
    for p in parts:
        own, at = np.unique(p[:, -1], return_inverse=True)
        none = int(len(own) > 0 and own[0] == 0)
        hub.append(np.where(p[:, -1] > 0, at - none + hubs, -1))
        hubs += len(own) - none
    whole = np.concatenate([np.zeros((0, FEATURES + 4)), *parts]).astype(np.int64)
    return Graph(whole[:, :FEATURES].astype(float), whole[:, FEATURES + 1], whole[:, FEATURES + 2] > 0, np.concatenate(hub), hubs), whole[:, FEATURES]


def fit(docs: DataFrame, sample_docs: int = 5000, most_nodes: int = 8000, doc_nodes: int = 400, synthetic: int = 600) -> Field:
    """Fits on ``synthetic`` made texts and on about ``sample_docs`` documents, of which about ``most_nodes`` nodes, taken by documents, come to
    the driver; both samples go by a hash of the ids, and a document gives ``doc_nodes`` nodes at most, drawn over its whole text."""
    share = -(-sample_docs * (1 << 20) // max(1, docs.count()))
    some = docs.select(F.xxhash64("doc_id", F.lit("pii")).alias("h"), "text").filter(F.col("text").rlike(ANY.pattern) & (F.pmod("h", F.lit(1 << 20)) < share))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [taught(text.as_py(), random.Random(h), most_nodes=doc_nodes) for h, text in zip(batch.column("h").to_pylist(), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["h", "n", "nodes"])

    found = Scratch(docs.sparkSession, "pii").keep(some.mapInArrow(teach, "h long, n long, nodes binary").filter("n > 0"))
    nodes = found.agg(F.sum("n")).first()[0] or 0
    share = -(-most_nodes * (1 << 20) // max(1, nodes))
    got = found.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share).orderBy("h", "nodes").collect()  # about most_nodes nodes of 152 bytes
    parts = [np.frombuffer(r["nodes"], "<u4").reshape(-1, FEATURES + 4) for r in got]
    rng = random.Random(11)
    return fit_arrays(*graph(parts + [taught(t, rng) for t in made(synthetic)]))


def find(text: str | None, field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, all spans) by kind."""
    base = base_spans(text or "")
    every = [list(s) for s in base]
    if text and ANY.search(text):
        nodes = Nodes(text, base)
        if nodes.spans:
            for kind, span in added_spans(nodes, field.marginals(nodes), base):
                every[kind].append(span)
    return base, [sorted(s) for s in every]


def joined(spans: list[list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def private_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans (base and added, as text) of each row of ``docs``.

    Null texts count as empty; repeated rows each get their row; an empty table gives an empty result;
    columns other than doc_id and text are not read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                base, every = find(text.as_py(), field)
                for col, v in zip(cols, (*map(len, base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)), strict=True):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)


def masked(text: str | None, field: Field) -> str | None:
    """``text`` with every found span replaced by its kind in brackets; of overlapping spans the first stays."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, found in zip(KINDS, find(text, field)[1], strict=True) for a, b in found):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return private_spans(docs, fit(docs))
