"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

Tokens with a digit or an @ are the variables. Neighbours share a chain potential;
distant tokens of one document that are alike (same characters but for case and
punctuation, or the same digits) share a skip potential, so labels carry over.
All weights are trained together, by the pseudo-likelihood of labels given the
labels that edges tie to them. Loopy sum-product messages give marginals; tokens in pattern spans are observed.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import few_at_a_time, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^ \t-\r]+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NOT_ALNUM = re.compile(r"[\W_]+")

Span = tuple[int, int, int]  # start, end, kind


def _emails(text: str):
    """Anchored at each @, so that time stays linear in runs without one."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = at = domain.end()
        else:
            at += 1


def _ips(text: str):
    """Groups of digits joined by single dots are taken four at a time from the left."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, groups = run.start(), run.group().split(".")
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g[-3:]) <= 255 for g in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by start, then kind."""
    if not _ANY.search(text):
        return []
    found = [(a, b, k) for k, f in enumerate((_emails, _ips, _cards, _phones)) for a, b in f(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text) if _ANY.search(m.group())]


def features(token: str) -> list[str]:
    """Names of what holds of a token: its shape, lengths and signs."""
    core = token.strip(".,;:!?\"'")
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    out = [
        "bias",
        f"digits={min(digits, 20) if digits < 4 else 4 if digits < 8 else 8 if digits < 14 else 14 if digits < 20 else 20}",
        f"letters={'none' if not letters else 'some' if letters < digits else 'most'}",
        f"dots={min(core.count('.'), 4)}",
        f"hyphens={min(core.count('-'), 3)}",
    ]
    out += [f"has={c}" for c in "@+()=_:/" if c in core]
    out.append("shape=" + re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in core))[:12])
    return out


def likeness(token: str) -> list[str]:
    """Keys that tokens which are repeated or similar have in common."""
    out = []
    plain = _NOT_ALNUM.sub("", token.lower())
    if len(plain) >= 4:
        out.append("c" + plain)
    digits = _NOT_DIGIT.sub("", token)
    if len(digits) >= 6:
        out.append("d" + digits)
    return out


def edges(text: str, spans: list[tuple[int, int]], reach: int = 8) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip): pairs of neighbours with one space between, and of alike tokens that no chain edge ties. A token is tied to
    the `reach` alike ones before it, so a group of that size is tied throughout and a larger one in time linear in its size."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if text[spans[i][1] : spans[i + 1][0]] == " "]
    tied, skip = set(chain), []
    groups: dict[str, list[int]] = defaultdict(list)
    for i, (a, b) in enumerate(spans):
        for key in likeness(text[a:b]):
            for j in groups[key][-reach:]:
                if (j, i) not in tied:
                    tied.add((j, i))
                    skip.append((j, i))
            groups[key].append(i)
    return chain, skip


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class SkipChain:
    """Potentials as log weights: node (feature x label), chain (left x right label) and skip (label x label, symmetric)."""

    def __init__(self, node: dict[str, list[float]], chain: list[list[float]], skip: list[list[float]]):
        self.node = {k: np.array(v) for k, v in node.items()}
        self.chain, self.skip = np.array(chain), np.array(skip)

    def to_json(self) -> str:
        return json.dumps({"node": {k: v.tolist() for k, v in self.node.items()}, "chain": self.chain.tolist(), "skip": self.skip.tolist()})

    @classmethod
    def from_json(cls, text: str) -> SkipChain:
        x = json.loads(text)
        return cls(x["node"], x["chain"], x["skip"])

    def local(self, tokens: list[str], observed: dict[int, int]) -> np.ndarray:
        """Log weights of each token's labels, its edges apart."""
        out = np.zeros((len(tokens), len(LABELS)))
        for i, t in enumerate(tokens):
            for f in features(t):
                w = self.node.get(f)
                if w is not None:
                    out[i] += w
        for i, k in observed.items():
            out[i] = -30.0
            out[i, k] = 0.0
        return out - out.max(1, keepdims=True)

    def marginals(self, text: str, spans: list[tuple[int, int]], observed: dict[int, int], rounds: int = 20) -> np.ndarray:
        """Loopy sum-product, damped, until messages stand still or for so many rounds."""
        local = self.local([text[a:b] for a, b in spans], observed)
        chain, skip = edges(text, spans)
        if not chain and not skip:
            return _softmax(local)
        left, right = np.array([*chain, *skip]).T
        src, dst = np.concatenate((left, right)), np.concatenate((right, left))
        each = np.stack([self.chain] * len(chain) + [self.skip] * len(skip))
        pots = np.concatenate((each, each.transpose(0, 2, 1)))
        m = len(left)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        messages = np.zeros((2 * m, len(LABELS)))
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, dst, messages)
            out = belief[src] - messages[back]
            out = np.logaddexp.reduce(out[:, :, None] + pots, axis=1)
            out -= out.max(1, keepdims=True)
            moved = np.abs(out - messages).max()
            messages = 0.5 * messages + 0.5 * out
            if moved < 1e-9:
                break
        belief = local.copy()
        np.add.at(belief, dst, messages)
        return _softmax(belief)


def token_labels(spans: list[tuple[int, int]], base: list[Span]) -> dict[int, int]:
    """The label of each token that a pattern span touches; the first span wins. Both lists are sorted: one sweep."""
    out: dict[int, int] = {}
    first = 0
    for a, b, k in base:
        while first < len(spans) and spans[first][1] <= a:
            first += 1  # ends before this span begins, and so before all later ones do
        i = first
        while i < len(spans) and spans[i][0] < b:
            out.setdefault(i, k + 1)
            i += 1
    return out


def train(texts: list[str], steps: int = 300, rate: float = 1.0, decay: float = 1e-3, max_tokens: int = 200_000) -> SkipChain:
    """The weights of largest pseudo-likelihood, by gradient ascent: each label given its token and the labels that edges tie to it.

    Labels are the patterns'. decay keeps weights that few tokens speak for small; without tokens all weights are nought. Texts are
    taken in turn until they have max_tokens tokens; tokens with the same features share a row.
    """
    rows: list[tuple[str, ...]] = []
    labels: list[int] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    for text in texts:
        spans, at = candidates(text), len(rows)
        if at >= max_tokens:
            break
        known = token_labels(spans, base_spans(text))
        labels += [known.get(i, 0) for i in range(len(spans))]
        rows += [tuple(features(text[a:b])) for a, b in spans]
        for into, found in zip((chain, skip), edges(text, spans), strict=True):
            into += [(at + i, at + j) for i, j in found]
    names = sorted({f for r in rows for f in r})
    place = {f: i for i, f in enumerate(names)}
    n, m = len(rows), len(LABELS)
    node, across, alike = np.zeros((len(names), m)), np.zeros((m, m)), np.zeros((m, m))
    if n:
        kinds = {r: i for i, r in enumerate(dict.fromkeys(rows))}
        kind = np.array([kinds[r] for r in rows])
        most = max(map(len, kinds))
        held = np.array([[*(place[f] for f in r), *[len(names)] * (most - len(r))] for r in kinds])  # the row after the last is of no feature
        y = np.eye(m)[labels]

        def beside(pairs: list[tuple[int, int]]) -> np.ndarray:
            """Of each token, how often each label stands at the other end of these (from, to) pairs, over the tokens `to`."""
            out = np.zeros((n, m))
            if pairs:
                a, b = np.array(pairs).T
                np.add.at(out, b, y[a])
            return out

        before, after = beside(chain), beside([(j, i) for i, j in chain])
        tied = beside([*skip, *[(j, i) for i, j in skip]])
        weight = 1 / np.maximum(tied.sum(1, keepdims=True), 1)  # a large group speaks once a token
        for _ in range(steps):
            own = np.concatenate((node, np.zeros((1, m))))[held].sum(1)
            miss = y - _softmax(own[kind] + before @ across + after @ across.T + (tied * weight) @ alike)
            by_kind = [np.repeat(np.bincount(kind, miss[:, k], len(kinds)), most) for k in range(m)]
            step = np.stack([np.bincount(held.ravel(), w, len(names) + 1)[:-1] for w in by_kind], 1)
            node += rate * (step / n - decay * node)
            across += rate * ((before.T @ miss + (after.T @ miss).T) / n - decay * across)
            step = (tied * weight).T @ miss / n
            alike += rate * ((step + step.T) / 2 - decay * alike)
    return SkipChain({f: node[i].tolist() for f, i in place.items()}, across.tolist(), alike.tolist())


def fit(docs: DataFrame, max_docs: int = 1_500, max_chars: int = 8_000) -> SkipChain:
    """Trains on at most max_docs texts of at most max_chars characters with a digit or @, those whose md5(doc_id) comes first.

    This bounds what is learned from, not what is searched: every text is searched whole. Without such texts all weights are even.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    fit_for = F.col("text").rlike("[0-9@]") & (F.length("text") <= max_chars)
    rows = docs.filter(fit_for).select(key.alias("_key"), F.xxhash64("text").alias("_tie"), "text")
    first = rows.select("_key", "_tie").distinct().orderBy("_key", "_tie").limit(max_docs)  # digests alone meet at the driver
    some = rows.join(F.broadcast(first), ["_key", "_tie"]).dropDuplicates(["_key", "_tie"])  # max_docs rows of two digests
    return train([r["text"] for r in some.select("_key", "_tie", "text").collect() if r["text"]])


def find(text: str, model: SkipChain, certain: float = 0.95) -> tuple[list[Span], list[Span]]:
    """(pattern spans, all spans): the field adds runs of tokens whose marginal for one kind is at least `certain`."""
    base = base_spans(text)
    spans = candidates(text)
    if not spans:
        return base, base
    observed = token_labels(spans, base)
    if len(observed) == len(spans):
        return base, base
    p = model.marginals(text, spans, observed)
    added: list[Span] = []
    for i, (a, b) in enumerate(spans):
        k = int(p[i].argmax())
        if i in observed or k == 0 or p[i, k] < certain:
            continue
        token = text[a:b]
        a += len(token) - len(token.lstrip(".,;:!?\"'"))
        b -= len(token) - len(token.rstrip(".,;:!?\"'"))
        if a >= b:
            continue
        if added and added[-1][2] == k - 1 and text[added[-1][1] : a] == " ":
            added[-1] = (added[-1][0], b, k - 1)
        else:
            added.append((a, b, k - 1))
    return base, sorted([*base, *added], key=lambda s: (s[0], s[2], s[1]))


def find_personal_data(docs: DataFrame, model: SkipChain) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text.

    Counts and base_sha256 are of the pattern spans; spans has those and the field's, as
    kind:start:end in code points, by start; ties go by kind, then end. A null text is empty, a very long one is searched
    whole; repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    import hashlib

    held = model.to_json()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches):
        field = SkipChain.from_json(held)
        empty = hashlib.sha256(b"").hexdigest()
        for batch in few_at_a_time(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = find(text, field) if text and _ANY.search(text) else ([], [])
                counts = [0, 0, 0, 0]
                for s in base:
                    counts[s[2]] += 1
                rows.append((*counts, hashlib.sha256(show(base).encode()).hexdigest() if base else empty, show(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema)
