r"""Personal data by a skip-chain conditional random field over fixed base patterns.

Base spans come from four patterns and their checks.  The field then looks at what they leave: its nodes are whole
mentions (a base span, a run of digit and separator tokens, or a token with a digit or an at sign; every other
token is O by its features, so leaving it out changes no marginal), its chain potentials join neighbouring nodes,
and its skip potentials join a node with the previous nodes of the same or a similar key (same digits, or seven and
more that end the other's, or same letters around an at sign) however far away.  Loopy belief propagation with the
base spans as observed labels spreads an entity's label to its other mentions, such as a phone number repeated
without its plus sign.  A free node becomes a span if its marginal passes `threshold`, and by nothing else.

Potentials are learned on a bounded sample of documents.  Base spans are observed labels, and so is O for a node that
neither has an entity's form nor hangs together with a base span by skip edges; the patterns can't tell what the other
nodes are, so their labels are latent and expectation-maximisation fills them in: unary weights by multinomial logistic
regression on observed and expected labels (phones also as they are written without their country code), chain and
skip potentials by smoothed log ratios of expected counts of label pairs, those that disagree included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import batches, records, sample_rows

KINDS = ("email", "ip", "card", "phone")
_EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digit runs are taken whole: a match of these patterns can only begin where a run does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Tokens are matched whole and searched then, so that one long token is read once.
_TOKEN, _MARK = re.compile(r"[^\x20\x09-\x0D]++"), re.compile("[0-9@]")
#: A token that other tokens of a number may follow, one that may follow, and the most digits of a mention.
_OPENS, _FOLLOWS, _MOST = re.compile(r"[+(]*[0-9][0-9().-]*(?<![.])"), re.compile(r"\(?[0-9][0-9().-]*[^\x20\x09-\x0DA-Za-z@+0-9]*"), 19
_NATIONAL = re.compile(r"(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}")
_GROUPS = re.compile(r"[0-9]{4}(?:[\x20.-][0-9]{4}){2}[\x20.-][0-9]{1,7}")
_COUNTRY = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?=[(0-9])")
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|="


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns: by kind, then start, in code points.  Linear in the text."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        last = 0
        for m in _EMAIL_RIGHT.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _EMAIL_LEFT:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def shown(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# Labels of the field: 0 is O, 1 + k is KINDS[k].
LABELS = 1 + len(KINDS)
_BINS = (1, 4, 7, 9, 13, 20, 41)
FEATURES = 14 + len(_BINS) + 1
#: What is known of linked mentions beforehand, worth PRIOR pairs: both are the same, but for a share DIFFER.  ROUNDS of expectation-maximisation.
PRIOR, DIFFER, ROUNDS = 20.0, 0.001, 4


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without punctuation at its ends; a bracket that opens a number stays."""
    closing = text.rfind(")", a, b)
    while a < b and text[a] in _EDGE and not (text[a] == "(" and a < closing):
        a += 1
    while a < b and text[b - 1] in _EDGE:
        b -= 1
    return a, b


def shape_of(mention: str) -> int:
    """The label whose form a mention has though no base pattern need match: grouped cards and phones; else 0."""
    core = mention[slice(*trimmed(mention, 0, len(mention)))]
    if _GROUPS.fullmatch(core) and 13 <= len(_digits(core)) <= 19 and luhn(_digits(core)):
        return 3
    core = _COUNTRY.sub("", core, count=1)
    return 4 if 9 <= len(_digits(core)) <= 11 and _NATIONAL.fullmatch(core) else 0


def features(token: str, before: str) -> np.ndarray:
    """What a node looks like, and whether the token before it looks like the start of a number."""
    n, x = sum("0" <= c <= "9" for c in token), np.zeros(FEATURES)
    core = token.strip(_EDGE)
    parts = core.split(".")
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    local, at, domain = core.partition("@")
    shape = shape_of(token)
    x[:14] = (
        1, bool(at and local and "." in domain), bool(at), four and all(len(p) <= 3 and int(p) <= 255 for p in parts), four,
        token.startswith("+"), "(" in token or ")" in token, "-" in core, 13 <= n <= 19 and n == len(core.replace("-", "").replace(" ", "")) and luhn(_digits(core)),
        n == len(core), any(c.isalpha() for c in core), before.startswith("+") and before[1:2].isdigit() or before.endswith(")"),
        shape == 3, shape == 4,
    )
    x[14 + int(np.searchsorted(_BINS, n, "right"))] = 1
    return x


@dataclass
class Nodes:
    spans: list[tuple[int, int]]
    labels: list[int]  # of the base spans; 0 where none covers the node
    x: np.ndarray
    chain: np.ndarray  # pairs of neighbouring nodes
    skip: np.ndarray  # pairs of a node and the node before it of the same key


def mentions_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the nodes in order: base spans that don't overlap one before, and runs of what is left."""
    out: list[tuple[int, int, int]] = []
    order, known, end = [], set(), 0
    for kind, a, b in sorted(base, key=lambda s: (s[1], s[0], s[2])):
        if kind >= 2:
            known.add(_digits(text[a:b]))
        if a >= end:
            order.append((a, b, 1 + kind))
            end = b
    at = 0
    for a, b, label in [*order, (len(text), len(text), 0)]:
        run: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(text, at, a):
            s, e = m.span()
            if not _MARK.search(text, s, e):
                continue
            joins = run and s == run[-1][1] + 1 and text[s - 1] == " " and _OPENS.fullmatch(text, *run[-1]) and _FOLLOWS.fullmatch(text, s, e)
            if run and not joins:
                out += _cut(text, run, known)
                run = []
            run.append((s, e))
        out += _cut(text, run, known)
        if label:
            out.append((a, b, label))
        at = b
    return out


def _cut(text: str, run: list[tuple[int, int]], known: set[str]) -> list[tuple[int, int, int]]:
    """A run's mentions: its parts with a known number's digits or their end, else all of it, or its tokens if it is too long for one."""
    if len(run) < 2:
        return [(a, b, 0) for a, b in run]
    digits = [_digits(text[a:b]) for a, b in run]
    ends = {x[k:] for x in known for k in range(max(1, len(x) - 6))} if known else set()
    out, left, k = [], [], 0

    def rest() -> None:
        if left and sum(len(digits[j]) for j in left) <= _MOST:
            out.append((run[left[0]][0], run[left[-1]][1], 0))
        else:
            out.extend(_shaped(text, [run[j] for j in left]))
        left.clear()

    while k < len(run):
        joined, hit = "", 0
        for j in range(k, len(run)):
            joined += digits[j]
            if len(joined) > _MOST:
                break
            if joined in ends:
                hit = j + 1
        if hit:
            rest()
            out.append((run[k][0], run[hit - 1][1], 0))
            k = hit
        else:
            left.append(k)
            k += 1
    rest()
    return out


def _shaped(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The tokens of a long run, those joined that have an entity's shape together."""
    out, k = [], 0
    while k < len(run):
        n = next((n for n in (4, 3, 2) if k + n <= len(run) and shape_of(text[run[k][0] : run[k + n - 1][1]])), 1)
        out.append((run[k][0], run[k + n - 1][1], 0))
        k += n
    return out


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> Nodes:
    found = mentions_of(text, base)
    spans, labels = [(a, b) for a, b, _ in found], [label for *_, label in found]
    tokens = [text[a:b] for a, b in spans]
    before = [tokens[k - 1] if k and spans[k][0] - spans[k - 1][1] == 1 else "" for k in range(len(spans))]
    chain = [(k - 1, k) for k in range(len(spans)) if before[k]]
    skip: list[tuple[int, int]] = []
    same: dict[str, int] = {}
    longer: dict[str, int] = {}  # an end of a key, to the last node of a key that is longer
    for k, token in enumerate(tokens):
        key = key_of(token)
        if not key:
            continue
        # Long tokens hold more than one number, so only a mention's digits are compared by their ends.
        ends = [key[j:] for j in range(1, len(key) - 6)] if "@" not in key and len(key) <= _MOST else []
        near = [same.get(key), longer.get(key), next((same[x] for x in ends if x in same), None)]
        skip += [(j, k) for j in sorted({j for j in near if j is not None})]
        same[key] = k
        for x in ends:
            longer[x] = k
    x = np.array([features(t, b) for t, b in zip(tokens, before)]).reshape(-1, FEATURES)
    pairs = lambda p: np.array(p, np.int64).reshape(-1, 2)
    return Nodes(spans, labels, x, pairs(chain), pairs(skip))


def key_of(token: str) -> str:
    """What similar mentions share; "" for tokens too short to tell."""
    if "@" in token:
        core = token.strip(_EDGE).lower()
        return core if len(core) > 4 else ""
    digits = _digits(token)
    return digits if len(digits) >= 7 else ""


@dataclass
class Field:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    threshold: float = 0.9

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base and added spans by kind, then start."""
        base = base_spans(text)
        nodes = nodes_of(text, base)
        if all(nodes.labels):
            return base
        belief = self.marginals(nodes)[0]
        last, added, order, at = 0, [], sorted(base, key=lambda s: s[1]), 0
        for k, label in enumerate(nodes.labels):
            got = int(belief[k].argmax())
            if label or not got or belief[k, got] < self.threshold:
                continue
            a, b = trimmed(text, *nodes.spans[k])
            while at < len(order) and order[at][1] < b:
                last, at = max(last, order[at][2]), at + 1
            if a < b and last <= a:
                added.append((got - 1, a, b))
        return sorted([*base, *added])

    def marginals(self, nodes: Nodes, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs of the nodes, and of the label pairs of the edges (chain, then skip), by loopy sum-product in log space; observed labels are fixed."""
        own = nodes.x @ self.unary
        fixed = np.array(nodes.labels)
        own[fixed > 0] = -1e3
        own[np.flatnonzero(fixed), fixed[fixed > 0]] = 0
        edges = np.concatenate([nodes.chain, nodes.skip])
        table = np.concatenate([np.repeat(self.chain[None], len(nodes.chain), 0), np.repeat(self.skip[None], len(nodes.skip), 0)])
        # Each edge carries a message both ways: 0 .. E-1 forward, E .. 2E-1 back.
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        both = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.zeros((len(src), LABELS))

        def gathered() -> np.ndarray:
            total = own.copy()
            for c in range(LABELS):
                total[:, c] += np.bincount(dst, sent[:, c], len(own))
            return total

        for _ in range(rounds if len(edges) else 0):
            new = _logsum((gathered()[src] - sent[back])[:, :, None] + both, 1)
            new -= _logsum(new, 1)[:, None]
            if np.abs(new - sent).max(initial=0) < 1e-4:
                break
            sent = 0.5 * sent + 0.5 * new
        total, n = gathered(), len(edges)
        pairs = (total[src[:n]] - sent[n:])[:, :, None] + (total[dst[:n]] - sent[:n])[:, None, :] + table
        pairs = np.exp(pairs - _logsum(_logsum(pairs, 2), 1)[:, None, None]) if n else np.zeros((0, LABELS, LABELS))
        return np.exp(total - _logsum(total, 1)[:, None]), pairs


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def latent(text: str, nodes: Nodes) -> np.ndarray:
    """Which nodes may be entities that no base pattern sees: those of an entity's form, and those that share a key, over any number of skip edges, with a base span."""
    root = list(range(len(nodes.spans)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in nodes.skip.tolist():
        root[find(b)] = find(a)
    marked = {find(k) for k, label in enumerate(nodes.labels) if label}
    return np.array([not label and (find(k) in marked or shape_of(text[slice(*nodes.spans[k])]) > 0) for k, label in enumerate(nodes.labels)], bool)


def _regression(x: np.ndarray, target: np.ndarray, weights: np.ndarray, steps: int) -> np.ndarray:
    """Multinomial logistic regression on soft labels; rows alike in `x` are counted together."""
    x, kinds = np.unique(x, axis=0, return_inverse=True)
    share = np.zeros((len(x), LABELS))
    np.add.at(share, kinds.reshape(-1), target)
    share /= share.sum()
    rows = share.sum(1, keepdims=True)
    for _ in range(steps):
        score = x @ weights
        weights = weights + 2.0 * (x.T @ (share - rows * np.exp(score - _logsum(score, 1)[:, None])) - 1e-4 * weights)
    return weights


def train(texts: Iterable[str], threshold: float = 0.9, steps: int = 300) -> Field:
    """A field from the base labels of a sample of texts; with an empty sample it adds nothing that isn't linked."""
    observed, open_ = [], []
    chain, skip = np.ones((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    one = np.eye(LABELS)
    for text in texts:
        nodes = nodes_of(text, base_spans(text))
        if not nodes.spans:
            continue
        y, hidden = np.array(nodes.labels), latent(text, nodes)
        observed.append((nodes.x[~hidden], one[y[~hidden]]))
        # Phones without their country code: the base pattern can't label them, as it looks for the plus sign.
        bare = [_COUNTRY.sub("", text[a:b], count=1) for (a, b), label in zip(nodes.spans, nodes.labels) if label == 4 and shape_of(text[a:b]) == 4]
        observed.append((np.array([features(t, "") for t in bare]).reshape(-1, FEATURES), one[np.full(len(bare), 4)]))
        if hidden.any():
            open_.append((nodes, hidden))
        for counts, edges in ((chain, nodes.chain), (skip, nodes.skip)):
            edges = edges[~hidden[edges].any(1)]
            np.add.at(counts, tuple(y[edges].T), 1)
    ratio = lambda n: np.log(n / n.sum()) - np.log(n.sum(1) / n.sum())[:, None] - np.log(n.sum(0) / n.sum())[None]

    def linked(n: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Log ratio of a label's share among the mentions linked to a label and among all nodes, both ways alike."""
        share, n = (seen + 1) / (seen + 1).sum(), n + n.T
        given = (n + PRIOR * ((1 - DIFFER) * one + DIFFER * share)) / (n.sum(1, keepdims=True) + PRIOR)
        got = np.log(given) - np.log(share)
        return (got + got.T) / 2

    field = Field(np.zeros((FEATURES, LABELS)), ratio(chain + chain.T), linked(skip, sum((y.sum(0) for _, y in observed), np.zeros(LABELS))), threshold)
    if not observed:
        return field
    x, target = (np.concatenate(z) for z in zip(*observed))
    field.unary = _regression(x, target, field.unary, steps)
    for turn in range(ROUNDS if open_ else 0):
        more_chain, more_skip, expected = chain.copy(), skip.copy(), []
        for nodes, hidden in open_:
            # At first a latent node's own look counts for nothing: the pattern's O isn't evidence against its links.
            belief, pairs = field.marginals(nodes if turn else replace(nodes, x=np.where(hidden[:, None], 0.0, nodes.x)))
            expected.append((nodes.x[hidden], belief[hidden]))
            touched = hidden[np.concatenate([nodes.chain, nodes.skip])].any(1)
            n = len(nodes.chain)
            more_chain += pairs[:n][touched[:n]].sum(0)
            more_skip += pairs[n:][touched[n:]].sum(0)
        x2, target2 = (np.concatenate(z) for z in zip(*expected))
        field.chain, field.skip = ratio(more_chain + more_chain.T), linked(more_skip, target.sum(0) + target2.sum(0))
        field.unary = _regression(np.concatenate([x, x2]), np.concatenate([target, target2]), field.unary, steps // 3)
    return field


def train_on(docs: DataFrame, rows: int = 1_000, threshold: float = 0.9, most_chars: int = 50_000) -> Field:
    """Train on at most 2 * `rows` whole documents, chosen by a hash of doc_id among those with a digit or an at sign and of `most_chars` characters at most."""
    some = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]") & (F.length("text") <= most_chars))
    return train((r[0] for r in sample_rows(some, rows, F.col("doc_id")).select("text").collect()), threshold)


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and how many the field added.

    A null text is an empty one and has no spans.  Rows are independent (repeated rows repeat), an empty table
    gives no rows, other columns are ignored.  Time is linear in the text, also for one very long token.
    """

    def run(arrow: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in records(arrow):
                base = base_spans(text or "")
                spans = field.spans(text or "")
                counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                yield doc_id, *counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), len(spans) - len(base)

        yield from batches(rows(), _FOUND)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
