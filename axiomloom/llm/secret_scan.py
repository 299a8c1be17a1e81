"""Secret scans: wide candidate patterns, then a random forest against false positives.

The forest sees a candidate's length, its character classes and transitions,
how much of it dictionary words cover, the path it was found under and the
words next to it. It is trained from labelled findings.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow import small_batches
from .text import SPACES, whole

DICTIONARY = 4_000       # most frequent words kept
GENERATED = 3_000        # labelled findings made from known formats
LABELLED = 4_000         # labelled findings kept for training
TREES, DEPTH, LEAF, ACCEPT = 40, 9, 3, 0.5
SEED = 20

#: Kinds with a form of their own, tried first, and the general
#: forms: the value of an assignment, then any long token with a digit.
KINDS = (
    ("aws_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("assigned", r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<value>[^\s\"',;]{6,})"),
    ("token", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}"),
)
_FORMS = [(k, re.compile(p)) for k, p in KINDS]
#: For the JVM: wider than every form above. Python's forms know Unicode spaces and cases,
#: so up to eight characters of any kind (``word``, a quote, three spaces) stand before ``:=``.
_MAY_HOLD = (r"[0-9]|-----BEGIN|AKIA|ASIA|gh[pousr]_|xox[abprs]-|eyJ"
             r"|(?iu:pass|pwd|secret|token|key|auth)[^:=]{0,8}[:=]")
_ASKING = re.compile(r"(?i)(pass|pwd|secret|token|key|auth|credential)[a-z_]*[\"']?\s*[:=]?\s*[\"']?$")
_HARMLESS = re.compile(r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|test|fake|commit|sha|md5|hash|uuid|checksum|digest|version|order|id|isbn|phone|card)")
_PATHS = re.compile(r"(?i)(test|example|sample|fixture|doc|mock|vendor|lock|min)")
_PLACEHOLDER = re.compile(r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|<[a-z]|\$\{|\*{3})")
NEAR = 24                # characters of context on both sides


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str
    value: str
    before: str
    after: str


def candidates(text: str) -> list[Candidate]:
    """Candidates from left to right; earlier kinds win where they overlap."""
    starts: list[int] = []  # of what is taken, in order
    ends: list[int] = []
    out = []
    for kind, form in _FORMS:
        for m in form.finditer(text):
            group = "value" if "value" in form.groupindex else 0
            s, e = m.span(group)
            at = bisect_left(starts, s)
            if (at == 0 or ends[at - 1] <= s) and (at == len(starts) or e <= starts[at]):
                starts.insert(at, s)
                ends.insert(at, e)
                out.append(Candidate(s, e, kind, text[s:e], text[max(0, s - NEAR):s], text[e:e + NEAR]))
    return sorted(out)


class Language(NamedTuple):
    """What ordinary words look like: a dictionary and character transitions."""

    words: frozenset
    transitions: np.ndarray  # log probability of a class after a class
    longest: int             # of the words


def _classes(value: str) -> np.ndarray:
    codes = np.frombuffer(value.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.full(len(codes), 37)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    out = np.where((lower >= 97) & (lower <= 122), lower - 97, out)
    out = np.where((codes >= 48) & (codes <= 57), codes - 48 + 26, out)
    return np.where(codes > 127, 36, out)


def transition_counts(words: list[tuple[str, int]]) -> np.ndarray:
    """How often a class of characters follows another inside words that occur n times."""
    counts = np.zeros((38, 38))
    for w, n in words:
        c = _classes(w)
        np.add.at(counts, (c[:-1], c[1:]), n)
    return counts


def language(words: list[tuple[str, int]], counts: np.ndarray | None = None) -> Language:
    """Of a dictionary and the transitions of all words (default: of the dictionary's)."""
    counts = 1 + (transition_counts(words) if counts is None else counts)
    kept = frozenset(w for w, _ in words if len(w) >= 3)
    return Language(kept, np.log(counts / counts.sum(axis=1, keepdims=True)), max(map(len, kept), default=0))


def _coverage(value: str, words: frozenset, longest: int) -> float:
    """Share of the characters inside dictionary words, longest first."""
    low, at, inside = value.lower(), 0, 0
    while at < len(low):
        step = next((k for k in range(min(longest, len(low) - at), 2, -1) if low[at:at + k] in words), 0)
        inside += step
        at += step or 1
    return inside / max(1, len(low))


FEATURES = ("length", "digits", "upper", "lower", "symbols", "switches", "transitions", "entropy", "distinct", "coverage",
            "hex", "asked", "harmless", "placeholder", "quoted", "path", "form")


def features(c: Candidate, path: str, lang: Language) -> list[float]:
    v = c.value
    n = len(v)
    k = np.array([0 if ch.isdigit() else 1 if ch.isupper() else 2 if ch.islower() else 3 for ch in v])
    share = np.bincount(k, minlength=4) / n
    cls = _classes(v)
    _, counts = np.unique(cls, return_counts=True)
    p = counts / n
    forms = [name for name, _ in KINDS]
    return [
        float(n), *share.tolist(), float((np.diff(k) != 0).mean()) if n > 1 else 0.0,
        float(lang.transitions[cls[:-1], cls[1:]].mean()) if n > 1 else 0.0, float(-(p * np.log2(p)).sum()), len(counts) / n,
        _coverage(v, lang.words, lang.longest), float(all(ch in "0123456789abcdefABCDEF" for ch in v)), float(bool(_ASKING.search(c.before))),
        float(bool(_HARMLESS.search(c.before + " " + c.after))), float(bool(_PLACEHOLDER.search(v))),
        float(c.before[-1:] in "\"'" and c.before != ""), float(bool(_PATHS.search(path))), float(forms.index(c.kind)),
    ]


class Tree(NamedTuple):
    feature: np.ndarray   # -1 in leaves
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray     # of positives in the node


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> Tree:
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if level == depth or len(rows) < 2 * leaf or y[rows].min() == y[rows].max():
            return me
        best = (1e-9, -1, 0.0)
        base = 2 * y[rows].mean() * (1 - y[rows].mean()) * len(rows)
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows[order], f], y[rows[order]]
            n = np.arange(1, len(v))
            pos = np.cumsum(t)[:-1]
            rest = t.sum() - pos
            impurity = 2 * pos * (n - pos) / n + 2 * rest * (len(v) - n - rest) / (len(v) - n)
            ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(v) - n >= leaf)
            if ok.any():
                i = int(np.argmin(np.where(ok, impurity, np.inf)))
                if base - impurity[i] > best[0]:
                    best = (base - impurity[i], f, v[i])
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            nodes[me][0:2] = [best[1], best[2]]
            nodes[me][2] = split(rows[goes], level + 1)
            nodes[me][3] = split(rows[~goes], level + 1)
        return me

    split(rng.integers(0, len(x), len(x)), 0)
    a = np.array(nodes)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [_grow(x, y, rng, depth, leaf) for _ in range(trees)]


def forest_score(forest: list[Tree], x: np.ndarray) -> np.ndarray:
    """Mean share of positives in the leaves that each row reaches."""
    total = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), int)
        while (inner := t.feature[at] >= 0).any():
            goes = x[np.arange(len(x)), np.maximum(t.feature[at], 0)] <= t.cut[at]
            at = np.where(inner, np.where(goes, t.left[at], t.right[at]), at)
        total += t.share[at]
    return total / max(1, len(forest))


def generated_findings(words: list[str], n: int = GENERATED, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(text, path, label): findings of known formats and look-alikes in prose."""
    rng = random.Random(seed)
    words = words or ["the", "of"]
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    name = lambda: rng.choice(("password", "token", "secret", "api_key", "API-KEY", "auth", "passwd"))
    block = lambda kind, k: f"-----BEGIN {kind}-----\n" + "".join(pick(mixed + "+/", min(64, k - i)) + "\n" for i in range(0, k, 64)) + f"-----END {kind}-----"
    key_kind = lambda: rng.choice(("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED ")) + "PRIVATE KEY"
    secret = (
        lambda: "AKIA" + pick(upper + "0189", 16), lambda: "ghp_" + pick(mixed, 36),
        lambda: f"{name()}{rng.choice(('=', ' = ', ': '))}{rng.choice(('', chr(34)))}{pick(rng.choice((hexa, mixed)), rng.randint(12, 40))}",
        lambda: f"{name()} = \"{pick(hexa, 40)}\"", lambda: f"{name()}={pick(hexa, 18)}", lambda: f"{name()}={pick(mixed + '!#%&', rng.randint(8, 20))}",
        lambda: f"{name()} {pick(mixed, rng.randint(20, 40))}", lambda: f"xoxb-{pick('0123456789', 11)}-{pick(mixed, 24)}",
        lambda: block(key_kind(), rng.randint(120, 2_400)), lambda: f"{name()} = \"{pick(mixed + '_-', rng.randint(40, 160))}\"",
        lambda: f"{rng.choice(('Bearer ', 'token=', 'jwt: ', ''))}eyJ{pick(mixed, rng.randint(14, 40))}.eyJ{pick(mixed + '_-', rng.randint(20, 400))}.{pick(mixed + '_-', rng.choice((43, 86, 342)))}",
    )
    harmless = (
        lambda: f"commit {pick(hexa, 40)}", lambda: f"sha256 {pick(hexa, 64)}", lambda: f"md5: {pick(hexa, 32)}", lambda: pick("0123456789", rng.randint(16, 19)),
        lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: f"{name()}={rng.choice(('changeme', 'your_password', 'xxxxxxxx', 'example123', '<password>', '${TOKEN}', '********'))}",
        lambda: "-".join(rng.choices(words, k=4)) + f"-{rng.randint(1, 99)}", lambda: "_".join(rng.choices(words, k=4)) + str(rng.randint(1, 2030)),
        lambda: f"{rng.choice(('password', 'token', 'auth'))}: {rng.choice([w for w in words if len(w) > 5] or ['ordinary'])}",
        lambda: f"/{'/'.join(rng.choices(words, k=4))}/v{rng.randint(1, 9)}", lambda: f"order {pick('0123456789', 18)}",
        lambda: f"data:image/png;base64,{pick(mixed + '+/', rng.randint(100, 2_400))}", lambda: f"sha512-{pick(mixed + '+/', 86)}==", lambda: f"sha512 {pick(hexa, 128)}",
        lambda: block(rng.choice(("CERTIFICATE", "PUBLIC KEY")), rng.randint(120, 2_400)), lambda: f"-----BEGIN {key_kind()}----- {' '.join(rng.choices(words, k=rng.randint(3, 40)))}",
        lambda: f"eyJ{rng.choice(words)}example.{rng.choice(words)}_placeholder.your_{rng.choice(words)}_signature",
    )
    out = []
    for _ in range(n):
        label = rng.randint(0, 1)
        made = rng.choice(secret if label else harmless)()
        prose = lambda: " ".join(rng.choices(words, k=5))
        path = f"src{rng.randint(0, 30)}" if rng.random() < (0.9 if label else 0.7) else rng.choice(("tests/fixtures", "docs/example.md", "lib/vendor.min.js"))
        out.append((f"{prose()} {made} {prose()}", path, label))
    return out


class Scanner(NamedTuple):
    lang: Language
    forest: list


def fit(labelled: list[tuple[str, str, int]], lang: Language) -> Scanner:
    """``labelled``: (text, path, label); every candidate of the text has the label."""
    x, y = [], []
    for text, path, label in labelled[:LABELLED]:
        for c in candidates(text):
            x.append(features(c, path, lang))
            y.append(label)
    if not x or len(set(y)) < 2:
        return Scanner(lang, [])
    return Scanner(lang, grow_forest(np.array(x), np.array(y, float)))


def _count_transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((38, 38))
    for b in batches:
        counts += transition_counts(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at].astype(np.int64))], names=["at", "n"])


def learn(docs: DataFrame, text: str = "text") -> Scanner:
    """A scanner for this corpus. The words of all documents give the dictionary
    (the most frequent ones), the transitions (all of them) and the prose around
    generated findings."""
    small_batches(docs.sparkSession)
    words = docs.select(F.explode(F.split(F.lower(whole(text)), SPACES)).alias("w")).filter(
        F.col("w").rlike(r"^\p{L}{2,24}$")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = cut_lineage(words, "secret-words")
    top = [(r["w"], r["n"]) for r in words.orderBy(F.desc("n"), "w").limit(DICTIONARY).collect()]
    counts = np.zeros(38 * 38)
    for r in words.mapInArrow(_count_transitions, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 38 * 38 rows
        counts[r["at"]] = r["n"]
    return fit(generated_findings([w for w, _ in top]), language(top, counts.reshape(38, 38)))


def scan(docs: DataFrame, scanner: Scanner, text: str = "text", path: str | None = "source", keep: tuple[str, ...] = ("doc_id",),
         redact: str | None = None) -> DataFrame:
    """``keep`` columns, n_candidates, spans (``kind:start:end`` of accepted
    findings, by start) and, with ``redact``, the text with each finding
    replaced by it.

    One row out per row in. Null and empty texts have no candidates and stay as
    they are. Offsets are code points, end exclusive. Texts without a digit, a
    fixed prefix or an assignment cannot hold a candidate and skip the Python
    worker's patterns.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(scanner)  # at most DICTIONARY words and TREES small trees
    t = F.col(text)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(*keep, t.alias("_t"), where.alias("_p"), F.coalesce(t.rlike(_MAY_HOLD), F.lit(False)).alias("_m"))
    if redact is None:
        rows = rows.withColumn("_t", F.when(F.col("_m"), F.col("_t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, forest = held.value
        for b in batches:
            n = len(keep)
            texts, paths, may = b.column(n), b.column(n + 1), b.column(n + 2).to_numpy(zero_copy_only=False)
            counts, spans, out = np.zeros(b.num_rows, np.int64), [""] * b.num_rows, {}
            for i in np.flatnonzero(may):
                whole_text, where = texts[i].as_py(), paths[i].as_py()
                found = candidates(whole_text)
                counts[i] = len(found)
                if not found or not forest:
                    continue
                score = forest_score(forest, np.array([features(c, where, lang) for c in found]))
                kept = [c for c, s in zip(found, score, strict=True) if s >= ACCEPT]
                spans[i] = ",".join(f"{c.kind}:{c.start}:{c.end}" for c in kept)
                if redact is not None and kept:
                    parts, at = [], 0
                    for c in kept:
                        parts += [whole_text[at:c.start], redact]
                        at = c.end
                    out[int(i)] = "".join([*parts, whole_text[at:]])
            cols = [*b.columns[:n], pa.array(counts), pa.array(spans, pa.string())]
            names = [*keep, "n_candidates", "spans"]
            if redact is not None:
                cleaned = texts
                if out:
                    cleaned = pa.array([out.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
                cols, names = [*cols, cleaned], [*names, "redacted"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = docs.select(*keep, F.lit(0).cast("bigint").alias("n_candidates"), F.lit("").alias("spans"),
                         *([F.lit("").alias("redacted")] if redact is not None else [])).schema
    return rows.mapInArrow(run, schema)


def span_count(spans: str = "spans"):
    return F.when(F.col(spans) == "", 0).otherwise(F.size(F.split(spans, ","))).cast("bigint")


