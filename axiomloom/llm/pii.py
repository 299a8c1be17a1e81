"""Personal data: exact base patterns, and spans that a BiLSTM-CRF adds.

The network reads windows of characters around every digit and ``@`` (each kind
holds one, so a window without any cannot hold a span). Windows overlap by half.
Each is decoded to tag posteriors; where windows overlap these are averaged with
more weight to a window's middle, and one Viterbi pass over each covered stretch
of the text settles all its windows together; very long ones are decoded in
sections that read some windows of their neighbours. What the network adds must
be as sure as held-out labelled texts ask for, must not touch a base span and must
pass an exact check of its kind. Stretches of the corpus whose numbers the base
patterns may mislabel are no training data.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bilstm_crf
from .arrow import small_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
HIDDEN, EPOCHS = 16, 6
SAMPLE_DOCS = 1_500      # documents with a digit or @ that the network learns from
TRAIN_WINDOWS = 4_000
SURE = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)  # bounds tried on held-out texts; the last is taken if none is free of wrong spans
WINDOWS_AT_ONCE = 512
SECTION, MARGIN = 2_048, 8  # windows of one text decoded together, and those read on both sides besides
SEED = 11

_IS_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _IS_LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:] if len(x) > 3 else x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _plausible(kind: int, value: str) -> bool:
    """The exact check on what the network adds."""
    d = _digits(value)
    if kind == 0:
        return "@" in value[1:-1] and "." in value
    if kind == 1:
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 ./-]", value)
    return 9 <= len(d) <= 15 and not re.search(r"[^0-9 ()./+-]", value) and len(re.findall(r"[0-9]+", value)) > 1


#: Classes of characters: 0 pads a window, each mark below has its own.
_MARKS = "@.+-_()/:;=,%&#\"'\n "
CLASSES = 6 + len(_MARKS)
_CLASS = np.full(128, 1, np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 3, 4
_CLASS[[ord(c) for c in _MARKS]] = np.arange(len(_MARKS)) + 6
TAGS = 1 + 2 * len(KINDS)  # 0 outside, then begin and inside of each kind
#: Inside follows begin or inside of its kind.
_MAY = np.ones((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    _MAY[:, 2 + 2 * _k] = False
    _MAY[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
_MAY_LOG = np.where(_MAY, 0.0, -1e9)
_FIRST_LOG = np.where(np.arange(TAGS) % 2 == 1, 0.0, np.where(np.arange(TAGS) == 0, 0.0, -1e9))


def char_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], np.uint8(5))


def window_starts(classes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or @, on a grid of STRIDE."""
    held = (classes == _CLASS[ord("0")]) | (classes == _CLASS[ord("@")])
    held = np.concatenate([held, np.zeros(-len(held) % STRIDE, bool)]).reshape(-1, STRIDE).any(axis=1)
    return np.flatnonzero(held | np.append(held[1:], False)) * STRIDE if len(held) else np.zeros(0, np.int64)


def _windows(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < len(classes), classes[np.minimum(at, len(classes) - 1)], 0).astype(np.int64)


def sections(starts: np.ndarray) -> Iterator[tuple[np.ndarray, float, float]]:
    """(windows, from, to): parts of a text's windows and where the spans begin that a part decides."""
    for i in range(0, len(starts), SECTION):
        end = i + SECTION
        yield (starts[max(0, i - MARGIN):end + MARGIN], float(starts[i]) if i else -np.inf,
               float(starts[end]) if end < len(starts) else np.inf)


def _tags(spans: list[tuple[int, int, int]], n: int) -> np.ndarray:
    out = np.zeros(n + WINDOW, np.int64)
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if not out[s:e].any():
            out[s], out[s + 1:e] = 1 + 2 * kind, 2 + 2 * kind
    return out


_CENTRED = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float64)[:, None]


def reconcile(starts: np.ndarray, posterior: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(kind, start, end, mean posterior) of the best tagging of each covered stretch."""
    cuts = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    for group in np.split(np.arange(len(starts)), cuts):
        at, n = starts[group[0]], starts[group[-1]] + WINDOW - starts[group[0]]
        total, weight = np.zeros((n, TAGS)), np.zeros((n, 1))
        for g in group:
            lo = starts[g] - at
            total[lo:lo + WINDOW] += posterior[g] * _CENTRED
            weight[lo:lo + WINDOW] += _CENTRED
        mean = total / np.maximum(weight, 1e-9)
        score = np.log(np.maximum(mean, 1e-9))
        best, back = score[0] + _FIRST_LOG, np.zeros((n, TAGS), np.int64)
        for t in range(1, n):
            step = best[:, None] + _MAY_LOG
            back[t] = step.argmax(axis=0)
            best = step.max(axis=0) + score[t]
        tag, path = int(best.argmax()), np.zeros(n, np.int64)
        for t in range(n - 1, -1, -1):
            path[t] = tag
            tag = int(back[t, tag])
        for s in np.flatnonzero(path % 2 == 1):
            e = s + 1
            while e < n and path[e] == path[s] + 1:
                e += 1
            yield (int(path[s]) - 1) // 2, int(at + s), int(at + e), float(mean[np.arange(s, e), path[s:e]].mean())


def added_spans(text: str, base: list[tuple[int, int, int]], net: bilstm_crf.Params) -> list[tuple[int, int, int]]:
    classes, out = char_classes(text), []
    for starts, lo, hi in sections(window_starts(classes)):
        windows = _windows(classes, starts)
        posterior = np.concatenate([bilstm_crf.marginals(net, windows[i:i + WINDOWS_AT_ONCE]) for i in range(0, len(windows), WINDOWS_AT_ONCE)])
        out += _accept(text, base, starts, posterior, float(net["sure"]), lo, hi)
    return out


def _accept(text: str, base: list[tuple[int, int, int]], starts: np.ndarray, posterior: np.ndarray, least: float,
            lo: float = -np.inf, hi: float = np.inf) -> list[tuple[int, int, int]]:
    return [span for span, sure in _proposed(text, base, starts, posterior) if sure >= least and lo <= span[1] < hi]


def _proposed(text: str, base: list[tuple[int, int, int]], starts: np.ndarray, posterior: np.ndarray) -> list[tuple[tuple[int, int, int], float]]:
    """Plausible spans that touch no base span, and how sure the network is."""
    begins, ends = sorted(s for _, s, _ in base), np.maximum.accumulate([0, *[e for _, _, e in sorted(base, key=lambda x: x[1])]])
    out = []
    for kind, s, e, sure in reconcile(starts, posterior):
        e = min(e, len(text))
        at = bisect_left(begins, e)  # base spans that begin before the end
        if _plausible(kind, text[s:e]) and ends[at] <= s:
            out.append(((kind, s, e), sure))
    return out


def generated(words: list[str], n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, labelled spans): known forms, forms the base patterns miss, and look-alikes."""
    rng = random.Random(seed)
    words = words or ["the", "of"]
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def grouped(digits: str, sep: str) -> str:
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))

    forms = (
        (0, lambda: f"{rng.choice(words)}{rng.choice(('.', '_', ''))}{rng.choice(words)}{rng.choice(('', num(2)))}@{rng.choice(words)}.{rng.choice(('com', 'org', 'net', 'de', 'fr'))}".lower()),
        (1, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        (2, lambda: grouped(card(), rng.choice((" ", "-", "", ".")))),
        (3, lambda: f"+{rng.randint(1, 99)} {num(3)} {num(3)}{rng.choice((' ', '-'))}{num(4)}"),
        (3, lambda: f"({num(3)}) {num(3)}-{num(4)}"), (3, lambda: f"0{num(3)}/{num(7)}"), (3, lambda: f"00{rng.randint(30, 50)} {num(3)} {num(7)}"),
        (None, lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}"), (None, lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}"),
        (None, lambda: f"password={hexa(18)}"), (None, lambda: f"token = \"{hexa(40)}\""), (None, lambda: num(rng.randint(1, 9))), (None, lambda: f"License, Version {rng.randint(1, 4)}.0"),
        (None, lambda: f"AKIA{num(3)}{rng.choice(words).upper()}"), (None, lambda: f"{num(4)}-{num(2)}-{num(2)}"), (None, lambda: f"{num(2)}:{num(2)}"), (None, lambda: f"@{rng.choice(words)}"),
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(3):
            text += " ".join(rng.choices(words, k=rng.randint(1, 5))) + rng.choice((" ", ": ", ", ", ". ", "\n"))
            kind, make = rng.choice(forms)
            value = make()
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + rng.choice((" ", ". ", ", ", "\n", ""))
            text += " " if text[-1].isalnum() else ""
        out.append((text, spans))
    return out


def fit(labelled: list[tuple[str, list[tuple[int, int, int]]]], held_out: list[tuple[str, list[tuple[int, int, int]]]] | None = None) -> bilstm_crf.Params:
    """The network, from at most TRAIN_WINDOWS windows of labelled texts, with the least bound ("sure") of
    SURE that lets no wrong span pass on held-out labelled texts (the last without any)."""
    ids, tags = [], []
    for text, spans in labelled:
        classes = char_classes(text)
        starts = window_starts(classes)
        if len(starts):
            ids.append(_windows(classes, starts))
            tags.append(_tags(spans, len(text))[starts[:, None] + np.arange(WINDOW)])
    ids, tags = np.concatenate(ids), np.concatenate(tags)
    pick = np.random.default_rng(SEED).permutation(len(ids))[:TRAIN_WINDOWS]
    net = dict(bilstm_crf.fit(ids[pick], tags[pick], CLASSES, TAGS, HIDDEN, EPOCHS))
    wrong = 1.0
    if held_out:
        wrong = 0.0
        for text, spans in held_out:
            classes, base = char_classes(text), base_spans(text)
            starts = window_starts(classes)
            if len(starts):
                for span, sure in _proposed(text, base, starts, bilstm_crf.marginals(net, _windows(classes, starts))):
                    wrong = max(wrong, sure if span not in spans else 0.0)
    net["sure"] = np.float64(next((s for s in SURE if s > wrong), SURE[-1]))
    return net


_NUMBERS = re.compile(r"[+(0-9][0-9 ().+/-]{6,}[0-9]")


def labels_known(piece: str) -> bool:
    """Whether the base patterns can be trusted to label a stretch: not if it holds numbers that may be a
    phone or a card in a form they do not know."""
    base = base_spans(piece)
    return not any(all(m.end() <= s or m.start() >= e for _, s, e in base) and any(_plausible(k, m.group()) for k in (2, 3))
                   for m in _NUMBERS.finditer(piece))


def learn(docs: DataFrame, text: str = "text", key: str = "doc_id") -> bilstm_crf.Params:
    """Train on a bounded sample of the corpus, labelled by the base patterns, and
    on generated texts made with its words."""
    small_batches(docs.sparkSession)
    ids = docs.filter(F.col(key).isNotNull() & F.col(text).rlike("[0-9@]")).select(F.col(key).alias("k")).distinct().orderBy(
        F.xxhash64(F.col("k").cast("string"), F.lit("pii"))).limit(SAMPLE_DOCS)  # a bounded broadcast
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(ids), "k", "left_semi")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Up to four stretches of 128 characters around digits and @ of each text."""
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"], strict=True):
                starts = window_starts(char_classes(t or ""))
                for s in starts[:: max(1, len(starts) // 4)][:4]:
                    lo = max(0, int(s) - 32)
                    out.append((k, t[lo:lo + 128]))
            yield pd.DataFrame(out, columns=["k", "t"])

    pieces = [r["t"] for r in rows.mapInPandas(near, rows.schema).orderBy("k", "t").collect()]  # at most 4 * SAMPLE_DOCS of 128 characters
    words = [w for w in dict.fromkeys(w for p in pieces for w in re.findall(r"\b[A-Za-z]{2,12}\b", p))][:2_000]
    return fit([(p, base_spans(p)) for p in pieces if labels_known(p)] + generated(words, 1_500), generated(words, 500, SEED + 1))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, net: bilstm_crf.Params, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row.

    Null and empty texts have none. Offsets are code points, end exclusive.
    Repeated rows get equal answers; only the named columns are read. Texts
    without a digit and without @ cannot hold a span and are not sent to Python.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    rows = docs.select(F.col(key).alias("doc_id"), F.when(F.col(text).rlike("[0-9@]"), F.col(text)).alias("t"))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in batches:
            counts = np.zeros((b.num_rows, len(KINDS)), np.int64)
            sha, spans = [empty] * b.num_rows, [""] * b.num_rows
            texts = b.column(1)
            waiting: list[tuple] = []
            queue: list[np.ndarray] = []
            all_spans: dict[int, list] = {}

            def settle() -> None:
                if not waiting:
                    return
                windows = np.concatenate(queue)
                posterior = np.concatenate([bilstm_crf.marginals(net, windows[i:i + WINDOWS_AT_ONCE]) for i in range(0, len(windows), WINDOWS_AT_ONCE)])
                lo = 0
                for i, t, base, starts, first, last in waiting:
                    all_spans[i] += _accept(t, base, starts, posterior[lo:lo + len(starts)], float(net["sure"]), first, last)
                    lo += len(starts)
                waiting.clear()
                queue.clear()

            for i in np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)):
                t = texts[int(i)].as_py()
                base = base_spans(t)
                for kind, _, _ in base:
                    counts[i, kind] += 1
                sha[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                all_spans[int(i)] = list(base)
                classes = char_classes(t)
                for starts, first, last in sections(window_starts(classes)):
                    waiting.append((int(i), t, base, starts, first, last))
                    queue.append(_windows(classes, starts))
                    if sum(map(len, queue)) >= 4 * WINDOWS_AT_ONCE:
                        settle()
            settle()
            for i, found in all_spans.items():
                spans[i] = _joined(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
