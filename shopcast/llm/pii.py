"""Personal data: fixed patterns, and a linear-chain conditional random field that adds to them.

The patterns give the base spans.  The field reads tokens (words trimmed of
surrounding signs): every feature is a property of the token's shape, of its
neighbours' shapes, or whether a number's checksum and range are right, and it is
trained on the driver from the small labelled
table below.  A token without a digit or ``@`` can only be outside (a hard
constraint), so a text falls into independent short chains between such tokens;
all chains of a batch are decoded together by Viterbi in numpy.  A chain's span
is added if it overlaps no base span.

Defined cases: a null text is the empty text; repeated rows give repeated
results; very long texts are handled whole.  Other columns are ignored by
``found`` and kept by ``masked``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]     # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; matches that fail their check are dropped."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:      # the part before each @ is followed back at most to the last match
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the labelled table: marked-up lines, <kind>...</kind>; '#' stands for a digit drawn by a fixed rule.  The last
# digit of a <card> makes its checksum right, that of a <wrong> number, which is none, makes it fail. ---

LABELLED = (
    "write to <email>anna.##@mail#.example.com</email> about it", "mail <email>j.smith@web-##.example.org</email>, please",
    "<email>info@shop.example</email> and <email>x##@y.example.net</email>!!", "ask <email>root@localhost</email> first",
    "<email>MARIA##@HOST.EXAMPLE.COM</email>%%% is old", "cc <email>a_b-c##@dept.example.edu</email>***",
    "from <ip>1##.##.#.1##</ip> to", "host <ip>10.0.#.##</ip>, port ##", "<ip>19#.16#.#.#</ip>*** was seen",
    "at <ip>##.1##.##.##</ip> and <ip>8.8.#.#</ip>.", "<ip>17#.##.1##.#</ip>$$$",
    "paid by <card>################</card> today", "card <card>#### #### #### ####</card> expired",
    "no <card>####-####-####-####</card>, ok", "<card>###############</card>%%% charged", "<card>#### ###### #####</card> amex",
    "call <phone>+# (###) ###-####</phone> now", "ring <phone>(###) ###-####</phone> or", "<phone>###-###-####</phone> home",
    "tel <phone>+## ## #### ####</phone>!!", "fax <phone>+#-###-###-####</phone>&&&", "at <phone>0## #### ####</phone> later",
    "<phone>+##########</phone> mobile", "<phone>###.###.####</phone> desk", "call <phone>+# (###) ###-####</phone>%%% now",
    "in #### there were ## of them", "from 19## to 20##, about #,### people", "version #.##.# of ####-##-## is out",
    "token = \"####a#f##c##e#b#####d##a####f##c######\" set", "chapter # and ## and ###", "it is ##.# percent, ## of ##",
    "at ##:## on ##/##/####", "room #b, floor #", "price $##.## or ##.##", "id ######## of row #####", "# ## # ## ### # # ##",
    "order <wrong>################</wrong> was sent", "no <wrong>#### #### #### ####</wrong> is void", "<wrong>####-####-####-####</wrong>, no",
    "serial <wrong>###############</wrong>%%% of", "<wrong>################</wrong>", "item <wrong>##############</wrong> of them",
    "id <wrong>################</wrong>*** or", "of <wrong>#### ###### #####</wrong> rows", "row <wrong>###################</wrong> is",
    "both <card>################</card> <card>################</card> paid", "<wrong>################</wrong> <wrong>################</wrong> and",
    "<card>################</card>!! and", "<card>####-####-####-####</card>&&& paid", "it is <card>################</card>",
    "build 2##.6##.4##.5##", "part 3##.4##.9##.8##*** of", "version ###.999.##.#",
    "pages ##-## and ###", "the @ sign and @name here", "a#b#c# d##e f###", "ratio #:#, x#, #x", "build #.#.##-####",
    "#### #### words", "in ##### lines ###### cells", "hash ##a#bc##f#", "1. ## 2. ## 3. ##", "over ### ### km, #.# kg",
)
COPIES = 8
_MARK = re.compile(r"<(/?)(\w+)>")
_NUMBER = re.compile(r"<(card|wrong)>([^<]*)</")


def _with_checksum(number: str, right: bool) -> str:
    """The number with its last digit set so that the checksum is right, or fails."""
    for d in "0123456789":
        if _luhn(re.sub(r"[\x20-]", "", number[:-1] + d)) == right:
            return number[:-1] + d
    raise AssertionError(number)


def labelled_table(lines: tuple[str, ...] = LABELLED) -> list[tuple[str, list[Span]]]:
    """(text, spans) rows: every line with ``COPIES`` draws of its digits, the same each time."""
    rng = np.random.default_rng(3)
    rows = []
    for line in lines:
        for _ in range(COPIES):
            drawn = re.sub("#", lambda _: str(rng.integers(10)), line)
            drawn = _NUMBER.sub(lambda m: f"<{m[1]}>{_with_checksum(m[2], m[1] == 'card')}</", drawn)
            text, spans, last, begin = "", [], 0, 0
            for m in _MARK.finditer(drawn):
                text += drawn[last:m.start()]
                last = m.end()
                if m[1] and m[2] in KINDS:
                    spans.append((begin, KINDS.index(m[2]), len(text)))
                begin = len(text)
            rows.append((text + drawn[last:], spans))
    return rows


# --- tokens, features, chains ---

_TRIM = re.compile(r"^[^A-Za-z0-9+(@]+|[^A-Za-z0-9)]+$")
_RUN = re.compile(r"[0-9]+|[A-Za-z\u0080-\U0010ffff]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def _run(m: re.Match) -> str:
    return ("d" + (str(len(m[0])) if len(m[0]) < 20 else "+")) if m[0][0] in "0123456789" else "a"


RIGHT, WRONG = "\u2713", "\u2717"       # after a shape: its checksum or its range is right, or fails
_DIGITS = re.compile(r"d(?:\d+|\+)(?:-d(?:\d+|\+))*")
_QUAD = re.compile(r"d\d+(?:\.d\d+){3}")


@cache
def _features(shape: str) -> tuple[str, ...]:
    check = shape[-1:] if shape[-1:] in (RIGHT, WRONG) else ""
    shape = _plain(shape)
    digits = sum(20 if n == "+" else int(n) for n in re.findall(r"d(\d+|\+)", shape))
    size = next((b for b in (0, 1, 3, 4, 6, 7, 9, 10, 11, 13, 16, 19) if digits <= b), 20)
    signs = re.sub(r"d(\d+|\+)|a", "", shape)
    mixed = len(re.findall(r"a(?=d)|d(?:\d+|\+)(?=a)", shape))
    return ("shape=" + shape[:24], f"digits={size}", "signs=" + signs[:8], f"first={shape[:1]}", f"last={shape[-1:]}",
            f"at={'@' in shape[1:]}", f"dot={'.' in shape.partition('@')[2]}", f"letters={'a' in shape}", f"mixed={min(mixed, 3)}",
            f"check={check}", f"check={check} digits={size}")


def _plain(shape: str) -> str:
    return shape[:-1] if shape[-1:] in (RIGHT, WRONG) else shape


def checked(text: str, chain: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The chain with a mark after the shapes of numbers of 14 to 19 digits, alone or as neighbouring short
    groups, by their checksum, and of four dotted numbers by their range."""
    out = list(chain)

    def mark(lo: int, hi: int, right: bool) -> None:
        for i in range(lo, hi):
            out[i] = (*out[i][:2], out[i][2] + (RIGHT if right else WRONG))

    at = 0
    while at < len(chain):
        start, end, shape = chain[at]
        if _QUAD.fullmatch(shape):
            mark(at, at + 1, all(len(p) <= 3 and int(p) <= 255 for p in text[start:end].split(".")))
        if not _DIGITS.fullmatch(shape):
            at += 1
            continue
        digits = text[start:end].replace("-", "")
        to = at + 1
        if len(digits) < 14:        # short groups side by side are one number
            while to < len(chain) and _DIGITS.fullmatch(chain[to][2]) and len(digits) < 20:
                digits += text[chain[to][0]:chain[to][1]].replace("-", "")
                to += 1
        if 14 <= len(digits) <= 19:
            mark(at, to, _luhn(digits))
            at = to
        else:
            at += 1
    return out


def shape_of(token: str) -> str:
    return _RUN.sub(_run, token)


def token_at(text: str, start: int, end: int) -> tuple[int, int, str]:
    """The trimmed token of a word: start, end, shape."""
    word = text[start:end]
    head = re.match(r"[^A-Za-z0-9+(@]*", word).end()
    tail = re.match(r"[^A-Za-z0-9)]*", word[::-1]).end()
    if head + tail >= len(word):
        head = tail = 0
    return start + head, end - tail, shape_of(text[start + head:end - tail])


LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_NO = -1e9


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Allowed starts and transitions: a span goes on only from its own kind."""
    n = len(LABELS)
    start, step = np.zeros(n), np.zeros((n, n))
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            start[j] = _NO
            step[:, j] = _NO
            step[j - 1, j] = step[j, j] = 0.0
    return start, step


def chain_features(shapes: list[str]) -> list[tuple[str, ...]]:
    """Features of each token of a chain; beyond its ends are plain words."""
    around = ["w", *map(_plain, shapes), "w"]
    of = [_features(s) if len(s) <= 256 else _features.__wrapped__(s) for s in shapes]     # long shapes are not remembered
    return [of[i] + ("before=" + around[i][:16], "after=" + around[i + 2][:16],
                            f"before={around[i][:16]} {s[:16]}", f"after={s[:16]} {around[i + 2][:16]}")
            for i, s in enumerate(around[1:-1])]


class Field:
    """Weights of the features and transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, start: np.ndarray, step: np.ndarray):
        self.names, self.weights, self.start, self.step = names, weights, start, step

    def emissions(self, chain: list[str]) -> np.ndarray:
        zero = np.zeros(len(LABELS))
        return np.array([sum((self.weights[self.names[f]] for f in fs if f in self.names), zero)
                         for fs in chain_features(chain)])

    def viterbi(self, chains: list[list[str]]) -> list[np.ndarray]:
        """Best label sequence of each chain; chains of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        at = 0
        while at < len(order):
            longest = len(chains[order[min(at + 1023, len(order) - 1)]])
            block = order[at:at + max(1, min(1024, (1 << 16) // max(longest, 1)))]
            at += len(block)
            lengths = np.array([len(chains[i]) for i in block])
            n, width = len(block), int(lengths.max())
            e = np.zeros((n, width, len(LABELS)))
            for row, i in enumerate(block):
                e[row, :lengths[row]] = self.emissions(chains[i])
            best, back = self.start + e[:, 0], np.zeros((n, width, len(LABELS)), np.int8)
            for t in range(1, width):
                every = best[:, :, None] + self.step
                back[:, t] = every.argmax(axis=1)
                new = every.max(axis=1) + e[:, t]
                best = np.where((t < lengths)[:, None], new, best)
            label = best.argmax(axis=1)
            path = np.zeros((n, width), np.int64)
            for t in range(width - 1, -1, -1):
                inside = t < lengths
                path[inside, t] = label[inside]
                label = np.where(inside & (t > 0), back[np.arange(n), t, label], label)
            for row, i in enumerate(block):
                out[i] = path[row, :lengths[row]]
        return out


def train(rows: list[tuple[str, list[Span]]], rounds: int = 150, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps (Adam) over all chains of the labelled rows."""
    chains, truth = [], []
    for text, spans in rows:
        for chain in chains_of(text):
            labels = []
            for start, end, _ in chain:
                hit = next((s for s in spans if s[0] <= start < s[2]), None)
                labels.append(0 if hit is None else 1 + 2 * hit[1] + (start > hit[0] + 1))
            chains.append([shape for _, _, shape in chain])
            truth.append(labels)
    names: dict[str, int] = {}
    feats = [[[names.setdefault(f, len(names)) for f in fs] for fs in chain_features(c)] for c in chains]
    n, width, k, m = len(chains), max(map(len, chains)), len(LABELS), len(names)
    x = np.zeros((n, width, m))
    y = np.zeros((n, width, k))
    mask = np.zeros((n, width), bool)
    for i, c in enumerate(feats):
        for t, fs in enumerate(c):
            x[i, t, fs] = 1
            y[i, t, truth[i][t]] = 1
            mask[i, t] = True
    start0, step0 = _steps()
    w, start, step = np.zeros((m, k)), np.zeros(k), np.zeros((k, k))
    seen = [np.einsum("ntm,ntk->mk", x, y), y[:, 0].sum(axis=0), np.einsum("nti,ntj->ij", y[:, :-1], y[:, 1:])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, start, step)]

    def soft(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for r in range(1, rounds + 1):
        e, s0, s = x @ w, start + start0, step + step0
        alpha, beta = np.zeros((n, width, k)), np.zeros((n, width, k))
        alpha[:, 0] = s0 + e[:, 0]
        for t in range(1, width):
            alpha[:, t] = np.where(mask[:, t, None], soft(alpha[:, t - 1, :, None] + s, 1) + e[:, t], alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], soft(s + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0.0)
        z = soft(alpha[:, -1], 1)
        node = np.where(mask[:, :, None], np.exp(np.minimum(alpha + beta - z[:, None, None], 0)), 0)
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + s + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], 0))
        pair *= mask[:, 1:, None, None]
        expected = [np.einsum("ntm,ntk->mk", x, node), node[:, 0].sum(axis=0), pair.sum(axis=(0, 1))]
        for p, a, b, (m1, m2) in zip((w, start, step), seen, expected, moments, strict=True):
            g = (a - b) / n - ridge * p
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += 0.1 * (m1 / (1 - 0.9 ** r)) / (np.sqrt(m2 / (1 - 0.99 ** r)) + 1e-8)
    return Field(names, w, start + start0, step + step0)


def chains_of(text: str) -> list[list[tuple[int, int, str]]]:
    """Runs of neighbouring tokens with a digit or @ (start, end, shape)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, marked = _marked_words(raw)
    return _chains(text, raw, starts, ends, marked)


_MARKED = np.zeros(256, bool)
_MARKED[[*range(48, 58), 64]] = True


def _marked_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of all words, and the indices of those with a digit or @."""
    starts, ends, _ = T.word_bounds(raw, np.array([0, len(raw)]))
    hits = np.flatnonzero(_MARKED[raw])
    return starts, ends, np.unique(np.searchsorted(starts, hits, "right") - 1)


def _chains(text: str, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, marked: np.ndarray
            ) -> list[list[tuple[int, int, str]]]:
    if not len(marked):
        return []
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))      # code points before each byte
    out: list[list[tuple[int, int, str]]] = []
    last = -2
    for i in marked.tolist():
        token = token_at(text, int(point[starts[i]]), int(point[ends[i]]))
        if i == last + 1:
            out[-1].append(token)
        else:
            out.append([token])
        last = i
    return [checked(text, chain) for chain in out]


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """Spans that the field finds beside the base ones of each text."""
    chains = [(i, c) for i, t in enumerate(texts) for c in chains_of(t)]
    out: list[list[Span]] = [[] for _ in texts]
    for (i, chain), labels in zip(chains, field.viterbi([[s for _, _, s in c] for _, c in chains]), strict=True):
        spans: list[Span] = []
        for (start, end, _), label in zip(chain, labels.tolist(), strict=True):
            if label and label % 2 == 1:
                spans.append((start, (label - 1) // 2, end))
            elif label:
                spans[-1] = (spans[-1][0], spans[-1][1], end)
        taken = [(s, e) for s, _, e in base[i]]
        out[i] += [s for s in spans if not any(a < s[2] and s[0] < b for a, b in _near(taken, s))]
    return out


def _near(taken: list[tuple[int, int]], span: Span) -> list[tuple[int, int]]:
    from bisect import bisect_left
    at = bisect_left(taken, (span[0], 0))
    to = bisect_left(taken, (span[2], 0))
    return taken[max(0, at - len(KINDS)):to]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _search(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base, added) spans of each text; texts without a digit or @ have none."""
    some = [i for i, t in enumerate(texts) if re.search("[0-9@]", t)]
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    base = [base_spans(texts[i]) for i in some]
    for i, b, a in zip(some, base, added_spans([texts[i] for i in some], base, field), strict=True):
        out[i] = (b, a)
    return out


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, counts and hash of base spans, all spans) of every row; no shuffle."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(train(labelled_table()))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                got = _search([t or "" for t in part.column("text").to_pylist()], field.value)
                cols = [part.column("doc_id")]
                cols += [pa.array([sum(s[1] == k for s in b) for b, _ in got], pa.int64()) for k in range(len(KINDS))]
                cols += [pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b, _ in got], pa.string()),
                         pa.array([_listed(sorted(b + a)) for b, a in got], pa.string()),
                         pa.array([len(a) for _, a in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                               "spans string, n_added long")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union goes."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns, personal data in the text masked and the length column set anew; no shuffle."""
    field = docs.sparkSession.sparkContext.broadcast(train(labelled_table()))
    schema = docs.schema
    where = [f.name for f in schema].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(where).type
            for part in T.slices(batch, text_col):
                texts = part.column(where).to_pylist()
                got = _search([t or "" for t in texts], field.value)
                new = [None if t is None else mask(t, b + a) if b or a else t for t, (b, a) in zip(texts, got, strict=True)]
                cols = list(part.columns)
                cols[where] = pa.array(new, kind)
                if chars_col in part.schema.names:
                    i = part.schema.names.index(chars_col)
                    cols[i] = pa.array([None if t is None else len(t) for t in new], part.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, schema)
