"""Personal data: exact base patterns and a semi-Markov conditional random field.

The base patterns (e-mail, IP address, card, phone) give spans that always
stay. The random field finds more: digit groups and spelled-out addresses give
candidate segments; whole-span features (digit and group counts, checksum,
brackets, plus sign, cue words before, what stands around) score each segment
with each type; a dynamic program over at most ``MAX_GROUPS`` groups a segment
jointly picks the boundaries and types of a run. Runs are maximal stretches of
neighbouring groups; the program keeps one number and one span for each group.

Weights are fitted here, on generated sentences with a fixed seed, by gradient
ascent on the conditional likelihood (forward and backward over segments).

Null texts are empty and have no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: the run of local characters before each at sign, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping within each kind; matches that fail their test are dropped without another try."""
    out = [(a, b, "email") for a, b in _emails(text)]
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 64 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- candidate segments

#: A segment joins at most so many groups.
MAX_GROUPS = 8
#: Digits of a segment, at least and at most.
DIGITS = (7, 19)
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[\x20]{0,2}[-.()/]{0,2}[\x20]{0,1}")
# a local part of labels between dots and spelled dots, an at sign, and the labels of a domain: as many as names can have
_DOT = r"(?: ?[\[(](?i:dot)[\])] ?| (?i:dot) |\.)"
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9_%+-])(?<![A-Za-z0-9_%+-]\.)[A-Za-z0-9][A-Za-z0-9_%+-]{{0,63}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,31}}(?: ?[\[(](?i:at)[\])] ?| (?i:at) )"
    rf"[A-Za-z0-9][A-Za-z0-9-]{{0,62}}(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]{{0,62}}){{0,125}}{_DOT}[A-Za-z][A-Za-z0-9-]{{1,62}}"
)
_CUES = {"phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"), "card": ("card", "visa", "mastercard", "amex", "karte", "tarjeta", "carte"), "ip": ("ip", "host", "server", "address"), "email": ("email", "e-mail", "mail", "contact"), "other": ("version", "license", "isbn", "invoice", "order", "token", "id", "build", "no")}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


class Segment:
    """A candidate: groups first to last of a run, with the features of its whole span."""

    __slots__ = ("end", "features", "first", "last", "start")

    def __init__(self, text: str, start: int, end: int, first: int, last: int):
        self.start, self.end, self.first, self.last = start, end, first, last
        self.features = span_features(text, start, end)


def span_features(text: str, start: int, end: int) -> list[str]:
    s = text[start:end]
    groups = _GROUP.findall(s)
    d = "".join(groups)
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    out = ["bias", f"digits={min(len(d), 20)}", f"groups={min(len(groups), 6)}", f"shape={'-'.join(str(min(len(g), 9)) for g in groups[:6])}"]
    out.append(f"marks={''.join(sorted(set(re.sub(r'[0-9A-Za-z]', '', s))))[:5]}")
    out.append(f"start={s[0] if not s[0].isalnum() else 'a' if s[0].isalpha() else '9'}")
    if len(groups) == 1:
        out.append("solid")
    if 12 <= len(d) <= 19:
        out.append("luhn" if luhn(d) else "no-luhn")
    if len(groups) == 4 and s.count(".") == 3:
        out.append("octets" if all(_small(g) for g in groups) else "no-octets")
    if not d or "@" in s or any(c.isalpha() for c in s):
        out.append("spelled-dot" if re.search(r"(?i)\bdot\b", s) else "plain-dot")
        out.append("spelled-brackets" if "(" in s or "[" in s else "spelled-bare")
    left, right = before[-1:], after[:1]
    out.append("left=" + ("edge" if not left else "space" if left.isspace() else "letter" if left.isalnum() or left == "_" else "quote" if left in "\"'=" else left if left in "+-./:#$%(" else "mark"))
    out.append("right=" + ("edge" if not right else "space" if right.isspace() else "letter" if right.isalpha() or right == "_" else right if right in "-/:%" else "mark"))
    if right == "." and after[1:].isdigit():
        out.append("right=more")
    words = {w.lower() for w in _WORD.findall(before)[-2:]}
    out += [f"cue={kind}" for kind, cues in _CUES.items() if words.intersection(cues)]
    return out


Run = tuple[int, Callable[[int], list[Segment]]]


def runs(text: str) -> Iterator[Run]:
    """Each run as its number of groups and a function that makes the candidate segments that end with a group. Digit groups with at most a few separators between them stand in one run; spelled-out addresses are runs of a single group."""

    def run_of(groups: list[tuple[int, int]]) -> Run:
        def ending(j: int) -> list[Segment]:
            out, n = [], 0
            for i in range(j, max(-1, j - MAX_GROUPS), -1):
                a, b = groups[i][0], groups[j][1]
                n += groups[i][1] - a
                if n > DIGITS[1]:
                    break
                if n >= DIGITS[0] or j - i >= 3:
                    if text[a - 1 : a] == "(" and ")" in text[a:b]:
                        a -= 1
                    if text[a - 1 : a] == "+":
                        a -= 1
                    out.append(Segment(text, a, b, i, j))
            return out

        return len(groups), ending

    groups: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        if groups and not (m.start() - groups[-1][1] <= 5 and _BETWEEN.fullmatch(text, groups[-1][1], m.start())):
            yield run_of(groups)
            groups = []
        groups.append(m.span())
    if groups:
        yield run_of(groups)
    low = text.lower()
    if " at " in low or "(at)" in low or "[at]" in low:
        for m in _SPELLED.finditer(text):
            yield 1, lambda _, m=m: [Segment(text, m.start(), m.end(), 0, 0)]


# ---------------------------------------------------------------- the random field


class Field:
    """Weights by (type, feature); a run's groups outside all segments score zero."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros((len(KINDS), len(names)))

    def scores(self, segments: list[Segment]) -> np.ndarray:
        return np.array([self.weights[:, [self.names[f] for f in s.features if f in self.names]].sum(axis=1) for s in segments])

    def best(self, n_groups: int, ending: Callable[[int], list[Segment]]) -> list[Span]:
        """The typed segments of the best segmentation of a run, group by group; only the best segment's span is kept for each end."""
        value = [0.0]
        back: list[tuple[int, Span] | None] = [None]
        for end in range(1, n_groups + 1):
            most, chosen = value[end - 1], None
            segments = ending(end - 1)
            if segments:
                scores = self.scores(segments)
                kinds = scores.argmax(axis=1)
                for k, s in enumerate(segments):
                    v = value[s.first] + scores[k, kinds[k]]
                    if v > most + 1e-12:
                        most, chosen = v, (s.first, (s.start, s.end, KINDS[kinds[k]]))
            value.append(most)
            back.append(chosen)
        out, end = [], n_groups
        while end:
            if back[end] is None:
                end -= 1
            else:
                end, span = back[end]
                out.append(span)
        return out[::-1]

    def fit(self, data: list[tuple[int, list[Segment], dict[tuple[int, int], str]]], rounds: int = 60, rate: float = 0.5, decay: float = 0.002) -> None:
        """Gradient ascent (with Adagrad steps) on the log likelihood of each run's true segments."""
        prepared = []
        for n, segments, truth in data:
            rows = [[self.names[f] for f in s.features] for s in segments]
            gold = np.zeros((len(segments), len(KINDS)))
            for k, s in enumerate(segments):
                if kind := truth.get((s.start, s.end)):
                    gold[k, KINDS.index(kind)] = 1
            prepared.append((n, segments, rows, gold))
        seen = np.full_like(self.weights, 1e-3)
        for _ in range(rounds):
            slope = -decay * len(prepared) * self.weights
            for n, segments, rows, gold in prepared:
                scores = np.array([self.weights[:, r].sum(axis=1) for r in rows])
                forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                forward[0] = backward[n] = 0
                total = np.logaddexp.reduce(scores, axis=1)
                ends: dict[int, list[int]] = {}
                starts: dict[int, list[int]] = {}
                for k, s in enumerate(segments):
                    ends.setdefault(s.last + 1, []).append(k)
                    starts.setdefault(s.first, []).append(k)
                for e in range(1, n + 1):
                    forward[e] = np.logaddexp.reduce([forward[e - 1], *(forward[segments[k].first] + total[k] for k in ends.get(e, ()))])
                for b in range(n - 1, -1, -1):
                    backward[b] = np.logaddexp.reduce([backward[b + 1], *(backward[segments[k].last + 1] + total[k] for k in starts.get(b, ()))])
                p = np.exp([scores[k] + forward[s.first] + backward[s.last + 1] - forward[n] for k, s in enumerate(segments)])
                for k, r in enumerate(rows):
                    slope[:, r] += (gold[k] - p[k])[:, None]
            seen += slope**2
            self.weights += rate * slope / np.sqrt(seen)


def sentences(n: int, seed: int = 7) -> list[tuple[str, dict[tuple[int, int], str]]]:
    """Generated sentences with their true spans: numbers of each type with and without cues, and others that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(2, 9)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = digits(16)
        if r.random() < 0.4:
            d = next(d[:-1] + str(c) for c in range(10) if luhn(d[:-1] + str(c)))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4)) if r.random() < 0.9 else digits(15)

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"1-{a}-{b}-{c}"])

    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))

    def spelled() -> str:
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" [at] ", "."), (" (at) ", ".")])
        case = r.choice([str, str, str, str.upper, str.title])
        at, dot = case(at), case(dot)
        local = r.choice(["", "", word() + ".", word()[0] + ".", word() + dot]) + word()
        return f"{local}{at}{dot.join(word() for _ in range(r.choice([1, 1, 1, 2, 5])))}{dot}{r.choice(['com', 'org', 'net', 'example'])}"

    def other() -> str:
        return r.choice([f"{digits(4)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {digits(2)}:{digits(2)}", f"{r.randint(1, 20)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{digits(r.randint(1, 6))}", f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f'"{r.choice("abcdef")}{digits(7)}{r.choice("abcdef")}{digits(9)}"', f"{digits(3)},{digits(3)}", f"x{digits(9)}", f"order {digits(8)}", f"{r.randint(256, 999)}.{digits(2)}.{digits(3)}.{digits(2)}", f"{digits(3)}/{digits(4)} {digits(2)}/{digits(4)}", f"{word()} at {word()}.{word()[:3]} {word()}", f"{digits(r.randint(20, 30))}", f"{digits(4)} {digits(4)}", f"0.{digits(12)}"])

    out = []
    for _ in range(n):
        text, truth = "", {}
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            kind = r.choice(["card", "phone", "ip", "email", "none", "none"])
            if kind in _CUES and r.random() < 0.3:
                text += r.choice(_CUES[kind]) + r.choice([": ", " "])
            s = {"card": card, "phone": phone, "ip": ip, "email": spelled, "none": other}[kind]()
            if kind != "none":
                truth[len(text), len(text) + len(s)] = kind
            text += s + r.choice([" ", ". ", ", ", "!! ", "### ", "\n"])
        out.append((text, truth))
    return out


@lru_cache
def trained(n: int = 500, seed: int = 7) -> Field:
    """The random field fitted on n generated sentences."""
    data = [(g, [s for j in range(g) for s in ending(j)], truth) for text, truth in sentences(n, seed) for g, ending in runs(text)]
    data = [x for x in data if x[1]]
    names: dict[str, int] = {}
    for _, segs, _ in data:
        for s in segs:
            for f in s.features:
                names.setdefault(f, len(names))
    field = Field(names)
    field.fit(data)
    return field


def all_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """The base spans and those spans of the random field that touch none of them, by start and then kind."""
    taken = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in taken]
    longest = max((b - a for a, b in taken), default=0)
    out = list(base)
    for n, ending in runs(text):
        for a, b, kind in field.best(n, ending):
            i = bisect_left(starts, a - longest)
            while i < len(taken) and taken[i][0] < b and taken[i][1] <= a:
                i += 1
            if i == len(taken) or taken[i][0] >= b:
                out.append((a, b, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- Spark


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _with_spans(make_columns: Callable) -> Callable:
    field = trained()  # fitted once, on the driver

    def make():
        def run(x):
            return make_columns(x, lambda text: (base := base_spans(text), all_spans(text, base, field)))

        return run

    return make


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of structs start, end, kind) of every text; one row a row."""

    def columns(x, find):
        found = [find(t) for t in x["text"]]
        as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        return {"doc_id": x["doc_id"], "base": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found]}

    one = "array<struct<start:int,end:int,kind:string>>"
    return by_batch(texts(docs), _with_spans(columns), f"doc_id long, base {one}, spans {one}")


def digest_spans(found: DataFrame) -> DataFrame:
    """The columns of the query from find_spans: counts and digest of the base spans, and all spans as text."""
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def redacted(text: str, spans: list[Span]) -> str:
    """text with every stretch of touching spans replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text column replaced by [EMAIL], [IP], [CARD] or [PHONE]. Null texts stay null; all columns stay, n_chars (if there is one) follows the new text."""
    field = trained()
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t and redacted(t, all_spans(t, base_spans(t), field)) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if "n_chars" in batch.schema.names:
                k = batch.schema.names.index("n_chars")
                sizes = [c if t is None else len(t) for t, c in zip(new, columns[k].to_pylist(), strict=True)]
                columns[k] = pa.array(sizes, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    from .common import small_batches

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
