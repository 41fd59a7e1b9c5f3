"""Personal data by a semi-Markov conditional random field over whole spans, beside fixed base patterns.

The base patterns (email, ip, card, phone) are exact and always reported. The field adds what they miss: written-out
at signs, phone numbers without a plus sign. It looks at windows around digits and at signs, cut into atoms (digit
runs, letter runs, single other characters). A candidate is a run of at most ``MAX_ATOMS`` atoms; its features describe
the whole span: digit count, group sizes, separators, checksum, what stands on both sides. Dynamic programming over
the atoms picks the best set of disjoint spans with their kinds; training maximises the probability of the labelled
segmentation by the forward and backward sums of the same recursion.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskframe.llm.common import strings

# The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]

MAX_ATOMS = 24
KNOWN = 20_000  # spans whose scores are kept for when they come again
SAMPLE = 1200  # windows to learn from, at most
MAX_WINDOW = 160  # characters of a window to learn from
EPOCHS, RATE, RIDGE = 60, 0.1, 1e-3

SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")
ANCHOR = re.compile(r"[0-9@]|[(\[{]at[)\]}]")
ATOM = re.compile(r"[(\[{](?:at|dot)[)\]}]|[0-9]+|[A-Za-z]+|.", re.S)
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+(?:@|[(\[{]at[)\]}])[A-Za-z0-9-]+(?:(?:\.|[(\[{]dot[)\]}])[A-Za-z0-9-]+)+")
PLAIN = re.compile(r"[A-Za-z0-9._%+@()\[\]{}-]+")
NUMBER = re.compile(r"\+?[(]?[0-9][0-9 ().-]*[0-9]")


def luhn(digits: str) -> bool:
    odd = [int(x) for x in digits[::-1][::2]]
    even = [sum(divmod(2 * int(x), 10)) for x in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Equal to a leftmost search for local part, ``@``, domain, but found from the at signs: one pass whatever the text."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            spans.append((start, end, "email"))
        at = text.find("@", max(end, at + 1))
    return spans


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The base matches in order of start, then kind."""
    if not ANCHOR.search(text):
        return []
    spans = _emails(text)
    spans += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(_small, m.groups()))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:  # 19 digits and their separators
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdecimal() and c.isascii() for c in m.group()) <= 15:
            spans.append((m.start(), m.end(), "phone"))
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words with an anchor, one blank between them. Linear: each search stops at the window before."""
    start = end = -1
    for anchor in ANCHOR.finditer(text):
        if anchor.start() < end:
            continue
        word = 1 + max(text.rfind(c, max(0, end), anchor.start()) for c in " \t\n\r\x0b\x0c")
        word = max(word, end, 0)
        stop = SPACE.search(text, anchor.end())
        stop = stop.start() if stop else len(text)
        if word == end + 1 and text[end:word] == " " and start >= 0:
            end = stop
            continue
        if start >= 0:
            yield start, end
        start, end = word, stop
    if start >= 0:
        yield start, end


def cut(text: str) -> tuple[array, array]:
    """Starts and ends of the atoms of a window."""
    starts, ends = array("q"), array("q")
    for m in ATOM.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    return starts, ends


def segments(text: str, starts: array, ends: array) -> Iterator[tuple[int, int, str, tuple[str, ...], bool, bool]]:
    """The candidates in order of their first atom: (first atom, last atom + 1, span, kinds, glued left, glued right)."""
    for i, start in enumerate(starts):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        left = text[start - 1] if start else " "
        glued = left.isalnum() or left in "@.+-_"
        for j in range(i + 1, min(len(starts), i + MAX_ATOMS) + 1):
            span = text[start:ends[j - 1]]
            if not span[-1].isalnum():
                continue
            kinds = ("email",) if SPELLED.fullmatch(span) else ("ip", "card", "phone") if len(span) > 6 and NUMBER.fullmatch(span) else ()
            if kinds:
                yield i, j, span, kinds, glued, goes_on(text[ends[j - 1]:ends[j - 1] + 2])
            elif not (span[0] in "+(0123456789" and NUMBER.fullmatch(span + "0")) and not PLAIN.fullmatch(span):
                break  # no longer span from here is a candidate either


def candidates(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    """Atoms of a window as (start, end), and the candidate segments as (first atom, last atom + 1, kind, features)."""
    starts, ends = cut(text)
    found = []
    for i, j, span, kinds, left, right in segments(text, starts, ends):
        found += [(i, j, k, [f"{k}|{f}" for f in features]) for k, features in zip(kinds, describe(span, kinds, left, right))]
    return list(zip(starts, ends)), found


def goes_on(right: str) -> bool:
    """Whether the two characters after a span continue it."""
    return right[:1].isalnum() or right[:1] in ("@", "-", "_") or right[:1] in (".", "[", "(", "{") and right[1:].isalnum()


def describe(span: str, kinds: tuple[str, ...], left: bool, right: bool) -> list[list[str]]:
    """For each kind the features of a whole span: its shape and whether it is glued to what stands around it."""
    out = ["any", "glued left" if left else "free left", "glued right" if right else "free right"]
    if kinds == ("email",):
        host = re.split(r"@|[(\[{]at[)\]}]", span, maxsplit=1)[-1]
        last = re.split(r"\.|[(\[{]dot[)\]}]", host)[-1]
        return [out + ["sign" if "@" in span else "spelled", "name end" if last.isalpha() and 2 <= len(last) <= 12 else "odd end"]]
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    out.append(f"digits {len(digits)}" if len(digits) < 20 else "digits many")
    shape = "-".join(str(len(g)) for g in groups) if len(groups) < 7 else "many"
    out += [f"groups {shape}", f"marks {''.join(sorted(set(re.sub('[0-9]', '', span))))}"]
    own = {
        "ip": lambda: ["four small" if len(groups) == 4 and all(map(_small, groups)) and set(span) <= set("0123456789.") else "not four small"],
        "card": lambda: ["sum right" if 13 <= len(digits) <= 19 and luhn(digits) else "sum wrong"],
        "phone": lambda: ["plus" if span[0] == "+" else "no plus", f"spread {min(3, len(groups))}"],
    }
    return [out + own[k]() for k in kinds]


@dataclass(frozen=True)
class Field:
    weights: dict[str, float]

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, UNSEEN if "|groups" in f or "|digits" in f else 0.0) for f in features)


UNSEEN = -1.0  # of a shape that training never saw


def segment(field: Field, text: str) -> list[Span]:
    """The best disjoint typed spans of a window; atoms outside spans score 0.

    Candidates are scored as they come, in order of their first atom, and only the best one that ends at an atom is kept: what
    is held is a few numbers for each atom, however many candidates there are.
    """
    starts, ends = cut(text)
    n = len(starts)
    best, back = array("d", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))  # back: first atom * kinds + kind + 1
    known: dict[tuple[str, bool, bool], list[float]] = {}
    done = 0
    for i, j, span, kinds, left, right in segments(text, starts, ends):
        for at in range(done + 1, i + 1):
            _settle(best, back, at)
        done = max(done, i)
        scores = known.get((span, left, right))
        if scores is None:
            scores = [field.score([f"{k}|{f}" for f in features]) for k, features in zip(kinds, describe(span, kinds, left, right))]
            if len(known) >= KNOWN:
                known.clear()
            known[span, left, right] = scores
        for kind, s in zip(kinds, scores):
            if s > 0 and (not back[j] or best[i] + s > best[j]):
                best[j], back[j] = best[i] + s, i * len(KINDS) + KINDS.index(kind) + 1
    for at in range(done + 1, n + 1):
        _settle(best, back, at)
    spans, j = [], n
    while j:
        if back[j]:
            i, kind = divmod(back[j] - 1, len(KINDS))
            spans.append((starts[i], ends[j - 1], KINDS[kind]))
            j = i
        else:
            j -= 1
    return spans[::-1]


def _settle(best: array, back: array, at: int) -> None:
    """All candidates that end at this atom are known: leave it outside unless one of them gains."""
    if not back[at] or best[at] <= best[at - 1]:
        best[at], back[at] = best[at - 1], 0


def all_spans(field: Field, text: str, base: list[Span]) -> list[Span]:
    """The base spans, and the field's that touch none of them."""
    if not ANCHOR.search(text):
        return base
    added, starts = [], [s[0] for s in base]
    reach = list(accumulate((s[1] for s in base), max))  # the furthest end of a span and those before it
    for shift, stop in windows(text):
        for start, end, kind in segment(field, text[shift:stop]):
            start, end = start + shift, end + shift
            before = bisect_left(starts, end)  # base spans that start before this one ends
            if not before or reach[before - 1] <= start:
                added.append((start, end, kind))
    return ordered(base + added) if added else base


def variants(window: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """A labelled window, and it with every phone's plus sign dropped, and with every email's signs spelled out."""
    out = [(window, spans)]
    for kinds, change in (
        (("phone",), lambda s: re.sub(r"^\+[0-9]{1,3}[ -]", "", s)),
        (("phone",), lambda s: re.sub(r"[() ]+", "-", re.sub(r"^\+[0-9]{1,3}[ -]\(?", "", s))),
        (("email",), lambda s: s.replace("@", "(at)")),
        (("email",), lambda s: s.replace("@", "[at]").replace(".", "[dot]")),
    ):
        if any(k in kinds for _, _, k in spans):
            text, moved, end = "", [], 0
            for s, e, k in spans:
                text += window[end:s]
                new = change(window[s:e]) if k in kinds else window[s:e]
                moved.append((len(text), len(text) + len(new), k))
                text, end = text + new, e
            out.append((text + window[end:], moved))
    return out


# Windows every training run sees, so that the field is defined on any corpus.
LESSONS = [
    ("ann.lee@mail.example.com", ["email"]), ("bob7@a-b.example", ["email"]), ("10.20.30.40", ["ip"]), ("192.168.1.254", ["ip"]),
    ("4111 1111 1111 1111", ["card"]), ("5500005555555559", ["card"]), ("378282246310005", ["card"]), ("+1 (212) 555-0142", ["phone"]),
    ("+44 20 7946 0958", ["phone"]), ("+1 (415) 555-2671", ["phone"]), ("2024-01-15", []), ("15.01.2024", []), ("1234567", []), ("20240115", []),
    ("12:30:45", []), ("1234567890", []), ("3.14159265", []), ("300.400.500.600", []), ("4111111111111112", []), ("978-3-16-148410-0", []),
    ("1000000 2000000", []), ("0123456789abcdef", []), ("a1b2c3d4e5f60718", []), ("1999 2000 2001 2002", []), ("10 20 30 40 50", []), ("v2.10.3", []),
    ("x@y", []), ("@name", []), ("123-45", []), ("12345-6789", []), ("1.234.567", []), ("1234-5678-9012", []), ("100 200 300", []), ("555 1234", []),
]


def train(examples: list[tuple[str, list[Span]]]) -> Field:
    """Weights that maximise the log probability of the labelled segmentations, with a small ridge."""
    names: dict[str, int] = {}
    windows = []
    for text, spans in examples:
        atoms, found = candidates(text)
        if not found:
            continue
        gold = {s for s in spans}
        rows = [[names.setdefault(f, len(names)) for f in features] for _, _, _, features in found]
        right = [(atoms[i][0], atoms[j - 1][1], k) in gold for i, j, k, _ in found]
        windows.append((len(atoms), [(i, j) for i, j, _, _ in found], rows, right))
    if not windows:
        return Field({})
    entry_row = np.concatenate([np.full(len(r), n) for n, r in enumerate(r for w in windows for r in w[2])])
    entry_col = np.concatenate([np.array(r) for w in windows for r in w[2]])
    right = np.array([x for w in windows for x in w[3]], float)
    n, m = len(right), len(names)
    w, mean, spread = np.zeros(m), np.zeros(m), np.zeros(m)
    for step in range(1, EPOCHS + 1):
        scores = np.bincount(entry_row, w[entry_col], n)
        expected = np.concatenate(list(_marginals(windows, scores)))
        slope = np.bincount(entry_col, (right - expected)[entry_row], m) / len(windows) - RIDGE * w
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope * slope
        w = w + RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
    return Field({f: float(w[i]) for f, i in names.items()})


def _marginals(windows, scores) -> Iterator[np.ndarray]:
    """Per window the probability of each candidate, by forward and backward sums over the atoms."""
    at = 0
    for size, places, rows, _ in windows:
        own = scores[at:at + len(rows)]
        at += len(rows)
        by_end: list[list] = [[] for _ in range(size + 1)]
        by_start: list[list] = [[] for _ in range(size + 1)]
        for (i, j), s in zip(places, own):
            by_end[j].append((i, s))
            by_start[i].append((j, s))
        forward, backward = [0.0] * (size + 1), [0.0] * (size + 1)
        for j in range(1, size + 1):
            forward[j] = _logsum([forward[j - 1], *(forward[i] + s for i, s in by_end[j])])
        for i in range(size - 1, -1, -1):
            backward[i] = _logsum([backward[i + 1], *(backward[j] + s for j, s in by_start[i])])
        yield np.exp([forward[i] + s + backward[j] - forward[size] for (i, j), s in zip(places, own)])


def _logsum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """Learn from windows of the documents, labelled by the base patterns, with their variants, and ``LESSONS``.

    At most ``sample`` distinct windows of at most ``MAX_WINDOW`` characters are used, the first by hash. No
    documents or none with a window leave the lessons.
    """
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {t[a:b] for t in strings(batch.column(0)) for a, b in windows(t) if b - a <= MAX_WINDOW}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["window"])

    drawn = (
        docs.select(F.col(text).cast("string").alias("text")).mapInArrow(draw, "window string")
        .distinct().orderBy(F.xxhash64("window"), "window").limit(sample).collect()
    )
    examples = [v for r in drawn for v in variants(r["window"], _disjoint(base_spans(r["window"])))]
    lessons = [(t, [(0, len(t), k) for k in kinds]) for t, kinds in LESSONS]
    for t, spans in lessons:
        examples += 3 * variants(t, spans)
    return train(examples)


def _disjoint(spans: list[Span]) -> list[Span]:
    kept: list[Span] = []
    for s in spans:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


SCHEMA = T.StructType([
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
])


def personal_data(field: Field, text: str | Column) -> Column:
    """A struct of ``SCHEMA``: base matches per kind, the digest of the base spans, and all spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, comma-joined. A null or empty
    text has no spans (counts 0, the digest of the empty string, empty ``spans``). Each row is read alone and whole:
    repeated rows give equal results and other columns play no part.
    """
    weights = field.weights

    @F.arrow_udf(SCHEMA)
    def find(texts: pa.Array) -> pa.Array:
        here, rows = Field(weights), []
        for t in strings(texts):
            base = base_spans(t)
            kinds = [s[2] for s in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(here, t, base))))
        columns = list(zip(*rows)) or [()] * len(SCHEMA)
        kinds_of = [pa.int64()] * len(KINDS) + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_of)], names=SCHEMA.names)

    return find.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def redacted(field: Field, text: str | Column) -> Column:
    """The text with every span replaced by its kind in brackets, overlapping spans by that of the first; null stays null."""
    weights = field.weights

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        here, out = Field(weights), []
        for t in texts.to_pylist():
            if t:
                parts, end = [], 0
                for start, stop, kind in all_spans(here, t, base_spans(t)):
                    if start >= end:
                        parts += [t[end:start], f"[{kind.upper()}]"]
                    end = max(end, stop)
                t = "".join([*parts, t[end:]]) if end else t
            out.append(t)
        return pa.array(out, pa.string())

    return mask(F.col(text) if isinstance(text, str) else text)
