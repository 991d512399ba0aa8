"""Secrets in texts: three fixed patterns, and strings that pass tests of randomness."""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickline.llm import words as W
from wickline.llm.scratch import written

# The kinds in their order, their patterns, and the lengths they need.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_BYTES = b"0123456789abcdef"
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

#: A text without this has no assignment; searched by Arrow.
MAY_ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"

_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Encodings by their alphabets, in the order of their symbols' values. A string is of the first that holds all its characters.
ENCODINGS = {
    "hex_lower": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36_lower": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Runs of these characters are tested: plain ones, and those that hold a base64 mark.
RUNS = ("base62", "base64", "base64url")
SCAN_BYTES = 2 << 20
STEPS = 20  # p-values are rounded up to 20 steps a decade


@dataclass(frozen=True)
class Battery:
    """``min_length``: characters of a tested string. ``alpha``: a string isn't random
    if the battery's combined p-value under randomness is below. ``false_share``: the
    expected share of ordinary strings among those found, controlled per length class."""

    min_length: int = 20
    alpha: float = 0.001
    false_share: float = 0.01


# ------------------------------------------------------------------------- the tests


def infer_encoding(text: str) -> str | None:
    """The first encoding that holds all characters of ``text``."""
    used = set(text)
    return next((name for name, alphabet in ENCODINGS.items() if used <= set(alphabet)), None)


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(values: np.ndarray, k: int) -> tuple[float, float]:
    """Chi-squared of the counts of ``k`` symbols and its upper p-value, by the moments
    that it has for few counts per symbol (cube-root approximation)."""
    n = len(values)
    x = float(k / n * (np.bincount(values, minlength=k).astype(np.float64) ** 2).sum() - n)
    freedom = (k - 1) * n / (n - 1)
    scale = (n - 1) / n
    spread = 2 / (9 * freedom)
    return x, _upper((max(x, 0.0) / (scale * freedom)) ** (1 / 3) / math.sqrt(spread) - (1 - spread) / math.sqrt(spread))


def runs(values: np.ndarray, k: int) -> float:
    """Two-sided p-value of the number of runs of symbols of the lower and upper half."""
    high = values >= k // 2
    n, n1 = len(values), int(high.sum())
    n2 = n - n1
    if not n1 or not n2:
        return 2.0 ** (1 - n)
    found = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * n1 * n2 / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return 1.0 if variance <= 0 else min(1.0, 2 * _upper(abs(found - mean) / math.sqrt(variance)))


def serial_correlation(values: np.ndarray) -> float:
    """Two-sided p-value of the correlation of neighbouring symbols."""
    centred = values - values.mean()
    power = float((centred**2).sum())
    if not power:
        return 0.0
    n = len(values)
    r = float((centred[1:] * centred[:-1]).sum()) / power
    return min(1.0, 2 * _upper(abs(r + 1 / n) * math.sqrt(n)))


def like_text(x: float, n: int, k: int, shares: np.ndarray) -> float:
    """P-value of a chi-squared as low as ``x`` if the ``n`` symbols came with the
    ``shares`` they have in ordinary text. It can't be small for short strings, whose
    counts say little."""
    s2, s3 = float((shares**2).sum()), float((shares**3).sum())
    mean = k * (1 - s2) + n * (k * s2 - 1)
    pairs = 2 * n * (n - 1) * (2 * (n - 2) * s3 + s2 - (2 * n - 3) * s2**2)
    return _upper((mean - x) / (k / n * math.sqrt(max(pairs, 1e-9))))


class Judge:
    """The battery with the character shares of a corpus."""

    def __init__(self, byte_counts: np.ndarray, rule: Battery):
        self.rule = rule
        self.shares, self.values = {}, {}
        for name, alphabet in ENCODINGS.items():
            # one more of each, so that no symbol is impossible
            counts = byte_counts[[ord(c) for c in alphabet]] + 1.0
            self.shares[name] = counts / counts.sum()
            self.values[name] = np.full(256, -1, np.int64)
            self.values[name][[ord(c) for c in alphabet]] = np.arange(len(alphabet))

    def p_value(self, text: str) -> float:
        """How likely an ordinary string of its length and encoding looks as random; 1
        if the battery says that it isn't random."""
        name = infer_encoding(text)
        k = len(ENCODINGS[name])
        values = self.values[name][np.frombuffer(text.encode(), np.uint8)]
        x, p_uniform = uniformity(values, k)
        if min(1.0, 3 * min(p_uniform, runs(values, k), serial_correlation(values))) < self.rule.alpha:
            return 1.0
        return like_text(x, len(values), k, self.shares[name])


def length_class(n: int) -> int:
    """Half-octaves."""
    return math.floor(2 * math.log2(n))


def step_of(p: float) -> int:
    """The p-value rounded up, in steps of a decade: 0 for 1, -20 for a tenth."""
    return max(-400, math.ceil(round(STEPS * math.log10(max(p, 1e-300)), 9)))


def thresholds(counts: dict[tuple[int, int], int], false_share: float) -> dict[int, int]:
    """Per length class the highest step that the step-up rule (Benjamini and Hochberg)
    accepts, from the number of tests per (class, step)."""
    out = {}
    for c in {c for c, _ in counts}:
        of_class = sorted((s, n) for (k, s), n in counts.items() if k == c)
        total, seen = sum(n for _, n in of_class), 0
        for step, n in of_class:
            seen += n
            if 10 ** (step / STEPS) * total <= false_share * seen:
                out[c] = step
    return out


# ------------------------------------------------------------------ spans of a block


def _spans(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least ``least`` set places."""
    edges = np.diff(mask.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - start >= least
    return start[long], end[long]


def _mask(alphabet: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(alphabet)] = True
    return table


_HEX_MASK = _mask(HEX_BYTES)
_RUN_MASKS = [_mask(ENCODINGS[name].encode()) for name in RUNS]


def base_spans(text: bytes, may_assign: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the matches of the three patterns in one text,
    leftmost and non-overlapping per kind, without those that are too short."""
    out = []
    if may_assign:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return out


def tested_spans(start: np.ndarray, end: np.ndarray, block: bytes, judge: Judge) -> list[tuple[int, int, float]]:
    """(start, end, p) of the strings of a block that are tested, from the spans of all
    runs. Of overlapping ones that with the least p-value stays, which is multiplied by
    their number."""
    spans = sorted(set(zip(start.tolist(), end.tolist())))
    out: list[tuple[int, int, float]] = []
    k = 0
    while k < len(spans):
        group, reach = [], spans[k][1]
        while k < len(spans) and spans[k][0] < reach:
            group.append(spans[k])
            reach = max(reach, spans[k][1])
            k += 1
        p, a, b = min((judge.p_value(block[a:b].decode()), a, b) for a, b in group)
        out.append((a, b, min(1.0, p * len(group))))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_TEST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("step", pa.int32())]))
_FOUND = "id {kind}, base array<struct<start: long, kind: int, end: long>>, tests array<struct<start: long, end: long, class: int, step: int>>"


def scan_block(texts: pa.Array, judge: Judge) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Per text its base spans (start, kind, end) and its tested strings outside of them
    (start, end, length class, step), in code points."""
    assigns = pc.match_substring_regex(texts, MAY_ASSIGN).to_pylist()
    raw = texts.cast(pa.large_binary()).to_pylist()
    block = b"\0".join(raw)  # no pattern and no run crosses a NUL
    data = np.frombuffer(block, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])]).astype(np.int64)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base: list[list[tuple]] = [[] for _ in raw]
    tests: list[list[tuple]] = [[] for _ in raw]

    for k, text in enumerate(raw):
        base[k] = [(a + int(starts[k]), kind, b + int(starts[k])) for a, kind, b in base_spans(text, assigns[k])]
    hex_start, hex_end = _spans(_HEX_MASK[data], HEX_LENGTH)
    for a, b, k in zip(hex_start.tolist(), hex_end.tolist(), (np.searchsorted(starts, hex_start, "right") - 1).tolist()):
        base[k].append((a, 2, b))

    run_spans = [_spans(mask[data], judge.rule.min_length) for mask in _RUN_MASKS]
    start, end = (np.concatenate(side) for side in zip(*run_spans))
    for a, b, p in tested_spans(start, end, block, judge):
        k = int(np.searchsorted(starts, a, "right")) - 1
        if not any(a < e and s < b for s, _, e in base[k]):
            tests[k].append((a, b, length_class(b - a), step_of(p)))

    for k in range(len(raw)):
        zero = int(points[starts[k]])
        base[k] = sorted((int(points[a]) - zero, kind, int(points[b]) - zero) for a, kind, b in base[k])
        tests[k] = [(int(points[a]) - zero, int(points[b]) - zero, c, s) for a, b, c, s in tests[k]]
    return base, tests


def _scanner(rule: Battery, byte_counts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(np.array(byte_counts, np.float64), rule)
        for batch in batches:
            for part, texts in W.pieces(batch, "text", SCAN_BYTES):
                base, tests = scan_block(texts, judge)
                as_dicts = [[[dict(zip(names, x)) for x in row] for row in rows] for names, rows in ((("start", "kind", "end"), base), (("start", "end", "class", "step"), tests))]
                columns = [part.column(part.schema.get_field_index("id")), pa.array(as_dicts[0], _SPAN), pa.array(as_dicts[1], _TEST)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "base", "tests"])

    return run


def _byte_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        for _, texts in W.pieces(batch, "text", SCAN_BYTES):
            total += np.bincount(np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], names=["byte", "n"])


# ------------------------------------------------------------------------ the operator


def scan_secrets(df: DataFrame, rule: Battery = Battery(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id and ``spans``, an array of (start, kind, end),
    sorted, in code points with exclusive ends; kinds are numbers of ``KINDS``.

    Base spans are the matches of the three patterns. Beside them, runs of the
    characters of base62, base64 and URL-safe base64 outside of base spans are tested.
    Their encoding is inferred; chi-squared uniformity of its alphabet, the runs test
    and serial correlation must not reject randomness together. Then the chi-squared is
    held against that of ordinary text, whose character shares come from all documents:
    how likely would a string of ordinary characters, as long, look as uniform? Strings
    are found by the step-up rule on these p-values within their length class, so the
    expected share of ordinary strings is controlled for short and for long ones.

    Null and empty texts have no spans. Repeated rows are tested each. An empty table
    gives an empty result. A block holds at most 2 MB of texts, or one longer text
    whole; other columns aren't looked at. The driver gets 256 byte counts and the
    number of tests per length class and step.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    bytes_seen = rows.select("text").mapInArrow(_byte_counter, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    counts = {r.byte: r.n for r in bytes_seen.collect()}
    schema = _FOUND.format(kind=rows.schema["id"].dataType.simpleString())
    found = written(rows.mapInArrow(_scanner(rule, [counts.get(b, 0) for b in range(256)]), schema), "spans")
    tests = found.select(F.inline("tests")).groupBy("class", "step").count().collect()
    limits = thresholds(Counter({(r["class"], r["step"]): r["count"] for r in tests}), rule.false_share)
    if not limits:
        added = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    else:
        limit = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        passing = F.filter("tests", lambda t: t["step"] <= F.try_element_at(limit, t["class"]))
        kind = F.lit(KINDS.index("random")).alias("kind")
        added = F.transform(passing, lambda t: F.struct(t["start"].alias("start"), kind, t["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", added)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of the spans, parted by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    numbers = [KINDS.index(k) for k in kinds]
    return F.filter(spans, lambda s: s["kind"].isin(numbers))
