"""Exponentially weighted means and ordinals in one blocked scan.

With ``q = 1-a`` an observation after ``g`` missing rows moves a mean to

    y[t] = (q^(g+1) y[t-1] + a x[t]) / (q^(g+1) + a)

(without a gap the divisor is 1), and a missing row leaves it as it is. All of this is
affine in the mean on entry, and affine maps compose. So a stretch of rows is summarised
by an *element*: its rows, the missing rows before its first and after its last
observation, the first observation ``xf``, and the map of the mean at the first
observation to that at the end, ``c + d (y - c) + l``. Two elements compose to one; the
gap between them is what trails in one and leads in the other. The first observation
of a series is its own mean.

The scan is a tree of three levels. Segments of a block, short enough for ``q^-k`` to
stay finite, compose to the block's element, blocks to that of a super-block of ``FAN``
blocks, and only these, a few numbers per ``FAN`` blocks, meet per symbol. On the way
down each level passes its parts the mean and gap on entry. Inside a segment a mean is a
running sum: with ``W`` the inverse of the decay since the segment's begin,

    y[t] = c + ((yf - c) W[f] + a SUM_{f<k<=t} (x[k] - c) W[k] / N[k]) / W[t]

where ``N`` are the divisors above. All means of a table share the segments, the
summaries and the join; running counts that must continue over blocks (ordinals) ride
along.

A mean of prices is taken relative to the block's first price ``c``, so means of a flat
series stay exactly flat and exactly equal to each other. A mean that decays towards zero
must not be shifted, so only the means named as ``levels`` are.

Only the means named as ``holes`` may have nulls inside their series, at the cost of two
more running columns; for the others nulls may lead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.operators.blocks import BLOCK

MAX_EXPONENT = 600.0
MAX_SEGMENT = 4096
FAN = 64

_ELEMENT = "struct<n:bigint,lead:bigint,xf:double,c:double,d:double,l:double,trail:bigint,q:double,a:double>"
_STATE = "struct<y:double,g:bigint>"
_ENTRY = "struct<y:double,f:bigint,xf:double,yf:double>"


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def wilder_alpha(length: int) -> float:
    return 1.0 / length


def segment_length(alphas: list[float]) -> int:
    """Rows per segment such that no weight exceeds exp(MAX_EXPONENT)."""
    rates = [-math.log1p(-a) for a in alphas if a < 1.0]
    return max(1, min([MAX_SEGMENT, *(int(MAX_EXPONENT / r) for r in rates)]))


def _array(items: list[str], kind: str) -> str:
    return f"cast(array({', '.join(items)}) as array<{kind}>)"


@dataclass(frozen=True)
class Mean:
    """One mean: its input, its alpha, the columns with the base and the weight of a
    row, and the divisor of its observation."""

    x: str
    alpha: float
    base: str
    weight: str
    divisor: str = "1D"

    @property
    def q(self) -> str:
        return f"{1 - self.alpha}D"

    @property
    def last_only(self) -> bool:
        """With alpha 1 the mean is the last observation."""
        return self.alpha >= 1.0

    def term(self) -> str:
        """What a row adds to the running sum; the first row of a segment nothing, as it
        is the observation the mean starts from."""
        if self.last_only:
            return "0D"
        return f"if({self.x} is null or t = 0, 0D, ({self.x} - {self.base}) * {self.weight} / {self.divisor})"

    def started(self, f: str, xf: str, base: str) -> str:
        """The term of a first observation behind the first row."""
        return f"if({f} > 0, ({xf} - {base}) * pow({self.q}, -{f}), 0D)"

    def element(self, i: int) -> str:
        """From the aggregates of a segment."""
        base, w_first, w_last = f"base_{i}", f"pow({self.q}, -f_{i})", f"weight_{i}"
        d, rest = f"{w_first} / {w_last}", f"{self.alpha}D * (sum_{i} - {self.started(f'f_{i}', f'xf_{i}', base)}) / {w_last}"
        if self.last_only:
            d, rest = "0D", f"xl_{i}"
        return (
            f"named_struct('n', n, 'lead', coalesce(f_{i}, n), 'xf', xf_{i}, 'c', {base}, 'd', {d}, 'l', {rest}, "
            f"'trail', coalesce(n - 1 - last_{i}, n), 'q', {self.q}, 'a', {self.alpha}D)"
        )

    def value(self, i: int) -> str:
        """The mean of a row, from its segment's entry."""
        e = f"get(get(entry, seg), {i})"
        if self.last_only:
            return f"if({e}.f is null or t < {e}.f, {e}.y, last_{i})"
        sums = f"({e}.yf - {self.base}) * pow({self.q}, -{e}.f) + {self.alpha}D * (sum_{i} - {self.started(f'{e}.f', f'{e}.xf', self.base)})"
        return f"if({e}.f is null or t < {e}.f, {e}.y, {self.base} + ({sums}) / {self.weight})"


def _decay(q: str, a: str, gap: str) -> str:
    """Share of the old mean in the one after an observation that follows a gap."""
    power = f"pow({q}, {gap} + 1)"
    return f"if({gap} = 0, {q}, {power} / ({power} + {a}))"


def _composed(a: str, b: str) -> str:
    """The element of two stretches in a row."""
    gap = f"({a}.trail + {b}.lead)"
    decay = _decay(f"{a}.q", f"{a}.a", gap)
    gain = f"if({gap} = 0, {a}.a, {a}.a / (pow({a}.q, {gap} + 1) + {a}.a))"
    moved = f"{decay} * ({a}.c - {b}.c + {a}.l) + {gain} * ({b}.xf - {b}.c)"
    both = f"""named_struct('n', {a}.n + {b}.n, 'lead', {a}.lead, 'xf', {a}.xf, 'c', {a}.c, 'd', {b}.d * {decay} * {a}.d,
        'l', ({b}.c - {a}.c) + {b}.d * ({moved}) + {b}.l, 'trail', {b}.trail, 'q', {a}.q, 'a', {a}.a)"""
    only_a = f"named_struct('n', {a}.n + {b}.n, 'lead', {a}.lead, 'xf', {a}.xf, 'c', {a}.c, 'd', {a}.d, 'l', {a}.l, 'trail', {a}.trail + {b}.n, 'q', {a}.q, 'a', {a}.a)"
    only_b = f"""named_struct('n', {a}.n + {b}.n, 'lead', {a}.n + {b}.lead, 'xf', {b}.xf, 'c', {b}.c, 'd', {b}.d, 'l', {b}.l,
        'trail', if({b}.xf is null, {a}.n + {b}.n, {b}.trail), 'q', {a}.q, 'a', {a}.a)"""
    return f"case when {a}.xf is null then {only_b} when {b}.xf is null then {only_a} else {both} end"


def _entered(s: str, e: str) -> str:
    """The mean at an element's first observation."""
    return f"if({s}.y is null, {e}.xf, {e}.xf + {_decay(f'{e}.q', f'{e}.a', f'({s}.g + {e}.lead)')} * ({s}.y - {e}.xf))"


def _left(s: str, e: str) -> str:
    """The state behind an element."""
    return f"""if({e}.xf is null, named_struct('y', {s}.y, 'g', {s}.g + {e}.n),
        named_struct('y', {e}.c + {e}.d * ({_entered(s, e)} - {e}.c) + {e}.l, 'g', {e}.trail))"""


def _fold(elements: str) -> str:
    """The composition of an array of vectors of elements."""
    composed = f"zip_with(p, o, (a, b) -> {_composed('a', 'b')})"
    return f"aggregate(slice({elements}, 2, size({elements})), {elements}[0], (p, o) -> {composed})"


def _carry(rows: DataFrame, means: list[Mean], conditions: list[str]) -> DataFrame:
    """One row per block: ``entry`` (segment -> per mean what it is entered with),
    ``c_in`` (counts on entry) and ``c_all`` (counts of the whole symbol)."""
    numbered = list(enumerate(means))
    place = lambda m: f"if({m.x} is null, null, t)"
    segments = rows.groupBy(*BLOCK, "seg").agg(
        F.expr("count(*) as n"),
        *[F.expr(f"sum({m.term()}) as sum_{i}") for i, m in numbered],
        *[F.expr(f"min({place(m)}) as f_{i}") for i, m in numbered],
        *[F.expr(f"max({place(m)}) as last_{i}") for i, m in numbered],
        *[F.expr(f"min_by({m.x}, {place(m)}) as xf_{i}") for i, m in numbered],
        *[F.expr(f"max_by({m.x}, {place(m)}) as xl_{i}") for i, m in numbered if m.last_only],
        *[F.expr(f"max({m.weight}) as weight_{i}") for i, m in numbered],
        *[F.expr(f"coalesce(max({m.base}), 0D) as base_{i}") for i, m in numbered],
        *[F.expr(f"count_if({c}) as count_{i}") for i, c in enumerate(conditions)],
    )
    vector = _array([m.element(i) for i, m in numbered], _ELEMENT)
    counts = _array([f"sum(count_{i})" for i in range(len(conditions))], "bigint")
    blocks = segments.groupBy(*BLOCK).agg(
        F.expr(f"sort_array(collect_list(named_struct('seg', seg, 'e', {vector}))) as segs"), F.expr(f"{counts} as counts")
    )
    blocks = blocks.selectExpr(
        "symbol", f"cast(floor(block / {FAN}) as int) as sup", "block", "transform(segs, s -> s.e) as segs", "counts"
    ).selectExpr("*", f"{_fold('segs')} as e")

    added = "zip_with({a}, {b}, (x, y) -> x + y)"
    no_counts = _array(["0"] * len(conditions), "bigint")
    supers = blocks.groupBy("symbol", "sup").agg(F.expr("sort_array(collect_list(struct(block, e, segs, counts))) as blocks"))
    total = f"aggregate(blocks, {no_counts}, (c, b) -> {added.format(a='c', b='b.counts')})"
    composed = supers.selectExpr("symbol", "sup", f"{_fold('transform(blocks, x -> x.e)')} as e", f"{total} as counts")

    start = _array(["named_struct('y', cast(null as double), 'g', 0L)"] * len(means), _STATE)
    step = f"zip_with(acc.s, item.e, (s, e) -> {_left('s', 'e')})"
    over_supers = f"""
        aggregate(sort_array(collect_list(struct(sup, e, counts))),
            named_struct('s', {start}, 'c', {no_counts}, 'out', cast(array() as array<struct<sup:int,s:array<{_STATE}>,c:array<bigint>>>)),
            (acc, item) -> named_struct('s', {step}, 'c', {added.format(a='acc.c', b='item.counts')},
                'out', array_append(acc.out, named_struct('sup', item.sup, 's', acc.s, 'c', acc.c))))"""
    tops = composed.groupBy("symbol").agg(F.expr(f"{over_supers} as fold")).selectExpr("symbol", "fold.c as c_all", "inline(fold.out)")

    entry = f"zip_with(a.s, v, (s, e) -> named_struct('y', s.y, 'f', if(e.xf is null, null, e.lead), 'xf', e.xf, 'yf', {_entered('s', 'e')}))"
    over_segments = f"""
        aggregate(item.segs, named_struct('s', acc.s, 'out', cast(array() as array<array<{_ENTRY}>>)),
            (a, v) -> named_struct('s', zip_with(a.s, v, (s, e) -> {_left('s', 'e')}), 'out', array_append(a.out, {entry})))"""
    over_blocks = f"""
        aggregate(blocks,
            named_struct('s', s, 'c', c, 'out', cast(array() as array<struct<block:int,entry:array<array<{_ENTRY}>>,c_in:array<bigint>>>)),
            (acc, item) -> transform(array({over_segments}), inner -> named_struct(
                's', inner.s, 'c', {added.format(a='acc.c', b='item.counts')},
                'out', array_append(acc.out, named_struct('block', item.block, 'entry', inner.out, 'c_in', acc.c))))[0])"""
    down = supers.join(tops, ["symbol", "sup"]).selectExpr("symbol", "c_all", f"{over_blocks} as fold")
    return down.selectExpr("symbol", "c_all", "inline(fold.out)")


def scan_series(
    rows: DataFrame,
    averages: dict[str, tuple[str, float]],
    ordinals: dict[str, str] | None = None,
    levels: tuple[str, ...] = (),
    holes: tuple[str, ...] = (),
) -> DataFrame:
    """Add a column per exponentially weighted mean, ``{name: (x, alpha)}``, and
    per ordinal, ``{name: condition}``: the number of earlier rows of the symbol
    that meet the condition, null on rows that do not, with the symbol's total in
    ``{name}_total``. ``x`` and ``condition`` are SQL expressions; ``levels`` names
    the means of price levels, ``holes`` those whose series may have nulls inside. On a
    row without an observation a mean stays what it was.

    ``rows`` are blocked bars without history rows.
    """
    ordinals = ordinals or {}
    conditions = list(ordinals.values())
    blended = {k: v for k, v in averages.items() if v[1] < 1.0 or k in holes}
    alphas = sorted({alpha for k, (_, alpha) in blended.items()})
    bases = sorted({x for k, (x, alpha) in blended.items() if k in levels and alpha < 1.0})
    open_series = sorted({x for k, (x, _) in blended.items() if k in holes})
    gapped = sorted({(x, alpha) for k, (x, alpha) in blended.items() if k in holes and alpha < 1.0})
    means = []
    for k, (x, alpha) in blended.items():
        base = f"base_{bases.index(x)}" if x in bases and k in levels else "0D"
        if k in holes and alpha < 1.0:
            g = gapped.index((x, alpha))
            means.append(Mean(x, alpha, base, f"gap_weight_{g}", f"exp(norm_{g})"))
        else:
            means.append(Mean(x, alpha, base, f"weight_{alphas.index(alpha)}" if alpha < 1.0 else "1D"))

    in_block = "over (partition by symbol, block order by ts)"
    so_far = "over (partition by symbol, block order by ts rows unbounded preceding)"
    length = segment_length(alphas)
    placed = rows.selectExpr(
        "*",
        f"row_number() {in_block} - 1 as t0",
        *[f"count_if({c}) {so_far} as run_{i}" for i, c in enumerate(conditions)],
        *[f"first({x}, true) {so_far} as base_{i}" for i, x in enumerate(bases)],
    )
    placed = placed.selectExpr("*", f"cast(t0 div {length} as int) as seg", f"cast(t0 % {length} as int) as t").drop("t0")
    placed = placed.selectExpr("*", *[f"pow({1 - a}D, -t) as weight_{i}" for i, a in enumerate(alphas) if a < 1.0])

    in_segment = "over (partition by symbol, block, seg order by ts rows"
    if open_series:
        before = f"{in_segment} between unbounded preceding and 1 preceding)"
        placed = placed.selectExpr("*", *[f"max(if({x} is null, null, t)) {before} as prev_{h}" for h, x in enumerate(open_series)])
        prev = {x: f"prev_{h}" for h, x in enumerate(open_series)}
        norm = "if({x} is null or {p} is null or t - {p} = 1, 0D, ln(pow({q}D, t - {p}) + {a}D))"
        placed = placed.selectExpr("*", *[f"{norm.format(x=x, p=prev[x], q=1 - a, a=a)} as norm_{g}" for g, (x, a) in enumerate(gapped)])
        weight = "pow({q}D, -if({x} is null, {p}, t)) * exp(sum(norm_{g}) {w} unbounded preceding))"
        placed = placed.selectExpr(
            "*", *[f"{weight.format(q=1 - a, x=x, p=prev[x], g=g, w=in_segment)} as gap_weight_{g}" for g, (x, a) in enumerate(gapped)]
        )

    summed = placed.selectExpr(
        "*",
        *[f"sum({m.term()}) {in_segment} unbounded preceding) as sum_{i}" for i, m in enumerate(means) if not m.last_only],
        *[f"last({m.x}, true) {in_segment} unbounded preceding) as last_{i}" for i, m in enumerate(means) if m.last_only],
    )
    joined = summed.join(_carry(placed, means, conditions), list(BLOCK))

    out = {k: x for k, (x, _) in averages.items() if k not in blended}
    out |= {name: m.value(i) for i, (name, m) in enumerate(zip(blended, means))}
    for i, (name, condition) in enumerate(ordinals.items()):
        out[name] = f"if({condition}, get(c_in, {i}) + run_{i} - 1, null)"
        out[f"{name}_total"] = f"get(c_all, {i})"
    kept = [c for c in rows.columns if c not in out]
    return joined.selectExpr(*kept, *[f"{e} as {k}" for k, e in out.items()])
