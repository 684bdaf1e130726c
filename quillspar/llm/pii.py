"""Personal data by aggregated weak supervision.

Patterns propose spans. Four labelers vote on each: the pattern's own strict
test, a gazetteer (domains, calling codes, issuer digits, reserved networks, key
words), the words before it and the characters around it. Expectation
maximisation over the table of vote patterns estimates how reliable each labeler
is; the posteriors train a logistic span classifier on features of the span, and
the classifier decides on all spans but the strict base ones, which stay.

The texts are worked on with DataFrame functions only and never move; what
reaches the driver is the table of distinct vote and feature patterns, whose
size is bounded by their few values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of equal starts; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "account", "secret")
BASE = KINDS[:4]
CONTEXT_CHARS = 24
ACCEPT_FROM = 0.5
LABELERS = ("pattern", "gazetteer", "context", "edges")
FEATURES = ("kind", "size", "before", "after", "cue", "known")
EM_ROUNDS = 50

# The patterns that propose spans. Possessive forms match what the
# plain ones do, without going back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# Gazetteers and cue words.
_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|biz|io|eu|de|fr|es|uk|it|nl|ch|at|us|ca)$"
_RESERVED = r"^0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
_CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_ISSUER = r"^[3-6]"
_KEYWORD = r"(?i)(?:token|secret|key|passw(?:or)?d|bearer|auth|credential)"
_CUE = {
    "email": r"(?i)(?:mail|contact|write|@)",
    "ip": r"(?i)(?:\bip\b|host|server|addr)",
    "card": r"(?i)(?:card|visa|master|amex|credit)",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile)",
    "account": r"(?i)(?:acc(?:oun)?t|iban|number|\bno\b)",
    "secret": r"[=:]\s*[\"']?$",
}


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    return f"""aggregate(sequence(1, length({d})), 0, (acc, i) -> acc + if(i % 2 = 0,
        if(2 * int(substr({d}, length({d}) - i + 1, 1)) > 9, 2 * int(substr({d}, length({d}) - i + 1, 1)) - 9, 2 * int(substr({d}, length({d}) - i + 1, 1))),
        int(substr({d}, length({d}) - i + 1, 1)))) % 10 = 0"""


def _quote(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


_SPAN = "struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,size:int,before:int,after:int,cue:int,known:int>"


def _character(x: str) -> str:
    """0 none, 1 letter or digit, 2 blank, 3 other."""
    return rf"case when {x} = '' then 0 when {x} rlike '^[\\p{{L}}\\p{{N}}_]$' then 1 when {x} rlike '^\\s$' then 2 else 3 end"


def _judged(kind: str) -> str:
    """The votes on and the features of a span s of what a pattern found."""
    number = kind in ("card", "phone", "account")
    d = "s.digits" if number else "''"
    strict = {
        "email": "true", "ip": f"s.match rlike {_quote(_IP)}", "card": f"length({d}) between 14 and 19 and {_luhn(d)}",
        "phone": f"length({d}) between 10 and 15", "account": "false", "secret": "false",
    }[kind]
    pattern = {"account": f"if(length({d}) between 14 and 19, 1, -1)", "secret": "if(length(s.match) in (32, 40, 64), 1, 0)"}.get(kind, f"if({strict}, 1, -1)")
    known = {
        "email": f"if(s.match rlike {_quote(_DOMAINS)}, 1, 0)", "ip": f"if(s.match rlike {_quote(_RESERVED)}, -1, 1)", "card": f"if({d} rlike {_quote(_ISSUER)}, 1, -1)",
        "phone": f"if(s.match rlike {_quote(_CALLING)}, 1, 0)", "account": f"if({d} rlike {_quote(_ISSUER)}, 1, -1)", "secret": f"if(s.left rlike {_quote(_KEYWORD)}, 1, -1)",
    }[kind]
    cue = f"if(s.left rlike {_quote(_CUE[kind])}, 1, 0)"
    before, after = _character("right(s.left, 1)"), _character("s.right")
    edges = f"if(({before}) <> 1 and ({after}) <> 1, 1, -1)"
    return f"""named_struct('kind', '{kind}', 'start', s.start, 'end', s.end, 'base', {strict}, 'votes', array({pattern}, {known}, {cue}, {edges}),
        'size', least(6, length(s.match) div 8), 'before', {before}, 'after', {after}, 'cue', {cue}, 'known', {known})"""


def _found(rows: DataFrame, kind: str, present: Column) -> DataFrame:
    """A column of the places a pattern matches at, without a move: lengths of what lies between add up."""
    pattern = F.lit(PATTERNS[kind])
    rows = rows.withColumn("_m", F.when(present, F.regexp_extract_all("_text", pattern, F.lit(0)))).withColumn("_p", F.when(F.size("_m") > 0, F.split("_text", PATTERNS[kind], -1)))
    ends = "aggregate(transform(_m, (m, i) -> length(_p[i]) + length(m)), cast(array() as array<int>), (a, x) -> array_append(a, if(size(a) = 0, x, a[size(a) - 1] + x)))"
    rows = rows.withColumn("_e", F.when(F.col("_p").isNotNull(), F.expr(ends)))
    spans = f"transform(_m, (m, i) -> named_struct('start', _e[i] - length(m), 'end', _e[i], 'match', m, 'digits', {_digits('m')}, 'left', right(_p[i], {CONTEXT_CHARS}), 'right', left(_p[i + 1], 1)))"
    return rows.withColumn(f"_{kind}", F.when(F.col("_e").isNotNull(), F.expr(spans))).drop("_m", "_p", "_e")


def candidates(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``_row``, with a column ``proposed`` of spans, their votes and features; none for a null text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_number", F.col("_text").rlike("[0-9]"))
    has = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+")) & F.col("_number")}
    for kind in PATTERNS:
        rows = _found(rows, kind, has.get(kind, F.col("_number")))
    parts = []
    for kind in KINDS:
        source = "card" if kind == "account" else kind
        if kind == "account":  # long numbers that are no card
            keep = f"length(s.digits) >= 12 and not (length(s.digits) between 14 and 19 and {_luhn('s.digits')})"
            parts.append(f"transform(filter(_{source}, s -> {keep}), s -> {_judged(kind)})")
        elif kind == "secret":
            parts.append(f"transform(_{source}, s -> {_judged(kind)})")
        else:
            parts.append(f"filter(transform(_{source}, s -> {_judged(kind)}), s -> s.base)")
    none = f"cast(array() as array<{_SPAN}>)"
    whole = ", ".join(f"coalesce({p}, {none})" for p in parts)
    found = " or ".join(f"_{kind} is not null" for kind in PATTERNS)
    return rows.withColumn("proposed", F.expr(f"if({found}, concat({whole}), {none})")).select("_row", "proposed")


@dataclass
class SpanModel:
    """Labeler reliabilities and the weights of the span classifier."""

    reliability: dict[tuple[str, int, int], float]
    prior: dict[str, float]
    weights: dict[str, float]

    def probability(self, span: str = "s") -> str:
        """The classifier as an expression over a span."""
        table = ", ".join(f"'{k}', {w!r}D" for k, w in sorted(self.weights.items())) or "'', 0D"
        terms = " + ".join(f"coalesce(element_at(map({table}), concat('{f}=', {span}.{f})), 0D)" for f in FEATURES)
        return f"1 / (1 + exp(-({self.weights.get('bias', 0.0)!r}D + {terms})))"


def learn(proposed: DataFrame, *, rounds: int = EM_ROUNDS) -> SpanModel:
    """Reliabilities by expectation maximisation, then the classifier, from all proposed spans.

    Spans with equal votes and features count as often as they occur, in whatever
    order; without spans there are no reliabilities and no weights.
    """
    # an outer explode: from an inner one a filter of all patterns would be inferred and put on the scan
    each = proposed.select(F.explode_outer("proposed").alias("s")).where("s is not null").select("s.kind", "s.votes", *[f"s.{f}" for f in FEATURES if f != "kind"])
    table = each.groupBy(*each.columns).count().orderBy(*each.columns).collect()  # bounded: votes and features take few values
    n = [r["count"] for r in table]
    votes = [tuple(r["votes"]) for r in table]
    belief = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v in votes]
    prior: dict[str, float] = {}
    reliability: dict[tuple[str, int, int], float] = {}
    for _ in range(rounds if table else 0):
        for kind in KINDS:
            own = [(n[i], belief[i]) for i, r in enumerate(table) if r["kind"] == kind]
            prior[kind] = (1 + sum(c * b for c, b in own)) / (2 + sum(c for c, _ in own))
        for j, name in enumerate(LABELERS):
            for y in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                for i in range(len(table)):
                    mass[votes[i][j]] += n[i] * (belief[i] if y else 1 - belief[i])
                for v, m in mass.items():
                    reliability[name, y, v] = m / sum(mass.values())
        for i, r in enumerate(table):
            odds = math.log(prior[r["kind"]] / (1 - prior[r["kind"]])) + sum(math.log(reliability[name, 1, votes[i][j]] / reliability[name, 0, votes[i][j]]) for j, name in enumerate(LABELERS))
            belief[i] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    # logistic regression on the features of the span, towards the beliefs
    keys = [["bias", *[f"{f}={r[f]}" for f in FEATURES]] for r in table]
    weights = {k: 0.0 for own in keys for k in own}
    total = sum(n) or 1
    step = {k: sum(c for c, own in zip(n, keys, strict=True) if k in own) / total + 0.01 for k in weights}
    for _ in range(400):
        slope = {k: 0.001 * w for k, w in weights.items()}
        for c, b, own in zip(n, belief, keys, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[k] for k in own)))))
            for k in own:
                slope[k] += c / total * (p - b)
        for k in weights:
            weights[k] -= slope[k] / (step[k] * len(FEATURES) * 0.3)
    return SpanModel(reliability, prior, weights)


def spans(docs: DataFrame, model: SpanModel | None = None, *, into: str = "spans") -> DataFrame:
    """``docs`` with a column ``into``: an array of (kind, start, end, base), by start, kind, end.

    Places are code points, ends exclusive. Base spans stay whatever the
    classifier says; another span is added if its probability is high enough and
    it overlaps no base span. A null text has none; repeated rows are judged each
    for itself, and all of them teach the model; other columns are kept, ``text``
    as it was, but for one named as ``into``, which makes way. A table without
    spans teaches a model that accepts nothing beyond the base.
    """
    rows = candidates(docs)
    model = model or learn(rows)
    order = "case s.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    base = "filter(proposed, s -> s.base)"
    added = f"filter(filter(proposed, s -> not s.base and {model.probability()} >= {ACCEPT_FROM}), s -> not exists(_base, b -> b.start < s.end and s.start < b.end))"
    flat = f"transform(array_sort(transform(concat(_base, {added}), s -> named_struct('start', s.start, 'nth', {order}, 'end', s.end, 'kind', s.kind, 'base', s.base))), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'base', s.base))"
    none = "cast(array() as array<struct<kind:string,start:int,end:int,base:boolean>>)"
    found = rows.withColumn("_base", F.expr(base)).select("_row", F.expr(f"if(size(proposed) = 0, {none}, {flat})").alias("_spans"))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != into], F.col("_spans").alias(into))


def joined(only_base: bool = False) -> str:
    source = "filter(spans, s -> s.base)" if only_base else "spans"
    return f"array_join(transform({source}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def masked(found: DataFrame, *, spans: str = "spans") -> DataFrame:
    """``text`` with every span of the column ``spans`` replaced by its kind in brackets.

    Of overlapping spans the later one is replaced from where the earlier ends. A
    row without spans, a null text included, stays as it was.
    """
    cut = f"""aggregate(`{spans}`, named_struct('at', 0, 'parts', cast(array() as array<string>)),
        (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end, 'parts', concat(a.parts, array(substr(text, a.at + 1, greatest(s.start - a.at, 0)), concat('[', upper(s.kind), ']'))))),
        a -> concat(array_join(a.parts, ''), substr(text, a.at + 1)))"""
    return found.withColumn("text", F.expr(f"if(size(`{spans}`) = 0, text, {cut})"))
