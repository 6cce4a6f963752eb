"""Personal data: rule-based base spans, and candidates selected by boosted trees, in DataFrame functions only.

Base spans are what the fixed patterns find, leftmost and without overlaps per kind, less the matches that fail the
kind's check. High-recall generators propose more spans (obfuscated addresses, local phone numbers, unusual separators).
Boosted regression trees score each candidate by format and context features; a threshold per kind, calibrated on
held-out examples for a precision of 0.98 at least, selects. The trees are fitted on the driver to examples that this
module generates from a fixed seed; their features are computed by the same Column expressions as in a query, and the fitted trees
become a Column expression, so a query has neither Python nor a shuffle in it.

Patterns are possessive and anchored, so that long runs cost linear time and no regex recursion.

Cases: a null text is empty and has no spans; the control characters U+0001 in texts are read as U+0002, lengths unchanged; a candidate
that overlaps a base span is dropped, and of overlapping candidates the best score stays (ties: kind order, then start);
repeated rows are treated alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that Java's engine neither recurses nor rescans.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators of further candidates.
MORE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[a-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[a-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[.\x20()\[\]]{1,5}[0-9]{1,3}){3}(?![0-9.])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[1-9][\x20().0-9-]{8,18}[0-9]|\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20.-][0-9]{4})(?![0-9])",
}
#: What a text must hold for a pattern to be tried at all.
GATE = {"email": r"@|(?i)[ (\[{]at[ )\]}]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write|reach|address|kontakt|correo|courriel|adresse",
    "ip": "ip|host|server|address|login|from|gateway",
    "card": "card|visa|master|amex|credit|debit|karte|tarjeta|carte|pay",
    "phone": "phone|call|tel|mobile|cell|fax|dial|reach|anruf|telefon|llam|appel",
}
FEATURES = ("kind", "digits", "length", "other", "bracket", "luhn", "variety", "glued_before", "glued_after", "context", "assigned", "groups", "octets", "words")
_MARK, _BLOCK = "\x01", 256
#: Scores are sums of a few leaves, which a query adds up in another order: equal ones may differ in the last digits.
_SLACK = 1e-6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k + 1, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _octets_ok(value: Column) -> Column:
    parts = F.split(F.regexp_replace(value, r"[^0-9]+", "."), r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(parts, lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) == 0, 0).otherwise(F.substring(F.ltrim(p, F.lit("0")), 1, 3).cast("int")) <= 255)


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets_ok(value)
    n = F.length(_digits(value))
    return n.between(14, 19) & luhn(_digits(value)) if kind == "card" else n.between(10, 15)


def pieces_of(text: Column, pattern: str, gate: str) -> Column:
    """The text cut at the matches' ends, so that every second piece is a match; null where there can't be any."""
    return F.when(F.rlike(text, F.lit(gate)), F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK))


def matches(pieces: Column) -> Column:
    """Matches as an array of (start, end, value, before, after): code points, 32 characters of context on each side.

    ``pieces`` must be a column of its own: an expression here would be evaluated again for every match.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def found(pieces: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pieces, b * _BLOCK + 1, F.lit(_BLOCK)))
        lengths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p)))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        def within(block: Column, b: Column) -> Column:
            def step(a: Column, p: Column) -> Column:
                at, k = a["at"], a["k"]
                here = F.struct(at.alias("start"), (at + F.length(p)).alias("end"), p.alias("value"), F.right(F.coalesce(F.get(pieces, b * _BLOCK + k - 1), F.lit("")), F.lit(32)).alias("before"), F.left(F.coalesce(F.get(pieces, b * _BLOCK + k + 1), F.lit("")), F.lit(32)).alias("after"))
                return F.struct((at + F.length(p)).alias("at"), (k + 1).alias("k"), F.when(k % 2 == 1, F.concat(a["out"], F.array(here))).otherwise(a["out"]).alias("out"))

            return F.aggregate(block, F.struct(F.get(starts, b).alias("at"), F.lit(0).alias("k"), empty.alias("out")), step, lambda a: a["out"])

        return F.flatten(F.transform(blocks, within))

    return F.when(F.size(pieces) > 1, found(pieces)).otherwise(empty)


def features(kind: Column, m: Column) -> Column:
    """Format and context of a candidate, as a struct of FEATURES (doubles)."""
    value, digits = m["value"], _digits(m["value"])
    context = reduce(lambda c, k: F.when(kind == k, F.rlike(F.concat(m["before"], F.lit(" "), m["after"]), F.lit(f"(?i){CONTEXT[k]}"))).otherwise(c), KINDS, F.lit(False))
    made = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), kind),
        "digits": F.length(digits),
        "length": F.length(value),
        "other": F.length(value) - F.length(F.regexp_replace(value, r"[^A-Za-z0-9]", "")),
        "bracket": F.rlike(value, F.lit(r"[\[({]")).cast("int"),
        "luhn": luhn(digits).cast("int"),
        "variety": F.size(F.array_distinct(F.split(digits, ""))),
        "glued_before": F.rlike(m["before"], F.lit(r"[\p{L}\p{N}_]$")).cast("int"),
        "glued_after": F.rlike(m["after"], F.lit(r"^[\p{L}\p{N}_]")).cast("int"),
        "context": context.cast("int"),
        "assigned": F.rlike(m["before"], F.lit(r"[=#\"'$€/:-]\s?$")).cast("int"),
        "groups": F.size(F.split(value, r"[^0-9]+")),
        "octets": _octets_ok(value).cast("int"),
        "words": F.size(F.split(F.trim(value), r"\s+")),
    }
    return F.struct(*[made[f].cast("double").alias(f) for f in FEATURES])


def _examples(seed: int) -> list[tuple[str, str, str, str, int]]:
    """(kind, before, value, after, label) made by rule: the kinds in their contexts, and look-alikes in theirs."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    text = lambda: " ".join(word() for _ in range(4))
    out = []
    for _ in range(400):
        say = {k: r.choice(CONTEXT[k].split("|")) for k in KINDS}
        at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), ("{at}", "."), ("[at]", "[dot]"), (" at ", " dot ")])
        plain = (at, dot) == (" at ", " dot ")
        out.append(("email", f"{text()} {say['email'] if plain or r.random() < 0.5 else ''}: ", f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}", f" {text()}", 1))
        out.append(("email", f"{text()} ", f"{word()} at {word()}. {word().capitalize()}", f" {text()}", 0))
        out.append(("email", f"{text()} ", f"{word()} at {word()} dot {word()}", f" {text()}", 0))
        out.append(("email", f"{text()} ", f"{word()} @ {word()}. {word()}", f" {text()}", 0))
        sep = r.choice(["[.]", " . ", "(.)"])
        out.append(("ip", f"{text()} {r.choice([say['ip'], ''])} ", sep.join(str(r.randint(0, 255)) for _ in range(4)), f" {text()}", 1))
        out.append(("ip", f"{text()} {r.choice([say['ip'], ''])} ", ":".join(f"{r.randint(0, 65535):x}" for _ in range(8)), f" {text()}", 1))
        out.append(("ip", f"{text()} ", " ".join(num(r.randint(1, 3)) for _ in range(4)), f" {text()}", 0))
        out.append(("ip", f"{text()} ", ". ".join(str(r.randint(1, 999)) for _ in range(4)), f" {text()}", 0))
        body = num(15)
        total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, body)))
        card = body + str(-total % 10)
        join = lambda c, s: s.join(c[k : k + 4] for k in (0, 4, 8, 12))
        out.append(("card", f"{text()} {r.choice([say['card'], ''])} ", join(card, r.choice([".", "/", "_", " - "])), f" {text()}", 1))
        bad = body + str((-total + r.randint(1, 9)) % 10)
        out.append(("card", f"{text()} ", join(bad, r.choice([".", "/", "_", " ", "-", " - "])), f" {text()}", 0))
        out.append(("card", f"{word()}_", join(bad, "_"), f"_{word()}", 0))
        a, b, c = num(3), num(3), num(4)
        out.append(("phone", f"{text()} {r.choice([say['phone'], ''])} ", r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}"]), f" {text()}", 1))
        out.append(("phone", f"{text()} {say['phone']} ", f"{a}.{b}.{c}", f" {text()}", 1))
        out.append(("phone", f"{text()} {r.choice([say['phone'] + ': ', ''])}", f"00{r.randint(1, 9)}{r.randint(0, 9)} {num(3)} {num(7)}", f" {text()}", 1))
        out.append(("phone", r.choice([f"{text()} {word()}=", f"{text()} #", f"{word()}"]), f"{a}-{b}-{c}", r.choice([f"{word()}", "-x"]), 0))
        out.append(("phone", f"{text()} ", f"{a} {b} {c}", f" {num(3)} {text()}", 0))
        out.append(("phone", f"{text()} = ", f"00{num(1)}{r.randint(1, 9)}{num(9)}", f" {text()}", 0))
        out.append(("phone", f"{text()} $", f"{a}.{b}.{c}", f" {text()}", 0))
    return out


def _tree(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, depth: int) -> tuple | float:
    leaf = float(residual.sum() / (hessian.sum() + 1.0))
    if depth == 0 or len(x) < 12:
        return leaf
    best = (1e-6, -1, 0.0)
    base = residual.sum() ** 2 / (hessian.sum() + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            gain = residual[left].sum() ** 2 / (hessian[left].sum() + 1.0) + residual[~left].sum() ** 2 / (hessian[~left].sum() + 1.0) - base
            if gain > best[0]:
                best = (gain, f, float(cut))
    _, f, cut = best
    if f < 0:
        return leaf
    left = x[:, f] <= cut
    return f, cut, _tree(x[left], residual[left], hessian[left], depth - 1), _tree(x[~left], residual[~left], hessian[~left], depth - 1)


def _value(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _value(low, x), _value(high, x))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, rate: float = 0.4) -> list:
    """Gradient boosting of the logistic loss with second-order leaves."""
    score, made = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, y - p, p * (1 - p), depth)
        made.append(tree)
        score += rate * _value(tree, x)
    return made


@lru_cache(maxsize=1)
def _model(key: int = 9) -> tuple[list, dict[str, float]]:
    spark = SparkSession.active()
    rows = _examples(key)
    data = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"kind": k, "before": b[-32:], "value": v, "after": a[:32], "y": y} for k, b, v, a, y in rows])), "array<struct<kind:string,before:string,value:string,after:string,y:int>>")).alias("m"))
    got = data.select(features(F.col("m.kind"), F.col("m")).alias("f"), "m.kind", "m.y").select("f.*", F.col("kind").alias("k"), "y").collect()
    x, y, kinds = np.array([[r[i] for i in range(len(FEATURES))] for r in got]), np.array([r.y for r in got]), np.array([r.k for r in got])
    fold = np.arange(len(x)) // 19 % 4 == 0  # held-out examples calibrate the thresholds
    trees = boost(x[~fold], y[~fold])
    score = 0.4 * sum(_value(t, x) for t in trees)
    least = {}
    for k in KINDS:
        s, t = score[fold & (kinds == k)], y[fold & (kinds == k)]
        order = np.argsort(-s, kind="stable")
        precision = np.cumsum(t[order]) / np.arange(1, len(s) + 1)
        good = np.flatnonzero((precision >= 0.98) & (np.r_[s[order][1:] < s[order][:-1], True]))
        least[k] = float(max(s[order][good[-1]], 0.0)) - _SLACK if len(good) else float("inf")
    return trees, least


def _as_column(tree: tuple | float, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(0.4 * tree)
    i, cut, low, high = tree
    return F.when(f[FEATURES[i]] <= cut, _as_column(low, f)).otherwise(_as_column(high, f))


def chosen(good: Column) -> Column:
    """The spans of candidates (loss, s), taken from the least loss on where they overlap none taken before."""
    order = F.array_sort(F.transform(good, lambda c: F.struct(c["loss"].alias("loss"), c["s"]["rank"].alias("rank"), c["s"]["start"].alias("start"), c["s"].alias("s"))))
    apart = lambda a, c: ~F.exists(a, lambda o: (o["s"]["start"] < c["s"]["end"]) & (c["s"]["start"] < o["s"]["end"]))
    return F.aggregate(order, F.filter(order, lambda c: F.lit(False)), lambda a, c: F.when(apart(a, c), F.concat(a, F.array(c))).otherwise(a), lambda a: F.transform(a, lambda c: c["s"]))


def _found(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns as _k0, _k1, ...; _text (never null), _base and _spans."""
    trees, least = _model()
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    clean = F.translate("_text", _MARK, "\x02")
    span = lambda kind, m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    rows = rows.withColumns({f"_base_{k}": pieces_of(clean, BASE[k], GATE[k]) for k in KINDS} | {f"_more_{k}": pieces_of(clean, MORE[k], GATE[k]) for k in KINDS})

    def base_of(kind: str) -> Column:
        return F.transform(F.filter(matches(F.col(f"_base_{kind}")), lambda m: _passes(kind, m["value"])), lambda m: span(kind, m))

    def scored_of(kind: str) -> Column:
        return F.transform(matches(F.col(f"_more_{kind}")), lambda m: F.struct(span(kind, m).alias("s"), features(F.lit(kind), m).alias("f")))

    rows = rows.withColumn("_base", F.array_sort(F.concat(*map(base_of, KINDS))))
    rows = rows.withColumn("_found", F.concat(*map(scored_of, KINDS)))
    free = F.filter("_found", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["s"]["end"]) & (c["s"]["start"] < b["end"])))
    scores = F.transform(free, lambda c: F.struct((-reduce(lambda a, b: a + b, [_as_column(t, c["f"]) for t in trees])).alias("loss"), c["s"].alias("s")))
    limit = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(-least[k]))])
    rows = rows.withColumn("_good", F.when(F.size("_found") > 0, F.filter(scores, lambda c: c["loss"] <= F.element_at(limit, c["s"]["kind"]))))
    best = F.when(F.size("_good") > 0, chosen(F.col("_good")))
    spans = F.when(best.isNotNull(), F.array_sort(F.concat("_base", best))).otherwise(F.col("_base"))
    return rows.select(*[f"_k{i}" for i in range(len(keep))], "_text", "_base", spans.alias("_spans"))


def detect(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, ``source`` (the text, never null), ``base`` and ``spans``: arrays of (start, rank, kind, end) in order."""
    return _found(docs, text, [key]).select(F.col("_k0").alias(key), F.col("_text").alias("source"), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", length: str | None = None) -> DataFrame:
    """All columns, with every span of the text replaced by its kind; ``length``, if given, names the column of the text's length to renew.

    A null text stays null.
    """
    new = redacted(F.col("_text"), F.col("_spans"))
    rows = _found(docs, text, docs.columns).withColumn("_new", new)

    def column(i: int, name: str) -> Column:
        old = F.col(f"_k{i}")
        if name == text:
            old = F.when(old.isNotNull(), F.col("_new"))
        elif name == length:
            old = F.when(old.isNotNull(), F.length("_new").cast(docs.schema[name].dataType))
        return old.alias(name)

    return rows.select(*[column(i, c) for i, c in enumerate(docs.columns)])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(source: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first in order names the stretch."""
    first = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"))
    merged = F.aggregate(
        spans,
        F.array(first),
        lambda a, s: F.when(s["start"] >= F.element_at(a, -1)["end"], F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))).otherwise(
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"), F.element_at(a, -1)["kind"].alias("kind"))))
        ),
    )
    piece = lambda m, k: F.concat(F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]"))), F.substring(source, m["end"] + 1, F.coalesce(F.get(merged, k + 1)["start"], F.length(source)) - m["end"]))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(merged, piece), "")).otherwise(source)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found = detect(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
