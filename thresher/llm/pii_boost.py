"""Personal data by candidate gradient boosting, in DataFrame functions only.

* High-recall generators propose spans of four kinds, which may overlap: the
  plain patterns (whose valid matches are the base spans and always stay) and
  wider ones (bracketed "at"/"dot", phone numbers without a country code, cards
  with other separators, bracketed dots in addresses).
* The boosted trees answer one question of a place in a text: do its
  surroundings announce a span of this kind?  Their features are the kind, what
  stands before and after, and the announcing words (whether of this kind); nothing of the format, so
  that what plain spans teach holds for wide ones.  For each kind the plain
  spans that pass their checks count as true; its plain matches that fail, the
  valid spans of other kinds and numbers that belong to no span count as false.
  Matches of the whole table are counted by feature vector (at most 1,200 of
  them), so the trees are fitted on every match, by counts alone.
* The trees' log-odds are calibrated on one fifth of the documents, and each
  kind gets the least threshold above which held-out matches are shown to be
  right at least 98 % of the time.  Wide candidates that reach it, pass their
  kind's check and overlap no base span become added spans.

Positions are code points, end exclusive.  All work on one text stays in its
row, so nothing is shuffled but the feature counts.

Defined cases: a null text counts as empty and has no spans (redacted it stays
null); repeated rows have the same spans; without candidates nothing is added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The plain patterns, with possessive repeats and starts only where a leftmost
# match can start (not inside a run that has just failed): the same matches
# without backtracking over long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+[\[(]\x20?at\x20?[\])]\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|[\[(]\x20?dot\x20?[\])])\x20?+[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[\[(]\.[\])][0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,2}+[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?+|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
MAY = {"email": r"@|[\[(]\x20?at", "ip": r"[0-9][\])]?\.?[\[(]?\.?[0-9]", "card": r"[0-9][\x20./_-]?[0-9]", "phone": r"[0-9][\x20.()-]*+[0-9]"}
# words that stand before a number, by what they announce
CONTEXT = ((1, r"(?:phone|tel|call|fax|mobile|cell)\W{0,3}$"), (2, r"(?:card|visa|credit|account)\W{0,3}$"), (3, r"(?:ip|host|server|address)\W{0,3}$"),
           (4, r"(?:mail|e-mail|contact)\W{0,3}$"), (5, r"(?:version|v|order|id|no|number|isbn|serial)\W{0,3}$"))
ANNOUNCES = (4, 3, 2, 1)  # for each kind, the context that announces it
FEATURES = ("kind", "before", "after", "context", "announced")
PRECISION = 0.98
BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running_sums(lengths: Column) -> Column:
    """Inclusive running sums of an array, by blocks: linear in its length."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def by_block(a: Column) -> Column:
        ids = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
        sums = F.transform(ids, lambda b: total(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        return _let(starts, lambda st: F.transform(a, lambda x, i: F.get(st, F.floor(i / BLOCK).cast("int"))
                                                   + total(F.slice(a, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))

    return _let(lengths, by_block)


def _char_class(c: Column) -> Column:
    return (F.when(c.isNull() | (c == ""), 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\s"), 3).otherwise(4))


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: array of (start, stop, found, lead, next)."""
    def spans(p: Column) -> Column:
        found, rest = p["found"], p["rest"]
        gaps = F.transform(rest, lambda r, i: F.length(r).cast("long") + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
        return _let(_running_sums(gaps), lambda start: F.transform(found, lambda m, i: F.struct(
            F.get(start, i).alias("start"), (F.get(start, i) + F.length(m)).alias("stop"), m.alias("found"),
            F.lower(F.right(F.get(rest, i), F.lit(16))).alias("lead"), F.left(F.get(rest, i + 1), F.lit(1)).alias("next"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("rest"))
    return _let(both, spans)


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(found)
    if kind == "card":
        return n.between(13, 19) & _luhn(digits)
    return n.between(9, 15)


def _octets(found: Column) -> Column:
    return F.forall(F.split(found, "[^0-9]+"), lambda p: p.rlike("^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$") | p.rlike("^0+$"))


def _luhn(digits: Column) -> Column:
    return F.when(F.length(digits).between(2, 30), F.call_function("luhn_check", digits)).otherwise(False)


def _described(k: int, kind: str, plain: bool) -> Callable[[Column], Column]:
    """A match as a candidate: its span, whether it passes its kind's check,
    the features; loose: a number that stands alone and is no card."""
    def described(m: Column) -> Column:
        context = F.coalesce(*[F.when(m["lead"].rlike(p), c) for c, p in CONTEXT], F.lit(0))
        before, valid = F.right(m["lead"], F.lit(1)), _valid(kind, m["found"])
        loose = F.lit(plain and kind == "card") & ~valid & before.rlike(r"^\s?$") & ~F.coalesce(m["next"], F.lit("")).rlike(r"[\p{L}0-9@._%+-]")
        return F.struct(
            F.lit(k).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), (F.lit(plain) & valid).alias("base"),
            valid.alias("valid"), F.lit(plain).alias("plain"), loose.alias("loose"),
            _char_class(before).alias("before"), _char_class(m["next"]).alias("after"), context.alias("context"), (context == ANNOUNCES[k]).cast("int").alias("announced"))

    return described


def candidates(text: Column) -> Column:
    """Every proposed span: array of (kind, start, stop, base, the features).
    kind is its place in KINDS; base: a plain pattern's match that passed."""
    parts = []
    for k, kind in enumerate(KINDS):
        for plain, pattern in ((True, BASE[kind]), (False, WIDE[kind])):
            parts.append(F.when(text.rlike(MAY[kind]) & text.rlike(pattern), F.transform(_matches(text, pattern), _described(k, kind, plain))))
    empty = F.array().cast("array<struct<kind:int,start:bigint,stop:bigint,base:boolean,valid:boolean,plain:boolean,loose:boolean,before:int,after:int,context:int,announced:int>>")
    return F.concat(*[F.coalesce(p, empty) for p in parts])


@dataclass
class Tree:
    """A split (feature, least value that goes right) or a leaf's value."""

    feature: int = -1
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0


@dataclass
class SpanModel:
    trees: list[Tree]
    bias: float
    slope: float
    shift: float
    thresholds: dict[int, float]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Tree:
    leaf = Tree(value=float(rate * g.sum() / (h.sum() + 1.0)))
    if depth == 0:
        return leaf
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[1:]:
            r = x[:, f] >= cut
            new = g[r].sum() ** 2 / (h[r].sum() + 1.0) + g[~r].sum() ** 2 / (h[~r].sum() + 1.0) - whole
            if new > gain:
                best, gain = (f, int(cut), r), new
    if best is None:
        return leaf
    f, cut, r = best
    return Tree(f, cut, _grow(x[~r], g[~r], h[~r], depth - 1, rate), _grow(x[r], g[r], h[r], depth - 1, rate))


def _walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    if tree.feature < 0:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] >= tree.cut, _walk(tree.right, x), _walk(tree.left, x))


def boost(x: np.ndarray, n: np.ndarray, true: np.ndarray, *, rounds: int = 24, depth: int = 3, rate: float = 0.4) -> tuple[list[Tree], float]:
    """Boosted trees for log-odds, on distinct feature rows with their counts."""
    p0 = (true.sum() + 0.5) / (n.sum() + 1.0)
    bias = float(np.log(p0 / (1 - p0)))
    score, trees = np.full(len(x), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, true - n * p, n * p * (1 - p), depth, rate))
        score = score + _walk(trees[-1], x)
    return trees, bias


def fit(docs: DataFrame) -> SpanModel | None:
    """Fit on the plain matches of every row of `docs` (doc_id, text)."""
    plain = F.filter(candidates(F.coalesce(F.col("text"), F.lit(""))), lambda c: c["plain"])
    found = docs.select((F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"), F.explode(plain).alias("c"))
    told = ("valid", "loose")
    counted = found.groupBy("held", *[F.col(f"c.{f}").alias(f) for f in (*told, *FEATURES)]).agg(F.count("*").alias("n"))
    rows = counted.orderBy("held", *told, *FEATURES).collect()  # one row per feature vector
    table: dict[tuple, list[float]] = {}
    for r in rows:
        for k, kind in enumerate(KINDS):
            own = r["kind"] == k
            if own or r["valid"] or (r["loose"] and kind != "card"):
                cell = table.setdefault((r["held"], k, r["before"], r["after"], r["context"], int(r["context"] == ANNOUNCES[k])), [0.0, 0.0])
                cell[0] += r["n"]
                cell[1] += r["n"] if own and r["valid"] else 0
    if not table:
        return None
    x = np.array([key[1:] for key in table], np.int64)
    n, yes = np.array(list(table.values())).T
    held = np.array([key[0] for key in table], bool)
    own, check = ~held, held
    if not own.any() or not check.any():
        own = check = np.ones(len(x), bool)
    trees, bias = boost(x[own], n[own], yes[own])
    score = bias + sum(_walk(t, x[check]) for t in trees)
    slope, shift = _calibrate(score, n[check], yes[check])
    p = 1 / (1 + np.exp(-(slope * score + shift)))
    thresholds = {}
    for k in range(len(KINDS)):
        mine = x[check][:, 0] == k
        # one wrong match more than there were: few matches show nothing
        levels = [t for t in np.unique(p[mine]) if yes[check][mine & (p >= t)].sum() / (n[check][mine & (p >= t)].sum() + 1) >= PRECISION]
        thresholds[k] = float(max(0.5, min([*levels, PRECISION])))
    return SpanModel(trees, bias, slope, shift, thresholds)


def _calibrate(score: np.ndarray, n: np.ndarray, yes: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift by damped Newton steps, with smoothed targets."""
    a, b = 1.0, 0.0
    target = (yes + 0.5) / (n + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        r, w = n * (target - p), n * p * (1 - p) + 1e-9
        g = np.array([(r * score).sum() - 0.1 * (a - 1), r.sum()])
        h = np.array([[(w * score * score).sum() + 0.1, (w * score).sum()], [(w * score).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b


def _as_column(tree: Tree, c: Column) -> Column:
    if tree.feature < 0:
        return F.lit(tree.value)
    return F.when(c[FEATURES[tree.feature]] >= tree.cut, _as_column(tree.right, c)).otherwise(_as_column(tree.left, c))


def _added(all_: Column, model: SpanModel | None) -> Column:
    """Wide candidates over their kind's threshold that pass its check and
    overlap no base span, nor an added one of a kind listed earlier."""
    base = F.filter(all_, lambda c: c["base"])
    wide = F.filter(all_, lambda c: ~c["plain"] & c["valid"])
    if model is None:
        return F.filter(wide, lambda c: F.lit(False))

    def good(c: Column) -> Column:
        score = F.lit(model.bias)
        for t in model.trees:
            score = score + _as_column(t, c)
        p = 1 / (1 + F.exp(-(score * model.slope + model.shift)))
        least = F.lit(2.0)
        for k, t in model.thresholds.items():
            least = F.when(c["kind"] == k, t).otherwise(least)
        return p >= least

    apart = lambda c, o: (o["start"] >= c["stop"]) | (c["start"] >= o["stop"])
    free = _let(base, lambda b: F.filter(wide, lambda c: good(c) & F.forall(b, lambda o: apart(c, o))))
    return F.when(F.size(wide) == 0, wide).otherwise(_let(free, lambda w: F.filter(w, lambda c: F.forall(w, lambda o: (o["kind"] >= c["kind"]) | apart(c, o)))))


def spans_of(text: Column, model: SpanModel | None) -> Column:
    """Struct of `base` and `all` spans (base and added): arrays of (kind,
    start, stop) by kind, then start.  A null text counts as empty."""
    short = lambda a: F.array_sort(F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))))
    return _let(candidates(F.coalesce(text, F.lit(""))), lambda a: F.struct(
        short(F.filter(a, lambda c: c["base"])).alias("base"), short(F.concat(F.filter(a, lambda c: c["base"]), _added(a, model))).alias("all")))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that
    overlap become one, named by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        between = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], between, F.get(names, x["kind"]))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), out.alias("out"))

    whole = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind),
    base_sha256 and spans (base and added) of every row."""
    lean = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = lean.select("doc_id", spans_of(F.col("text"), fit(lean)).alias("s"))
    kinds = F.transform("s.base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("s.base")), 256).alias("base_sha256"), span_text(F.col("s.all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows with personal data redacted (and n_chars brought up to date);
    columns as they were."""
    model = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    text = F.col("row.text").cast("string")
    found = docs.select(F.struct("*").alias("row"), spans_of(F.col("text").cast("string"), model)["all"].alias("spans"))
    out = found.select("row", "spans", F.when(text.isNotNull(), redacted(text, F.col("spans"))).alias("out"))
    now = {"text": F.col("out"), "n_chars": F.when(F.size("spans") > 0, F.length("out").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(now[c] if c in now else F.col("row")[c]).alias(c) for c in docs.columns])
