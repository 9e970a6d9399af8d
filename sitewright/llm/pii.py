"""Personal data and secrets: generators, boosted trees, calibrated thresholds; built-in functions only on the rows.

Base spans (email, ip, card, phone) come from fixed patterns with exact checks and always stay.  Wider generators propose further,
overlapping candidates: obfuscated or short addresses, bracketed and long internet addresses, dotted or unverified card
numbers, phone numbers without a plus sign; and two kinds of their own: ``id`` (social security and passport numbers, IBANs)
and ``secret`` (keys of well-known services, tokens, passwords after their name).  Boosted trees judge a candidate by its
format and by the words around it; a threshold for each kind, the lowest with ``PRECISION`` on snippets that the trees did not
see, selects what is added.  An added span never overlaps a base span, and of overlapping added spans the first start, then
the longest, then the first kind stays; one that only a left-out span reaches into is left out too.

There is no labelled table for this task, so the trees are fitted on snippets of their own (``pii_training``) with a fixed seed;
their features come from the same expressions as those of the documents.  One process fits once.  The fitted trees become a sum
of CASE expressions, which all candidates of a text share.

Offsets are code points, the end is exclusive.  A null text counts as empty and has no span; texts are searched whole,
in their own row, without a shuffle, in time that grows with their length; repeated rows are searched one by one; an empty table
gives an empty result.  Columns of the input may have any name: ``redact`` keeps them all, ``report`` leaves them out.
The patterns use possessive groups and start guards that leave every match as it is but keep the search linear in
long runs of letters or digits.
"""
from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, pick, scan, unlike
from .pii_training import ROWS, SEED, snippets

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "id", "secret")
TREES, DEPTH, RATE, PRECISION, BINS = 80, 4, 0.3, 0.98, 64
AROUND = 32
MATCHES = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
SPANS = "array<struct<s:int,d:int,k:int,added:int>>"
FAR = 2**31 - 1

_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": ("@",), "phone": ("+",)}

_AT = r"(?:\s?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\{(?:at|AT)\})\s?|\s(?:at|AT)\s)"
_MARKED_AT = r"\s?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\{(?:at|AT)\})\s?"
_DOT = r"(?:\s?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\{(?:dot|DOT)\})\s?|\s(?:dot|DOT)\s)"
_HEX = "0-9A-Fa-f"
# (kind, pattern, what a text must hold; none: a digit)
GENERATORS = (
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++)*?{_DOT}[A-Za-z0-9-]++", ("dot", "DOT")),
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++{_MARKED_AT}[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+", ("(at)", "[at]", "{at}", "(AT)", "[AT]", "{AT}")),
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]++", ("@",)),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s\.\s)[0-9]{1,3}){3}(?![0-9])", ("[.]", "(.)", " . ")),
    ("ip", rf"(?<![{_HEX}:.])(?:[{_HEX}]{{1,4}}:){{7}}[{_HEX}]{{1,4}}(?![{_HEX}:.])", (":",)),
    ("card", r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9])", ()),
    ("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])", ()),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\)\s?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", ()),
    ("phone", r"(?<![0-9+])00[1-9][0-9]{0,2}(?:[\x20().-]{1,2}[0-9]{2,4}){2,5}(?![0-9])", ("00",)),
    ("phone", r"(?<![0-9+./:-])0[1-9][0-9]{0,3}[\x20/.-](?:[0-9]{2,8}[\x20.-]?){1,4}(?<=[0-9])(?![0-9])", ("0",)),
    ("phone", r"(?<![0-9A-Za-z+./:_-])[2-9][0-9]{9}(?![0-9A-Za-z])", ()),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ("-",)),
    ("id", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ()),
    ("id", r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])", ()),
    ("id", r"(?<![0-9A-Za-z+./:_-])[0-9]{9}(?![0-9A-Za-z])", ()),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", ("AKIA", "ASIA")),
    ("secret", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{30,}+)", ("gh", "xox", "AIza")),
    ("secret", r"(?<![A-Za-z0-9])[sprk]k[-_](?:(?:live|test|proj)[-_])?[A-Za-z0-9_-]{16,}+", ("k-", "k_")),
    ("secret", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", ("eyJ",)),
    ("secret", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", ("PRIVATE KEY",)),
    ("secret", r"(?<![A-Za-z0-9])(?:[Pp]assword|[Pp]asswd|[Pp]wd|[Ss]ecret|[Tt]oken|api[_-]?key|API[_-]?KEY|PASSWORD|SECRET|TOKEN)\s?[:=]\s?[\x22']?[^\s\x22',;]{6,}+", (":", "=")),
)
CONTEXT = {
    "email": r"mail|contact|write|reach|reply|adresse|correo|kontakt|courriel",
    "ip": r"\bip\b|host|server|addr|client|node|connect|logged|servidor|serveur",
    "card": r"card|visa|credit|debit|payment|charge|tarjeta|karte|carte",
    "phone": r"phone|tel\b|tel[.:]|call|mobile|fax|cell|ring|telefon|llam|appel|number is",
    "id": r"ssn|social|passport|passeport|pasaporte|iban|account|konto|national|tax|\bid\b",
    "secret": r"key|token|secret|password|credential|aws|export|login",
}
OTHER = r"order|ref|invoice|isbn|serial|version|item|\bno\b|number of|score|page|hash|timestamp|ticket|build|flight|model|part|population|total|batch|sku|case|look|arriv|meet|stay"
FEATURES = (
    "generator", "n_digits", "n_chars", "luhn", "lead", "lead3", "remainder97", "own_word", "other_word", "glued_before", "glued_after", "parens", "marks", "upper", "variety", "suffix",
)


def luhn(digits: Column) -> Column:
    """Whether the check digit fits, from the right: every second digit doubled, nines cast out."""
    digit = lambda i: F.substr(digits, -i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def remainder97(m: Column) -> Column:
    """The check of bank account numbers: the first four characters go last, letters count 10 to 35, modulo 97 it is 1."""
    code = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    moved = let(F.regexp_replace(m, r"\s", ""), lambda t: F.concat(F.substr(t, F.lit(5)), F.substring(t, 1, 4)))
    return F.aggregate(F.split(moved, "(?!^)"), F.lit(0), lambda a, c: F.when(code(c) > 9, a * 100 + code(c)).otherwise(a * 10 + code(c)) % 97)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: start, end, the match, what stands before and after.  Places follow
    from the lengths of the pieces between."""
    empty = F.expr(f"cast(array() as {MATCHES})")

    def placed(v: Column) -> Column:
        m, p = v["m"], v["p"]
        widths = F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda a, b: F.char_length(a) + F.char_length(b))
        item = lambda ends: F.transform(m, lambda x, i: F.struct(
            (F.get(ends, i) - F.char_length(x)).alias("s"), F.get(ends, i).alias("e"), x.alias("m"),
            F.substring(F.get(p, i), -AROUND, AROUND).alias("before"), F.substring(F.get(p, i + 1), 1, 2).alias("after")))
        return F.when(F.size(m) > 0, let(scan(widths, lambda a, b: a + b, F.lit(0)), item)).otherwise(empty)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), placed)


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(only_digits(m))
    if kind == "card":
        return n.between(13, 19) & luhn(only_digits(m))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _when_has(text: Column, needles: tuple[str, ...], found: Column) -> Column:
    """found only where the text holds one of the needles, or a digit if there is none: most texts skip the search."""
    has = reduce(lambda a, b: a | b, [F.instr(text, n) > 0 for n in needles]) if needles else text.rlike("[0-9]")
    return F.when(has, found).otherwise(F.expr(f"cast(array() as {MATCHES})"))


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda x: valid(kind, x["m"]))
    return _when_has(text, NEEDS.get(kind, ()), found)


def _features(number: int, kind: str, x: Column) -> Column:
    m, before = x["m"], F.lower(x["before"])
    digits = only_digits(m)
    real = lambda c: c.cast("double")
    values = (
        real(F.lit(number)), real(F.length(digits)), real(F.char_length(m)),
        real(F.when(F.length(digits).between(2, 30), luhn(digits)).otherwise(False)),
        real(F.when(F.length(digits) > 0, F.substring(digits, 1, 1).cast("int")).otherwise(-1)),
        real(F.when(F.length(digits) > 2, F.substring(digits, 1, 3).cast("int")).otherwise(-1)),
        real(F.when(m.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{8,36}$"), remainder97(m) == 1).otherwise(False)),
        real(before.rlike(CONTEXT[kind])), real(before.rlike(OTHER)),
        real(x["before"].rlike(r"[A-Za-z0-9_@#$/.-]$")), real(x["after"].rlike(r"^[A-Za-z0-9_@/]|^[.-][0-9A-Za-z]")),
        real(F.instr(m, "(") > 0), real(F.char_length(F.regexp_replace(m, r"[A-Za-z0-9]", ""))),
        real(F.char_length(F.regexp_replace(m, r"[^A-Z]", ""))), real(F.size(F.array_distinct(F.split(F.substring(m, 1, 60), "(?!^)")))),
        real(F.lower(m).rlike(r"(?:com|org|net|edu|gov|info|de|fr|es|uk|io)$")),
    )
    return F.struct(*[v.alias(n) for v, n in zip(values, FEATURES)])


def candidates(text: Column, number: int) -> Column:
    """One generator's candidates: number of the kind, start, end, features."""
    kind, pattern, needle = GENERATORS[number]
    k = F.lit(ALL_KINDS.index(kind)).alias("k")
    return F.transform(_when_has(text, needle, matches(text, pattern)), lambda x: F.struct(k, x["s"].alias("s"), x["e"].alias("e"), _features(number, kind, x).alias("f")))


# ---- training: boosting, thresholds -----------------------------------------------------------------------------------


def grow_tree(codes: np.ndarray, cuts: list[np.ndarray], at: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int = 10):
    """A regression tree as (feature, cut, left, right) or a leaf value, by the gain in second-order loss over binned values."""
    value = float(-gradient[at].sum() / (hessian[at].sum() + 1.0))
    if depth == 0 or len(at) < 2 * least:
        return value
    best, parent = (1e-6, -1, -1), gradient[at].sum() ** 2 / (hessian[at].sum() + 1.0)
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        held = codes[at, j]
        g, h, n = (np.bincount(held, weights=w, minlength=len(edges) + 1).cumsum() for w in (gradient[at], hessian[at], np.ones(len(at))))
        left, right = (g[:-1] ** 2 / (h[:-1] + 1.0)), ((g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1.0))
        gain = np.where((n[:-1] >= least) & (n[-1] - n[:-1] >= least), left + right - parent, -1.0)
        if gain.max() > best[0]:
            best = (float(gain.max()), j, int(gain.argmax()))
    if best[1] < 0:
        return value
    low = codes[at, best[1]] <= best[2]
    return best[1], float(cuts[best[1]][best[2]]), *[grow_tree(codes, cuts, at[side], gradient, hessian, depth - 1, least) for side in (low, ~low)]


def run_tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, left, right = tree
    return np.where(x[:, j] <= cut, run_tree(left, x), run_tree(right, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list:
    levels = [np.unique(c) if len(np.unique(c)) <= BINS else np.unique(np.quantile(c, np.linspace(0, 1, BINS))) for c in x.T]
    cuts = [(v[:-1] + v[1:]) / 2 for v in levels]
    codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1)
    score, grown = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grown.append(grow_tree(codes, cuts, np.arange(len(x)), p - y, p * (1 - p), depth))
        score += rate * run_tree(grown[-1], x)
    return grown


class Model:
    """Trees over FEATURES and, for each kind, the lowest score to add a candidate (None: add none)."""

    def __init__(self, trees: list, thresholds: dict[str, float | None]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, f: Column) -> Column:
        def case(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(RATE * tree)
            return F.when(f[FEATURES[tree[0]]] <= tree[1], case(tree[2])).otherwise(case(tree[3]))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + case(tree)
        return total

    def selects(self, c: Column) -> Column:
        limits = [F.lit(float("inf") if self.thresholds[k] is None else self.thresholds[k]) for k in ALL_KINDS]
        return self.score(c["f"]) >= F.get(F.array(*limits), c["k"])


_FITTED: dict[tuple[int, int], Model] = {}  # plain numbers, the same in every process


def fit(spark: SparkSession, n: int = ROWS, seed: int = SEED) -> Model:
    if (n, seed) in _FITTED:
        return _FITTED[n, seed]
    made = F.from_json(F.lit(json.dumps(snippets(n, seed))), "array<struct<kind:string,label:int,text:string>>")
    rows = spark.range(1).select(F.explode(made).alias("r")).select("r.*")
    proposed = F.concat(*[F.transform(candidates(F.col("text"), i), lambda c: c["f"]) for i in range(len(GENERATORS))])
    kind_of = [g[0] for g in GENERATORS]
    got = rows.select("kind", "label", F.explode(proposed).alias("f")).select("kind", "label", "f.*").collect()  # at most a few per snippet
    got = [r for r in got if kind_of[int(r["generator"])] == r["kind"]]
    x, y = np.array([[r[f] for f in FEATURES] for r in got]), np.array([float(r["label"]) for r in got])
    kinds, half = np.array([r["kind"] for r in got]), np.random.default_rng(seed).random(len(got)) < 0.5
    trees = boost(x[half], y[half])
    score = sum(RATE * run_tree(t, x) for t in trees)
    thresholds: dict[str, float | None] = {}
    for kind in ALL_KINDS:
        m = ~half & (kinds == kind)
        order = np.argsort(-score[m], kind="stable")
        s, right = score[m][order], np.cumsum(y[m][order]) / np.arange(1, m.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = float(s[good[-1]]) if len(good) else None
    _FITTED[n, seed] = Model(trees, thresholds)
    return _FITTED[n, seed]


# ---- the operator ------------------------------------------------------------------------------------------------------


def _ordered(k: int, spans: Column) -> Column:
    """Base spans of one kind as (start, minus end, kind, added)."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("d"), F.lit(k).alias("k"), F.lit(0).alias("added")))


def _added(base: Column, chosen: Column) -> Column:
    """The chosen spans that no base span reaches into and no earlier chosen one.  In the order of starts, the greatest base end
    so far and the least base start from here on tell what overlaps, so that the work grows with the number of spans."""
    from_left = lambda u: scan(F.transform(u, lambda x: F.when(x["added"] == 0, -x["d"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
    from_right = lambda u: F.reverse(scan(F.transform(F.reverse(u), lambda x: F.when(x["added"] == 0, x["s"]).otherwise(FAR)), lambda a, b: F.least(a, b), F.lit(FAR)))
    apart = lambda v: F.filter(v["u"], lambda x, i: (x["added"] == 1) & (F.get(v["left"], i) <= x["s"]) & (F.get(v["right"], i) >= -x["d"]))
    free = let(F.sort_array(F.concat(base, chosen)), lambda u: let(F.struct(u.alias("u"), from_left(u).alias("left"), from_right(u).alias("right")), apart))
    ends = lambda s: scan(F.transform(s, lambda x: -x["d"]), lambda a, b: F.greatest(a, b), F.lit(0))
    return let(free, lambda s: let(ends(s), lambda e: F.filter(s, lambda x, i: (i == 0) | (F.get(e, i - 1) <= x["s"]))))


def spans_of(text: Column, model: Model) -> Column:
    """All spans of a text as (s, d = minus end, k, added), base ones first."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*[_ordered(i, base_spans(text, k)) for i, k in enumerate(KINDS)])
    proposed = F.concat(*[candidates(text, i) for i in range(len(GENERATORS))])
    chosen = F.transform(F.filter(proposed, model.selects), lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("d"), c["k"].alias("k"), F.lit(1).alias("added")))
    both = F.struct(base.cast(SPANS).alias("b"), chosen.cast(SPANS).alias("c"))
    return let(both, lambda v: F.when(F.size(v["c"]) > 0, F.concat(v["b"], _added(v["b"], v["c"]))).otherwise(v["b"]))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans by kind as listed, then start, joined by commas."""
    names = F.array(*map(F.lit, ALL_KINDS))
    keyed = F.sort_array(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), (-x["d"]).alias("e"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def report(df: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, spans (base and added), n_spans."""
    model = model or fit(df.sparkSession)
    found = pick(df, doc_id="long", text="string").select("doc_id", spans_of(F.col("text"), model).alias("found"))
    base = F.filter("found", lambda x: x["added"] == 0)
    count = lambda i: F.size(F.filter("found", lambda x: (x["added"] == 0) & (x["k"] == i))).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def redact(df: DataFrame, model: Model | None = None) -> DataFrame:
    """df with each span of the text replaced by its kind in brackets, overlapping spans by the first one's; n_chars,
    if there, is counted anew.  All columns are kept, whatever their names."""
    model, names, held = model or fit(df.sparkSession), df.columns, unlike(df, "found")
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    found = df.withColumn(held, F.sort_array(F.transform(spans_of(F.col("text"), model), lambda x: F.struct(x["s"].alias("s"), (-x["d"]).alias("e"), x["k"].alias("k")))))

    def rebuilt(v: Column) -> Column:
        spans, text = v["spans"], v["text"]

        def joined(ends: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            part = lambda x, i: F.when(x["s"] >= before(i), F.concat(F.substr(text, before(i) + 1, x["s"] - before(i)), F.get(label, x["k"]))).otherwise("")
            return F.concat(F.array_join(F.transform(spans, part), ""), F.substr(text, F.element_at(ends, -1) + 1))

        return let(scan(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b), F.lit(0)), joined)

    text = F.when(F.size(held) > 0, let(F.struct(F.col(held).alias("spans"), F.col("text").alias("text")), rebuilt)).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(dict(df.dtypes)["n_chars"]), F.col("n_chars")))
    return out.select(*names)
