"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select redactions.

DataFrame functions only. Every generator is one regular expression; the pieces between its matches (split) and the matches
(regexp_extract_all) give places in code points. The four base generators are kept wherever their check passes (octets up
to 255, Luhn and 13 to 19 digits, 9 to 15 digits), and a long string of letters and digits that is assigned to a word such as token is
a secret. The others propose overlapping spans that these miss: numbers without `+`, spaced or slashed card numbers, addresses
with `[at]`, spaced octets, secrets that stand alone.

Trees learn what a known span looks like without what makes it known. Features are of the canonical form (`+`, `[at]`, spaces and
the kind of separator are taken away) and of the characters beside it; whether a check passes is none of them. Labels: a proposal is right if it is a base span
that passes, or lies over one of its own kind; it is wrong if it fails its check, or lies over a base span of another kind; else it has none. As known
spans seldom have wrong neighbours of the same form, every cell of right ones also gives background: the same features but for one, with each
of its other values, BACKGROUND of the weight in all. A form or a context that no known span has is thus held against a proposal. Proposals are
counted by feature values first, so the driver fits a table of bounded size (2.5 million cells; some hundreds in practice) whatever the corpus. Platt
scaling on a fifth of the documents makes scores probabilities, and a kind's threshold is the least at which PRECISION holds there. A
proposal must also pass its kind's check. Of spans that overlap, base spans win, then the one that starts first, then the longer.

Nulls: a null text counts as empty, a null doc_id stays null. Rows that repeat a doc_id stay apart. Ties of equal spans go to the generator listed
first. Very long texts are matched whole, in time linear in their length. Empty tables give empty ones; without a right and a wrong
proposal nothing is added to the known spans. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

#: Kinds of base spans, and those that only the method has.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
#: name, kind, base?, a cheap test that a text must pass, pattern. Possessive repeats and look-behinds keep a match linear
#: in the text; they find what the plain patterns would find, leftmost and without overlap.
GENERATORS = (
    ("email", "email", True, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # whole runs of digits with single separators; only runs of 12 to 20 digits are looked at, of which 12 and 20 fail
    ("card", "card", True, r"[0-9](?:[ -]?[0-9]){11}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,19}+(?![ -]?[0-9])"),
    ("phone", "phone", True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email_at", "email", False, r"(?i)[\[({]at[\])}]", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?[\[({{](?i:at)[\])}}] ?[A-Za-z0-9-]++(?: ?(?:[\[({{](?i:dot)[\])}}]|\.) ?[A-Za-z0-9-]++)++"),
    ("email_host", "email", False, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-])"),
    ("ip_spaced", "ip", False, r"[0-9] \. ?[0-9]|[0-9]\. [0-9]", r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?! ?\.? ?[0-9])"),
    ("card_split", "card", False, r"[0-9]{4}[ ./-]{1,2}[0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[ ./-]{1,2}[0-9]{4}){3}(?![0-9])"),
    ("card_block", "card", False, r"[0-9]{13}", r"(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    ("phone_bare", "phone", False, r"[0-9]{3}[ .-][0-9]{3}", r"(?<![0-9+])(?:(?:\+|00)[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])(?![ .-][0-9]{4}(?![0-9]))"),
    ("phone_local", "phone", False, r"[0-9]{3}[ .-][0-9]{3}", r"(?<![0-9])(?<![0-9][.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])(?![ .-][0-9]{4}(?![0-9]))"),
    ("secret_set", "secret", False, r"[A-Za-z0-9_-]{20}", r"(?i)(?<=(?:token|key|secret|passw|pwd)[a-z]{0,8}[\"']? ?[:=] ?[\"']?)(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"),
    ("secret", "secret", False, r"[A-Za-z0-9_-]{20}", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}+"),
)
NAMES = tuple(g[0] for g in GENERATORS)
#: Words before a span that speak for its kind.
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|pay|iban|karte|tarjeta|carte", "phone": r"tel|phone|call|fax|mobil|whats", "secret": "(?!)"}
LEFT, RIGHT = 32, 4
ROUNDS, DEPTH, RATE, RIDGE, PRECISION, BACKGROUND = 30, 4, 0.3, 1.0, 0.95, 0.5
#: Features and the number of their values (0, 1, ...).
SIZES = {"kind": len(KINDS), "digits": 21, "groups": 7, "first": 6, "last": 6, "paren": 2, "left_word": 2, "right_word": 2, "context": 2, "code_like": 2}
FEATURES = tuple(SIZES)
#: Features of which another value than those of known spans speaks against a proposal; of context only its absence does.
TELLING = ("digits", "groups", "first", "last", "left_word", "right_word", "code_like", "context")


def _found(pattern: str, test: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    has = text.contains(test) if test == "@" else text.rlike(test)
    none = F.array().cast("array<string>")
    return F.when(has, F.split(text, pattern, -1)).otherwise(none), F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn check digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _proposal(k: int):
    return lambda x: F.struct(
        F.lit(k).alias("gen"), F.length(x["before"]).alias("gap"), x["match"].alias("match"), F.right(x["before"], F.lit(LEFT)).alias("left"), F.left(x["after"], F.lit(RIGHT)).alias("right"))


def candidates(numbered: DataFrame) -> DataFrame:
    """Of numbered (row, doc_id, text): row, doc_id and, for each proposed span (one row of nulls if there is none): gen, start, end, match, left, right.

    The places of a text's matches are running sums, made by a window over that text's matches alone.
    """
    df = numbered.select("row", "doc_id", "text")
    for name, _, _, test, pattern in GENERATORS:
        pieces, matches = _found(pattern, test)
        df = df.withColumn(f"p_{name}", pieces).withColumn(f"m_{name}", matches)
    each = []
    for k, (name, *_) in enumerate(GENERATORS):
        p, m = F.col(f"p_{name}"), F.col(f"m_{name}")
        both = F.arrays_zip(F.slice(p, 1, F.size(m)).alias("before"), m.alias("match"), F.when(F.size(m) > 0, F.slice(p, 2, F.size(m))).otherwise(p).alias("after"))
        each.append(F.transform(F.when(F.size(m) > 0, both).otherwise(F.slice(both, 1, 0)), _proposal(k)))
    spans = df.select("row", "doc_id", F.posexplode_outer(F.concat(*each)).alias("at", "x")).select("row", "doc_id", "at", "x.*")
    so_far = Window.partitionBy("row", "gen").orderBy("at")
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far))
    return spans.withColumn("start", F.col("end") - F.length("match")).drop("at", "gap")


def canonical(kind: Column) -> Column:
    """The match in groups of letters and digits, without the marks that only some forms have."""
    dotted = F.regexp_replace(F.regexp_replace("match", r"(?i) ?[\[({]at[\])}] ?", "@"), r"(?i) ?[\[({]dot[\])}] ?| ?\. ?", ".")
    number = F.regexp_replace(F.regexp_replace("match", r"^(?:\+|00(?=[1-9]))", ""), "[^0-9]+", "-")
    return F.btrim(F.when(kind == 0, dotted).when(kind == 1, F.regexp_replace("match", " ", "")).when(kind == 4, F.col("match")).otherwise(number), F.lit("-"))


def described(spans: DataFrame) -> DataFrame:
    """spans with kind (place in KINDS), base, checks (whether the kind's check passes) and the FEATURES."""
    gens = F.col("gen")
    kind = F.element_at(F.array(*(F.lit(KINDS.index(g[1])) for g in GENERATORS)), gens + 1)
    base = F.element_at(F.array(*(F.lit(g[2]) for g in GENERATORS)), gens + 1)
    digits = _digits(F.col("match"))
    n = F.length(digits)
    octets = F.forall(F.split(F.regexp_replace("match", " ", ""), r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), F.ltrim(x, F.lit("0"))), -3, 3) <= "255"))
    right_count = F.when(kind == 2, (n >= 13) & (n <= 19)).when(kind == 3, (n >= 9) & (n <= 15)).otherwise(True)
    mixed = F.col("match").rlike("[A-Za-z]") & F.col("match").rlike("[0-9].*[0-9].*[0-9]")
    checks = F.when(kind == 1, octets).when(kind == 2, right_count & luhn(digits)).when(kind == 3, right_count).when(kind == 4, mixed).otherwise(F.col("match").rlike(r"@[A-Za-z0-9-]+\.|(?i)[\[({]at[\])}]"))
    context = F.lit(False)
    for k, name in enumerate(KINDS):
        context = F.when(kind == k, F.lower("left").rlike(CONTEXT[name])).otherwise(context)
    left = F.regexp_replace("left", r"\+$", "")  # as if the mark were not there
    groups = F.split(canonical(kind), r"[^\p{L}\p{N}]+")
    at_most = lambda c, name: F.least(c, F.lit(SIZES[name] - 1))
    feature = {
        "digits": at_most(n, "digits"),
        "groups": at_most(F.size(groups), "groups"),
        "first": at_most(F.length(F.element_at(groups, 1)), "first"),
        "last": at_most(F.length(F.element_at(groups, -1)), "last"),
        "paren": F.col("match").contains("(").cast("int"),
        "left_word": left.rlike(r"[\p{L}\p{N}_]$").cast("int"),
        "right_word": F.col("right").rlike(r"^[\p{L}\p{N}_]").cast("int"),
        "context": context.cast("int"),
        # what stands before a secret is what makes it known, and no feature of it
        "code_like": F.when(kind == 4, 0).otherwise(F.lower(left).rlike(r"(?:token|key|hash|version|id|sku|isbn|=|#)[ \"':]*$").cast("int")),
    }
    out = spans.withColumn("kind", kind).withColumn("base", base)
    return out.select("*", F.coalesce(checks, F.lit(False)).alias("checks"), *(F.coalesce(c, F.lit(0)).alias(k) for k, c in feature.items()))


def labelled(spans: DataFrame) -> DataFrame:
    """spans with known (base or assigned, and its check passes) and right (null: nothing tells)."""
    known = (F.col("base") | (F.col("gen") == NAMES.index("secret_set"))) & F.col("checks")
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    over = []
    for k in range(len(KINDS)):
        own = F.col("known") & (F.col("kind") == k)
        over.append((F.max(F.when(own, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(own, F.col("start"))).over(after) < F.col("end")))
    over = F.array(*(F.coalesce(c, F.lit(False)) for c in over))
    met = spans.withColumn("known", F.coalesce(known, F.lit(False))).withColumn("over", F.when(F.col("gen").isNotNull(), over))
    same = F.element_at("over", F.col("kind") + 1)
    right = F.when(F.col("known"), True).when(F.col("base") | ~F.col("checks"), False).when(same, True).when(F.exists("over", lambda x: x), False)
    return met.withColumn("right", F.when(F.col("gen").isNotNull(), right)).drop("over")


@dataclass
class Trees:
    """Boosted trees as nested tuples (feature, bound, below, above) or leaf values; start, Platt scaling and thresholds by kind."""

    start: float
    trees: list
    scale: float
    shift: float
    thresholds: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The same as column() for rows of FEATURES."""
        score = np.full(len(x), self.start) + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-(self.scale * score + self.shift)))

    def column(self) -> Column:
        def expr(node) -> str:
            if not isinstance(node, tuple):
                return f"{node!r}D"
            return f"(CASE WHEN {node[0]} <= {node[1]} THEN {expr(node[2])} ELSE {expr(node[3])} END)"

        score = " + ".join([f"{self.start!r}D", *map(expr, self.trees)])
        return F.expr(f"1D / (1D + exp(-({self.scale!r}D * ({score}) + {self.shift!r}D)))")


def _grow(x, g, h, rows, depth):
    """The least loss of second order over all splits of the rows (cells)."""
    leaf = float(-RATE * g[rows].sum() / (h[rows].sum() + RIDGE))
    best = None
    if depth:
        whole = g[rows].sum() ** 2 / (h[rows].sum() + RIDGE)
        for f in range(x.shape[1]):
            for bound in np.unique(x[rows, f])[:-1]:
                low, high = rows[x[rows, f] <= bound], rows[x[rows, f] > bound]
                gain = g[low].sum() ** 2 / (h[low].sum() + RIDGE) + g[high].sum() ** 2 / (h[high].sum() + RIDGE) - whole
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = gain, f, int(bound), low, high
    if best is None:
        return leaf
    _, f, bound, low, high = best
    return FEATURES[f], bound, _grow(x, g, h, low, depth - 1), _grow(x, g, h, high, depth - 1)


def _values(node, x):
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    return np.where(x[:, FEATURES.index(node[0])] <= node[1], _values(node[2], x), _values(node[3], x))


def background(cells: list[dict]) -> list[dict]:
    """Wrong cells beside the right ones: one telling feature has another value, and no right one is there. They weigh BACKGROUND of the right ones."""
    out: dict[tuple, float] = {}
    seen = {tuple(c[f] for f in FEATURES) for c in cells if c["good"]}
    for c in cells:
        if not c["good"]:
            continue
        near = [{**c, f: v} for f in TELLING for v in range(SIZES[f]) if v != c[f] and not (f == "context" and v)]
        near = [x for x in near if tuple(x[f] for f in FEATURES) not in seen]
        for x in near:
            key = (*(x[f] for f in FEATURES), x["held"])
            out[key] = out.get(key, 0.0) + BACKGROUND * c["good"] / len(near)
    return [dict(zip((*FEATURES, "held"), key)) | {"good": 0.0, "bad": n} for key, n in sorted(out.items())]


def fit(cells: list) -> Trees:
    """Boost on cells: FEATURES, held (in the calibration part), good, bad (right and wrong proposals)."""
    never = (2.0,) * len(KINDS)
    cells = [c if isinstance(c, dict) else c.asDict() for c in cells]
    cells = cells + background(cells)
    x = np.array([[c[f] for f in FEATURES] for c in cells], np.int64).reshape(-1, len(FEATURES))
    held, good, bad = (np.array([c[k] for c in cells], np.float64) for k in ("held", "good", "bad"))
    own = np.flatnonzero(held == 0)
    if not len(own) or not good[own].sum() or not bad[own].sum():
        return Trees(0.0, [], 1.0, 0.0, never)
    start = math.log(good[own].sum() / bad[own].sum())
    score, trees = np.full(len(x), start), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = (good + bad) * p - good, (good + bad) * p * (1 - p)
        tree = _grow(x, g, h, own, DEPTH)
        trees.append(tree)
        score += _values(tree, x)
    cal = np.flatnonzero(held == 1)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt scaling, kept near the identity by a ridge
        p = 1 / (1 + np.exp(-(a * score[cal] + b)))
        r, w = (good + bad)[cal] * p - good[cal], (good + bad)[cal] * p * (1 - p)
        s = score[cal]
        grad = np.array([(r * s).sum() + (a - 1), r.sum() + b])
        hess = np.array([[(w * s * s).sum() + 1, (w * s).sum()], [(w * s).sum(), w.sum() + 1]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-(a * score + b)))
    thresholds = []
    for k in range(len(KINDS)):
        rows = cal[x[cal, 0] == k]
        rows = rows[np.argsort(-p[rows])]
        right, all_ = np.cumsum(good[rows]), np.cumsum((good + bad)[rows])
        enough = np.flatnonzero((right >= PRECISION * all_) & (right > 0))
        thresholds.append(max(0.5, float(p[rows[enough[-1]]])) if len(enough) else 2.0)
    return Trees(float(start), trees, float(a), float(b), tuple(thresholds))


def detect(docs: DataFrame) -> DataFrame:
    """row, doc_id and the selected spans: kind, start, end, base, score; one row of nulls for a text without any."""
    return _detect(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))


def _detect(numbered: DataFrame) -> DataFrame:
    return select(materialize(labelled(described(candidates(numbered))), "pii-candidates"))


def train(spans: DataFrame) -> Trees:
    """The trees of the labelled proposals."""
    held = (F.pmod(F.xxhash64("row"), F.lit(5)) == 0).cast("int")
    cells = spans.filter("right is not null").groupBy(*FEATURES, held.alias("held")).agg(F.count_if("right").alias("good"), F.count_if(~F.col("right")).alias("bad")).collect()
    return fit(sorted(cells))


def select(spans: DataFrame) -> DataFrame:
    """row, doc_id and the spans that are known or that the trees take; one row of nulls for a text without any."""
    model = train(spans)
    scored = spans.withColumn("score", F.when(F.col("gen").isNotNull(), model.column()))
    enough = F.element_at(F.array(*map(F.lit, model.thresholds)), F.col("kind") + 1)
    some = F.when(F.col("base"), F.col("known")).otherwise(F.col("known") | (F.col("checks") & (F.col("score") >= enough)))
    picked = scored.withColumn("ok", F.coalesce(some, F.lit(False)))
    in_order = Window.partitionBy("row").orderBy("start", F.desc("end"), "gen")
    before, after = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(1, Window.unboundedFollowing)
    is_base, extra = F.col("ok") & F.col("base"), F.col("ok") & ~F.col("base")
    clash = (F.max(F.when(is_base, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(is_base, F.col("start"))).over(after) < F.col("end"))
    picked = picked.withColumn("extra", extra & ~F.coalesce(clash, F.lit(False)))
    clash = F.max(F.when(F.col("extra"), F.col("end"))).over(before) > F.col("start")
    picked = picked.withColumn("ok", is_base | (F.col("extra") & ~F.coalesce(clash, F.lit(False))))
    return picked.select("row", "doc_id", *(F.when(F.col("ok"), F.col(c)).alias(c) for c in ("kind", "start", "end", "base", "score")))


def digest(found: DataFrame) -> DataFrame:
    """One row for each text: doc_id, counts of base spans by kind, base_sha256, spans, n_spans (all of them)."""
    item = F.struct("kind", "start", "end")
    sets = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *(F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sort_array(F.collect_list(F.when(F.col("base"), item))).alias("own"), F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), item))).alias("every"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return sets.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(text("own"), 256).alias("base_sha256"), text("every").alias("spans"), F.size("every").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, text with every selected span replaced by its kind in brackets (an overlap is replaced once)."""
    # numbered once, in a table: a number made again could fall on another row
    texts = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered-documents")
    found = _detect(texts).filter("kind is not null")
    ends = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    texts = texts.join(ends, "row", "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        own = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), own.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return texts.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans over the whole documents table."""
    return digest(detect(documents(spark, sf_dir).select("doc_id", "text")))
