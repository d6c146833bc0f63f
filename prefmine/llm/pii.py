"""Personal data by boosted candidates: generators propose, trees score, calibrated thresholds select.

- Base spans: e-mail, IPv4, card and phone matches that pass their checks. They are always kept.
- Candidates: patterns of high recall propose spans that may overlap each other and base spans.
- Score: gradient-boosted trees over features of a candidate's format (length, digits, letters, checks)
  and of its context (what stands left and right). They learn from silver labels: strict rules of format
  and context that read more than the features do. All candidates of all distinct texts are learned from, half for the trees, half
  for the thresholds; those of equal features and label are one row with their number as weight. (Spark's trees take the cut
  points they try from a draw of their own over these rows.)
- Thresholds: per format (pattern), the lowest score from which on at least ``precision`` of the second half's
  candidates are right; a format without such a score selects nothing. A format with fewer than ``evidence`` candidates in
  that half can't be calibrated: its candidates are selected by the strict rule itself, whatever the corpus holds.
- A selected candidate is dropped if it overlaps a base span of its kind, lies within another base span, or overlaps a
  candidate with a better score (then longer, then earlier).

Everything but the learning is an expression over one row: no shuffle, no Python. Texts without a digit or ``@`` are not
searched, they cannot hold a span. Null texts count as empty and give no spans. Repeated rows give equal
results. If there is nothing to learn from (no candidates, or silver labels of one kind), the strict rules select.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.llm.tables import prefix_sums, written

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")

# Possessive forms and the look-behind with \G keep long runs linear; they match what the plain patterns match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
KEYED = r"(?i)(?<![a-z])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
CANDIDATES = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?@\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}"),
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", KEYED + r"[A-Za-z0-9+/_.-]{8,}+"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])"),
)
FEATURES = ("kind", "chars", "digits", "letters", "upper", "marks", "distinct", "is_hex", "luhn", "octets", "check97", "plus", "at", "left_word", "right_word", "left_assign", "left_key", "left_digit", "right_digit")
RUN = 256  # selected candidates that are searched together for overlaps
FIELDS = ("kind", "format", "start", "stop", "value", "left", "right")


def with_matches(df: DataFrame, text: str, pattern: str, out: str, only: Column) -> DataFrame:
    """Appends the matches of a pattern as an array of (value, start, stop), in code points."""
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "__found": F.when(only, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        "__gaps": F.when(only, F.split(text, pattern, -1)).otherwise(none),
    })
    width = F.zip_with(F.slice("__gaps", F.lit(1), F.size("__found")), "__found", lambda g, f: F.length(g) + F.length(f))
    df = df.withColumn("__stops", F.when(F.size("__found") == 0, F.array().cast("array<int>")).otherwise(prefix_sums(width)))
    made = F.zip_with("__found", "__stops", lambda f, s: F.struct(f.alias("value"), (s - F.length(f)).alias("start"), s.alias("stop")))
    return df.withColumn(out, made).drop("__found", "__gaps", "__stops")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.split(_digits(value), ""))
    doubled = F.transform(digits, lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _check97(value: Column) -> Column:
    """The check digits of an IBAN hold."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int")
    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,}$"), F.aggregate(F.split(turned, ""), F.lit(0), step) == 1).otherwise(False)


def _holds(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return n.between(13, 19) & _luhn(value)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _base_of(kind: str) -> Column:
    place = F.lit(KINDS.index(kind)).alias("kind")
    good = F.filter(f"__{kind}", lambda m: _holds(kind, m["value"]))
    return F.transform(good, lambda m: F.struct(place, m["start"].alias("start"), m["stop"].alias("stop")))


def with_base_spans(df: DataFrame, text: str, out: str = "__base") -> DataFrame:
    """Appends the base spans as an array of (kind, start, stop), by kind as listed, then start."""
    only = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    digit = F.col(text).rlike("[0-9]")
    for kind, pattern in BASE.items():
        df = with_matches(df, text, pattern, f"__{kind}", only.get(kind, digit))
    parts = [_base_of(kind) for kind in BASE]
    return df.withColumn(out, F.concat(*parts)).drop(*[f"__{k}" for k in BASE])


def _proposed(matches: str, kind: str, place: int, keyed: bool, text: str) -> Column:
    def span(m: Column) -> Column:
        value = F.regexp_replace(m["value"], KEYED, "") if keyed else m["value"]  # the span is the value alone
        start = m["stop"] - F.length(value)
        left = F.substring(F.col(text), F.greatest(start - 23, F.lit(1)), F.least(start, F.lit(24)))
        right = F.substring(F.col(text), m["stop"] + 1, F.lit(8))
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(place).alias("format"), start.alias("start"), m["stop"].alias("stop"), value.alias("value"), left.alias("left"), right.alias("right"))

    return F.transform(matches, span)


def with_candidates(df: DataFrame, text: str, out: str = "__candidates") -> DataFrame:
    """Appends the proposed spans as an array of ``FIELDS``."""
    digit = F.col(text).rlike("[0-9]")
    parts = []
    for i, (kind, pattern) in enumerate(CANDIDATES):
        spelled = F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]"))
        only = digit if kind != "email" else spelled if r"\(at\)" in pattern else F.contains(text, F.lit("@"))
        df = with_matches(df, text, pattern, f"__c{i}", only)
        parts.append(_proposed(f"__c{i}", kind, i, pattern.startswith(KEYED), text))
    return df.withColumn(out, F.concat(*parts)).drop(*[f"__c{i}" for i in range(len(CANDIDATES))])


def features(c: Column) -> dict[str, Column]:
    value, left, right = c["value"], c["left"], c["right"]
    number = lambda x: x.cast("double")
    return {
        "kind": number(c["kind"]), "chars": number(F.length(value)), "digits": number(F.length(_digits(value))),
        "letters": number(F.length(F.regexp_replace(value, "[^A-Za-z]", ""))), "upper": number(F.length(F.regexp_replace(value, "[^A-Z]", ""))),
        "marks": number(F.length(F.regexp_replace(value, "[A-Za-z0-9]", ""))), "distinct": number(F.size(F.array_distinct(F.split(value, "")))),
        "is_hex": number(value.rlike("^[0-9a-fA-F]+$")), "luhn": number(_luhn(value)), "octets": number(value.rlike(OCTETS)), "check97": number(_check97(value)),
        "plus": number(value.startswith("+")), "at": number(F.contains(value, F.lit("@"))), "left_word": number(left.rlike("[A-Za-z0-9]$")),
        "right_word": number(right.rlike("^[A-Za-z0-9]")), "left_assign": number(left.rlike("[=:]\\s*[\"']?$")), "left_key": number(left.rlike(KEYED + "$")),
        "left_digit": number(left.rlike("[0-9][\\x20.-]?$")), "right_digit": number(right.rlike("^[\\x20.-]?[0-9]")),
    }


def silver(c: Column) -> Column:
    """Whether strict rules of format and context call a candidate personal data or a secret."""
    value, left, right = c["value"], c["left"], c["right"]
    n = F.length(_digits(value))
    free = ~left.rlike("[A-Za-z0-9]$") & ~right.rlike("^[A-Za-z0-9]")
    rules = {
        "email": value.rlike(r"^[A-Za-z0-9._%+-]+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)*\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,}"),
        "ip": value.rlike(OCTETS) & free & ~left.rlike("(?i)(version|release|section)\\s*$"),
        "card": n.between(13, 19) & _luhn(value) & free & ~value.rlike("^0+$"),
        "phone": free & (value.startswith("+") & n.between(9, 15) | left.rlike("(?i)(phone|tel|call|fax|mobile)[^0-9]{0,6}$")),
        "ssn": ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|0000$") & free,
        "iban": _check97(value),
        "secret": value.rlike("[0-9]") & (left.rlike(KEYED + "$") | value.rlike("^(?=.*[a-fA-F])(?=.*[0-9])[0-9a-fA-F]{32,}$") & free),
    }
    return reduce(lambda out, k: out.when(c["kind"] == KINDS.index(k), rules[k]), rules, F.when(F.lit(False), False)).otherwise(False)


class Model:
    """Trees as an expression over a candidate's features, and a threshold per format; other formats go by the strict rule."""

    def __init__(self, margin: Callable[[dict[str, Column]], Column] | None, thresholds: dict[int, float]):
        self.margin, self.thresholds = margin, thresholds

    def featured(self, c: Column) -> Column:
        """The candidate with its features and whether the rule holds, each worked out once."""
        rule = F.when(c["format"].isin(*self.thresholds), False).otherwise(silver(c)) if self.thresholds else silver(c)
        known = [F.struct(*[v.alias(n) for n, v in features(c).items()]).alias("features")] if self.thresholds else []
        return F.struct(*[c[n].alias(n) for n in ("start", "stop", "kind", "format")], rule.alias("rule"), *known)

    def score(self, f: Column) -> Column:
        """Score of a candidate from :meth:`featured`; 1 or 0 by the rule."""
        rule = F.when(f["rule"], 1.0).otherwise(0.0)
        if not self.thresholds:
            return rule
        return F.when(f["format"].isin(*self.thresholds), self.boosted({n: f["features"][n] for n in FEATURES})).otherwise(rule)

    def boosted(self, f: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin(f)))

    def selects(self, place: Column, score: Column) -> Column:
        rule = F.when(F.lit(False), False)
        for k, least in self.thresholds.items():
            rule = rule.when(place == k, score >= least)
        return rule.otherwise(score >= 1.0)


def _tree(node, names: tuple[str, ...]) -> Callable[[dict[str, Column]], Column]:
    if node.subtreeDepth() == 0:
        value = float(node.prediction())
        return lambda f: F.lit(value)
    name, cut = names[node.split().featureIndex()], float(node.split().threshold())
    left, right = _tree(node.leftChild(), names), _tree(node.rightChild(), names)
    return lambda f: F.when(f[name] <= cut, left(f)).otherwise(right(f))


def learn(df: DataFrame, text: str = "text", precision: float = 0.97, evidence: int = 40, trees: int = 12, depth: int = 4) -> Model:
    """Fits trees and thresholds on all candidates of ``df``."""
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("__text")).filter(F.col("__text").rlike("[0-9@]|at[)\\]]"))
    # outer, as Spark would else search every text once more to see whether it has candidates
    found = with_candidates(texts, "__text").select(F.xxhash64("__text").alias("of"), F.explode_outer("__candidates").alias("c")).filter("c IS NOT NULL")
    order = F.xxhash64(F.concat_ws("|", "c.value", F.col("c.start").cast("string"), "c.left"))
    label, fits = silver(F.col("c")).cast("double").alias("label"), (F.pmod(order, F.lit(2)) == 0).alias("fits")
    known = [v.alias(f"f_{k}") for k, v in features(F.col("c")).items()]
    each = found.select("of", "c.format", "c.start", "c.stop", label, fits, *known).dropDuplicates(["of", "format", "start", "stop"])
    alike = each.groupBy("format", "label", "fits", *[f"f_{k}" for k in FEATURES]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = written(alike, "candidates")
    fits = rows.filter("fits")
    if len(fits.select("label").distinct().collect()) < 2:
        return Model(None, {})
    names = tuple(FEATURES)
    assembled = VectorAssembler(inputCols=[f"f_{n}" for n in names], outputCol="features").transform(fits).select("label", "features", "n")
    fitted = GBTClassifier(weightCol="n", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False).fit(assembled)
    parts = [(float(w), _tree(t._call_java("rootNode"), names)) for w, t in zip(fitted.treeWeights, fitted.trees)]
    model = Model(lambda f: reduce(lambda a, b: a + b, [tree(f) * w for w, tree in parts]), {})
    level = F.floor(model.boosted({n: F.col(f"f_{n}") for n in names}) * 200).alias("level")
    counts = rows.filter("NOT fits").select("format", "n", (F.col("label") * F.col("n")).alias("right"), level).groupBy("format", "level")
    counts = counts.agg(F.sum("right").alias("right"), F.sum("n").alias("n")).collect()  # at most 11 x 201 rows
    for place in {r["format"] for r in counts}:
        own = sorted((r for r in counts if r["format"] == place), key=lambda r: -r["level"])
        if sum(r["n"] for r in own) >= evidence:
            model.thresholds[place] = 2.0  # beyond any score
            right = total = 0.0
            for r in own:
                right, total = right + r["right"], total + r["n"]
                if right >= precision * total:
                    model.thresholds[place] = r["level"] / 200
    return model


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def with_spans(df: DataFrame, model: Model, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """Appends the base spans and all spans, arrays of (kind, start, stop) by kind, then start."""
    df = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    df = with_candidates(with_base_spans(df, "__text"), "__text")
    within = lambda a, b: (a["start"] >= b["start"]) & (a["stop"] <= b["stop"])
    new = F.filter("__candidates", lambda c: ~F.exists("__base", lambda b: _overlap(b, c) & (b["kind"] == c["kind"]) | within(c, b)))
    scored = lambda f: F.struct(*[f[n].alias(n) for n in ("start", "stop", "kind", "format")], model.score(f).alias("score"))
    df = df.withColumn("__scored", F.array_sort(F.transform(F.transform(new, model.featured), scored)))
    df = df.withColumn("__chosen", F.filter("__scored", lambda c: model.selects(c["format"], c["score"])))

    def rank(c: Column) -> Column:
        return F.struct(c["score"], c["stop"] - c["start"], -c["start"], -c["kind"])

    # in runs with their extent, so that only the runs that a candidate reaches into are searched, however long candidates are
    firsts = F.sequence(F.lit(0), F.greatest(F.size("__chosen") - 1, F.lit(0)), F.lit(RUN))
    runs = F.transform(F.transform(firsts, lambda i: F.slice("__chosen", i + 1, F.lit(RUN))), lambda r: F.struct(
        F.array_min(r["start"]).alias("start"), F.array_max(r["stop"]).alias("stop"), r.alias("rows")
    ))
    df = df.withColumn("__runs", runs)
    better = lambda c, r: F.exists(r["rows"], lambda d: _overlap(c, d) & (rank(d) > rank(c)))
    best = F.filter("__chosen", lambda c: ~F.exists("__runs", lambda r: _overlap(c, r) & better(c, r)))
    plain = F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    all_spans = F.array_distinct(F.array_sort(F.concat("__base", plain)))
    return df.withColumns({base: F.col("__base"), spans: all_spans}).drop("__text", "__base", "__candidates", "__scored", "__chosen", "__runs")


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or group of spans that overlap, put as ``[KIND]`` of the first in order."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.struct(F.concat(acc["out"], gap, F.get(names, s["kind"])).alias("out"), s["stop"].alias("at"))
        longer = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))
        return F.when(s["start"] < acc["at"], longer).otherwise(more)

    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, begin, step, done))
