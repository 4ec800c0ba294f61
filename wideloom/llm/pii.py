"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation finds how
reliable each is, and a span classifier trained on its posteriors decides.  DataFrame functions only.

*Base spans* are exact patterns with checks (email, ip, card, phone) and always stay.  *Candidates* are the
base spans and what wider patterns find (addresses with "(at)" and "(dot)", numbers in other notations).
The labelers: ``regex`` (strict shape), ``gazetteer`` (name endings, issuer and dialling prefixes), ``context``
(words just before, in four languages) and ``edge`` (what touches the span).  A vote is yes, no or abstain.
Counts of vote patterns over all documents, a bounded table, are all that reaches the driver: there the
two-class model with one reliability table per labeler and kind is fitted, and a logistic model over votes
and shape is trained on its posteriors.  The classifier is applied as a column expression; a candidate that
is no base span is added at ``ADD`` or more, unless it overlaps a base span.

Offsets count code points, ends are exclusive.  Null and empty texts have no spans.  Every row is treated
by itself, repeated rows alike.  Columns but id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wideloom.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
ADD = 0.9
ROUNDS = 30
CONTEXT_CHARS = 40

# Possessive forms of the base patterns: the same matches, without recursion or rescans of long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WIDE = {
    "at": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?)[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9.+-])\(?[0-9]{2,5}+\)?[\x20./-]{1,2}+[0-9]{2,5}+(?:[\x20./-][0-9]{2,5}+){1,4}+(?![0-9])",
}
GAZETTEER = {
    "email": r"\.(?i:com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|eu|ch|at|be|nl)$",
    "ip": r"^(?!0\.|127\.|255\.)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6)",
    "phone": r"^(?:\+(?:1|3[0-9]|4[0-9])|\(?[2-9][0-9]{2}\)?|0[1-9])",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|courriel|correo|kontakt|contact|write)\W{0,4}(?:\w{1,6}\W{1,3})?$",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|from)\W{0,4}(?:\w{1,6}\W{1,3})?$",
    "card": r"(?i)(?:card|visa|mastercard|carte|karte|tarjeta|credit)\W{0,4}(?:\w{1,6}\W{1,3})?$",
    "phone": r"(?i)(?:phone|tel|tél|call|fax|mobile|handy|m[oó]vil|appelez)\W{0,4}(?:\w{1,6}\W{1,3})?$",
}
AGAINST = r"(?i)(?:isbn|version|section|page|order|invoice|id|no|nr|chapter|figure|fig|table)[.:# ]{0,3}$"
LABELERS = ("regex", "gazetteer", "context", "edge")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(v > 9, v - 9).otherwise(v)
    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        d = digits(m)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def _running(sizes: Column, step: int = 64) -> Column:
    """Sum of the entries before each one, in two levels so that long lists stay cheap."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / step).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = F.transform(blocks, lambda b: total(F.slice(sizes, b * step + 1, F.lit(step))))
    starts = F.transform(blocks, lambda b: F.struct(b.alias("b"), total(F.slice(sums, F.lit(1), b)).alias("s")))
    return F.flatten(F.transform(starts, lambda x: F.transform(
        F.sequence(F.lit(0), F.least(F.lit(step - 1), F.size(sizes) - 1 - x["b"] * step)),
        lambda i: x["s"] + total(F.slice(sizes, x["b"] * step + 1, i)))))


def located(df: DataFrame, patterns: dict[str, str], needs: dict[str, str | None]) -> DataFrame:
    """Add ``s_<name>``: start, end and string of all matches of each pattern in ``text``.

    The texts between the matches give the offsets; rows without a match are not cut.
    """
    def found(name: str) -> Column:
        t, need = F.col("text"), needs.get(name)
        some = t.contains(need) if need else t.rlike(patterns[name])
        return F.when(some, F.regexp_extract_all(t, F.lit(patterns[name]), F.lit(0)))
    df = df.select("*", *[found(n).alias(f"m_{n}") for n in patterns])
    df = df.select("*", *[F.when(F.size(f"m_{n}") > 0, F.zip_with(
        F.slice(F.split("text", patterns[n], -1), F.lit(1), F.size(f"m_{n}")), f"m_{n}",
        lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len")))).alias(f"g_{n}") for n in patterns])
    df = df.select("*", *[F.when(F.col(f"g_{n}").isNotNull(), _running(F.transform(f"g_{n}", lambda x: x["gap"] + x["len"]))).alias(f"r_{n}") for n in patterns])
    out = []
    for n in patterns:
        at = F.zip_with(f"r_{n}", f"g_{n}", lambda r, g: F.struct((r + g["gap"]).alias("start"), (r + g["gap"] + g["len"]).alias("end")))
        spans = F.zip_with(at, f"m_{n}", lambda a, m: F.struct(a["start"].alias("start"), a["end"].alias("end"), m.alias("m")))
        out.append(F.coalesce(F.when(F.col(f"r_{n}").isNotNull(), spans), F.array().cast("array<struct<start:int,end:int,m:string>>")).alias(f"s_{n}"))
    drop = [f"{p}_{n}" for n in patterns for p in "mgr"]
    return df.select("*", *out).drop(*drop)


def base_spans(df: DataFrame) -> DataFrame:
    """Add ``base``: the valid base spans as ``(start, kind, end, m)``, sorted; ``kind`` numbers ``KINDS``."""
    df = located(df, BASE, NEEDS)

    def checked(i: int, k: str) -> Column:
        return F.transform(F.filter(f"s_{k}", lambda s: passes(k, s["m"])),
                           lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["m"].alias("m")))
    valid = [checked(i, k) for i, k in enumerate(KINDS)]
    return df.select("*", F.array_sort(F.concat(*valid)).alias("base")).drop(*[f"s_{k}" for k in KINDS])


def candidates(df: DataFrame) -> DataFrame:
    """Add ``wide``: spans of the wider patterns that overlap no base span, with the kind their shape suggests."""
    df = located(df, WIDE, {})
    n = lambda s: F.length(digits(s["m"]))
    dotted = lambda s: s["m"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    kind = lambda s: F.when(n(s).between(13, 19), F.lit(2)).otherwise(F.lit(3))
    item = lambda s, k: F.struct(s["start"].alias("start"), k.alias("kind"), s["end"].alias("end"), s["m"].alias("m"))
    both = F.concat(F.transform("s_at", lambda s: item(s, F.lit(0))),
                    F.transform(F.filter("s_number", lambda s: n(s).between(7, 19) & ~dotted(s)), lambda s: item(s, kind(s))))
    free = F.filter(both, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return df.select("*", F.array_sort(free).alias("wide")).drop("s_at", "s_number")


def votes(text: Column, span: Column) -> dict[str, Column]:
    """One column per labeler: 1 yes, 0 no, -1 abstain; and the shape features of the classifier."""
    m, kind = span["m"], span["kind"]
    before = F.substring(text, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT_CHARS)))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    by = lambda table, of: F.coalesce(*[F.when(kind == i, of.rlike(table[k])) for i, k in enumerate(KINDS)])
    strict = F.coalesce(*[F.when(kind == i, m.rlike(f"^(?:{BASE[k]})$") & passes(k, m)) for i, k in enumerate(KINDS)])
    yes_no = lambda c: F.when(c, 1).otherwise(0)
    plain = F.when(kind == 2, digits(m)).when(kind == 0, F.regexp_replace(m, r"(?i)\s?[(\[{]dot[)\]}]\s?", ".")).otherwise(m)
    return {
        "regex": yes_no(strict), "gazetteer": yes_no(by(GAZETTEER, plain)),
        "context": F.when(by(CONTEXT, before), 1).when(before.rlike(AGAINST), 0).otherwise(-1),
        "edge": yes_no(~before.rlike(r"[\p{L}\p{N}_/=-]$") & ~after.rlike(r"[\p{L}\p{N}_/=]")),
        "long": yes_no(F.length(m) > 14), "cut": yes_no(m.rlike(r"[\x20()\[\]{}-]")), "luhn": yes_no(F.when(F.length(digits(m)).between(12, 19), luhn(digits(m)))),
    }


def patterns(docs: DataFrame) -> list[dict]:
    """Counts of ``kind``, votes and shape over all candidates of all documents: at most 4 * 2 * 2 * 3 * 2 * 8 rows."""
    rows = candidates(base_spans(texts(docs)))
    spans = rows.select("text", F.explode(F.concat("base", "wide")).alias("span"))
    named = spans.select(F.col("span.kind").alias("kind"), *[c.alias(n) for n, c in votes(F.col("text"), F.col("span")).items()])
    return [r.asDict() for r in named.groupBy(*named.columns).agg(F.count("*").alias("n")).collect()]


def reliabilities(table: list[dict], rounds: int = ROUNDS) -> tuple[list[float], dict]:
    """Expectation-maximisation over the vote patterns: a posterior per pattern, and P(vote | class) per kind and labeler."""
    post = []
    for r in table:
        cast = [r[v] for v in LABELERS if r[v] >= 0]
        post.append(0.1 + 0.8 * sum(cast) / len(cast))
    model: dict = {}
    for _ in range(rounds):
        model = {}
        for kind in {r["kind"] for r in table}:
            own = [(r, p) for r, p in zip(table, post) if r["kind"] == kind]
            weight = [sum(r["n"] * (p if c else 1 - p) for r, p in own) for c in (0, 1)]
            model[kind, "prior"] = [(w + 1) / (sum(weight) + 2) for w in weight]
            for v in LABELERS:
                for c in (0, 1):
                    right = 2.0  # a labeler is taken to be better than chance where nothing speaks against it
                    seen = {x: sum(r["n"] * (p if c else 1 - p) for r, p in own if r[v] == x) + (right if x == c else 1.0) for x in (-1, 0, 1)}
                    model[kind, v, c] = {x: s / sum(seen.values()) for x, s in seen.items()}
        post = []
        for r in table:
            score = [math.log(model[r["kind"], "prior"][c]) + sum(math.log(model[r["kind"], v, c][r[v]]) for v in LABELERS) for c in (0, 1)]
            post.append(1 / (1 + math.exp(max(-700, min(700, score[0] - score[1])))))
    return post, model


def features(r: dict) -> dict[str, float]:
    """Names of the indicator features of a pattern, shared by training and the column expression."""
    out = {f"kind={r['kind']}": 1.0}
    out |= {f"{r['kind']}:{v}={r[v]}": 1.0 for v in (*LABELERS, "long", "cut", "luhn")}
    return out


def train(table: list[dict], steps: int = 400, rate: float = 0.5, l2: float = 1e-3) -> dict[str, float]:
    """Logistic span classifier on the posteriors; patterns weigh by the root of their count."""
    post, _ = reliabilities(table) if table else ([], {})
    rows = [(features(r), p, math.sqrt(r["n"])) for r, p in zip(table, post)]
    total = sum(w for *_, w in rows) or 1.0
    weights: dict[str, float] = {}
    for _ in range(steps):
        slope: dict[str, float] = {k: l2 * v for k, v in weights.items()}
        for f, p, w in rows:
            q = 1 / (1 + math.exp(-max(-30, min(30, sum(weights.get(k, 0.0) for k in f)))))
            for k in f:
                slope[k] = slope.get(k, 0.0) + w / total * (q - p)
        for k, s in slope.items():
            weights[k] = weights.get(k, 0.0) - rate * s
    return weights


def probability(weights: dict[str, float], kind: Column, cast: Column | dict[str, Column]) -> Column:
    """The classifier as a column: looked-up weights, summed, through the logistic function."""
    terms = F.lit(0.0)
    for name, w in sorted(weights.items()):
        if name.startswith("kind="):
            terms = terms + F.when(kind == int(name[5:]), w).otherwise(0.0)
        else:
            head, value = name.split("=")
            k, v = head.split(":")
            terms = terms + F.when((kind == int(k)) & (cast[v] == int(value)), w).otherwise(0.0)
    return 1 / (1 + F.exp(-terms))


def find(docs: DataFrame, add: float = ADD) -> DataFrame:
    """``(doc_id, text, base, spans)`` for every row; two passes over the texts, no shuffle but of pattern counts."""
    weights = train(patterns(docs))
    return apply(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), weights, add)


def apply(rows: DataFrame, weights: dict[str, float], add: float = ADD) -> DataFrame:
    """Add ``base`` and ``spans`` to ``rows``, which have a column ``text``."""
    rows = candidates(base_spans(rows))
    if not weights:
        return rows.withColumn("spans", F.col("base")).drop("wide")
    cast = F.transform("wide", lambda s: F.struct(s.alias("span"), *[c.alias(n) for n, c in votes(F.col("text"), s).items()]))
    rows = rows.select("*", cast.alias("cast"))
    judged = F.filter("cast", lambda c: probability(weights, c["span"]["kind"], c) >= add)
    rows = rows.select("*", F.transform(judged, lambda c: c["span"]).alias("added"))
    return rows.select("*", F.array_sort(F.concat("base", "added")).alias("spans")).drop("wide", "cast", "added")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def mask(docs: DataFrame, add: float = ADD) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets and ``n_chars`` counted anew.

    Spans that overlap are replaced one after the other, each by its own mark.
    """
    weights = train(patterns(docs))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    rows = apply(inner, weights, add)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    pieces = F.aggregate("spans", start, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.concat(a["out"], F.array(F.substring("text", a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.get(names, s["kind"]))).alias("out")))
    rest = F.substring(F.col("text"), F.col("cut.at") + 1, F.length("text"))
    rows = rows.select("row", "text", F.size("spans").alias("n"), F.when(F.size("spans") > 0, pieces).alias("cut"))
    rows = rows.select("row", F.when(F.col("n") > 0, F.concat(F.concat_ws("", F.col("cut.out")), rest)).otherwise(F.col("text")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
