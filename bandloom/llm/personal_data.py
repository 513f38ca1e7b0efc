"""Personal data by weak supervision, in built-in functions only.

Candidates are the matches of four strict patterns (email, ip, card, phone) and of looser
ones (spelled-out emails, local phone numbers). Labelers vote +1, 0 or -1 on each: the strict
pattern's own check, gazetteers (top-level domains, card issuers, calling codes, address
ranges), the words before, what adjoins, and the digits' variety. Counts of vote patterns over
the whole corpus, at most ``3 ** 5`` for a kind, go to the driver, where expectation-maximisation
estimates how reliable each labeler is and how common real spans are. The posteriors train a
logistic classifier over votes and kinds, which then decides about every candidate that the
strict patterns did not settle: those keep their spans in any case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, keyed, written

KINDS = ("email", "ip", "card", "phone")

# The strict patterns. Possessive repeats and the look-behinds only spare failing
# retries; \G lets a match follow the last one directly.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9_%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,24}){1,4}",
    "phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: What a text must contain for a pattern to match at all.
QUICK = {
    ("email", True): lambda t: F.contains(t, F.lit("@")),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    ("phone", True): lambda t: t.rlike(r"\+[0-9]"),
    ("email", False): lambda t: t.rlike(r"(?i)[(\[]at[)\]]"),
    ("phone", False): lambda t: t.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
}
# Gazetteers and context words.
DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at se no dk fi pl pt be ie nz mx ar app dev ai me tv example test"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|64[4-9]|35|30[0-5]|36|38|39|62)"
CALLING = r"^\+(?:1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|3[5-8][0-9]|4[2][0-9]|5[09][0-9]|6[7-9][0-9]|8[58][0-9]|9[679][0-9])"
RESERVED = r"^(?:0|22[4-9]|2[3-5][0-9])\."
CONTEXT = {
    "email": r"e-?mail|contact|write|reach|mailto|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|address|addr|client|login|adresse",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel|call|fax|mobile|cell|whatsapp|sms|anruf|appel|llam",
}
AGAINST = r"(?:version|build|isbn|issn|order|ticket|sha|hash|token|key|serial|total|sum|[=#$€£]|no\.?|nr\.?)[ \"':]*$"
LABELERS = ("check", "gazetteer", "context", "adjoining", "variety")
#: Probability from which the classifier adds a candidate.
ADD = 0.9


def _candidates(text: Column) -> tuple[dict, list]:
    """Columns of pieces and hits, and the array expressions over them."""
    columns, arrays = {}, []
    for strict, patterns in ((True, STRICT), (False, LOOSE)):
        for kind, pattern in patterns.items():
            name = f"{kind}_{strict}"
            may = QUICK[kind, strict](text)
            pattern = pattern if strict else f"(?i){pattern}"
            columns[f"p_{name}"] = F.when(may, F.split(text, pattern, -1))
            columns[f"h_{name}"] = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
            pieces, hits = F.col(f"p_{name}"), F.col(f"h_{name}")
            arrays.append((hits, pieces, KINDS.index(kind), strict))
    return columns, arrays


def _struct(pieces: Column, kind: int, strict: bool):
    return lambda hit, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("i"), F.length(pieces[i]).alias("gap"), hit.alias("hit"),
        F.lower(F.right(pieces[i], F.lit(40))).alias("before"), F.left(pieces[i + 1], F.lit(2)).alias("after"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """A stored table: at least one row for each row of ``docs(doc_id, text)``, ``kind`` null where nothing was found.

    Positions follow from the pieces between a pattern's matches: running sums of lengths.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    columns, arrays = _candidates(F.col("text"))
    split = rows.select("row", "doc_id", *[c.alias(n) for n, c in columns.items()])
    none = F.array().cast("array<struct<kind:int,strict:boolean,i:int,gap:int,hit:string,before:string,after:string>>")
    every = F.concat(*[F.coalesce(F.transform(h, _struct(p, k, s)), none) for h, p, k, s in arrays])
    return written(split.select("row", "doc_id", F.explode_outer(every).alias("c")).select("row", "doc_id", "c.*"))


def luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(reverse, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def voted(found: DataFrame) -> DataFrame:
    """Spans (code points, end exclusive) with their votes; ``base``: strict and its check passed."""
    order = W.partitionBy("row", "kind", "strict").orderBy("i")
    ends = F.sum(F.col("gap") + F.length("hit")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    kind = lambda name: F.col("kind") == KINDS.index(name)
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.length(digits)
    parts = F.forall(F.split("hit", r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    passes = F.when(kind("email"), True).when(kind("ip"), parts).when(kind("card"), luhn(digits)).otherwise(n.between(9, 15))
    vote = lambda good: F.when(good, 1).otherwise(-1)
    domain = F.lower(F.regexp_extract("hit", r"([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1))
    gazetteer = (
        F.when(kind("email"), vote(domain.isin(DOMAINS.split()))).when(kind("ip"), vote(~F.col("hit").rlike(RESERVED)))
        .when(kind("card"), vote(digits.rlike(ISSUERS))).when(F.col("strict"), vote(F.col("hit").rlike(CALLING))).otherwise(vote(digits.rlike("^[2-9]")))
    )
    words = F.lit(False)
    for name, pattern in CONTEXT.items():
        words = words | (kind(name) & F.col("before").rlike(pattern))
    context = F.when(F.col("before").rlike(AGAINST), -1).when(words, 1).otherwise(0)
    joined = F.col("before").rlike(r"[\p{L}0-9_]$") | F.col("after").rlike(r"^[\p{L}0-9_]")
    variety = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.substring(digits, i, F.lit(1)))))
    return (
        found.filter("kind is not null").withColumn("end", ends.cast("long")).withColumn("start", F.col("end") - F.length("hit")).withColumn("passes", passes)
        .withColumn("base", F.col("strict") & F.col("passes")).withColumn("check", F.when(F.col("strict"), vote(F.col("passes"))).otherwise(0))
        .withColumn("gazetteer", gazetteer).withColumn("context", context).withColumn("adjoining", F.when(joined, -1).otherwise(1))
        .withColumn("variety", F.when(kind("email"), 0).otherwise(vote(variety >= 3)))
        .select("row", "doc_id", "kind", "start", "end", "base", *LABELERS)
    )


@dataclass
class Classifier:
    weights: dict[tuple, float]  # (kind,) and (labeler, vote)

    def probability(self) -> Column:
        total = F.lit(0.0)
        for k in range(len(KINDS)):
            total = total + F.when(F.col("kind") == k, self.weights.get((k,), 0.0)).otherwise(0.0)
        for name in LABELERS:
            for v in (-1, 0, 1):
                total = total + F.when(F.col(name) == v, self.weights.get((name, v), 0.0)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 30) -> tuple[list[float], dict]:
    """EM over ``(kind, votes, count)``: posteriors of the patterns, and P(vote | real or not) by labeler.

    Starts from majority votes; counts are smoothed by one.
    """
    posterior = [min(0.95, max(0.05, 0.5 + 0.2 * sum(votes))) for _, votes, _ in patterns]
    share: dict = {}
    for _ in range(rounds):
        seen: dict = {}
        prior: dict = {}
        for (kind, votes, n), p in zip(patterns, posterior, strict=True):
            for y, w in ((1, n * p), (0, n * (1 - p))):
                prior[kind, y] = prior.get((kind, y), 1.0) + w
                for j, v in enumerate(votes):
                    seen[j, v, y] = seen.get((j, v, y), 1.0) + w
        for j in range(len(LABELERS)):
            for y in (0, 1):
                total = sum(seen.get((j, v, y), 1.0) for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    share[j, v, y] = seen.get((j, v, y), 1.0) / total
        for at, (kind, votes, _) in enumerate(patterns):
            log = [math.log(prior[kind, y]) + sum(math.log(share[j, v, y]) for j, v in enumerate(votes)) for y in (0, 1)]
            posterior[at] = 1 / (1 + math.exp(max(-30.0, min(30.0, log[0] - log[1]))))
    return posterior, share


def train(spans: DataFrame, steps: int = 300) -> Classifier:
    """Fit on the counts of vote patterns; with no candidates every weight is 0."""
    rows = spans.groupBy("kind", *LABELERS).count().collect()  # 4 kinds, 3 votes of 5 labelers at most
    patterns = sorted((r["kind"], tuple(r[name] for name in LABELERS), r["count"]) for r in rows)
    posterior, _ = reliabilities(patterns)
    weights: dict[tuple, float] = {}
    total = sum(math.sqrt(n) for *_, n in patterns) or 1.0  # square roots: frequent patterns don't drown the others
    for _ in range(steps):
        step: dict[tuple, float] = {}
        for (kind, votes, n), p in zip(patterns, posterior, strict=True):
            names = [(kind,), *zip(LABELERS, votes, strict=True)]
            z = sum(weights.get(x, 0.0) for x in names)
            g = math.sqrt(n) / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            for x in names:
                step[x] = step.get(x, 0.0) + g
        for x, g in step.items():
            weights[x] = weights.get(x, 0.0) - 2.0 * (g + 1e-3 * weights.get(x, 0.0))
    return Classifier(weights)


def detected(found: DataFrame) -> DataFrame:
    """``row, doc_id, kind, start, end, base``: all strict spans, and those the classifier adds.

    An added span overlaps no strict one.
    """
    spans = written(voted(found))
    scored = spans.withColumn("added", ~F.col("base") & (train(spans).probability() >= ADD)).filter("base or added")
    own = W.partitionBy("row").orderBy("start", "end")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(own.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(own.rowsBetween(1, W.unboundedFollowing))
    clear = scored.withColumn("_b", before).withColumn("_a", after)
    return clear.filter("base or ((_b is null or _b <= start) and (_a is null or _a >= end))").select("row", "doc_id", "kind", "start", "end", "base")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs(doc_id, text)``.

    Counts and digest are of strict spans; ``spans`` has the added ones too. Null and empty texts
    have none. Rows are never merged, ids may repeat or be null. Other columns are not read.
    """
    found = candidates(docs)
    span = F.struct("start", "kind", "end")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    some = detected(found).groupBy("row").agg(*counts, F.collect_list(F.when(F.col("base"), span)).alias("strict"), F.collect_list(span).alias("all"))
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    joined = rows.join(some, "row", "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{name}", F.lit(0).cast("long")).alias(f"n_{name}") for name in KINDS],
        F.sha2(_listed(F.coalesce("strict", none)).cast("binary"), 256).alias("base_sha256"), _listed(F.coalesce("all", none)).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every detected span replaced by its kind in brackets and ``n_chars`` as it then is.

    Overlapping spans become one, named after the first. Texts without spans, null and empty
    ones among them, are not touched. Rows are told apart whatever their ids, none goes, and
    all columns stay, whatever their names.
    """
    key, listed = fresh(docs, "row_key"), fresh(docs, "row_spans")
    rows = keyed(docs, key)
    spans = detected(candidates(rows.select(F.col(key).alias("doc_id"), "text")))  # the key stands for the id from here
    own = W.partitionBy("row").orderBy("start", "kind")
    reached = F.coalesce(F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    island = spans.withColumn("new", (F.col("start") >= reached).cast("int")).withColumn("n", F.sum("new").over(own))
    first = F.min_by("kind", F.struct("start", "kind")).alias("kind")
    runs = island.groupBy("row", "doc_id", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"), first)
    lists = runs.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(listed))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    s, text = F.col(listed), F.col("text")
    last = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(s, i - 1)["end"])
    between = lambda x, i: F.substring(text, (last(i) + 1).cast("int"), (x["start"] - last(i)).cast("int"))
    pieces = F.transform(s, lambda x, i: F.concat(between(x, i), names[x["kind"]]))
    tail = F.substring(text, (F.element_at(s, -1)["end"] + 1).cast("int"), F.length(text))
    out = rows.join(lists, key, "left").withColumn("text", F.when(s.isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(text))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(s.isNotNull(), size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
