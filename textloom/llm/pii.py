"""Personal data: fixed patterns, and spans that a weakly supervised classifier adds.

Four kinds come from patterns alone: email, ip, card, phone. They always stay. Candidates of two further kinds,
`secret` (long tokens that mix letters and digits) and `id` (digit runs that are no card or phone), are judged:
a regex, a gazetteer and a context labeler each vote on every candidate or abstain. Expectation-maximisation over
the counts of the votes' combinations estimates how reliable each labeler is and how likely each combination is
to be private. With those likelihoods as weights a span classifier (naive Bayes over the candidate's own shape and
its surroundings) is trained on all candidates, and its log odds decide.

Only DataFrame functions touch rows. The driver sees counts of vote combinations and of feature values, whose
numbers are fixed by this code.

Defined cases: a null text is empty and has no spans; offsets count code points; spans of different kinds may
overlap; with no candidates nothing is trained and only the patterns' spans are returned. Repeated rows, and rows
that share a doc_id, are each reported; the query leaves out rows without a doc_id. Columns other than doc_id and
text are not read. Time and memory grow in proportion to a text's length and its number of matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage
from .decontam import let

LOCAL = r"[A-Za-z0-9._%+-]"
#: a match starts where its run of local characters does, or where the match before ended inside that run
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SECRET = r"[A-Za-z0-9_+/-]{16,}+={0,2}"
KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: fixed values: words that announce a secret, or a number that identifies a person
GAZETTEER = {
    "secret": ("token", "password", "passwd", "pwd", "secret", "apikey", "api_key", "api key", "access key", "private key", "bearer", "credential", "auth"),
    "id": ("ssn", "social security", "passport", "iban", "account", "tax", "insurance", "licence", "license", "id", "card", "visa", "mastercard", "tel", "phone", "mobile", "fax"),
}
NEAR = 24
BLOCK = 24
#: a match: its place in code points, its text, up to NEAR characters before it and one after it
SPAN = "struct<start:int,end:int,found:string,lead:string,after:string>"
LABELERS = ("regex", "gazetteer", "context")
SMOOTH, PRIOR, STEPS = 1.0, 0.2, 50


def scanned(array: Column, state: Column, step, form: str) -> Column:
    """Array of what step(state, item) = (next state, value) gives for each item of array in order; form: the values' type.

    Appending to an array copies it, so values gather in blocks of BLOCK items, and these in blocks of BLOCK blocks:
    the work stays near linear.
    """
    none = F.array().cast(f"array<{form}>")
    nested = F.array().cast(f"array<array<{form}>>")

    def begun(acc: Column, empty: Column) -> Column:
        return F.struct(acc["state"].alias("state"), empty.alias("out"))

    def item(acc: Column, x: Column) -> Column:
        after, value = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(value)).alias("out"))

    def block(items: Column, acc: Column, k: Column) -> Column:
        part = F.slice(items, k * BLOCK + 1, F.lit(BLOCK))
        add = lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out"))
        return let(F.aggregate(part, begun(acc, none), item), add)

    def blocks(items: Column, acc: Column, j: Column) -> Column:
        last = F.least((j + 1) * BLOCK - 1, F.floor((F.size(items) - 1) / BLOCK).cast("int"))
        add = lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(F.flatten(d["out"]))).alias("out"))
        return let(F.aggregate(F.sequence(j * BLOCK, last), begun(acc, nested), lambda a, k: block(items, a, k)), add)

    def whole(items: Column) -> Column:
        start = F.struct(state.alias("state"), nested.alias("out"))
        all_ = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK**2).cast("int"))
        done = F.aggregate(all_, start, lambda acc, j: blocks(items, acc, j))
        return F.when(F.size(items) == 0, none).otherwise(F.flatten(done["out"]))

    return let(array, whole)


def matches(text: Column, pattern: str, guard: str) -> Column:
    """SPAN structs of all leftmost matches: the pieces between them give the offsets and what stands around."""

    def place(found: Column, between: Column) -> Column:
        def add(at: Column, i: Column) -> tuple[Column, Column]:
            begin = at + F.length(between[i])
            end = begin + F.length(found[i])
            before = F.when(i > 0, F.concat(F.right(between[F.greatest(i - 1, F.lit(0))], F.lit(NEAR)), found[F.greatest(i - 1, F.lit(0))])).otherwise("")
            lead = F.right(F.concat(F.right(before, F.lit(NEAR)), F.right(between[i], F.lit(NEAR))), F.lit(NEAR))
            after = F.left(F.concat(F.left(between[i + 1], F.lit(1)), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(1))
            values = (begin.alias("start"), end.alias("end"), found[i].alias("found"), lead.alias("lead"), after.alias("after"))
            return end, F.struct(*values)

        return scanned(F.sequence(F.lit(0), F.size(found) - 1), F.lit(0), add, SPAN)

    none = F.array().cast(f"array<{SPAN}>")
    pieces = lambda found: let(F.split(text, pattern, -1), lambda between: place(found, between))
    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(pieces(found)))
    return F.when(text.rlike(guard), some).otherwise(none)


def clear_of(spans: Column, others: Column) -> Column:
    """The spans (SPAN structs) that overlap none of others (arrays of start and end), in order of start.

    One pass over both in order of start knows the farthest end before each span, one in reverse the nearest start
    after it.
    """
    far, row = F.lit(1 << 30), f"struct<start:int,end:int,own:boolean,x:{SPAN},free:boolean>"
    plain = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(False).alias("own"), F.lit(None).cast(SPAN).alias("x"), F.lit(True).alias("free"))
    own = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(True).alias("own"), x.alias("x"), F.lit(True).alias("free"))

    def marked(x: Column, free: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["own"].alias("own"), x["x"].alias("x"), (x["free"] & free).alias("free"))

    def forth(ended: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["own"], ended).otherwise(F.greatest(ended, x["end"])), marked(x, ended <= x["start"])

    def back(begins: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["own"], begins).otherwise(F.least(begins, x["start"])), marked(x, begins >= x["end"])

    all_ = F.sort_array(F.concat(F.transform(others, plain), F.transform(spans, own)))
    passed = let(let(all_, lambda a: F.reverse(scanned(a, F.lit(-1), forth, row))), lambda a: F.reverse(scanned(a, far, back, row)))
    kept = F.transform(F.filter(passed, lambda x: x["own"] & x["free"]), lambda x: x["x"])
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(kept)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Doubles every second digit from the right; the digits' sum is a multiple of ten."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """Arrays of (start, end, found) of the four fixed kinds."""
    enough = lambda x, least, most: let(F.length(digits(x["found"])), lambda n: (n >= least) & (n <= most))
    return [
        matches(text, EMAIL, "@"),
        F.filter(matches(text, IP, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), lambda x: x["found"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")),
        F.filter(matches(text, CARD, r"[0-9](?:[\x20-]?[0-9]){12}"), lambda x: enough(x, 13, 19) & luhn(digits(x["found"]))),
        F.filter(matches(text, PHONE, r"\+[0-9]"), lambda x: enough(x, 9, 15)),
    ]


def described(spans: Column, kind: str) -> Column:
    """Candidates with their votes (1, 0, -1 for an abstention) and the features that the classifier reads."""

    def one(x: Column) -> Column:
        found, start = x["found"], x["start"]
        lead, after = F.lower(x["lead"]), x["after"]
        announced = lead.rlike("(?:^|[^a-z])(?:" + "|".join(GAZETTEER[kind]) + ")[^a-z]")
        assigned = lead.rlike(r"[=:#][\s\"']*$")
        inside = lead.rlike(r"[/@&?%\w]$") | after.rlike(r"[/@\w]")
        length = F.length(found)
        if kind == "secret":
            mixed = found.rlike("[0-9]") & found.rlike("[A-Za-z]")
            shape = F.when(mixed & found.rlike("^(?:[0-9a-f]{24,}|[A-Za-z0-9_-]{24,}|[A-Za-z0-9+/]{22,}={1,2})$"), 1).when(~mixed, 0).otherwise(-1)
        else:
            shape = F.when(found.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})$"), 1).when(F.length(digits(found)) < 9, 0).otherwise(-1)
        votes = [shape, F.when(announced, 1).otherwise(-1), F.when(assigned, 1).when(inside, 0).otherwise(-1)]
        many = lambda pattern: F.floor(4 * F.length(F.regexp_replace(found, pattern, "")) / length)
        features = [
            F.least(F.lit(12), F.floor(F.log2(length.cast("double")) * 2)), many("[^0-9]"), many("[^A-Z]"), many("[A-Za-z0-9]"),
            F.when(announced, 1).otherwise(0), F.when(assigned, 1).otherwise(0), F.when(inside, 1).otherwise(0), shape,
        ]
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), x["end"].alias("end"), F.concat_ws(",", *[v.cast("string") for v in votes]).alias("votes"),
            F.transform(F.array(*[f.cast("int") for f in features]), lambda f, i: F.concat_ws(":", F.lit(kind), i.cast("string"), f.cast("string"))).alias("features"),
        )

    return F.transform(spans, one)


def examined(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as (doc_id, base, candidates); staged."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    arrays = base_spans(F.col("text"))
    of_kind = lambda k: lambda x: F.struct(F.lit(k).alias("k"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.concat(*[F.transform(a, of_kind(k)) for k, a in enumerate(arrays)])
    tokens = F.filter(matches(F.col("text"), SECRET, r"[A-Za-z0-9_+/-]{16}"), lambda x: x["found"].rlike("[0-9]") & x["found"].rlike("[A-Za-z]"))
    numbers = F.filter(matches(F.col("text"), CARD, r"[0-9](?:[\x20-]?[0-9]){5}"), lambda x: F.length(digits(x["found"])) >= 6)
    rows = stage(rows.select("doc_id", base.alias("base"), tokens.alias("tokens"), numbers.alias("numbers")))
    place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    taken = F.concat(F.transform("base", place), F.transform("tokens", place))
    secrets = let(F.transform("base", place), lambda b: clear_of(F.col("tokens"), b))
    ids = let(taken, lambda t: clear_of(F.col("numbers"), t))
    out = stage(rows.select("doc_id", "base", F.concat(described(secrets, "secret"), described(ids, "id")).alias("candidates")))
    unstage(rows)
    return out


def reliabilities(counts: dict[tuple[int, ...], int]) -> tuple[dict[tuple[int, ...], float], list[float]]:
    """Expectation-maximisation: how likely each combination of votes is private; how often each labeler is right.

    A labeler is right with one probability, kept above a coin's so that the classes cannot change places; an
    abstention says nothing.
    """
    right, prior = [0.8] * len(LABELERS), PRIOR
    post: dict[tuple[int, ...], float] = {}
    for _ in range(STEPS):
        for votes in counts:
            odds = math.log(prior / (1 - prior))
            for v, r in zip(votes, right, strict=True):
                odds += 0.0 if v < 0 else math.log(r / (1 - r)) * (1 if v == 1 else -1)
            post[votes] = 1 / (1 + math.exp(-odds))
        total = sum(counts.values())
        prior = min(0.95, max(0.01, (sum(n * post[v] for v, n in counts.items()) + SMOOTH * PRIOR) / (total + SMOOTH)))
        for i in range(len(LABELERS)):
            cast = [(v, n) for v, n in counts.items() if v[i] >= 0]
            good = sum(n * (post[v] if v[i] == 1 else 1 - post[v]) for v, n in cast)
            right[i] = min(0.98, max(0.6, (good + 8 * SMOOTH) / (sum(n for _, n in cast) + 10 * SMOOTH)))
    return post, right


def trained(rows: DataFrame) -> dict[str, float]:
    """Log odds that each feature value gives, and each kind's own, from the candidates of all rows."""
    each = rows.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    counts: dict[str, dict[tuple[int, ...], int]] = {}
    for kind, votes, n in each.groupBy("kind", "votes").agg(F.count("*")).collect():  # at most 27 combinations a kind
        counts.setdefault(kind, {})[tuple(map(int, votes.split(",")))] = n
    if not counts:
        return {}
    post = {f"{kind}|{','.join(map(str, v))}": p for kind, c in counts.items() for v, p in reliabilities(c)[0].items()}
    likely = F.create_map(*[F.lit(x) for kv in post.items() for x in kv])[F.concat_ws("|", "kind", "votes")]
    weighed = each.withColumn("p", likely)
    totals = {r[0]: (r[1], r[2]) for r in weighed.groupBy("kind").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect()}
    values = weighed.select("kind", "p", F.explode("features").alias("f")).groupBy("kind", "f").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect()
    odds = {kind: math.log((a + SMOOTH) / (b + SMOOTH)) for kind, (a, b) in totals.items()}
    for kind, f, a, b in values:  # features take a dozen values each
        all_a, all_b = totals[kind]
        odds[f] = math.log((a + SMOOTH) / (all_a + 2 * SMOOTH)) - math.log((b + SMOOTH) / (all_b + 2 * SMOOTH))
    return odds


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): arrays of (k, start, end) in the order of k, an index of KINDS, then start; and base, the fixed ones."""
    rows = examined(docs)
    odds = trained(rows)
    none = F.array().cast("array<struct<k:int,start:int,end:int>>")
    if not odds:
        return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort("base").alias("spans"))
    weights = F.create_map(*[F.lit(x) for kv in odds.items() for x in kv])
    score = lambda c: weights[c["kind"]] + F.aggregate(c["features"], F.lit(0.0), lambda a, f: a + F.coalesce(weights[f], F.lit(0.0)))
    added = F.transform(F.filter("candidates", lambda c: score(c) > 0), lambda c: F.struct(F.when(c["kind"] == "secret", 4).otherwise(5).alias("k"), c["start"].alias("start"), c["end"].alias("end")))
    added = F.when(F.size("candidates") == 0, none).otherwise(added)
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("spans"))


def as_text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found_spans(table(spark, sf_dir, "documents").filter("doc_id is not null"))
    n = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")
    return out.select("doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
