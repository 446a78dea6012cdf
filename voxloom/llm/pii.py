"""Personal data by rules, and by bootstrapped contextual extraction from what the rules find.

All of it is DataFrame operations. Rules find emails, IPv4 addresses, card numbers and phone
numbers; these are the seeds. The words around a seed make lexical patterns (the word before,
the word after, both). Identifier-like strings that no rule takes are instances in the same
graph of patterns and instances. In each round a pattern's confidence for a kind is the share of
its distinct instances that are believed to be of that kind, and an instance's belief is the
noisy-or of the confidences of its patterns with support; seeds stay at 1. Support are several
distinct instances that are seeds or believed in, so that what was discovered in one context
opens the next; the rounds end when no pattern comes or goes. What is of a kind's shape
(`SHAPES`; nothing else is a new span) and stands in a pattern of high confidence with support
is a new span of that kind. Spans of the rules always stay; a number that a rule takes and then
drops (a wrong check digit, a part above 255) is no instance.

The text is read once; the graph holds short strings only, is aggregated before each shuffle,
and is rewritten to the shared folder in every round. Matches come from one scan with possessive
patterns, so that long runs of one class of characters take linear time.

Defined results: null and empty texts have no spans; a null doc_id stays a row; rows that repeat
a doc_id and text get the same spans; other columns are ignored, and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch, small_side

KINDS = ("email", "ip", "card", "phone")
#: What the contract's patterns match, with starts and repeats written so that no text takes quadratic time.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Text that is no instance: what the rules match, but for digits that are too few for a card.
TAKEN = (RULES["email"], RULES["phone"], RULES["ip"], r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+")
#: A run of digit groups, or any word with a digit or an at sign.
INSTANCE = r"(?<![\w@.+-])\(?[0-9]{2,5}\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){1,4}(?![\w@])|(?<![^\x20\x09-\x0D\x01])[^\x20\x09-\x0D\x010-9@]*+[0-9@][^\x20\x09-\x0D\x01]*+"
SHAPES = {
    "email": r"^[a-z0-9._%+-]+(?:@[a-z][a-z0-9-]*|[\[({]at[\])}][a-z0-9.-]+)$",
    "ip": r"^(?:[0-9a-f]{0,4}:){3,7}[0-9a-f]{0,4}$",
    "card": r"^(?=.*[x*])[0-9x*]{4}(?:[ -]?[0-9x*]{2,6}){2,4}$",
    "phone": r"^\(?[0-9]{2,5}\)?(?:[ ./-]?\(?[0-9]{2,5}\)?){1,4}$",
}
EDGES = "\"'(),.;:!?[]<>{}#$%&*|="
MARK = "\x01"


def running(steps: Column, add=lambda a, x: a + x) -> Column:
    """For each element the sum (or what else `add` makes) of those before it; in blocks, as appending to one long array copies it each time."""
    n = F.size(steps)
    width = block_width(n)
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda k: F.slice(steps, k * width + 1, width))
    none = F.array().cast("array<long>")

    def before(values: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(values, begin, lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    zero = F.lit(0).cast("long")
    starts = before(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: add(a, x))), zero)
    return F.when(n > 0, F.flatten(F.zip_with(parts, starts, lambda p, s: before(p, s)))).otherwise(none)


def block_width(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))


def last_word(gap: Column) -> Column:
    return F.substring_index(F.rtrim(F.translate(gap, "\t\n\x0b\x0c\r" + MARK, " " * 6)), " ", -1)


def first_word(gap: Column) -> Column:
    return F.substring_index(F.ltrim(F.translate(gap, "\t\n\x0b\x0c\r" + MARK, " " * 6)), " ", 1)


def context(word: Column, edge: str) -> Column:
    """Lower-case letters of a word; other words and the ends of the text get a sign of their own."""
    letters = F.regexp_replace(F.lower(word), r"[^\p{L}]+", "")
    return F.when(word == "", F.lit(edge)).when(letters == "", F.lit("~")).otherwise(letters)


def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df and, for each name, an array of all matches of its pattern: start, end, value, left, right."""
    own = df.columns
    has = F.col(text).rlike("[0-9@]")
    none = F.array().cast("array<string>")
    found = df.select("*", *[c for name, p in patterns.items() for c in (
        F.when(has, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"v_{name}"),
        F.when(has & F.col(text).rlike(p), F.split(text, p, -1)).otherwise(none).alias(f"g_{name}"),
    )])
    at = found.select("*", *[F.zip_with(f"v_{n}", F.slice(f"g_{n}", F.lit(1), F.size(f"v_{n}")), lambda v, g: (F.length(v) + F.length(g)).cast("long")).alias(f"s_{n}") for n in patterns])
    at = at.select("*", *[running(F.col(f"s_{n}")).alias(f"b_{n}") for n in patterns])

    def array(n: str) -> Column:
        def one(v: Column, k: Column) -> Column:
            start = F.get(F.col(f"b_{n}"), k) + F.length(F.get(F.col(f"g_{n}"), k))
            left, right = last_word(F.get(F.col(f"g_{n}"), k)), first_word(F.get(F.col(f"g_{n}"), k + 1))
            return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), context(left, "^").alias("left"), context(right, "$").alias("right"))

        return F.transform(f"v_{n}", one)

    return at.select(*own, *[array(n).alias(n) for n in patterns])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    figures = F.split(F.reverse(number), "")
    doubled = F.transform(figures, lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def byte_sized(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), byte_sized),
    "card": lambda v: F.when(F.length(digits(v)).between(13, 19), luhn(digits(v))).otherwise(False),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}


def masked(df: DataFrame, text: str, patterns: tuple[str, ...]) -> DataFrame:
    """df with a column `masked`: the text, all matches overwritten by as many marks."""
    df = df.withColumn("masked", F.translate(F.when(F.col(text).rlike("[0-9@]"), F.col(text)).otherwise(""), MARK, " "))
    for p in patterns:
        df = df.withColumn("pieces", F.split("masked", p, -1)).withColumn("found", F.regexp_extract_all("masked", F.lit(p), F.lit(0)))
        rebuilt = F.array_join(F.transform("pieces", lambda g, k: F.concat(g, F.repeat(F.lit(MARK), F.coalesce(F.length(F.get(F.col("found"), k)), F.lit(0))))), "")
        df = df.withColumn("masked", F.when(F.size("found") > 0, rebuilt).otherwise(F.col("masked"))).drop("pieces", "found")
    return df


def valid(kind: str):
    return lambda m: VALID[kind](m["value"])


def span_of(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def seed_of(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), F.lower(m["value"]).alias("value"), m["left"].alias("left"), m["right"].alias("right"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, seeds, instances): all that is needed of the texts."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    found = with_matches(rows, "text", RULES)
    kept = found.select("doc_id", "text_hash", "text", *[F.filter(k, valid(k)).alias(k) for k in KINDS])
    spans = F.concat(*[F.transform(k, span_of(k)) for k in KINDS])
    seeds = F.concat(*[F.transform(k, seed_of(k)) for k in KINDS])
    kept = masked(kept.select("doc_id", "text_hash", "text", spans.alias("base"), seeds.alias("seeds")), "text", TAKEN).drop("text")
    loose = with_matches(kept, "masked", {"loose": INSTANCE}).drop("masked")

    def instance(m: Column) -> Column:
        bracketed = m["value"].rlike(r"^\([0-9]+\)[\x20./-]?\(?[0-9]")  # this bracket is part of the number
        tail = F.rtrim(m["value"], F.lit(EDGES))
        value = F.when(bracketed, tail).otherwise(F.ltrim(tail, F.lit(EDGES)))
        lead = F.length(tail) - F.length(value)
        low = F.lower(value)
        kind = F.lit("other")
        for k in ("phone", "card", "ip", "email"):
            fits = low.rlike(SHAPES[k])
            kind = F.when(fits & F.length(digits(low)).between(7, 15) if k == "phone" else fits, F.lit(k)).otherwise(kind)
        start = m["start"] + lead
        return F.struct(kind.alias("kind"), low.alias("value"), start.alias("start"), (start + F.length(value)).alias("end"), m["left"].alias("left"), m["right"].alias("right"))

    return loose.select("doc_id", "text_hash", "base", "seeds", F.filter(F.transform("loose", instance), lambda m: m["value"] != "").alias("instances"))


def patterns_of(left: Column, right: Column) -> Column:
    return F.array(F.concat(F.lit("L "), left), F.concat(F.lit("R "), right), F.concat(F.lit("B "), left, F.lit(" "), right))


def bootstrap(scanned: DataFrame, scratch: Scratch, most_rounds: int = 12, sure: float = 0.6, support: int = 3) -> DataFrame:
    """Patterns of high confidence: (pattern, kind). scanned: what scan() returns.

    The rounds end when they are the same twice, or after `most_rounds`.
    """
    seeds = scanned.select(F.explode("seeds").alias("s")).select("s.kind", "s.value", "s.left", "s.right", F.lit(True).alias("seed"))
    loose = scanned.select(F.explode("instances").alias("s")).select("s.kind", "s.value", "s.left", "s.right", F.lit(False).alias("seed"))
    links = seeds.unionByName(loose).select("kind", "value", "seed", F.explode(patterns_of(F.col("left"), F.col("right"))).alias("pattern"))
    links = scratch.table(links.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")), "links")
    # Each pattern's size goes with its links once, and not again in each round.
    shape = scratch.table(links.groupBy("pattern").agg(F.count("*").alias("n")), "shape")
    known = links.where("seed").select("kind", "value", F.lit(1.0).alias("belief")).distinct()
    belief, seen = known, None
    for _ in range(most_rounds):
        scored = links.where("kind <> 'other'").join(belief, ["kind", "value"])
        sums = scored.groupBy("pattern", "kind").agg(F.sum(F.round("belief", 9).cast("decimal(18,9)")).cast("double").alias("believed"), F.count_if(F.col("belief") >= sure).alias("backed"))
        trust = sums.where(F.col("backed") >= support).join(shape, "pattern").select("pattern", "kind", (F.col("believed") / (F.col("n") + 1)).alias("trust"))
        trust = scratch.table(trust, "trust")
        now = trust.where(F.col("trust") >= sure).agg(F.count("*"), F.sum(F.xxhash64("pattern", "kind").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        # Seeds are believed in anyway; only the others are scored.
        doubt = links.where("kind <> 'other'").join(known.select("kind", "value"), ["kind", "value"], "left_anti").join(trust, ["pattern", "kind"]).groupBy("kind", "value")
        doubt = doubt.agg((1 - F.exp(F.sum(F.round(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))), 9).cast("decimal(18,9)")).cast("double"))).alias("belief"))
        belief = scratch.table(doubt.unionByName(known), "belief")
    return trust.where(F.col("trust") >= sure).select("pattern", "kind")


def discovered(scanned: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """(doc_id, text_hash, added): the new spans of each distinct text that has some."""
    sure = scratch.table(bootstrap(scanned, scratch, **options), "sure")
    loose = scanned.select("doc_id", "text_hash", F.explode("instances").alias("s")).where("s.kind <> 'other'")
    loose = loose.select("doc_id", "text_hash", "s.kind", "s.start", "s.end", F.explode(patterns_of(F.col("s.left"), F.col("s.right"))).alias("pattern"))
    hits = loose.join(sure, ["pattern", "kind"]).select("doc_id", "text_hash", "kind", "start", "end")
    span = F.struct("kind", "start", "end")
    return scratch.table(hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(span)).alias("added")), "added")


def ordered(spans: Column) -> Column:
    """Spans by kind as listed, then by start."""
    def rank(kind: Column) -> Column:
        return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")

    keyed = F.transform(spans, lambda s: F.struct(rank(s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(ordered(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) for each row; spans holds base and what was discovered."""
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.table(scan(docs), "scanned")
    added, small = small_side(scratch, discovered(scanned, scratch, **options), "few", weight=F.size("added") + 1)
    added = added.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    joined = scanned.select("doc_id", "text_hash", "base").join(F.broadcast(added) if small else added, same, "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return joined.select("doc_id", "base", F.concat("base", F.coalesce("added", none)).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets, and n_chars, if there, set anew."""
    scratch = Scratch(docs.sparkSession, "redact")
    scanned = scratch.table(scan(docs), "scanned")
    added = discovered(scanned, scratch, **options)
    base = scanned.where(F.size("base") > 0).select("doc_id", "text_hash", F.col("base").alias("added"))
    each = base.unionByName(added).select("doc_id", "text_hash", F.explode("added").alias("s"))
    spans, small = small_side(scratch, each.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("s.start", "s.end", "s.kind"))).alias("spans")), "spans", weight=F.size("spans") + 1)
    spans = spans.withColumnsRenamed({"doc_id": "voxloom_d", "text_hash": "voxloom_h", "spans": "voxloom_spans"})
    same = F.col("doc_id").eqNullSafe(F.col("voxloom_d")) & (F.xxhash64("text") == F.col("voxloom_h"))
    joined = docs.join(F.broadcast(spans) if small else spans, same, "left")
    # Overlapping spans become one, which has the kind of its first part. `reach` is where the spans before each one end.
    ends = F.transform(F.coalesce("voxloom_spans", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")), lambda s: s["end"])
    joined = joined.withColumn("voxloom_reach", F.concat(running(ends, lambda a, x: F.greatest(a, x)), F.array(F.coalesce(F.array_max(ends), F.lit(0).cast("long")))))
    reach = lambda k: F.get("voxloom_reach", k)
    part = lambda text, a, b: text.substr((a + 1).cast("int"), (b - a).cast("int"))
    # A position in a string is found by reading up to it, so the text is cut into blocks of spans first.
    n = F.size("voxloom_spans")
    width = block_width(n)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda g: F.struct(
        (g * width).alias("first"), F.slice("voxloom_spans", g * width + 1, width).alias("spans"), part(F.col("text"), reach(g * width), reach(F.least((g + 1) * width, n))).alias("text")))

    def write(g: Column, s: Column, k: Column) -> Column:
        start, at = s["start"], reach(g["first"] + k)
        offset = reach(g["first"])
        return F.when(start >= at, F.concat(part(g["text"], at - offset, start - offset), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

    rest = part(F.col("text"), reach(n), F.length("text").cast("long"))
    done = F.concat(F.array_join(F.transform(blocks, lambda g: F.array_join(F.transform(g["spans"], lambda s, k: write(g, s, k)), "")), ""), rest)
    # Under a name of its own: in the same select, an alias "text" would be taken for the column within the lambdas.
    joined = joined.withColumn("voxloom_text", F.when(F.col("voxloom_spans").isNull(), F.col("text")).otherwise(done))
    out = {"text": F.col("voxloom_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("voxloom_spans").isNull(), F.col("n_chars")).otherwise(F.length("voxloom_text")).cast(dict(docs.dtypes)["n_chars"])
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
