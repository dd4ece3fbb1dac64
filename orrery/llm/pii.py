"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss, by DataFrame functions only.

Base spans come from four regular expressions with checks. They are seed entities, as are tokens that look drawn by chance
(kind "secret", which has no base spans): 32 and more lower-case hexadecimal digits, or 16 and more with four letters and
four figures among them, or 16 and more capitals and figures. Every token with a digit or an @ is an instance; of one like
name=value or name:value, the value is. Each induces up to three lexical patterns: the name and its mark or else the two
words before; if it has nine digits or more and no letters, its shape (digits as 9); if it is one long run of letters and
figures, the letters that it begins with. Patterns and instances form a graph, which is scored in rounds. A pattern is trusted for a kind if at least SUPPORT
different seeds of the kind follow it, and they make up TRUST of the different instances that do; of a shape, TRUST of
those whose kind is known, as nothing else tells what is no identifier. Words before must also be followed by an instance
in at least SHARE of all places where they stand in the corpus. The instances of a trusted pattern that have four digits
or an @ become seeds of its kind. Rounds go on until none trusts a new pattern. At the end each instance of a trusted
pattern that no base span touches is a span of its kind; one of several kinds is of the first.

Everything that is gathered is a count by pattern, after sums in each task, so that a frequent pattern or value costs
no more than a rare one. Texts are read three times, whatever the number of rounds: for spans and instances, and to count the
places of patterns that enough instances follow, first where instances stand, then everywhere. MOST_BROADCAST changes the
way of that count, never its result.

Cases: null and empty texts have no spans; rows that repeat are judged each; offsets count code points; a match or a
run of any length takes no stack and is read a fixed number of times; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm._store import Scratch

# The kinds, in order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
SECRET = "^(?:[0-9a-f]{32,}+|(?=(?:[0-9]*+[a-f]){4})(?=(?:[a-f]*+[0-9]){4})[0-9a-f]{16,}+|(?=[0-9]*+[A-Z])(?=(?:[A-Z]*+[0-9]){2})[0-9A-Z]{16,}+)$"
NAME = "^[^A-Za-z0-9]*+[A-Za-z][A-Za-z0-9_.-]*+[=:]++(?=[^0-9@]*+[0-9@])"
LONG, HEAD = "^[A-Za-z0-9_-]{16,}+$", "^[A-Za-z]{4}"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"
SPACES = r"[\x20\x09-\x0D]+"

# The same patterns for the JVM: possessive, so that a long match takes no stack, and tried only where a run of their
# first characters begins (or a match has just ended), so that long runs without a match are read once.
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
LINEAR_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
OUTER = r"^[^A-Za-z0-9@+]++|(?:\G|(?<![^A-Za-z0-9]))[^A-Za-z0-9]++$"
RUN = 256
SUPPORT, TRUST, SHARE = 3, 0.7, 0.25
SHAPE_DIGITS, SHAPE_MOST = 9, 40
MOST_BROADCAST = 1_000_000
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: structs of start, stop (code points), value and the text between it and the
    match before. Places are summed up in runs of RUN matches: appending one match at a time to an array copies it, which
    in a text of very many matches would cost their number squared."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    zipped = F.filter(zipped, lambda z: z["value"].isNotNull())
    match = "struct<start:int,stop:int,value:string,gap:string>"

    def step(acc, z):
        start = acc["at"] + F.length(z["gap"])
        stop = start + F.length(z["value"])
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), stop.alias("stop"), z["value"].alias("value"), z["gap"].alias("gap")))).alias("found"))

    def run(acc, part):
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{match}>").alias("found")), step)
        return F.aggregate(F.array(inner), acc, lambda a, x: F.struct(x["at"].alias("at"), F.concat(a["found"], F.array(x["found"])).alias("found")))

    runs = lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(RUN)), lambda k: F.slice(all_, k, F.lit(RUN)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{match}>>").alias("found"))
    done = lambda all_: F.when(F.size(all_) > 0, F.flatten(F.aggregate(runs(all_), start, run, lambda acc: acc["found"]))).otherwise(F.array().cast(f"array<{match}>"))
    # the array of matches is bound to a name, so that it is found once
    return F.element_at(F.transform(F.array(zipped), done), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.try_cast("int") + 1)))
    return n.between(12, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False))),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
#: What a text must hold for a pattern to match at all.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by start, then kind."""
    none = F.array().cast(SPAN)
    found = []
    for k, kind in enumerate(KINDS):
        good = F.filter(located(text, LINEAR[kind]), lambda m: CHECKS[kind](m["value"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["stop"].alias("stop")))
        found.append(F.when(text.rlike(HINTS[kind]), spans).otherwise(none))
    return F.array_sort(F.concat(*found))


def instances(text: Column) -> Column:
    """Tokens with a digit or an @, or their values: start, stop, core (without outer punctuation) and patterns: the two
    words before, in lower case; the shape, which begins with a tab; the name or the first letters, after a line feed."""
    def one(m):
        before = F.filter(F.split(F.lower(m["gap"]), SPACES), lambda w: w != "")
        name = F.regexp_extract(m["value"], NAME, 0)
        value = m["value"].substr(F.length(name) + 1, F.length(m["value"]))
        lead = F.length(m["value"]) - F.length(F.regexp_replace(value, "^[^A-Za-z0-9@+]++", ""))
        core = F.regexp_replace(value, OUTER, "")
        shaped = (F.length(core) <= SHAPE_MOST) & ~core.rlike("[A-Za-z]") & (F.length(_digits(core)) >= SHAPE_DIGITS)
        words, shape = F.when(F.size(before) >= 2, F.concat_ws(" ", F.slice(before, -2, 2))), F.when(shaped, F.concat(F.lit("\t"), F.regexp_replace(core, "[0-9]", "9")))
        words = F.when(name != "", F.concat(F.lit("\n"), F.lower(F.regexp_replace(name, "^[^A-Za-z]++", "")))).otherwise(words)
        head = F.when(core.rlike(LONG) & core.rlike(HEAD), F.concat(F.lit("\n"), F.substring(core, 1, 4)))
        return F.struct((m["start"] + lead).alias("start"), (m["start"] + lead + F.length(core)).alias("stop"), core.alias("core"), F.array_compact(F.array(words, shape, head)).alias("patterns"))

    return F.when(text.rlike("[0-9@]"), F.filter(F.transform(located(text, LINEAR_TOKEN), one), lambda x: (F.size(x["patterns"]) > 0) & (x["core"] != "")))


def firm_patterns(edges: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Patterns that SUPPORT different instances follow; if they are words, those that are followed by an instance in at
    least SHARE of all places where they stand, counted over all texts."""
    able = edges.groupBy("pattern").agg(F.count_distinct("core").alias("cores"), F.sum("n").alias("places")).where(F.col("cores") >= SUPPORT)
    able = scratch.keep(able.withColumn("h", F.xxhash64("pattern")))
    shapes = able.where(F.col("pattern").rlike("^[\t\n]")).select("pattern")
    able = able.where(~F.col("pattern").rlike("^[\t\n]"))
    # What stands in the texts that hold instances is a lower bound, and leaves few patterns to count in all texts.
    for texts in (docs.where(F.col("text").cast("string").rlike("[0-9@]")), docs):
        able = scratch.keep(able.join(_stands(texts, able), "h").where(F.col("places") >= SHARE * F.col("all")).select("pattern", "places", "h"))
    return able.select("pattern").union(shapes)


def _stands(docs: DataFrame, able: DataFrame) -> DataFrame:
    """h, all: the number of places where the two words of each pattern of able stand."""
    words = F.filter(F.split(F.lower(F.col("text").cast("string")), SPACES), lambda w: w != "")
    pairs = docs.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda x, y: F.xxhash64(F.concat(x, F.lit(" "), y)))).alias("h"))
    hashes = able.select("h").distinct()
    if able.count() <= MOST_BROADCAST:  # 8 bytes each
        return pairs.join(F.broadcast(hashes), "h").groupBy("h").agg(F.count("*").alias("all"))
    # sums in each task before anything is shuffled
    return pairs.groupBy("h").agg(F.count("*").alias("all")).join(hashes, "h")


def trusted_patterns(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """pattern, kind of the trusted patterns. edges: pattern, core, kind (of the seed, or null), of firm patterns alone."""
    trusted, known, n = None, edges, 0
    while True:
        seeds = known.where("kind is not null").groupBy("pattern", "kind").agg(F.count_distinct("core").alias("seeds")).where(F.col("seeds") >= SUPPORT)
        told = F.when(~F.col("pattern").startswith("\t") | F.col("kind").isNotNull(), F.col("core"))
        all_of = known.groupBy("pattern").agg(F.count_distinct(told).alias("cores"))
        rated = seeds.join(all_of, "pattern").where(F.col("seeds") >= TRUST * F.col("cores"))
        found = rated.groupBy("pattern").agg(F.max_by("kind", F.struct("seeds", -F.col("kind"))).alias("kind"))
        if trusted is not None:  # what is trusted stays so
            found = trusted.union(found.join(trusted.select("pattern"), "pattern", "left_anti"))
        trusted = scratch.keep(found)
        if (now := trusted.count()) == n:
            return trusted
        n = now
        sure = F.col("core").contains("@") | (F.length(_digits(F.col("core"))) >= 4)
        learned = edges.where("kind is null").where(sure).join(trusted.withColumnRenamed("kind", "_k"), "pattern").groupBy("core").agg(F.min("_k").alias("_l"))
        known = scratch.keep(edges.join(learned, "core", "left").select("pattern", "core", F.coalesce("kind", "_l").alias("kind")))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans) and extra (spans) of every row of docs."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), base_spans(text).alias("base"), instances(text).alias("tokens")))
    token = found.where(F.size("tokens") > 0).select("doc_id", "own", "base", F.explode("tokens").alias("t"))
    touch = F.filter("base", lambda b: (b["start"] < F.col("t.stop")) & (F.col("t.start") < b["stop"]))
    token = token.select("doc_id", "own", "t.*", F.try_element_at(touch, F.lit(1))["kind"].alias("kind"))
    token = token.select("doc_id", "own", "start", "stop", "core", "kind", F.explode("patterns").alias("pattern"))
    seed = F.coalesce("kind", F.when(F.col("core").rlike(SECRET), F.lit(len(KINDS))))
    edges = scratch.keep(token.groupBy("pattern", "core").agg(F.max(seed).alias("kind"), F.count("*").alias("n")))
    firm = scratch.keep(firm_patterns(edges, docs, scratch))
    trusted = trusted_patterns(scratch.keep(edges.join(firm, "pattern", "left_semi")), scratch).withColumnRenamed("kind", "as")
    spans = token.where("kind is null").join(trusted, "pattern").groupBy("doc_id", "own", "start", "stop").agg(F.min("as").alias("as"))
    more = spans.groupBy("doc_id", "own").agg(F.array_sort(F.collect_list(F.struct("start", F.col("as").alias("kind"), F.col("stop")))).cast(SPAN).alias("extra"))
    joined = found.join(more.toDF("_id", "_own", "extra"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")), "left")
    return joined.select("doc_id", "base", F.coalesce("extra", F.array().cast(SPAN)).alias("extra"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, all spans, and how many the method added."""
    names = F.array(*[F.lit(k) for k in [*KINDS, "secret"]])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_added"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[list, list]]:
    """Base and extra spans (start, kind, stop) of each doc_id, by plain loops over the fixed patterns; for tests."""
    digits = lambda v: [int(c) for c in v if c in string.digits]
    luhn = lambda d: sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    good = {
        "email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v)), "phone": lambda v: 9 <= len(digits(v)) <= 15,
    }
    base, tokens, edges, stands, cores = {}, [], {}, Counter(), defaultdict(set)
    for i, t in rows:
        t = t or ""
        base[i] = sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], t) if good[kind](m[0]))
        words = [w for w in re.split(SPACES, t.lower()) if w]
        stands.update(f"{x} {y}" for x, y in zip(words, words[1:]))
        end = 0
        for m in re.finditer(TOKEN, t):
            before, end = [w for w in re.split(SPACES, t[end : m.start()].lower()) if w], m.end()
            name = re.match(NAME, m[0])
            value = m[0][name.end() :] if name else m[0]
            lead = len(m[0]) - len(re.sub("^[^A-Za-z0-9@+]+", "", value))
            core = re.sub("^[^A-Za-z0-9@+]+|[^A-Za-z0-9]+$", "", value)
            shapes = ["\t" + re.sub("[0-9]", "9", core)] if len(core) <= SHAPE_MOST and not re.search("[A-Za-z]", core) and len(digits(core)) >= SHAPE_DIGITS else []
            words = ["\n" + re.sub("^[^A-Za-z]+", "", name[0]).lower()] if name else [" ".join(before[-2:])] * (len(before) >= 2)
            heads = ["\n" + core[:4]] if re.search(LONG, core) and re.search(HEAD, core) else []
            for pattern in words + shapes + heads if core else []:
                start, stop = m.start() + lead, m.start() + lead + len(core)
                kind = next((k for a, k, b in base[i] if a < stop and start < b), None)
                tokens.append((i, start, stop, pattern, core, kind))
    for _, _, _, pattern, core, kind in tokens:
        kind = len(KINDS) if kind is None and re.search(SECRET, core) else kind
        old, n = edges.get((pattern, core), (None, 0))
        edges[pattern, core] = (kind if old is None else old if kind is None else max(old, kind), n + 1)
        cores[pattern].add(core)
    places = Counter()
    for (pattern, _), (_, n) in edges.items():
        places[pattern] += n
    firm = {p for p in cores if len(cores[p]) >= SUPPORT and (p[0] in "\t\n" or places[p] >= SHARE * stands[p])}
    edges = {e: k for e, (k, _) in edges.items() if e[0] in firm}
    trusted, learned = {}, {}
    while True:
        known = {e: learned.get(e[1]) if k is None else k for e, k in edges.items()}
        seeds = Counter((p, k) for (p, _), k in known.items() if k is not None)
        of = Counter(p for (p, _), k in known.items() if k is not None or p[0] != "\t")
        rated = sorted((n, -k, p) for (p, k), n in seeds.items() if n >= SUPPORT and n >= TRUST * of[p] and p not in trusted)
        if not rated:
            break
        trusted |= {p: -k for n, k, p in rated}
        learned = {}
        for (pattern, core), kind in edges.items():
            if kind is None and pattern in trusted and ("@" in core or len(digits(core)) >= 4):
                learned[core] = min(learned.get(core, 9), trusted[pattern])
    extra: dict[int, dict] = {i: {} for i in base}
    for i, a, b, p, _, kind in tokens:
        if kind is None and p in trusted:
            extra[i][a, b] = min(extra[i].get((a, b), 9), trusted[p])
    return {i: (base[i], sorted((a, k, b) for (a, b), k in extra[i].items())) for i in base}
