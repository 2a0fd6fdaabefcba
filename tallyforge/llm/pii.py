"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of strict patterns (e-mail, IP, card and phone numbers). The words around seeds
give lexical patterns; addresses and groups of digits that stand in the same patterns are candidate
instances. Patterns and instances form a graph, scored in rounds: a pattern by the mean score of its
instances, an instance by the chance that one of its patterns holds. Seeds stay at one. Instances that
high-confidence patterns support, and whose form suits the kind, are added as spans wherever they stand.

A match's place comes from `split` by the same expression: gaps and matches alternate, so their lengths
add up to starts, by blocks of BLOCK. All quantifiers that could loop are possessive: no backtracking over
long texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed, small_enough

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns, in the syntax of java.util.regex; (?:\G|...) starts at a run's begin or where a match has ended.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What may be an identifier: an address, or groups of digits with what stands within numbers, apart by single blanks.
CANDIDATE = r"(?<![A-Za-z0-9._%+@-])(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9._-]++|\+?\(?[0-9][0-9A-Fa-f:.()/-]*+(?: \(?[0-9][0-9.()/-]*+)*+)"
#: Characters of context that are kept before and after a match.
LEFT, RIGHT = 64, 32
#: Rounds of scoring, distinct seeds that a pattern needs, least scores of patterns and of instances.
ROUNDS, SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 3, 0.5, 0.5
#: Matches whose lengths are added up together, and patterns or instances that a broadcast may hold.
BLOCK, BROADCAST = 256, 100_000

_NO_SPANS = "array<struct<rank:int,start:int,end:int,value:string,l:string,r:string>>"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.concat(F.lit("0"), F.substring(F.regexp_replace(p, "^0+", ""), 1, 4)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _is_valid(kind: str):
    return lambda s: _valid(kind, s["value"])


def _has_rank(rank: int):
    return lambda s: s["rank"] == rank


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, begin: Column) -> Column:
    none = F.array().cast("array<int>")

    def add(state: Column, x: Column) -> Column:
        return F.struct((state["at"] + x).alias("at"), F.concat(state["all"], F.array(state["at"] + x)).alias("all"))

    return F.aggregate(values, F.struct(begin.alias("at"), none.alias("all")), add, lambda s: s["all"])


def _sums(lengths: Column) -> Column:
    """The sums of a (not empty) array's elements up to each; an array grows within a block only, so time is linear."""

    def block(n: Column, b: Column) -> Column:
        return F.slice(n, b * BLOCK + 1, F.lit(BLOCK))

    def by_blocks(n: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int"))
        wholes = _running(F.transform(blocks, lambda b: F.aggregate(block(n, b), F.lit(0), lambda x, y: x + y)), F.lit(0))
        return _let(F.concat(F.array(F.lit(0)), wholes), lambda begins: F.flatten(F.transform(blocks, lambda b: _running(block(n, b), F.element_at(begins, b + 1)))))

    return _let(lengths, by_blocks)


def _places(rank: int, matches: Column, gaps: Column) -> Column:
    """The matches with their places and contexts; gaps has one element more than matches."""
    pairs = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("l"), F.slice(gaps, F.lit(2), F.size(matches)).alias("r"))
    ends = _sums(F.transform(pairs, lambda p: (F.length(p["l"]) + F.length(p["m"])).cast("int")))

    def span(p: Column, end: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), (end - F.length(p["m"])).cast("int").alias("start"), end.alias("end"), p["m"].alias("value"), F.right(p["l"], F.lit(LEFT)).alias("l"), F.left(p["r"], F.lit(RIGHT)).alias("r"))

    return F.when(F.size(matches) > 0, F.zip_with(pairs, ends, span)).otherwise(F.array().cast(_NO_SPANS))


def _key(docs: DataFrame) -> Column:
    """Equal for rows of equal doc_id and text only."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))))


def base_spans(docs: DataFrame, candidates: bool = False) -> DataFrame:
    """docs with __base (spans of the strict patterns, by kind and start) and, if asked for, __candidates.

    A null text has no spans. Of the columns only `text` is read; it stays.
    """
    text = F.coalesce("text", F.lit(""))
    guard = {"email": text.contains("@"), "phone": text.contains("+")}
    patterns = STRICT | ({"candidate": CANDIDATE} if candidates else {})
    empty = F.array().cast("array<string>")
    out = docs.withColumns({f"__m_{k}": F.when(guard.get(k, F.lit(True)), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(empty) for k, p in patterns.items()})
    out = out.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(text, p, -1)).otherwise(empty) for k, p in patterns.items()})
    out = out.withColumns({f"__s_{k}": _places(i, F.col(f"__m_{k}"), F.col(f"__g_{k}")) for i, k in enumerate(patterns)})
    base = F.concat(*[F.filter(f"__s_{k}", _is_valid(k)) for k in STRICT])
    out = out.withColumn("__base", base)
    if candidates:
        out = out.withColumn("__candidates", F.col("__s_candidate"))
    return out.drop(*[f"__{x}_{k}" for x in "mgs" for k in patterns])


def _contexts(left: Column, right: Column) -> Column:
    """The lexical patterns around a place: three words or two before; one before and one after; a label before; a label and a word after.

    A label ends with : = or #, and quotes or brackets may follow. The word right before must have a letter, so
    that separators alone are no pattern.
    """
    left, right = F.lower(left), F.lower(right)
    three, two, one = (F.regexp_replace(F.regexp_extract(left, rf"(?<!\S)(\S+(?:\s+\S+){{{n}}})[\s(]*$", 1), r"\s+", " ") for n in (2, 1, 0))
    after, label = F.regexp_extract(right, r"^[\s)]*(\S+)", 1), F.regexp_extract(left, r"""([^\s:=#"'(,;|]+)["']?\s*[:=#]+[\s"'(\[<]*$""", 1)
    word = one.rlike(r"\p{L}")
    both = [F.when((three != "") & word, F.concat(F.lit("3:"), three)), F.when((two != "") & word, F.concat(F.lit("2:"), two)), F.when(word & (after != ""), F.concat(F.lit("a:"), one, F.lit(" _ "), after)), F.when(label != "", F.concat(F.lit("l:"), label)), F.when((label != "") & (after != ""), F.concat(F.lit("b:"), label, F.lit(" _ "), after))]
    return F.array_compact(F.array(*both))


def _suits(rank: Column, value: Column) -> Column:
    """Whether a candidate's form suits a kind."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    forms = {0: F.instr(value, "@") > 1, 1: value.rlike(r"^[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){2,7}$") & (digits >= 3), 2: digits.between(12, 19) & value.rlike("^[0-9 -]+$"), 3: digits.between(7, 15) & value.rlike(r"^\+?[0-9() ./-]+$")}
    out = F.lit(False)
    for k, form in forms.items():
        out = F.when(rank == k, form).otherwise(out)
    return out


def _tokens(found: DataFrame) -> DataFrame:
    """(key, start, end, value, instance, l, r): the candidates that overlap no base span, without punctuation around them."""
    token = found.select("key", "base", F.explode("candidates").alias("c"))
    token = token.where(~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start"))))
    value = F.regexp_replace("c.value", r"[^0-9A-Za-z]+$", "")
    token = token.select("key", F.col("c.start").alias("start"), value.alias("value"), F.col("c.l").alias("l"), F.col("c.r").alias("r")).where("value <> ''")
    return token.withColumns({"end": (F.col("start") + F.length("value")).cast("int"), "instance": F.lower("value")})


def induced(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(rank, pattern, seeds): the patterns that as many distinct seeds support."""
    seeds = found.select(F.explode("base").alias("s")).select("s.rank", F.lower("s.value").alias("instance"), F.explode(_contexts(F.col("s.l"), F.col("s.r"))).alias("pattern")).distinct()
    return seeds.groupBy("rank", "pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support)


def discovered(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, pattern_score: float = PATTERN_SCORE, instance_score: float = INSTANCE_SCORE) -> DataFrame:
    """(key, added): the spans that patterns add, from (key, base, candidates); added ones overlap no base span.

    A common pattern gathers in no task: patterns are broadcast while they are few (their rows are counted), and
    beyond that a join's large partitions are split.
    """
    patterns = checkpointed(induced(found, support))
    known = small_enough(patterns.select("rank", "pattern"), BROADCAST)
    seeds = found.select(F.explode("base").alias("s")).select("s.rank", F.lower("s.value").alias("instance"), F.explode(_contexts(F.col("s.l"), F.col("s.r"))).alias("pattern")).distinct()
    seeds = seeds.join(known, ["rank", "pattern"])
    token = _tokens(found)
    met = token.select("value", "instance", F.explode(_contexts(F.col("l"), F.col("r"))).alias("pattern")).join(known, "pattern").where(_suits(F.col("rank"), F.col("value")))
    edges = seeds.select("rank", "pattern", "instance", F.lit(1.0).alias("score")).unionByName(met.select("rank", "pattern", "instance", F.lit(0.0).alias("score")).distinct())
    edges, by_pattern = checkpointed(edges.groupBy("rank", "pattern", "instance").agg(F.max("score").alias("score"))), None
    for k in range(rounds):
        by_pattern = edges.groupBy("rank", "pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("weight"))
        held = F.when(F.col("weight") >= pattern_score, F.least("weight", F.lit(0.999))).otherwise(0.0)
        by_instance = edges.join(by_pattern, ["rank", "pattern"]).groupBy("rank", "instance").agg((1 - F.exp(F.sum(F.log(1 - held)))).alias("chance"))
        edges = edges.join(by_instance, ["rank", "instance"]).select("rank", "pattern", "instance", F.when(F.col("score") == 1.0, 1.0).otherwise(F.col("chance")).alias("score"))
        if k + 1 < rounds:
            edges = checkpointed(edges)
    good = edges.where(F.col("score") >= instance_score).join(by_pattern.where(F.col("weight") >= pattern_score), ["rank", "pattern"]).groupBy("instance").agg(F.min("rank").alias("rank"))
    good = small_enough(checkpointed(good), BROADCAST)
    hits = token.select("key", "start", "end", "value", "instance").join(good, "instance").where(_suits(F.col("rank"), F.col("value")))
    span = F.struct("rank", "start", "end", "value")
    return hits.groupBy("key").agg(F.collect_set(span).alias("added"))


def _found(docs: DataFrame) -> DataFrame:
    spans = base_spans(docs.select("doc_id", "text"), candidates=True)
    return checkpointed(spans.select(_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__base").alias("base"), F.col("__candidates").alias("candidates")))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for each row: arrays of (rank of the kind, start, end, value), by kind and start.

    Starts and ends count code points, ends exclusive. A null text is empty. Texts are searched whole, of any
    length. Rows that repeat a doc_id have spans each; rows that repeat in all have equal ones. An instance that
    patterns of several kinds support is of the kind listed first. Extra columns are not read. An empty table
    gives no rows.
    """
    found = _found(docs)
    joined = found.select("key", "doc_id", _plain(F.col("base")).alias("base")).join(discovered(found), "key", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return joined.select("doc_id", "base", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the base spans' digest and all spans, named."""
    counts = {f"n_{k}": F.size(F.filter("base", _has_rank(i))).cast("long") for i, k in enumerate(KINDS)}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in `text` replaced by its kind in brackets; all columns stay, whatever their names.

    Spans that overlap are replaced together, by the kind of the first. A null text stays null, an empty one
    empty. Texts are searched whole. Rows that repeat are redacted each; an empty table stays empty.
    """
    added = discovered(_found(docs))
    added = small_enough(checkpointed(added.select(F.col("key").alias("of"), "added")), BROADCAST)
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"))
    spans = base_spans(whole).withColumn("key", _key(whole)).join(added, F.col("key") == F.col("of"), "left")
    base = _plain(F.col("__base"))
    every = F.array_sort(F.transform(F.when(F.col("added").isNull(), base).otherwise(F.concat(base, "added")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))
    spans = spans.withColumn("spans", every)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        more = F.array(F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.element_at(marks, s["rank"] + 1))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, F.concat(state["out"], more)).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    redacted = F.aggregate("spans", begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    row = F.col("row").withField("`text`", F.when(F.size("spans") > 0, redacted).otherwise(F.col("text")))
    return spans.select(row.alias("row")).select("row.*")
