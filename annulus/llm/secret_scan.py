"""Secret scans through a trigram index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: clauses that must all hold, each a choice of
trigram sets. Postings of the trigrams that some query names are built (lower case), joined with the queries and
counted, which intersects them; documents that satisfy a rule's query are its candidates, and the rule's expression
is run on these alone. A rule without mandatory trigrams is run on every document. Candidates may be too many, never
too few, so results equal those of running every rule on every document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import free_names, text_key

MOST_STRINGS, MOST_GRAMS, BLOCK = 24, 2, 64
#: English letters from the most to the least common: fixed values, to tell which trigrams are seldom.
COMMON = "etaoinshrdlcumwfgypbvkjxqz"
Query = list[list[frozenset[str]]]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and not overlapping, whose group is of least characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


#: The first three are the base kinds; the others are added. Java matches repeated groups by recursion and tries each start, so
#: groups repeat a bounded number of times, and what a failed match may scan again begins at a boundary only.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,20} ){0,6}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]{1,20} ){0,6}PRIVATE KEY-----)?)", 0, 1),
    Rule("web", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
)
BASE = ("assign", "access", "hex")


def _trigrams(text: str) -> frozenset[str]:
    """The MOST_GRAMS trigrams of text whose letters are least common; whatever holds text holds them."""
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    return frozenset(sorted(grams, key=lambda g: -sum(COMMON.find(c) % 27 for c in g))[:MOST_GRAMS])


def trigram_query(pattern: str) -> Query:
    """Clauses (all must hold) of trigram sets (one must be there whole); none: no trigram is mandatory."""
    clauses: Query = []

    def need(strings: set[str]) -> None:
        if all(len(s) >= 3 for s in strings):
            clauses.append(sorted({_trigrams(s) for s in strings}, key=sorted))

    def walk(items, run: set[str]) -> set[str]:
        """The strings that what was read last can end with exactly, from those before; what can't be kept is required."""
        for op, arg in items:
            known = one(op, arg)
            if known is not None and len(run) * len(known) <= MOST_STRINGS:
                run = {a + b for a in run for b in known}
                continue
            if op is C.SUBPATTERN and known is None:
                run = walk(arg[3], run)
                continue
            if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] and (inner := exact(arg[2])) and len(run) * len(inner) <= MOST_STRINGS:
                run = {a + b for a in run for b in inner}
            need(run)
            run = {""}
        return run

    def exact(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            known = one(op, arg)
            if known is None or len(out) * len(known) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in known}
        return out

    def one(op, arg) -> set[str] | None:
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and all(x[0] is C.LITERAL for x in arg) and len(arg) <= 8:
            return {chr(x[1]).lower() for x in arg}
        if op is C.AT:
            return {""}
        if op is C.SUBPATTERN:
            return exact(arg[3])
        if op is C.BRANCH:
            parts = [exact(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 2 and (inner := exact(arg[2])):
            out = set()
            for times in range(arg[0], arg[1] + 1):
                strings = {""}
                for _ in range(times):
                    strings = {a + b for a in strings for b in inner}
                out |= strings
            return out if len(out) <= MOST_STRINGS else None
        return None

    need(walk(list(_parser.parse(pattern)), {""}))
    return clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``docs(doc_id, _text_key, text)`` -> (doc_id, _text_key, trigram), for these trigrams, in lower case."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("doc_id", "_text_key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, _text_key, kinds array<string>): the rules whose trigram query each text satisfies; others are absent."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    terms = [(kind, c, a, t, len(grams)) for kind, q in queries.items() for c, clause in enumerate(q) for a, grams in enumerate(clause) for t in sorted(grams)]
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(terms or [("", 0, 0, "", 1)], "kind string, clause int, choice int, trigram string, need int"))  # as many as the rules hold
    sizes = F.broadcast(spark.createDataFrame([(k, len(q)) for k, q in queries.items()] or [("", 1)], "kind string, clauses int"))
    met = postings(docs, sorted({t[3] for t in terms}) or [""]).join(wanted, "trigram")
    chosen = met.groupBy("doc_id", "_text_key", "kind", "clause", "choice", "need").agg(F.count_distinct("trigram").alias("n")).where("n = need")
    whole = chosen.groupBy("doc_id", "_text_key", "kind").agg(F.count_distinct("clause").alias("n")).join(sizes, "kind").where("n = clauses")
    return whole.groupBy("doc_id", "_text_key").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _parts(text: Column, rule: Rule, then: Callable[[Column, Column, Column], Column]) -> Column:
    """then(what lies between the matches, one more than they are; the matches; the group that counts of each)."""
    pattern = F.lit(rule.pattern)

    def given(whole: Column) -> Column:
        values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
        return then(F.split(text, rule.pattern, -1), whole, values)

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), given)


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of a rule's matches in code points; kind is the rule's name.

    Lengths are added up in blocks of ``BLOCK`` matches, then over the blocks, so that no long array grows match by match.
    """
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")

    def step(acc, x):
        first = acc["at"] + x["gap"]
        span = F.struct(first.alias("start"), F.lit(rule.kind).alias("kind"), (first + x["n"]).alias("end"))
        return F.struct((first + x["n"]).alias("at"), F.when(x["v"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def blocks(sizes: Column) -> Column:
        last = F.floor(F.greatest(F.size(sizes) - 1, F.lit(0)) / BLOCK).cast("int")
        empty = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), empty, step))

    def placed(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(found, start, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = lambda s, base: F.struct((s["start"] + base).alias("start"), s["kind"].alias("kind"), (s["end"] + base).alias("end"))
        return F.flatten(F.zip_with(found, bases, lambda x, base: F.transform(x["out"], lambda s: moved(s, base))))

    def lengths(between: Column, whole: Column, values: Column) -> Column:
        matched = F.arrays_zip(whole.alias("m"), values.alias("v"))
        return F.zip_with(F.slice(between, F.lit(1), F.size(whole)), matched, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["m"]).alias("n"), F.length(m["v"]).alias("v")))

    return _let(_let(_parts(text, rule, lengths), blocks), placed)


def _with_kinds(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, str]:
    """docs with a column of the name returned: the rules of which each row is a candidate, rules without trigrams aside (null: of none)."""
    own, kinds, doc, of = free_names(docs, "_text_key", "_kinds", "_doc", "_of")
    keyed = docs.withColumn(own, text_key())
    found = candidates(keyed.select("doc_id", F.col(own).alias("_text_key"), "text"), rules)
    found = found.select(F.col("doc_id").alias(doc), F.col("_text_key").alias(of), F.col("kinds").alias(kinds))
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found[doc]) & (keyed[own] == found[of]), "left").drop(doc, of, own), kinds


def _applies(rule: Rule, text: Column, kinds: str) -> Column:
    return F.array_contains(F.col(kinds), rule.kind) if trigram_query(rule.pattern) else text.rlike(_long_enough(rule))


def _long_enough(rule: Rule) -> str:
    """For a rule that is one repeated class, the same with its least length; else the rule's own expression."""
    return rule.pattern[:-1] + "{%d,}" % rule.least if rule.pattern.endswith("]+") and rule.pattern.count("[") == 1 and rule.pattern.startswith("[") else rule.pattern


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with ``secrets array<struct<start, kind, end>>`` by start, then by the rules' order.

    Positions are code points, the end exclusive; kinds may overlap. Null and empty texts hold none. Repeated rows and
    rows with a null doc_id are scanned like any other. A text of any length is scanned whole, each rule in time that
    grows with the length. A column of that name is replaced; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    marked, kinds = _with_kinds(docs, rules)
    every = F.concat(*[F.when(_applies(r, text, kinds), _spans(text, r)).otherwise(none) for r in rules])
    sortable = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["kind"].alias("kind"), s["end"].alias("end"))))
    found = F.transform(sortable, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return marked.withColumn("secrets", found).drop(kinds)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    found = find_secrets(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret's counted group replaced by mark; rows and columns stay, n_chars (if any) is set anew.

    Null and empty texts stay as they are; repeated rows and rows with a null doc_id are masked like any other; rules apply
    one after the other to the whole text, of any length. An empty table gives an empty result.
    """
    out, kinds = _with_kinds(docs, rules)
    for rule in rules:
        text = F.col("text")

        def masked(between: Column, whole: Column, values: Column, least: int = rule.least) -> Column:
            kept = F.zip_with(whole, values, lambda m, v: F.when(F.length(v) >= least, F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(v)), F.lit(mark))).otherwise(m))
            return F.array_join(F.zip_with(between, kept, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")

        applies = text.isNotNull() & F.coalesce(_applies(rule, text, kinds), F.lit(False))
        out = out.withColumn("text", F.when(applies, _parts(text, rule, masked)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
