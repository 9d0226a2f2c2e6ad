"""Secret scan over a trigram inverted index, with DataFrame functions only.

1. From each rule's regular expression a Boolean trigram query is derived: the literal text
   that every match must hold, cut into trigrams; strings of one alternative are joined by
   AND, alternatives by OR. Trigrams are ASCII lower case.
2. The inverted index holds, for every trigram that a query asks for, the rows whose text
   has it: posting lists by block of rows, so that no list grows with the table.
3. Each query is answered by intersecting and uniting posting lists of a block. What is left
   are candidates, rule by rule; a candidate need not match.
4. Candidates are verified with the regular expression itself. Rules without a mandatory
   trigram (runs of hexadecimal digits) scan every text.

Places are code points: the text between matches and the matches themselves are measured and
summed, in blocks of ``CHUNK`` matches, so that the work stays near the number of matches.

Candidates are told by a hash of key and text; two rows that share it only share candidates,
as every row is verified on its own text.

Cases: null and empty texts have no spans; repeated rows are all returned; an empty table
gives an empty result; other columns are ignored. Spans of one start are in the order of the
rules; spans of different kinds may overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.textio import ascii_lower
from flowlens.session import stage

#: Rows of a block of the index, about.
BLOCK = 256
CHUNK = 256
#: Strings that a query follows at once, and members of a class that are told apart.
STRINGS, MEMBERS = 64, 8


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least`` is the length of ``group`` from which a match counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base patterns, and published formats of keys.
RULES = (
    Rule("assign", rf"({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20:/@]{1,64}:[^\x00-\x20:/@]{1,64}@"),
)

# --- from a regular expression to a trigram query

#: A query: True (any text), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _and(parts: Iterable[Query]) -> Query:
    flat: set[Query] = set()
    for p in parts:
        flat |= set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p}
    flat.discard(True)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _or(parts: Iterable[Query]) -> Query:
    flat: set[Query] = set()
    for p in parts:
        flat |= set(p[1]) if isinstance(p, tuple) and p[0] == "or" else {p}
    if True in flat or not flat:
        return True
    needs = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in flat}
    flat = {p for p in flat if not any(needs[o] < needs[p] for o in flat)}  # a weaker demand takes in a stronger one
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _has_any(strings: set[str]) -> Query:
    return _or(_and(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The strings that a part can be, where these are few, and what any text of it holds."""
    run: set[str] = {""}
    held: list[Query] = []
    exact = True
    for op, arg in tree:
        op = str(op)
        own: set[str] | None = None
        query: Query = True
        if op == "LITERAL":
            own = {chr(arg).lower() if arg < 128 else chr(arg)}
        elif op == "IN":
            ranges = [(a, a) if str(k) == "LITERAL" else a if str(k) == "RANGE" else None for k, a in arg]
            if None not in ranges and sum(b - a + 1 for a, b in ranges) <= 2 * MEMBERS:
                chars = {chr(c).lower() if c < 128 else chr(c) for a, b in ranges for c in range(a, b + 1)}
                own = chars if len(chars) <= MEMBERS else None
        elif op == "SUBPATTERN":
            own, query = _walk(arg[3])
        elif op == "BRANCH":
            ways = [_walk(w) for w in arg[1]]
            if all(w[0] is not None for w in ways):
                own = set().union(*(w[0] for w in ways))
            query = _or(w[1] for w in ways)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            sub, query = _walk(inner)
            query = query if least else True
            if sub is not None and (least, most) in ((0, 1), (1, 1)):
                own = sub | {""} if not least else sub
        elif op == "AT":
            own = {""}
        if own is None:
            held += [_has_any(run), query]
            run, exact = {""}, False
        elif len(run) * len(own) > STRINGS:
            held.append(_has_any(run))
            run, exact = own, False
        else:
            run = {a + b for a, b in product(run, own)}
    held.append(_has_any(run))
    return (run if exact else None), _and(held)


def trigram_query(pattern: str) -> Query:
    """What trigrams, in ASCII lower case, a text needs for a match; True if the pattern demands none."""
    return _walk(re._parser.parse(pattern))[1]


def grams_of(query: Query) -> set[str]:
    if isinstance(query, bool):
        return set()
    return {query} if isinstance(query, str) else set().union(*(grams_of(q) for q in query[1]))


# --- index and search


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def postings(docs: DataFrame, grams: Iterable[str], text: str = "text", blocks: int = 1) -> DataFrame:
    """The inverted index: block, gram, rows. ``docs`` has the row number ``row`` and the text."""
    wanted = F.array(*[F.lit(g) for g in sorted(grams)]).cast("array<string>")
    held = _let(ascii_lower(F.col(text)), lambda t: F.filter(wanted, lambda g: F.contains(t, g)))
    block = F.pmod("row", F.lit(blocks)).cast("long").alias("block")
    return docs.select("row", block, F.explode(held).alias("gram")).groupBy("block", "gram").agg(F.collect_set("row").alias("rows"))


def _answer(query: Query, lists: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(lists, F.lit(query)), F.array().cast("array<bigint>"))
    parts = [_answer(q, lists) for q in sorted(query[1], key=repr)]
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, parts)


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """row, rules: the rules whose query the postings of a row fulfil."""
    block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("lists"))
    found = F.array(*[F.struct(F.lit(n).alias("rule"), _answer(q, F.col("lists")).alias("rows")) for n, q in queries.items()])
    each = block.select(F.explode(found).alias("f")).select("f.rule", F.explode("f.rows").alias("row"))
    return each.groupBy("row").agg(F.collect_list("rule").alias("rules"))


# --- verification


def _starts(gaps: Column, sizes: Column) -> Column:
    """Start of each match: all gaps and matches before it, and its own gap."""
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, s: F.struct(g.alias("gap"), (g + s).alias("step")))
    add = lambda a, x: a + x["step"]
    zero = F.lit(0).cast("long")

    def body(v: Column) -> Column:
        chunks = F.transform(F.sequence(zero, F.floor((F.size(v) - 1) / CHUNK)), lambda b: F.aggregate(F.slice(v, (b * CHUNK + 1).cast("int"), F.lit(CHUNK)), zero, add))
        before = lambda c: F.transform(c, lambda _, i: F.aggregate(F.slice(c, F.lit(1), i), zero, lambda a, x: a + x))

        def place(x: Column, i: Column, at: Column) -> Column:
            own = F.floor(i / CHUNK).cast("int")
            return F.get(at, own) + F.aggregate(F.slice(v, own * CHUNK + 1, i - own * CHUNK), zero, add) + x["gap"]

        return _let(_let(chunks, before), lambda at: F.transform(v, lambda x, i: place(x, i, at)))

    return _let(steps, body)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind, end) of the matches of a rule that count; leftmost, without overlaps."""
    pattern = F.lit(rule.pattern)
    kind = F.lit(number)

    def body(m: Column) -> Column:
        sizes, counted = F.transform(m["hits"], lambda h: F.length(h).cast("long")), F.transform(m["parts"], lambda h: F.length(h) >= rule.least)
        gaps = F.transform(m["gaps"], lambda g: F.length(g).cast("long"))
        all_ = F.zip_with(_starts(gaps, sizes), sizes, lambda a, s: F.struct(a.alias("start"), kind.alias("kind"), (a + s).alias("end")))
        return F.filter(all_, lambda _, i: F.get(counted, i)) if rule.least else all_

    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("parts"), F.split(text, rule.pattern, -1).alias("gaps"))
    return F.when(text.rlike(rule.pattern), _let(found, body))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: key, n_<kind> of the base kinds, base_sha256, spans."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "text"))
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    indexed = {n: q for n, q in queries.items() if q is not True}
    blocks = max(1, docs.count() // BLOCK)
    index = postings(rows, set().union(*map(grams_of, indexed.values())), "text", blocks)
    found = stage(candidates(index, indexed), "secret-candidates")
    told = rows.join(found, "row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    each = []
    for n, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, n)
        each.append(F.coalesce(F.when(F.array_contains("rules", n), spans) if n in indexed else spans, none))
    told = told.select("id", F.array_sort(F.concat(*each)).alias("all"))
    base = [n for n, r in enumerate(rules) if r.base]
    told = told.withColumn("base", F.filter("all", lambda s: s["kind"].isin(base)))
    names = F.array(*[F.lit(r.kind) for r in rules])
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    counts = [count(n).alias(f"n_{rules[n].kind}") for n in base]
    return told.select(F.col("id").alias(key), *counts, F.sha2(join("base").cast("binary"), 256).alias("base_sha256"), join("all").alias("spans"))
