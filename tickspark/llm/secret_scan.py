"""Secret scans through a trigram inverted index, with DataFrame operations only.

Each rule's regular expression is analysed on the driver into a Boolean query over trigrams that every match must
hold. Postings (trigram, document) are built for the trigrams that the rules ask for, intersected per document, and
the rules run only on their candidates. A rule with no mandatory trigram scans every text. Postings move, texts do not.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import split_by, written
from tickspark.llm.lines import let


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern (the same in Java, RE2 and Python) whose group has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds that results must report.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ with 16 characters or more
)
#: Kinds added to them.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A Boolean query: any of the sets, all trigrams of a set; None asks for nothing.
Query = frozenset[frozenset[str]] | None
#: Strings that an expression may stand for, before the analysis cuts there.
MOST_STRINGS = 64


def either(queries: Iterable[Query]) -> Query:
    found = list(queries)
    return None if any(q is None for q in found) else _least(s for q in found for s in q)


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least(x | y for x, y in product(a, b))


def _least(sets: Iterable[frozenset[str]]) -> frozenset[frozenset[str]]:
    """Without sets that hold another: the other already admits what they admit."""
    kept: list[frozenset[str]] = []
    for s in sorted(set(sets), key=lambda x: (len(x), sorted(x))):
        if not any(k <= s for k in kept):
            kept.append(s)
    return frozenset(kept)


def of_strings(strings: Iterable[str]) -> Query:
    """Query that admits every text holding one of the strings."""
    found = list(strings)
    if any(len(s) < 3 for s in found):
        return None
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in found)


def trigram_query(pattern: str) -> Query:
    """Boolean trigram query, in lower case, that the lower-cased text of every match fulfils."""
    strings, query = _walk(re._parser.parse(pattern))
    return both(query, of_strings(strings))


def _walk(nodes) -> tuple[set[str], Query]:
    """(strings that the end of the expression spells exactly since the last cut, query of all before it)."""
    ends, query = {""}, None

    def cut():
        nonlocal ends, query
        query = both(query, of_strings(ends))
        ends = {""}

    for op, arg in nodes:
        name = str(op)
        exact: set[str] | None = None
        inner: Query = None
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "IN":
            exact = _characters(arg)
        elif name == "SUBPATTERN":
            exact, inner = _whole(arg[-1])
        elif name == "BRANCH":
            parts = [_whole(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            else:
                inner = either(both(q, of_strings(e) if e is not None else None) for e, q in parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            once, inner_once = _whole(body)
            if once is not None and (low, int(high)) == (0, 1):
                exact = {"", *once}
            elif low:
                inner = inner_once if once is None else of_strings(once)
        elif name == "AT":
            continue
        if exact is not None and len(ends) * len(exact) <= MOST_STRINGS:
            ends = {a + b for a, b in product(ends, exact)}
        else:
            cut()
            query = both(query, inner)
            if exact is not None and len(exact) <= MOST_STRINGS:
                ends = exact
    return ends, query


def _whole(nodes) -> tuple[set[str] | None, Query]:
    """(all strings of an expression, None) if they are few, else (None, its query)."""
    strings, query = _walk(nodes)
    plain = query is None and all(str(op) in ("LITERAL", "IN", "SUBPATTERN", "BRANCH", "AT") or (str(op) == "MAX_REPEAT" and (arg[0], int(arg[1])) == (0, 1)) for op, arg in nodes)
    if plain and strings != {""}:
        return strings, None
    return None, both(query, of_strings(strings))


def _characters(members) -> set[str] | None:
    out: set[str] = set()
    for op, arg in members:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < 8:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def postings(docs: DataFrame, trigrams: Iterable[str]) -> DataFrame:
    """(trigram, id, mark): the documents (id, mark, text) that hold each of the trigrams, in either case."""
    asked = F.array(*[F.lit(t) for t in sorted(trigrams)])
    held = let(F.lower("text"), lambda low: F.filter(asked, lambda t: F.contains(low, t)))
    return docs.select(F.explode(held).alias("trigram"), "id", "mark")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, mark, kinds): the intersected postings of each document, as the kinds whose query they fulfil."""
    held = index.groupBy("id", "mark").agg(F.collect_set("trigram").alias("held"))
    fulfilled = [F.when(_any(q), F.lit(kind)) for kind, q in queries.items() if q is not None]
    return held.select("id", "mark", F.array_compact(F.array(*fulfilled)).alias("kinds")).filter(F.size("kinds") > 0)


def _any(query: Query) -> Column:
    out = F.lit(False)
    for s in sorted(query, key=sorted):
        one = F.lit(True)
        for t in sorted(s):
            one &= F.array_contains("held", t)
        out |= one
    return out


#: Type of the spans of one rule.
SPANS = "array<struct<start:int,nth:int,end:int,kind:string,size:int>>"
#: Matches whose lengths are summed one by one; whole runs of so many are summed once.
RUN = 128


def before(sizes: Column) -> Column:
    """Sum of all earlier elements for each element of an array that is not empty: in runs, so that long arrays cost little more."""
    add = lambda a, b: a + b
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    run = lambda k: F.floor(k / RUN).cast("int")
    count = run(F.size(sizes) - 1)
    sums = F.transform(F.sequence(F.lit(0), count), lambda b: total(F.slice(sizes, b * RUN + 1, F.lit(RUN))))
    bases = let(sums, lambda xs: F.transform(xs, lambda _, b: total(F.slice(xs, F.lit(1), b))))
    return let(bases, lambda base: F.transform(sizes, lambda _, k: F.get(base, run(k)) + total(F.slice(sizes, run(k) * RUN + 1, k % RUN))))


def spans(text: Column, rule: Rule, nth: int) -> Column:
    """array<struct(start, nth, end, kind)> of the rule's matches in text, in code points.

    Positions come from the lengths of the matches and of the pieces between them.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    lengths = F.transform(found, F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else lengths
    # the piece after the last match belongs to none
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), lengths, lambda gap, n: F.length(gap) + n)

    def placed(lens: Column) -> Column:
        one = lambda x: F.struct((x["at"] + x["step"] - x["len"]).alias("start"), F.lit(nth).alias("nth"), (x["at"] + x["step"]).alias("end"), F.lit(rule.kind).alias("kind"), x["size"].alias("size"))
        told = lambda s: F.arrays_zip(before(s).alias("at"), s.alias("step"), lens.alias("len"), (sizes if rule.group else lens).alias("size"))
        return let(steps, lambda s: let(told(s), lambda z: F.transform(z, one)))

    some = F.size(lengths) > 0
    return F.filter(F.when(some, let(lengths, placed)).otherwise(F.array().cast(SPANS)), lambda x: x["size"] >= rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct(start, nth, end, kind, size)>) per row, by start and then in the order of the rules.

    A null text is an empty one. Rows with equal id and text have equal spans; null ids are matched like any other. An
    empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows, mark = docs.select(F.col(id_col).alias("id"), text.alias("text")), F.xxhash64("text")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {t for q in queries.values() if q is not None for s in q for t in s}
    none = F.array().cast("array<string>")
    if asked:
        found = written(candidates(postings(rows.withColumn("mark", mark), asked), queries), "candidates").toDF("c_id", "c_mark", "kinds")
        # only rows that may be candidates move; all others are scanned where they stand
        some, rest = split_by(rows, F.xxhash64("id"), found.select(F.xxhash64("c_id")))
        some = some.withColumn("mark", mark).join(found, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark")), "left").select("id", "text", "kinds")
        rows = some.unionByName(rest.withColumn("kinds", none))
    else:
        rows = rows.withColumn("kinds", none)
    parts = []
    for nth, rule in enumerate(rules):
        there = spans(F.col("text"), rule, nth)
        parts.append(there if queries[rule.kind] is None else F.when(F.array_contains("kinds", rule.kind), there).otherwise(F.array().cast(SPANS)))
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of scan()'s rows."""
    base = [r.kind for r in BASE]
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, base), F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def sql() -> str:
    """The same scan in DuckDB SQL, without an index."""
    quoted = lambda x: x.replace("'", "''")
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS nth, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{quoted(r.pattern)}') AS m, "
        f"regexp_extract_all(text, '{quoted(r.pattern)}', {r.group}) AS g, string_split_regex(text, '{quoted(r.pattern)}') AS gaps FROM d"
        for n, r in enumerate(BASE + MORE)
    )
    told = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS ({kinds}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a),
p AS (SELECT doc_id, nth, kind, length(g[i]) >= least AS ok, length(m[i]) AS n,
             CAST(list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS BIGINT) AS s FROM i),
f AS (SELECT doc_id, nth, kind, s, s + n AS e FROM p WHERE ok),
r AS (SELECT doc_id, {counts}, coalesce(string_agg({told}, ',' ORDER BY s, nth) FILTER (WHERE nth < {len(BASE)}), '') AS base, string_agg({told}, ',' ORDER BY s, nth) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)
"""
