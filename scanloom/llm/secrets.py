"""Secret scans (operator 3) over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query: any of some clauses, each a
set of trigrams that a match must hold (letters folded to lower case). The index
holds a posting (trigram, document) for the trigrams of these queries; postings
are intersected per document and clause, and only candidates are matched against
the rule. A rule without mandatory trigrams is matched against every text.

Defined results: a null text counts as empty and has no spans; very long texts with
very many spans take little more than time in proportion (the sums over spans are
taken block by block); spans that start together are in the order of their kinds;
repeated rows and null ids keep a row each; an empty table gives no rows; the columns
of the input are read by name (doc_id, text) and others are ignored or, by ``redact``,
carried along in a struct, so their names can't clash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group has at least so many characters.
    group: int = 0
    least: int = 1
    base: bool = False


#: The kinds in their order. ``access`` and ``hex`` have their least
#: length in the pattern, which finds the same runs; ``assign`` can't, as a match
#: that is too short still uses up its characters.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\t\n\r ]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# The body of a private key as ``redact`` takes it, which need not have an END: header lines, lines of base64 (of any length, also indented,
# quoted or with written-out \\n), long runs of base64 between blanks, and the END line.
# Possessive loops neither go back nor recurse in Java, so no length is too much.
_BREAK = r"(?:[ \t]*+(?:\r?\n|\r|\\r\\n|\\n))++[ \t>#*]*+"
_BODY = (
    rf"(?:{_BREAK}(?:Proc-Type|DEK-Info|Key-Info|Content-Domain|Comment):(?:[^\r\n\\]|\\(?![rn]))*+)*+"
    rf"(?:(?:{_BREAK}|\s*+)[A-Za-z0-9+/]{{40,}}+=*+|{_BREAK}[A-Za-z0-9+/]++=*+(?=[ \t]*+(?:[\r\n\"']|\\[rn]|-----END|$))|\s++[A-Za-z0-9+/]++=*+(?=\s*+-----END))*+"
    rf"(?:(?:{_BREAK}|\s*+)-----END [A-Z ]{{0,40}}PRIVATE KEY-----)?+"
)
#: The rules that ``redact`` masks by: a private key with its body.
MASKED = tuple(Rule(r.kind, r.pattern.partition("(?:")[0] + _BODY) if r.kind == "pem" else r for r in RULES)

#: Alternatives beyond which a part of a pattern counts as unknown.
MOST = 64
GAP = "\0"


def _strings(tree) -> list[str]:
    """Strings that a match of ``tree`` is spelled as; GAP stands for anything."""
    out = [""]
    for op, arg in tree:
        if op is sre.LITERAL:
            own = [chr(arg).lower()]
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            own = sorted({chr(c).lower() for _, c in arg})
        elif op is sre.SUBPATTERN:
            own = _strings(arg[3])
        elif op is sre.BRANCH:
            own = [s for branch in arg[1] for s in _strings(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, part = arg
            inner = _strings(part)
            if (least, most) == (0, 1):
                own = ["", *inner]
            elif not least:
                own = [GAP]
            else:
                own = inner if least == most == 1 else [s + GAP for s in inner]
        elif op is sre.AT:
            own = [""]
        else:
            own = [GAP]
        if len(own) > MOST or len(out) * len(own) > MOST:
            own = [GAP]
        out = [a + b for a, b in itertools.product(out, dict.fromkeys(own))]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of which a match satisfies one; empty if the pattern has no mandatory trigrams."""
    clauses = []
    for s in _strings(parser.parse(pattern)):
        own = frozenset(run[i : i + 3] for run in s.split(GAP) for i in range(len(run) - 2))
        if not own:
            return []
        clauses.append(own)
    return [c for c in dict.fromkeys(clauses) if not any(o < c for o in clauses)]


#: Letters from the most frequent on; what isn't here is rarer still.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"
#: Postings that are intersected for a clause: its rarest trigrams. Fewer give more candidates, all of which are verified.
TERMS = 2


def clauses_of(rules: tuple[Rule, ...]) -> list[tuple[int, list[str]]]:
    """(rule number, trigrams) of each clause that the index is asked for."""

    def rarity(t: str) -> tuple[int, str]:
        return -sum(FREQUENT.index(c) if c in FREQUENT else len(FREQUENT) for c in t), t

    return [(n, sorted(c, key=rarity)[:TERMS]) for n, r in enumerate(rules) for c in trigram_query(r.pattern)]


def _keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Rows with a key that copies under other ids, null ids and repeated rows don't share or lose.

    With ``carry`` all columns but the text come along in the struct ``row``, and ``null_text`` tells nulls from empty texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = []
    if carry:
        others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
        more = [F.struct(*others).alias("row"), F.col("text").isNull().alias("null_text")]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)
    return own.withColumns({"id": F.coalesce("doc_id", F.lit(-1)), "text_key": F.xxhash64("text")})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, id, text_key) for the trigrams that the rules ask for."""
    asked = sorted({t for _, c in clauses_of(rules) for t in c})
    # lower() has a projection of its own, or each trigram would have it computed again
    low = _keyed(docs).select("id", "text_key", F.lower("text").alias("low"))
    found = F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked))
    return low.select(found.alias("found"), "id", "text_key").select(F.explode("found").alias("trigram"), "id", "text_key").where("trigram is not null")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, text_key, rules): a bit for each rule one of whose clauses has all its postings there."""
    clauses = clauses_of(rules)

    def bit(terms: list[str]) -> Column:
        return F.coalesce(*(F.when(F.col("trigram") == t, F.lit(1 << i)) for i, t in enumerate(terms)), F.lit(0))

    met = index.groupBy("id", "text_key").agg(*(F.bit_or(bit(terms).cast("long")).alias(f"c{k}") for k, (_, terms) in enumerate(clauses)))
    mask = F.lit(0).cast("long")
    for k, (n, terms) in enumerate(clauses):
        mask = mask.bitwiseOR(F.when(F.col(f"c{k}") == (1 << len(terms)) - 1, F.lit(1 << n)).otherwise(0).cast("long"))
    return met.select("id", "text_key", mask.alias("rules")).where("rules <> 0")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(of: Column) -> Column:
    """An array (cheap to name) cut into about as many blocks as a block has elements, so that work within and over blocks stays small."""
    cut = lambda size: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(of) / size).cast("int"), F.lit(1)) - 1), lambda k: F.slice(of, k * size + 1, size)
    )
    return let(F.ceil(F.sqrt(F.size(of))).cast("int"), cut)


def _sums(of: Column) -> Column:
    """Running sums of an array of ints that isn't empty."""
    zero = F.array(F.lit(0))

    def run(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def whole(inner: Column) -> Column:
        before = run(F.transform(inner, lambda xs: F.element_at(xs, -1)))
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda xs, b: F.transform(xs, lambda x: x + b)))

    return let(F.transform(_blocks(of), lambda xs: F.slice(run(xs), 2, F.size(xs))), whole)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Array of (start, kind, end) of the rule's matches that count, in code points."""
    pattern = F.lit(rule.pattern)

    def of(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(hits)), F.length)
        both = F.zip_with(gaps, F.transform(hits, F.length), lambda g, n: F.struct(g.alias("g"), n.alias("n")))
        ended = let(both, lambda b: let(F.transform(b, lambda x: x["g"] + x["n"]), lambda t: F.zip_with(b, _sums(t), lambda x, e: F.struct((e - x["n"]).alias("start"), e.alias("end")))))
        if rule.least > 1:  # matches that are too short are dropped here, as they use up their characters
            kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
            ended = F.filter(F.zip_with(ended, kept, lambda s, k: F.when(F.length(k) >= rule.least, s)), F.isnotnull)
        return F.transform(ended, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    return F.when(F.rlike(text, pattern), let(F.regexp_extract_all(text, pattern, F.lit(0)), of)).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: bool = False) -> DataFrame:
    """(doc_id, text, found): every row with its spans, sorted by start and kind; with ``carry`` also ``row`` and ``null_text``."""
    if sum(1 for r in rules for _ in trigram_query(r.pattern)) > 60 or len(rules) > 60:
        raise ValueError("too many rules for one pass")
    own = _keyed(docs, carry).join(candidates(postings(docs, rules), rules), ["id", "text_key"], "left")
    none = F.array().cast(SPANS)
    parts = []
    for n, r in enumerate(rules):
        spans = _spans(F.col("text"), n, r)
        if trigram_query(r.pattern):
            chosen = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << n).cast("long")) != 0
            spans = F.when(chosen, spans).otherwise(none)
        parts.append(spans)
    return own.select("doc_id", "text", *(["row", "null_text"] if carry else []), F.array_sort(F.concat(*parts)).alias("found"))


def _written(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, and all spans written out."""
    found = F.col("found")
    base = [n for n, r in enumerate(rules) if r.base]

    def count(n: int) -> Column:  # a default argument of the lambda would be taken for the element's index
        return F.size(F.filter(found, lambda s: s["kind"] == n)).cast("long")

    counts = {f"n_{rules[n].kind}": count(n) for n in base}
    only = F.filter(found, lambda s: s["kind"].isin(base))
    return scan(docs, rules).select(
        "doc_id",
        *(c.alias(k) for k, c in counts.items()),
        F.sha2(_written(only, rules), 256).alias("base_sha256"),
        _written(found, rules).alias("spans"),
    )


def _masked(text: Column, found: Column, mask: str) -> Column:
    """The text with the union of the sorted spans replaced, a mask for each run of spans that overlap.

    Spans are taken in blocks: each block cuts its own piece of the text, and its spans cut that.
    """

    def merged(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        span = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        over = (F.size(acc) > 0) & (s["start"] < last["end"])
        return F.when(over, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(span)))

    def _cut(own: Column) -> Column:
        ends = F.concat(F.array(own["at"]), F.transform(own["spans"], lambda s: s["end"]))
        pairs = F.zip_with(own["spans"], ends, lambda s, e: F.struct(s.alias("s"), e.alias("last")))
        gap = lambda p: F.substring(own["piece"], p["last"] - own["at"] + 1, p["s"]["start"] - p["last"])
        part = lambda p: F.when(p["s"].isNull() | (p["s"]["start"] < p["last"]), "").otherwise(F.concat(gap(p), F.lit(mask)))
        return F.array_join(F.transform(pairs, part), "")

    def clean(block: Column) -> Column:
        # spans that the blocks before have masked whole are gone; one that goes on is masked up to its end
        spans = F.filter(block["spans"], lambda s: s["end"] > block["at"])
        piece = lambda s: F.substring(text, block["at"] + 1, F.coalesce(F.try_element_at(s, F.lit(-1))["end"], block["at"]) - block["at"])
        return let(let(spans, lambda s: F.struct(piece(s).alias("piece"), s.alias("spans"), block["at"].alias("at"))), _cut)

    def whole(runs: Column) -> Column:
        # where a block's text starts: at the end of all spans before it
        begins = F.aggregate(runs, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.element_at(b, -1)["end"]))))

        def joined(at: Column) -> Column:
            numbered = F.zip_with(runs, F.slice(at, 1, F.size(runs)), lambda b, a: F.struct(b.alias("spans"), a.alias("at")))
            return F.concat(F.array_join(F.transform(numbered, clean), ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text)))

        return let(begins, joined)

    kind = "array<struct<start:int,end:int>>"
    return let(F.transform(_blocks(found), lambda b: F.aggregate(b, F.array().cast(kind), merged)), whole)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = MASKED, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; n_chars follows where there is one. Rows are shuffled once."""
    scanned = scan(docs, rules, carry=True)
    clean = F.when(F.size("found") > 0, _masked(F.col("text"), F.col("found"), mask)).otherwise(F.col("text"))
    out = scanned.select("row", F.when(~F.col("null_text"), clean).alias("text"), (F.size("found") > 0).alias("hit"))
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c) if c.lower() != "text" else F.col("text")
        if c.lower() == "n_chars":
            value = F.when(F.col("hit"), F.length("text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for ``secrets``: every rule matched against every text."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for n, r in enumerate(rules):
        p = quoted(r.pattern)
        parts.append(
            f"list_filter(list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{"
            f"'start': coalesce(list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))), 0)"
            f" + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i - 1], lambda x: length(x))), 0),"
            f" 'kind': {n}, 'len': length(regexp_extract_all(t, {p})[i]),"
            f" 'own': length(regexp_extract_all(t, {p}, {r.group})[i])}}), lambda s: s.own >= {r.least})"
        )
    kinds = "[" + ", ".join(quoted(r.kind) for r in rules) + "]"
    write = f"lambda s: {kinds}[s.kind + 1] || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.len AS BIGINT)"
    base = [n for n, r in enumerate(rules) if r.base]
    of_base = f"list_filter(f, lambda s: s.kind IN ({', '.join(map(str, base))}))"
    counts = ", ".join(f"CAST(len(list_filter(f, lambda s: s.kind = {n})) AS BIGINT) AS n_{rules[n].kind}" for n in base)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, list_sort({' || '.join(parts)}) AS f FROM d) "
        f"SELECT doc_id, {counts}, sha256(array_to_string(list_transform({of_base}, {write}), ',')) AS base_sha256, "
        f"array_to_string(list_transform(f, {write}), ',') AS spans FROM s"
    )


def brute(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """The same spans by Python's own matcher, for tests."""
    t = text or ""
    return sorted((m.start(), n, m.end()) for n, r in enumerate(rules) for m in re.finditer(r.pattern, t) if len(m[r.group]) >= r.least)
