"""Secret scanning over a trigram inverted index, with DataFrame functions only.

Each rule is a regular expression. Its Boolean trigram query (an OR of ANDs of trigrams that a match must
contain) is derived from the expression; the postings (trigram, document) of those trigrams are
intersected, and only the candidates are verified with the expression. A rule without a mandatory trigram
scans every text. The index holds ASCII-lower-cased trigrams, so candidates are a superset. Of each alternative, a text is asked for its
trigram of the rarest letters first; one that lacks it gets no posting of the others.

Edge cases: a null text is scanned as the empty text; documents that share an id share
their candidates, which only adds work, and so do those of one text that have no id; matches of one rule never overlap, matches of several rules may;
an empty table gives no rows. Offsets are code points, end exclusive. A very long text is scanned whole by one task, its matches in blocks, so that time
grows with their number. Other columns pass through whatever their names; `_spans` replaces an input column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _parser as parser  # the standard library's parse tree of a pattern

from .common import materialise, prepare


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    base: bool = False
    group: int = 0  # the group whose length counts
    least: int = 0  # least length of that group, or the match is dropped


#: The base kinds in their order, then token formats published by the services themselves.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", True, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

#: To the END line without another one before it, or over the header fields and base64 lines that follow. Possessive, so that no text is tried twice.
_KEY = (
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr]){1,4}[A-Za-z-]{1,30}: [^\r\n]*+)*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{20,}+)++(?:\s{1,4}[A-Za-z0-9+/]{1,76}={0,2}(?=\s*(?:[\r\n]|$)))?+)?+)"
)
#: What redact() covers: of a private key not only its BEGIN line, which is all that summary() reports, but the key.
COVERED = tuple(Rule(r.kind, r.pattern + _KEY) if r.kind == "pem" else r for r in RULES)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The alternatives of a pattern's trigram query, each a set of trigrams; [] if the rule must scan."""

    def lower(c: int) -> str:
        return chr(c).lower() if c < 128 else chr(c)

    def strings(node) -> list[str] | None:
        """All strings that a node matches, if they are few."""
        op, arg = node
        name = str(op)
        if name == "LITERAL":
            return [lower(arg)]
        if name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
            return sorted({lower(a) for _, a in arg})
        if name == "MAX_REPEAT" and arg[1] <= 1:
            inner = sequence(arg[2])
            return None if inner is None else ([""] if arg[0] == 0 else []) + inner
        if name == "SUBPATTERN":
            return sequence(arg[3])
        if name == "BRANCH":
            parts = [sequence(x) for x in arg[1]]
            return None if None in parts else [s for p in parts for s in p]
        return None

    def sequence(nodes) -> list[str] | None:
        out = [""]
        for node in nodes:
            s = strings(node)
            if s is None or len(out) * len(s) > 64:
                return None
            out = [a + b for a, b in product(out, s)]
        return out

    grams = lambda s: frozenset(s[i : i + 3] for i in range(len(s) - 2))
    runs, open_run = [], [""]  # literal stretches, each a list of alternatives
    for node in parser.parse(pattern):
        s = strings(node)
        if s is None or len(open_run) * len(s) > 64:
            runs.append(open_run)
            open_run = [""] if s is None else s
        else:
            open_run = [a + b for a, b in product(open_run, s)]
    runs.append(open_run)
    query = [frozenset()]
    for run in runs:
        options = {grams(s) for s in run}
        if frozenset() not in options and len(query) * len(options) <= 64:
            query = [a | b for a, b in product(query, options)]
    # an alternative that contains another one adds nothing
    query = [q for q in set(query) if not any(o < q for o in set(query))]
    return [] if frozenset() in query else sorted(query, key=sorted)


def _rarity(trigram: str) -> int:
    """How rare a trigram's letters are in running text, by the order of their frequency."""
    return sum("etaoinshrdlucmfwypvbgkqjxz".find(c) % 30 for c in trigram)


def postings(docs: DataFrame, branches: list[frozenset[str]], key: Column, text: Column) -> DataFrame:
    """The inverted index's rows for the trigrams of the alternatives: trigram, doc."""
    rest: dict[str, set[str]] = {}
    for trigrams in branches:
        lead = max(trigrams, key=lambda t: (_rarity(t), t))
        rest.setdefault(lead, set()).update(trigrams)
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, sorted(x))) for lead in sorted(rest) for x in (lead, rest[lead])])

    def within(low: Column) -> Column:
        leads = F.filter(F.array(*map(F.lit, sorted(rest))), lambda t: F.contains(low, t))
        return F.filter(F.array_distinct(F.flatten(F.transform(leads, lambda t: F.element_at(table, t)))), lambda t: F.contains(low, t))

    found = F.flatten(F.transform(F.array(F.lower(text)), within))
    return docs.select(key.alias("doc"), F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules, key: Column, text: Column) -> DataFrame:
    """doc, rules (array of kinds): the documents whose postings satisfy a rule's query."""
    spark = docs.sparkSession
    queries = [(r.kind, i, q) for r in rules for i, q in enumerate(trigram_query(r.pattern))]
    rows = [(kind, f"{kind}{i}", t, len(q)) for kind, i, q in queries for t in sorted(q)]
    table = F.broadcast(spark.createDataFrame(rows, "kind string, branch string, trigram string, need int"))  # as many rows as the rules have trigrams
    index = postings(docs, [q for _, _, q in queries], key, text)
    hits = index.join(table, "trigram").groupBy("doc", "kind", "branch", "need").agg(F.count_distinct("trigram").alias("n"))
    return hits.where("n = need").groupBy("doc").agg(F.collect_set("kind").alias("rules"))


_SPANS = "array<struct<start:int,kind:string,end:int>>"


def _in_blocks(items: Column, fold, size: int = 1000) -> Column:
    """fold(block) of each `size` items, as an array: appending to one array over and over copies it each time."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / size), F.lit(0)).cast("int")), lambda b: fold(F.slice(x, b * size + 1, F.lit(size))))
    return F.transform(F.array(items), cut)[0]


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, kind, end) of a rule's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    none = F.array().cast(_SPANS)

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["gap"])
        end = start + F.length(z["hit"])
        span = F.struct(start.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        value = z["hit"] if rule.group == 0 else F.regexp_extract(z["hit"], rule.pattern, rule.group)
        keep = F.length(value) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def add(acc: Column, block: Column) -> Column:  # a block's spans count from its own beginning
        moved = F.transform(block["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.array_append(acc["blocks"], moved).alias("blocks"))

    blocks = _in_blocks(pairs, lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("spans")), step))
    spans = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("blocks")), add, lambda acc: F.flatten(acc["blocks"]))
    return F.when(F.rlike(text, F.lit(rule.pattern)), spans).otherwise(none)


def _scanned(docs: DataFrame, rules, key: str, text: str) -> DataFrame:
    """row (the input's columns), body, spans: array of (start, kind, end), by start, then by the rules' order."""
    prepare(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    ident = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.xxhash64(body).cast("string")))
    found = materialise(candidates(docs, rules, ident, body), "secret-candidates")
    joined = docs.select(F.struct(*docs.columns).alias("row"), ident.alias("doc"), body.alias("body")).join(found, "doc", "left")
    none = F.array().cast(_SPANS)
    parts = []
    for rule in rules:
        spans = matches(F.col("body"), rule)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("rules", rule.kind), spans).otherwise(none)
        parts.append(F.coalesce(spans, none))
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    by = F.array_sort(F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(by, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return joined.select("row", "body", spans.alias("spans"))


def find_secrets(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a column _spans besides: array of (start, kind, end), by start, then by the rules' order."""
    found = _scanned(docs, rules, key, text)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "_spans"], F.col("spans").alias("_spans"))


def join_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(docs.select("doc_id", "text"), rules)
    base = F.filter("_spans", lambda s: s["kind"].isin([r.kind for r in rules if r.base]))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(join_spans(base).cast("binary"), 256).alias("base_sha256"), join_spans(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules=COVERED, mark: str = "[SECRET]") -> DataFrame:
    """docs whose texts have each stretch covered by matches replaced by a mark (a null text stays null)."""
    found = _scanned(docs, rules, "doc_id", "text")
    body = F.col("body")
    pieces = F.array().cast("array<string>")

    def step(part: Column, base: Column):
        def run(acc: Column, s: Column) -> Column:  # stretches that touch or overlap are one
            gap = F.substr(part, acc["at"] - base + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            fresh = ~acc["any"] | (s["start"] > acc["at"])
            out = F.when(fresh, F.array_append(acc["out"], F.concat(gap, F.lit(mark)))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"), F.lit(True).alias("any"))

        return run

    def add(acc: Column, block: Column) -> Column:  # a block goes on where the ones before it end, and cuts its own part out of the text first
        zero = F.struct(acc["at"].alias("at"), pieces.alias("out"), acc["any"].alias("any"))
        part = F.substr(body, acc["at"] + 1, F.greatest(F.array_max(F.transform(block, lambda s: s["end"])) - acc["at"], F.lit(0)))
        done = F.transform(F.array(part), lambda p: F.aggregate(block, zero, step(p, acc["at"])))
        done = F.transform(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], F.array_join(d["out"], "")).alias("out"), d["any"].alias("any")))
        return done[0]

    zero = F.struct(F.lit(0).alias("at"), pieces.alias("out"), F.lit(False).alias("any"))
    clean = F.aggregate(_in_blocks(F.col("spans"), lambda part: part), zero, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(body, acc["at"] + 1)))
    new = F.when(F.size("spans") > 0, clean).otherwise(F.col("row.text"))
    return found.select(*[new.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def sql(rules=RULES) -> str:
    """DuckDB SQL of summary(): positions from the lengths of matches and of the pieces between them."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        value = f"regexp_extract(m, '{p}', {r.group})" if r.group else "m"
        parts.append(
            f"SELECT r, {i} AS k, '{r.kind}' AS kind, {str(r.base).lower()} AS base, "
            f"list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s, length(m) AS n "
            f"FROM (SELECT r, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS ms, unnest(regexp_extract_all(text, '{p}')) AS m, "
            f"generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM d) WHERE length({value}) >= {r.least}"
        )
    spans = "\nUNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({spans}),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) FILTER (base) AS b,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""
