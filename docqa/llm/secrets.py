"""Secret scans with a trigram inverted index; DataFrame functions only."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docqa.llm.common import column, fresh, table

# The contract's kinds in its order. {n,} equals the plain run with a shorter match dropped.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
# A private key runs from its BEGIN line to the next END line, unless five hyphens stand between. Without END it runs over header
# lines and base64 words and a short last line; each step is matched from the end of the one before (\G), so that a key of any
# length takes neither a bound nor a stack.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
MARK = r"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----"
BETWEEN = r"""[ \t\r\n\\"'>#*,|]*+"""
HEADER = rf"\G{BETWEEN}[A-Z][A-Za-z-]+:\x20[^\r\n]*+"
WORD = rf"\G{BETWEEN}[A-Za-z0-9+/=]{{16,}}+"
LAST = r"\A\r?\n[ \t>#*|]*+[A-Za-z0-9+/]{1,15}={0,2}(?![^\r\n])"
MORE = {
    "pem": PEM,
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}
RULES = BASE | MORE
MASK = "[SECRET]"


def trigram_query(pattern: str) -> list[set[str]]:
    """Alternatives, each a set of lower-case trigrams that all occur in any match by it; [] if some match needs none."""
    parser = re._parser

    def runs(tree) -> list[tuple]:
        """Every way through the pattern as characters, with None where anything may stand."""
        ways = [()]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                step = [(chr(arg).lower(),)]
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
                step = [(c,) for c in sorted({chr(a).lower() for _, a in arg})]
            elif name == "BRANCH":
                step = [way for branch in arg[1] for way in runs(branch)]
            elif name == "SUBPATTERN":
                step = runs(arg[-1])
            elif name == "MAX_REPEAT":
                low, high, body = arg
                one = runs(body)
                step = [*([()] if not low else []), *one] if high == 1 else [(None,)] if not low else [(*way, None) for way in one]
            else:
                step = [(None,)]
            ways = [a + b for a, b in product(ways, step)]
            if len(ways) > 256:
                return [(None,)]
        return ways

    def grams(way: tuple) -> set[str]:
        return {"".join(way[i : i + 3]) for i in range(len(way) - 2) if None not in way[i : i + 3]}

    found = [grams(way) for way in runs(parser.parse(pattern))]
    least = [x for x in found if not any(y < x for y in found)]
    return [] if not all(found) else [x for i, x in enumerate(least) if x not in least[:i]]


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index ``gram, text_hash`` of the trigrams that some rule asks for."""
    low = docs.select(F.xxhash64("text").alias("text_hash"), F.lower("text").alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    return low.select("text_hash", has.alias("has")).select("text_hash", F.explode("has").alias("gram"))


def candidates(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``text_hash, mask``: bit r is set if the trigram query of rule r holds. Texts of one hash share their bits, so copies
    and hash collisions may only add candidates. Rules without a query have no bit."""
    asked = {r: trigram_query(p) for r, p in enumerate(rules.values())}
    grams = sorted({g for q in asked.values() for way in q for g in way})
    clauses = []
    for r, query in asked.items():
        for way in query:
            own = sorted(way)
            clauses += [(len(clauses), r, grams.index(g), 1 << i, (1 << len(own)) - 1, min(own) + str(own)) for i, g in enumerate(own)]
    names = {c[-1] + str(c[1]): i for i, c in enumerate(clauses)}
    rows = [(names[c[-1] + str(c[1])], *c[1:5]) for c in clauses]
    asks = docs.sparkSession.createDataFrame(rows, "clause int, rule int, gram int, bit long, want long")
    hits = postings(docs, grams).join(F.broadcast(asks), "gram")  # as many rows as the rules have trigrams
    met = hits.groupBy("text_hash", "clause", "rule", "want").agg(F.bit_or("bit").alias("got")).filter("got = want")
    return met.groupBy("text_hash").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


def _spans(text: Column, rank: int, kind: str, pattern: str) -> Column:
    """Array of start, rank, kind, end. Texts between matches come from a split, so positions are running lengths."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    parts = F.arrays_zip(F.transform(found, F.length).alias("n"), F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"), F.transform(value, F.length).alias("v"))
    span = "array<struct<start:int,rank:int,kind:string,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + x["gap"]
        one = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + x["n"]).alias("end")))
        keep = F.when(x["v"] >= 8, F.concat(a["out"], one)).otherwise(a["out"])
        return F.struct((at + x["n"]).alias("at"), keep.alias("out"))

    return F.aggregate(parts, start, step, lambda a: a["out"])


def _key_body(rest: Column) -> Column:
    """How far a key without END reaches into the text after its BEGIN line."""
    size = lambda found: F.aggregate(F.transform(found, F.length), F.lit(0), lambda a, n: a + n)
    heads = size(F.regexp_extract_all(rest, F.lit(HEADER), F.lit(0)))

    def from_words(x: Column) -> Column:
        body = F.substring(rest, x + 1, F.length(rest))
        words = size(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
        last = F.length(F.regexp_extract(F.substring(body, words + 1, F.length(rest)), LAST, 0))
        return x + F.when(words > 0, words + last).otherwise(0)

    return F.element_at(F.transform(F.array(heads), from_words), 1)


def _key_spans(text: Column, rank: int, kind: str) -> Column:
    """As ``_spans``, for private keys: BEGIN and END lines by place, each BEGIN with the END that follows it."""
    marks, gaps = F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), F.split(text, MARK, -1)
    n = F.size(marks)
    parts = F.arrays_zip(marks.alias("mark"), F.slice(gaps, 1, n).alias("before"), F.slice(gaps, 2, n).alias("rest"), F.concat(F.slice(marks, 2, n), F.array(F.lit(""))).alias("next"))
    span = "array<struct<start:int,rank:int,kind:string,end:int>>"

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + F.length(x["before"])
        after = at + F.length(x["mark"])
        paired = F.startswith(x["next"], F.lit("-----END")) & ~F.contains(x["rest"], F.lit("-----"))
        end = after + F.when(paired, F.length(x["rest"]) + F.length(x["next"])).otherwise(_key_body(x["rest"]))
        one = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(after.alias("at"), F.when(F.startswith(x["mark"], F.lit("-----BEGIN")), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out")), step, lambda a: a["out"])


def scan(docs: DataFrame, rules: dict[str, str] = RULES, name: str = "secret_spans") -> DataFrame:
    """``docs`` with the column ``name``: all spans (start, rank, kind, end; code points, end exclusive) by start, then rule.

    Every rule is verified on the whole text of each candidate of its trigram query; rules without mandatory trigrams run
    on all texts. Null and empty texts have no spans; every row stays, repeated ones too; no column but ``text`` is read; an
    empty table gives none. A column ``name`` of the input is replaced, all others stay.
    """
    docs = docs.drop(name)
    key, own, mask_of = fresh(docs, "text_key", "text_hash", "mask")
    found = candidates(docs, rules).select(F.col("text_hash").alias(own), F.col("mask").alias(mask_of))
    marked = docs.withColumn(key, F.xxhash64("text")).join(found, F.col(key) == F.col(own), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    text, mask, parts = F.col("text"), F.coalesce(mask_of, F.lit(0)), []
    for rank, (kind, pattern) in enumerate(rules.items()):
        may = mask.bitwiseAND(F.lit(1 << rank)) != 0 if trigram_query(pattern) else F.lit(True)
        spans = _key_spans(text, rank, kind) if pattern == PEM else _spans(text, rank, kind, pattern)
        parts.append(F.when(may & text.rlike(pattern), spans).otherwise(none))
    return marked.withColumn(name, F.array_sort(F.concat(*parts))).drop(key, own, mask_of)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Every span replaced by ``MASK`` (overlapping spans once); ``n_chars``, if there, follows. Every row stays, repeated ones
    too; null and empty texts stay as they are; the columns are those of ``docs``; an empty table gives none."""
    spans = fresh(docs, "spans_found")[0]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = x["start"] >= a["at"]
        out = F.when(new, F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), F.lit(MASK))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(F.col("text"))
    out = scan(docs, name=spans).withColumn("text", clean)
    out = out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
    return out.select(*map(column, docs.columns))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


QUERIES = {"op1_secrets": op1_secrets}
