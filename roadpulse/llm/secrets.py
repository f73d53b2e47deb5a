"""Secrets in texts: base patterns, and credentials that come in parts.

Base spans (assign, access, hex) stand alone. Weaker candidates, a bare random
string or a value behind a vague name, and a user or client name, count only
where the complementary part lies within SCOPE code points of them: an
interval semi-join of parts, cut into cells of a scope's length, so that no
pair is ever listed. Copies of a text are linked once.

Nulls and edges: a null text is empty and has no spans; null and repeated
doc_ids keep their rows; an empty table gives no rows; spans of different kinds
may overlap and all are reported. Other columns are passed through by `redact`
and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, let

# The base patterns. The lengths of access and hex are part of
# them, since both take a run to its end; a short assigned value still takes
# its place and is dropped afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_CHARS = 8

# Parts of credentials. A weak secret is a long run of mixed letters and digits
# or a value behind a vaguer name.
SCOPE = 500
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,40}[0-9])(?=[0-9a-z+/_-]{0,40}[A-Z])(?=[0-9A-Z+/_-]{0,40}[a-z])[A-Za-z0-9+/_-]{24,}"
VAGUE = r"""(?<![A-Za-z])(?i:pwd|pass|passphrase|credentials?|private_?key|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
IDENT = r"""(?<![A-Za-z])(?i:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
ENDPOINT = r"""(?i:(?:https?|ftp|ssh|jdbc:[a-z]{2,12}|postgres|postgresql|mysql|mongodb|redis|amqp)://[a-z0-9._~:/?#@%+=&-]+|(?<![a-z])(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9._-]{3,})"""

# Order among spans with one start.
KINDS = ("assign", "access", "hex", "weak", "ident", "endpoint")
BASE = KINDS[:3]

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places in code points. What
    lies between matches and the matches themselves add up to the places."""

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x).alias("size")))
        empty = F.lit(None).cast("array<struct<start:int,end:int>>")
        start = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array()).alias("out"))

        def add(acc: Column, s: Column) -> Column:
            begin = acc["at"] + s["gap"]
            new = F.struct(begin.alias("start"), (begin + s["size"]).alias("end"))
            return F.struct((begin + s["size"]).alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

        return F.aggregate(steps, start, add)["out"]

    whole = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if least:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        paired = F.arrays_zip(whole.alias("s"), values.alias("v"))
        whole = F.transform(F.filter(paired, lambda p: F.length(p["v"]) >= least), lambda p: p["s"])
    spans = F.transform(whole, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    none = F.array().cast(_SPAN)
    return F.when(text.rlike(pattern), spans.cast(_SPAN)).otherwise(none)


def _base(text: Column) -> Column:
    parts = [_spans(text, "assign", ASSIGN, 1, ASSIGN_CHARS), _spans(text, "access", ACCESS), _spans(text, "hex", HEX)]
    return F.concat(*parts)


def _parts(text: Column, base: Column) -> Column:
    """Weak secrets outside the base spans, identifiers and endpoints."""
    weak = F.concat(_spans(text, "weak", RANDOM), _spans(text, "weak", VAGUE))
    idents = _spans(text, "ident", IDENT)

    def apart(s: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    ends = _spans(text, "endpoint", ENDPOINT)
    return F.concat(F.filter(weak, apart), F.filter(idents, apart), ends)


def with_spans(docs: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and an array `name` of all spans, in order."""
    base, parts, text, key = (fresh(docs, c) for c in ("base", "parts", "whole", "text_key"))
    found = docs.withColumn(text, F.coalesce("text", F.lit("")))
    found = found.withColumn(base, let(F.col(text), _base))
    found = found.withColumn(parts, let(F.struct(F.col(text).alias("t"), F.col(base).alias("b")), lambda x: _parts(x["t"], x["b"])))
    weak = F.exists(parts, lambda p: p["kind"] != "endpoint")
    found = found.withColumn(key, F.when(weak, F.sha2(text, 256)))
    found = cut_lineage(found.select(*keep, base, parts, key))

    open_ = found.filter(F.col(key).isNotNull())
    linked = _linked(open_.select(F.col(key).alias("key"), F.concat(base, parts).alias("all")).dropDuplicates(["key"]))
    linked = linked.select(F.col("key").alias(key), F.col("more").alias(parts))
    closed = found.filter(F.col(key).isNull()).select(*keep, F.sort_array(base).alias(name))
    joined = open_.drop(parts).join(linked, key, "left")
    more = F.coalesce(parts, F.array().cast(_SPAN))
    return closed.unionByName(joined.select(*keep, F.sort_array(F.concat(base, more)).alias(name)))


def _linked(texts: DataFrame) -> DataFrame:
    """(key, more): the weak spans that have their complement in scope."""
    spans = texts.select("key", F.explode("all").alias("s")).select("key", "s.*").distinct()
    names = F.col("kind").isin("ident", "access")
    role = F.when(names, "name").when(F.col("kind") == "endpoint", "place").otherwise("secret")
    spans = spans.withColumn("role", role)
    cells = F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))
    near = F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))
    there = spans.select("key", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("role2"), F.explode(cells).alias("cell"))
    asked = spans.filter(F.col("kind").isin("weak", "ident")).withColumn("cell", F.explode(near))
    complement = F.when(F.col("role") == "secret", F.col("role2") != "secret").otherwise(F.col("role2") == "secret")
    gap = F.greatest(F.col("s2") - F.col("end"), F.col("start") - F.col("e2"), F.lit(0))
    a, t = asked.alias("a"), there.alias("t")
    on = (F.col("a.key") == F.col("t.key")) & (F.col("a.cell") == F.col("t.cell")) & complement & (gap <= SCOPE)
    met = a.join(t, on, "left_semi").select("key", F.struct("start", "rank", "kind", "end").alias("s")).distinct()
    return met.groupBy("key").agg(F.collect_list("s").alias("more"))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans, their digest, and all spans."""
    found = with_spans(docs.select("doc_id", "text"), "found", ["doc_id"])
    base = F.filter("found", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"))


def redact(docs: DataFrame, marker: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced; overlapping spans become one."""
    name = fresh(docs, "found")
    marked = with_spans(docs, name, docs.columns)

    def cut(x: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def add(acc: Column, s: Column) -> Column:
            between = F.substring(x["t"], acc["at"] + 1, s["start"] - acc["at"])
            out = F.when((s["start"] < acc["at"]) & (acc["at"] > 0), acc["out"]).otherwise(F.concat(acc["out"], between, F.lit(marker)))
            return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        return F.aggregate(x["s"], start, add, lambda a: F.concat(a["out"], F.substring(x["t"], a["at"] + 1, F.length(x["t"]))))

    hit = F.size(name) > 0
    text = F.when(hit, let(F.struct(F.col("text").alias("t"), F.col(name).alias("s")), cut)).otherwise(F.col("text"))
    out = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
