"""Secret scans with multipart credential linking.

Base kinds are reported wherever they match. Weak candidates (identifiers, keys, endpoints) are reported
only when complementary parts lie within ``within`` code points in the same scope, a part of the text
without an empty line: an identifier near a secret, a key near an identifier, an endpoint near both.
The interval join asks for each candidate's nearest complement before and after it, none that it overlaps, with
windows over the ends of a scope's spans, so no pairs are made however many candidates a scope has.

Spans are sums of the lengths that a pattern's split and its matches have in turn; only lengths leave
the scan. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import keep


@dataclass(frozen=True)
class Kind:
    """A pattern; of its matches those with `least` characters in `group` count, and `needs` all match in it."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    role: str = ""
    needs: tuple[str, ...] = ()


BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, "secret"),
    Kind("access", r"AKIA[A-Z0-9]+", 16, 0, "identifier"),
    Kind("hex", r"[0-9a-f]{32,}", 32, 0, "secret"),  # as [0-9a-f]+ of 32 or more: a run cannot begin inside another
)
WEAK = (
    Kind("id", r"""(?i:(access_?key_?id|client_?id|account_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 4, 2, "identifier"),
    Kind("key", r"[A-Za-z0-9+/_-]{20,}", 20, 0, "secret", ("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", r"""(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|s3|amqp)://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?""", 7, 0, "endpoint"),
)
EMPTY_LINE = Kind("break", r"\n[\x20\x09\x0D]*\n", 1)
KINDS = (*BASE, *WEAK, EMPTY_LINE)


def _lengths(text: Column, kind: Kind) -> Column:
    """For each match: length of the gap before it, its length, and whether it counts. Null without a match."""
    pattern = F.lit(kind.pattern)
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    part = found if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))

    def counts(p: Column) -> Column:
        good = F.length(p) >= kind.least
        for n in kind.needs:
            good = good & p.rlike(n)
        return good

    rows = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), F.arrays_zip(F.transform(found, F.length).alias("n"), F.transform(part, counts).alias("ok")), lambda g, m: F.struct(g.alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    return F.when(text.rlike(kind.pattern), rows)


def scan(docs: DataFrame, within: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id and spans, an array of (start, rank, kind, end) ordered by start and kind.

    Offsets are code points, end exclusive. Null texts are empty; repeated rows and ids each get a row; other
    columns are ignored. A weak candidate that overlaps a base span is not reported again; a key that overlaps an id's
    span is part of it."""
    t = F.coalesce(F.col(text), F.lit(""))
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), t.alias("text"))
    scanned = scanned.select("row", "doc_id", "text", *[_lengths(F.col("text"), k).alias(k.name) for k in (*BASE, *WEAK)])
    weak = F.coalesce(*[F.col(k.name) for k in WEAK]).isNotNull()
    scanned = scanned.withColumn("break", F.when(weak, _lengths(F.col("text"), EMPTY_LINE))).drop("text")
    scanned = keep(scanned, "secrets")
    some = F.coalesce(*[F.col(k.name) for k in KINDS]).isNotNull()
    empty = scanned.where(~some).select("doc_id", F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)").alias("spans"))
    each = scanned.where(some).select("row", "doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k.name).alias("kind"), F.lit(k.role).alias("role"), F.col(k.name).alias("m")) for i, k in enumerate(KINDS)])).alias("k")).where("k.m is not null")
    each = each.select("row", "doc_id", "k.rank", "k.kind", "k.role", F.posexplode("k.m").alias("at", "m"))
    order = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(order)
    spans = each.select("row", "doc_id", "rank", "kind", "role", F.col("m.ok").alias("ok"), (end - F.col("m.n")).cast("long").alias("start"), end.cast("long").alias("end"))
    # Rows without a match that counts stay, so that their documents do.
    in_row = Window.partitionBy("row").orderBy("start", "rank")
    spans = spans.withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(in_row))
    near = Window.partitionBy("row", "scope").orderBy("start", "rank")
    before, after = near.rowsBetween(Window.unboundedPreceding, -1), near.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("rank") < len(BASE)

    def overlaps(among: Column) -> Column:
        last, first = F.max(F.when(F.col("ok") & among, F.col("end"))).over(before), F.min(F.when(F.col("ok") & among, F.col("start"))).over(after)
        return F.coalesce(last > F.col("start"), F.lit(False)) | F.coalesce(first < F.col("end"), F.lit(False))

    # A weak span inside a base one is reported already, and a key that is an identifier's value is no secret beside it.
    part = spans.withColumns({"_base": overlaps(base), "_value": overlaps(F.col("kind") == "id")})
    part = part.withColumn("ok", F.col("ok") & (base | ~(F.col("_base") | ((F.col("kind") == "key") & F.col("_value")))))
    # Each span's two ends in order of place: what ends at or before its start, and what starts at or after its end, is beside it.
    ends = part.withColumn("e", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("side")), F.struct(F.col("end").alias("at"), F.lit(0).alias("side")))))
    ends = ends.select("row", "doc_id", "rank", "kind", "role", "ok", "start", "end", "scope", "e.at", "e.side")
    in_order = Window.partitionBy("row", "scope").orderBy("at", "side")
    gone, ahead = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(1, Window.unboundedFollowing)

    def beside(role: str) -> Column:
        of = lambda side: F.when(F.col("ok") & (F.col("role") == role) & (F.col("side") == side), F.col("at"))
        last, first = F.max(of(0)).over(gone), F.min(of(1)).over(ahead)
        return F.coalesce(F.when(F.col("side") == 1, F.col("at") - last <= within).otherwise(first - F.col("at") <= within), F.lit(False))

    ends = ends.withColumns({"by_identifier": beside("identifier"), "by_secret": beside("secret")})
    spans = ends.groupBy("row", "rank", "start", "end", "kind").agg(F.first("doc_id").alias("doc_id"), F.first("ok").alias("ok"), F.max("by_identifier").alias("by_identifier"), F.max("by_secret").alias("by_secret"))
    linked = F.when(base, True).when(F.col("kind") == "id", F.col("by_secret")).when(F.col("kind") == "key", F.col("by_identifier")).when(F.col("kind") == "endpoint", F.col("by_identifier") & F.col("by_secret")).otherwise(False)
    span = F.when(F.col("ok") & linked, F.struct("start", "rank", "kind", "end"))
    found = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    return empty.unionByName(found.select("doc_id", "spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < len(BASE))
